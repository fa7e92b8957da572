"""Near-duplicate line removal by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are near when their word sequences differ by at most one edit (a word replaced, added or
left out). Deleting one word from either gives them an equal variant: a replacement when the same
place is deleted in both, an insertion when the longer line less a word is the shorter line.

Emitting every variant of every line would write a row for each word of the corpus, so variants are
emitted in two steps that together lose nothing. First each line is cut in BLOCKS blocks and emits
one variant for each block with that whole block deleted; an edit lies inside one block, so a near
pair shares at least one of these. Then only lines that share a block variant with a different line
emit their single-word deletions, and only inside that block. Equal keys are grouped to their
earliest line and joined back, so a key that millions of lines share is never paired out. Every
match is confirmed by its real edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_groups
from .store import release, written

BLOCKS = 2


def _spaced(text: Column) -> Column:
    """White space other than newlines as spaces, so that single-character splits do."""
    for c in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(line: Column) -> Column:
    """Runs outside [\\x20\\x09-\\x0D]."""
    return F.array_remove(F.split(_spaced(line), " "), "")


def _once(x: Column) -> Column:
    """x as a generated column: the optimiser would otherwise copy it into every expression that reads it."""
    return F.explode(F.array(x))


def _near(a: Column, b: Column) -> Column:
    """True where two word arrays are at most one edit apart."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")

    def rest(x: Column, start: Column) -> Column:
        return F.slice(x, F.greatest(start, F.lit(1)), F.size(x))

    return (
        F.when(F.abs(F.size(a) - F.size(b)) > 1, False)
        .when(at == 0, True)
        .when(F.size(a) == F.size(b), rest(a, at + 1) == rest(b, at + 1))
        .when(F.size(a) > F.size(b), rest(a, at + 1) == rest(b, at))
        .otherwise(rest(a, at) == rest(b, at + 1))
    )


def _block(base: Column, j: Column | int) -> tuple[Column, Column]:
    """Words before and after block j of a line of `base` words."""
    before = F.floor(base * j / BLOCKS).cast("int")
    return before, (base - F.floor(base * (j + 1) / BLOCKS)).cast("int")


def _block_key(words: Column, base: Column, j: int) -> Column:
    before, after = _block(base, j)
    return F.xxhash64(base, F.lit(j), F.slice(words, 1, before), F.slice(words, F.size(words) - after + 1, after))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_words: int = 8, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Drop each line that an earlier line equals, or comes within max_edits word edits of.

    Lines end at a newline; words are runs of bytes outside [\\x20\\x09-\\x0D]. Earlier is a smaller
    id, or the same id and a smaller line number; a line is judged against all lines of the input,
    also those that are dropped themselves. Lines of fewer than min_words words (at least 2) are
    only compared for equal words, lines without words always stay. max_edits is 0 or 1.

    Returns (id, n_lines, n_removed, text): one row for each input row, text the lines that stay.
    A null text has no lines and gives an empty text. Rows with a null id are left out. In rows that
    repeat an id, lines with equal numbers are neither earlier than the other; what is dropped at a
    line number is dropped in all rows of that id. Other columns are ignored, but for those named in
    carry, which follow the others (renamed to carry_ and their number).
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    carried = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carried).filter("id is not null")
    texts = source.repartition("id")
    lines = source.select("id", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line", "s"))
    lines = lines.select("id", "line", _once(F.array_remove(F.split("s", " "), "")).alias("w"))
    n = F.size("w")
    keys = [_block_key(F.col("w"), (n - less).cast("int"), j) for less in (0, 1) for j in range(BLOCKS)]
    lines = lines.filter(n > 0).select(
        "id",
        "line",
        F.xxhash64("w").alias("h1"),
        F.xxhash64(F.lit(7), F.col("w")).alias("h2"),
        F.when((n >= min_words) & F.lit(max_edits > 0), F.array(*keys)).alias("keys"),
    )
    lines = written(lines)
    earliest = lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    placed = join_groups(lines.select("id", "line", "h1", "h2"), earliest, ["h1", "h2"], "n", lines.count())
    gone = written(placed.filter("struct(id, line) > first").select("id", "line"))
    if max_edits:
        near = written(_near_lines(lines, gone, texts, used := []))
        for done in (lines, *used):
            release(done)
        gone = gone.union(near)
    removed = gone.groupBy("id").agg(F.collect_set("line").alias("removed"))
    whole = texts.join(removed.hint("shuffle_hash"), "id", "left").withColumn("lines", F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")))
    count = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), count - 1), "removed")
    kept = F.when(F.col("removed").isNotNull() & (count > 0), F.transform(stay, lambda i: F.get("lines", i)))
    names = [f"carry_{i}" for i in range(len(carry))]
    return whole.select("id", "text", count.alias("n"), kept.alias("kept"), *names).select(
        "id",
        F.col("n").cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.col("n") - F.size("kept")).cast("long").alias("n_removed"),
        F.when(F.col("kept").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("kept", "\n")).alias("text"),
        *names,
    )


def _near_lines(lines: DataFrame, copies: DataFrame, texts: DataFrame, used: list[DataFrame]) -> DataFrame:
    """(id, line) of the lines that have an earlier line one word edit away; `used` takes the tables written on the way."""
    entries = lines.filter("keys is not null").select("id", "line", "h1", F.posexplode("keys").alias("kind", "key"))
    shared = entries.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select("key")
    places = entries.select("id", "line", "kind", "key").join(shared, "key").join(copies, ["id", "line"], "left_anti")
    places = written(places.groupBy("id").agg(F.collect_list(F.struct("line", "kind", "key")).alias("places")))

    def line_words(line: Column) -> Column:
        return _words(F.get("lines", line))

    found = texts.join(places.hint("shuffle_hash"), "id").select("id", "places", F.split("text", "\n").alias("lines"))
    found = found.select("id", F.explode(F.transform("places", lambda p: F.struct(p.line.alias("line"), p.kind.alias("kind"), p.key.alias("key"), line_words(p.line).alias("w")))).alias("p"))
    found = found.select("id", "p.*").filter("w is not null")
    less = F.floor(F.col("kind") / BLOCKS).cast("int")
    base = F.size("w") - less
    before, after = _block(base, F.col("kind") % BLOCKS)
    middle = F.slice("w", before + 1, F.greatest(F.size("w") - before - after, F.lit(0)))
    # Eight bytes for each word: cutting a word out copies bytes, not arrays.
    middle = F.unhex(F.array_join(F.transform(middle, lambda w: F.lpad(F.hex(F.xxhash64(w)), 16, "0")), ""))
    found = found.select("id", "line", "key", less.alias("less"), _once(middle).alias("m")).filter("length(m) > 0")

    def variant(i: Column) -> Column:
        cut = F.concat(F.substring("m", F.lit(1), 8 * (i - 1)), F.substring("m", 8 * i + 1, F.length("m")))
        return F.struct(F.xxhash64("key", F.when(F.col("less") == 0, i).otherwise(0), cut).alias("k"), F.col("less").alias("role"))

    whole = F.struct(F.xxhash64("key", F.lit(0), "m").alias("k"), F.lit(2).alias("role"))
    variants = F.transform(F.sequence(F.lit(1), (F.length("m") / 8).cast("int")), variant)
    found = found.select("id", "line", F.explode(F.when(F.col("less") == 0, F.concat(variants, F.array(whole))).otherwise(variants)).alias("v"))
    found = found.select("id", "line", "v.k", "v.role")
    # Role 0 meets role 0 (a word replaced at one place); 1 (a word left out) meets 2 (a whole line).
    at = F.struct("id", "line")
    best = found.groupBy("k").agg(*[F.min(F.when(F.col("role") == r, at)).alias(f"b{r}") for r in range(3)])
    best = best.filter("b0 is not null or (b1 is not null and b2 is not null)")
    other = F.when(F.col("role") == 0, F.col("b0")).when(F.col("role") == 1, F.col("b2")).otherwise(F.col("b1"))
    pairs = found.join(best, "k").select("id", "line", other.alias("o")).filter("o < struct(id, line)").select("id", "line", "o.id", "o.line")
    pairs = pairs.toDF("id", "line", "id0", "line0").distinct()

    pairs = written(pairs)
    # The words of every place that a pair names, fetched from each text once; hub lines are joined apart.
    named = pairs.select("id", "line").union(pairs.select("id0", "line0")).groupBy("id").agg(F.collect_set("line").alias("named"))
    fetched = texts.join(named.hint("shuffle_hash"), "id").select("id", "named", F.split("text", "\n").alias("lines"))
    fetched = fetched.select("id", F.explode(F.transform("named", lambda p: F.struct(p.alias("line"), line_words(p).alias("w")))).alias("p"))
    fetched = written(fetched.select("id", "p.line", "p.w"))
    used += [places, pairs, fetched]
    hubs = fetched.toDF("id0", "line0", "b").join(pairs.groupBy("id0", "line0").agg(F.count("*").alias("n")), ["id0", "line0"])
    both = join_groups(pairs.join(fetched.withColumnRenamed("w", "a"), ["id", "line"]), hubs, ["id0", "line0"], "n", pairs.count())
    return both.filter(_near(F.col("a"), F.col("b"))).select("id", "line")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
with d as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
l as (select doc_id, unnest(range(len(ls))) as i, ls from d),
w as (select doc_id, i, ls[i + 1] as s, list_filter(regexp_split_to_array(ls[i + 1], '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from l),
u as (select ws, min((doc_id, i)) as f from w where len(ws) > 0 group by ws),
big as (select *, row_number() over () as id from u where len(ws) >= 8),
v as (select id, f, len(ws) as n, unnest(range(1, len(ws) + 1)) as p, ws from big),
x as (select id, f, n, p, md5(array_to_string(list_concat(ws[1:p-1], ws[p+1:]), ' ')) as k from v),
y as (select id, f, len(ws) as n, md5(array_to_string(ws, ' ')) as k from big),
s as (select k, n, p, min(f) as g from x group by all),
e as (select x.id, s.g from x join s on x.k = s.k and x.n = s.n and x.p = s.p
      union all select x.id, y.f from x join y on y.k = x.k and y.n = x.n - 1
      union all select y.id, x.f from x join y on y.k = x.k and y.n = x.n - 1),
g as (select id, min(g) as g from e group by id),
z as (select u.ws, u.f, g.g from u left join big on big.ws = u.ws left join g on g.id = big.id),
r as (select w.doc_id, w.i, w.s, coalesce((w.doc_id, w.i) > z.f or z.g < z.f, false) as gone from w left join z on z.ws = w.ws),
a as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
      string_agg(case when not gone then s end, chr(10) order by i) as t from r group by doc_id)
select documents.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from documents left join a on a.doc_id = documents.doc_id
"""
