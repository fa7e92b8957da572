"""Filters, paging, search, set operations, metering and text operators over the record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import metering, pairs, rollup, rules, sets, text
from ..operators.deal import deal
from .tables import count, lines, table


def run_filter(spark, d):
    o = table(spark, d, "orders")
    return o.filter(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") >= 1000)).select("o_orderkey", "o_orderstatus")


def text_search(spark, d):
    p = table(spark, d, "part")
    return p.filter(scalar.contains_text("BrAnd#1", "p_name", "p_brand", "p_type")).select("p_partkey", "p_brand")


def tag_filter(spark, d):
    tags = F.array("p_brand", "p_type")
    first = table(spark, d, "part").select("p_partkey", tags.alias("tags"))
    return first.filter(scalar.has_tags(F.col("tags"), [], ["Brand#11", "Brand#12", "Brand#13", "Brand#21"])).select("p_partkey")


def page_offset(spark, d):
    rows, _, _ = sets.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100, 50)
    return rows


def page_keyset(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    return sets.page_after(rows, ["c_nationkey", "c_custkey"], (3, 10), 40)


def page_newest(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    return sets.page_after(rows, ["c_nationkey", "c_custkey"], (20, 100), 40, newest=True)


def resolve_entities(spark, d):
    e = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    q = table(spark, d, "part").select(F.explode(F.array(F.col("p_partkey").cast("string"), F.upper("p_name"), "p_brand", F.concat(F.lit("no-"), "p_name"))).alias("query")).distinct()
    return sets.resolve(e, q).withColumn("id", F.coalesce("id", F.lit("-")))


def latest_per_key(spark, d):
    return sets.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


def _states(spark, d, before):
    o = table(spark, d, "orders")
    o = o.filter(F.col("o_orderdate") < F.expr("timestamp_ntz '1996-01-01'")) if before else o.filter(F.col("o_orderdate") >= F.expr("timestamp_ntz '1993-01-01'"))
    return o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"), F.count("*").alias("n"))


def snapshot_diff(spark, d):
    return sets.diff(_states(spark, d, True), _states(spark, d, False), ["o_custkey"], ["last", "n"])


def reconcile_inventory(spark, d):
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("digest"), "doc_id")
    before = docs.filter("doc_id % 10 <> 1").select("path", "digest")
    path = F.when(F.col("doc_id") % 10 == 2, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    digest = F.when(F.col("doc_id") % 10 == 3, F.md5(F.concat("digest", F.lit("x")))).otherwise(F.col("digest"))
    after = docs.filter("doc_id % 10 <> 4").select(path.alias("path"), digest.alias("digest"))
    return sets.reconcile(before, after, "path", "digest").withColumn("from_path", F.coalesce("from_path", F.lit("")))


def upsert_merge(spark, d):
    base = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus")
    changes = table(spark, d, "orders").filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_orderkey") % 2 == 0).alias("deleted"))
    return sets.merged(base, changes, ["o_orderkey"], "deleted")


def insert_absent(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return sets.insert_absent(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"])


def conflict_ledger(spark, d):
    return sets.conflicts(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


def unambiguous_inputs(spark, d):
    return sets.unambiguous(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag")


def token_jaccard(spark, d):
    p = table(spark, d, "part").select("p_partkey", scalar.identifier_tokens(F.concat("p_name", F.lit("_Group"), F.floor(F.col("p_partkey") / 7))).alias("t"))
    n = 5 * count(spark, d, "part")  # about five tokens a part
    c = pairs.candidates(p, "p_partkey", "t", 1, rows=n)
    a, b = (deal(p.select(F.col("p_partkey").alias(end), F.col("t").alias(t)), n, end) for end, t in (("left", "a"), ("right", "b")))
    out = deal(c.join(a, "left"), n, "right").join(b, "right")
    return out.select("left", "right", "shared", F.round(scalar.token_jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


def path_rollup(spark, d):
    paths = table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("p"))
    return rollup.nesting(paths, "p")


def step_tree(spark, d):
    rows = lines(spark, d).select("l_orderkey", F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("path"), "l_quantity")
    return rollup.step_tree(rows, "l_orderkey", "path", "l_quantity")


def domain_membership(spark, d):
    places = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("place"))
    facets = places.select(scalar.folder_of(F.col("place")).alias("facet")).filter("facet <> ''").distinct()
    return rules.covered_by(places, "place", facets, "facet").select("page_id", "facet")


def directory_distances(spark, d):
    """Every hundredth page against all others: the stated query set is small and goes to every task."""
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("p"))
    asked = p.filter("page_id % 100 = 0").toDF("a", "pa")
    return p.toDF("b", "pb").join(asked, F.col("a") != F.col("b")).select("a", "b", scalar.directory_distance(F.col("pa"), F.col("pb")).alias("distance"))


def grep_counts(spark, d):
    return text.grep(table(spark, d, "documents"), "doc_id", "text", "the [a-z]+ of", "count")


def read_range(spark, d):
    return text.read_range(table(spark, d, "documents"), "doc_id", "text", 2, 3)


def chunks_fixed(spark, d):
    return text.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", 500).withColumn("content", F.md5("content"))


def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id = 0").first()["embedding"]
    return text.vector_topk(v, "vec_id", "embedding", q, 20).withColumn("score", F.round("score", 6))


def usage_rollup(spark, d):
    rows = table(spark, d, "lineitem").withColumn("charge", F.when(F.col("l_discount") > 0.0, F.col("l_extendedprice")))
    out = metering.usage_by(rows, ["l_orderkey", "l_returnflag"], ["l_quantity"], "charge")
    return out.withColumn("charge", F.round(F.coalesce("charge", F.lit(-1.0)), 2))


def usage_totals(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("tokens"), F.when(F.col("l_returnflag") == "R", "reported").when(F.col("l_returnflag") == "A", "estimated").otherwise("unknown").alias("kind"), "l_extendedprice", F.when(F.col("l_linestatus") == "F", "EUR").alias("cur")
    )
    return metering.usage_totals(rows, "tokens", "kind", "l_extendedprice", "cur").withColumns({c: F.round(c, 2) for c in ("reported", "estimated")})


def tiered_cost(spark, d):
    tiers = F.array(F.struct(F.lit(0.0).alias("min_tokens"), F.lit(20.0).alias("max_tokens"), F.lit(3.0).alias("rate")), F.struct(F.lit(20.0).alias("min_tokens"), F.lit(40.0).alias("max_tokens"), F.lit(2.0).alias("rate")))
    rate = metering.tier_rate(tiers, F.col("l_quantity"), F.lit(1.0))
    cost = metering.token_cost(F.col("l_quantity"), F.col("l_linenumber"), F.lit(None).cast("double"), F.col("l_tax") * 100, F.lit(None).cast("double"), {"input": rate, "cached": F.lit(0.5), "written": F.lit(4.0), "output": rate * 5})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(cost, 12).alias("cost"))


def tier_brackets(spark, d):
    t = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("price"))
    return metering.tier_brackets(t, "p_brand", "p_size", "price").withColumn("max_tokens", F.coalesce("max_tokens", F.lit(-1)))


def headroom(spark, d):
    kind = F.expr("case c_mktsegment when 'AUTOMOBILE' then 'window' when 'BUILDING' then 'spend-cap' when 'FURNITURE' then 'balance' when 'MACHINERY' then 'credit-balance' else 'other' end")
    bal = F.col("c_acctbal")
    rows = table(spark, d, "customer").select("c_custkey", kind.alias("kind"), (bal / 64).alias("used_percent"), F.when(F.col("c_nationkey") != 3, 5000.0).otherwise(0.0).alias("cap"), bal.alias("used"), bal.alias("remaining"), F.expr("case when c_custkey % 3 > 0 then timestamp_ntz '2000-01-01' end").alias("resets_at"))
    out = metering.headroom(rows, F.expr("timestamp_ntz '1999-12-31'"))
    return out.select("c_custkey", F.round(F.coalesce("headroom", F.lit(-1.0)), 6).alias("headroom"), F.round(F.coalesce("share", F.lit(-1.0)), 9).alias("share"), F.coalesce("unit", F.lit("-")).alias("unit"), "exhausted", F.coalesce("resets_in_ms", F.lit(-1)).alias("resets_in_ms"))


def price_lookup(spark, d):
    prices = table(spark, d, "part").groupBy(F.col("p_brand").alias("vendor"), F.col("p_size").cast("string").alias("id")).agg(F.max("p_retailprice").alias("price")).filter("price > 1500")
    items = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("vendor"), F.col("p_size").cast("string").alias("id"))
    return metering.price_lookup(items, prices).select("p_partkey", F.coalesce("price", F.lit(-1.0)).alias("price"), "price_from")


def inside_runs(spark, d):
    runs = table(spark, d, "orders").filter("o_orderkey % 4 <> 0").select("o_orderkey", F.col("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 30 days")).alias("ended"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    return metering.inside_runs(rows, runs, "o_orderkey", "l_shipdate").select("o_orderkey", "l_linenumber", "inside")


def scalar_pack(spark, d):
    n = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        scalar.cadence((n % 5000 * 1000).cast("long")).alias("cadence"),
        F.coalesce(scalar.duration_ms(F.concat(n.cast("string"), F.get(F.array(*map(F.lit, ["ms", "s", "m", "h", "d", "w", "x"])), (n % 7).cast("int")))), F.lit(-1)).alias("duration"),
        scalar.retry_delay_ms((n % 12 + 1).cast("long")).alias("delay"),
        scalar.token_estimate(F.col("o_orderpriority")).alias("tokens"),
        scalar.days_between(F.expr("timestamp_ntz '2000-01-01'"), F.col("o_orderdate")).alias("age"),
    )


WORDS = "list_filter(string_split(trim(regexp_replace(lower(regexp_replace(regexp_replace(p_name || '_Group' || (p_partkey // 7), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
PAGES = "select page_id, regexp_replace(url, '^[a-z]+://', '') as p from pages"

QUERIES = {
    "run_filter": (run_filter, "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('O', 'P') and o_orderpriority = '1-URGENT' and o_totalprice >= 1000"),
    "text_search": (text_search, "select p_partkey, p_brand from part where contains(lower(p_name), 'brand#1') or contains(lower(p_brand), 'brand#1') or contains(lower(p_type), 'brand#1')"),
    "tag_filter": (tag_filter, "select p_partkey from part where list_has_any([p_brand, p_type], ['Brand#11', 'Brand#12', 'Brand#13', 'Brand#21'])"),
    "page_offset": (page_offset, "select o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey limit 50 offset 100"),
    "page_keyset": (page_keyset, "select c_nationkey, c_custkey from customer where (c_nationkey, c_custkey) > (3, 10) order by 1, 2 limit 40"),
    "page_newest": (page_newest, "select c_nationkey, c_custkey from customer where (c_nationkey, c_custkey) < (20, 100) order by 1 desc, 2 desc limit 40"),
    "resolve_entities": (resolve_entities, "with q as (select distinct unnest([p_partkey::varchar, upper(p_name), p_brand, 'no-' || p_name]) as query from part), n as (select lower(p_name) as l, p_partkey::varchar as id from part union select lower(p_brand), p_partkey::varchar from part), c as (select l, count(*) as c, min(id) as i from n group by l) select query, case when e.p_partkey is not null or c.c = 1 then 'resolved' when c.c > 1 then 'ambiguous' else 'not-found' end as state, case when e.p_partkey is not null then query when c.c = 1 then c.i else '-' end as id from q left join part e on e.p_partkey::varchar = query left join c on c.l = lower(query)"),
    "latest_per_key": (latest_per_key, "select user_id, event_type, ts, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1"),
    "snapshot_diff": (snapshot_diff, "with a as (select o_custkey, max(o_orderkey) as l, count(*) as n from orders where o_orderdate < timestamp '1996-01-01' group by 1), b as (select o_custkey, max(o_orderkey) as l, count(*) as n from orders where o_orderdate >= timestamp '1993-01-01' group by 1) select coalesce(a.o_custkey, b.o_custkey) as o_custkey, case when a.o_custkey is null then 'added' when b.o_custkey is null then 'removed' else 'changed' end as change from a full join b on a.o_custkey = b.o_custkey where a.o_custkey is null or b.o_custkey is null or (a.l, a.n) <> (b.l, b.n)"),
    "reconcile_inventory": (reconcile_inventory, "with s as (select source || '/' || doc_id as path, md5(text) as digest, doc_id from documents), a as (select path, digest from s where doc_id % 10 <> 1), b as (select case when doc_id % 10 = 2 then 'moved/' || path else path end as path, case when doc_id % 10 = 3 then md5(digest || 'x') else digest end as digest from s where doc_id % 10 <> 4), g as (select * from a where path not in (select path from b)), f as (select * from b where path not in (select path from a)), m as (select x.path as from_path, y.path from (select digest, min(path) as path from g group by 1 having count(*) = 1) x join (select digest, min(path) as path from f group by 1 having count(*) = 1) y on x.digest = y.digest) select path, 'move' as change, from_path from m union all select a.path, 'update', '' from a join b on a.path = b.path and a.digest <> b.digest union all select path, 'delete', '' from g where path not in (select from_path from m) union all select path, 'insert', '' from f where path not in (select path from m)"),
    "upsert_merge": (upsert_merge, "select o_orderkey, o_orderstatus from orders where o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 union all select o_orderkey, 'X' from orders where o_orderkey % 5 = 0 and o_orderkey % 2 <> 0"),
    "insert_absent": (insert_absent, "select o_orderkey, o_orderstatus from orders where o_orderkey % 3 <> 0 union all select o_orderkey, 'N' from orders where o_orderkey % 2 = 0 and o_orderkey % 3 = 0"),
    "conflict_ledger": (conflict_ledger, "select l_orderkey, count(distinct l_suppkey) as \"values\", count(*) as \"rows\" from lineitem group by 1 having count(distinct l_suppkey) > 1"),
    "unambiguous_inputs": (unambiguous_inputs, "select l_orderkey, min(l_returnflag) as l_returnflag from lineitem group by 1 having min(l_returnflag) = max(l_returnflag)"),
    "token_jaccard": (token_jaccard, f"with p as (select p_partkey, {WORDS} as t from part), e as (select distinct p_partkey, unnest(t) as k from p), s as (select * from e where k in (select k from e group by k having count(*) <= 40)), c as (select a.p_partkey as \"left\", b.p_partkey as \"right\", count(*) as shared from s a join s b on a.k = b.k and a.p_partkey < b.p_partkey group by 1, 2) select \"left\", \"right\", shared, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 9) as jaccard from c join p x on x.p_partkey = \"left\" join p y on y.p_partkey = \"right\""),
    "path_rollup": (path_rollup, f"with s as (select string_split(p, '/') as x from ({PAGES})), i as (select x, unnest(range(1, len(x))) as n from s) select array_to_string(x[1:n], '/') as folder, count(*) filter (n = len(x) - 1) as direct, count(*) as descendants from i group by 1"),
    "step_tree": (step_tree, "with s as (select l_orderkey, [l_returnflag, l_linestatus, l_linenumber::varchar] as x, l_quantity as q, unnest([1, 2, 3]) as n from lineitem) select l_orderkey, array_to_string(x[1:n], '/') as step, sum(case when n = 3 then q else 0 end) as direct, sum(q) as inclusive from s group by 1, 2"),
    "domain_membership": (domain_membership, f"with p as ({PAGES}), f as (select distinct regexp_replace(p, '/?[^/]*$', '') as facet from p) select page_id, facet from p join f on facet <> '' and (p = facet or starts_with(p, facet || '/'))"),
    "directory_distances": (directory_distances, f"with p as (select page_id, list_filter(string_split(p, '/'), lambda x: x <> '') as x from ({PAGES})), j as (select a.page_id as a, b.page_id as b, a.x as p, b.x as q from p a join p b on a.page_id <> b.page_id where a.page_id % 100 = 0) select a, b, len(p) + len(q) - 2 * len(list_filter(range(1, least(len(p), len(q)) + 1), lambda i: p[1:i] = q[1:i])) as distance from j"),
    "grep_counts": (grep_counts, "with l as (select doc_id, unnest(string_split(text, chr(10))) as c from documents) select doc_id, count(*) as matches from l where regexp_matches(c, 'the [a-z]+ of') group by 1"),
    "read_range": (read_range, "with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line, string_split(text, chr(10)) as x from documents) select doc_id, line, x[line] as content from l where line between 2 and 4"),
    "chunks_fixed": (chunks_fixed, "with c as (select doc_id, text, unnest(range(0, (length(text) + 499) // 500)) as chunk from documents where length(text) > 0), s as (select doc_id, text, chunk, chunk * 500 as start, substring(text, chunk * 500 + 1, 500) as content from c) select doc_id, chunk, start, start + length(content) as \"end\", start - length(replace(substring(text, 1, start), chr(10), '')) + 1 as first_line, start - length(replace(substring(text, 1, start), chr(10), '')) + 1 + length(content) - length(replace(content, chr(10), '')) as last_line, md5(content) as content from s"),
    "vector_topk": (vector_topk, "select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score from embeddings order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) desc, vec_id limit 20"),
    "usage_rollup": (usage_rollup, "select l_orderkey, l_returnflag, count(*) as items, sum(l_quantity) as l_quantity, round(case when count(*) filter (l_discount > 0) = count(*) then sum(l_extendedprice) else -1 end, 2) as charge from lineitem group by 1, 2"),
    "usage_totals": (usage_totals, "select case when l_linestatus = 'F' then 'EUR' else 'none' end as currency, count(*) as turns, sum(l_quantity) filter (l_linenumber <> 3) as tokens, count(*) filter (l_linenumber = 3) as untokened, count(*) filter (l_returnflag not in ('R', 'A')) as unpriced, round(coalesce(sum(l_extendedprice) filter (l_returnflag = 'R'), 0), 2) as reported, round(coalesce(sum(l_extendedprice) filter (l_returnflag = 'A'), 0), 2) as estimated from lineitem group by 1"),
    "tiered_cost": (tiered_cost, "with r as (select *, case when l_quantity < 20 then 3.0 when l_quantity < 40 then 2.0 else 1.0 end::double as r from lineitem) select l_orderkey, l_linenumber, round((greatest(l_quantity - l_linenumber, 0) * r + l_linenumber * 0.5::double + l_tax * 100 * r * 5) / 1000000, 12) as cost from r"),
    "tier_brackets": (tier_brackets, "with t as (select p_brand, p_size, max(p_retailprice) as price from part group by 1, 2) select p_brand, p_size as min_tokens, coalesce(lead(p_size) over (partition by p_brand order by p_size), -1) as max_tokens, price as rate from t"),
    "headroom": (headroom, "with r as (select *, case c_mktsegment when 'AUTOMOBILE' then 100 - least(100, greatest(0, c_acctbal / 64)) when 'BUILDING' then greatest(0, case when c_nationkey <> 3 then 5000 else 0 end - c_acctbal) when 'FURNITURE' then greatest(0, c_acctbal) when 'MACHINERY' then greatest(0, c_acctbal) end as h from customer) select c_custkey, round(coalesce(h, -1), 6) as headroom, round(case c_mktsegment when 'AUTOMOBILE' then h / 100 when 'BUILDING' then case when c_nationkey <> 3 then h / 5000 else 0 end else -1 end, 9) as share, case c_mktsegment when 'AUTOMOBILE' then 'percent' when 'BUILDING' then 'usd' when 'FURNITURE' then 'usd' when 'MACHINERY' then 'credits' else '-' end as unit, coalesce(h <= 0, false) as exhausted, (case when c_custkey % 3 > 0 then 86400000 else -1 end)::bigint as resets_in_ms from r"),
    "price_lookup": (price_lookup, "with p as (select p_brand as v, p_size as s, max(p_retailprice) as price from part group by 1, 2 having max(p_retailprice) > 1500), b as (select s, min(price) as price from p group by 1 having count(*) = 1) select p_partkey, coalesce(p.price, b.price, -1) as price, case when p.price is not null then 'vendor' when b.price is not null then 'unique-id' else 'none' end as price_from from part left join p on v = p_brand and p.s = p_size left join b on b.s = p_size"),
    "inside_runs": (inside_runs, "select l_orderkey as o_orderkey, l_linenumber, case when o_orderkey is null then true else o_orderdate <= l_shipdate and (o_orderstatus <> 'F' or l_shipdate <= o_orderdate + interval 30 days) end as inside from lineitem left join orders on o_orderkey = l_orderkey and o_orderkey % 4 <> 0"),
    "scalar_pack": (scalar_pack, "with o as (select *, o_orderkey % 5000 * 1000 as ms from orders) select o_orderkey, case when ms > 0 and ms % 86400000 = 0 then (ms // 86400000) || 'd' when ms > 0 and ms % 3600000 = 0 then (ms // 3600000) || 'h' when ms > 0 and ms % 60000 = 0 then (ms // 60000) || 'm' when ms > 0 and ms % 1000 = 0 then (ms // 1000) || 's' else ms || 'ms' end as cadence, case when o_orderkey % 7 = 6 then -1 else o_orderkey * [1, 1000, 60000, 3600000, 86400000, 604800000, 0][o_orderkey % 7 + 1] end as duration, least(2 ** (o_orderkey % 12) * 1000, 300000)::bigint as delay, ceil(length(o_orderpriority) / 4)::bigint + 4 as tokens, floor((epoch_us(timestamp '2000-01-01') - epoch_us(o_orderdate)) / 86400000000)::bigint as age from o"),
}
