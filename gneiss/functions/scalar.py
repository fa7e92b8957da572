"""Scalar functions over text, paths, durations, maps and tokens as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import ratio

_UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def identifier_tokens(name: Column) -> Column:
    """Lower-case words of a camelCase, snake_case or ACRONYMWord identifier."""
    x = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    x = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")
    x = F.regexp_replace(x, "[^A-Za-z0-9]+", " ")
    return F.array_remove(F.split(F.lower(x), " "), "")


def token_jaccard(a: Column, b: Column, stop: list[str] = ()) -> Column:
    """Shared over united tokens of two arrays without the stop words, 0 for none."""
    ignored = F.array(*[F.lit(s) for s in stop]).cast("array<string>")
    a, b = F.array_except(a, ignored), F.array_except(b, ignored)
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def contains_text(needle: str, *columns: str) -> Column:
    """True where any column holds needle as a substring in any case; no wildcards."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle.lower())), F.lit(False))
    return found


def has_tags(tags: Column, every: list[str] = (), some: list[str] = ()) -> Column:
    """All of `every`, and any of `some` unless it is empty."""
    out = F.lit(True)
    if every:
        out &= F.size(F.array_except(F.array(*map(F.lit, every)), tags)) == 0
    if some:
        out &= F.arrays_overlap(tags, F.array(*map(F.lit, some)))
    return out


def covers(facet: Column, place: Column) -> Column:
    """A facet covers itself and what lies under it by whole path segments; path#symbol only itself."""
    return (place == facet) | (~F.contains(facet, F.lit("#")) & F.startswith(place, F.concat(facet, F.lit("/"))))


def folder_of(path: Column) -> Column:
    """Path without its last segment, "" at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest last; none at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    )


def directory_distance(a: Column, b: Column) -> Column:
    """Segments up from a and down to b through their nearest common folder."""

    def parts(x: Column) -> Column:
        return F.array_remove(F.split(x, "/"), "")

    pa, pb = parts(a), parts(b)
    same = F.zip_with(pa, pb, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    shared = F.when(first == 0, F.size(same)).otherwise(first - 1)
    return (F.size(pa) + F.size(pb) - 2 * shared).cast("int")


def duration_ms(text: Column) -> Column:
    """Milliseconds of "250ms", "30s", "5m", "6h", "1d" or "2w"; null for anything else."""
    size = F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d|w)$", 1)
    unit = F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d|w)$", 2)
    factor = F.lit(None).cast("long")
    for u, ms in _UNITS.items():
        factor = F.when(unit == u, F.lit(ms)).otherwise(factor)
    return F.when(size != "", size.try_cast("long") * factor)


def cadence(ms: Column) -> Column:
    """The largest unit of d, h, m, s or ms that divides a duration."""
    out = F.concat(ms.cast("string"), F.lit("ms"))
    for u in ("s", "m", "h", "d"):
        out = F.when((ms > 0) & (ms % _UNITS[u] == 0), F.concat((ms / _UNITS[u]).cast("long").cast("string"), F.lit(u))).otherwise(out)
    return out


def days_between(now: Column, then: Column) -> Column:
    """Whole days from then to now, rounded down."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 86_400_000_000).cast("long")


def token_estimate(text: Column) -> Column:
    """Tokens a message takes: a quarter of its characters rounded up, and four for its frame."""
    return (F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 4) + 4).cast("long")


def context_budget(window: Column, reserved: Column) -> Column:
    """Tokens left of a window after the reserve and a margin of 8 % rounded up."""
    return (window - reserved - F.ceil(window * 0.08)).cast("long")


def retry_delay_ms(failures: Column) -> Column:
    """One second doubled with each failure after the first, five minutes at most."""
    return F.least(F.pow(F.lit(2.0), F.least(failures, F.lit(30)) - 1) * 1000, F.lit(300_000.0)).cast("long")


def patched(base: Column, patch: Column) -> Column:
    """Map base overlaid by map patch; keys that patch sets to null go."""
    keep = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(keep, F.map_filter(patch, lambda _, v: v.isNotNull()))


def package_of(specifier: Column) -> Column:
    """Package of an import specifier: two segments if scoped; null for relative, absolute, # and scheme forms."""
    outside = specifier.rlike(r"^(\.|/|#)|^[A-Za-z][A-Za-z0-9+.-]*:")
    parts = F.split(specifier, "/")
    scoped = F.startswith(specifier, F.lit("@"))
    return F.when(outside | (specifier == ""), None).when(scoped & (F.size(parts) > 1), F.array_join(F.slice(parts, 1, 2), "/")).when(scoped, None).otherwise(parts[0])


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with keys in order and nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def model_id(name: Column) -> Column:
    """Model name in lower case, dots and underscores as dashes, runs of dashes as one, none at the ends."""
    x = F.regexp_replace(F.lower(name), "[._]", "-")
    return F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-|-$", "")


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its binary value; what lies exactly between two goes up."""
    between = (x * 2 ** (digits + 1)) % 2 == 1
    return F.replace(F.format_number(F.when(between, x + 10.0 ** -(digits + 2)).otherwise(x), digits), F.lit(","))


def money(amount: Column, currency: Column | None = None) -> Column:
    """Amount with two decimals, with four below one, "<" where those are all zero; null for none.

    Dollars, or no currency given, have their sign before, others their name after.
    """
    x = amount.cast("double")
    shown = F.when(x < 1, fixed(x, 4)).otherwise(fixed(x, 2))
    tiny = (x > 0) & (shown == "0.0000")
    bound, shown = F.when(tiny, "<").otherwise(""), F.when(tiny, "0.0001").otherwise(shown)
    dollars = F.concat(bound, F.lit("$"), shown)
    return dollars if currency is None else F.when(currency == "USD", dollars).otherwise(F.concat(bound, shown, F.lit(" "), currency))


def short_count(n: Column) -> Column:
    """1234 as 1.2k, 1234567 as 1.2M; smaller numbers as they are."""
    x = n.cast("double")
    return F.when(x >= 1_000_000, F.concat(fixed(x / 1_000_000, 1), F.lit("M"))).when(x >= 1000, F.concat(fixed(x / 1000, 1), F.lit("k"))).otherwise(n.cast("string"))


def _glob_parts(glob: str) -> tuple[list[str], int]:
    """Alternatives of the brace group that opens glob and the place after its close; no close gives (-1)."""
    depth, parts, at = 0, [""], 0
    while at < len(glob):
        c = glob[at]
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return parts, at + 1
        if c == "," and depth == 1:
            parts.append("")
        elif at:
            parts[-1] += c
        at += 1
    return parts, -1


def _glob_body(glob: str) -> str:
    out = ""
    while glob:
        if glob.startswith("**/"):
            out, glob = out + "(?:[^/]+/)*", glob[3:]
        elif glob.startswith("**"):
            out, glob = out + "[^\\n\\r\\u2028\\u2029]*", glob[2:]
        elif glob[0] in "*?":
            out, glob = out + ("[^/]*" if glob[0] == "*" else "[^/]"), glob[1:]
        elif glob[0] == "{" and (group := _glob_parts(glob))[1] > 0:
            inner = [_glob_body(x) for x in group[0]]
            out += f"(?:{'|'.join(inner)})" if len(inner) > 1 else rf"\{{{inner[0]}\}}"
            glob = glob[group[1] :]
        else:
            out, glob = out + re.escape(glob[0]), glob[1:]
    return out


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob: **/ crosses folders, ** all but line ends, * and ? stay in one.

    {a,b} are alternatives, nested ones too; a brace without a comma or a partner is a character.
    """
    return f"^{_glob_body(glob)}(?![\\s\\S])"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_pattern(glob))


def first_matching(value: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Label of the first rule (label, regular expression) that the value matches."""
    out = F.lit(otherwise)
    for label, pattern in reversed(rules):
        out = F.when(value.rlike(pattern), label).otherwise(out)
    return out


def file_kind(path: Column) -> Column:
    """config, test, story, source or other: the first that fits.

    Configuration is known by its file name alone, tests and stories by a folder above or an inner
    suffix, and source by the extension.
    """
    name = F.element_at(F.split(path, "/"), -1)
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    script = name.rlike(r"\.[cm]?[jt]sx?$")
    inner = F.regexp_extract(name, r"\.([^.]+)\.[^.]+$", 1)
    # fixed values
    named = name.isin("package.json", "turbo.json", "knip.json", "bunfig.toml") | name.rlike(r"^tsconfig.*\.json$")
    config = named | (script & (inner == "config")) | name.rlike(r"^\..+")
    test = F.arrays_overlap(folders, F.array(*map(F.lit, ("test", "tests", "__tests__", "__mocks__", "e2e")))) | (script & inner.isin("test", "spec"))
    story = F.array_contains(folders, "stories") | (script & (inner == "stories"))
    return F.when(config, "config").when(test, "test").when(story, "story").when(script, "source").otherwise("other")


def extension(path: Column) -> Column:
    """Lower-case extension; null for dotfiles, trailing dots and names without one."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.lower(F.regexp_extract(name, r"^.+\.([A-Za-z0-9]+)$", 1)), F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision, 0 if either is zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Names of log levels, from the least.
LEVELS = ("debug", "info", "warn", "error")


def at_least_level(level: Column, least: str, levels: tuple[str, ...] = LEVELS) -> Column:
    """True where a named level is `least` or above; unknown levels are below all."""
    rank = F.array_position(F.array(*map(F.lit, levels)), level)
    return rank >= levels.index(least) + 1


def log_matches(level: str, source: str = "all", query: str = "", run: str | None = None) -> Column:
    """Log entries (level, source, message, run_name, run_id, step_id) of a level or above, a source, a run, holding a text.

    The text is looked for in message, run name, run id and step id, joined by a space each, without regard to case; it is trimmed, and
    nothing is looked for where it is empty then.
    """
    out = at_least_level(F.col("level"), level)
    if run is not None:
        out &= F.coalesce(F.col("run_id") == run, F.lit(False))
    if source != "all":
        out &= F.col("source") == source
    if query.strip():
        joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("message", "run_name", "run_id", "step_id")])
        out &= F.contains(F.lower(joined), F.lit(query.strip().lower()))
    return out


def search_keys(keys: Column, needle: str, mode: str) -> Column:
    """True if any of an array of names matches in any case: "exact", "prefix" or "contains"."""
    n = F.lit(needle.lower())
    tests = {"exact": lambda k: F.lower(k) == n, "prefix": lambda k: F.startswith(F.lower(k), n), "contains": lambda k: F.contains(F.lower(k), n)}
    if mode not in tests:
        raise ValueError(f"unknown mode {mode}")
    return F.exists(keys, tests[mode])


def has_pairs(tags: Column, wanted: dict[str, str]) -> Column:
    """True if a map holds every wanted pair."""
    out = F.lit(True)
    for k, v in wanted.items():
        out &= F.coalesce(F.try_element_at(tags, F.lit(k)) == v, F.lit(False))
    return out


def set_parts(left: Column, right: Column) -> Column:
    """Struct of what two arrays share and what only one has, each sorted."""
    parts = {"shared": F.array_intersect(left, right), "left_only": F.array_except(left, right), "right_only": F.array_except(right, left)}
    return F.struct(*[F.array_sort(c).alias(n) for n, c in parts.items()])


def wave_ms(text: Column, grammar: str) -> Column:
    """Milliseconds of a duration such as 30m in one of three grammars; null where it does not fit.

    "cadence" is a positive whole number of s, m, h, d; "span" a number, fractions too, of m, h, d, w;
    "delay" a number of ms, s, m, h.
    """
    # fixed values
    units = {
        "cadence": (r"^(\d+)([smhd])$", {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}),
        "span": (r"^(\d+(?:\.\d+)?)([mhdw])$", {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}),
        "delay": (r"^(\d+(?:\.\d+)?)(ms|s|m|h)$", {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}),
    }
    pattern, sizes = units[grammar]
    text = F.trim(text) if grammar != "span" else text
    size = F.lit(None).cast("long")
    for unit, ms in sizes.items():
        size = F.when(F.regexp_extract(text, pattern, 2) == unit, ms).otherwise(size)
    out = F.regexp_extract(text, pattern, 1).try_cast("double") * size
    return F.when(out > 0, out) if grammar == "cadence" else out


def range_start(text: Column, to: Column) -> Column:
    """Time that lies <n>y, <n>m or <n>d before `to` in the calendar (UTC); null for "all" and what does not fit."""
    n = F.regexp_extract(text, r"^(\d+)([ymd])$", 1).try_cast("int")
    unit = F.regexp_extract(text, r"^(\d+)([ymd])$", 2)
    back = lambda y, m, d: to - F.make_interval(years=y, months=m, days=d)
    zero = F.lit(0)
    return F.when(unit == "y", back(n, zero, zero)).when(unit == "m", back(zero, n, zero)).when(unit == "d", back(zero, zero, n))


def next_slot(last: Column, hour: int, minute: int = 0, weekdays: list[str] | None = None) -> Column:
    """First time after `last` at hour:minute of one of the weekdays (three letters; none: every day)."""
    day = F.date_trunc("day", last)
    at = day + F.make_interval(hours=F.lit(hour), mins=F.lit(minute))
    if not weekdays:
        return F.when(at > last, at).otherwise(at + F.expr("interval 1 day"))
    ahead = [F.make_interval(days=F.lit(k)) for k in range(8)]
    named = F.array(*[F.when(F.date_format(day + k, "EEE").isin(*[w.capitalize()[:3] for w in weekdays]) & (at + k > last), at + k) for k in ahead])
    return F.array_min(F.array_compact(named))


def backoff_ms(kind: str, attempt: Column, initial: int, step: int = 0, factor: float = 2.0, share: Column | None = None) -> Column:
    """Delay before the next attempt, attempts counted from 1.

    "fixed" is initial, "linear" adds a step each time, "exponential" multiplies by factor each time,
    "jittered" is exponential with a share (0 to 1) between 80 % and 120 % of it.
    """
    grown = F.lit(float(initial)) * F.pow(F.lit(factor), attempt - 1)
    if kind == "jittered":
        grown = grown * (0.8 + 0.4 * (F.lit(0.5) if share is None else share))
    plain = {"fixed": F.lit(float(initial)) + attempt * 0, "linear": F.lit(float(initial)) + step * (attempt - 1), "exponential": grown, "jittered": grown}
    return F.round(plain[kind]).cast("long")


def valid_json(text: Column) -> Column:
    """True where a text is JSON whose numbers are finite and none of them is -0."""
    bare = F.regexp_replace(text, r'"(?:[^"\\\\]|\\\\.)*"', '""')
    zero = bare.rlike(r"-0(\.0+)?([eE][+-]?\d+)?(?![.\d])")
    return F.coalesce(F.try_parse_json(text).isNotNull() & ~zero & ~bare.rlike(r"(?i)nan|infinity|\d[eE]\+?\d{4,}"), F.lit(False))


def short_hash(text: Column, digits: int = 12) -> Column:
    """First hexadecimal digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, digits)


def message_tokens(texts: Column, images: Column) -> Column:
    """Tokens of a message of text parts (an array) and a number of images: four, a quarter of each part's characters rounded up, 768 for each image."""
    parts = F.aggregate(texts, F.lit(0).cast("long"), lambda s, t: s + F.ceil(F.char_length(t) / 4))
    return (parts + 4 + F.coalesce(images, F.lit(0)) * 768).cast("long")


def effective_limit(window: Column, reserved: Column, hard: Column | None = None, ratio_: float = 0.8) -> Column:
    """Tokens to keep below: the high-water share of the headroom rounded down, or a smaller hard limit."""
    headroom = F.greatest(F.lit(0), window - reserved - F.ceil(window * 0.08))
    high = F.floor(headroom * ratio_).cast("long")
    return high if hard is None else F.least(high, hard)  # least() ignores nulls


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def frontmatter(text: Column) -> Column:
    """Map of the `key: value` lines between two lines of --- at the start of a text; empty without them."""
    head = F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    keyed = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z][\w-]*:"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("key"), F.trim(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1)).alias("value"))
    return F.map_from_entries(F.transform(keyed, pair))


def placeholders(text: Column) -> Column:
    """Distinct names in {{name}} places of a prompt, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{\s*([A-Za-z_][\w.]*)\s*\}\}"), 1))


def run_bucket(status: Column, attention: Column) -> Column:
    """queued, running, waiting, complete, failed or cancelled; runs that ask for attention or are parked wait, others have none."""
    return F.when(attention | status.isin("suspended", "paused"), "waiting").when(status.isin("queued", "running", "complete", "failed", "cancelled"), status)
