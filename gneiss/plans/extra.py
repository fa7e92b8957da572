"""Lookups, formats, durations, log bookkeeping and dataset sinks over the tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import backlog, catalog, graph, history, log, metering, pairs, rollup, rules, sets, structure
from ..sources import readers, writers
from .repository import EDGE, module_graph
from .tables import count, lines, table


def _scratch(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp()
    return f"{base.rstrip('/')}/gneiss/{uuid.uuid4().hex}"


def _part(spark, d):
    return table(spark, d, "part")


def shards(spark, d):
    path = _scratch(spark)
    writers.write_shards(_part(spark, d).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("package"), "p_size"), path)
    return readers.package_shards(spark, path, ["Brand#11", "Brand#12"]).select("id", "package", "p_size")


def exported(spark, d):
    path = _scratch(spark)
    writers.export_json(_part(spark, d).select("p_partkey", "p_name"), path)
    return spark.read.schema("p_partkey long, p_name string").json(path)


def specifiers(spark, d):
    s = F.expr("case p_size % 7 when 0 then './' || p_name when 1 then '@' || p_brand || '/' || p_partkey || '/sub' when 2 then 'node:' || p_partkey when 3 then '#' || p_name when 4 then '/' || p_name when 5 then 'lib' || p_partkey else 'lib' || p_partkey || '/x/y' end")
    return _part(spark, d).select("p_partkey", F.coalesce(scalar.package_of(s), F.lit("-")).alias("package"))


def static_relations(spark, d):
    _, edges = module_graph(spark, d)
    some = lines(spark, d).filter("l_quantity >= 49").select("l_orderkey", "l_partkey").distinct()
    a, b = some.withColumnRenamed("l_partkey", "left"), some.withColumnRenamed("l_partkey", "right")
    near = edges.select(F.least("src", "dst").alias("left"), F.greatest("src", "dst").alias("right"))
    rows = a.join(b, "l_orderkey").filter("left < right").select("left", "right").union(near).distinct()
    return pairs.static_relation(rows, edges, graph.closure(edges))


def usage_by_agent(spark, d):
    used = lines(spark, d).filter("l_quantity >= 48").groupBy((F.col("l_suppkey") % 500).alias("agent")).agg(F.count("*").alias("turns"), F.sum("l_linenumber").alias("tokens"))
    known = table(spark, d, "supplier").select((F.col("s_suppkey") % 500 + 1).alias("agent"))
    return metering.with_known_ids(used, known, "agent", ["turns", "tokens"])


def shared_affinity(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("w"))
    return pairs.shared_affinity(g, "l_orderkey", "l_suppkey", "w").withColumn("affinity", F.round("affinity", 6))


def lock_lookup(spark, d):
    asked = _part(spark, d).select(F.concat_ws("/", F.concat(F.lit("a"), F.expr("p_partkey % 3")), F.concat(F.lit("b"), F.expr("p_partkey % 5")), F.lit("c")).alias("locator"), F.col("p_brand").alias("name")).distinct()
    lock = _part(spark, d).select(F.expr("case p_size % 3 when 0 then '' when 1 then 'a' || (p_size % 2) else 'a' || (p_size % 3) || '/b' || (p_size % 5) end").alias("at"), F.col("p_brand").alias("name"))
    lock = lock.distinct().withColumn("version", F.concat_ws("@", "name", "at"))
    return structure.lock_lookup(asked, lock).withColumn("version", F.coalesce("version", F.lit("-")))


def relabelled(spark, d):
    rows = _part(spark, d).select("p_partkey", F.array(F.expr("p_partkey % 3"), F.expr("p_size % 3")).alias("home"), F.when(F.col("p_size") % 5 > 0, F.array(F.expr("p_size % 3"), F.expr("p_partkey % 2"))).otherwise(F.array().cast("array<bigint>")).alias("away"))
    return rules.relabelled(rows.withColumn("home", F.col("home").cast("array<bigint>")).withColumn("away", F.col("away").cast("array<bigint>")), "home", "away").select("p_partkey", "label")


def valid_budgets(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "window").otherwise("spend-cap")
    starts = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate"))
    resets = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate") + F.expr("interval 200 days"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", kind.alias("kind"), (F.col("o_totalprice") - 50000).alias("cap"), (F.col("o_totalprice") / 2 - 40000).alias("used"), starts.alias("starts_at"), resets.alias("resets_at"))
    out = metering.valid_budgets(o, "o_custkey", "o_orderkey", F.expr("timestamp_ntz'1997-01-01 00:00:00'"))
    return out.select("o_custkey", *[F.round(c, 6).alias(c) for c in ("cap", "spent", "remaining", "share")])


def patched_tags(spark, d):
    m = _part(spark, d).select("p_partkey", F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_type")).alias("m"), F.create_map(F.lit("b"), F.when(F.col("p_size") > 25, F.lit("new")), F.lit("c"), F.col("p_name")).alias("p"))
    x = m.select("p_partkey", scalar.patched(F.col("m"), F.col("p")).alias("x"))
    return x.select("p_partkey", *[F.coalesce(F.try_element_at("x", F.lit(k)), F.lit("-")).alias(k) for k in "abc"])


def missed_ranges(spark, d):
    """Moves of consumers from one order of a customer to the next, over a log compacted up to the middle of its orders."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    moves = o.select(F.concat_ws("/", "o_custkey", "o_orderkey").alias("name"), F.coalesce(before, F.lit(0)).alias("from"), F.col("o_orderkey").alias("to"), (F.col("o_totalprice") > 100000).alias("handed"))
    return log.missed_ranges(moves, 3000)


def fresh_changes(spark, d):
    current = _part(spark, d).select(F.col("p_partkey").alias("id"), F.col("p_size").alias("revision"))
    changes = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_quantity").cast("int")).alias("expected"), "l_orderkey", "l_linenumber")
    return backlog.fresh_changes(current, changes).select("id", "l_orderkey", "l_linenumber")


def hashes(spark, d):
    return _part(spark, d).select("p_partkey", scalar.short_hash(F.col("p_name")).alias("short"), F.sha1("p_name").alias("sha1"), scalar.canonical_hash("p_size", "p_partkey").alias("canonical"))


def compacted(spark, d):
    return _part(spark, d).select("p_partkey", F.to_json(F.struct(F.when(F.col("p_size") > 9, F.col("p_size")).alias("a"), F.when(F.col("p_size") < 30, F.col("p_partkey")).alias("b"))).alias("json"))


def distances(spark, d):
    return _part(spark, d).select("p_partkey", F.round(scalar.distance(F.col("p_size"), F.lit(3.0), F.lit(7), F.expr("p_partkey % 11")), 9).alias("distance"))


def durations(spark, d):
    n = F.expr("cast(p_size as string)")
    unit = lambda us: F.concat(n, F.element_at(F.array(*map(F.lit, us)), (F.col("p_partkey") % len(us) + 1).cast("int")))
    one = lambda us, g: F.coalesce(scalar.wave_ms(unit(us), g), F.lit(-1)).cast("long")
    to = F.expr("cast(timestamp_ntz'2024-03-31 12:00:00' as timestamp)")
    start = F.date_format(scalar.range_start(unit(["y", "m", "d", "x"]), to), "yyyy-MM-dd")
    return _part(spark, d).select("p_partkey", one("smhdx", "cadence").alias("cadence"), one(["m", "h", "d", "w", "s"], "span").alias("span"), one(["ms", "s", "m", "h", "d"], "delay").alias("delay"), F.coalesce(start, F.lit("-")).alias("start"))


def next_slots(spark, d):
    o = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    at = lambda *a: F.date_format(scalar.next_slot(F.col("t"), *a), "yyyy-MM-dd HH:mm")
    return o.select("event_id", at(9, 30).alias("daily"), at(6, 0, ["mon", "thu"]).alias("weekly"))


def message_budgets(spark, d):
    c = table(spark, d, "conversations")
    tokens = scalar.message_tokens(F.array("text", "role"), F.when(F.col("turn") % 3 == 0, F.col("turn")))
    return c.select("conv_id", "turn", tokens.alias("tokens"), scalar.effective_limit(F.col("conv_id") * 1000 + 9000, F.lit(8192), F.when(F.col("turn") % 2 == 0, F.lit(5000))).alias("budget"))


def model_ids(spark, d):
    return _part(spark, d).select("p_partkey", scalar.model_id(F.expr("'_' || p_name || '.V' || (p_size / 10) || '__X-'")).alias("model"))


def labels(spark, d):
    x = F.col("p_partkey") * F.when(F.col("p_size") % 4 == 0, 7919).otherwise(1)
    return _part(spark, d).select("p_partkey", scalar.short_count(x).alias("count"), scalar.money(F.when(F.col("p_size") % 5 == 0, F.lit(0.00001)).otherwise(F.col("p_size") / 8.0), F.when(F.col("p_size") % 2 == 0, "USD").otherwise("EUR")).alias("money"))


def backoffs(spark, d):
    a = F.col("event_id") % 9 + 1
    return table(spark, d, "events").select("event_id", *[scalar.backoff_ms(k, a, 500, 250, 3.0, F.col("event_id") % 5 / 4).alias(k) for k in ("fixed", "linear", "exponential", "jittered")])


def json_checks(spark, d):
    j = F.expr("case p_size % 5 when 0 then '{\"a\":' || p_partkey || '}' when 1 then '[1,' when 2 then '[-0]' when 3 then '\"-0\"' else '{\"b\":[-0.5,null]}' end")
    return _part(spark, d).select("p_partkey", scalar.valid_json(j).alias("valid"))


def frontmatters(spark, d):
    t = F.expr("'---\nname: ' || p_name || '\nbrand: ' || p_brand || '\n---\nUse {{ name }} of {{brand}} and {{name}}'")
    m = _part(spark, d).select("p_partkey", scalar.frontmatter(t).alias("m"), scalar.placeholders(t).alias("p"))
    return m.select("p_partkey", F.col("m")["name"].alias("name"), F.col("m")["brand"].alias("brand"), F.array_join("p", ",").alias("names"))


def observations(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 10 == 0, 503).otherwise(200).alias("status"), F.concat(F.lit("seen "), F.expr("event_id % 3")).alias("body"))
    h = e.withColumn("hash", catalog.observation_hash(F.col("status"), F.col("body")))
    first = log.velocity(h.withColumn("n", F.lit(0)), "user_id", ["event_id"], "n").drop("n", "delta")
    from pyspark.sql import Window

    before = F.lag("hash").over(Window.partitionBy("user_id").orderBy("event_id"))
    return first.withColumn("changed", F.coalesce(F.col("hash") != before, F.lit(True))).select("event_id", "hash", "changed")


def timeline(spark, d):
    stat = lines(spark, d).filter("l_quantity > 10").groupBy(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path")).agg(F.min("o_orderdate").alias("ts"), F.sum("l_linenumber").alias("additions"), F.max("l_linenumber").alias("deletions"))
    names = lines(spark, d).filter("l_quantity < 40").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), F.expr("case l_partkey % 3 when 0 then 'R' when 1 then 'M' else 'A' end").alias("status"), F.expr("case when l_partkey % 3 = 0 then l_partkey - 1 end").alias("previous_path")).distinct()
    out = catalog.timeline(stat, names, count(spark, d, "lineitem"))
    return out.select("hash", "path", F.coalesce("status", F.lit("-")).alias("status"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("previous_path", "additions", "deletions")])


def module_records(spark, d):
    p = _part(spark, d)
    facts = {
        "size": p.filter("p_size > 5").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("value")),
        "brand": p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value")),
        "kind": p.filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("value")),
    }
    out = catalog.module_records(p.select(F.col("p_partkey").alias("id")), facts)
    return out.select("id", *[F.coalesce(c, F.lit("-")).alias(c) for c in facts], "cautions")


def placement_labels(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 3).alias("package"))
    r = lines(spark, d).filter("l_quantity >= 45").join(c, "o_custkey").select("l_partkey", "package", F.col("l_orderkey").alias("module"))
    at = [("symbol", "s", 1), ("file", "f", 2), ("folder", "d", 16), ("package", "p", 64)]
    levels = F.array(*[F.struct(F.lit(name).alias("level"), F.concat(F.lit(mark), F.expr(f"l_partkey div {n}")).alias("place")) for name, mark, n in at])
    rows = r.withColumn("l", F.explode(levels)).select("l.level", "l.place", F.expr("l_partkey div 64 % 3").alias("home_package"), "package", "module")
    return catalog.placements(rows).withColumn("toward", F.coalesce("toward", F.lit(-1)))


def catalog_ids(spark, d):
    keys = _part(spark, d).select(F.expr("'V' || (p_partkey % 4) || '/' || replace(p_name, ' ', '_') || '.' || (p_size % 3)").alias("key"))
    models = _part(spark, d).select(F.col("p_partkey").alias("id"), F.expr("case p_size % 4 when 0 then 'v' || (p_partkey % 4) || '/' || replace(p_name, ' ', '-') || '-' || (p_size % 3) when 1 then replace(p_name, ' ', '-') || '.' || (p_size % 3) when 2 then 'models/' || replace(p_name, ' ', '_') || '-' || (p_size % 3) || ':free' else 'none' end").alias("model"), F.expr("case when p_partkey % 2 = 0 then 'v' || (p_partkey % 4) end").alias("vendor"))
    return catalog.catalog_ids(models, keys, ["models/"], [":free"]).withColumn("match", F.coalesce("match", F.lit("-")))


def hops_through(spark, d):
    _, edges = module_graph(spark, d)
    return catalog.hops_through(edges, _part(spark, d).filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id")))


def quota_windows(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("account"), F.expr("case s_suppkey % 3 when 0 then 'weekly' when 1 then 'monthly' else 'hourly' end").alias("span"), F.expr("s_suppkey % 9 + 1").alias("hours"), (F.col("s_acctbal") / 50).alias("used_percent"))
    return catalog.quota_windows(s).withColumn("used_percent", F.round("used_percent", 6))


def facet_lineage(spark, d):
    return catalog.facet_lineage(_part(spark, d).select(F.col("p_partkey").alias("id"), F.expr("case when p_partkey % 10 > 0 then p_partkey - 1 end").alias("parent")))


def appended(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id")
    heads = rows.groupBy("event_type").agg(F.min("event_id").alias("head")).filter("head % 2 = 0")
    return log.appended(rows, heads, "event_type", ["event_id"])


def declared_consumers(spark, d):
    s = table(spark, d, "supplier")
    known = s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("position"), F.lit(5).alias("seen_at"))
    wanted = s.filter("s_suppkey % 3 = 0").select(F.col("s_name").alias("name"))
    return log.declared(known, wanted, table(spark, d, "events"), "event_id", F.lit(9))


def moved_consumers(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("position"), F.expr("'c' || (s_suppkey % 2)").alias("claim"))
    moves = s.filter("position % 4 > 0").select("name", F.expr("position - position % 3 % 2").alias("from"), (F.col("position") + 100).alias("to"), F.lit("c1").alias("claim"))
    return log.moved(s, moves)


def due_consumers(spark, d):
    t = F.expr("timestamp'2024-01-01 12:00:00'")
    s = table(spark, d, "supplier")
    c = s.select(F.col("s_name").alias("name"), (F.col("s_suppkey") * 200).alias("position"), F.when(F.col("s_suppkey") % 3 == 0, t + F.expr("interval 1 minute")).alias("retry_at"), F.when(F.col("s_suppkey") % 7 == 0, t - F.expr("interval 5 minutes")).when(F.col("s_suppkey") % 7 == 1, t - F.expr("interval 1 minute")).alias("called_at"))
    return log.due(c, table(spark, d, "events"), "event_id", t).withColumn("next", F.coalesce("next", F.lit(-1)))


def schedule_ticks(spark, d):
    t = F.expr("timestamp'2024-01-01 12:00:00'")
    s = table(spark, d, "supplier").select(F.col("s_name").alias("key"), F.when(F.col("s_suppkey") % 3 > 0, t).otherwise(t + F.expr("interval 1 hour")).alias("next_due"), (F.col("s_suppkey") * 60000).alias("every_ms"), F.expr("case when s_suppkey % 5 = 0 then 'w' || s_suppkey end").alias("held_by"))
    return log.ticks(s, t).select("key", "outcome", F.coalesce(F.unix_millis("next_due") - F.unix_millis(t), F.lit(-1)).alias("wait"))


def frame_faults(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("run"), (F.col("turn") + F.when(F.col("conv_id") % 7 == 0, F.when(F.col("turn") > 1, 1).otherwise(0)).otherwise(0)).alias("cursor"), F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "terminal").otherwise("other").alias("kind"), (F.col("turn") % 2 == 0).alias("evidence"))
    return log.frame_faults(c)


def concept_graph(spark, d):
    r = table(spark, d, "lineitem").filter("l_quantity >= 49").select((F.col("l_partkey") % 60).alias("concept"), (F.col("l_suppkey") % 8).alias("package"), F.col("l_returnflag").alias("role")).distinct()
    o = _part(spark, d).select((F.col("p_partkey") % 60).alias("concept"), (F.col("p_size") % 60).cast("long").alias("other")).filter("concept <> other").distinct()
    dep = table(spark, d, "supplier").select((F.col("s_suppkey") % 8).alias("from"), (F.col("s_nationkey") % 8).cast("long").alias("to")).filter("from <> to").distinct()
    return catalog.concept_graph(r, o, dep)


def covered_ranks(spark, d):
    rows = _part(spark, d).filter("p_size >= 49").select("p_partkey", "p_size")
    return catalog.with_coverage(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("analyzed")))


def matrix_entities(spark, d):
    r = table(spark, d, "lineitem").filter("l_quantity >= 49")
    out = catalog.matrix_entities(r.select((F.col("l_suppkey") % 20).alias("a"), "l_returnflag", "l_partkey"), "a", "l_returnflag", "l_partkey")
    return out.withColumn("entities", F.array_join(F.col("entities").cast("array<string>"), ","))


def consumer_sites(spark, d):
    rows = lines(spark, d).select(F.col("l_suppkey").alias("supplier"), (F.col("o_custkey") % 50).alias("consumer"), "l_returnflag", "l_quantity")
    return catalog.consumer_sites(rows.filter("l_returnflag = 'R' and l_quantity > 30"), rows.filter("l_returnflag = 'A' and l_quantity > 30"))


def stride_checkpoints(spark, d):
    return history.stride_checkpoints(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", "o_orderdate", 11, 20).select("pos", "o_orderkey")


def newest_months(spark, d):
    return history.monthly_checkpoints(table(spark, d, "orders"), "o_orderkey", "o_orderdate", 6)


def renamed_lineages(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 300).alias("path"), "o_orderkey", (F.col("o_orderstatus") != "F").alias("alive"))
    aliases = table(spark, d, "orders").filter("o_custkey % 300 % 3 = 0").select((F.col("o_custkey") % 300).alias("old"), (F.col("o_custkey") % 300 + 1).alias("final")).distinct()
    return history.lineage_intervals(o, "path", "o_orderkey", "alive", aliases).withColumn("until", F.coalesce("until", F.lit(-1)))


def maximal_sequences(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set((F.col("l_suppkey") % 7).cast("int"))).alias("path"))
    return sets.maximal_sequences(o, "path").select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def weighted_shares(spark, d):
    s = _part(spark, d).select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_size") / 50).alias("a"), F.when(F.col("p_size") % 2 > 0, F.lit(0.5)).alias("b"), F.lit(0.2).alias("c"))
    return s.select("p_partkey", F.round(rollup.weighted_share({"a": 0.5, "b": 0.3, "c": 0.2}), 9).alias("gravity"))


def overlap_candidates(spark, d):
    p = _part(spark, d)
    items = p.select(F.col("p_partkey").alias("item"), F.expr("p_partkey % 300").alias("file"), F.array(F.concat(F.lit("t"), F.expr("p_partkey % 90")), F.concat(F.lit("u"), F.expr("p_size"))).alias("tokens"), F.expr("transform(sequence(0, 5), i -> 'q' || (p_partkey * (i + 1) % 97))").alias("properties"))
    conversions = p.filter("p_size = 7").select(F.col("p_partkey").alias("item"), F.expr("p_partkey - 1").alias("other"))
    coupled = p.filter("p_size = 9 and p_partkey % 300 > 0").select(F.expr("p_partkey % 300 - 1").alias("left"), F.expr("p_partkey % 300").alias("right")).distinct()
    return pairs.overlap_candidates(items, conversions, coupled, ["q1", "q2"], rows=6 * count(spark, d, "part"))


def reviewed(spark, d):
    p = _part(spark, d).select((F.col("p_partkey") % 150).alias("subject"), F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("a"), F.expr("case when p_size % 9 > 0 then p_size % 3 end").alias("b"), (F.col("p_size") % 11 == 0).alias("bad"))
    return rules.reviewed(p, ["a", "b"], "bad", "id")


QUERIES = {
    "shards": (shards, "select p_partkey as id, p_brand as package, p_size from part where p_brand in ('Brand#11', 'Brand#12')"),
    "exported": (exported, "select p_partkey, p_name from part"),
    "specifiers": (specifiers, "select p_partkey, case p_size % 7 when 1 then '@' || p_brand || '/' || p_partkey when 5 then 'lib' || p_partkey when 6 then 'lib' || p_partkey else '-' end as package from part"),
    "static_relations": (static_relations, f"with recursive {EDGE}, cl as (select src, dst from ed union select cl.src, ed.dst from cl join ed on ed.src = cl.dst), s as (select distinct l_orderkey, l_partkey from lineitem where l_quantity >= 49), p as (select distinct a.l_partkey as \"left\", b.l_partkey as \"right\" from s a join s b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey union select least(src, dst), greatest(src, dst) from ed), x as (select p.*, exists (select 1 from ed where src = p.\"left\" and dst = p.\"right\") as lr, exists (select 1 from ed where src = p.\"right\" and dst = p.\"left\") as rl, exists (select 1 from cl where (src = p.\"left\" and dst = p.\"right\") or (src = p.\"right\" and dst = p.\"left\")) as far from p) select \"left\", \"right\", case when lr and rl then 'both' when lr then 'left-to-right' when rl then 'right-to-left' when far then 'indirect' else 'none' end as static_relation from x"),
    "usage_by_agent": (usage_by_agent, "with u as (select l_suppkey % 500 as agent, count(*) as turns, sum(l_linenumber) as tokens from lineitem where l_quantity >= 48 group by 1), k as (select distinct s_suppkey % 500 + 1 as agent from supplier) select coalesce(u.agent, k.agent) as agent, coalesce(turns, 0) as turns, coalesce(tokens, 0)::bigint as tokens from u full join k on k.agent = u.agent"),
    "shared_affinity": (shared_affinity, "with g as (select l_orderkey, l_suppkey, max(l_quantity) as w from lineitem group by 1, 2), n as (select l_orderkey, greatest(1, count(*) - 1) as n from g group by 1) select a.l_suppkey as \"left\", b.l_suppkey as \"right\", round(sum(least(a.w, b.w) / n), 6) as affinity from g a join g b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey join n on n.l_orderkey = a.l_orderkey group by 1, 2"),
    "lock_lookup": (lock_lookup, "with a as (select distinct 'a' || (p_partkey % 3) || '/b' || (p_partkey % 5) || '/c' as locator, p_brand as name from part), l as (select distinct case p_size % 3 when 0 then '' when 1 then 'a' || (p_size % 2) else 'a' || (p_size % 3) || '/b' || (p_size % 5) end as at, p_brand as name from part) select a.locator, a.name, coalesce(arg_max(l.name || '@' || l.at, length(l.at)), '-') as version from a left join l on l.name = a.name and (l.at = '' or starts_with(a.locator || '/', l.at || '/')) group by 1, 2"),
    "relabelled": (relabelled, "select p_partkey, case when p_size % 5 > 0 and p_partkey % 2 in (p_partkey % 3, p_size % 3) then 'shares-domain' else 'crosses-domain' end as label from part"),
    "valid_budgets": (valid_budgets, "with f as (select *, o_totalprice - 50000 as cap, o_totalprice / 2 - 40000 as used from orders where o_orderstatus <> 'F' qualify row_number() over (partition by o_custkey order by o_orderkey) = 1) select o_custkey, round(cap, 6) as cap, round(used, 6) as spent, round(greatest(cap - used, 0), 6) as remaining, round(case when cap > 0 then least(1, greatest(cap - used, 0) / cap) else 0 end, 6) as share from f where cap >= 0 and (o_orderkey % 4 = 0 or o_orderdate <= timestamp '1997-01-01') and (o_orderkey % 5 = 0 or o_orderdate + interval 200 days > timestamp '1997-01-01')"),
    "patched_tags": (patched_tags, "select p_partkey, p_brand as a, case when p_size > 25 then 'new' else '-' end as b, p_name as c from part"),
    "missed_ranges": (missed_ranges, "with m as (select o_custkey || '/' || o_orderkey as name, coalesce(lag(o_orderkey) over (partition by o_custkey order by o_orderkey), 0) as f, least(3000, case when o_totalprice > 100000 then o_orderkey - 1 else o_orderkey end) as u from orders) select name, f + 1 as missed_from, u as missed_through from m where u > f"),
    "fresh_changes": (fresh_changes, "select l_partkey as id, l_orderkey, l_linenumber from lineitem join part on p_partkey = l_partkey where p_size = l_quantity::int"),
    "hashes": (hashes, "select p_partkey, substr(sha256(p_name), 1, 12) as short, sha1(p_name) as sha1, sha256('{\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}') as canonical from part"),
    "compacted": (compacted, "select p_partkey, '{' || concat_ws(',', case when p_size > 9 then '\"a\":' || p_size end, case when p_size < 30 then '\"b\":' || p_partkey end) || '}' as json from part"),
    "distances": (distances, "select p_partkey, round(sqrt((p_size - 7) ** 2 + (3.0::double - p_partkey % 11) ** 2), 9) as distance from part"),
    "durations": (durations, "select p_partkey, case p_partkey % 5 when 0 then p_size * 1000 when 1 then p_size * 60000 when 2 then p_size * 3600000 when 3 then p_size * 86400000::bigint else -1 end::bigint as cadence, case p_partkey % 5 when 0 then p_size * 60000 when 1 then p_size * 3600000 when 2 then p_size * 86400000::bigint when 3 then p_size * 604800000::bigint else -1 end::bigint as span, case p_partkey % 5 when 0 then p_size when 1 then p_size * 1000 when 2 then p_size * 60000 when 3 then p_size * 3600000 else -1 end::bigint as delay, case p_partkey % 4 when 0 then strftime(timestamp '2024-03-31 12:00:00' - to_years(p_size), '%Y-%m-%d') when 1 then strftime(timestamp '2024-03-31 12:00:00' - to_months(p_size), '%Y-%m-%d') when 2 then strftime(timestamp '2024-03-31 12:00:00' - to_days(p_size), '%Y-%m-%d') else '-' end as start from part"),
    "next_slots": (next_slots, "with e as (select event_id, ts, date_trunc('day', ts) as day from events), k as (select event_id, min(day + to_days(k::int) + interval 6 hours) as w from (select *, unnest(range(0, 8)) as k from e) where dayofweek(day + to_days(k::int)) in (1, 4) and day + to_days(k::int) + interval 6 hours > ts group by 1) select e.event_id, strftime(case when day + interval 570 minutes > ts then day + interval 570 minutes else day + interval 2010 minutes end, '%Y-%m-%d %H:%M') as daily, strftime(w, '%Y-%m-%d %H:%M') as weekly from e join k on k.event_id = e.event_id"),
    "message_budgets": (message_budgets, "with b as (select *, floor(greatest(0, conv_id * 1000 + 9000 - 8192 - ceil((conv_id * 1000 + 9000) * 0.08::double)) * 0.8::double)::bigint as h from conversations) select conv_id, turn, (ceil(length(text) / 4) + ceil(length(role) / 4) + 4 + case when turn % 3 = 0 then turn * 768 else 0 end)::bigint as tokens, case when turn % 2 = 0 then least(h, 5000) else h end as budget from b"),
    "model_ids": (model_ids, "select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower('_' || p_name || '.V' || (p_size / 10) || '__X-'), '[._]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as model from part"),
    "labels": (labels, "with x as (select p_partkey, p_size, p_partkey * case when p_size % 4 = 0 then 7919 else 1 end as n, p_size / 8 as m from part) select p_partkey, case when n >= 1000000 then printf('%.1fM', n / 1000000 + case when n % 500000 = 250000 then 0.001 else 0 end) when n >= 1000 then printf('%.1fk', n / 1000 + case when n % 500 = 250 then 0.001 else 0 end) else n::varchar end as count, case when p_size % 2 = 0 then case when p_size % 5 = 0 then '<$0.0001' when m < 1 then printf('$%.4f', m) else printf('$%.2f', m + case when p_size % 2 = 1 then 0.0001 else 0 end) end else case when p_size % 5 = 0 then '<0.0001 EUR' when m < 1 then printf('%.4f EUR', m) else printf('%.2f EUR', m + case when p_size % 2 = 1 then 0.0001 else 0 end) end end as money from x"),
    "backoffs": (backoffs, "select event_id, 500 as fixed, 500 + 250 * (event_id % 9) as linear, round(500 * 3.0::double ** (event_id % 9))::bigint as exponential, round(500 * 3.0::double ** (event_id % 9) * (0.8::double + 0.4::double * ((event_id % 5) / 4)))::bigint as jittered from events"),
    "json_checks": (json_checks, "select p_partkey, p_size % 5 in (0, 3, 4) as valid from part"),
    "frontmatters": (frontmatters, "select p_partkey, p_name as name, p_brand as brand, 'name,brand' as names from part"),
    "observations": (observations, "with h as (select user_id, event_id, sha256(case when event_id % 10 = 0 then '503' || chr(10) else '' end || 'seen ' || (event_id % 3)) as hash from events) select event_id, hash, coalesce(hash <> lag(hash) over (partition by user_id order by event_id), true) as changed from h"),
    "timeline": (timeline, "with s as (select l_orderkey as h, l_partkey as p, sum(l_linenumber) as a, max(l_linenumber) as d from lineitem where l_quantity > 10 group by 1, 2), n as (select distinct l_orderkey as h, l_partkey as p from lineitem where l_quantity < 40), x as (select coalesce(s.h, n.h) as hash, coalesce(s.p, n.p) as path, n.h is not null as named, a, d from s full join n on n.h = s.h and n.p = s.p) select hash, path, case when not named then '-' when path % 3 = 0 then 'R' when path % 3 = 1 then 'M' else 'A' end as status, case when named and path % 3 = 0 then path - 1 else -1 end as previous_path, coalesce(a, -1)::bigint as additions, coalesce(d, -1) as deletions from x"),
    "module_records": (module_records, "select p_partkey as id, case when p_size > 5 then p_size::varchar else '-' end as size, p_brand as brand, case when p_partkey % 4 > 0 then p_type else '-' end as kind, concat_ws(', ', case when p_size <= 5 then 'no size' end, case when p_partkey % 4 = 0 then 'no kind' end) as cautions from part"),
    "placement_labels": (placement_labels, "with r as (select distinct l_partkey as k, c_custkey % 3 as package, l_orderkey as m from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where l_quantity >= 45), u as (select 'symbol' as level, 's' || k as place, k // 64 % 3 as h, package, m from r union all select 'file', 'f' || (k // 2), k // 64 % 3, package, m from r union all select 'folder', 'd' || (k // 16), k // 64 % 3, package, m from r union all select 'package', 'p' || (k // 64), k // 64 % 3, package, m from r), b as (select level, place, h, package, count(distinct m) as n from u group by 1, 2, 3, 4), g as (select level, place, coalesce(sum(n) filter (package = h), 0)::bigint as home, coalesce(sum(n) filter (package <> h), 0)::bigint as away, max(n) filter (package <> h) as top, arg_min(package, (-n, package)) filter (package <> h) as lead from b group by 1, 2) select level, place, home, away, case when top / (home + away) >= 0.6 then 'departs' when home / (home + away) >= 0.6 then 'fits' else 'spread' end as label, case when top / (home + away) >= 0.6 then lead else -1 end as toward from g"),
    "catalog_ids": (catalog_ids, """with keys as (select distinct 'V' || (p_partkey % 4) || '/' || replace(p_name, ' ', '_') || '.' || (p_size % 3) as key from part), c as (select key, replace(replace(lower(key), '.', '-'), '_', '-') as ck, replace(replace(lower(substr(key, instr(key, '/') + 1)), '.', '-'), '_', '-') as cb from keys),
bp as (select ck, max(key) as hit from c group by 1), bb as (select cb, max(key) as hit from c group by 1 having count(*) = 1),
m as (select p_partkey as id, p_size % 4 as k, replace(replace(lower(p_name), ' ', '-'), '_', '-') || '-' || (p_size % 3) as x, 'v' || (p_partkey % 4) as v, p_partkey % 2 = 0 as has from part)
select id, case when k = 3 then '-' else coalesce(case when k = 0 then a.hit end, case when k in (1, 2) and has then a.hit end, case when k in (1, 2) then bb.hit end, '-') end as match from m left join bp a on a.ck = v || '/' || x left join bb on bb.cb = x"""),
    "hops_through": (hops_through, f"with recursive {EDGE}, hd as (select src as s, dst as t, 1 as h from ed union select hd.s, ed.dst, h + 1 from hd join ed on ed.src = hd.t where h < 60 and hd.s <> ed.dst), di as (select s, t, min(h) as h from hd group by 1, 2) select di.s as src, di.t as dst, di.h as hops, exists (select 1 from di a join di b on a.t = b.s where a.s = di.s and b.t = di.t and a.h + b.h = di.h and a.t % 3 = 0) as via from di"),
    "quota_windows": (quota_windows, "select s_suppkey as account, case s_suppkey % 3 when 0 then 'weekly' when 1 then 'monthly' else 'hourly' end as span, round(least(100, greatest(0, s_acctbal / 50)), 6) as used_percent, case s_suppkey % 3 when 0 then 168 when 1 then 720 else s_suppkey % 9 + 1 end * 3600000::bigint as duration from supplier"),
    "facet_lineage": (facet_lineage, "select p_partkey as id, p_partkey - k as ancestor, k::int as depth from (select p_partkey, unnest(range(0, p_partkey % 10 + 1)) as k from part)"),
    "appended": (appended, "with h as (select event_type, min(event_id) as head from events group by 1 having min(event_id) % 2 = 0) select e.event_type, event_id, row_number() over (partition by e.event_type order by event_id) + coalesce(head, 0) as position from events e left join h on h.event_type = e.event_type"),
    "declared_consumers": (declared_consumers, "select s_name as name, case when s_suppkey % 2 = 0 then s_suppkey else (select max(event_id) from events) end as position, case when s_suppkey % 3 = 0 then 9 else 5 end as seen_at from supplier where s_suppkey % 2 = 0 or s_suppkey % 3 = 0"),
    "moved_consumers": (moved_consumers, "with x as (select s_name as name, s_suppkey as k, s_suppkey % 2 = 1 and s_suppkey % 4 > 0 and s_suppkey % 3 % 2 = 0 as m from supplier) select name, case when m then k + 100 else k end as position, 'c' || (k % 2) as claim, m as moved from x"),
    "due_consumers": (due_consumers, "with x as (select s_name as name, s_suppkey as k, case when s_suppkey % 7 = 0 then 'stuck' when s_suppkey % 7 = 1 then 'busy' when s_suppkey * 200 >= (select max(event_id) from events) then 'idle' when s_suppkey % 3 = 0 then 'waiting' else 'due' end as state from supplier) select name, state, case when state = 'due' then k * 200 + 1 else -1 end as next from x"),
    "schedule_ticks": (schedule_ticks, "select s_name as key, case when s_suppkey % 5 = 0 then 'held by w' || s_suppkey else 'run' end as outcome, case when s_suppkey % 5 = 0 then -1 else s_suppkey * 60000 end as wait from supplier where s_suppkey % 3 > 0"),
    "frame_faults": (frame_faults, "with c as (select conv_id as run, turn + case when conv_id % 7 = 0 and turn > 1 then 1 else 0 end as cursor, (conv_id + turn) % 4 = 0 as t, turn % 2 = 0 as ev from conversations), x as (select *, row_number() over w - 1 as i, coalesce(bool_or(t) over (partition by run order by cursor rows between unbounded preceding and 1 preceding), false) as b from c window w as (partition by run order by cursor)), f as (select run, cursor, case when cursor <> i then 'out-of-order' when b and t then 'second-terminal' when b and not ev then 'late-activity' end as fault from x) select * from f where fault is not null"),
    "concept_graph": (concept_graph, "with r as (select distinct l_partkey % 60 as concept, l_suppkey % 8 as package, l_returnflag as role from lineitem where l_quantity >= 49), o as (select distinct p_partkey % 60 as concept, p_size % 60 as other from part where p_partkey % 60 <> p_size % 60), d as (select distinct s_suppkey % 8 as f, s_nationkey % 8 as t from supplier where s_suppkey % 8 <> s_nationkey % 8), m as (select distinct concept, package from r) select concept, 'role:' || role as kind, concept::varchar as \"from\", package::varchar as \"to\" from r union select concept, 'overlap', concept::varchar, other::varchar from o union select a.concept, 'dependency', f::varchar, t::varchar from d join m a on a.package = f join m b on b.package = t and b.concept = a.concept"),
    "covered_ranks": (covered_ranks, "with c as (select count(*) as k, count(*) filter (s_acctbal > 0) as a from supplier) select p_partkey, p_size, k as packages_known, a as packages_analyzed, case when k = a then 'complete' else 'lower-bound' end as certainty from part, c where p_size >= 49"),
    "matrix_entities": (matrix_entities, "select l_suppkey % 20 as row, l_returnflag as column, count(distinct l_partkey) as value, array_to_string(list_sort(list(distinct l_partkey)), ',') as entities from lineitem where l_quantity >= 49 group by 1, 2"),
    "consumer_sites": (consumer_sites, "with r as (select l_suppkey as supplier, o_custkey % 50 as consumer, l_returnflag as f from lineitem join orders on o_orderkey = l_orderkey where l_quantity > 30 and l_returnflag in ('R', 'A')) select supplier, consumer, count(*) filter (f = 'R') as \"references\", count(*) filter (f = 'A') as import_sites from r group by 1, 2"),
    "stride_checkpoints": (stride_checkpoints, "with o as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () - 1 as last from orders) select pos, o_orderkey from o where (last - pos) % 11 = 0 and last - pos < 220"),
    "newest_months": (newest_months, "select strftime(o_orderdate, '%Y-%m') as month, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1 order by 1 desc limit 6"),
    "renamed_lineages": (renamed_lineages, "with o as (select o_custkey % 300 as path, o_orderkey, o_orderstatus <> 'F' as alive, case when o_custkey % 300 % 3 = 0 then o_custkey % 300 + 1 else o_custkey % 300 end as lineage from orders), x as (select *, lag(path) over w as bp, lag(alive) over w as ba from o window w as (partition by lineage order by o_orderkey)), c as (select * from x where bp is null or bp <> path or ba <> alive) select lineage, path, o_orderkey as since, coalesce(lead(o_orderkey) over (partition by lineage order by o_orderkey), -1) as until, alive from c"),
    "maximal_sequences": (maximal_sequences, "with p as (select distinct x from (select l_orderkey, list_sort(list(distinct (l_suppkey % 7)::int)) as x from lineitem group by 1)) select array_to_string(x, '>') as path from p a where not exists (select 1 from p b where len(b.x) > len(a.x) and contains('>' || array_to_string(b.x, '>') || '>', '>' || array_to_string(a.x, '>') || '>'))"),
    "weighted_shares": (weighted_shares, "with s as (select p_partkey, case when p_size % 3 > 0 then p_size / 50 end as a, case when p_size % 2 > 0 then 0.5::double end as b from part) select p_partkey, round((coalesce(a, 0) * 0.5::double + coalesce(b, 0) * 0.3::double + 0.2::double * 0.2::double) / (0.2::double + case when a is null then 0 else 0.5::double end + case when b is null then 0 else 0.3::double end), 9) as gravity from s"),
    "overlap_candidates": (overlap_candidates, """with i as (select p_partkey as item, p_partkey % 300 as file, ['t' || (p_partkey % 90), 'u' || p_size] as t, list_distinct(list_transform(range(1, 7), lambda k: 'q' || (p_partkey * k % 97))) as q from part),
te as (select item, unnest(list_distinct(t)) as k from i), tb as (select k from te group by 1 having count(*) <= 40), pe as (select item, k from (select item, unnest(q) as k from i) where k not in ('q1', 'q2')), pb as (select k from pe group by 1 having count(*) <= 40),
g as (select distinct a.item as l, b.item as r, 'name' as g from te a join tb on tb.k = a.k join te b on b.k = a.k and a.item < b.item union select a.item, b.item, 'property' from pe a join pb on pb.k = a.k join pe b on b.k = a.k and a.item < b.item group by 1, 2 having count(*) >= 3
union select p_partkey - 1, p_partkey, 'conversion' from part where p_size = 7 union select least(a.item, b.item), greatest(a.item, b.item), 'temporal' from (select distinct p_partkey % 300 as f from part where p_size = 9 and p_partkey % 300 > 0) c join i a on a.file = c.f - 1 join i b on b.file = c.f)
select l as "left", r as "right", string_agg(g, ',' order by g) as generators from g where l <> r group by 1, 2"""),
    "reviewed": (reviewed, "with p as (select p_partkey % 150 as subject, p_partkey as id, p_size % 4 as a, case when p_size % 9 > 0 then p_size % 3 end as b, p_size % 11 = 0 as bad from part), m as (select x.subject, x.id, bool_or(coalesce(y.a = x.a and y.b = x.b and y.id < x.id, false)) as twin, bool_or(coalesce(y.a <= x.a and y.b <= x.b and (y.a < x.a or y.b < x.b), false)) as beaten from p x join p y on y.subject = x.subject and y.id <> x.id and not y.bad where not x.bad group by 1, 2) select p.subject, p.id, case when bad then 'invalid' when twin then 'indistinguishable' when beaten then 'dominated' else 'viable' end as state from p left join m on m.id = p.id"),
}
