"""Searches, lookups, details and scores over the record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import metering, rules, structure
from ..operators.sets import running_total
from .tables import lines, table

#: Fixed lookup of media types by extension.
MEDIA = [("htm", "text/html"), ("html", "text/html"), ("json", "application/json"), ("css", "text/css")]


def log_filter(spark, d):
    """Events as log entries: of level info or above, from runs, holding a text that spans the joined fields."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "info").otherwise("debug")
    source = F.when(F.col("event_id") % 3 == 0, "host").otherwise("run")
    e = table(spark, d, "events").select("event_id", level.alias("level"), source.alias("source"), F.col("event_type").alias("message"), F.concat(F.lit("Run "), F.col("user_id")).alias("run_name"), F.col("user_id").cast("string").alias("run_id"), F.lit(None).cast("string").alias("step_id"))
    return e.filter(scalar.log_matches("info", "run", " CLICK run 1 ")).select("event_id", "level").union(e.filter(scalar.log_matches("error", "host")).select("event_id", "level"))


def entity_search(spark, d):
    keys = F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand")
    hits = [table(spark, d, "part").filter(scalar.search_keys(keys, n, m)).select("p_partkey", F.lit(m).alias("mode")) for n, m in (("BRAND#21", "exact"), ("red", "prefix"), ("gear", "contains"))]
    return hits[0].union(hits[1]).union(hits[2])


def tagged_runs(spark, d):
    tags = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tags.alias("tags"))
    return rows.filter(scalar.has_pairs(F.col("tags"), {"flag": "R", "status": "F"})).select("l_orderkey", "l_linenumber")


def media_types(spark, d):
    kinds = spark.createDataFrame(MEDIA, "ext string, media string")
    path = F.regexp_replace(F.regexp_replace("url", "/*([?#].*)?$", ""), "^[a-z]+://", "")
    rows = table(spark, d, "pages").select("page_id", scalar.extension(F.concat(path, F.when(F.col("page_id") % 3 == 0, ".HTML").when(F.col("page_id") % 3 == 1, ".json").otherwise("/.x"))).alias("ext"))
    return rows.join(F.broadcast(kinds), "ext", "left").select("page_id", F.coalesce("media", F.lit("unknown")).alias("media"))  # a fixed list


def enriched_catalog(spark, d):
    base = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("size"), "p_retailprice")
    other = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 100).alias("size"), (F.col("p_retailprice") + F.when(F.col("p_partkey") % 2 == 0, 1.0).otherwise(0.0)).alias("p_retailprice"))
    return metering.enriched(base, other, "p_partkey", ["size"], ["p_retailprice"]).select("p_partkey", F.coalesce("size", F.lit(-1)).alias("size"))


def fold_scores(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b"))
    return rows.select("p_partkey", F.round(rules.fold_score({"a": 0.7, "b": 0.6}), 9).alias("score"))


def rule_violations(spark, d):
    findings = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_replace("url", "^[a-z]+://", "").alias("place"))
    required = findings.filter("id % 5 = 0").select(scalar.folder_of(F.col("place")).alias("facet")).filter("facet <> ''").distinct()
    return rules.violations(required.select(F.md5("facet").alias("rule"), "facet", F.lit(True).alias("required")), findings)


def overview(spark, d):
    o, n = table(spark, d, "orders"), lines(spark, d)
    a = o.agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    return a.join(n.agg(F.count("*").alias("lines"), F.countDistinct("l_partkey").alias("parts")))


def brand_details(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_brand").agg(F.count("*").alias("parts"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), F.max("p_size").alias("largest"))


def brand_overlaps(spark, d):
    sizes = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("s"))
    names = sizes.select(F.col("p_brand").alias("left"), F.col("s").alias("a")), sizes.select(F.col("p_brand").alias("right"), F.col("s").alias("b"))
    both = names[0].join(names[1], F.col("left") < F.col("right")).withColumn("x", scalar.set_parts(F.col("a"), F.col("b")))  # 25 brands
    return both.select("left", "right", F.size("x.shared").alias("shared"), F.size("x.left_only").alias("left_only"), F.size("x.right_only").alias("right_only"))


def embedding_json(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.from_json(F.to_json(F.transform("embedding", lambda x: x.cast("double"))), "array<double>").alias("e"))
    return v.select("vec_id", F.size("e").alias("size"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def running_totals(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return running_total(rows, ["o_custkey"], ["o_orderkey"], "o_totalprice", "so_far").select("o_orderkey", F.round("so_far", 2).alias("so_far"))


def top_orders(spark, d):
    return structure.top_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)




PAGES = "select page_id as id, regexp_replace(url, '^[a-z]+://', '') as place from pages"

QUERIES = {
    "log_filter": (log_filter, "select event_id, 'info' as level from events where event_type = 'click' and event_id % 3 > 0 and contains('click run ' || user_id || ' ' || user_id || ' ', 'click run 1') union all select event_id, 'error' from events where event_type = 'error' and event_id % 3 = 0"),
    "entity_search": (entity_search, "select p_partkey, 'exact' as mode from part where lower(p_brand) = 'brand#21' or lower(p_name) = 'brand#21' union all select p_partkey, 'prefix' from part where starts_with(lower(p_name), 'red') or starts_with(lower(p_brand), 'red') union all select p_partkey, 'contains' from part where contains(lower(p_name), 'gear') or contains(lower(p_brand), 'gear')"),
    "tagged_runs": (tagged_runs, "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linestatus = 'F'"),
    "media_types": (media_types, "select page_id, case page_id % 3 when 0 then 'text/html' when 1 then 'application/json' else 'unknown' end as media from pages"),
    "enriched_catalog": (enriched_catalog, "select p_partkey, case when p_partkey % 3 <> 0 then p_size when p_partkey % 2 <> 0 then p_size + 100 else -1 end as size from part"),
    "fold_scores": (fold_scores, "select p_partkey, round(least(1, greatest(0, p_size / 50 * 0.7::double + p_retailprice / 2000 * 0.6::double)), 9) as score from part"),
    "rule_violations": (rule_violations, f"with p as ({PAGES}), f as (select distinct regexp_replace(place, '/?[^/]*$', '') as facet from p where id % 5 = 0) select distinct md5(facet) as rule, facet, id, place from p join f on facet <> '' and (place = facet or starts_with(place, facet || '/'))"),
    "overview": (overview, "select (select count(*) from orders) as orders, (select count(distinct o_custkey) from orders) as customers, (select min(o_orderdate) from orders) as first, (select max(o_orderdate) from orders) as last, (select count(*) from lineitem join orders on l_orderkey = o_orderkey) as lines, (select count(distinct l_partkey) from lineitem) as parts"),
    "brand_details": (brand_details, "select p_brand, count(*) as parts, array_to_string(list_sort(list(distinct p_type)), ',') as types, max(p_size) as largest from part group by 1"),
    "brand_overlaps": (brand_overlaps, "with s as (select p_brand, list(distinct p_size) as s from part group by 1) select a.p_brand as \"left\", b.p_brand as \"right\", len(list_intersect(a.s, b.s)) as shared, len(a.s) - len(list_intersect(a.s, b.s)) as left_only, len(b.s) - len(list_intersect(a.s, b.s)) as right_only from s a join s b on a.p_brand < b.p_brand"),
    "embedding_json": (embedding_json, "select vec_id, len(embedding) as size, round(list_sum(embedding::double[]), 6) as total from embeddings"),
    "running_totals": (running_totals, "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey), 2) as so_far from orders"),
    "top_orders": (top_orders, "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3"),
}
