"""Registered queries over bounded walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import impact
from ..operators.checkpoint import cut
from ..sources import tables as t
from .reporting import query

SEEDS_SQL = """told AS (SELECT l_orderkey, 'S' || l_suppkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-11-01'),
most AS (SELECT 'S' || l_suppkey AS node, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY 1 ORDER BY n DESC, node LIMIT 15),
seeds AS MATERIALIZED (SELECT node FROM (SELECT node FROM told WHERE k <= 4 UNION SELECT node FROM most) ORDER BY node LIMIT 25)"""


@query(f"WITH {SEEDS_SQL} SELECT node FROM seeds")
def walk_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where walks start: the first four suppliers of late stories, and the fifteen named most."""
    lines = t.load(spark, sf_dir, "lineitem")
    own = lambda since: lines.where(F.col("l_shipdate") >= t.moment(since)).withColumn("node", F.concat(F.lit("S"), "l_suppkey"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "node"))), lambda x: x["node"])
    stories = own("2001-11-01 00:00:00").groupBy(F.col("l_orderkey").alias("id")).agg(listed.alias("tickers"))
    return impact.walk_seeds(stories, own("2001-06-01 00:00:00").groupBy("node").agg(F.count("*").alias("mentions")))


#: The walk as a recursion over its queue: one node a step.
WALK_SQL = f"""{t.EDGES_SQL}, {SEEDS_SQL}, {{edges}}
ed AS MATERIALIZED (SELECT row_number() OVER (ORDER BY subject, predicate, object) AS id, * FROM walked),
deg AS (SELECT node, count(*) AS d FROM (SELECT subject AS node FROM ed UNION ALL SELECT object FROM ed) GROUP BY 1),
adj AS MATERIALIZED (SELECT node, list({{{{'id': id, 'other': other, 'forward': forward, 'c': confidence}}}} ORDER BY id) AS es FROM (SELECT subject AS node, object AS other, TRUE AS forward, id, confidence FROM ed WHERE confidence >= 0.35 UNION ALL SELECT object, subject, FALSE, id, confidence FROM ed WHERE confidence >= 0.35 AND subject <> object) GROUP BY 1),
walk(n, queue, seen, links) AS (
  SELECT 0::BIGINT, (SELECT list({{{{'node': node, 'hop': 0}}}} ORDER BY node) FROM seeds), (SELECT list(node ORDER BY node) FROM seeds), []::STRUCT(id BIGINT, forward BOOLEAN, hop INTEGER)[]
  UNION ALL
  SELECT n + 1, list_concat(queue[2:], list_transform(news, lambda x: {{{{'node': x, 'hop': hop + 1}}}})), list_concat(seen, news), list_concat(links, list_transform(es, lambda e: {{{{'id': e.id, 'forward': e.forward, 'hop': hop}}}}))
  FROM (SELECT *, list_filter(list_transform(es, lambda e: e.other), lambda x, i: NOT list_contains(seen, x) AND list_position(list_transform(es, lambda e: e.other), x) = i) AS news
    FROM (SELECT n, queue, seen, links, queue[1].hop AS hop, CASE WHEN queue[1].hop < 3 AND (queue[1].hop = 0 OR d <= 40) THEN list_filter(coalesce(adj.es, []), lambda e: NOT list_contains(list_transform(links, lambda l: l.id), e.id)) ELSE [] END AS es
      FROM walk LEFT JOIN adj ON adj.node = queue[1].node LEFT JOIN deg ON deg.node = queue[1].node WHERE len(queue) > 0 AND len(links) < 40 AND len(seen) < 400))),
met AS (SELECT unnest(links) AS l FROM (SELECT links FROM walk ORDER BY n DESC LIMIT 1)),
links AS MATERIALIZED (SELECT subject, predicate, object, l.forward AS forward, least(l.hop + 1, 4) AS order_, greatest(0, least(1, confidence * pow(0.75, l.hop))) AS conf,
  subject || ' ' || replace(predicate, '_', ' ') || ' ' || object || CASE WHEN l.forward THEN '' ELSE ' (reverse exposure)' END AS mechanism FROM met JOIN ed ON ed.id = l.id ORDER BY conf DESC, order_, subject, predicate, object LIMIT 40)"""
WHOLE, PART = "walked AS (SELECT * FROM edges),", "walked AS (SELECT * FROM edges WHERE predicate <> 'supplies' OR confidence >= 0.99),"


def _walk_sql(edges: str) -> str:
    return WALK_SQL.replace("{edges}", edges).replace("{{", "{").replace("}}", "}")


@query(f"WITH RECURSIVE {_walk_sql(WHOLE)} SELECT subject, predicate, object, forward, order_ AS \"order\", round(conf, 6) AS confidence, mechanism FROM links")
def impact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest links that a walk from the window's entities meets before it has enough."""
    return impact.impact_links(t.kg_edges(spark, sf_dir), walk_seeds(spark, sf_dir), cut).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH RECURSIVE {_walk_sql(PART)} SELECT subject, predicate, object, forward, order_ AS \"order\", round(conf, 6) AS confidence, mechanism FROM links")
def impact_links_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the strongest supplies only, where walks go on to customers, nations and regions."""
    edges = t.kg_edges(spark, sf_dir).where("predicate <> 'supplies' OR confidence >= 0.99")
    return impact.impact_links(edges, walk_seeds(spark, sf_dir), cut).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH RECURSIVE {_walk_sql(PART)}, ranked AS (SELECT *, row_number() OVER (ORDER BY conf DESC, order_, subject, predicate, object) AS rank FROM links),
tr AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'arc ' || c_custkey END AS name, CASE WHEN c_custkey % 4 = 0 THEN [] ELSE ['c' || c_custkey, 'n' || c_nationkey, ''] END AS named, c_custkey % 3 = 0 AS claims, c_nationkey, c_custkey % 7 AS o FROM customer),
hit AS (SELECT tr.id, rank, subject AS f, object AS g, mechanism, order_, conf FROM tr JOIN ranked ON (len(named) = 0 AND NOT claims) OR list_contains(named, lower(subject)) OR list_contains(named, lower(object)) OR (claims AND (lower(subject) = 'n' || c_nationkey OR lower(object) = 'n' || c_nationkey))
  UNION ALL SELECT id, 41, CASE WHEN name = '' THEN 'trend' ELSE name END, 'N' || c_nationkey, 'pays', greatest(2, least(4, CASE WHEN o = 0 THEN 2 ELSE o END)), 0.35 FROM tr WHERE claims)
SELECT id, place::INT AS place, f AS from_entity, g AS to_entity, mechanism, order_ AS "order", round(conf, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS place FROM hit) WHERE place <= 20""")
def trend_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade of an arc a customer: links that touch what it names, or all, and its own claim."""
    links = cut(impact.impact_links(t.kg_edges(spark, sf_dir).where("predicate <> 'supplies' OR confidence >= 0.99"), walk_seeds(spark, sf_dir), cut))
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    named = F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), key.cast("string")), F.concat(F.lit("n"), nation), F.lit("")))
    claim = F.struct(F.concat(F.lit("N"), nation).alias("entity"), F.lit(" pays ").alias("mechanism"), (key % 7).cast("int").alias("order"))
    blank = F.struct(F.lit("").alias("entity"), F.lit("x").alias("mechanism"), F.lit(3).alias("order"))
    trends = t.load(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("arc "), key.cast("string"))).alias("name"), named.alias("named"), F.when(key % 3 == 0, F.array(claim, blank)).otherwise(F.array().cast("array<struct<entity:string,mechanism:string,order:int>>")).alias("claims"))
    return impact.trend_cascades(trends, links).withColumn("confidence", F.round("confidence", 6))
