"""Queries over the graph of recommendations and the bridge of artists and descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateforge.operators import graph
from crateforge.operators.components import components
from crateforge.operators.overlap import overlap_join
from crateforge.plans import catalog as c
from crateforge.plans.catalog import table
from crateforge.plans.registry import query
from crateforge.sources.staging import stage, tidy

#: Undirected edges u < v of the recommendations, and both directions of them.
EDGES = "(select distinct least(album_id, recommended_id) u, greatest(album_id, recommended_id) v from @recommendation)"
BOTH = f"(select u, v from {EDGES} union all select v, u from {EDGES})"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The recommendations as a staged edge table (u, v): they are computed once, however often a measure reads them."""
    found = c.recommendation(spark, d).select(F.col("album_id").alias("u"), F.col("recommended_id").alias("v"))
    return stage(found)[0]


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated sources: every album whose id is divisible by 20."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("node"))


@query(f"with recursive b as materialized (select * from {BOTH}), r as (select u node, u root from b union select b.v, r.root from r join b on b.u = r.node) select node, min(root) root from r group by node")
@tidy
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return components(edges(spark, d))


@query(f"select node, degree, nodes from (select u node, count(*) degree from {BOTH} group by u) join (select degree, count(*) nodes from (select u, count(*) degree from {BOTH} group by u) group by degree) using (degree)")
@tidy
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Each album's degree, and how many albums have it."""
    found = edges(spark, d)
    return graph.degrees(found).join(graph.degree_histogram(found), "degree").select("node", "degree", "nodes")


REACHED = f"""with recursive b as materialized (select * from {BOTH}),
r as (select distinct u source, u node, 0 distance from b where u % 20 = 0 union select r.source, b.v, r.distance + 1 from r join b on b.u = r.node where r.distance < 24),
s as (select source, node, cast(min(distance) as int) distance from r group by all)"""


@query(f"{REACHED} select source, node, distance from s")
@tidy
def graph_distances(spark: SparkSession, d: str) -> DataFrame:
    """Edges on the shortest ways from the stated sources to all albums."""
    return graph.distances(edges(spark, d), asked(spark, d))


@query(f"""{REACHED}, n as (select count(distinct u) al from b)
select source node, max(distance) eccentricity, count(*) reached, round((count(*) - 1) / sum(distance) * (count(*) - 1) / (select al - 1 from n), 9) closeness from s group by source""")
@tidy
def graph_eccentricity(spark: SparkSession, d: str) -> DataFrame:
    return graph.eccentricities(edges(spark, d), asked(spark, d)).withColumn("closeness", F.round("closeness", 9))


@query(f"""{REACHED}, e as (select source, max(distance) e from s group by source), m as (select min(e) radius, max(e) diameter from e)
select radius, diameter, count(*) filter (e = radius) centre, count(*) filter (e = diameter) periphery from e, m group by all""")
@tidy
def graph_extent(spark: SparkSession, d: str) -> DataFrame:
    """Radius and diameter over the stated sources, and how many of them are central or peripheral."""
    return graph.extent(graph.eccentricities(edges(spark, d), asked(spark, d)))


@query(f"with b as materialized (select * from {BOTH}) select count(distinct u) nodes, count(*) // 2 edges, count(*) / (count(distinct u) * (count(distinct u) - 1.0)) density from b")
@tidy
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return graph.density(edges(spark, d))


@query(f"""with b as materialized (select * from {BOTH}), n as (select u node, count(*) degree from b group by u),
t as (select x.u node, count(*) // 2 triangles from b x join b y on y.u = x.v join b z on z.u = y.v and z.v = x.u group by x.u)
select node, degree, coalesce(triangles, 0) triangles, case when degree > 1 then round(2.0 * coalesce(triangles, 0) / (degree * (degree - 1)), 9) else 0 end clustering from n left join t using (node)""")
@tidy
def graph_clustering(spark: SparkSession, d: str) -> DataFrame:
    return graph.clustering(edges(spark, d)).withColumn("clustering", F.round("clustering", 9))


@query()
@tidy
def graph_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks along the recommendations as they point; held against numpy in the tests, as SQL cannot iterate to an end."""
    return graph.pagerank(edges(spark, d))


@query()
@tidy
def graph_eigenvector(spark: SparkSession, d: str) -> DataFrame:
    return graph.eigenvector(edges(spark, d))


@query()
@tidy
def graph_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Over the ways that start at the stated sources."""
    return graph.betweenness(edges(spark, d), asked(spark, d))


#: Descriptors that two artists must share.
SHARED = 34


@query(f"""with m as materialized (select distinct artist_id a, descriptor_id i from @album join @album_descriptor using (album_id))
select x.a, y.a b, count(*) shared from m x join m y on x.i = y.i and x.a < y.a group by x.a, y.a having count(*) >= {SHARED}""")
def artist_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Artists weighted by the descriptors that they share, from SHARED on: the projection of the bridge on artists."""
    used = c.album(spark, d).join(c.album_descriptor(spark, d), "album_id").select(F.col("artist_id").alias("key"), F.col("descriptor_id").alias("item"))
    return overlap_join(used, SHARED)


@query(f"""with recursive b as materialized (select * from {BOTH}), r as (select 0::bigint node, 0 d union select b.v, d + 1 from r join b on b.u = r.node where d < 2)
select u, v from {EDGES} where u in (select node from r) and v in (select node from r)""")
@tidy
def graph_ego(spark: SparkSession, d: str) -> DataFrame:
    """The edges among the albums at most two steps from album 0."""
    return graph.ego(edges(spark, d), 0, 2)
