"""Graph and location tables: A30 (edges, degree, node size), T7 + J8 (top
subgraph), F24 (node class), J6 + A31 (connections per location).

The reference draws a graph of its first 1,000 rows; here every row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions import net


def edge_weights(df: DataFrame, a: str = "src_ip", b: str = "dst_ip") -> DataFrame:
    """Undirected weighted edges (node_a <= node_b), weight = rows."""
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    return (df.where(x.isNotNull() & y.isNotNull())
              .groupBy(F.least(x, y).alias("node_a"), F.greatest(x, y).alias("node_b"))
              .agg(F.count(F.lit(1)).alias("weight")))


def node_degree(edges: DataFrame) -> DataFrame:
    """degree = incident distinct edges (a self-loop adds 2); node size
    10 + 2 * degree; class of the node as an address (F24)."""
    ends = edges.select(F.explode(F.array("node_a", "node_b")).alias("node"))
    deg = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return deg.select("node", "degree", (F.lit(10) + 2 * F.col("degree")).alias("node_size"),
                      net.ip_class("node").alias("node_class"))


def top_nodes(degree: DataFrame, k: int = 50) -> DataFrame:
    """K nodes of highest degree (ties by name)."""
    return degree.orderBy(F.desc("degree"), F.asc("node")).limit(k)


def top_subgraph(edges: DataFrame, k: int = 50) -> DataFrame:
    """Edges whose both ends are among the top k nodes.  The node list
    is at most k rows (limit), so broadcasting it has a proven bound."""
    top = F.broadcast(top_nodes(node_degree(edges), k).select("node"))
    e = edges.join(top.withColumnRenamed("node", "node_a"), "node_a", "left_semi")
    return e.join(top.withColumnRenamed("node", "node_b"), "node_b", "left_semi")


def location_counts(df: DataFrame, locations: DataFrame, src: str = "src_ip", dst: str = "dst_ip",
                    key: str = "ip", loc_cols: tuple = ("lat", "lon")) -> DataFrame:
    """J6 + A31: connections per location over both ends, marker radius
    5 + 15 * count / max, colour red above 0.7 * max else blue."""
    ends = df.select(F.col(src).alias("__ip")).unionAll(df.select(F.col(dst).alias("__ip")))
    loc = locations.select(F.col(key).alias("__ip"), *[F.col(c) for c in loc_cols])
    counts = ends.join(loc, "__ip").groupBy(*loc_cols).agg(F.count(F.lit(1)).alias("count"))
    mx = counts.agg(F.max("count").alias("__max"))  # one row
    out = counts.crossJoin(F.broadcast(mx))
    return out.select(*loc_cols, "count",
                      (F.lit(5.0) + F.col("count") / F.col("__max") * 15).alias("radius"),
                      F.when(F.col("count") > F.col("__max") * 0.7, "red").otherwise("blue").alias("color"))
