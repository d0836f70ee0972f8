"""Connected components and links inside buckets."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Rows up to which a table of fixed-width rows (under 64 bytes each) is broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 500_000
#: Members of a large bucket, on average, that meet as many others in one group of the join.
TILE = 512


def small(df: DataFrame) -> DataFrame:
    """Mark a written table of fixed-width rows for broadcast if its count is within BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """`node`, `label` for the nodes of `edges` (a, b): the least node of each connected component.

    Each round hangs every node under its least neighbour, if that is less, and under that one's parent, and then
    contracts the edges to the parents, so that rounds shrink fast. Every round is written, so its work does not pile
    up. Hot nodes are met by partial aggregation and by joins that adaptive execution can split. No edges give no rows.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = materialize(both(edges))
    labels = links.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while not links.isEmpty():
        up = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("p"))
        above = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parents = materialize(up.join(above, "p", "left").select("node", F.coalesce("pp", "p").alias("parent")))
        labels = materialize(labels.join(parents.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("parent", "label").alias("label")))
        pa, pb = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        links = materialize(links.join(pa, "a").join(pb, "b").where("pa != pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    return labels


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The `labels` that `components` gives for their edges and `edges` (a, b) together, written: only edges between different labels are followed."""
    of = lambda x: small(labels).select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
    both = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y"))
    both = materialize(both.where("x != y"))
    moved = materialize(components(both.select(F.col("x").alias("a"), F.col("y").alias("b")))).toDF("label", "to")
    ends = both.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("label")), F.struct(F.col("b").alias("node"), F.col("y").alias("label")))).alias("e")).select("e.*")
    return materialize(labels.unionByName(ends).distinct().join(small(moved), "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def star_pairs(members: DataFrame, *ends: str) -> DataFrame:
    """Pairs (a, b), a < b, of each member of a bucket with the bucket's `ends` (columns of nodes)."""
    each = members.select("node", F.explode(F.array(*ends)).alias("end")).where(F.col("node") != F.col("end"))
    return each.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()


def with_hub(members: DataFrame) -> DataFrame:
    """Add `hub`, the bucket's node that meets the most others over all buckets: likely the text that the others derive from."""
    size = members.groupBy("bucket").agg(F.count("*").alias("_size"))
    score = members.join(size, "bucket").groupBy("node").agg(F.sum("_size").alias("_score"))
    hub = members.join(score, "node").groupBy("bucket").agg(F.max(F.struct("_score", "node")).alias("_h"))
    return members.join(hub.select("bucket", F.col("_h.node").alias("hub")), "bucket")


def open_members(members: DataFrame, labels: DataFrame, met: int) -> DataFrame:
    """The members, with their labels, of buckets whose nodes do not all share a component yet.

    Buckets of at most `met` nodes are left out: there the star pairs have compared all.
    """
    own = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = own.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("k")).where((F.col("x") != F.col("y")) & (F.col("k") > met)).select("bucket")
    return own.join(mixed, "bucket")


def open_pairs(left: DataFrame, close: Column | None = None) -> DataFrame:
    """Pairs (a, b) of one bucket with different labels, of written open members. `close` may use l.* and r.*.

    A bucket whose members are all connected has none, so copies are never expanded into all pairs.
    """
    l, r = left.alias("l"), left.alias("r")
    on = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.label") != F.col("r.label"))
    return l.join(r, on & close if close is not None else on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def tiled_pairs(left: DataFrame, close: Column) -> DataFrame:
    """Pairs (a, b) as those of `open_pairs`, for large buckets: written open members with `k` (members of the bucket) and `part`, a whole
    number that differs by at most one between members that are `close`.

    Every two members meet. A bucket's members are dealt over k / TILE chunks and each two chunks are one group of the join, so that a
    bucket is many groups of bounded size; a member is copied once for each chunk that it meets. Groups are few bytes and much work,
    so they are dealt over all partitions, which adaptive execution would join by their bytes.
    """
    chunks, n = F.ceil(F.col("k") / TILE).cast("long"), shuffle_partitions(left.sparkSession)
    own, keys = F.pmod(F.xxhash64("node"), chunks), ("bucket", "part", "_i", "_j")
    every = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
    l = left.withColumn("_i", own).withColumn("_j", every).repartition(n, *keys).alias("l")
    r = left.withColumn("_j", own).withColumn("_i", every).withColumn("_down", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("part", F.col("part") - F.col("_down")).repartition(n, *keys).alias("r")
    on = reduce(and_, (F.col(f"l.{c}") == F.col(f"r.{c}") for c in keys))
    once = (F.col("r._down") == 1) | (F.col("l.node") < F.col("r.node"))
    met = l.join(r, on & once & (F.col("l.label") != F.col("r.label")) & close)
    return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
