"""Edge tables: canonical form, splits, pools, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.hashing import draw
from graphmill.functions.lineage import stored

EDGE = ["relation", "src", "dst"]


def canonical(edges: DataFrame) -> DataFrame:
    """Adds src, dst: the endpoints in order (a null endpoint is skipped)."""
    return edges.withColumns({"src": F.least("x_index", "y_index"), "dst": F.greatest("x_index", "y_index")})


def dedup(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges; nulls equal nulls."""
    return canonical(edges).select(*EDGE).dropDuplicates(EDGE)


def dense_position(df: DataFrame, group: list[str], order: str, width: int = 1 << 16) -> DataFrame:
    """Adds pos, the 0-based place by a whole-number column within its group.

    Places are counted within runs of width values and shifted by the sizes of
    the runs before (a table of distinct group x run), so no group is one task.
    """
    run = F.floor(F.col(order) / width)
    df = df.withColumn("_run", run)
    sizes = df.groupBy(*group, "_run").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*group, "_run", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*group, "_run").orderBy(order)) - 1
    placed = df.withColumn("_own", own).join(sizes, [*group, "_run"])
    return placed.withColumn("pos", F.col("_before") + F.col("_own")).drop("_run", "_own", "_before")


def border(counts: DataFrame, digit: Column, start: DataFrame) -> DataFrame:
    """One row (digit, before, quota): the smallest digit at which the cumulative count,
    from before on, passes the quota (null: none does), and the count below it.
    counts: (count, digit's columns), few digits; start: one row (before, quota)."""
    sums = counts.groupBy(digit.alias("_d")).agg(F.sum("count").alias("_n")).join(F.broadcast(start))
    upto = F.col("before") + F.sum("_n").over(Window.orderBy("_d"))
    passed = sums.withColumn("_upto", upto).agg(F.min(F.when(F.col("_upto") > F.col("quota"), F.col("_d"))).alias("digit"), F.max(F.when(F.col("_upto") <= F.col("quota"), F.col("_upto"))).alias("_below"))
    return passed.join(F.broadcast(start)).select("digit", F.coalesce("_below", "before").alias("before"), "quota")


def split(edges: DataFrame, seed: int = 42, tenths: int = 9) -> DataFrame:
    """Adds split: 'train' for the first floor(n * tenths / 10) edges in the
    order of a hash, 'val' for the rest.

    The border is found by radix: counts of the hash's first 20 bits (combined
    map-side), cumulated over their first 10 bits and then, in the one that holds the
    border, over the next 10. Only the rows of one prefix of 20 bits are ranked, about a
    millionth of all; for the others a comparison decides. Edges and their hashes are
    made once, into a table, and the counts, of a row per prefix, into another.
    """
    hashed = stored(edges.withColumn("_h", draw(seed, *[F.col(c) for c in EDGE])).withColumn("_p", F.shiftright("_h", 12)), "split")
    counts = stored(hashed.groupBy("_p").count().coalesce(8), "split-counts")
    start = counts.agg(F.lit(0).cast("long").alias("before"), F.floor(F.coalesce(F.sum("count"), F.lit(0)) * tenths / 10).alias("quota"))
    first = border(counts, F.shiftright("_p", 10), start)
    inside = counts.join(F.broadcast(first.select("digit")), F.shiftright("_p", 10) == F.col("digit")).select("_p", "count")
    second = border(inside, F.col("_p"), first.select("before", "quota"))
    digit, before, quota = second.first()  # one row
    placed = hashed.withColumns({"digit": F.lit(digit).cast("long"), "before": F.lit(before).cast("long"), "quota": F.lit(quota).cast("long")})
    whole = placed.where("digit IS NULL OR _p <> digit").withColumn("split", F.when(F.col("_p") >= F.col("digit"), "val").otherwise("train"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_h", *EDGE))
    edge = placed.where("_p = digit").withColumn("split", F.when(F.col("before") + rank <= F.col("quota"), "train").otherwise("val"))
    return whole.unionByName(edge).select(*edges.columns, "split")


def relation_ids(edges: DataFrame) -> DataFrame:
    """(relation, rel_id): dense ids in code-point order of the vocabulary."""
    names = edges.select("relation").where("relation IS NOT NULL").distinct()
    return names.withColumn("rel_id", (F.row_number().over(Window.orderBy("relation")) - 1).cast("long"))


def pools(edges: DataFrame) -> DataFrame:
    """(relation, pos, node): the endpoints of each relation, numbered densely."""
    ends = edges.where("relation IS NOT NULL").select("relation", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return dense_position(ends, ["relation"], "node").select("relation", "pos", "node")


def pool_sizes(pool: DataFrame) -> DataFrame:
    return pool.groupBy("relation").agg(F.count("*").alias("n"))


def without(edges: DataFrame, banned: DataFrame, keys: list[str] = EDGE) -> DataFrame:
    """Edges that are not in banned, repeats kept."""
    return edges.join(banned.select(*keys).distinct(), keys, "left_anti")


def total_degree(edges: DataFrame) -> DataFrame:
    """Rows at each node; a self loop counts twice."""
    return edges.select(F.explode(F.array("x_index", "y_index")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("y_index").alias("node")).agg(F.count("*").alias("degree"))


def decile_bins(degrees: DataFrame) -> DataFrame:
    """One row: bins, the distinct linear deciles of the degrees in order."""
    points = F.percentile("degree", [i / 10 for i in range(11)])
    return degrees.agg(F.array_distinct(points).alias("bins"))


def bin_of(degree: Column, bins: Column) -> Column:
    """The bin a degree is in, the largest degree in the last bin."""
    place = F.size(F.filter(bins, lambda b: b <= degree)) - 1
    return F.greatest(F.lit(0), F.least(place, F.size(bins) - 2))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, nbr): distinct neighbours in both directions."""
    both = edges.select(F.col("x_index").alias("node"), F.col("y_index").alias("nbr")).union(edges.select("y_index", "x_index"))
    return both.distinct()


def shuffled(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Rows in the order of a hash."""
    return df.orderBy(draw(seed, *[F.col(k) for k in keys]), *keys)
