"""Mixing sources to target weights.

Tokens (words) are aggregated per source, targets are shares of all tokens by
weight with a ceiling on repetition, and each document is emitted floor(rate)
times plus one hash-seeded Bernoulli copy with probability equal to the
fraction, where rate = target / source size. A draw is a hash of the document, turned
by a seed of its source: of SEEDS turns, each of them an even draw, the one that
brings the source's taken words nearest to its target (the first where some tie).

One pass counts words; sizes and draws are kept as a narrow table. Shuffles: two
map-side combined aggregations per source. The per-source table is joined back by broadcast where its row count is checked to be small, otherwise
by a salted join, so that a source with a third of all rows is spread either way.

Defined results: null text counts 0 words; a null source is a source of its
own, ordered last; a source without words has target 0 and rate 0; rows with equal
doc_id and text share one draw, others, also those with null or repeated doc_ids,
have their own; an empty table gives an empty result. Only the named columns are
read; all others pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.shared import fresh, n_words, unit_hash, written

#: Rows of the per-source table up to which it is broadcast (about 60 bytes each).
BROADCAST_ROWS = 100_000
SALTS = 64
#: Seeds tried for each source.
SEEDS = 16


def source_targets(sized: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """(source, size) rows -> one row per source: source_size, target, rate.

    Sources in code-point order, null last, take the weights in turn. Targets
    share all words by weight; none exceeds max_repeat times its source, the
    excess being reshared. With sources in order of ceiling / weight, the
    level at which each next source would settle is
    (total - ceilings before) / (weights from here on); the largest such level
    is the one where no further source is over its ceiling.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.select("source", "source_size", place.alias("place"))
    per = per.withColumn("weight", F.element_at(cycle, F.col("place") % len(weights) + 1).cast("long"))
    per = per.withColumn("ceiling", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), "place")
    before = F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy(F.lit(1))
    per = per.withColumn("level", (F.sum("source_size").over(whole) - before) / onward)
    per = per.withColumn("level", F.max("level").over(whole))
    target = F.least(F.col("ceiling").cast("double"), F.col("weight") * F.col("level"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def turned(draw: Column, turn: int | Column) -> Column:
    """A draw in [0, 1) turned by turn / SEEDS, again in [0, 1)."""
    at = draw + turn / F.lit(float(SEEDS))
    return at - F.floor(at)


def fraction(rate: str = "rate") -> Column:
    return F.col(rate) - F.floor(rate)


def joined_back(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows (source, draw, ...) with the columns of their source."""
    if per.count() <= BROADCAST_ROWS:
        return rows.alias("d").join(F.broadcast(per).alias("p"), F.expr("d.source <=> p.source"))
    salted = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return rows.alias("d").join(salted.alias("p"), F.expr("d.source <=> p.source AND d.salt = p.salt"))


def with_turns(sized: DataFrame, per: DataFrame) -> DataFrame:
    """per with turn: the seed that brings each source nearest to its target."""
    extra = [F.sum(F.when(turned(F.col("draw"), F.lit(k)) < fraction(), F.col("size")).otherwise(0)).alias(f"extra_{k}") for k in range(SEEDS)]
    sums = joined_back(sized, per).groupBy("p.source").agg(*extra).alias("s")
    off = [F.struct(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"extra_{k}") - F.col("target")).alias("off"), F.lit(k).alias("turn")) for k in range(SEEDS)]
    both = per.alias("p").join(sums, F.expr("p.source <=> s.source"))
    return both.select("p.source", "source_size", "target", "rate", F.array_min(F.array(*off))["turn"].alias("turn"))


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_repeat: int = 3,
    seed: int = 42,
    out_col: str = "mix",
) -> DataFrame:
    """docs with one struct column out_col (size, source_size, target, copies),
    which replaces a column of that name."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    draw = unit_hash(seed, F.col(id_col), F.md5(F.col(text_col).cast("binary")))
    full = docs.select(row.alias("row"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), draw.alias("draw"))
    sized = written(full.select("source", "size", "draw"), "mix-sizes")
    per = written(source_targets(sized, weights, max_repeat), "mix")
    per = written(with_turns(sized, per), "mix-turns")
    extra = F.when(turned(F.col("draw"), F.col("turn")) < fraction(), 1).otherwise(0)
    mix = F.struct(F.col("size"), F.col("source_size"), F.col("target"), (F.floor("rate") + extra).cast("long").alias("copies"))
    return joined_back(full, per).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != out_col], mix.alias(out_col))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it."""
    mix = fresh(docs, "mix")
    planned = plan_mix(docs, out_col=mix, **options)
    copies = F.array_repeat(F.lit(0), F.col(f"{mix}.copies").cast("int"))
    return planned.withColumn(mix, F.explode(copies)).select(*docs.columns)
