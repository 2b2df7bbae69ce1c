"""Losses and metrics of predictions (y_true, y_score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.lineage import settled

#: Distinct scores that one task cumulates, about.
RANGE = 1 << 20


def bce(logit: Column, label: Column) -> Column:
    """Binary cross-entropy of a logit, stable at both ends."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log(1 + F.exp(-F.abs(logit)))


def batch_loss(rows: DataFrame, batch: str, how: str) -> DataFrame:
    """loss: 'rows' weighs batches by their rows, 'batches' weighs them alike."""
    per = rows.groupBy(batch).agg(F.avg("loss").alias("l"), F.count("*").alias("n"))
    value = F.sum(F.col("l") * F.col("n")) / F.sum("n") if how == "rows" else F.avg("l")
    return per.agg(value.alias("loss"))


def confusion(preds: DataFrame, threshold: float = 0.5, inclusive: bool = True) -> DataFrame:
    """accuracy, f1, precision, recall; a ratio of nothing is 0."""
    said = F.col("y_score") >= threshold if inclusive else F.col("y_score") > threshold
    true = F.col("y_true") == 1
    c = preds.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count("*").alias("n"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, n = (F.col(x) for x in ("tp", "fp", "fn", "n"))
    return c.select(ratio(n - fp - fn, n).alias("accuracy"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def by_score(preds: DataFrame) -> DataFrame:
    """(s, p, n): positives and negatives at each distinct score, combined map-side."""
    return preds.groupBy(F.col("y_score").alias("s")).agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") != 1).alias("n"))


def cumulated(scores: DataFrame, size: int = RANGE) -> DataFrame:
    """by_score() rows with tp and fp, sums down to and including each score, and r, the
    range a score is in, from the highest.

    Scores are dealt by range into as many partitions as make about size rows each; sums
    within a range are shifted by the sums of the ranges above, a row per range.
    """
    scores = settled(scores)
    ranges = max(1, -(-scores.count() // size))
    if ranges == 1:
        placed = scores.withColumn("r", F.lit(0))
    else:  # a checkpoint, so that a range's number stays its own
        placed = settled(scores.repartitionByRange(ranges, F.desc("s")).withColumn("r", F.spark_partition_id()))
    sums = placed.groupBy("r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("r", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("an"))
    within = Window.partitionBy("r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({"wp": F.sum("p").over(within), "wn": F.sum("n").over(within)}).join(F.broadcast(sums), "r")
    return out.select("r", "s", "p", "n", (F.col("ap") + F.col("wp")).alias("tp"), (F.col("an") + F.col("wn")).alias("fp"))


def auc_by_rank(preds: DataFrame, fallback: float | None = None) -> DataFrame:
    """auc: share of positive-negative pairs in order, ties counting half."""
    c = cumulated(by_score(preds)).agg(F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.col("n") * F.col("p") / 2).alias("won"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    pairs = F.col("pos") * F.col("neg")
    return c.select(F.when(pairs > 0, F.col("won") / pairs).otherwise(F.lit(fallback).cast("double")).alias("auc"))


def roc_points(preds: DataFrame) -> DataFrame:
    """(fpr, tpr, threshold) from the origin on, collinear points left out; a rate
    of no positives or no negatives is null, of no rows only the origin is left."""
    c = cumulated(by_score(preds))
    total = c.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    # A point lies on a line with its neighbours if the steps to it and from it are
    # equal; a step is its score's own counts. The step after a range's last score
    # is the first one of the next range, found in a table of one row per range.
    firsts = c.groupBy("r").agg(F.max_by(F.struct("p", "n"), "s").alias("first"))
    firsts = firsts.select("r", F.lead("first").over(Window.orderBy("r")).alias("then"), (F.row_number().over(Window.orderBy("r")) == 1).alias("top"))
    order = Window.partitionBy("r").orderBy(F.desc("s"))
    ahead = c.withColumns({"next": F.lead(F.struct("p", "n")).over(order), "place": F.row_number().over(order)}).join(F.broadcast(firsts), "r")
    ahead = ahead.withColumn("next", F.coalesce("next", "then"))
    kept = ahead.where("(top AND place = 1) OR next IS NULL OR p <> next.p OR n <> next.n")
    origin = total.select(F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(float("inf")).alias("threshold"))
    points = kept.select("tp", "fp", F.col("s").cast("double").alias("threshold")).unionByName(origin)
    return points.join(F.broadcast(total)).select(F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"), "threshold")


def auc_by_area(preds: DataFrame, fallback: float | None = None) -> DataFrame:
    """auc: area under the curve by trapezoids; of one class: fallback."""
    c = cumulated(by_score(preds))
    area = F.sum(F.col("n") * (2 * F.col("tp") - F.col("p")) / 2)
    pairs = F.sum("p") * F.sum("n")
    return c.agg(F.when(pairs > 0, F.try_divide(area, pairs)).otherwise(F.lit(fallback).cast("double")).alias("auc"))


def evaluate(preds: DataFrame, model: str, dataset: str, threshold: float = 0.5, inclusive: bool = True, fallback: float | None = None) -> DataFrame:
    """One row: model, dataset, auc, accuracy, f1, precision, recall."""
    row = auc_by_rank(preds, fallback).join(confusion(preds, threshold, inclusive))
    return row.select(F.lit(model).alias("model"), F.lit(dataset).alias("dataset"), "auc", "accuracy", "f1", "precision", "recall")


def summary(rows: list[DataFrame]) -> DataFrame:
    """Metric rows of several models, best first."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.desc("auc"), "model", "dataset")


def metric_lines(row: DataFrame, names: tuple[str, ...] = ("auc", "accuracy", "f1", "precision", "recall"), dataset: bool = False) -> DataFrame:
    """A metric row as lines of text, six decimals, after a line that names the
    dataset if asked for."""
    lines = [F.format_string(f"{n}: %.6f", F.col(n)) for n in names]
    head = [F.concat(F.lit("Dataset: "), "dataset")] if dataset else []
    return row.select(F.explode(F.array(*head, *lines)).alias("value"))


def early_stop(history: DataFrame, patience: int) -> DataFrame:
    """history (epoch, value) with best so far, improved (strictly) and streak
    of epochs without; rows after patience ran out are not kept."""
    order = Window.orderBy("epoch")
    before = F.max("value").over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = history.withColumn("improved", before.isNull() | (F.col("value") > before)).withColumn("best", F.max("value").over(order))
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(order)
    out = out.withColumn("streak", F.col("epoch") - last)
    done = F.max((F.col("streak") >= patience).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("done", F.coalesce(done, F.lit(0))).where("done = 0").drop("done")
