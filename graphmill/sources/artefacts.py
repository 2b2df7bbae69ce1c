"""What stages leave for one another: similarity bundles, evaluations, reused tables.

All are Parquet, CSV or text folders that Spark writes and reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators.metrics import metric_lines, roc_points, summary
from graphmill.operators.similarity import degrees_of


def found(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path, None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def first_found(spark: SparkSession, *paths: str) -> DataFrame:
    """The table at the first path that has one; FileNotFoundError naming all otherwise."""
    for path in paths:
        if (df := found(spark, path)) is not None:
            return df
    raise FileNotFoundError(f"no table at any of {list(paths)}")


def reused(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path, built and written first where there is none."""
    if (df := found(spark, path)) is not None:
        return df
    build().write.parquet(path)
    return spark.read.parquet(path)


def save_bundle(sim: DataFrame, members: DataFrame, folder: str) -> None:
    """A similarity (i, j, sim) and its members (node, local, and degree if known)."""
    sim.select("i", "j", "sim").write.mode("overwrite").parquet(f"{folder}/sim")
    members.write.mode("overwrite").parquet(f"{folder}/members")


def load_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(sim, members with degree); members without a degree have the number of their
    similarities over 0."""
    sim, members = first_found(spark, f"{folder}/sim"), first_found(spark, f"{folder}/members")
    if "degree" not in members.columns:
        members = members.join(degrees_of(sim), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return sim, members


def save_evaluation(preds: DataFrame, row: DataFrame, folder: str, names: tuple[str, ...] = ("auc", "accuracy", "f1", "precision", "recall"), dataset: bool = False) -> None:
    """Predictions and ROC points as CSV, the metric row as lines of text."""
    preds.select("y_true", "y_score").write.mode("overwrite").csv(f"{folder}/raw_pred", header=True)
    roc_points(preds).orderBy("fpr", "tpr").write.mode("overwrite").csv(f"{folder}/roc", header=True)
    metric_lines(row, names, dataset).coalesce(1).write.mode("overwrite").text(f"{folder}/metrics")


def named_copy(path: str, suffix: str = "_llm") -> str:
    """The path of a table derived from another CSV."""
    stem = path.removesuffix(".csv")
    return f"{stem}{suffix}.csv"


def each_model(models: dict[str, Callable[[], DataFrame]]) -> tuple[list[DataFrame], dict[str, str]]:
    """Metric rows of the models that can be evaluated, and what went wrong with the
    others: whatever a model's evaluation raises doesn't stop the rest. Each is run once;
    what it found, a row or a few, is what is returned."""
    rows, failed = [], {}
    for name, evaluate in models.items():
        try:
            found = evaluate()
            rows.append(found.sparkSession.createDataFrame(found.collect(), found.schema))
        except Exception as error:  # noqa: BLE001
            failed[name] = (str(error) or type(error).__name__).splitlines()[0]
    return rows, failed


def compared(models: dict[str, Callable[[], DataFrame]], path: str) -> tuple[DataFrame | None, dict[str, str]]:
    """The metric rows of all models that can be evaluated, best first, written as CSV;
    None where none can."""
    rows, failed = each_model(models)
    if not rows:
        return None, failed
    out = summary(rows)
    out.coalesce(1).write.mode("overwrite").csv(path, header=True)  # a row per model
    return out, failed
