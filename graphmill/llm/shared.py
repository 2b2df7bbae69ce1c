"""What several text operators share: the scratch folder, written tables, file systems."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which alone separates words in every contract here.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors see.

    Where that setting is absent, a temporary folder is made and set if the session
    has one machine only; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("graphmill.scratch", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        base = tempfile.mkdtemp(prefix="graphmill-")
        spark.conf.set("graphmill.scratch", base)
    return f"{base.rstrip('/')}/graphmill-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """df as a Parquet table in the shared scratch folder, read back: cuts the
    lineage and survives the loss of any executor. folders: columns by whose values
    the table is cut into folders."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path, partitionBy=list(folders) or None)
    return spark.read.schema(df.schema).parquet(path)


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The Arrow file system and inner path of a URI or plain path."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path):
        if path.startswith("file:"):
            return arrow_fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Keep the Arrow batches that go to Python workers under size bytes, so
    that a worker's memory doesn't follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text): all columns of docs in one struct, so that no name of theirs
    can clash with a working column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))


def unpacked(work: DataFrame, columns: list[str], out: list[str]) -> DataFrame:
    """The columns packed() took, without those named in out, then out."""
    return work.select(*[F.col(f"row.`{c}`").alias(c) for c in columns if c not in out], *out)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def n_words(column: str | Column) -> Column:
    """Number of words (long); null text: 0."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def unit_hash(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from md5 of the seed and the keys (null: 'null');
    any SQL engine with md5 can repeat it."""
    parts = [F.coalesce(k.cast("string"), F.lit("null")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
