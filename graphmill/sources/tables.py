"""Readers with declared schemas, and the graph roles of the star-schema tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node_index long, node_id string, node_type string, node_name string"
EDGES = "relation string, x_index long, y_index long"
LABELLED = f"{EDGES}, label int"
MAPPING = "DrugID string, DiseaseID string"
ONTOLOGY = "graphs array<struct<nodes array<struct<id:string,meta:struct<xrefs:array<struct<val:string>>,basicPropertyValues:array<struct<pred:string,val:string>>>>>>>"
DRUGS, OTHERS = 10_000_000, 20_000_000
#: Lines of a shuffle partition.
ROWS = 500_000
#: Size of the vectors in embeddings.
PLACES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table. The session gets a shuffle partition for every ROWS of its lines
    where it has fewer, so that what a task holds doesn't grow with the table."""
    lines = table(spark, sf_dir, "lineitem")
    needed = -(-lines.count() // ROWS)  # from the files' footers
    if needed > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", needed)
    return lines


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with header under a declared schema, pruned to columns."""
    df = spark.read.schema(schema).option("enforceSchema", False).csv(path, header=True)
    return require(df, columns).select(*columns) if columns else df


def require(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """df, or ValueError naming the columns it lacks."""
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def optional(spark: SparkSession, path: str | None, schema: str) -> DataFrame | None:
    """A CSV source that may be absent."""
    if not path:
        return None
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def ontology_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, meta) of the nodes of the first graph of an ontology in JSON."""
    graphs = spark.read.schema(ONTOLOGY).json(path, multiLine=True)
    return graphs.select(F.posexplode(F.get("graphs", F.lit(0))["nodes"]).alias("ord", "node")).select("ord", "node.id", "node.meta")


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The path of the most recently modified file, by path where times tie."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    row = files.agg(F.max(F.struct("modificationTime", "path")).alias("last")).first()
    return row.last.path if row.last else None


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: disease, supplier: drug, customer: other."""
    kinds = (("part", "p_partkey", "p_name", "disease", 0), ("supplier", "s_suppkey", "s_name", "drug", DRUGS), ("customer", "c_custkey", "c_name", "other", OTHERS))
    parts = [
        table(spark, sf_dir, name).select((F.col(key) + shift).alias("node_index"), F.col(key).cast("string").alias("node_id"), F.lit(kind).alias("node_type"), F.col(label).alias("node_name"))
        for name, key, label, kind, shift in kinds
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem as an edge supplier - part by return flag."""
    return lineitem(spark, sf_dir).select(F.col("l_returnflag").alias("relation"), (F.col("l_suppkey") + DRUGS).alias("x_index"), F.col("l_partkey").alias("y_index"), "l_orderkey", "l_linenumber", "l_quantity")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply edges with the first line of each order also the other way round,
    and the purchases customer - part of all orders."""
    lines = supply(spark, sf_dir)
    back = lines.where("l_linenumber = 1").select("relation", F.col("y_index").alias("x_index"), F.col("x_index").alias("y_index"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey") + OTHERS)
    bought = lines.join(orders.toDF("l_orderkey", "customer"), "l_orderkey").select(F.lit("purchased").alias("relation"), F.col("customer").alias("x_index"), "y_index")
    return lines.select("relation", "x_index", "y_index").unionByName(back).unionByName(bought)


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External pairs: drug and disease ids as text, some of which are unknown."""
    lines = lineitem(spark, sf_dir)
    drug = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("X"), "l_suppkey")).otherwise(F.col("l_suppkey").cast("string"))
    disease = F.concat(F.lit("MESH:D"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"))
    return lines.select(drug.alias("DrugID"), F.when(F.col("l_suppkey") % 11 == 0, F.concat(F.lit("OMIM:"), "l_partkey")).otherwise(disease).alias("DiseaseID"))
