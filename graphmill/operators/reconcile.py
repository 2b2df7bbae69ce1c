"""Identifier reconciliation between vocabularies, and enrichment of edge sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESH = "MESH:"
#: Start of the term addresses that count.
MONDO = "http://purl.obolibrary.org/obo/MONDO_"


def last_by_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A two-column map in which the last row of a key wins."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def no_zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+", "")


def padded(c: Column) -> Column:
    """Left-padded with zeros to 6 characters, never cut."""
    return F.when(F.char_length(c) >= 6, c).otherwise(F.lpad(c, 6, "0"))


def bare(c: Column) -> Column:
    """A MeSH key without its letters D and leading zeros, where it starts with D."""
    return F.when(c.startswith("D"), no_zeros(F.replace(c, F.lit("D"), F.lit("")))).otherwise(no_zeros(c))


def lookup_keys(c: Column) -> Column:
    """The keys under which a disease id is sought, in order."""
    plain = F.replace(c, F.lit(MESH), F.lit(""))
    short = bare(plain)
    return F.array(plain, F.concat(F.lit("D"), padded(short)), short)


def crosswalk(terms: DataFrame) -> DataFrame:
    """(key, mondo) from ontology terms (ord, id, meta): MeSH keys of a term's
    cross references and exact matches; in order of terms and of keys within
    one, the last writer of a key wins. Terms outside MONDO, and empty ids or
    keys, give none."""
    mondo = no_zeros(F.element_at(F.split("id", "_"), -1))
    refs = F.transform(F.filter(F.coalesce("meta.xrefs", F.array()), lambda x: x["val"].startswith(MESH)), lambda x: F.replace(x["val"], F.lit(MESH), F.lit("")))
    exact = F.filter(F.coalesce("meta.basicPropertyValues", F.array()), lambda p: p["pred"].endswith("exactMatch") & p["val"].contains("mesh/D"))
    exact = F.transform(exact, lambda p: F.element_at(F.split(p["val"], "/"), -1))
    own = terms.where(F.col("id").startswith(MONDO)).select("ord", mondo.alias("mondo"), F.posexplode(F.concat(refs, exact)).alias("i", "raw"))
    short = bare(F.col("raw"))
    keys = own.select("ord", "i", "mondo", F.posexplode(F.array("raw", F.concat(F.lit("D"), padded(short)), short)).alias("k", "key"))
    keys = keys.where("key <> '' AND mondo <> ''").withColumn("at", F.struct("ord", "i", "k"))
    return last_by_key(keys, "key", "mondo", "at")


def reconcile_drugs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs with x_index and x_name of the drug whose node_id is DrugID."""
    drugs = nodes.where("node_type = 'drug'").groupBy("node_id").agg(F.max_by(F.struct("node_index", "node_name"), "node_index").alias("n"))
    joined = pairs.join(drugs, pairs.DrugID == drugs.node_id, "left")
    return joined.select(*pairs.columns, F.col("n.node_index").alias("x_index"), F.col("n.node_name").alias("x_name"))


def reconcile_diseases(pairs: DataFrame, walk: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs with y_index and y_name: the first key of DiseaseID that the
    crosswalk knows names a term; if that term is no node, later keys aren't tried."""
    ids = pairs.select("DiseaseID").where("DiseaseID IS NOT NULL").distinct()
    keys = ids.select("DiseaseID", F.posexplode(lookup_keys(F.col("DiseaseID"))).alias("i", "key"))
    known = keys.join(walk, "key").groupBy("DiseaseID").agg(F.min_by("mondo", "i").alias("mondo"))
    diseases = nodes.where("node_type = 'disease'").groupBy("node_id").agg(F.max_by(F.struct("node_index", "node_name"), "node_index").alias("n"))
    found = known.join(diseases, known.mondo == diseases.node_id).select("DiseaseID", F.col("n.node_index").alias("y_index"), F.col("n.node_name").alias("y_name"))
    return pairs.join(found, "DiseaseID", "left").select(*pairs.columns, "y_index", "y_name")


def coverage(mapped: DataFrame) -> DataFrame:
    """One row of counts: distinct ids, unmatched ones and their share, and rows
    matched on both sides."""
    gone = lambda key, index: F.countDistinct(F.when(F.col(index).isNull(), F.col(key)))
    out = mapped.agg(
        F.count("*").alias("n_rows"), F.countDistinct("DrugID").alias("n_drugs"), gone("DrugID", "x_index").alias("drugs_unmatched"),
        F.countDistinct("DiseaseID").alias("n_diseases"), gone("DiseaseID", "y_index").alias("diseases_unmatched"),
        F.count_if(F.col("x_index").isNotNull() & F.col("y_index").isNotNull()).alias("rows_matched"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({"drug_gap": share("drugs_unmatched", "n_drugs"), "disease_gap": share("diseases_unmatched", "n_diseases"), "row_share": share("rows_matched", "n_rows")})


def matched_only(mapped: DataFrame) -> DataFrame:
    return mapped.dropna(subset=["x_index", "y_index"])


def enrich(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the names and types of both ends, missing ones null, and
    is_valid: a drug and a disease in either order. A task holds its share of the nodes;
    edges pass by it unsorted, so one end with very many of them takes no memory."""
    side = lambda s: nodes.select(F.col("node_index").alias(f"{s}_index"), F.col("node_name").alias(f"{s}_name"), F.col("node_type").alias(f"{s}_type")).hint("shuffle_hash")
    out = edges.join(side("x"), "x_index", "left").join(side("y"), "y_index", "left")
    kinds = ("drug", "disease")
    valid = F.col("x_type").isin(*kinds) & F.col("y_type").isin(*kinds) & (F.col("x_type") != F.col("y_type"))
    return out.select(*edges.columns, "x_name", "y_name", "x_type", "y_type", F.coalesce(valid, F.lit(False)).alias("is_valid"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
