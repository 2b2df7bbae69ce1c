"""Quality rules: hashed n-gram log-likelihood ratios, and base counts per text.

Words and word pairs, lower-cased, are hashed into BUCKETS buckets. Two multinomials over the
buckets are counted: of the raw corpus (all documents) and of a trusted target
(documents whose label says quality 1, a bounded sample of at most max_trusted
of them, chosen by hash). A document's score is the mean over its n-grams of
log p(target) - log p(raw); a document passes where the score is at least
`threshold`. With the base rules this is deterministic for every document.

Everything is DataFrame operations. The corpus counts are one map-side combined
aggregation into BUCKETS rows; the ratios (BUCKETS rows, a fixed bound) become
an array literal, so scoring is a projection of each row and moves no text.
Windows of words are told apart by 64-bit hashes, built by doubling widths: of
lower-cased words first, and of the words as they are where those repeat.

Defined results: null text has no words, all counts 0, score 0.0, base_failed;
without trusted documents every ratio is 0 and all pass the ratio rule; null or
repeated doc_ids are rows like others; an empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.shared import WORD, packed, text_of, unpacked

BUCKETS = 1 << 16
#: Pseudo-count of every bucket in both multinomials.
SMOOTH = 1.0
THRESHOLD = -0.15
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0))


def joined_hashes(hashes: str | Column, step: int) -> Column:
    """The hash of each element with the one step places on, where there is one."""
    after = F.slice(hashes, step + 1, F.greatest(F.size(hashes) - step, F.lit(0)))
    both = F.zip_with(F.slice(hashes, 1, F.size(after)), after, lambda a, b: F.xxhash64(a, b))
    return both


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, as the only element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_hashes(rows: DataFrame) -> DataFrame:
    """rows (with words) with plain and pairs: the hash of every lower-cased word and
    of every pair of neighbours."""
    out = rows.withColumn("plain", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    return out.withColumn("pairs", joined_hashes("plain", 1))


def bucket_of(h: Column) -> Column:
    return h.bitwiseAND(BUCKETS - 1).cast("int")


def buckets_of(text: str | Column) -> Column:
    """The bucket of every word and of every pair of a text."""
    plain = F.transform(words_of(text), lambda w: F.xxhash64(F.lower(w)))
    return bound(plain, lambda p: F.transform(F.concat(p, joined_hashes(p, 1)), bucket_of))


def ratios(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_trusted: int = 20_000) -> list[float]:
    """log p(target) - log p(raw) of each bucket; both multinomials are counted in one
    pass over docs."""
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id")).dropna().distinct()
    trusted = trusted.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(max_trusted).withColumn("trusted", F.lit(1))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(trusted), "doc_id", "left")
    grams = rows.select("trusted", F.explode(buckets_of("text")).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    held = {r.bucket: (r.raw, r.target) for r in counts.collect()}  # BUCKETS rows at most
    totals = [sum(x[i] for x in held.values()) + SMOOTH * BUCKETS for i in (0, 1)]
    if totals[1] == SMOOTH * BUCKETS:
        return [0.0] * BUCKETS
    return [math.log((held.get(b, (0, 0))[1] + SMOOTH) / totals[1]) - math.log((held.get(b, (0, 0))[0] + SMOOTH) / totals[0]) for b in range(BUCKETS)]


def literal_array(values: list[float]) -> Column:
    """An array<double> that the optimiser folds into one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def covered(places: Column) -> Column:
    """Words in windows that begin at the ordered places."""
    after = F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0)))
    gaps = F.zip_with(places, after, lambda a, b: F.least(b - a, F.lit(WINDOW)))  # the last: null and so WINDOW
    return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counted(rows: DataFrame) -> DataFrame:
    """rows (row, text) with words, plain, pairs and the base counts of each text."""
    out = with_hashes(rows.withColumn("words", words_of("text")))
    words = F.col("words")
    # Windows of 2, 4, 8 words: each hash joins two of half its width.
    out = out.withColumn("window", joined_hashes("pairs", 2)).withColumn("window", joined_hashes("window", 4))
    again = F.size(F.array_distinct("window")) < F.size("window")
    out = out.withColumn("exact", F.when(again, F.transform(words, lambda w: F.xxhash64(w)))).drop("window")
    for step in (1, 2, 4):
        out = out.withColumn("exact", joined_hashes("exact", step))
    placed = F.sort_array(F.transform("exact", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    out = out.withColumn("placed", placed).drop("exact")
    n = F.size("placed")
    twin = F.filter("placed", lambda p, k: ((k > 0) & (F.get("placed", k - 1)["w"] == p["w"])) | ((k < n - 1) & (F.get("placed", k + 1)["w"] == p["w"])))
    out = out.withColumn("twins", F.sort_array(F.transform(twin, lambda p: p["i"]))).drop("placed")
    lines = F.filter(F.split(text_of("text"), "\n"), lambda x: x.rlike(WORD))
    out = out.withColumn("lines", lines)
    return out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(text_of("text"), F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered(F.col("twins")), F.lit(0)).cast("long"),
        }
    ).drop("lines", "twins")


def judge(docs: DataFrame, weights: list[float], *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, base_failed, the mean log ratio and kept;
    these replace columns of the same names."""
    out = counted(packed(docs, text_col))
    table = literal_array(weights)
    n_grams = F.size("plain") + F.size("pairs")
    total = F.aggregate(F.concat("plain", "pairs"), F.lit(0.0), lambda s, h: s + F.get(table, bucket_of(h)))
    out = out.withColumn("ratio", total / F.greatest(n_grams, F.lit(1))).drop("words", "plain", "pairs")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
    return unpacked(out, docs.columns, [*COUNTS, "base_failed", "kept", "ratio"])
