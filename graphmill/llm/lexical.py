"""Ranked lexical search, pruned by hashed max-sketches.

A term's impact in a document depends on its occurrences and the document's length;
the item's side is the term's weight. A document's sketch has CELLS coordinates: its
terms are hashed to them, and each holds the maximum of the impacts that meet there. So
for an item, the sum of its terms' weights times the coordinates they look up is never
below the document's score.

Two scans of the documents per block of items, with nothing shuffled but counts and
results:

1. Counts: documents with terms, terms in all, and for each term of the items the
   documents that hold it, added up in each task first.
2. Search: a task folds a batch of documents into sketches, looks up all items
   at once, and takes each item's documents in descending order of their bounds. It
   scores them exactly until the next bound is below the item's k-th best score
   so far. What a task returns is its k best documents of each item; the best of
   all tasks are the answer.

Items are broadcast in blocks of at most BLOCK bytes of text, one block after another,
whatever the number of items. Everything but the weights is in whole numbers (sketches
and bounds too: sums stay below 2^53).

Defined results: null and empty texts have no terms and never score; rows of a repeated
doc_id are documents of their own; equal scores rank by doc_id, null last; equal item rows
are asked once, items of one id with different texts each; an item without terms, or of
terms that no document holds, has no rows; an empty table gives no rows; other
columns are not read; whole texts of any length are read, a document at a time.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.shared import small_batches, written

#: Coordinates of a sketch; documents folded at a time, and their terms, about; bytes of item text broadcast at a time.
CELLS, FOLDED, HELD, BLOCK = 4096, 256, 1 << 20, 4 << 20
#: A-Z lower-cased; other ASCII but digits and letters separates terms.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = "slot int, doc_id long, score long"
#: Slots of the counts of documents and of terms.
DOCUMENTS, TERMS = -1, -2


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(LOWER).split() if text else []


def counter(vocabulary: dict[bytes, int]) -> Callable:
    """For mapInArrow over (text): (slot, n) of what a task's documents hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = Counter({DOCUMENTS: 0, TERMS: 0}), vocabulary.keys()
        for batch in batches:
            for text in batch.column(0):
                own = terms(text.as_py())
                if own:
                    found[DOCUMENTS] += 1
                    found[TERMS] += len(own)
                    found.update(vocabulary[t] for t in known & set(own))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], ["slot", "n"])

    return count


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - 75 + (75 * n * n_docs) // n_terms


def impact(tf: int, norm: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def cell(term: bytes) -> int:
    return zlib.crc32(term) % CELLS


def folded(counts: list[Counter], norms: list[int]) -> np.ndarray:
    """The sketches of some documents: CELLS x documents, a document's maxima in a column."""
    sizes = [len(c) for c in counts]
    cells = np.fromiter((cell(t) for c in counts for t in c), np.int64, sum(sizes))
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, sum(sizes))
    norm, column = np.repeat(np.array(norms, np.int64), sizes), np.repeat(np.arange(len(counts)), sizes)
    sketch = np.zeros(CELLS * len(counts))
    np.maximum.at(sketch, cells * len(counts) + column, (1_000_000_000 * tf // (1000 * tf + 8 * norm)).astype(np.float64))
    return sketch.reshape(CELLS, len(counts))


class Item:
    """An item's terms with their weights times their repeats, and its k best documents so far."""

    def __init__(self, weighed: dict[bytes, int], k: int):
        self.weighed = [(t, w) for t, w in weighed.items() if w > 0]
        self.cells = np.array([cell(t) for t, _ in self.weighed], np.int64)
        self.weights = np.array([w for _, w in self.weighed], np.float64)
        self.k, self.best = k, []  # a heap of (score, is null, -doc_id), the worst first

    def offer(self, sketch: np.ndarray, counts: list[Counter], norms: list[int], ids: list) -> int:
        """Scores documents by descending bound until no other can come in; how many it scored."""
        if not self.weighed:
            return 0
        bounds = self.weights @ sketch[self.cells]
        near = np.flatnonzero(bounds >= (self.best[0][0] if len(self.best) == self.k else 1))
        order, scored = near[np.argsort(-bounds[near], kind="stable")], 0
        for i in order.tolist():
            if len(self.best) == self.k and bounds[i] < self.best[0][0]:
                break
            own, norm = counts[i], norms[i]
            score = sum(w * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm)) for t, w in self.weighed if (tf := own.get(t)))
            scored += 1
            if score > 0:
                entry = (score, ids[i] is not None, -(ids[i] or 0))
                if len(self.best) < self.k:
                    heappush(self.best, entry)
                elif entry > self.best[0]:
                    heapreplace(self.best, entry)
        return scored


def searcher(items: list[dict[bytes, int]], n_docs: int, n_terms: int, k: int) -> Callable:
    """For mapInArrow over (doc_id, text): the k best documents a task has for each item.
    items: terms with weights times repeats."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [Item(weighed, k) for weighed in items]
        for counts, norms, ids in groups(batches, n_docs, n_terms):
            sketch = folded(counts, norms)
            for item in asked:
                item.offer(sketch, counts, norms, ids)
        flat = [(slot, -i if known else None, score) for slot, item in enumerate(asked) for score, known, i in item.best]
        slots, docs, scores = zip(*flat, strict=True) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], ["slot", "doc_id", "score"])

    return search


def groups(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[tuple[list[Counter], list[int], list]]:
    """Term counts, length norms and ids of FOLDED documents with terms at a time."""
    counts, norms, ids, held = [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = terms(text.as_py())
            if own:
                counts.append(Counter(own))
                norms.append(length_norm(len(own), n_docs, n_terms))
                ids.append(doc_id)
                held += len(counts[-1])
            if len(ids) == FOLDED or held > HELD:
                yield counts, norms, ids
                counts, norms, ids, held = [], [], [], 0
    if ids:
        yield counts, norms, ids


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) rows of at most about BLOCK bytes of text."""
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // BLOCK)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        if rows:
            yield [(r.item_id, bytes(r.text)) for r in rows]


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0
    of each item."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    asking = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    out = None
    for block in item_blocks(asking):
        asked = [Counter(terms(text)) for _, text in block]
        vocabulary = {t: slot for slot, t in enumerate(sorted(set().union(*asked)))}
        counted = rows.select("text").mapInArrow(counter(vocabulary), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        found = dict(counted.collect())  # a number per term of the block
        n_docs, n_terms = found.get(DOCUMENTS, 0), found.get(TERMS, 0)
        weighed = [{t: n * weight(found[vocabulary[t]], n_docs) for t, n in own.items() if vocabulary[t] in found} for own in asked]
        best = rows.mapInArrow(searcher(weighed, n_docs, n_terms, k), FOUND)
        order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(slot, item_id) for slot, (item_id, _) in enumerate(block)], "slot int, item_id long")
        answer = written(best.join(F.broadcast(names), "slot").select("item_id", "rank", "doc_id", "score"), "lexical-found")
        out = answer if out is None else out.unionByName(answer)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
