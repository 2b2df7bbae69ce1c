"""Exact top-k search by inner product, with a three-phase uniform threshold.

A score is a sum over SLICES runs of components, so each slice of a vector has a
score of its own and, for a query, a local score list: in every task, that task's
vectors in the order of the slice's scores. For a block of queries:

1. Gather: every task takes the k best entries of each of its lists, completes their
   scores and returns the k best of these. The k-th best of all tasks is a safe
   cutoff t: k rows reach it.
2. Collect: with t broadcast, a list's entries of t / SLICES or more are sufficient,
   since a row below that in every list sums to less than t. Their upper bounds
   (collected scores, t / SLICES for the others) are held against t.
3. Resolve: what remains gets its exact score, and a task returns its k best rows of
   t or more; the best of all tasks are the answer.

No vector is moved: each phase scans the table, and only k rows per query and task
are shuffled. Queries go in blocks of at most BLOCK bytes, broadcast one after
another, whatever the number of queries; each block's answer is a written table.
Within a task, matrices of at most TILE vectors are scored in numpy, exactly:
in floats where all sums are below 2^24 or 2^53, else in Python integers.

Defined results: vectors that are null or hold a null or non-finite component (once
multiplied) take no part; shorter vectors end in zeros; rows with the query's own id are no candidates, nor
are any others left out (repeated rows count each, equal vectors tie by id); rows
without an id can't be queries and come last among ties; equal query rows are asked
once; scores beyond 64 bits are held at its ends; fewer than k candidates are all
returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.shared import small_batches, written

SLICES = 2
#: Bytes of the queries broadcast at a time (eight a component), and vectors scored at a time.
BLOCK, TILE = 16 << 20, 1024
#: Queries scored at a time.
ASKED = 256
FOUND = "slot int, vec_id long, score long"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, as doubles; null where the vector takes no part."""
    scaled = F.transform(vector, lambda x: x.cast("double") * factor)
    sound = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Doubles of 2^52 or more are whole; floor() would cut them to 64 bits.
    floors = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return F.when(F.coalesce(sound, F.lit(False)), floors)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of width places, zeros where they are shorter."""
    sizes = np.asarray(vectors.value_lengths())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = places < width  # beyond it the queries hold zeros
    out[rows[inside], places[inside]] = values[inside]
    return out


def exact(asked: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the smallest numbers that hold every sum of their products."""
    most = float(np.abs(asked).max(initial=0)) * float(np.abs(told).max(initial=0)) * max(1, asked.shape[1])
    if most < 1 << 24:
        return asked.astype(np.float32), told.astype(np.float32)
    if most < 1 << 53:
        return asked, told
    return tuple(np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (asked, told))


def cuts(width: int) -> list[slice]:
    edges = [width * i // SLICES for i in range(SLICES + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a] or [slice(0, 0)]


class Best:
    """The k best rows of each query so far, as (-score, id is null, id)."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]

    def add(self, slot: int, scores: list, nulls: list, ids: list) -> None:
        own = self.rows[slot] + [(-min(MOST, max(LEAST, s)), null, i) for s, null, i in zip(scores, nulls, ids, strict=True)]
        own.sort()
        self.rows[slot] = own[: self.k]

    def batch(self) -> pa.RecordBatch:
        flat = [(slot, None if null else i, -s) for slot, rows in enumerate(self.rows) for s, null, i in rows]
        slots, ids, scores = zip(*flat, strict=True) if flat else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["slot", "vec_id", "score"])


def tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whether they are null, vectors) of at most TILE rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            ids, vectors = batch.slice(at, TILE).columns
            yield ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), matrix(vectors, width)


def partial_scores(asked: np.ndarray, told: np.ndarray) -> np.ndarray:
    """slices x queries x vectors, in 64-bit or Python integers."""
    asked, told = exact(asked, told)
    parts = np.stack([asked[:, c] @ told[:, c].T for c in cuts(asked.shape[1])])
    return parts if parts.dtype == object else parts.astype(np.int64)


def leaders(parts: np.ndarray, k: int) -> np.ndarray:
    """queries x vectors: what is among the k best of some list. Ties may leave out any."""
    n = parts.shape[2]
    if n <= k:
        return np.ones(parts.shape[1:], bool)
    chosen = np.zeros(parts.shape[1:], bool)
    for scores in parts:
        best = np.argsort(scores, axis=1)[:, -k:] if scores.dtype == object else np.argpartition(scores, n - k, axis=1)[:, -k:]
        np.put_along_axis(chosen, best, True, axis=1)
    return chosen


def sufficient(parts: np.ndarray, cutoff: np.ndarray, free: np.ndarray) -> np.ndarray:
    """queries x vectors: in some list at the uniform threshold, and with an upper bound
    that reaches the cutoff (the other lists' entries are below the threshold and not above
    their list's first). free: queries without a cutoff, which take all. Both sides are
    times the number of lists, to stay whole."""
    m, cut = len(parts), cutoff[:, None]
    collected = parts * m >= cut
    first = np.minimum(parts.max(axis=2, keepdims=True, initial=LEAST // 8) * m, cut)
    bound = np.where(collected, parts * m, first).sum(axis=0)
    return free[:, None] | collected.any(axis=0) & (bound >= cut * m)


def searcher(ids: list, asked: np.ndarray, k: int, cutoff: list | None) -> Callable:
    """For mapInArrow over (vec_id, vector): the k best rows a task has for each query,
    by the leaders of its lists, or by what is sufficient for the cutoffs."""
    own = np.array(ids, np.int64)
    if cutoff is not None:
        free = np.array([c is None or c == LEAST for c in cutoff], bool)
        whole_cut = np.array([LEAST if none else c for none, c in zip(free, cutoff, strict=True)], object)
        # Sums in 64 bits stay far below this bound, which holds the rest of a cutoff.
        small_cut = np.clip(whole_cut, -(1 << 58), 1 << 58).astype(np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(own), k)
        for rows, nulls, told in tiles(batches, asked.shape[1]):
            for at in range(0, len(own), ASKED):
                some = slice(at, at + ASKED)
                parts = partial_scores(asked[some], told)
                if cutoff is None:  # its own row may be in a query's lists, so one more is taken
                    chosen = leaders(parts, k + 1)
                else:
                    cut = (whole_cut if parts.dtype == object else small_cut)[some]
                    chosen = sufficient(parts, cut, free[some])
                slots, places = np.nonzero(chosen & (nulls | (own[some, None] != rows)))
                totals = parts[:, slots, places].sum(axis=0)
                if cutoff is not None:
                    enough = free[some][slots] | (totals >= cut[slots]).astype(bool)
                    slots, places, totals = slots[enough], places[enough], totals[enough]
                bounds = np.searchsorted(slots, np.arange(parts.shape[1] + 1))
                for slot in np.flatnonzero(np.diff(bounds)).tolist():
                    here = slice(bounds[slot], bounds[slot + 1])
                    best.add(at + slot, totals[here].tolist(), nulls[places[here]].tolist(), rows[places[here]].tolist())
        yield best.batch()

    return search


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each slot with rank, of the k best of every task."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of at most about BLOCK bytes each."""
    rows, width = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    blocks = -(-rows * max(1, width) * 8 // BLOCK)
    for block in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)) == block).orderBy("query_id", "vector").toArrow().combine_chunks()
        if got.num_rows:
            yield got.column("query_id").to_pylist(), matrix(got.column("vector").chunk(0), width)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of queries (same columns), the k rows
    of vectors with other ids whose inner products of whole components are highest."""
    spark = vectors.sparkSession
    small_batches(spark)
    told = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col), factor).alias("vector")).where("vector IS NOT NULL")
    asking = queries.select(F.col(id_col).cast("long").alias("query_id"), whole(F.col(vector_col), factor).alias("vector")).where("query_id IS NOT NULL AND vector IS NOT NULL").distinct()
    out = None
    for ids, asked in query_blocks(written(asking, "topk-queries")):
        gathered = best_of(told.mapInArrow(searcher(ids, asked, k, None), FOUND), k).where(F.col("rank") == k)
        cutoff = dict(gathered.select("slot", "score").collect())  # a number per query of the block
        collected = told.mapInArrow(searcher(ids, asked, k, [cutoff.get(i) for i in range(len(ids))]), FOUND)
        names = spark.createDataFrame(list(enumerate(ids)), "slot int, query_id long")
        block = written(best_of(collected, k).join(F.broadcast(names), "slot").select("query_id", "rank", "vec_id", "score"), "topk-found")
        out = block if out is None else out.unionByName(block)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out
