"""Toxicity by class-conditional Kneser-Ney models.

Two character n-gram models, one of toxic and one of ordinary text, read the
words of a document. Only the counts of the longest n-grams are a class's own;
what either class has not seen falls back on Kneser-Ney continuation counts
shared by both, so rare expressions weigh alike in both and cancel. A word's
log-likelihood ratio is the sum over its characters; a document's statistics
are its length-normalised ratios: over all words, and the largest over any
window of WINDOW words and any single word. A logistic curve fitted on
labelled rows that the language models have not seen turns them into a score.

Class counts come from bounded samples of labelled rows, chosen by hash: at most
max_rows rows of each class for the counts, and as many for the curve; all their
n-grams count. The shared continuation counts come from all documents and grow
with them: one scan counts words (a task sends a word once per HELD words), the
n-grams of the distinct words are counted by Spark, and only the counts that the
class models' own n-grams fall back on, as many as these at most, leave for the
driver. The finished model, which is broadcast, holds 12 bytes for each n-gram
and each context of the samples. Scoring reads every whole text of the table and
works out the words of one Arrow batch at a time.

Fitting and scoring never read lang, source or the held-out labels
(crc32(doc_id) mod 4 = 2). Defined results: null or wordless text has
statistics 0 and so the score of neutral text; without labels of both classes
every score is 0.0; null doc_ids are scored and not held out; repeated rows get
equal scores, count as often as they occur for the language models and once (the
least text of an id) for the curve; a label row that is null in any column is not
used. score() replaces a column named as its output.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.shared import small_batches, text_of, written

ORDER = 6
WINDOW = 5
DISCOUNT = 0.75
START, END = "^", "$"
ASCII_WORDS, LETTERS = re.compile(r"[a-z]+"), regex.compile(r"\p{L}+")
#: Words whose ratio a task remembers at once, and words a task counts before it sends them on.
REMEMBERED, HELD = 100_000, 100_000
#: Words whose n-grams a worker holds at once.
LEARNED = 10_000


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; fitting and scoring both take these."""
    text = text.lower()
    return (ASCII_WORDS if text.isascii() else LETTERS).findall(text)


def grams_of(word: str) -> list[str]:
    """Each character of a word with up to ORDER - 1 before it."""
    padded = START + word + END
    return [padded[max(0, end - ORDER) : end] for end in range(2, len(padded) + 1)]


def hashes_of(grams: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass")) for g in grams), np.uint64, len(grams))


class Table:
    """n-gram -> number, as sorted 64-bit hashes of the n-grams."""

    def __init__(self, numbers: dict[str, float]):
        keys = hashes_of(list(numbers))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(numbers.values(), np.float32, len(numbers))[order]

    def __len__(self) -> int:
        return len(self.keys)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Table) and np.array_equal(self.keys, other.keys) and np.array_equal(self.values, other.values)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hash: its number (0 where there is none), and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(self.keys.searchsorted(keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return np.where(there, self.values[at], 0.0).astype(np.float64), there


@dataclass(frozen=True)
class Model:
    """seen: n-gram -> log ratio; unseen: context -> log ratio of the weights
    given to the shared counts; the curve's mean, scale, weights and bias."""

    seen: Table
    unseen: Table
    centre: tuple[float, ...] = (0.0, 0.0, 0.0)
    scale: tuple[float, ...] = (1.0, 1.0, 1.0)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    bias: float = -math.inf


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4 (null: -1)."""
    return F.coalesce((F.crc32(id_col.cast("string").cast("binary")) % 4).cast("int"), F.lit(-1))


def chosen(labels: DataFrame, folds: tuple[int, ...], max_rows: int, label_col: str) -> DataFrame:
    """(doc_id, toxic) of at most max_rows labelled documents of each class."""
    usable = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    usable = usable.where(F.col("toxic").isin(0, 1) & fold(F.col("doc_id")).isin(*folds)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64(F.lit("toxicity"), "doc_id"), F.col("doc_id"))
    picked = [usable.where(F.col("toxic") == c).orderBy(*order).limit(max_rows) for c in (0, 1)]
    return picked[0].unionByName(picked[1])


COUNTED = "word string, ordinary long, toxic long"


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (toxic, text) -> words and how often rows of each class have
    them (rows without a class count as neither), before more than HELD are held."""
    counts = Counter(), Counter(), set()

    def flushed() -> Iterator[pa.RecordBatch]:
        words = list(counts[2].union(counts[0], counts[1]))
        for at in range(0, len(words), 1 << 16):
            part = words[at : at + (1 << 16)]
            both = [pa.array([counts[c][w] for w in part], pa.int64()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *both], ["word", "ordinary", "toxic"])
        for c in counts:
            c.clear()

    for batch in batches:
        for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[2 if c is None else c].update(words_of(text))
            if sum(map(len, counts)) > HELD:
                yield from flushed()
    yield from flushed()


def word_counts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(word, ordinary, toxic) of every word in docs (doc_id, text)."""
    rows = docs.join(F.broadcast(labelled), "doc_id", "left").select("toxic", text_of("text").alias("text"))  # 2 * max_rows labels at most
    counts = rows.mapInArrow(counted_words, COUNTED).groupBy("word")
    return written(counts.agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "toxicity-words")


def padded() -> Column:
    return F.concat(F.lit(START), "word", F.lit(END))


def grams_in(words: DataFrame) -> DataFrame:
    """words with gram: one row for each character of each word and what stands before it."""
    ends = F.sequence(F.lit(2), F.char_length(padded()))
    gram = F.transform(ends, lambda e: F.substring(padded(), F.greatest(e - (ORDER - 1), F.lit(1)), F.least(e, F.lit(ORDER))))
    return words.withColumn("gram", F.explode(gram))


def class_counts(words: DataFrame) -> DataFrame:
    """(gram, ordinary, toxic) of all n-grams of the labelled rows' words."""
    grams = grams_in(words.where("ordinary + toxic > 0"))
    return grams.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def continuations(words: DataFrame, needed: DataFrame) -> DataFrame:
    """(gram, kinds) over all words: of the n-grams whose context is in needed
    (context), how many different characters stand before them."""
    longest = grams_in(words).select("gram").distinct()
    lengths = F.sequence(F.lit(2), F.char_length("gram"))
    runs = longest.select(F.explode(F.transform(lengths, lambda n: F.substring("gram", -n, n))).alias("run"))
    runs = runs.withColumn("gram", F.substring("run", 2, ORDER))
    runs = runs.withColumn("context", F.expr("left(gram, char_length(gram) - 1)"))
    runs = runs.join(F.broadcast(needed), "context", "left_semi")  # contexts of the samples' n-grams
    return runs.select("run", "gram").distinct().groupBy("gram").agg(F.count("*").alias("kinds"))


class Shared:
    """The shared model: p(last character | those before) by continuation counts."""

    def __init__(self, kinds: dict[str, int], contexts: dict[str, tuple[int, int]]):
        """kinds: n-gram -> continuation count; contexts: context -> sum and number of these."""
        self.kinds, self.contexts = kinds, contexts
        self.known = {"": 1.0 / (contexts.get("", (0, 0))[1] + 1)}

    def __call__(self, gram: str) -> float:
        if gram not in self.known:
            lower, (n, spread) = self(gram[1:]), self.contexts.get(gram[:-1], (0, 0))
            self.known[gram] = lower if not n else (max(self.kinds.get(gram, 0) - DISCOUNT, 0.0) + DISCOUNT * spread * lower) / n
        return self.known[gram]


def ratio_tables(counts: dict[str, tuple[int, int]], shared: Shared) -> tuple[dict[str, float], dict[str, float]]:
    """(seen, unseen) of a Model from n-gram counts (ordinary, toxic)."""
    held: tuple[dict[str, int], dict[str, int]] = ({}, {})
    variety: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for gram, pair in counts.items():
        for c in (0, 1):
            if pair[c]:
                held[c][gram[:-1]] = held[c].get(gram[:-1], 0) + pair[c]
                variety[c][gram[:-1]] = variety[c].get(gram[:-1], 0) + 1

    def weight(c: int, context: str) -> float:
        return DISCOUNT * variety[c][context] / held[c][context] if context in held[c] else 1.0

    seen = {}
    for gram, pair in counts.items():
        context, lower = gram[:-1], shared(gram[1:])
        p = [max(pair[c] - DISCOUNT, 0.0) / held[c].get(context, 1) + weight(c, context) * lower for c in (0, 1)]
        seen[gram] = math.log(p[1] / p[0])
    unseen = {h: math.log(weight(1, h) / weight(0, h)) for h in held[0].keys() | held[1].keys()}
    return seen, unseen


class WordRatios(dict):
    """word -> log-likelihood ratio (toxic over ordinary)."""

    def __init__(self, model: Model):
        super().__init__()
        self.seen, self.unseen = model.seen, model.unseen

    def learn(self, words: Iterable[str]) -> None:
        """Works out the ratios of words not yet known, LEARNED at once."""
        new = [w for w in words if w not in self]
        for at in range(0, len(new), LEARNED):
            self.add(new[at : at + LEARNED])

    def add(self, new: list[str]) -> None:
        grams = [grams_of(w) for w in new]
        flat = [g for gs in grams for g in gs]
        ratio, there = self.seen.find(hashes_of(flat))
        rest = np.flatnonzero(~there)
        ratio[rest] = self.unseen.find(hashes_of([flat[i][:-1] for i in rest]))[0]
        cuts = np.cumsum([0, *map(len, grams[:-1])])
        self.update(zip(new, np.add.reduceat(ratio, cuts).tolist(), strict=True))


def statistics(values: np.ndarray) -> tuple[float, float, float]:
    """Length-normalised ratios of all words, of the most toxic window, and of
    the most toxic word, from the words' ratios."""
    if not len(values):
        return 0.0, 0.0, 0.0
    sums = np.concatenate(([0.0], np.cumsum(values)))
    width = min(WINDOW, len(values))
    return values.mean(), (sums[width:] - sums[:-width]).max() / width, values.max()


def statistics_of(texts: list[str | None], ratios: WordRatios) -> np.ndarray:
    if len(ratios) > REMEMBERED:
        ratios.clear()
    words = [words_of(t or "") for t in texts]
    ratios.learn(set().union(*words))
    return np.array([statistics(np.fromiter(map(ratios.__getitem__, w), np.float64, len(w))) for w in words]).reshape(-1, 3)


def fitted_curve(features: np.ndarray, labels: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> dict:
    """Logistic regression by Newton steps."""
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([(features - centre) / scale, np.ones(len(features))])
    beta, pull = np.zeros(x.shape[1]), ridge * np.diag([1.0] * features.shape[1] + [0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - labels) + pull @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull + 1e-9 * np.eye(len(beta)), grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return {"centre": tuple(centre.tolist()), "scale": tuple(scale.tolist()), "weights": tuple(beta[:-1].tolist()), "bias": float(beta[-1])}


def score_of(model: Model, stats: np.ndarray) -> np.ndarray:
    """Scores in [0, 1] of rows of statistics."""
    if model.bias == -math.inf:
        return np.zeros(len(stats))
    z = ((stats - np.array(model.centre)) / np.array(model.scale)) @ np.array(model.weights) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def columns_of(df: DataFrame, *names: str) -> list[list]:
    table = df.select(*names).toArrow()
    return [table.column(c).to_pylist() for c in names]


def shared_model(spark: SparkSession, words: DataFrame, counts: dict[str, tuple[int, int]]) -> Shared:
    """The shared model over all words, as far as the n-grams in counts fall back on it."""
    suffixes = {gram[i:] for gram in counts for i in range(1, len(gram))}
    needed = spark.createDataFrame(pa.table({"context": pa.array(list({s[:-1] for s in suffixes}), pa.string())}))
    kinds = written(continuations(words, needed), "toxicity-kinds")
    wanted = spark.createDataFrame(pa.table({"gram": pa.array(list(suffixes), pa.string())}))
    own = columns_of(kinds.join(F.broadcast(wanted), "gram", "left_semi"), "gram", "kinds")
    context = F.expr("left(gram, char_length(gram) - 1)").alias("context")
    totals = kinds.groupBy(context).agg(F.sum("kinds").alias("n"), F.count("*").alias("spread"))
    contexts = columns_of(totals, "context", "n", "spread")
    return Shared(dict(zip(*own, strict=True)), {h: (n, k) for h, n, k in zip(*contexts, strict=True)})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 4000,
) -> Model:
    """Language models from folds 0 and 3, the score's curve from fold 1."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col))
    words = word_counts(docs, chosen(labels, (0, 3), max_rows, label_col))
    found = columns_of(class_counts(words), "gram", "ordinary", "toxic")  # n-grams of the samples
    counts = {g: (o, t) for g, o, t in zip(*found, strict=True)}
    if not all(any(pair[c] for pair in counts.values()) for c in (0, 1)):
        return Model(Table({}), Table({}))
    model = Model(*map(Table, ratio_tables(counts, shared_model(spark, words, counts))))
    del counts
    shared = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = WordRatios(shared.value)
        for batch in batches:
            stats = statistics_of(batch.column("text").to_pylist(), ratios)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(stats[:, j]) for j in range(3))], ["toxic", "a", "b", "c"])

    rows = docs.join(F.broadcast(chosen(labels, (1,), max_rows, label_col)), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")
    rows = rows.mapInArrow(measured, "toxic int, a double, b double, c double").toArrow()
    shape = np.column_stack([rows.column(c).to_numpy() for c in "abc"]) if rows.num_rows else np.zeros((0, 3))
    y = rows.column("toxic").to_numpy()
    if len(set(y.tolist())) < 2:
        return model
    # The sample holds the classes in other shares than the labels do.
    found = dict(labels.where(fold(F.col("doc_id")) == 1).groupBy(F.col(label_col).cast("int").alias("c")).count().where("c IN (0, 1)").collect())
    curve = fitted_curve(shape, y)
    odds = math.log(found[1] / found[0]) - math.log((y == 1).sum() / (y == 0).sum())
    return Model(model.seen, model.unseen, **(curve | {"bias": curve["bias"] + odds}))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """docs with a score column; every row and every whole text is scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ratios = WordRatios(shared.value)
        for batch in batches:
            yield pa.array(score_of(shared.value, statistics_of(batch.to_pylist(), ratios)))

    small_batches(docs.sparkSession)
    return docs.withColumn(out_col, scored(text_of(text_col)))
