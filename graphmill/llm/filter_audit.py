"""Filter interaction audit: what each filter of a chain removes, in every order.

Method: failing-id relations. One pass over the texts evaluates the filters; then
only ids move. Every filter has a table of the ids that fail it. A prefix is the set
of filters already applied (what survives doesn't depend on their order), and the
audit walks the prefixes by size. At each size, with `alive` the (prefix, id) rows
that survive so far,

- removals of a filter after a prefix: alive rows left-semi joined to its id table;
- survivors of the prefix and the filter: alive rows left-anti joined to it;
- redundancies: ids of the filter's table left-anti joined to the prefix's alive rows;
- label losses: removals of ids whose labels say so;
- unique failures: removals after all other filters.

Ids that fail nothing survive every prefix: a left-anti join finds them once and they
are only counted. With n filters and u ids that fail some, at most u n 2^(n-1) rows of
a few bytes pass a join, spread by (filter, id), so no part or filter is one task; all
counts are combined map-side. Each size's survivors are a written table, so a lost
executor costs no earlier size. Orders come last: rows of (part, prefix, filter) are
joined to the n! orders' steps, a fixed table.

A repeat is a row whose digest (SHA-256 of the text) a smaller id has. Digests with
over a HOT-th of all rows, fewer than HOT in number, are broadcast; others are joined
by digest, so no group of copies is one task.

Defined results: null texts are empty; null parts are the empty string; rows with a
null id repeat nothing, are not repeated and have no labels; repeated rows (equal
ids) count each, and none of them is a repeat of the other; labels with several rows
for an id: any positive one counts; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.shared import n_words, text_of, written

#: A digest with over one in HOT rows goes by broadcast; there are fewer than HOT.
HOT = 1000
REPEAT = "repeat"
LOST = ["good", "toxic"]


def text_filters(text: Column) -> dict[str, Column | str]:
    """The audited filters by letter: what makes a text fail, or REPEAT."""
    words = n_words(text)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    return {
        "A": words < 200,
        "B": 100 * distinct < 50 * words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": REPEAT,
    }


def row_facts(docs: DataFrame, filters: dict[str, Column | str], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """key (of the row), id, part, digest, fails (names of the filters on the text)."""
    own = [F.when(how, F.lit(name)) for name, how in filters.items() if how is not REPEAT]
    fails = F.filter(F.array(*own), lambda x: x.isNotNull()) if own else F.lit(None).cast("array<string>")
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), part.alias("part"), F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"), fails.alias("fails"))


def repeats(facts: DataFrame) -> DataFrame:
    """(key, part) of the rows whose digest a smaller id has."""
    firsts = facts.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts, "audit-firsts")
    most = -(-facts.count() // HOT)
    rows = facts.where("id IS NOT NULL").select("key", "id", "part", "digest")
    hot = firsts.where(F.col("n") > most)
    by_hot = rows.join(F.broadcast(hot), "digest")
    by_digest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(firsts.where(F.col("n") <= most), "digest")
    return by_hot.unionByName(by_digest).where("id > first").select("key", "part")


def failing_ids(facts: DataFrame, filters: dict[str, Column | str]) -> DataFrame:
    """(filter, key, part): the id tables of the filters, a folder for each."""
    rows = facts.select(F.explode("fails").alias("filter"), "key", "part")
    for name, how in filters.items():
        if how is REPEAT:
            rows = rows.unionByName(repeats(facts).select(F.lit(name).alias("filter"), "key", "part"))
    return written(rows, "audit-fails", "filter")


def with_labels(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """facts with good and toxic, false where no label says so."""
    says = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in LOST]
    known = labels.where("id IS NOT NULL").groupBy("id").agg(*says)
    return facts.join(known, "id", "left").select("key", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in LOST])


def prefixes(n: int, size: int) -> list[int]:
    return [p for p in range(1 << n) if p.bit_count() == size]


def bits(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def walked(facts: DataFrame, fails: DataFrame, labels: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(part, prefix, n): survivors of every prefix among the ids that fail some filter;
    (part, prefix, filter, removed, good_lost, toxic_lost, redundant) of every prefix and filter not in it."""
    n, bit = len(names), {name: 1 << i for i, name in enumerate(names)}
    code = F.create_map(*[F.lit(x) for name in names for x in (name, bit[name])])
    fails = fails.select(code[F.col("filter")].alias("bit"), "key", "part")
    alive = facts.join(fails.select("key").distinct(), "key", "left_semi")
    alive = written(with_labels(alive, labels).select(F.lit(0).alias("prefix"), "key", "part", *LOST), "audit-alive")
    kept, steps = [], []
    for size in range(n + 1):
        kept.append(alive.groupBy("part", "prefix").agg(F.count("*").alias("n")))
        if size == n:
            break
        tried = alive.withColumn("bit", F.explode(F.filter(bits(list(bit.values())), lambda b: F.col("prefix").bitwiseAND(b) == 0)))
        removed = tried.join(fails, ["bit", "key"], "left_semi").groupBy("part", "prefix", "bit").agg(F.count("*").alias("removed"), *[F.count_if(c).alias(f"{c}_lost") for c in LOST])
        known = fails.withColumn("prefix", F.explode(F.filter(bits(prefixes(n, size)), lambda p: p.bitwiseAND(F.col("bit")) == 0)))
        redundant = known.join(alive, ["prefix", "key"], "left_anti").groupBy("part", "prefix", "bit").agg(F.count("*").alias("redundant"))
        steps.append(removed.unionByName(redundant, allowMissingColumns=True))
        # A prefix is reached once: by its highest filter.
        onward = tried.where(F.col("bit") > F.col("prefix")).join(fails, ["bit", "key"], "left_anti")
        alive = written(onward.select((F.col("prefix") + F.col("bit")).alias("prefix"), "key", "part", *LOST), "audit-alive")
    merged = steps[0]
    for more in steps[1:]:
        merged = merged.unionByName(more)
    survivors = kept[0]
    for more in kept[1:]:
        survivors = survivors.unionByName(more)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("removed", "good_lost", "toxic_lost", "redundant")]
    return survivors, merged.groupBy("part", "prefix", "bit").agg(*sums)


def order_steps(names: list[str]) -> list[tuple]:
    """(filter_order, step, prefix, bit) of every order of the filters."""
    bit = {name: 1 << i for i, name in enumerate(names)}
    return [("".join(order), step + 1, sum(bit[x] for x in order[:step]), bit[name]) for order in permutations(names) for step, name in enumerate(order)]


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) for each part, each order of the filters and each step.

    filters: by one-letter name a condition that is true where a row of docs fails, or
    REPEAT. labels: id_col, quality, toxic. shapley: the filter's removals summed over
    all orders."""
    spark = docs.sparkSession
    filters = text_filters(text_of(text_col)) if filters is None else filters
    names, n = list(filters), len(filters)
    facts = written(row_facts(docs, filters, id_col, text_col, part_col), "audit-rows")
    fails = failing_ids(facts, filters)
    said = labels.select(F.col(id_col).alias("id"), F.col("quality").alias("good"), "toxic")
    survivors, steps = walked(facts.select("key", "id", "part"), fails, said, names)
    survivors, steps = written(survivors, "audit-kept"), written(steps, "audit-steps")

    clean = facts.select("key", "part").join(fails.select("key").distinct(), "key", "left_anti").groupBy("part").agg(F.count("*").alias("clean"))
    parts = facts.select("part").distinct().join(clean, "part", "left").select("part", F.coalesce("clean", F.lit(0)).alias("clean"))
    orders = spark.createDataFrame(order_steps(names), "filter_order string, step int, prefix int, bit int")
    grid = parts.withColumn("prefix", F.explode(bits(list(range(1 << n)))))
    grid = grid.withColumn("bit", F.explode(F.filter(bits([1 << i for i in range(n)]), lambda b: F.col("prefix").bitwiseAND(b) == 0)))
    after = survivors.select("part", F.col("prefix").alias("after"), "n")
    grid = grid.withColumn("after", F.col("prefix") + F.col("bit")).join(after, ["part", "after"], "left").join(steps, ["part", "prefix", "bit"], "left")
    counts = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("removed", "redundant", "good_lost", "toxic_lost")}
    grid = grid.select("part", "prefix", "bit", (F.col("clean") + F.coalesce("n", F.lit(0))).alias("kept"), *counts.values())
    full = (1 << n) - 1
    ways = F.create_map(*[F.lit(x) for size in range(n) for x in (size, factorial(size) * factorial(n - 1 - size))])
    alone = F.sum(F.when(F.col("prefix") == full - F.col("bit"), F.col("removed")))
    shares = grid.groupBy("part", "bit").agg(alone.alias("unique_fails"), F.sum(F.col("removed") * ways[F.bit_count("prefix")]).alias("shapley"))
    out = grid.join(shares, ["part", "bit"]).join(F.broadcast(orders), ["prefix", "bit"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

