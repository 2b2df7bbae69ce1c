"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Fingerprints of 64 bits come from the XXH64 of all word shingles. Exact copies
share a fingerprint and are collapsed by a map-side combined aggregation, so
the search works on distinct fingerprints only. Two fingerprints that differ in
at most `distance` bits agree on one of distance + 1 bit blocks; each distinct
fingerprint goes to one bucket per block. A bucket over BUCKET rows is dealt out
again by the bits it doesn't share yet: what remains of the blocks is cut again
into distance + 1 blocks, to which the same argument applies, and so on while
buckets are too large and the cuts (a fixed table) have no more than CUTS rows.

Whole buckets of the same block make groups of about GROUP rows, each with one index.
In it the fingerprints stand in the Gray order of their bits, those of the block on
top, in which neighbours differ in few bits. An index node covers a run of them and
holds the bits that all of them share (mask and pattern); a node's own mask is what its
parent hasn't factored out. Every fingerprint is searched from the root: differences
add up on the way down, and a whole node is dropped once they exceed the distance
(one in the block's bits does so alone: such pairs meet in another block's index),
linked at once if even its unshared bits can't exceed it, and dropped if its members
are all connected to the query already. Links come out as a spanning forest, at most
one row per member, never all pairs.

The links' connected components come from repeated large-star and small-star
steps over rows of links, written to the shared folder after each round; only
counts reach the driver.

near_copies() groups texts whose sets of word shingles have a Jaccard similarity
of at least `similarity`. Its candidates are the components of fingerprints of
the texts' distinct words, which move by few bits when few words change; links
are then confirmed by exact Jaccard of the shingle sets, within a component. A
component's texts are not all compared to one another: a share of them, the
pivots, is compared to all, in rounds with more pivots each, until the texts that
were no pivots are known to be connected to one another.

Defined results: null or wordless text has fingerprint 0, linked like any
other; a null doc_id is a row of its own whose component is the smallest non-null
doc_id reachable (null if there is none); repeated rows get equal results; ties
in the smallest doc_id don't matter; an empty table gives an empty result. Of
near copies the row with the smallest id stays (null last, then by a hash of the
text; of repeated rows, one); wordless texts are copies of one another. Only
the named columns are read; others pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.shared import small_batches, text_of, written

BITS = 64
SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Members of a bucket above which it is dealt out again, and the most rows of the table of cuts.
BUCKET, CUTS = 8192, 5000
#: Rows of the buckets that share an index, about.
GROUP = 32_768
LEAF, FANOUT = 16, 8
#: Of near_copies(): shingle, similarity, differing bits of the fingerprints of words.
NEAR_SHINGLE, SIMILARITY, NEAR_DISTANCE = 5, 0.8, 7
#: Pivots of a component in the first round, and how many times more in each next one.
PIVOTS, MORE = 32, 8
#: Members of a component that are compared to its pivots in one task, about.
SPLIT = 1000
#: (query, node) pairs that a search looks at in one step; the next level has up to LEAF times as many.
FRONT = 1 << 14
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14


def simhash_of(features: list[bytes]) -> int:
    """A bit is 1 if it is set in over half of the features' hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(features), BLOCK):
        h = np.array([xxhash.xxh64_intdigest(f, SEED) for f in features[at : at + BLOCK]], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(features), bitorder="little").view("<u8")[0])


def shingles_of(words: list[bytes], width: int) -> list[bytes]:
    """Runs of width words, repeats included; of fewer words, the whole sequence."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    return [joined[i:j] for i, j in zip(first, last, strict=True)]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only, ASCII white space only


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text in UTF-8; every repeated shingle counts."""
    words = words_of(text)
    return simhash_of(shingles_of(words, shingle)) if words else 0


def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        values = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64)
        yield pa.array(values.view(np.int64))


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out_col, F.arrow_udf(fingerprints, "long")(text_of(text_col).cast("binary")))


def blocks_of(bits: list[int], n: int) -> list[list[int]]:
    """bits in n nearly equal runs."""
    cuts = [round(i * len(bits) / n) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def mask_of(bits: list[int]) -> int:
    """A signed 64-bit mask."""
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def bits_on_top(codes: np.ndarray, mask: int) -> np.ndarray:
    """codes with their bits in another order, those of mask on top; distances stay."""
    order = sorted(range(BITS), key=lambda bit: (mask >> bit & 1, bit))
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="little")).view("<u8").ravel()


class GrayIndex:
    """A static tree over distinct fingerprints in the Gray order of their bits,
    those of fixed on top.

    levels[0] are leaves of LEAF members; above, FANOUT nodes make one. Of each
    node: the bits all members share, their pattern, and of these bits the ones
    its parent doesn't share (own).
    """

    def __init__(self, codes: np.ndarray, fixed: int = 0):
        turned = bits_on_top(codes, fixed)
        order = np.argsort(gray_rank(turned), kind="stable")
        self.fingerprints, self.codes = codes[order], turned[order]
        n = fixed.bit_count()
        self.fixed = np.uint64((1 << BITS) - (1 << (BITS - n)))
        ones, both = self.codes.copy(), self.codes.copy()
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        size = LEAF
        while True:
            cuts = np.arange(0, len(ones), size)
            ones, both = np.bitwise_or.reduceat(ones, cuts), np.bitwise_and.reduceat(both, cuts)
            self.levels.append((~(ones ^ both), both))
            if len(cuts) == 1:
                break
            size = FANOUT
        self.own = []
        for level, (shared, _) in enumerate(self.levels):
            if level + 1 < len(self.levels):
                above = self.levels[level + 1][0][np.arange(len(shared)) // FANOUT]
                self.own.append(shared & ~above)
            else:
                self.own.append(shared)

    def members(self, level: int) -> int:
        return LEAF * FANOUT**level

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Bits set in x; one among the fixed bits outweighs any distance."""
        return popcount(x) + np.where(x & self.fixed, np.int16(BITS), np.int16(0))


class Forest:
    """Union-find by array; find() resolves all at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def flatten(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return self.root
            self.root = up

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, pairs: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that connected something new."""
        roots, kept = np.sort(self.flatten()[pairs], axis=1), []
        pairs = pairs[np.unique(roots[:, 0] * len(self.root) + roots[:, 1], return_index=True)[1]]
        for a, b in pairs.tolist():
            x, y = self.find(a), self.find(b)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                kept.append((a, b))
        return kept


def same_root(roots: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Of each run: the root that all its members have, else -1."""
    low, high = np.minimum.reduceat(roots, cuts), np.maximum.reduceat(roots, cuts)
    return np.where(low == high, low, -1)


def index_links(codes: np.ndarray, distance: int = DISTANCE, fixed: int = 0) -> tuple[np.ndarray, list[int]]:
    """A spanning forest of the links among distinct codes that agree in the bits of
    fixed, as rows of two codes (links between codes that differ there may be among
    them), and how many nodes each level, leaves first, dropped with all their members.

    Every code is sent down the tree from its root. The front of (query, node) pairs is
    taken depth first in pieces, so that memory stays bounded, and links are joined
    into the forest as they are found: nodes whose members are all connected to the
    query already are dropped like those that differ too much. A node whose members
    must all match is linked by its first one (its members agree in the fixed bits and
    are linked to one another further down).
    """
    index = GrayIndex(codes, fixed)
    codes, n, top = index.codes, len(codes), len(index.levels) - 1
    forest, kept, dropped = Forest(n), [], [0] * (top + 1)
    for apart in range(1, min(LEAF, n)):  # neighbours in Gray order first
        near = np.flatnonzero(popcount(codes[apart:] ^ codes[:-apart]) <= distance)
        kept += forest.join(np.stack([near, near + apart], 1))
    front = [(top, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int16))]
    while front:
        level, queries, nodes, sums = front.pop()
        if len(queries) > FRONT:
            half = len(queries) // 2
            front += [(level, queries[half:], nodes[half:], sums[half:]), (level, queries[:half], nodes[:half], sums[:half])]
            continue
        roots = forest.flatten()
        if level < 0:
            near = (nodes > queries) & (roots[nodes] != roots[queries])
            queries, nodes = queries[near], nodes[near]
            near = index.differences(codes[queries] ^ codes[nodes]) <= distance
            kept += forest.join(np.stack([queries[near], nodes[near]], 1))
            continue
        shared, pattern = index.levels[level]
        width = index.members(level)
        sums = sums + index.differences((codes[queries] ^ pattern[nodes]) & index.own[level][nodes])
        ends = np.minimum((nodes + 1) * width, n)
        one = same_root(roots, np.arange(0, n, width))[nodes]
        open_ = (sums <= distance) & (ends - 1 > queries) & (one != roots[queries])
        dropped[level] += len(queries) - int(open_.sum())
        queries, nodes, sums = queries[open_], nodes[open_], sums[open_]
        whole = (sums + index.differences(~shared[nodes]) <= distance) & (nodes * width > queries)
        kept += forest.join(np.stack([queries[whole], nodes[whole] * width], 1))
        queries, nodes, sums = queries[~whole], nodes[~whole], sums[~whole]
        step = FANOUT if level else LEAF
        last = len(index.levels[level - 1][0]) if level else n
        queries, sums = np.repeat(queries, step), np.repeat(sums, step)
        nodes = (nodes[:, None] * step + np.arange(step)).ravel()
        inside = nodes < last
        if inside.any():
            front.append((level - 1, queries[inside], nodes[inside], sums[inside]))
    return index.fingerprints[np.array(kept, np.int64).reshape(-1, 2)], dropped


def links_of_group(distance: int):
    """For applyInPandas: a forest of the links among the buckets of one mask that a
    group holds (columns used, fp), through one index."""

    def links(pdf):
        import pandas as pd

        fixed = unsigned(int(pdf["used"].iloc[0]))
        pairs, _ = index_links(np.unique(pdf["fp"].to_numpy().view(np.uint64)), distance, fixed)
        pairs = pairs.view(np.int64)
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    return links


def cuts_of(used: int, distance: int) -> list[int]:
    """The masks that the bits not yet used are cut into."""
    return [mask_of(block) for block in blocks_of([b for b in range(BITS) if not used >> b & 1], distance + 1)]


def bucketed(prints: DataFrame, distance: int) -> DataFrame:
    """(bucket, used, fp): every pair within the distance shares a bucket of at most
    BUCKET rows, or one whose members share the bits of all levels of cuts; used is the
    mask of the bits that a bucket's members share."""
    spark = prints.sparkSession
    open_ = prints.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("used"), "fp")
    done, uses = [], [0]
    while True:
        cuts = [(used, mask) for used in uses for mask in cuts_of(used, distance)]
        if done:
            cut = open_.join(F.broadcast(spark.createDataFrame(cuts, "used long, mask long")), "used")  # CUTS rows at most
        else:
            cut = open_.withColumn("mask", F.explode(F.array(*[F.lit(mask) for _, mask in cuts])))
        dealt = cut.select(F.xxhash64("bucket", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), F.col("used").bitwiseOR(F.col("mask")).alias("used"), "fp")
        uses = sorted({used | mask for used, mask in cuts})
        if len(uses) * (distance + 1) > CUTS or BITS - max(map(int.bit_count, map(unsigned, uses))) < 2 * (distance + 1):
            done.append(dealt)
            break
        dealt = written(dealt, "simhash-dealt") if done else dealt
        large = written(dealt.groupBy("bucket").count().where(F.col("count") > BUCKET).select("bucket"), "simhash-large")
        if large.isEmpty():
            done.append(dealt)
            break
        done.append(dealt.join(large, "bucket", "left_anti"))
        open_ = dealt.join(large, "bucket", "left_semi")
    out = done[0].select("bucket", "used", "fp")
    for more in done[1:]:
        out = out.unionByName(more.select("bucket", "used", "fp"))
    return out


def unsigned(mask: int) -> int:
    return mask & ((1 << BITS) - 1)


def grouped(prints: DataFrame, distance: int) -> DataFrame:
    """(group, used, fp): whole buckets of one mask, about GROUP rows a group."""
    groups = max(1, prints.count() // GROUP)
    return bucketed(prints, distance).select(F.pmod("bucket", F.lit(groups)).alias("group"), "used", "fp")


def linked(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, root) of the distinct fingerprints that have a link."""
    links = grouped(prints, distance).groupBy("used", "group").applyInPandas(links_of_group(distance), "a long, b long")
    return components(links).select(F.col("node").alias("fp"), "root")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable by links (a, b), for every node
    that has a link.

    Large-star and small-star rounds until nothing changes; a star's centre is
    a key of map-side combined minimums and of skew-split joins only.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        large = written(large, "large-star")
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select("b", "a", "low")
        to_low = small.where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
        stars = written(small.select(F.col("low").alias("a"), "b").unionByName(to_low).distinct(), "small-star")
        # A forest of stars: every b has one a, and no a is a b.
        inner = stars.select(F.col("b").alias("a")).join(stars.select("a").distinct(), "a", "left_semi")
        if inner.isEmpty() and stars.count() == stars.select("b").distinct().count():
            roots = stars.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return stars.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
        edges = stars


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: id_col, fp, component_id."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = written(with_fingerprint(ids).select("id", "fp"), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = written(linked(distinct.select("fp"), distance), "simhash-roots")
    # Fingerprints that stand alone never meet this join's other side.
    joined = distinct.join(roots, "fp")
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(lowest, "root").select("fp", "component_id")
    alone = distinct.join(roots.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    return spread_back(prints, written(named.unionByName(alone), "simhash-classes")).select(F.col("id").alias(id_col), "fp", "component_id")


PRINTS = "fp long, same binary"


def word_prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of each text: the SimHash of its distinct words, and a hash of the words in order."""
    for texts in batches:
        words = [words_of(t) for t in texts.to_pylist()]
        fps = np.array([simhash_of(list(set(w))) if w else 0 for w in words], np.uint64).view(np.int64)
        same = pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary())
        yield pa.StructArray.from_arrays([pa.array(fps), same], ["fp", "same"])


def shingle_sets(width: int):
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = (shingles_of(words_of(t), width) if t.strip() else [] for t in texts.to_pylist())
            hashes = [np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in f], np.uint64)).view(np.int64) for f in found]
            yield pa.array(hashes, pa.list_(pa.int64()))

    return sets


def confirmed(members: DataFrame, similarity: float) -> DataFrame:
    """(member, label) of members (group, member, grams): equal labels where a
    chain of exact similarities of at least `similarity` connects two members of a
    group."""
    members = written(members, "near-members")
    state = members.select("group", "member", F.col("member").alias("label"), F.lit(False).alias("ran"))
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("splits"))
    pivots = PIVOTS
    while True:
        # Open: members that were no pivots, outside the label that most of those have.
        classes = state.where("NOT ran").groupBy("group", "label").count()
        open_ = classes.groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.sum("count").alias("n"), F.max("count").alias("top"))
        open_ = written(open_.where("n > top").join(sizes, "group"), "near-open")
        if open_.isEmpty():
            return state.select("member", "label")
        candidates = state.join(open_, "group").where("NOT ran AND (top = 1 OR label <> most)")
        left = F.when(F.col("top") == 1, F.col("n")).otherwise(F.col("n") - F.col("top"))
        share = F.pmod(F.xxhash64("member", F.lit(pivots)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        chosen = written(candidates.where((left <= pivots) | (share < pivots / left)).select("member"), "near-pivots")
        rows = members.join(open_.select("group", "splits"), "group")
        spread = rows.join(chosen, "member", "left_semi").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
        spread = spread.select("group", "split", F.col("member").alias("pivot"), F.col("grams").alias("pivot_grams"))
        rows = rows.select("group", F.pmod(F.hash("member"), "splits").alias("split"), "member", "grams")
        n, m, both = F.size("grams"), F.size("pivot_grams"), F.size(F.array_intersect("grams", "pivot_grams"))
        pairs = rows.join(spread, ["group", "split"]).where((F.col("member") != F.col("pivot")) & (F.least(n, m) >= similarity * F.greatest(n, m)))
        pairs = pairs.where(both >= similarity * (n + m - both)).select("member", "pivot")
        names = state.select("member", "label")
        edges = pairs.join(names, "member").select("pivot", F.col("label").alias("a")).distinct()
        edges = edges.join(names.select(F.col("member").alias("pivot"), F.col("label").alias("b")), "pivot").select("a", "b")
        roots = components(edges).select(F.col("node").alias("label"), "root")
        state = state.join(roots, "label", "left").join(chosen.select("member", F.lit(True).alias("now")), "member", "left")
        state = state.select("group", "member", F.coalesce("root", "label").alias("label"), (F.col("ran") | F.col("now").isNotNull()).alias("ran"))
        state = written(state, "near-state")
        pivots *= MORE


def keep_first(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, distance: int = NEAR_DISTANCE
) -> DataFrame:
    """One row of docs per group of near copies: that with the smallest id
    (null last, then by a hash of the text); of repeated rows, one."""
    small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    work = docs.select(row.alias("row"), text_of(text_col).alias("text"), F.col(id_col).alias("id"))
    # What a row is found by again: hashes of its text and of its id.
    work = work.select("row", "text", "id", F.xxhash64("text").alias("key"), F.xxhash64(F.col("id").isNull(), "id").alias("id_key"))
    prints = work.select("id", "key", "id_key", F.arrow_udf(word_prints, PRINTS)(F.col("text").cast("binary")).alias("p")).select("id", "key", "id_key", "p.*")
    order = F.struct(F.col("id").isNull().alias("nil"), "id", "key", "id_key")
    texts = written(prints.groupBy("same").agg(F.min(order).alias("first"), F.min("fp").alias("fp")), "near-texts")
    roots = written(linked(texts.select("fp").distinct(), distance), "near-roots")
    grouped = texts.join(roots, "fp", "left").withColumn("group", F.coalesce("root", "fp")).drop("root")
    several = grouped.groupBy("group").count().where("count > 1").select("group", F.lit(True).alias("several"))
    grouped = grouped.join(several, "group", "left").select("same", "first", "group", F.coalesce("several", F.lit(False)).alias("several"), "first.key", "first.id_key")
    # The first row of every distinct text moves once; rows equal in both keys meet in one place.
    rows = work.select("row", "key", "id_key").join(grouped, ["key", "id_key"]).dropDuplicates(["key", "id_key"])
    rows = written(rows.select("row", "same", "group", "several", "first"), "near-rows")
    grams = F.arrow_udf(shingle_sets(shingle), "array<long>")(text_of(F.col(f"row.`{text_col}`")).cast("binary"))
    labels = confirmed(rows.where("several").select("group", F.col("same").alias("member"), grams.alias("grams")), similarity)
    firsts = rows.where("several").select(F.col("same").alias("member"), "first").join(labels, "member")
    lowest = firsts.groupBy("label").agg(F.min_by("member", "first").alias("same"))
    kept = rows.where("NOT several").select("row").unionByName(rows.where("several").join(lowest, "same", "left_semi").select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def spread_back(prints: DataFrame, classes: DataFrame, hot: int = 1000) -> DataFrame:
    """prints with their class. A fingerprint that over 1/hot of the rows carry
    is joined by broadcast (there are at most hot of them), the rest by a join
    in which no key holds more than that share."""
    counts = prints.groupBy("fp").count().where(F.col("count") > prints.count() // hot)
    wide = written(counts.join(classes, "fp").select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot")), "simhash-hot")
    marked = prints.join(F.broadcast(wide), "fp", "left")
    rare = marked.where("hot IS NULL").select("id", "fp").join(classes, "fp")
    return marked.where("hot").select("id", "fp", F.col("hot_id").alias("component_id")).unionByName(rare.select("id", "fp", "component_id"))
