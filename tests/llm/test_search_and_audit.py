"""Top-k search, lexical search and the filter audit on small odd tables, against brute force."""

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphmill.llm import filter_audit, lexical, topk

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

# Top-k


def plain_top(vectors, queries, k):
    """rows: (id, vector). {query id: [(score, id)]} by all products."""
    floors = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {(i, tuple(v)) for i, v in floors if i in queries}
    out = {}
    for q, v in asked:
        found = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in floors if i != q]
        out[q] = sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]
    return out


def found_top(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def vector_table(spark, rows, extra=()):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("own").alias(c) for c in extra])


def test_top_k_on_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)] + [(350, [0.5] * 6)]  # a large group of copies, one of them repeated
    rows += [(1000, None), (1050, [0.1, None, 0.1]), (1100, [float("nan")] * 6), (1150, [float("inf")] + [0.0] * 5), (1200, []), (1250, [1.0, 2.0]), (None, [0.6] * 6), (None, None), (1300, [-1e-20] * 6), (-50, [0.25] * 7)]
    df = vector_table(spark, rows, ["slot", "score", "rank", "vector", "query_id"]).repartition(7)
    got = found_top(topk.top_k(df, df.where("vec_id % 50 = 0"), 5))
    want = plain_top(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    assert got == want and -50 in got and 1250 in got and 1200 in got


def test_top_k_with_few_or_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (50, [-1.0, 0.0])]
    df = vector_table(spark, rows)
    assert found_top(topk.top_k(df, df.where("vec_id % 50 = 0"), 5)) == plain_top(rows, {0, 50}, 5)
    assert topk.top_k(df.limit(0), df, 5).isEmpty() and topk.top_k(df, df.limit(0), 5).isEmpty()
    assert topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).isEmpty()


def test_top_k_of_huge_numbers(spark):
    rows = [(0, [2.0**40, 1.0, 3.0]), (1, [2.0**40, 1.0, 3.0]), (2, [2.0**40, 2.0, 3.0]), (3, [-(2.0**100), 0.0, 0.0]), (4, [1e300, 0.0, 0.0]), (5, [1e300, -1e300, 0.0]), (6, [0.5, 0.5, 0.5])]
    df = vector_table(spark, rows)
    assert found_top(topk.top_k(df, df, 3)) == plain_top(rows, set(range(7)), 3)


def test_top_k_in_blocks_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, size=5)]) for i in range(500)]
    monkeypatch.setattr(topk, "BLOCK", 5 * 8 * 3)
    df = vector_table(spark, rows).repartition(5)
    assert found_top(topk.top_k(df, df.where("vec_id % 50 = 0"), 4)) == plain_top(rows, set(range(0, 500, 50)), 4)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 9), st.integers(0, 10**6), st.integers(1, 4))
def test_sufficient_entries_hold_all_that_reach_the_cutoff(width, n, seed, k):
    rng = np.random.default_rng(seed)
    parts = topk.partial_scores(rng.integers(-4, 5, (3, width)).astype(float), rng.integers(-4, 5, (n, width)).astype(float))
    totals = parts.sum(axis=0)
    cut = np.sort(totals, axis=1)[:, -min(k, n)]
    chosen = topk.sufficient(parts, cut, np.zeros(3, bool))
    assert chosen[totals >= cut[:, None]].all()


def test_threshold_prunes(spark):
    """Of random vectors most are in no list at the threshold."""
    rng = np.random.default_rng(7)
    told, asked = np.floor(rng.normal(size=(1024, 32)) * 256), np.floor(rng.normal(size=(4, 32)) * 256)
    parts = topk.partial_scores(asked, told)
    cut = np.sort(parts.sum(axis=0), axis=1)[:, -5]
    assert topk.sufficient(parts, cut, np.zeros(4, bool)).mean() < 0.2


# Lexical search


def plain_search(docs, items, k=10):
    lower = lambda t: TERM.findall((t or "").translate(ASCII_LOWER))
    held = [(i, Counter(lower(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = {}
    for item, text in set(items):
        scores = []
        for i, c, n in held:
            m = 100 - 75 + ((75 * n * n_docs) // n_terms)
            scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in lower(text)), i))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        if best:
            out[item, text] = best
    return out


LONG = " ".join(f"word{i % 991}" for i in range(50_000))
DOCS = [(1, "Alpha beta, GAMMA! alpha"), (2, "alpha-beta_gamma delta"), (2, "alpha-beta_gamma delta"), (3, ""), (4, None), (None, "alpha beta"), (5, LONG), (6, " \t\x00!?"), (7, "Ünïcode 日本語 alpha É é"), (8, "zeta " * 300)] + [(i, "copies of one text alpha") for i in range(100, 160)]
ITEMS = [(1, "alpha beta BETA"), (2, "日本語 É"), (3, None), (4, "unknown words only"), (5, "word5 word6 word990 zeta"), (1, "alpha beta BETA"), (6, ""), (7, "copies of one text"), (None, "zeta")]


def found_items(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r["rank"] == len(out[r.item_id])
    return out


@pytest.mark.parametrize(("cells", "folded", "block"), [(4096, 256, 4 << 20), (2, 3, 80)])
def test_search_against_all_scores(spark, monkeypatch, cells, folded, block):
    # What a Python worker sees is pickled with the function only by reference, so
    # the sketch's size is checked through the functions below.
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").select("*", F.lit(1).alias("slot"), F.lit(2).alias("rank"), F.lit(3).alias("score")).repartition(6)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found_items(lexical.search(docs, items)) == {i: best for (i, _), best in plain_search(DOCS, ITEMS).items()}
    assert lexical.search(docs.limit(0), items).isEmpty() and lexical.search(docs, items.limit(0)).isEmpty()


@pytest.mark.parametrize("cells", [2, 64, 4096])
def test_bounds_are_never_below_scores(cells, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", cells)
    rng = np.random.default_rng(cells)
    counts = [Counter(f"t{x}".encode() for x in rng.zipf(1.4, size=80) % 500) for _ in range(60)]
    norms = [lexical.length_norm(sum(c.values()), 60, 60 * 80) for c in counts]
    sketch = lexical.folded(counts, norms)
    item = lexical.Item({f"t{x}".encode(): int(w) for x, w in zip(range(40), rng.integers(1, 9000, 40), strict=True)}, 5)
    bounds = item.weights @ sketch[item.cells]
    scores = [sum(w * lexical.impact(c[t], m) for t, w in item.weighed if t in c) for c, m in zip(counts, norms, strict=True)]
    assert (bounds >= np.array(scores)).all()
    item.offer(sketch, counts, norms, list(range(60)))
    assert sorted(item.best, reverse=True) == sorted(((s, True, -i) for i, s in enumerate(scores) if s), reverse=True)[:5]


def test_few_documents_are_scored_exactly():
    """Where an item's terms are rare, the bounds leave out nearly all documents."""
    rng = np.random.default_rng(8)
    counts = [Counter(f"t{x}".encode() for x in rng.integers(0, 20_000, 100)) for _ in range(2000)]
    item = lexical.Item({f"t{x}".encode(): 3000 + x for x in range(0, 20_000, 1000)}, 3)
    scored = sum(item.offer(lexical.folded(counts[at : at + 250], [100] * 250), counts[at : at + 250], [100] * 250, list(range(at, at + 250))) for at in range(0, 2000, 250))
    assert scored < 400 and len(item.best) == 3


def test_terms_are_the_contract_matches():
    text = "".join(map(chr, range(0, 400))) + " ABC abc 日本\x7f語 x_y É"
    assert [t.decode() for t in lexical.terms(text.encode())] == TERM.findall(text.translate(ASCII_LOWER))


# Filter audit

AUDIT_DOCS = [(i, text, source) for i, (text, source) in enumerate([
    ("plain " * 250, "a"), ("plain " * 250, "a"), (" ".join(f"w{i}" for i in range(250)), "a"), (None, None), ("", "b"), ("SHOUT " * 10, "b"), ("a $ b", None), (" ".join(f"w{i}" for i in range(250)), ""),
    ("one\x1ctwo three", "b"), (LONG, "c"), (LONG, "c"), ("UPPER " + LONG, "b"), (" ".join(f"x{i}" for i in range(400)), "b"),
])] + [(None, "SHOUT " * 10, "a"), (3, None, "b"), (5, "SHOUT " * 10, "b")]
AUDIT_LABELS = [(0, 1, 0), (1, 1, 1), (1, 0, None), (5, None, 1), (None, 1, 1), (9, 1, 0), (12, 1, 1), (99, 1, 1)]


def plain_audit(docs, labels):
    failing, first = [], {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, source in docs:
        text = text or ""
        words = WORDS.findall(text)
        own = set()
        own |= {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        own |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        own |= {"E"} if i is not None and i > first[text] else set()
        said = [(q, t) for d, q, t in labels if d == i and i is not None]
        failing.append((source or "", own, any(q == 1 for q, _ in said), any(t == 1 for _, t in said)))
    out = set()
    for part in {f[0] for f in failing}:
        mine = [f for f in failing if f[0] == part]
        rows, total = [], Counter()
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                before = set(order[:step])
                gone = [f for f in mine if name in f[1] and not f[1] & before]
                total[name] += len(gone)
                rows.append((part, "".join(order), step + 1, sum(not f[1] & (before | {name}) for f in mine), len(gone), sum(name in f[1] and bool(f[1] & before) for f in mine), sum(f[1] == {name} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out |= {(*r, total[r[1][r[2] - 1]]) for r in rows}
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_audit_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT", hot)
    clash = [F.lit("own").alias(c) for c in ("key", "id", "part", "fails", "prefix", "bit", "kept", "good")]
    docs = spark.createDataFrame(AUDIT_DOCS, "doc_id long, text string, source string").select("*", *clash).repartition(5)
    labels = spark.createDataFrame(AUDIT_LABELS, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit(docs, labels).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(AUDIT_DOCS, AUDIT_LABELS)


def test_audit_of_no_rows_and_of_own_filters(spark):
    docs = spark.createDataFrame(AUDIT_DOCS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(AUDIT_LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).isEmpty()
    own = {"X": F.col("source") == "a", "Y": F.col("text").isNull()}
    rows = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(docs, labels.limit(0), own).collect()}
    assert len(rows) == 2 * 2 * len({s or "" for _, _, s in AUDIT_DOCS})
    assert rows["a", "XY", 1].removed == 4 and rows["a", "XY", 1].kept == 0 and rows["b", "YX", 1].removed == 1 and rows["b", "YX", 1].good_lost == 0
