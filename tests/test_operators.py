import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphmill.operators import edges as E
from graphmill.operators import graph as G
from graphmill.operators import metrics as M
from graphmill.operators import reconcile as R
from graphmill.operators import sampling as S
from graphmill.operators import similarity as J
from graphmill.operators import training as Tr
from graphmill.sources import artefacts as A
from graphmill.sources import tables as T

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_undirected_dedup(spark):
    raw = spark.createDataFrame([("r", 1, 2), ("r", 2, 1), ("r", 1, 2), ("s", 1, 2), ("r", 3, 3), (None, 4, 5), (None, 5, 4), ("r", None, 7)], T.EDGES)
    assert rows(E.dedup(raw)) == sorted([("r", 1, 2), ("s", 1, 2), ("r", 3, 3), (None, 4, 5), ("r", 7, 7)], key=repr)


@FEW
@given(n=st.integers(0, 60), parts=st.integers(1, 7))
def test_split_is_exact_and_stable(spark, n, parts):
    edges = spark.createDataFrame([("r", i, i + 1) for i in range(n)], "relation string, src long, dst long")
    found = rows(E.split(edges.repartition(parts)))
    assert sum(r[3] == "train" for r in found) == n * 9 // 10 and len(found) == n
    assert found == rows(E.split(edges.coalesce(1)))


@FEW
@given(nodes=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 300_000)), unique=True))
def test_dense_positions(spark, nodes):
    df = spark.createDataFrame(nodes, "g string, node long")
    found = {(r.g, r.node): r.pos for r in E.dense_position(df, ["g"], "node").collect()}
    for g in "ab":
        own = sorted(n for k, n in nodes if k == g)
        assert [found[g, n] for n in own] == list(range(len(own)))


def test_negatives_keep_their_promises(spark, sf):
    known = E.dedup(T.raw_edges(spark, sf))
    pool = E.pools(known)
    bad = S.typed_negatives(known, pool, known).select("relation", "x_index", "y_index").distinct()
    assert bad.where("x_index = y_index").isEmpty()
    assert E.canonical(bad).join(known, E.EDGE, "left_semi").isEmpty()
    assert bad.join(pool.withColumnRenamed("node", "y_index"), ["relation", "y_index"], "left_anti").isEmpty()


def test_unresolved_negatives_are_dropped(spark):
    known = spark.createDataFrame([("r", 1, 2)], "relation string, src long, dst long")
    assert S.typed_negatives(known, E.pools(known), known).isEmpty()
    open_ = spark.createDataFrame([("r", 1, 2), ("r", 1, 2)], known.schema)
    none = known.limit(0)
    assert rows(S.typed_negatives(open_, E.pools(open_), none, tries=40)) == [("r", 1, 2, 0)] * 2


@pytest.mark.parametrize("degrees", [[1, 10], [4, 4, 4], [1, 1, 2, 9]])
def test_bins_hold_every_degree(spark, degrees):
    df = spark.createDataFrame(list(enumerate(degrees)), "node long, degree long")
    bins = E.decile_bins(df)
    values = bins.first().bins
    assert np.allclose(values, np.unique(np.percentile(degrees, range(0, 101, 10)).round(9)))
    found = df.join(bins).select("degree", E.bin_of(df.degree, bins.bins).alias("b")).collect()
    assert all(0 <= r.b <= max(0, len(values) - 2) for r in found)


def test_cold_nodes(spark):
    edges = spark.createDataFrame([("r", 1, 5, 1)] + [("r", i, 6, 1) for i in range(3)] + [("r", i, 7, i % 2) for i in range(4)], T.LABELLED)
    assert rows(S.cold_nodes(edges)) == [(5, 1), (6, 3)]
    assert rows(S.cold_nodes(edges, positives_only=True)) == [(5, 1), (6, 3), (7, 2)]


def plain_walk(ordered, size, share=0.9):
    """The greedy rule over all rows in order."""
    seen, taken, turn, pool = (set(), set()), [], 0, list(ordered)
    while len(taken) < size and pool:
        rest, took = [], False
        for row in pool:
            new = row[0] not in seen[0], row[1] not in seen[1]
            if len(taken) < size and (new[turn] or (new[1 - turn] and len(taken) < share * size)):
                taken.append(row)
                seen[0].add(row[0])
                seen[1].add(row[1])
                turn, took = 1 - turn, True
            else:
                rest.append(row)
        pool = rest
        if not took:
            return taken + pool[: size - len(taken)]
    return taken


@pytest.mark.parametrize(("xs", "ys", "size"), [(20, 30, 40), (200, 15, 60), (9, 300, 100), (40, 40, 500), (3, 2, 40), (150, 150, 60)])
def test_coverage_sample_is_the_walk_over_all_rows(spark, xs, ys, size):
    rng = np.random.default_rng(xs)
    pairs = sorted({(int(x), int(y)) for x, y in zip(rng.integers(0, xs, 400), rng.integers(0, ys, 400))})
    df = spark.createDataFrame([*pairs, (None, 1)], "x_index long, y_index long").repartition(3)
    order = E.shuffled(df.dropna(), ["x_index", "y_index"], 42).collect()
    assert rows(S.coverage_sample(df, size=size)) == sorted(plain_walk([tuple(r) for r in order], size), key=repr)


ONTOLOGY = """{"graphs": [{"nodes": [
 {"id": "http://purl.obolibrary.org/obo/MONDO_0000001"},
 {"id": "http://purl.obolibrary.org/obo/MONDO_0000012", "meta": {"xrefs": [{"val": "MESH:D000013"}, {"val": "OMIM:1"}]}},
 {"id": "http://purl.obolibrary.org/obo/MONDO_0000034", "meta": {"basicPropertyValues": [{"pred": "x#exactMatch", "val": "http://id.nlm.nih.gov/mesh/D000077"}, {"pred": "x#exactMatch", "val": "http://id.nlm.nih.gov/mesh/C5"}]}},
 {"id": "http://purl.obolibrary.org/obo/MONDO_0000056", "meta": {"xrefs": [{"val": "MESH:C535275"}, {"val": "MESH:D000013"}]}},
 {"id": "http://purl.obolibrary.org/obo/HP_1", "meta": {"xrefs": [{"val": "MESH:D000099"}]}}]}]}"""


def test_crosswalk(spark, tmp_path):
    (tmp_path / "o.json").write_text(ONTOLOGY)
    walk = dict(rows(R.crosswalk(T.ontology_nodes(spark, str(tmp_path / "o.json")))))
    assert walk["D000013"] == walk["13"] == "56"  # the last writer
    assert walk["D000077"] == "34" and walk["C535275"] == "56"
    assert not {"D000099", "99", "C5", ""} & set(walk)
    nodes = spark.createDataFrame([(1, "56", "disease", "a"), (2, "7", "drug", "b"), (3, "7", "drug", "c"), (4, "56", "drug", "d")], T.NODES)
    pairs = spark.createDataFrame([("7", "MESH:D000013"), ("8", "MESH:D000077"), ("7", "OMIM:9"), (None, None), ("7", "MESH:D000013")], T.MAPPING)
    found = R.reconcile_diseases(R.reconcile_drugs(pairs, nodes), R.crosswalk(T.ontology_nodes(spark, str(tmp_path / "o.json"))), nodes)
    assert rows(found) == sorted([("7", "MESH:D000013", 3, "c", 1, "a")] * 2 + [("8", "MESH:D000077", None, None, None, None), ("7", "OMIM:9", 3, "c", None, None), (None,) * 6], key=repr)
    assert R.coverage(found).first().asDict() == {"n_rows": 5, "n_drugs": 2, "drugs_unmatched": 1, "n_diseases": 3, "diseases_unmatched": 2, "rows_matched": 2, "drug_gap": 0.5, "disease_gap": 2 / 3, "row_share": 0.4}
    assert R.matched_only(found).count() == 2


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([("12",), ("1234567",), ("",)], "c string")
    assert [r[0] for r in df.select(R.padded(df.c)).collect()] == ["000012", "1234567", "000000"]


def test_enrich(spark):
    nodes = spark.createDataFrame([(1, "a", "drug", "A"), (2, "b", "disease", "B"), (3, "c", "gene", "C"), (4, "d", None, "D")], T.NODES)
    edges = spark.createDataFrame([("r", 1, 2, 1), ("r", 2, 1, 1), ("r", 1, 3, 1), ("r", 1, 4, 0), ("r", 1, 9, 0), ("r", 1, 1, 0)], T.LABELLED)
    found = R.enrich(edges, nodes)
    assert [r.is_valid for r in found.orderBy("x_index", "y_index").collect()] == [False, True, False, False, False, True]
    assert R.null_counts(found, ["y_name", "y_type"]).first() == (1, 2)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_jaccard_of_hubs(spark, block):
    adj = [(i, 100) for i in range(9)] + [(i, 101 + i % 2) for i in range(9)]
    near = {i: {n for k, n in adj if k == i} for i in range(9)}
    want = [(i, j, len(near[i] & near[j]) / len(near[i] | near[j])) for i in range(9) for j in range(i + 1, 9)]
    found = J.jaccard(spark.createDataFrame(adj, "node long, nbr long"), spark.range(9).toDF("node"), block=block)
    assert rows(found) == sorted(want, key=repr)


def test_jaccard(spark):
    edges = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 11), (2, 10), (3, 11), (4, 4)], "x_index long, y_index long")
    members = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "node long")
    sim = J.jaccard(E.adjacency(edges), members)
    assert rows(sim) == [(1, 2, 1.0), (1, 3, 0.5), (2, 3, 0.5)]
    stats = J.matrix_stats(sim, 5).first()
    assert (stats.least, stats.largest, stats.nonzero_pct) == (0.0, 1.0, 44.0) and math.isclose(stats["mean"], 9 / 25)
    assert all(math.isclose(r[1], 1) for r in J.normalised(J.both_ways(sim, members)).groupBy("i").agg({"w": "sum"}).collect())


def test_blend(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0]), (9, [7.0, 7.0])], "node long, vector array<double>")
    sim = J.both_ways(spark.createDataFrame([(1, 2, 0.5)], "i long, j long, sim double"), spark.createDataFrame([(1,), (2,), (3,)], "node long"))
    degrees = spark.createDataFrame([(1, 0), (2, 1), (3, 5)], "node long, degree long")
    found = dict(rows(J.blended(vectors, sim, degrees, 2)))
    c = 0.9
    assert np.allclose(found[1], [c * 2 / 3 + 1 - c, c / 3]) and found[9] == [7.0, 7.0] and np.allclose(found[3], [5, 5])


def preds(spark, pairs):
    return spark.createDataFrame(pairs, "y_true int, y_score double")


SCORES = st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.1, 0.2, 0.5, 0.7, 0.9])), min_size=1, max_size=30)


@FEW
@given(pairs=SCORES)
def test_auc_and_confusion(spark, pairs):
    df = preds(spark, pairs)
    p, n = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    want = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)) if p and n else None
    auc = M.auc_by_rank(df).first().auc
    assert auc == want or math.isclose(auc, want)
    c = M.confusion(df).first()
    tp, fp, fn = sum(s >= 0.5 for s in p), sum(s >= 0.5 for s in n), sum(s < 0.5 for s in p)
    assert c.f1 == (2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0) and c.precision == (tp / (tp + fp) if tp + fp else 0)


def test_single_class_and_threshold(spark):
    df = preds(spark, [(1, 0.5), (1, 0.9)])
    assert M.auc_by_rank(df).first().auc is None and M.auc_by_rank(df, 0.5).first().auc == 0.5
    assert M.confusion(df).first().recall == 1.0 and M.confusion(df, inclusive=False).first().recall == 0.5
    for label in (0, 1):
        one = spark.createDataFrame([(label, 0.2), (label, 0.7)], "y_true int, y_score double")
        assert M.auc_by_area(one).first().auc is None and M.auc_by_area(one, 0.5).first().auc == 0.5 == M.auc_by_rank(one, 0.5).first().auc
        points = M.roc_points(one).collect()
        assert len(points) >= 2 and all((p.tpr if label else p.fpr) is not None and (p.fpr if label else p.tpr) is None for p in points)
    assert M.auc_by_area(one.limit(0)).first().auc is None and M.roc_points(one.limit(0)).count() == 1


def test_roc(spark):
    df = preds(spark, [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (1, 0.5), (0, 0.5)])
    found = sorted(map(tuple, M.roc_points(df).collect()), key=lambda r: -r[2])
    assert found == [(0.0, 0.0, math.inf), (0.0, 0.25, 0.9), (0.0, 0.75, 0.7), (0.5, 0.75, 0.6), (1.0, 1.0, 0.5)]
    assert math.isclose(M.auc_by_area(df).first().auc, M.auc_by_rank(df).first().auc)


def test_cumulated_over_many_ranges(spark, monkeypatch):
    """However few scores a range holds, the sums are those of all."""
    rng = np.random.default_rng(1)
    pairs = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 300), rng.integers(0, 90, 300) / 7, strict=True)]
    df = preds(spark, pairs)
    found = {r.s: (r.tp, r.fp) for r in M.cumulated(M.by_score(df), 5).collect()}
    assert found == {s: (sum(y for y, x in pairs if x >= s), sum(1 - y for y, x in pairs if x >= s)) for _, s in pairs}
    want = rows(M.roc_points(df))
    monkeypatch.setattr(M.cumulated, "__defaults__", (5,))
    assert rows(M.roc_points(df)) == want


@pytest.mark.parametrize(("n", "tenths"), [(0, 9), (1, 9), (10, 9), (500, 7), (40, 10), (40, 0)])
def test_split_takes_the_first_by_hash(spark, n, tenths):
    df = spark.createDataFrame([("r", i, i + 1) for i in range(n)], "relation string, src long, dst long")
    got = {(r.src, r.split) for r in E.split(df, tenths=tenths).collect()}
    order = [r.src for r in E.shuffled(df, E.EDGE, 42).collect()]
    assert got == {(s, "train" if k < n * tenths // 10 else "val") for k, s in enumerate(order)}


def test_early_stop(spark):
    history = spark.createDataFrame(list(enumerate([0.5, 0.6, 0.6, 0.6, 0.7, 0.1])), "epoch int, value double")
    assert [r.epoch for r in M.early_stop(history, 2).orderBy("epoch").collect()] == [0, 1, 2, 3]
    assert M.early_stop(history, 3).where("improved").count() == 3


def test_metric_lines_and_summary(spark):
    df = preds(spark, [(1, 0.9), (0, 0.1)])
    best = M.summary([M.evaluate(preds(spark, [(1, 0.1), (0, 0.9)]), "b", "t"), M.evaluate(df, "a", "t")])
    assert [r.model for r in best.collect()] == ["a", "b"]
    assert M.metric_lines(best.limit(1)).first().value == "auc: 1.000000"


def vectors_of(spark, table):
    return spark.createDataFrame(list(table.items()), "node long, vector array<double>")


def test_encode(spark):
    edges = spark.createDataFrame([("b", 1, 2, 1), ("a", 2, 3, 0)], T.LABELLED)
    out = G.encode(spark.createDataFrame([(5, "x", "t", "n")], T.NODES), train=edges, val=edges.limit(0), test_hard=None)
    assert rows(out["relations"]) == [("a", 0), ("b", 1)] and rows(out["messages"]) == [(1, 2, 1)]
    assert "test_hard" not in out and out["size"].first().n_nodes == 6


def test_training_learns(spark, tmp_path):
    edges = [(i, 100 + i, 0, 1.0) for i in range(6)] + [(i, 100 + (i + 1) % 6, 0, 0.0) for i in range(6)]
    df = spark.createDataFrame(edges, "x_index long, y_index long, rel_id long, label double").cache()
    graph = df.selectExpr("x_index AS src", "y_index AS dst", "rel_id")
    nodes = spark.createDataFrame([(i,) for i in [*range(6), *range(100, 106)]], "node long")
    model = Tr.Model(4)
    start = Tr.start(model, nodes, spark.createDataFrame([(0,)], "rel_id long"))
    best, history = Tr.train(model, start, df, df, graph, str(tmp_path), epochs=4, patience=4, lr=0.2, fanouts=(2,))
    assert history[-1][1] < history[0][1] and best.nodes.count() == start.nodes.count()
    moved = Tr.transferred(start, best)
    assert moved.weights.select("row").collect() == start.weights.select("row").collect()
    assert sorted(map(str, moved.nodes.select("node", "row").collect())) == sorted(map(str, best.nodes.select("node", "row").collect()))


def test_sources(spark, tmp_path):
    path = str(tmp_path / "e")
    df = spark.createDataFrame([("r", 1, 2)], T.EDGES)
    T.write_csv(df, path)
    assert rows(T.read_csv(spark, path, T.EDGES, ["x_index"])) == [(1,)] and T.optional(spark, None, T.EDGES) is None
    assert T.optional(spark, str(tmp_path / "none"), T.EDGES) is None
    with pytest.raises(ValueError, match="missing columns"):
        T.require(df, ["z"])
    assert T.newest(spark, f"{path}/*.csv").endswith(".csv")


def test_bundle_and_reuse(spark, tmp_path):
    sim = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (1, 3, 0.0)], "i long, j long, sim double")
    A.save_bundle(sim, spark.createDataFrame([(1, 0), (2, 1), (4, 2)], "node long, local long"), f"{tmp_path}/b")
    loaded, members = A.load_bundle(spark, f"{tmp_path}/b")
    assert rows(loaded) == rows(sim) and rows(members.select("node", "degree")) == [(1, 2), (2, 2), (4, 0)]
    with pytest.raises(FileNotFoundError, match="no table"):
        A.load_bundle(spark, f"{tmp_path}/none")
    calls = []
    for _ in range(2):
        out = A.reused(spark, f"{tmp_path}/stage", lambda: calls.append(1) or spark.range(3))
    assert out.count() == 3 and calls == [1] and A.first_found(spark, f"{tmp_path}/no", f"{tmp_path}/stage").count() == 3


def test_evaluation_artefacts(spark, tmp_path):
    preds = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6)], "y_true int, y_score double")
    row = M.evaluate(preds, "m", "d")
    A.save_evaluation(preds, row, str(tmp_path), ("auc", "accuracy"), dataset=True)
    assert [r.value for r in spark.read.text(f"{tmp_path}/metrics").collect()] == ["Dataset: d", "auc: 0.750000", "accuracy: 0.500000"]
    assert spark.read.csv(f"{tmp_path}/raw_pred", header=True).count() == 4
    assert [float(r.tpr) for r in spark.read.csv(f"{tmp_path}/roc", header=True).collect()][-1] == 1.0
    assert A.named_copy("a/test.csv") == "a/test_llm.csv"

    def broken():
        raise FileNotFoundError("no weights")

    calls = []
    models = {"x": broken, "y": lambda: {}["z"], "m": lambda: calls.append(1) or row}
    good, failed = A.each_model(models)
    assert len(good) == 1 and failed == {"x": "no weights", "y": "'z'"} and good[0].first() == row.first() and calls == [1]
    table, failed = A.compared(models, f"{tmp_path}/all.csv")
    assert len(failed) == 2 and [r.model for r in spark.read.csv(f"{tmp_path}/all.csv", header=True).collect()] == ["m"] and table.count() == 1
    assert A.compared({"x": broken}, f"{tmp_path}/none.csv") == (None, {"x": "no weights"})


def test_batches(spark):
    edges = spark.createDataFrame([(i, 100 + i % 7) for i in range(60)], "src long, dst long")
    batched = G.batches(edges.toDF("x_index", "y_index"), ["x_index", "y_index"], 20)
    assert {r.batch for r in batched.collect()} == {0, 1, 2}
    near = G.batch_neighbourhood(edges, batched, [3, 2]).collect()
    seeds = {(r.batch, n) for r in batched.collect() for n in (r.x_index, r.y_index)}
    assert all((r.batch, r.dst) in seeds for r in near if r.hop == 0)
    per = {}
    for r in near:
        per[r.batch, r.hop, r.dst] = per.get((r.batch, r.hop, r.dst), 0) + 1
    assert per and all(n <= (3, 2)[hop] for (_, hop, _), n in per.items())
