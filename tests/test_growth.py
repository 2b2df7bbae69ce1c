"""What must not grow faster than the input: work done twice, and what one task holds."""

import time

from pyspark.sql import functions as F

from graphmill.functions.lineage import settled
from graphmill.operators import edges as E
from graphmill.operators import reconcile as R
from graphmill.operators import sampling as S
from graphmill.operators import similarity as J
from graphmill.sources import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_settling_runs_the_last_stage_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = settled(spark.range(100).mapInArrow(run, "id long"))
    assert sorted(r.id for r in rows.collect()) == list(range(100))
    assert seen.value == 100


def test_split_hashes_edges_once(spark):
    edges = spark.createDataFrame([("r", i, i + 1) for i in range(100)], "relation string, src long, dst long")
    split = E.split(edges)
    assert "md5" not in plan(split)
    assert split.where("split = 'train'").count() == 90


def test_enrich_holds_no_table_and_sorts_nothing(spark):
    nodes = spark.createDataFrame([(1, "drug", "a"), (2, "disease", "b")], "node_index long, node_type string, node_name string")
    out = R.enrich(spark.createDataFrame([(1, 2)] + [(1, -1)] * 9, "x_index long, y_index long"), nodes)
    assert "ShuffledHashJoin" in plan(out) and "BroadcastHashJoin" not in plan(out) and "Sort " not in plan(out)
    assert out.where("is_valid").count() == 1 and out.where("y_name IS NULL").count() == 9


def test_shuffles_get_room_for_the_lines(spark, sf, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(T, "ROWS", 500)
    try:
        n = T.lineitem(spark, sf).count()
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == -(-n // 500) > int(before)
        spark.conf.set("spark.sql.shuffle.partitions", "5000")
        T.lineitem(spark, sf)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "5000"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_similar_vectors_move_once_to_a_tile(spark):
    """Pairs are joined with no degrees and no vectors."""
    adj = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 8)], "node long, nbr long")
    members = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    sim = J.jaccard(adj, members)
    assert str(sim._jdf.queryExecution().optimizedPlan().toString()).split("Join")[0].count("Aggregate") == 1
    assert sorted(tuple(r) for r in sim.collect()) == [(1, 2, 0.5), (2, 3, 0.5)]
    vectors = spark.createDataFrame([(1, [1.0]), (2, [4.0]), (9, [5.0])], "node long, vector array<double>")
    out = J.blended(vectors, J.both_ways(sim, members), members.limit(0).selectExpr("node", "0 AS degree"), 1)
    assert "CoGroups" in out._jdf.queryExecution().toString()
    got = {r.node: r.vector[0] for r in out.collect()}
    assert abs(got[1] - (0.9 * (1 + 0.5 * 4) / 1.5 + 0.1 * 1)) < 1e-12 and abs(got[2] - (0.9 * (4 + 0.5 * 1) / 2 + 0.1 * 4)) < 1e-12 and got[9] == 5.0


def test_first_attempts_go_in_slices(spark, monkeypatch):
    """By slices or at once the negatives are the same, and no more than a slice is joined at once."""
    edges = spark.createDataFrame([("r", i, 100 + i * j % 9) for i in range(40) for j in range(3)], "relation string, src long, dst long")
    known = settled(edges.distinct())
    pool = settled(E.pools(known))
    want = sorted(tuple(r) for r in S.typed_negatives(edges, pool, known).collect())
    joined = []
    monkeypatch.setattr(S, "SLICE", 30)
    monkeypatch.setattr(S, "stored", lambda df, label: joined.append(df.count()) or df)
    assert sorted(tuple(r) for r in S.typed_negatives(edges, pool, known).collect()) == want
    assert len(joined) == 8 and sum(joined) == 240 and max(joined) < 60
    got = S.typed_negatives(known, pool, known, distinct=True)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in S.typed_negatives(known, pool, known).collect())


def test_stored_tables_leave_no_shuffles(spark):
    """What made a table goes from the disk, and tiles of similarities hold their ends only."""

    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    before = held()
    rows = settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and rows.count() == 7
    vectors = spark.createDataFrame([(1, [1.0])], "node long, vector array<double>")
    full = settled(spark.createDataFrame([(1, 1, 1.0)], "i long, j long, sim double"))
    out = J.blended(vectors, full, spark.createDataFrame([], "node long, degree long"), 1)
    assert "batch" not in plan(out) and [tuple(r) for r in out.collect()] == [(1, [1.0])]
