import numpy as np
import pytest
from pyspark.sql import functions as F

from hailgrid.llm.curve_neighbours import hilbert_keys, neighbours


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 2)])
def test_neighbours_on_the_curve_touch(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
    keys = hilbert_keys(cells, bits)
    path = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def _exact(ids, x, every, k):
    n = np.linalg.norm(x, axis=1)
    for i in np.flatnonzero(ids % every == 0):
        scores = np.round((x @ x[i]) / (n * n[i]), 12)
        yield ids[i], [ids[j] for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]


def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = vectors.toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    got = {}
    for r in neighbours(vectors, least_window=64, block_rows=300).collect():
        got.setdefault(r.query_id, {})[r.rank] = r
    hit = total = 0
    for query, want in _exact(ids, x, 50, 5):
        rows = got[query]
        assert sorted(rows) == [1, 2, 3, 4, 5] and query not in {r.vec_id for r in rows.values()}
        assert [r.score for _, r in sorted(rows.items())] == sorted((r.score for r in rows.values()), reverse=True)
        hit += len(set(want) & {r.vec_id for r in rows.values()})
        total += 5
    assert hit / total >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=4).tolist()
    rows = [(i, same) for i in range(100, 180)] + [(i, rng.normal(size=4).tolist()) for i in range(200, 230)]
    rows += [(50, None), (300, [0.0] * 4), (350, [1.0, None, 0.0, 0.0]), (400, [1.0, float("nan"), 0.0, 0.0]), (450, [1.0, float("inf"), 0.0, 0.0])]
    rows += [(None, same), (500, [1.0, 2.0]), (550, [-0.0, 0.0, 0.0, 1e300]), (600, [1e-300, 0.0, 0.0, 0.0]), (100, same)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = {}
    for r in neighbours(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {100, 150, 200, 550, 600}
    assert [r.vec_id for r in got[100]] == [101, 102, 103, 104, 105] and [r.vec_id for r in got[150]] == [100, 101, 102, 103, 104]
    assert all(abs(r.score - 1) < 1e-12 for r in got[100])


def test_fewer_candidates_than_asked(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours(vectors).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 0.707107), (0, 2, 1, 0.0)]
    assert neighbours(vectors.limit(0)).count() == 0 and neighbours(vectors.where("vec_id = 0")).count() == 0
