import numpy as np
from pyspark.sql import functions as F

from hailgrid.llm import multi_index
from hailgrid.llm.multi_index import near_vectors
from hailgrid.llm.queries import op12_embedding_dedup

from .conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, threshold=0.93):
    """[(vec_id, n_links, component_id, kept)] by comparing every pair."""
    lists, parent = [[] for _ in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    groups = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups.setdefault((label, len(v)), []).append(i)
    for own in groups.values():
        a = np.array([rows[i][1] for i in own], np.float64)
        a = a / np.abs(a).max(1)[:, None]
        a = a / np.linalg.norm(a, axis=1)[:, None]
        for x, y in zip(*np.nonzero(a @ a.T >= threshold), strict=True):
            if x != y:
                lists[own[x]].append(own[y])
                parent[root(own[x])] = root(own[y])
    least = {}
    for i, (vec_id, *_) in enumerate(rows):
        if vec_id is not None:
            least[root(i)] = min(least.get(root(i), vec_id), vec_id)
    return [(v, len(lists[i]), least.get(root(i)), least.get(root(i)) == v) for i, (v, *_) in enumerate(rows)]


def clusters(seed, centres, size=16):
    rnd = np.random.default_rng(seed)
    rows = []
    for c in range(centres):
        base = rnd.normal(size=size)
        for _ in range(int(rnd.integers(1, 30))):
            noisy = base + rnd.normal(size=size) * rnd.choice([0.02, 0.1, 0.25])
            rows.append((len(rows), noisy.tolist(), int(c % 3)))
    return rows


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_equals_plain_comparison(spark, monkeypatch):
    rows = clusters(3, 60)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("cell", F.lit(1)).withColumn("uid", F.lit("x"))
    want = plain(rows)
    got = near_vectors(frame).collect()
    # The traversal finds all links here; the sample alone would let 1 in 1000 go.
    assert key(got) == key(want)
    # Rows and cells of the grid as tiles, full cells cut, visitors dealt out.
    monkeypatch.setattr(multi_index, "TILE_ROWS", 8)
    monkeypatch.setattr(multi_index, "TILE_VISITORS", 16)
    assert key(near_vectors(frame, codes=4).collect()) == key(want)


def test_odd_vectors(spark):
    rows = clusters(5, 6, 5)
    n = len(rows)
    odd = [None, [], [0.0] * 5, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 1.0, 0.0, 0.0, 0.0]]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)]
    rows += [(n + 10, rows[0][1], None), (n + 11, rows[0][1], 0), (n + 11, rows[0][1], 0), (None, rows[0][1], 0), (n + 12, rows[0][1][:3], 0)]
    rows += [(n + 13, [1e300, 1e300, 0.0, 0.0, 0.0], 2), (n + 14, [1e-300, 1e-300, 0.0, 0.0, -0.0], 2), (n + 15, [2.0], 0), (n + 16, [7.0], 0), (n + 17, [-7.0], 0)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(0)).withColumn("key", F.lit(0))).collect()
    assert key(got) == key(plain(rows))


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_of_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    # Near copies of some of the given vectors, at the edge of the threshold too.
    rnd = np.random.default_rng(2)
    for i, (_, v, label) in enumerate(rows[:300]):
        v = np.array(v)
        noise = rnd.normal(size=len(v))
        noise *= np.linalg.norm(v) * rnd.uniform(0.05, 0.4) / np.linalg.norm(noise)
        rows.append((10_000 + i, (v + noise).tolist(), label))
    want = {r[0]: r[1] for r in plain(rows)}
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(want.values()) > 400
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert key(op12_embedding_dedup(spark, SF).collect()) == key(plain(rows))
