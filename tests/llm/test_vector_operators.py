"""The operators on embeddings against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<float>, label int"
BAD = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, []]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    points = rng.standard_normal((500, 16))
    for k in range(0, 120, 2):  # near copies, some in chains
        points[k + 1] = points[k] + 0.22 * rng.standard_normal(16) * np.linalg.norm(points[k]) / 4
    points[200:260] = points[200]  # copies
    points[260:300] = points[260] + 0.05 * rng.standard_normal((40, 16))
    points[300] *= 1e-20
    points[301] *= 1e18
    return [(k * 5, [float(np.float32(x)) for x in p], k % 3) for k, p in enumerate(points)] + [(100_000 + k, v, 0) for k, v in enumerate(BAD)]


def good(rows):
    keep = [(i, np.array(v, np.float64)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, points = np.array([i for i, _ in keep]), np.stack([v / np.linalg.norm(v) for _, v in keep])
    return ids, points


def test_nearest(spark, rows):
    from tidewater.llm.ann import nearest

    frame = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("code", F.lit("clash"))
    got = nearest(frame, F.col("vec_id") % 50 == 0).collect()
    ids, points = good(rows)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = points @ points[q]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == ids[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and ids[q] not in [i for _, i, _ in own]
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        for _, i, score in own:
            assert score == pytest.approx(near[np.searchsorted(ids, i)], abs=1e-12)
        near[q] = -2
        best = ids[np.lexsort((ids, -np.round(near, 12)))[:5]]
        hits += len(set(best) & {i for _, i, _ in own})
        total += 5
    assert hits >= 0.97 * total


def test_nearest_of_few_and_odd_rows(spark, rows):
    from tidewater.llm.ann import nearest

    few = spark.createDataFrame([*rows[:3], rows[2], (None, rows[5][1], 0), *rows[-6:]], VECTORS)
    got = nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert {r["vec_id"] for r in got} == {5, 10} and [r["rank"] for r in got] == [1, 2]
    assert nearest(few.limit(0), F.lit(True)).count() == 0 and nearest(few, F.lit(False)).count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [1.0, 0.0, 0.0], 0)], VECTORS)
    assert [(r["query_id"], r["vec_id"]) for r in nearest(mixed, F.lit(True)).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
    copies = spark.createDataFrame([(k, [1.0, 2.0, 3.0], 0) for k in range(20)], VECTORS)
    assert [r["vec_id"] for r in nearest(copies, F.col("vec_id") == 3).orderBy("rank").collect()] == [0, 1, 2, 4, 5]


def test_groups(spark, rows, monkeypatch):
    from tidewater.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "LARGE", 20)  # so that filters are split
    frame = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("times", F.lit(1))
    got = {r["_id"]: r for r in embedding_dedup.embedding_groups(frame).collect()}
    ids, points = good(rows)
    linked = points @ points.T >= 0.9
    first = list(range(len(ids)))

    def root(x):
        while first[x] != x:
            x = first[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        if linked[i, j]:
            a, b = sorted((root(i), root(j)))
            first[b] = a
    found = sum(got[i]["_n_links"] for i in ids.tolist())
    assert 0.99 * (linked.sum() - len(ids)) <= found <= linked.sum() - len(ids)
    same = [got[i]["_component"] == ids[root(k)] for k, i in enumerate(ids.tolist())]
    assert np.mean(same) >= 0.99
    assert all(got[i]["_n_links"] <= linked[k].sum() - 1 and got[i]["_kept"] == (got[i]["_component"] == i) for k, i in enumerate(ids.tolist()))
    assert all(tuple(got[i])[1:] == (0, i, True) for i in range(100_000, 100_006)) and len(got) == len(rows)


def test_groups_of_odd_rows(spark, rows):
    from tidewater.llm.embedding_dedup import embedding_groups

    v = rows[0][1]
    frame = spark.createDataFrame([(7, v, 0), (7, v, 0), (3, v, 0), (None, v, 0), (9, [2 * x for x in v], 1), (8, [1.0], 0), (6, [3.0], 0)], VECTORS)
    got = sorted((r["_id"] or -1, r["_n_links"], r["_component"], r["_kept"]) for r in embedding_groups(frame).collect())
    assert got == [(-1, 0, None, False), (3, 3, 3, True), (6, 1, 6, True), (7, 3, 3, False), (7, 3, 3, False), (8, 1, 6, False), (9, 3, 3, False)]
    assert embedding_groups(frame.limit(0)).count() == 0


def test_components(spark):
    from tidewater.llm.cluster import components

    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    names = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            names[a] = names[b] = min(names[a], names[b])
    assert got == {x: n for x, n in names.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
