import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.llm import hilbert_search, metric_join

from .helpers import Union, frame

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[50:80] = x[50] + rng.normal(0, 0.06, (30, dims))  # near copies
    x[80:95] = x[80]  # exact copies
    x[95] = x[80] * 3  # the same direction
    rows = [(i, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * dims, 1), (902, [1.0, None] + [0.0] * (dims - 2), 1), (903, [math.nan] * dims, 1), (904, [math.inf] * dims, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (None, rows[50][1], 1), (10, rows[10][1], 1)]
    return rows + odd


def good(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize("block", [4096, 40])
def test_metric_join_equals_brute_force(spark, block):
    rows = vectors()
    got = metric_join.near_duplicates(frame(spark, rows, SCHEMA), 0.95, block=block).collect()
    assert len(got) == len(rows)
    cos = lambda a, b: len(a) == len(b) and np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.95
    vec = [np.array(v, float) if good(v) else None for _, v, _ in rows]
    links, union = [0] * len(rows), Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if vec[i] is not None and vec[j] is not None and cos(vec[i], vec[j]):
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(union.find(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    want = sorted(((r[0], links[i], least[union.find(i)], r[0] is not None and r[0] == least[union.find(i)]) for i, r in enumerate(rows)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_metric_join_on_nothing(spark):
    assert metric_join.near_duplicates(frame(spark, [], SCHEMA)).collect() == []
    only = metric_join.near_duplicates(frame(spark, [(1, None, 0), (2, [0.0], 0)], SCHEMA)).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_huge_and_tiny_vectors(spark):
    rows = [(i, [f * x for x in v], 0) for i, (f, v) in enumerate((f, v) for v in ([1.0, 2.0, 3.0], [3.0, -1.0, 0.5]) for f in (1.0, 1e200, 1e-200, 1e-300))]
    got = metric_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(i, 3, i // 4 * 4, i % 4 == 0) for i in range(8)]


def test_cells_hold_all_partners():
    """Each vector's home cell has every vector within reach, as its own or as a guest."""
    rng = np.random.default_rng(3)
    centres = metric_join._unit(rng.normal(size=(6, 8)))
    x = metric_join._unit(np.repeat(centres, 30, axis=0) + rng.normal(0, 0.15, (180, 8)))
    cells = metric_join._Cells(x[rng.choice(180, 6, replace=False)], 0.95)
    home, cos = cells.home(x)
    for c in range(6):
        own = cos[home == c, c]
        cells.radius[c] = np.arccos(np.clip(own, -1, 1)).max() if len(own) else 0
    guests = cells.guests(home, cos)
    for i, j in zip(*np.nonzero(x @ x.T >= 0.95)):
        assert home[j] == home[i] or guests[j, home[i]]
    assert guests.mean() < 0.5  # and it prunes


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_search.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_search_recall_and_scores(spark):
    rows = vectors(600)
    df = frame(spark, rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("cid", F.lit(2))
    got = hilbert_search.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    valid = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and good(v) and len(v) == 16]
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for at, (q, x) in enumerate(valid):
        if q % 20:
            continue
        rest = sorted(((-float(np.dot(x, y)), i) for n, (i, y) in enumerate(valid) if n != at))[:20]
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        by = dict(valid)
        for _, i, s in own:  # exactly: products summed from first to last
            total_of = 0.0
            for a, b in zip(x.tolist(), by[i].tolist()):
                total_of += a * b
            assert s == total_of
        hits += len({i for _, i in rest} & {i for _, i, _ in own})
        total += 20
    assert hits / total >= 0.9


def test_search_copies_and_ties(spark):
    """More copies than asked for: the smallest keys come back, without the row itself."""
    rows = [(i, [1.0, 0.0], 0) for i in range(50)] + [(100, [0.0, 1.0], 0)]
    got = hilbert_search.search(frame(spark, rows, SCHEMA), F.col("vec_id") == 3, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 4, 5] and {r["score"] for r in got} == {1.0}
    few = hilbert_search.search(frame(spark, rows[-1:] + rows[:2], SCHEMA), F.col("vec_id") == 100, k=5).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in few) == [(1, 0), (2, 1)]
    assert hilbert_search.search(frame(spark, [], SCHEMA), F.lit(True)).collect() == []


def test_search_recall_with_uneven_norms_and_an_outlier(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16))
    x *= (rng.uniform(0.5, 2, 2000) / np.linalg.norm(x, axis=1))[:, None]
    x[1] *= 100 * 2 / np.linalg.norm(x[1])
    df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = hilbert_search.search(df, F.col("vec_id") % 20 == 0, k=20, window=64).collect()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    hits = sum(r["vec_id"] in np.argsort(-score[r["query_id"]])[:20] for r in got)
    assert hits / 2000 >= 0.9, hits / 2000


def test_windows_stay_small_on_clusters(spark, monkeypatch):
    """What the measurement asks for follows the data's structure, not the table's size."""
    rng = np.random.default_rng(6)
    asked = []
    plain = hilbert_search._measured_window
    monkeypatch.setattr(hilbert_search, "_measured_window", lambda *a: asked.append(plain(*a)) or asked[-1])
    for n in (2000, 4000):
        x = np.repeat(rng.normal(size=(n // 25, 16)), 25, axis=0) + rng.normal(0, 0.02, (n, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
        got = hilbert_search.search(df, F.col("vec_id") % 20 == 0, k=20, window=32).collect()
        hits = sum(r["vec_id"] // 25 == r["query_id"] // 25 for r in got)
        assert hits / len(got) >= 0.9
    assert max(asked) < 200


def test_search_huge_and_tiny_vectors(spark):
    rows = [(i, [f * c for c in (1.0, float(i), -2.0)], 0) for i, f in enumerate([1.0, 1e150, 1e-150, 1e200, 1e-200, 1e-320])]
    got = hilbert_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0, k=4).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 1, 2, 4]


def test_rows_without_a_key_are_candidates(spark):
    """They ask nothing, are found, and come after keys at ties."""
    rows = [(20, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.1, 0.9], 1), (None, [5.0, 0.0], 1), (None, [0.9, 0.1], 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hilbert_search.search(df, F.col("vec_id") % 20 == 0, k=3).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(20, 1, None), (20, 2, 1), (20, 3, None)]
    assert [round(r["score"], 4) for r in got] == [5.0, 0.9, 0.9]
    one = hilbert_search.search(df, F.lit(True), k=1)
    assert {r["query_id"] for r in one.collect()} == {20, 1, 2}
