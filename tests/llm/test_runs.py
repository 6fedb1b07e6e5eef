"""Runs of rows that share a key: the two passes over long ones lose no link and don't cost their square."""

import random

import pytest
from pyspark.sql import functions as F

from rulemill.llm import long_runs, shingle_join

from .helpers import Union
from .test_pipeline import edited_documents, five_words, similar


def components(n, pairs):
    union = Union(n)
    for a, b in pairs:
        union.join(a, b)
    return [union.find(i) for i in range(n)]


@pytest.mark.parametrize("chunk", [4, 30])
def test_long_runs_equal_brute_force(spark, chunk):
    rng = random.Random(8)
    texts = [t for _, t in edited_documents()]
    base = [f"hot{k}" for k in range(150)]
    for i in range(90):  # a group of near copies, some at the edge of the similarity
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(150)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(words))
    sets = [five_words(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = [(r["a"], r["b"]) for r in shingle_join.near_links(df, chunk=chunk).collect()]
    assert all(a == b or (max(a, b), min(a, b)) in set(near) for a, b in got)
    assert components(len(texts), got) == components(len(texts), near)


def test_a_group_in_one_key_costs_no_square(spark):
    rows = spark.range(400).select(F.lit(0).alias("k"), F.col("id").alias("node"), F.lit(20).cast("long").alias("n"))
    stars = long_runs._at(long_runs._stars(rows.limit(0).drop("n"), rows, ["k"], "node", 16))
    assert stars.count() == 400 + 16 * 20 and stars.groupBy("c", "d").count().agg(F.max("count")).first()[0] < 80
    found = spark.range(397).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
    rest = long_runs._at(long_runs._rest(rows, found, ["k"], "node", 20))
    assert sorted((r["d"], r["side"], r["count"]) for r in rest.groupBy(F.col("d") >= 0, "side").count().toDF("d", "side", "count").collect()) == [(False, 0, 60), (False, 1, 397), (True, 0, 3)]
    whole = found.select("node", "component").unionByName(spark.range(397, 400).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component")))
    assert long_runs._rest(rows, whole, ["k"], "node", 20).isEmpty()


def test_long_texts_are_dealt_by_their_shingles(spark):
    """A chunk is bounded by the shingles of its texts, not only by their number; no link is lost."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        words = list(base)
        for _ in range(15):
            words[rng.randrange(3000)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts + [f"alone {i}" for i in range(5)])), "node long, text string")
    seen = []
    whole, shingle_join.run_links = shingle_join.run_links, lambda short, long, *a: seen.append((short.count(), long.groupBy("k").agg(F.count("*").alias("n"), F.max("n").alias("chunks"), F.sum("load").alias("load")).collect())) or whole(short, long, *a)
    try:
        got = [(r["a"], r["b"]) for r in shingle_join.near_links(df, chunk=8).collect()]  # room for 8192 shingles
    finally:
        shingle_join.run_links = whole
    assert len(set(components(17, got)[:12])) == 1 and len(set(components(17, got))) == 6
    long = [r for r in seen[0][1] if r["n"] == 12]
    assert long and all(r["chunks"] == -(-r["load"] // 8192) >= 4 for r in long)


def test_memory_of_long_texts():
    """A thousand texts of twenty thousand words are dealt in chunks of a million shingles, which take less than 400 MB."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) for _ in range(2 * shingle_join.CHUNK * long_runs.UNIT // 20_000)]
    tracemalloc.start()
    shingle_join.spanning(sets, np.arange(len(sets)) % 2, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e8


def test_hubs_join_by_broadcast(spark):
    """A node with very many neighbours is no join key; components are right."""
    from rulemill.llm import components as C

    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.range(5000, 5400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = {r["node"]: r["component"] for r in C.connected_components(star).collect()}
    assert len(got) == 3000 + 401 and {got[i] for i in range(3000)} == {0} and {got[i] for i in range(5000, 5401)} == {5000}
    edges = star.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    plan = C._large_star(edges, edges.count())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_odd_runs(spark):
    none = spark.range(0).select(F.lit(0).alias("k"), F.col("id").alias("node"), F.lit(2).cast("long").alias("n"))
    link = lambda placed: placed.select(F.col("node").alias("a"), F.col("node").alias("b"))
    assert long_runs.run_links(none.drop("n"), none, ["k"], "node", link, 5).collect() == []
    alone = spark.range(9).select(F.lit(0).alias("k"), F.col("id").alias("node"), F.lit(2).cast("long").alias("n"))
    # nothing is linked: each row still meets each other one
    seen = []

    def record(placed):
        seen.append({(r["c"], r["d"], r["side"], r["node"]) for r in placed.select("c", "d", "side", "node").collect()})
        return link(placed)

    long_runs.run_links(none.drop("n"), alone, ["k"], "node", record, 5, pivots=1).collect()
    met = {(x[3], y[3]) for x in seen[1] for y in seen[1] if x[:2] == y[:2]}
    assert met == {(i, j) for i in range(9) for j in range(9)}


def test_components_equal_union_of_links(spark):
    """Chains, stars, links to itself, repeated links and null ends, held against plain merging of sets."""
    import numpy as np

    from rulemill.llm import components as C

    rng = np.random.default_rng(11)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    pairs += [(2000, 2000 + i) for i in range(60)] + [(5, 5), (3000, 3000), (3000, 3000), (3001, None), (None, None)]
    least: dict[int, int] = {}
    for a, b in pairs:
        if a is not None and b is not None:
            x, y = least.setdefault(a, a), least.setdefault(b, b)
            least = {n: min(x, y) if c in (x, y) else c for n, c in least.items()}
    got = C.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(least) and {r["node"]: r["component"] for r in got} == least
