import random

import pytest

from rulemill.operators.cumulative import quantiles, running_sums


@pytest.mark.parametrize("ranges", [2, 7, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, ranges, descending):
    """Exact wherever the ranges are cut, in the middle of a group too."""
    own = {"spark.sql.shuffle.partitions": str(ranges), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    rng = random.Random(ranges)
    rows = [(g, float(v) ** 3, rng.randint(0, 9)) for g in "ab" for v in rng.sample(range(-300, 300), 150)] + [("c", 1.0, 5)]
    got = running_sums(spark.createDataFrame(rows, "g string, v double, n long"), "g", "v", ["n"], descending).collect()
    for k, v in old.items():
        spark.conf.set(k, v)
    assert len(got) == len(rows)
    for r in got:
        assert r["n_run"] == sum(n for g, v, n in rows if g == r["g"] and (v >= r["v"] if descending else v <= r["v"]))


def test_quantiles_equal_numpy(spark):
    import numpy as np

    rng = random.Random(0)
    rows = [(float(rng.randint(0, 40)) if rng.random() < 0.8 else None, rng.random() * 1e6, None) for _ in range(501)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(spark.createDataFrame(rows, "x double, y double, z double"), ["x", "y", "z"], shares)
    assert got["z"] == []
    for c, k in (("x", 0), ("y", 1)):
        assert np.allclose(got[c], np.quantile([r[k] for r in rows if r[k] is not None], shares))
    assert quantiles(spark.createDataFrame([], "x double"), ["x"], shares) == {"x": []}


def test_quantiles_by_bounds(spark, monkeypatch):
    """Large columns, heavy ties, NaN and infinities; the bounds may miss, and a stretch may need further sketches."""
    import numpy as np

    from pyspark.sql import functions as F

    from rulemill.operators import cumulative

    rows = spark.range(60_000).select(
        F.hash("id").cast("double").alias("wide"), F.when(F.col("id") % 2 == 0, 5.0).otherwise((F.col("id") % 1000).cast("double")).alias("tied"),
        F.when(F.col("id") % 3 == 0, float("inf")).when(F.col("id") % 3 == 1, float("nan")).otherwise(F.col("id").cast("double")).alias("odd"), F.lit(2.0).alias("same"),
    )
    shares = [0.0, 0.2, 0.25, 0.5, 0.50001, 0.8, 1.0]
    own = rows.toPandas()
    for accuracy, around, few in ((10_000, 0.0005, 1_000), (50, 0.0001, 100)):
        monkeypatch.setattr(cumulative, "_ACCURACY", accuracy)
        monkeypatch.setattr(cumulative, "_AROUND", around)
        monkeypatch.setattr(cumulative, "_FEW", few)
        got = quantiles(rows, ["wide", "tied", "same"], shares)
        for c in ("wide", "tied", "same"):
            assert np.allclose(got[c], np.quantile(own[c], shares)), c
        odd = quantiles(rows, ["odd"], [0.1, 0.5, 0.9])["odd"]
        low = np.sort(own["odd"])[5999:6001]
        assert odd[0] == pytest.approx(low[0] + (low[1] - low[0]) * 0.9, abs=0.01)
        assert odd[1] == float("inf") and np.isnan(odd[2])



def test_later_passes_read_open_columns_only(spark, monkeypatch):
    """A column with few values is done after the first counts; the one with many is looked at alone."""
    import numpy as np

    from pyspark.sql import functions as F

    from rulemill.operators import cumulative

    passes, keep = [], cumulative._by_cell
    monkeypatch.setattr(cumulative, "_by_cell", lambda *a: passes.append(keep(*a)) or passes[-1])
    read = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(cumulative, "_FEW", 100)
    monkeypatch.setattr(cumulative, "_ACCURACY", 50)
    rows = spark.range(20_000).select((F.col("id") % 7).cast("double").alias("few"), F.hash("id").cast("double").alias("many"))
    got, own = quantiles(rows, ["few", "many"], [0.2, 0.5]), rows.toPandas()
    assert all(np.allclose(got[c], np.quantile(own[c], [0.2, 0.5])) for c in ("few", "many"))
    assert len(passes) > 2 and "hash(" in read(passes[0]) and all("% 7" not in read(p) for p in passes[1:]) and "% 7" in read(passes[0])
