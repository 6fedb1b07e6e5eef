import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from rulemill.functions import text as T
from rulemill.functions.numeric import bin_number, f1, number, precision, ratio, recall
from rulemill.operators import cleaning, encoding, splitting
from rulemill.spec import FeatureSpec, with_open_columns


def column(spark, values, expr, kind="string"):
    """expr over one column of values, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_null_tokens(spark):
    assert column(spark, [" NA ", "-", None, "none", "None", "x", " x "], T.null_tokens) == [None, None, None, "none", None, "x", " x "]


def test_numbers(spark):
    got = column(spark, ["True", "1", " 3 ", "1e3", "abc", "inf", "1_000", "0x1A", "1d", ".5", "5.", "", None, "nan"], number)
    assert got == [None, 1.0, 3.0, 1000.0, None, math.inf, None, None, None, 0.5, 5.0, None, None, None]


def test_fixed_bins(spark):
    values = [-1.0, 0.0, 0.5, 2.0, 2.1, 5.0, 20.0, 20.01, 1e9, None]
    got = column(spark, values, lambda c: bin_number(c, [0, 2, 5, 10, 20, float("inf")]), "double")
    assert got == [0, 0, 0, 0, 1, 1, 3, 4, 4, 0]


def test_quintiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 0, 1, 3, 7)], "v double")
    assert encoding.quantile_edges(df, "v") == [0.0, 1.0, 3.0, math.inf]
    assert encoding.quantile_edges(df.where("v = 7"), "v") == [math.inf]


@pytest.mark.parametrize(
    ("values", "labels"),
    [
        ([1, 2, 3, 4, 5], ["very_low", "low", "medium", "high", "very_high"]),
        ([0, 1, 2, 3, 4], ["very_low", "low", "medium", "high", "very_high"]),
        ([0, 1, 2, 3], ["low", "medium_low", "medium_high", "high"]),
        ([0, 1, 2], ["medium", "high", "level_2"]),
        ([1, 2, 3], ["medium", "high", "level_3"]),
        ([1, 2], ["yes", "level_2"]),
        ([0, 1], ["yes", "level_1"]),
        ([1, 2, 7], ["medium", "high", "level_7"]),
        ([3, 4, 5, 6, 7, 8], [f"level_{v}" for v in range(3, 9)]),
        ([], []),
    ],
)
def test_ordinal_labels(spark, values, labels):
    df = spark.createDataFrame([(v,) for v in [*values, 99, None]], "code int")
    got = {r[0]: r[1] for r in df.select("code", encoding.ordinal_label(F.col("code"), values)).collect()}
    assert got == dict(zip(values, labels)) | {99: None, None: None}


def test_metrics(spark):
    p, r = precision(F.lit(42), F.lit(121)), recall(F.lit(42), F.lit(58))
    got = spark.range(1).select(p, r, f1(p, r), ratio(F.lit(1), F.lit(0))).first()
    assert [round(x, 5) for x in got] == [0.25767, 0.42, 0.31939, 0.0]


SPECS = [FeatureSpec("id", identifier=True), FeatureSpec("x", "continuous", 0.0), FeatureSpec("o", "ordinal"), FeatureSpec("b", "binary"), FeatureSpec("c")]


def test_clean_end_to_end(spark):
    rows = [("1", "1", "1", "1", "a"), ("2", "2", "2", "0", "b"), ("3", "3", "4", "1", "NA"), ("4", "4", "-", "True", "c"), ("5", "-7", "3", None, None)]
    done, model = cleaning.clean(spark.createDataFrame(rows, "id string, x string, o string, b string, c string"), SPECS)
    got = {r["id"]: r for r in done.collect()}
    assert model.values == {"c": "", "x": 2.5, "o": 2.5, "b": "1"}
    assert got["5"]["x"] == 2.5 and got["5"]["x_missing"] and got["4"]["o"] == 2 and got["4"]["o_missing"]  # 2.5 is cut
    assert [got[k]["b"] for k in "12345"] == [True, False, True, False, True]  # the text True is no number
    assert got["3"]["c"] == "" and dict(done.dtypes)["o"] == "tinyint" and "id_missing" not in done.columns


def test_clean_empty_table(spark):
    done, _ = cleaning.clean(spark.createDataFrame([], "id string, x string, o string, b string, c string"), SPECS)
    assert done.collect() == []


def test_mode_ties_and_open_columns(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "b string")
    assert cleaning.fit(df, [FeatureSpec("b", "binary")]).values == {"b": "a"}
    specs, lacking = with_open_columns(SPECS, ["id", "x", "new"])
    assert [s.kind for s in specs] == ["categorical", "continuous", "categorical"] and lacking == ["o", "b", "c"]
    with pytest.raises(ValueError):
        FeatureSpec("x", "other")


def test_split_is_exact_disjoint_and_complete(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    split = splitting.stratified_split(df, "k", "y", {1: 7, 0: 60}).cache()
    got = {(r["split"], r["y"]): r["n"] for r in split.groupBy("split", "y").agg(F.count("*").alias("n")).collect()}
    assert got == {("test", 1): 7, ("test", 0): 60, ("train", 1): 43, ("train", 0): 390}
    assert split.select("k").distinct().count() == 500
    again = splitting.stratified_split(df.repartition(7), "k", "y", {1: 7, 0: 60})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))
    other = splitting.stratified_split(df, "k", "y", {1: 7, 0: 60}, seed=1).where("split = 'test'").select("k")
    assert other.exceptAll(split.where("split = 'test'").select("k")).count() > 0


def test_half_of_all_rows_and_deep_buckets(spark, monkeypatch):
    """Counts of any size: a test part of half the table, buckets split until they are small, too few rows, null keys."""
    rows = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1), (None, 0), (90_000, None)], "k long, y int"))
    want = {v: sorted((hashlib.md5(f"{k}:42".encode()).hexdigest(), k) for k in range(20_000) if (k % 5 == 0) == v) for v in (1, 0)}
    for few in (4096, 2):
        monkeypatch.setattr(splitting, "_FEW", few)
        split = splitting.stratified_split(rows, "k", "y", {1: 2_000, 0: 8_000, 7: 3})
        assert not re.search("Exchange|Sort|Window|Join", split._jdf.queryExecution().executedPlan().toString().replace("WithinJoin", ""))
        test = {(r["y"], r["k"]) for r in split.where("split = 'test'").collect()}
        assert test == {(v, k) for v, n in ((1, 2_000), (0, 8_000)) for _, k in want[v][:n]} and split.count() == 20_003
    assert splitting.stratified_split(rows, "k", "y", {1: 9_999}).where("split = 'test'").count() == 4_000
    assert splitting.stratified_split(rows.limit(0), "k", "y", {1: 1}).collect() == []


def test_codes_of_unseen_categories(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    codes = encoding.category_codes(train, "c")
    assert {r["c"]: r["c_code"] for r in encoding.apply_codes(test, "c", codes).collect()} == {"a": 0, "b": 1, "z": 0, None: 0}


def test_encoding_layout(spark):
    df = spark.createDataFrame([(1.0, 1, True, "a", "t", 0), (2.0, 2, False, "b", None, 1)], "x double, o int, f boolean, c string, note string, y int")
    done = encoding.fit_encoding(df, {"x": "continuous", "o": "ordinal", "f": "binary", "c": "categorical", "note": "text"}, "y", {"x": [0, 1, float("inf")]}).apply(df)
    assert done.columns == ["x", "x_bin", "o", "o_qual", "f", "c", "note", "y"]


def test_any_number_of_categories(spark):
    """Ten thousand names get their codes, and unseen ones 0, without a list of them on the driver."""
    df = spark.range(10_000).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"), F.lit(1).alias("y"))
    fitted = encoding.fit_encoding(df, {"name": "categorical"}, "y")
    both = df.unionByName(spark.createDataFrame([("unseen", 1), (None, 1)], "name string, y int"))
    assert sorted(r["name"] for r in fitted.apply(both).collect()) == sorted([*range(10_000), 0, 0])


def test_kinds_by_name_and_bytes(spark):
    assert encoding.kinds_by_name(["roles_count", "Company_size", "grit", "x"], {"x": "binary"}) == {"roles_count": "continuous", "Company_size": "binary", "grit": "ordinal", "x": "binary"}
    df = spark.createDataFrame([(1, "a")], "b byte, t string")
    assert encoding.column_kinds(df, {"b": 5, "t": 1}) == {"b": "ordinal", "t": "categorical"}
    assert encoding.column_kinds(df, {"b": 5, "t": 1}, byte_flags=True)["b"] == "binary"


def test_modes(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None), ("b", None), ("a", None)], "x string, y string")
    assert cleaning.modes(df, ["x", "y"]) == {"x": "a"} and cleaning.modes(df, []) == {}


def test_fit_reads_its_input_once(spark, tmp_path):
    """An encoding is learned in several passes over a written copy, so that joins before it run once."""
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    rows = spark.range(90).select((F.col("id") % 30).cast("double").alias("x"), (F.col("id") % 3).cast("int").alias("o"), F.concat(F.lit("c"), F.col("id") % 4).alias("c"), F.lit(1).alias("y"))
    fitted = encoding.fit_encoding(rows.mapInArrow(seen, rows.schema), {"x": "continuous", "o": "ordinal", "c": "categorical"}, "y")
    assert passes.value == 90 and fitted.levels == {"o": [0, 1, 2]} and len(fitted.edges["x"]) == 6
    assert fitted.apply(rows).select("c").distinct().count() == 4
