"""Queries: cleaning, splitting, encoding and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.numeric import INFINITE, NUMBER
from ..operators import boosting, cleaning, encoding, selection, splitting
from ..sources.tables import as_text
from .registry import query
from .virtual import DIRTY, load

_COLUMNS = ("acctbal", "tier", "flag", "segment")


def _tok(c: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in V.NULL_TOKENS)
    return f"CASE WHEN trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) IN ({tokens}) THEN NULL ELSE {c} END"


def _num(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUMBER}') OR regexp_matches({c}, '{INFINITE}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


_STD = f", std AS (SELECT {', '.join(f'{_tok(c)} AS {c}' for c in ('key', *_COLUMNS))} FROM dirty)"
_CO = f"{_STD}, co AS (SELECT key, CASE WHEN {_num('acctbal')} >= 0 THEN {_num('acctbal')} END AS acctbal, {_num('tier')} AS tier, flag, segment FROM std)"


def _coerced(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.coerce(cleaning.standardise_nulls(load(spark, d, "dirty")), DIRTY)


@query("SELECT key, acctbal, tier, flag, segment FROM dirty", ("dirty",))
def scan_text_cast(spark: SparkSession, d: str) -> DataFrame:
    return as_text(load(spark, d, "dirty"))


@query(f"{_STD} SELECT * FROM std", ("dirty",))
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.standardise_nulls(load(spark, d, "dirty"))


@query(f"{_STD} SELECT key, {_num('acctbal')} AS acctbal FROM std", ("dirty",))
def numeric_coerce(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.standardise_nulls(load(spark, d, "dirty")).select("key", cleaning.number(F.col("acctbal")).alias("acctbal"))


@query(f"{_STD} SELECT 'acctbal' AS \"column\", count(*) FILTER (WHERE {_num('acctbal')} < 0) AS replaced, count(*) FILTER (WHERE {_num('acctbal')} >= 0) AS kept FROM std", ("dirty",))
def invalid_to_null(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.invalid_counts(cleaning.standardise_nulls(load(spark, d, "dirty")), DIRTY)


@query(f"{_CO} SELECT key, {', '.join(f'{c} IS NULL AS {c}_missing' for c in _COLUMNS)} FROM co", ("dirty",))
def missing_flags(spark: SparkSession, d: str) -> DataFrame:
    flagged = cleaning.missing_flags(_coerced(spark, d), DIRTY)
    return flagged.select("key", *[f"{c}_missing" for c in _COLUMNS])


@query(f"{_CO} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM co" for c in _COLUMNS), ("dirty",))
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.null_profile(_coerced(spark, d), list(_COLUMNS)).select("column", "nulls")


@query(f"{_CO} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS rate FROM co" for c in _COLUMNS), ("dirty",))
def missing_rates(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.null_profile(_coerced(spark, d), list(_COLUMNS)).select("column", F.round("rate", 6).alias("rate"))


def _imputed(spark: SparkSession, d: str) -> DataFrame:
    rows = _coerced(spark, d)
    return cleaning.fit(rows, DIRTY).impute(rows)


_MEDIAN = "(SELECT quantile_cont({c}, 0.5) FROM co)"
_MODE = "(SELECT flag FROM co WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)"


@query(f"{_CO} SELECT key, round(coalesce(acctbal, {_MEDIAN.format(c='acctbal')}), 6) AS value FROM co", ("dirty",))
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    return _imputed(spark, d).select("key", F.round("acctbal", 6).alias("value"))


@query(f"{_CO} SELECT key, coalesce(flag, {_MODE}) AS value FROM co", ("dirty",))
def impute_mode(spark: SparkSession, d: str) -> DataFrame:
    return _imputed(spark, d).select("key", F.col("flag").alias("value"))


@query(f"{_CO} SELECT key, coalesce(segment, '') AS value FROM co", ("dirty",))
def impute_const(spark: SparkSession, d: str) -> DataFrame:
    return _imputed(spark, d).select("key", F.col("segment").alias("value"))


@query(
    f"""{_CO}, im AS (SELECT key, coalesce(acctbal, {_MEDIAN.format(c='acctbal')}) AS acctbal, coalesce(tier, {_MEDIAN.format(c='tier')}) AS tier,
    coalesce(flag, {_MODE}) AS flag, coalesce(segment, '') AS segment FROM co)
    SELECT key, round(CAST(CAST(acctbal AS FLOAT) AS DOUBLE), 3) AS acctbal, CAST(trunc(tier) AS INT) AS tier, coalesce({_num('flag')}, 0) <> 0 AS flag, segment FROM im""",
    ("dirty",),
)
def typed_cast(spark: SparkSession, d: str) -> DataFrame:
    rows = _coerced(spark, d)
    model = cleaning.fit(rows, DIRTY)
    cast = model.cast(model.impute(rows))
    return cast.select("key", F.round(F.col("acctbal").cast("double"), 3).alias("acctbal"), F.col("tier").cast("int").alias("tier"), "flag", "segment")


@query("SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, round(avg(label), 6) AS rate FROM orders_labelled", ("orders_labelled",))
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return splitting.class_balance(load(spark, d, "orders_labelled"), "label").withColumn("rate", F.round("rate", 6))


@query(
    "SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1) * (0.98 / 0.02), 6) AS weight FROM items",
    ("items",),
)
def class_weight(spark: SparkSession, d: str) -> DataFrame:
    return splitting.class_weight(load(spark, d, "items"), "label").withColumn("weight", F.round("weight", 6))


_COUNTS = {1: 100, 0: 900}
_SPLIT = """, split_rows AS (SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR) || ':42'), row_id)
    <= CASE label WHEN 1 THEN 100 ELSE 900 END THEN 'test' ELSE 'train' END AS split, label FROM orders_labelled)"""


@query(f"{_SPLIT} SELECT row_id, split, label FROM split_rows", ("orders_labelled",))
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.stratified_split(load(spark, d, "orders_labelled"), "row_id", "label", _COUNTS).select("row_id", "split", "label")


_CHECKS = {
    "rows": ("count(*)", 1000, 1e18),
    "labels_in_range": ("count(*) FILTER (WHERE label NOT IN (0, 1))", 0, 0),
    "positives": ("count(*) FILTER (WHERE label = 1)", 100, 1e18),
    "test_rows": ("count(*) FILTER (WHERE split = 'test')", 1000, 1000),
    "test_positives": ("count(*) FILTER (WHERE split = 'test' AND label = 1)", 100, 100),
    "null_keys": ("count(*) FILTER (WHERE row_id IS NULL)", 0, 0),
    "positive_rate": ("avg(label)", 0.08, 0.12),
    "negatives": ("count(*) FILTER (WHERE label = 0)", 900, 1e18),
    "train_rows": ("count(*) FILTER (WHERE split = 'train')", 7000, 9000),
}


@query(f"{_SPLIT} " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", CAST({e} AS DOUBLE) AS observed, {e} BETWEEN {lo} AND {hi} AS passed FROM split_rows" for k, (e, lo, hi) in _CHECKS.items()), ("orders_labelled",))
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    rows = stratified_split(spark, d)
    test, label = F.col("split") == "test", F.col("label")
    seen = {"rows": F.count("*"), "labels_in_range": F.count_if(~label.isin(0, 1)), "positives": F.count_if(label == 1), "test_rows": F.count_if(test), "test_positives": F.count_if(test & (label == 1)), "null_keys": F.count_if(F.col("row_id").isNull()), "positive_rate": F.avg("label"), "negatives": F.count_if(label == 0), "train_rows": F.count_if(~test)}
    return splitting.checks(rows, {k: (seen[k], float(lo), float(hi)) for k, (_, lo, hi) in _CHECKS.items()})


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer)
    SELECT 'union' AS kind, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL
    SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL
    SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL
    SELECT 'subset', CAST(count(*) = 0 AS BIGINT) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)"""
)
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    a = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("k"))
    b = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"))
    return splitting.set_relations(a, b)


_ITEM_COLUMNS = ("price", "quantity", "discount", "level", "closed", "state")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM items" for c in _ITEM_COLUMNS) + ")", ("items",))
def cardinality_profile(spark: SparkSession, d: str) -> DataFrame:
    return encoding.cardinality(load(spark, d, "items"), _ITEM_COLUMNS)


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 10 THEN 'ordinal' ELSE 'continuous' END AS kind FROM items" for c in _ITEM_COLUMNS[:4])
    + " UNION ALL SELECT 'closed', 'binary' UNION ALL SELECT 'state', 'categorical')",
    ("items",),
)
def feature_types(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "items").select(*_ITEM_COLUMNS)
    counts = {r["column"]: r["distinct"] for r in encoding.cardinality(rows, _ITEM_COLUMNS).collect()}  # a row a column
    kinds = encoding.column_kinds(rows, counts)
    return spark.createDataFrame(sorted(kinds.items()), "column string, kind string")


@query(
    "SELECT kind, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT CASE WHEN count(DISTINCT {c}) <= 10 THEN 'ordinal' ELSE 'continuous' END AS kind FROM items" for c in _ITEM_COLUMNS[:4])
    + " UNION ALL SELECT 'binary' UNION ALL SELECT 'categorical') GROUP BY 1",
    ("items",),
)
def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return encoding.kind_counts(feature_types(spark, d))


#: Names of features, made of parts' names and of what names say about kinds.
_NAMES = "concat(lower(replace(p_name, ' ', '_')), CASE p_partkey % 5 WHEN 0 THEN '_count' WHEN 1 THEN '_Roles' WHEN 2 THEN '_leadership' WHEN 3 THEN '_COMPANY_number' ELSE '' END)"


def _named(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(name), '{w}')" for w in words)


@query(f"SELECT name, CASE WHEN {_named(V.CONTINUOUS_NAMES)} THEN 'continuous' WHEN {_named(V.BINARY_NAMES)} THEN 'binary' ELSE 'ordinal' END AS kind, count(*) AS n FROM (SELECT {_NAMES} AS name FROM part) GROUP BY 1, 2")
def name_kinds(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/part.parquet").select(F.expr(_NAMES).alias("name"))
    return names.groupBy("name", encoding.kind_by_name(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


_EDGES = [0.0, 20000.0, 40000.0, 60000.0, 80000.0, float("inf")]


@query(
    "SELECT CASE WHEN price > 80000 THEN 4 WHEN price > 60000 THEN 3 WHEN price > 40000 THEN 2 WHEN price > 20000 THEN 1 ELSE 0 END AS bin, count(*) AS n, min(price) AS least, max(price) AS most FROM items GROUP BY 1",
    ("items",),
)
def bin_fixed(spark: SparkSession, d: str) -> DataFrame:
    return encoding.bin_profile(load(spark, d, "items"), "price", _EDGES)


@query(
    """, e AS (SELECT quantile_cont(price, 0.2) AS a, quantile_cont(price, 0.4) AS b, quantile_cont(price, 0.6) AS c, quantile_cont(price, 0.8) AS f FROM items)
    SELECT CAST(CAST(price > a AS INT) + CAST(price > b AS INT) + CAST(price > c AS INT) + CAST(price > f AS INT) AS INT) AS bin, count(*) AS n, min(price) AS least, max(price) AS most FROM items, e GROUP BY 1""",
    ("items",),
)
def bin_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "items")
    return encoding.bin_profile(rows, "price", encoding.quantile_edges(rows, "price"))


#: Scales drawn from the levels 1 to 5, each as an expression and with what its codes mean.
_SCALES = {
    "1..5": ("level", {1: "very_low", 2: "low", 3: "medium", 4: "high", 5: "very_high"}),
    "0..4": ("level - 1", {0: "very_low", 1: "low", 2: "medium", 3: "high", 4: "very_high"}),
    "0..3": ("least(level, 4) - 1", {0: "low", 1: "medium_low", 2: "medium_high", 3: "high"}),
    "1..3": ("least(level, 3)", {1: "medium", 2: "high", 3: "level_3"}),
    "1..2": ("least(level, 2)", {1: "yes", 2: "level_2"}),
    "1,2,7": ("CASE WHEN level < 3 THEN level ELSE 7 END", {1: "medium", 2: "high", 7: "level_7"}),
    "2..7": ("level + CASE WHEN level = 5 THEN 2 ELSE 1 END", {2: "low", 3: "medium", 4: "high", 5: "very_high", 7: "level_7"}),
}


@query(
    ", s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS scale, CAST({e} AS INT) AS code FROM items WHERE level > 0" for k, (e, _) in _SCALES.items())
    + ") SELECT scale, code, CASE " + " ".join(f"WHEN scale = '{k}' AND code = {c} THEN '{t}'" for k, (_, names) in _SCALES.items() for c, t in names.items()) + " END AS label, count(*) AS n FROM s GROUP BY ALL",
    ("items",),
)
def ordinal_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "items").where("level > 0").select(*[F.expr(e).cast("int").alias(f"s{i}") for i, (e, _) in enumerate(_SCALES.values())], "label")
    names = [c for c in rows.columns if c != "label"]
    fitted = encoding.fit_encoding(rows, dict.fromkeys(names, "ordinal"), "label")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("scale"), F.col(c).alias("code"), F.col(f"{c}_qual").alias("label")) for k, c in zip(_SCALES, names, strict=True)]))
    return fitted.apply(rows).select(each.alias("s")).groupBy("s.scale", "s.code", "s.label").agg(F.count("*").alias("n"))


_CODES = ", codes AS (SELECT nation AS category, CAST(row_number() OVER (ORDER BY nation) - 1 AS INT) AS code FROM (SELECT DISTINCT nation FROM orders_labelled {where}))"


@query(f"{_CODES.format(where='')} SELECT category, code, count(*) AS n FROM codes JOIN orders_labelled ON nation = category GROUP BY 1, 2", ("orders_labelled",))
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders_labelled")
    codes = encoding.category_codes(rows, "nation")
    return codes.join(rows.groupBy(F.col("nation").alias("category")).agg(F.count("*").alias("n")), "category")


@query(f"{_CODES.format(where='WHERE label = 1')} SELECT nation AS category, CAST(coalesce(code, 0) AS INT) AS code, count(*) AS n FROM orders_labelled LEFT JOIN codes ON nation = category GROUP BY 1, 2", ("orders_labelled",))
def label_encode_transform(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders_labelled")
    coded = encoding.apply_codes(rows, "nation", encoding.category_codes(rows.where("label = 1"), "nation"))
    return coded.groupBy(F.col("nation").alias("category"), F.col("nation_code").alias("code")).agg(F.count("*").alias("n"))


@query(
    """, u AS (SELECT status AS v FROM orders_labelled UNION SELECT priority FROM orders_labelled), codes AS (SELECT v AS category, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM u)
    SELECT category, code, count(*) AS n FROM codes JOIN orders_labelled ON priority = category OR status = category GROUP BY 1, 2""",
    ("orders_labelled",),
)
def label_encode_union(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders_labelled")
    both = rows.select(F.col("status").alias("v")).unionByName(rows.select(F.col("priority").alias("v")))
    return encoding.category_codes(both, "v").join(both.groupBy(F.col("v").alias("category")).agg(F.count("*").alias("n")), "category")


_KINDS = {"balance": "continuous", "tier": "ordinal", "grade": "ordinal", "in_debt": "binary", "segment": "categorical", "priority": "text"}
_ENCODED = """, q AS (SELECT quantile_cont(balance, 0.2) AS a, quantile_cont(balance, 0.4) AS b, quantile_cont(balance, 0.6) AS c, quantile_cont(balance, 0.8) AS f FROM orders_labelled),
    codes AS (SELECT segment AS category, CAST(row_number() OVER (ORDER BY segment) - 1 AS INT) AS code FROM (SELECT DISTINCT segment FROM orders_labelled))
    SELECT balance, CAST(CAST(balance > a AS INT) + CAST(balance > b AS INT) + CAST(balance > c AS INT) + CAST(balance > f AS INT) AS INT) AS balance_bin, grade, tier,
    CASE grade WHEN 0 THEN 'medium' WHEN 1 THEN 'high' WHEN 2 THEN 'level_2' END AS grade_qual,
    CASE tier WHEN 1 THEN 'very_low' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' WHEN 5 THEN 'very_high' END AS tier_qual,
    in_debt, code AS segment, priority, balance_missing, label FROM orders_labelled JOIN codes ON segment = category, q"""


@query(_ENCODED, ("orders_labelled",))
def encode_pipeline(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders_labelled").drop("row_id", "nation", "status")
    return encoding.fit_encoding(rows, _KINDS, "label").apply(rows)


@query("SELECT balance, tier, balance_missing, label FROM orders_labelled", ("orders_labelled",))
def project_selected(spark: SparkSession, d: str) -> DataFrame:
    return encoding.project_selected(load(spark, d, "orders_labelled"), ["balance", "tier", "no_such_column"], "label")


@query()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    return selection.importance(load(spark, d, "items"), ["price", "quantity", "discount", "level"], ["state"], "label", rounds=100, target_rate=0.02)


_BOOST = ("price", "quantity", "discount", "level")
_BINS = 16


def _boost_rows(spark: SparkSession, d: str) -> DataFrame:
    """Items whose price is missing where few were bought."""
    return load(spark, d, "items").withColumn("price", F.when(F.col("quantity") >= 8, F.col("price")))


@query(
    ", b AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {k} AS k, CAST({'CASE WHEN quantity >= 8 THEN price END' if c == 'price' else c} AS DOUBLE) AS x, 0.5 - label AS g, 0.25 AS h FROM items" for k, c in enumerate(_BOOST))
    + f"""), cuts AS (SELECT DISTINCT feature, k, unnest(quantile_cont(x, [{", ".join(f"{i} / {_BINS}" for i in range(1, _BINS))}])) AS cut FROM b GROUP BY feature, k),
    s AS (SELECT feature, k, cut, CAST(coalesce(sum(g) FILTER (WHERE x <= cut), 0) AS DOUBLE) AS gl, CAST(coalesce(sum(h) FILTER (WHERE x <= cut), 0) AS DOUBLE) AS hl, CAST(coalesce(sum(g) FILTER (WHERE x IS NULL), 0) AS DOUBLE) AS gm,
          CAST(coalesce(sum(h) FILTER (WHERE x IS NULL), 0) AS DOUBLE) AS hm, CAST(sum(g) AS DOUBLE) AS g, CAST(sum(h) AS DOUBLE) AS h FROM b JOIN cuts USING (feature, k) GROUP BY feature, k, cut),
    o AS (SELECT feature, k, cut, missing_left, gl + CASE WHEN missing_left THEN gm ELSE 0 END AS gl, hl + CASE WHEN missing_left THEN hm ELSE 0 END AS hl, g, h FROM s, (VALUES (true), (false)) m(missing_left))
    SELECT feature, round(cut, 6) AS cut, missing_left, round((gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) / 2, 6) AS gain, round(hl, 6) AS left_hessian
    FROM o WHERE hl >= 1 AND h - hl >= 1 ORDER BY (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1)) DESC, k, cut, missing_left DESC LIMIT 1""",
    ("items",),
)
def boost_root_split(spark: SparkSession, d: str) -> DataFrame:
    found = selection.root_split(_boost_rows(spark, d), _BOOST, "label", bins=_BINS)
    return found.select("feature", F.round("cut", 6).alias("cut"), "missing_left", F.round("gain", 6).alias("gain"), F.round("left_hessian", 6).alias("left_hessian"))


@query()
def shapley_values(spark: SparkSession, d: str) -> DataFrame:
    """Every row's margin and what each input adds to it."""
    rows = _boost_rows(spark, d)
    model = boosting.fit(rows, _BOOST, "label", rounds=10)
    told = boosting.shapley_values(rows, model, ["row_id"])
    return told.select("row_id", "margin", *[F.get("contributions", i).alias(c) for i, c in enumerate(_BOOST)])


@query()
def training_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """rows, right, accuracy of boosted trees on the rows that they learned from."""
    return selection.training_accuracy(load(spark, d, "items"), list(_BOOST), ["state"], "label", rounds=10, target_rate=None)
