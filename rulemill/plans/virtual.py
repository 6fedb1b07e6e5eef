"""Inputs of the registered queries, drawn from the test tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import FeatureSpec, Rule

SQL = {
    "dirty": """
        SELECT CAST(c_custkey AS STRING) AS key,
               CASE c_custkey % 11 WHEN 0 THEN ' N/A ' WHEN 1 THEN '' WHEN 2 THEN '-' WHEN 3 THEN 'abc' WHEN 4 THEN NULL
                    WHEN 5 THEN ' 3 ' WHEN 6 THEN '1e3' ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) END AS acctbal,
               CASE c_custkey % 7 WHEN 0 THEN ' None ' WHEN 1 THEN 'none' WHEN 2 THEN '1d' ELSE CAST(c_nationkey % 6 AS STRING) END AS tier,
               CASE c_custkey % 5 WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN ' 0 ' WHEN 3 THEN NULL ELSE '1' END AS flag,
               CASE c_custkey % 13 WHEN 0 THEN 'nan' WHEN 1 THEN NULL ELSE c_mktsegment END AS segment
        FROM {customer}""",
    "orders_labelled": """
        SELECT o.o_orderkey AS row_id, o.o_orderstatus AS status, o.o_orderpriority AS priority, c.c_acctbal AS balance,
               c.c_mktsegment AS segment, n.n_name AS nation, CAST(c.c_nationkey % 5 + 1 AS INT) AS tier,
               CAST(o.o_orderkey % 3 AS INT) AS grade, c.c_acctbal < 0 AS in_debt, c.c_acctbal < 100 AS balance_missing,
               CASE WHEN o.o_totalprice > 400000 THEN 1 ELSE 0 END AS label
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "items": """
        SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
                         CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING)) AS row_id, l_extendedprice AS price, l_quantity AS quantity, l_discount AS discount,
               CAST(round(l_discount * 50) AS INT) AS level, l_linestatus = 'F' AS closed, l_linestatus AS state,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
        FROM {lineitem}""",
    "docs": """
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.n_chars > 2000 AS is_long, b.quality AS label, b.toxic
        FROM {documents} d JOIN {labels} b ON d.doc_id = b.doc_id""",
    "causal": """
        SELECT p_partkey AS id, CAST(p_size % 2 AS INT) AS label,
               CASE p_partkey % 7
                 WHEN 0 THEN concat('High ', p_name, ' and ', lower(p_type), ' range → ', p_brand, ' appeal. → success; ', p_name, ' → stock')
                 WHEN 1 THEN concat(p_name, ' → low demand → Failure; extensive ', lower(p_type), ' range → ', p_brand, ' → better')
                 WHEN 2 THEN concat('the ', p_name, ' with ', p_brand, ', plus colour → strong sales growth → success growth investment.; I am ', CAST(p_size AS STRING), '% confident')
                 WHEN 3 THEN concat(p_name, ' leads to ', p_brand, ' reach resulting in positive')
                 WHEN 4 THEN concat(p_name, ' including ', lower(p_type), ' range → shelf space leading to problems and barriers; ')
                 WHEN 5 THEN concat(lower(p_type), ' range → margin → weak (', CAST(p_size AS STRING), '% certainty)')
                 ELSE concat(' ; ', p_name, ' → , price! ? → decreased ;', p_name, ' → again → success') END AS text
        FROM {part}""",
    "turns": "SELECT conv_id, turn, conv_id * 1000 + turn AS id, role, text FROM {conversations}",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")


def duck(name: str) -> str:
    """The SQL of an input with the tables' own names."""
    return SQL[name].format(**{t: t for t in TABLES})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [t for t in TABLES if "{" + t + "}" in SQL[name]]
    return spark.sql(SQL[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


DIRTY = [FeatureSpec("key", identifier=True), FeatureSpec("acctbal", "continuous", 0.0), FeatureSpec("tier", "ordinal"), FeatureSpec("flag", "binary"), FeatureSpec("segment")]

#: Rules over items and docs with given thresholds, in the order in which they are combined.
ITEM_RULES = [
    Rule("r1", "price", "continuous", 90, 60000.0, 0.3, 10),
    Rule("r2", "quantity", "ordinal", 70, 40.0, 0.34, 9),
    Rule("r3", "closed", "binary", 50, True, 0.33, 8),
    Rule("r4", "discount", "continuous", 30, 0.08, 0.32, 7),
    Rule("r5", "state", "categorical", 10, "O", 0.35, 6),
]
DOC_RULES = [
    Rule("d1", "n_chars", "continuous", 9, 2500.0, 0.8, 5),
    Rule("d2", "is_long", "binary", 5, True, 0.8, 4),
    Rule("d3", "lang", "categorical", 3, "en", 0.9, 3),
]
#: Phrases and keywords of the causal texts.
PHRASES = {"ring": "ring", "widget": "widget", "blue bolt": "blue_bolt", "bolt": "bolt", "gear": "gear", "economy range": "economy", "promo range": "promo", "standard range": "standard", "range": "any_range", "colour": "colour", "old anvil": "anvil"}
WORDS = {"metal": ["anvil", "plate", "pipe", "iron"], "trinket": ["gizmo", "ring", "small"], "shelf": ["range", "size", "large"]}
SELECTED = ["ring", "widget", "bolt", "gear", "economy", "promo", "colour", "anvil", "gizmo"]
