"""Queries: causal texts to triples, graph and rules; records, batches, replies and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import explaining, graph, ordering, triples
from ..sources import records
from ..sources.tables import materialize
from ..streaming import resume
from .registry import query
from .virtual import PHRASES, SELECTED, WORDS, load

_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _normal(c: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(trim(lower({c}), {_WS}), '\\s+'), lambda w: NOT list_contains({_list(V.STOP_WORDS)}, w) AND w <> ''), ' ')"


def _compound(c: str) -> str:
    marks = " OR ".join(f"contains(lower({c}), '{m}')" for m in V.COMPOUND_MARKS)
    parts = f"[{c}]"
    for p in V.COMPOUND_SPLITS:
        pieces = f"regexp_split_to_array(p, '(?i){p}')"
        parts = f"flatten(list_transform({parts}, lambda p: CASE WHEN len({pieces}) > 1 THEN list_transform({pieces}, lambda x: trim(x, {_WS})) ELSE [p] END))"
    split = f"list_filter(list_transform({parts}, lambda x: trim(x, {_WS})), lambda x: length(x) >= {V.SHORTEST_PART})"
    return f"CASE WHEN {marks} THEN list_filter({split}, lambda x, i: list_position({split}, x) = i) ELSE [{c}] END"


_CHAINS = f", chains AS (SELECT id, label, unnest(range(0, len(l))) AS chain, unnest(l) AS piece FROM (SELECT id, label, list_filter(list_transform(string_split(text, ';'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS l FROM causal))"


def _chains(spark: SparkSession, d: str) -> DataFrame:
    return triples.chain_table(load(spark, d, "causal"), "id", "text", "label")


@query(f"{_CHAINS} SELECT id, CAST(chain AS INT) AS pos, piece FROM chains", ("causal",))
def chain_split(spark: SparkSession, d: str) -> DataFrame:
    return _chains(spark, d).select("id", F.col("chain").alias("pos"), "piece")


_JOINED = "concat(p_name, CASE p_partkey % 7 WHEN 0 THEN ' and ' WHEN 1 THEN ' ,' WHEN 2 THEN ' Plus ' WHEN 3 THEN ', and ' WHEN 4 THEN ' with and ' WHEN 5 THEN ' and with ' ELSE ' ' END, p_brand)"


@query(f"SELECT id, CAST(unnest(range(0, len(l))) AS INT) AS pos, unnest(l) AS piece FROM (SELECT id, {_compound('t')} AS l FROM (SELECT p_partkey AS id, {_JOINED} AS t FROM part))")
def compound_split(spark: SparkSession, d: str) -> DataFrame:
    texts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr(_JOINED).alias("t"))
    split = F.when(T.is_compound(F.col("t")), T.compound_parts(F.col("t"))).otherwise(F.array("t"))
    return texts.select("id", F.posexplode(split).alias("pos", "piece"))


@query(f"{_CHAINS} SELECT id, CAST(chain AS INT) AS pos, {_normal('piece')} AS piece FROM chains", ("causal",))
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _chains(spark, d).select("id", F.col("chain").alias("pos"), T.normalise(F.col("piece")).alias("piece"))


_STRIP = "' ' || chr(9) || chr(10) || chr(13) || '.,;:!?'"


@query(f"SELECT doc_id AS id, 0 AS pos, left(trim(text, {_STRIP}), {V.MECHANISM_LENGTH}) AS piece FROM documents")
def mechanism_clean(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit(0).alias("pos"), T.mechanism(F.col("text")).alias("piece"))


def _confidence(c: str) -> str:
    x = f"TRY_CAST(regexp_extract({c}, '{V.CONFIDENCE}', 1) AS DOUBLE)"
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {x} > 1 THEN {x} / 100 ELSE {x} END)) END"


@query(f"SELECT id, round({_confidence('text')}, 6) AS value FROM causal", ("causal",))
def confidence_extract(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "causal").select("id", F.round(T.confidence(F.col("text")), 6).alias("value"))


def _semantic(c: str, y: str) -> str:
    words = f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''))"
    share = lambda known: f"(len(list_intersect({words}, {_list(known)})) / greatest(len({words}), 1))"
    good, bad = share(V.SUCCESS_WORDS), share(V.FAILURE_WORDS)
    return f"CASE WHEN {good} > {bad} AND {good} >= {V.OUTCOME_SHARE} THEN 'success' WHEN {bad} > {good} AND {bad} >= {V.OUTCOME_SHARE} THEN 'failure' WHEN {y} = 1 THEN 'success' ELSE 'failure' END"


def _outcome(c: str, y: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.OUTCOMES.items())
    return f"CASE trim(lower({c}), {_WS}) {cases} ELSE CASE WHEN {y} = 1 THEN 'success' ELSE 'failure' END END"


@query(f"{_CHAINS} SELECT id, CAST(chain AS INT) AS pos, {_semantic('piece', 'label')} AS outcome FROM chains", ("causal",))
def semantic_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _chains(spark, d).select("id", F.col("chain").alias("pos"), T.semantic_outcome(F.col("piece"), F.col("label")).alias("outcome"))


_WORD = "CASE p_partkey % 5 WHEN 0 THEN ' Success ' WHEN 1 THEN 'worse' WHEN 2 THEN 'LIMITED' WHEN 3 THEN p_name ELSE 'good' END"


@query(f"SELECT p_partkey AS id, {_outcome(_WORD, 'p_size % 2')} AS outcome FROM part")
def outcome_normalise(spark: SparkSession, d: str) -> DataFrame:
    words = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr(_WORD).alias("w"), F.expr("p_size % 2").alias("y"))
    return words.select("id", T.outcome(F.col("w"), F.col("y")).alias("outcome"))


def _groups(pattern: str) -> str:
    return ", ".join(f"regexp_extract_all(piece, '{pattern}', {g}) AS g{g}" for g in (1, 2, 3))


_RAW = (
    f"{_CHAINS}, raw AS ("
    + " UNION ALL ".join(
        f"SELECT id, label, chain, piece, '{name}' AS pattern, {prio} AS prio, unnest(range(0, len(g1))) AS match, unnest(g1) AS feature_text, unnest(g2) AS mechanism_text, coalesce(unnest(g3), '') AS outcome_text FROM (SELECT *, {_groups(pattern)} FROM chains)"
        for prio, (name, pattern) in enumerate(V.CHAIN_PATTERNS)
    )
    + ")"
)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return triples.raw_matches(_chains(spark, d), "id")


@query(f"{_RAW} SELECT id, CAST(chain AS INT) AS chain, pattern, CAST(match AS INT) AS match, feature_text, mechanism_text, outcome_text FROM raw", ("causal",))
def triples_raw(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("id", "chain", "pattern", "match", "feature_text", "mechanism_text", "outcome_text")


_PARTS = f"{_RAW}, parts AS (SELECT *, unnest(range(0, len(l))) AS part, unnest(l) AS fragment FROM (SELECT *, {_compound('feature_text')} AS l FROM raw)), frags AS (SELECT DISTINCT fragment, {_normal('fragment')} AS norm FROM parts)"
_DICT = "(VALUES " + ", ".join(f"({i}, '{p}', '{f}')" for i, (p, f) in enumerate(PHRASES.items())) + ") dict(pos, phrase, feature)"
_COVER = "CASE WHEN contains(norm, phrase) THEN length(phrase) / greatest(length(norm), 1) ELSE length(norm) / greatest(length(phrase), 1) END"
_EXACT = f"exact AS (SELECT DISTINCT norm, feature FROM frags JOIN {_DICT} ON norm = phrase)"
_CONTAIN = f"""contain AS (SELECT norm, feature, score FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, pos) AS r FROM
    (SELECT norm, pos, feature, {_COVER} AS score FROM (SELECT DISTINCT norm FROM frags) JOIN {_DICT} ON contains(norm, phrase) OR contains(phrase, norm)) WHERE score > {V.CONTAINMENT}) WHERE r = 1)"""


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    return triples.parts(_raw(spark, d))


def _norms(spark: SparkSession, d: str) -> DataFrame:
    return _fragments(spark, d).select(T.normalise(F.col("fragment")).alias("norm")).distinct()


@query(f"{_PARTS}, {_EXACT} SELECT norm AS fragment, feature, 1.0::DOUBLE AS score FROM exact", ("causal",))
def phrase_map_exact(spark: SparkSession, d: str) -> DataFrame:
    return triples.map_exact(_norms(spark, d), triples.dictionary(spark, PHRASES)).select(F.col("norm").alias("fragment"), "feature", F.lit(1.0).alias("score"))


@query(f"{_PARTS}, {_CONTAIN} SELECT norm AS fragment, feature, round(score, 6) AS score FROM contain", ("causal",))
def phrase_map_containment(spark: SparkSession, d: str) -> DataFrame:
    return triples.map_containment(_norms(spark, d), triples.dictionary(spark, PHRASES)).select(F.col("norm").alias("fragment"), "feature", F.round("score", 6).alias("score"))


_WORD_ROWS = " UNION ALL ".join(f"SELECT norm, {i} AS pos, '{f}' AS feature, {' + '.join(f'''CAST(contains(norm, '{k}') AS INT)''' for k in ks)} AS hits, {len(ks)} AS size FROM (SELECT DISTINCT norm FROM frags)" for i, (f, ks) in enumerate(WORDS.items()))


@query(
    f"""{_PARTS}, k AS (SELECT *, CASE WHEN hits > 1 THEN least(1.0::DOUBLE, hits / size * 1.5::DOUBLE) ELSE hits / size END AS score FROM ({_WORD_ROWS}) WHERE hits > 0)
    SELECT norm AS fragment, feature, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, pos) AS r FROM k) WHERE r = 1 AND score >= {V.KEYWORDS}""",
    ("causal",),
)
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return triples.map_keywords(_norms(spark, d), WORDS, blend=False).select(F.col("norm").alias("fragment"), "feature", F.round("score", 6).alias("score"))


@query()
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(i, f) for i, f in enumerate(SELECTED)], "pos int, feature string")
    return triples.map_fuzzy(_norms(spark, d), names).select(F.col("norm").alias("fragment"), "feature", F.round("score", 6).alias("score"))


@query()
def canonicalise(spark: SparkSession, d: str) -> DataFrame:
    return triples.canonicalise(_fragments(spark, d), PHRASES, WORDS, SELECTED)


@query(
    f"""{_PARTS}, {_EXACT}, {_CONTAIN}, names AS (SELECT DISTINCT norm, norm AS feature FROM frags WHERE list_contains({_list(SELECTED)}, norm))
    SELECT fragment, f.norm, coalesce(e.feature, c.feature, n.feature) AS feature, CASE WHEN e.feature IS NOT NULL THEN 'exact' WHEN c.feature IS NOT NULL THEN 'containment' ELSE 'name' END AS strategy
    FROM frags f LEFT JOIN exact e USING (norm) LEFT JOIN contain c USING (norm) LEFT JOIN names n USING (norm) WHERE coalesce(e.feature, c.feature, n.feature) IS NOT NULL""",
    ("causal",),
)
def canonicalise_plain(spark: SparkSession, d: str) -> DataFrame:
    """The cascade without the two strategies that need sequence similarities."""
    return triples.canonicalise(_fragments(spark, d), PHRASES, None, SELECTED, fuzzy=False)


_FIRST = f"""{_PARTS}, {_EXACT}, {_CONTAIN}, names AS (SELECT fragment, coalesce(e.feature, c.feature) AS feature FROM frags LEFT JOIN exact e USING (norm) LEFT JOIN contain c USING (norm) WHERE coalesce(e.feature, c.feature) IS NOT NULL),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY id, chain, feature ORDER BY prio, match, part) AS r FROM parts JOIN names USING (fragment)),
    triple AS (SELECT id, chain, pattern, prio, match, part, feature, left(trim(mechanism_text, {_STRIP}), {V.MECHANISM_LENGTH}) AS mechanism,
        CASE WHEN pattern = 'incomplete' AND outcome_text = '' THEN CASE WHEN label = 1 THEN 'success' ELSE 'failure' END WHEN pattern IN ('flexible', 'incomplete') THEN {_semantic('outcome_text', 'label')} ELSE {_outcome('outcome_text', 'label')} END AS outcome,
        {_confidence('piece')} AS confidence FROM firsts WHERE r = 1)"""


def _triples(spark: SparkSession, d: str) -> DataFrame:
    fragments = _fragments(spark, d)
    return triples.first_matches(fragments, triples.canonicalise(fragments, PHRASES), "id", "label")


@query(f"{_FIRST} SELECT id, CAST(chain AS INT) AS chain, pattern, feature, mechanism, outcome FROM triple", ("causal",))
def triples_first_match(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).select("id", "chain", "pattern", "feature", "mechanism", "outcome")


@query(f"{_FIRST} SELECT pattern, count(*) AS n FROM triple GROUP BY 1", ("causal",))
def pattern_usage(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).groupBy("pattern").agg(F.count("*").alias("n"))


_ORDER = ("id", "chain", "prio", "match", "part")
_EDGES = f"""{_FIRST}, edge AS (SELECT feature, outcome, count(*) AS weight, list(mechanism ORDER BY id, chain, prio, match, part, mechanism) AS mechanisms, avg(confidence) AS confidence_avg, sum(confidence) AS confidence_sum,
    min(id) AS first_id, min((id, chain, prio, match, part)) AS first_seen FROM triple GROUP BY 1, 2)"""


def _edges(spark: SparkSession, d: str, *lists: str) -> DataFrame:
    return graph.edges(_triples(spark, d), _ORDER, lists=lists)


@query(f"{_EDGES} SELECT feature, outcome, weight, array_to_string(mechanisms[-10000:], ' | ') AS mechanisms FROM edge WHERE weight >= 1", ("causal",))
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d, "mechanisms").select("feature", "outcome", "weight", F.array_join("mechanisms", " | ").alias("mechanisms"))


@query(f"{_EDGES} SELECT feature, outcome, round(confidence_avg, 6) AS confidence_avg, round(confidence_sum, 6) AS confidence_sum FROM edge", ("causal",))
def edge_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("feature", "outcome", F.round("confidence_avg", 6).alias("confidence_avg"), F.round("confidence_sum", 6).alias("confidence_sum"))


_TWO = "CASE WHEN coalesce({c}, 0) <> 0 THEN printf('%.2f', {c}) ELSE '' END AS {c}"


@query(
    f"""{_EDGES} SELECT feature, outcome, weight, CASE WHEN length(m) > 1000 THEN left(m, 1000) || '...' ELSE m END AS mechanisms, {_TWO.format(c='confidence_avg')}, {_TWO.format(c='confidence_sum')}, n AS mechanism_count
    FROM (SELECT feature, outcome, weight, round(confidence_avg, 9) AS confidence_avg, round(confidence_sum, 9) AS confidence_sum, array_to_string(mechanisms[-10000:], ' | ') AS m, len(mechanisms[-10000:]) AS n FROM edge)""",
    ("causal",),
)
def edge_csv_projection(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d, "mechanisms").withColumn("confidence_avg", F.round("confidence_avg", 9)).withColumn("confidence_sum", F.round("confidence_sum", 9))
    return graph.edge_table(edges)


@query(f"{_EDGES} SELECT DISTINCT feature AS id, 'feature' AS node_type FROM edge UNION ALL SELECT 'success', 'outcome' UNION ALL SELECT 'failure', 'outcome'", ("causal",))
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_edges(spark, d))


@query(f"{_EDGES} SELECT feature AS src, outcome AS dst, weight FROM edge", ("causal",))
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select(F.col("feature").alias("src"), F.col("outcome").alias("dst"), "weight")


@query()
def graph_layout(spark: SparkSession, d: str) -> DataFrame:
    """Where the nodes of the causal graph are drawn."""
    edges = materialize(_edges(spark, d).select("feature", "outcome"), "layout-edges")
    return graph.layout(edges, materialize(graph.nodes(edges), "layout-nodes"))


@query(
    f"""{_EDGES} SELECT 'edges' AS metric, CAST(count(*) AS DOUBLE) AS value FROM edge UNION ALL SELECT 'total_weight', CAST(sum(weight) AS DOUBLE) FROM edge UNION ALL SELECT 'min_weight', CAST(min(weight) AS DOUBLE) FROM edge
    UNION ALL SELECT 'max_weight', CAST(max(weight) AS DOUBLE) FROM edge UNION ALL SELECT 'avg_weight', round(avg(weight), 6) FROM edge UNION ALL SELECT 'feature_nodes', CAST(count(DISTINCT feature) AS DOUBLE) FROM edge UNION ALL SELECT 'outcome_nodes', 2.0::DOUBLE""",
    ("causal",),
)
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return graph.statistics(edges, graph.nodes(edges)).withColumn("value", F.round("value", 6))


_RANKED = f"{_EDGES}, ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN outcome = 'success' THEN 0 ELSE 1 END, weight DESC, first_seen, feature, outcome) AS INT) AS pos FROM edge)"
_TOP = 12


@query(f"{_RANKED} SELECT pos, feature, outcome, weight FROM ranked", ("causal",))
def edges_prioritised(spark: SparkSession, d: str) -> DataFrame:
    return graph.prioritised(_edges(spark, d))


@query(f"{_EDGES} SELECT feature, outcome, weight FROM edge ORDER BY weight DESC, feature, outcome LIMIT 5", ("causal",))
def edges_top(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("feature", "outcome", "weight").orderBy(F.desc("weight"), "feature", "outcome").limit(5)


def _picked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.selected_rules(_edges(spark, d, "first_mechanisms"), spark.createDataFrame([(s,) for s in SELECTED], "feature string"), _TOP)


_KEPT = f"{_RANKED}, kept AS (SELECT * FROM ranked WHERE pos <= {_TOP} AND list_contains({_list(SELECTED)}, feature))"


@query(f"{_KEPT} SELECT pos, feature, outcome, weight FROM kept", ("causal",))
def rules_semi(spark: SparkSession, d: str) -> DataFrame:
    return _picked(spark, d)[0].select("pos", "feature", "outcome", "weight")


@query(f"{_RANKED} SELECT pos, feature, outcome, weight FROM ranked WHERE pos <= {_TOP} AND NOT list_contains({_list(SELECTED)}, feature)", ("causal",))
def rules_skipped_anti(spark: SparkSession, d: str) -> DataFrame:
    return _picked(spark, d)[1].select("pos", "feature", "outcome", "weight")


_KINDS = {"ring": "continuous", "widget": "ordinal", "gear": "binary", "bolt": "binary"}
_KIND = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " ELSE 'categorical' END"
_FORM = "CASE WHEN feature_type = 'binary' THEN 'binary_' || outcome ELSE feature_type END"
_TEXT = "CASE form " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TEMPLATES.items()) + " END"
_HOLD = "CASE feature_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.PLACEHOLDERS.items()) + " END"
_RULES = f"""{_KEPT}, rule AS (SELECT pos, concat_ws('_', feature, outcome, weight) AS rule_id, feature, feature_type, outcome, weight, replace(replace({_TEXT}, '{{feature}}', feature), '{{outcome}}', outcome) AS condition_template,
    {_HOLD} AS threshold_placeholder, array_to_string(mechanisms[1:5], ' | ') AS mechanisms, CAST(len(mechanisms) AS BIGINT) AS mechanism_count FROM (SELECT *, {_FORM} AS form FROM (SELECT *, {_KIND} AS feature_type FROM kept)))"""


def _templates(spark: SparkSession, d: str) -> DataFrame:
    return graph.rule_templates(_picked(spark, d)[0], _KINDS)


@query(f"{_RULES} SELECT * FROM rule", ("causal",))
def rule_templates(spark: SparkSession, d: str) -> DataFrame:
    return _templates(spark, d).withColumn("mechanisms", F.array_join("mechanisms", " | "))


@query(f"{_RULES} SELECT 'feature_type:' || feature_type AS dimension, count(*) AS n FROM rule GROUP BY 1 UNION ALL SELECT 'outcome:' || outcome, count(*) FROM rule GROUP BY 1", ("causal",))
def rule_stats(spark: SparkSession, d: str) -> DataFrame:
    each = F.explode(F.array(F.concat(F.lit("feature_type:"), F.col("feature_type")), F.concat(F.lit("outcome:"), F.col("outcome"))))
    return _templates(spark, d).select(each.alias("dimension")).groupBy("dimension").agg(F.count("*").alias("n"))


@query(f"{_RULES} SELECT rule_id, feature, outcome, weight, mechanisms FROM rule", ("causal",))
def rules_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lines = _templates(spark, d).select(F.to_json(F.struct("rule_id", "feature", "outcome", "weight", "mechanisms")).alias("line"))
    return lines.select(F.from_json("line", "rule_id string, feature string, outcome string, weight bigint, mechanisms array<string>").alias("r")).select("r.rule_id", "r.feature", "r.outcome", "r.weight", F.array_join("r.mechanisms", " | ").alias("mechanisms"))


@query("SELECT doc_id AS row_id, CAST(to_json(struct_pack(lang := lang, source := source, n_chars := n_chars, is_long := is_long)) AS VARCHAR) AS features_json, label FROM docs", ("docs",))
def feature_records(spark: SparkSession, d: str) -> DataFrame:
    return records.as_records(load(spark, d, "docs"), "doc_id", ["lang", "source", "n_chars", "is_long"], "label")


@query(
    """SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, min(id) AS first_id, max(id) AS last_id
    FROM (SELECT (row_number() OVER (ORDER BY id) - 1) // 30 AS batch, id FROM turns) WHERE batch < 17 GROUP BY 1""",
    ("turns",),
)
def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    numbered = ordering.number_rows(load(spark, d, "turns").select("id"), "id")
    return ordering.batches(numbered).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query()
def explain_batches(spark: SparkSession, d: str) -> DataFrame:
    return explaining.explain(feature_records(spark, d))


@query(
    """, r AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 30 AS batch, len(list_filter(regexp_split_to_array(CAST(to_json(struct_pack(lang := lang, source := source, n_chars := n_chars, is_long := is_long)) AS VARCHAR), '\\s+'), lambda w: w <> '')) AS words FROM docs)
    SELECT CAST(count(DISTINCT batch) AS BIGINT) AS batches, CAST(0 AS BIGINT) AS failed, CAST(count(DISTINCT batch) AS BIGINT) AS calls, CAST(0 AS BIGINT) AS retries, CAST(sum(words) AS BIGINT) AS prompt_tokens, CAST(sum(words + 6) AS BIGINT) AS reply_tokens FROM r""",
    ("docs",),
)
def explain_counters(spark: SparkSession, d: str) -> DataFrame:
    """Calls, retries and words of explanations of all documents in batches of 30, by the template."""
    numbered = ordering.batches(ordering.number_rows(feature_records(spark, d), "row_id"), 30, None)
    return explaining.counted(explaining.explain(numbered, batch="batch", keep=("batch",), counted=True))


@query("SELECT doc_id AS row_id, label, text AS explanation, n_chars FROM docs", ("docs",))
def explain_join(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "docs")
    told = docs.select(F.col("doc_id").alias("row_id"), F.lit(0).alias("label"), F.col("text").alias("explanation"))
    joined = explaining.attach(told, records.as_records(docs, "doc_id", ["n_chars"], "label"))
    return joined.select("row_id", "label", "explanation", F.get_json_object("features_json", "$.n_chars").cast("long").alias("n_chars"))


_REPLY = """CASE event_id % 7 WHEN 0 THEN concat('[{"index":', CAST(event_id AS STRING), ',"text":"', repeat('ab', 40), '"}]')
    WHEN 1 THEN 'no list' WHEN 2 THEN concat('[{"index":', CAST(event_id AS STRING), '}]') WHEN 3 THEN concat('[{"index":-1,"text":"', repeat('x', 90), '"}]')
    WHEN 4 THEN concat('[{"index":', CAST(event_id AS STRING), ',"text":"short"}]') WHEN 5 THEN concat('[{"index":', CAST(event_id AS STRING), ',"text":"', repeat('y', 2001), '"}]') ELSE '[]' END"""


@query(
    f"""WITH e AS (SELECT event_id AS id, {_REPLY} AS reply FROM events), j AS (SELECT id, reply, starts_with(reply, '[') AS ok FROM e)
    SELECT id, CASE WHEN NOT ok THEN 'not_array' WHEN json_array_length(reply) <> 1 THEN 'wrong_count' WHEN json_extract_string(reply, '$[0].index') IS NULL OR json_extract_string(reply, '$[0].text') IS NULL THEN 'missing_field'
    WHEN CAST(json_extract_string(reply, '$[0].index') AS BIGINT) <> id THEN 'bad_index' WHEN length(json_extract_string(reply, '$[0].text')) < 70 THEN 'too_short' WHEN length(json_extract_string(reply, '$[0].text')) > 2000 THEN 'too_long' ELSE 'ok' END AS status
    FROM (SELECT id, ok, CASE WHEN ok THEN reply ELSE '[]' END AS reply FROM j)"""
)
def llm_response_validate(spark: SparkSession, d: str) -> DataFrame:
    replies = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.expr(_REPLY).alias("reply"))
    return replies.select("id", records.reply_status(F.col("reply"), F.array("id")).alias("status"))


_LINE = """CASE doc_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN '{"index": 1, "success_label"' WHEN 2 THEN '{"index": 1, "causal_cot": "there is no label"}' WHEN 3 THEN '[1, 2]'
    WHEN 4 THEN '{"index": 1, "success_label": 1, "causal_cot": "short"}' WHEN 5 THEN concat('{"index": 1, "success_label": 1, "causal_cot": "', repeat('x', 5001), '"}')
    WHEN 6 THEN concat('{"index": ', CAST(doc_id AS STRING), ', "success_label": 0, "causal_cot": "', lang, ' leads to ', source, '"}') ELSE '{"index": null, "success_label": 1, "causal_cot": "a null index"}' END"""


@query(
    f"""WITH l AS (SELECT doc_id AS id, {_LINE} AS line FROM documents)
    SELECT id, CASE WHEN trim(line) = '' THEN 'blank' WHEN NOT json_valid(line) OR NOT starts_with(line, '{{') THEN 'malformed' WHEN json_extract_string(j, '$.index') IS NULL OR json_extract_string(j, '$.success_label') IS NULL OR json_extract_string(j, '$.causal_cot') IS NULL THEN 'missing_field'
    WHEN length(json_extract_string(j, '$.causal_cot')) < 10 THEN 'too_short' WHEN length(json_extract_string(j, '$.causal_cot')) > 5000 THEN 'too_long' ELSE 'ok' END AS status FROM (SELECT id, line, CASE WHEN json_valid(line) THEN line END AS j FROM l)"""
)
def jsonl_validate(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.expr(_LINE).alias("line"))
    return lines.select("id", records.line_status(F.col("line")).alias("status"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


_DONE = "id < 100000 AND conv_id % 2 = 0"


@query(f"SELECT CAST(coalesce(max(id), -1) AS BIGINT) AS last FROM turns WHERE {_DONE}", ("turns",))
def resume_point(spark: SparkSession, d: str) -> DataFrame:
    return resume.resume_point(load(spark, d, "turns").where(_DONE), "id")


@query(
    f""", b AS (SELECT (row_number() OVER (ORDER BY id) - 1) // 30 AS batch, id FROM turns), s AS (SELECT batch, count(*) AS n, min(id) AS a, max(id) AS z FROM b GROUP BY 1), l AS (SELECT coalesce(max(id), -1) AS last FROM turns WHERE {_DONE})
    SELECT CAST(batch AS BIGINT) AS batch, n, CASE WHEN z <= last THEN 'skip' WHEN a <= last THEN 'redo' ELSE 'run' END AS action FROM s, l""",
    ("turns",),
)
def resume_pending_batches(spark: SparkSession, d: str) -> DataFrame:
    turns = load(spark, d, "turns")
    batched = ordering.batches(ordering.number_rows(turns.select("id"), "id"), first=None)
    return resume.pending_batches(batched, turns.where(_DONE), "id")


@query("SELECT conv_id AS id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM turns) WHERE r = 1", ("turns",))
def dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return resume.last_wins(load(spark, d, "turns"), ["conv_id"], "turn").select(F.col("conv_id").alias("id"), "text")
