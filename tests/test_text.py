import re

import pytest
from pyspark.sql import functions as F

from rulemill.functions import text as T
from rulemill.functions import vocabulary as V
from rulemill.operators import graph, triples

TEXTS = [
    "High education and big teams → strong reach → Success",
    "experience → weak margins → growth success investment.; I am 80% confident",
    "skills → focus",
    "press coverage leads to reach resulting in positive",
    "a → b → c; d → e leading to problems and barriers.; ;",
    "roles → x → decreased (40% certainty)",
    "one, two plus three → many → odd words here",
]


@pytest.mark.parametrize("name,pattern", V.CHAIN_PATTERNS)
def test_patterns_match_like_python(spark, name, pattern):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, piece string")
    got = {}
    for r in triples.raw_matches(df, "id", [(name, pattern)]).collect():
        got.setdefault(r["id"], []).append((r["match"], r["feature_text"], r["mechanism_text"], r["outcome_text"]))
    plain = re.compile(pattern.removeprefix("(?im)"), re.I | re.M)
    for i, t in enumerate(TEXTS):
        assert [m[1:] for m in sorted(got.get(i, []))] == plain.findall(t)


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_small_functions(spark):
    assert values(spark, ["  The HIGH  level\tof skill ", "of the", None], T.normalise) == ["level skill", "", None]
    assert values(spark, ["I am 80% confident", "1 confidence", "(40% certainty)", "nothing", "250% confident"], T.confidence) == [0.8, 1.0, 0.4, None, 1.0]
    assert values(spark, ["a; b ;; ;c", "", None], T.chains) == [["a", "b", "c"], [], None]
    # separators take their turns, so that one that a former one left without its blank stays
    assert values(spark, ["a team, and press coverage", "education with and leadership", "first and with second"], T.compound_parts) == [["a team", "press coverage"], ["education with", "leadership"], ["first", "with second"]]
    assert values(spark, ["alpha and beta, gamma plus of AND delta"], T.compound_parts) == [["alpha", "beta", "gamma", "delta"]]
    assert values(spark, [" . x? !", "y" * 600], T.mechanism) == ["x", "y" * 500]
    y = lambda label: lambda c: T.semantic_outcome(c, F.lit(label))
    assert values(spark, ["success growth", "failure here now", "", "problems barriers"], y(1)) == ["success", "success", "success", "failure"]
    assert values(spark, [" Better", "LIMITED", "unknown"], lambda c: T.outcome(c, F.lit(0))) == ["success", "failure", "failure"]


def test_cascade(spark):
    fragments = spark.createDataFrame([(x,) for x in ("the ring", "a shiny red ring", "iron pipe thing", "gadgets", "wibble", "wobbly thing of no kind")], "fragment string")
    got = triples.canonicalise(fragments, {"ring": "ring", "red ring": "red_ring"}, {"metal": ["iron", "pipe"]}, ["gadget", "wibble"])
    assert {r["fragment"]: (r["feature"], r["strategy"]) for r in got.collect()} == {
        "the ring": ("ring", "exact"),
        "a shiny red ring": ("red_ring", "containment"),
        "iron pipe thing": ("metal", "keywords"),
        "gadgets": ("gadget", "fuzzy"),
        "wibble": ("wibble", "name"),
    }


def test_first_match_wins_in_a_chain(spark):
    df = spark.createDataFrame([(1, 1, "ring → shine → success; ring → rust → failure")], "id int, y int, text string")
    parts = triples.parts(triples.raw_matches(triples.chain_table(df, "id", "text", "y"), "id"))
    names = triples.canonicalise(parts, {"ring": "ring"})
    got = triples.first_matches(parts, names, "id", "y").orderBy("chain").collect()
    assert [(r["chain"], r["pattern"], r["mechanism"], r["outcome"]) for r in got] == [(0, "primary", "shine", "success"), (1, "primary", "rust", "failure")]
    edges = graph.edges(triples.first_matches(parts, names, "id", "y"), ("id", "chain"))
    assert sorted((r["feature"], r["outcome"], r["weight"]) for r in edges.collect()) == [("ring", "failure", 1), ("ring", "success", 1)]
    assert {r["id"] for r in graph.nodes(edges).collect()} == {"ring", "success", "failure"}


def test_edges_to_rules_keep_their_order(spark):
    """Top edges are taken before those of unselected features go."""
    rows = [("a", "failure", 50, 1), ("b", "success", 9, 2), ("c", "success", 9, 3), ("d", "success", 1, 4)]
    edges = spark.createDataFrame([(f, o, w, ["m"] * 7, None, None, s) for f, o, w, s in rows], "feature string, outcome string, weight long, mechanisms array<string>, confidence_avg double, confidence_sum double, first_seen int")
    kept, skipped = graph.selected_rules(edges, spark.createDataFrame([("a",), ("b",), ("d",)], "feature string"), top=3)
    assert [r["feature"] for r in kept.orderBy("pos").collect()] == ["b", "d"] and [r["feature"] for r in skipped.collect()] == ["c"]
    rule = graph.rule_templates(kept, {"b": "continuous", "d": "binary"}).orderBy("pos").collect()
    assert rule[0]["rule_id"] == "b_success_9" and rule[0]["condition_template"] == "IF b >= <threshold> THEN P(success) >= <confidence>"
    assert rule[1]["condition_template"] == "IF d == True THEN P(success) >= <confidence>" and rule[1]["threshold_placeholder"] is None
    assert len(rule[0]["mechanisms"]) == 5 and rule[0]["mechanism_count"] == 7


def test_edge_table(spark):
    edges = spark.createDataFrame([("a", "success", 2, ["x" * 700, "y" * 700], 0.5, 0.0, 1)], "feature string, outcome string, weight long, mechanisms array<string>, confidence_avg double, confidence_sum double, first_seen int")
    row = graph.edge_table(edges).first()
    assert len(row["mechanisms"]) == 1003 and row["confidence_avg"] == "0.50" and row["confidence_sum"] == ""
    assert graph.dot(edges).first()["line"] == '"a" -> "success" [penwidth=4];'


def _random_texts(n, seed, letters="abc d"):
    import random

    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(n)})


def test_containment_by_value_equals_all_pairs(spark, monkeypatch):
    norms, phrases = _random_texts(150, 1) + ["long text with a phrase inside of it"], _random_texts(80, 2)
    fragments = spark.createDataFrame([(t,) for t in norms], "norm string")
    table = spark.createDataFrame([(i, p, f"f{i}") for i, p in enumerate(phrases)], "pos int, phrase string, feature string")
    want = {}
    for t in norms:
        scored = [(-(len(p) / max(len(t), 1) if p in t else len(t) / max(len(p), 1)), i) for i, p in enumerate(phrases) if p in t or t in p]
        if scored and -min(scored)[0] > V.CONTAINMENT:
            want[t] = f"f{min(scored)[1]}", -min(scored)[0]
    for most in (100_000, 0):
        monkeypatch.setattr(triples, "_BROADCAST", most)
        got = triples.map_containment(fragments, table)
        assert {r["norm"]: (r["feature"], r["score"]) for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    # many phrases
    many = spark.range(10_000).select(F.col("id").cast("int").alias("pos"), F.format_string("phrase number %05d", "id").alias("phrase"), F.format_string("f%d", "id").alias("feature"))
    texts = spark.createDataFrame([("the phrase number 00042 here",), ("number 0777",), ("nothing",)], "norm string")
    assert {r["norm"]: r["feature"] for r in triples.map_containment(texts, many).collect()} == {"the phrase number 00042 here": "f42", "number 0777": "f7770"}


def test_keywords_by_value_equal_contains(spark):
    norms = _random_texts(150, 3)
    keywords = {"x": ["a", "ab", "ab"], "y": ["d", "c b"], "z": [""]}
    got = {(r["norm"], r["feature"]): r["score"] for r in triples.keyword_scores(spark.createDataFrame([(t,) for t in norms], "norm string"), keywords, blend=False).collect()}
    want = {}
    for t in norms:
        for f, ks in keywords.items():
            if hits := sum(k in t for k in ks):
                want[t, f] = min(1.0, hits / len(ks) * 1.5) if hits > 1 else hits / len(ks)
    assert got == pytest.approx(want)


def test_letters_bound_the_similarity(spark):
    from difflib import SequenceMatcher

    norms, names = _random_texts(120, 4, "abcdefghij kß"), [t for t in _random_texts(25, 5, "abcdefghij kß") if t]
    fragments = spark.createDataFrame([(t,) for t in norms], "norm string")
    selected = spark.createDataFrame(list(enumerate(names)), "pos int, feature string")
    pairs = {(r["norm"], r["feature"]) for r in triples.fuzzy_pairs(fragments, selected, 0.6).collect()}
    apart = {(a, b) for a in norms for b in names if a not in b and b not in a}
    assert pairs <= apart and all((a, b) in pairs for a, b in apart if SequenceMatcher(None, a, b).ratio() >= 0.6)
    assert len(pairs) < 0.35 * len(apart)  # the share that Python sees
    want = {}
    for a in norms:
        best = min(((-(len(b) / max(len(a), 1) if b in a else len(a) / len(b) if a in b else SequenceMatcher(None, a, b).ratio()), i) for i, b in enumerate(names)))
        if -best[0] >= 0.6:
            want[a] = names[best[1]]
    assert {r["norm"]: r["feature"] for r in triples.map_fuzzy(fragments, selected, 0.6).collect()} == want


def test_patterns_tried_once_between_marks_match_as_if_tried_everywhere(spark):
    rng, words = __import__("random").Random(8), ["→", "→", " → ", "ring", "High ", "Lack of ", "success", "Failure", "better", " leads to ", " resulting in ", " for ", ".", "\n", " ", "a,b", "positive"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    chains = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id int, chain int, piece string")
    every = [(n, p.replace("(?im)", "(?mi)", 1)) for n, p in V.CHAIN_PATTERNS]  # not known to begin with anything
    got, want = ([sorted(map(tuple, triples.raw_matches(chains, "id", p, n).collect()))] for p, n in ((V.CHAIN_PATTERNS, V.CHAIN_NEEDS), (every, {})))
    assert got == want and len(got[0]) > 1000 and {r[3] for r in got[0]} == {n for n, _ in V.CHAIN_PATTERNS}


def test_long_chains_without_a_match_cost_their_length(spark):
    import time

    chains = spark.range(40).select("id", F.lit(0).alias("chain"), F.concat(F.repeat(F.lit("word "), 4000), F.lit("leads to "), F.repeat(F.lit("word "), 4000), F.lit("→ x→ y→ other")).alias("piece"))
    began = time.monotonic()
    assert triples.raw_matches(chains, "id", [p for p in V.CHAIN_PATTERNS if p[0] in ("primary", "alternative_1")]).count() == 0
    assert time.monotonic() - began < 20
