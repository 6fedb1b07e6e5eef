"""From causal texts to (feature, outcome, mechanism, confidence) rows.

Chains, pattern matches and parts of compound features are exploded side by side; only distinct fragments are mapped
to feature names, and the first match of a feature in a chain wins by a window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.tables import importable, materialize


def chain_table(df: DataFrame, key: str, text: str, *carry: str) -> DataFrame:
    """key, chain, piece: the chains of each text."""
    return df.select(key, *carry, F.posexplode(T.chains(F.col(text))).alias("chain", "piece"))


def raw_matches(chains: DataFrame, key: str, patterns: Sequence[tuple[str, str]] = V.CHAIN_PATTERNS, needs: Mapping[str, str] = V.CHAIN_NEEDS) -> DataFrame:
    """All matches of all patterns in each chain: pattern, prio, match, feature_text, mechanism_text, outcome_text.

    outcome_text is empty where an incomplete chain names no outcome. Chains are read once: a pattern finds its whole
    matches, where what it needs is there at all, and groups are read from those. Matching costs far more than moving a
    chain, so chains are dealt out evenly first. Patterns that begin with anything but marks (V.CHAIN_BEGUN) try one place
    between two marks, not each: if they match from a later one, they match from the first. A needed pattern that fails
    spares a chain the whole.
    """
    kind = "array<struct<pattern:string,prio:int,match:int,feature_text:string,mechanism_text:string,outcome_text:string>>"

    def found(prio: int, name: str, pattern: str):
        if pattern in V.CHAIN_BEGUN:
            pattern = pattern.replace("(?im)", "(?im)" + V.CHAIN_BEGIN, 1)
        whole = F.regexp_extract_all("piece", F.lit(pattern), F.lit(0))
        if name in needs:
            whole = F.when(F.col("piece").rlike(needs[name]), whole).otherwise(F.array().cast("array<string>"))
        group = lambda m, g: F.regexp_extract(m, pattern, g)
        return F.transform(whole, lambda m, i: F.struct(F.lit(name).alias("pattern"), F.lit(prio).alias("prio"), i.alias("match"), group(m, 1).alias("feature_text"), group(m, 2).alias("mechanism_text"), group(m, 3).alias("outcome_text"))).cast(kind)

    every = F.concat(*[found(i, n, p) for i, (n, p) in enumerate(patterns)])
    dealt = chains.repartition(int(chains.sparkSession.conf.get("spark.sql.shuffle.partitions")), *chains.columns)
    return dealt.select(*chains.columns, F.explode(every).alias("m")).select(*chains.columns, "m.*")


def parts(matches: DataFrame) -> DataFrame:
    """One row a part of each match's feature text: part, fragment. Written once, as mapping and choosing both read it."""
    whole = F.array(F.col("feature_text"))
    split = F.when(T.is_compound(F.col("feature_text")), T.compound_parts(F.col("feature_text"))).otherwise(whole)
    return materialize(matches.select("*", F.posexplode(split).alias("part", "fragment")), "fragments")


def dictionary(spark, phrases: Mapping[str, str]) -> DataFrame:
    """pos, phrase, feature: a phrase table in its own order."""
    return spark.createDataFrame([(i, p, f) for i, (p, f) in enumerate(phrases.items())], "pos int, phrase string, feature string")


def map_exact(fragments: DataFrame, phrases: DataFrame) -> DataFrame:
    """fragments (norm) with the feature of the phrase they equal."""
    return fragments.join(F.broadcast(phrases), F.col("norm") == F.col("phrase"))


#: Phrases and keywords with up to so many characters in all are broadcast, and so is the index of their substrings if
#: it has up to so many rows; beyond that Spark chooses the join.
_BROADCAST = 100_000


def _substrings(text: Column, lengths: Column) -> Column:
    """The distinct substrings of a text that have one of these lengths (an array of numbers)."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: (n >= 1) & (n <= F.length(text))), of)))


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= _BROADCAST else df


def map_containment(fragments: DataFrame, phrases: DataFrame, least: float = V.CONTAINMENT) -> DataFrame:
    """fragments with the feature of the phrase that covers most, containing or contained; ties to the first phrase.

    Joins by value: a fragment's substrings at the lengths that phrases have meet the phrases, and the phrases'
    substrings meet the fragments. Only substrings that cover more than `least` are made.
    """
    norm, phrase = F.col("norm"), F.col("phrase")
    a, b = F.length(norm), F.length(phrase)
    facts = phrases.agg(F.coalesce(F.collect_set(b), F.array().cast("array<int>")).alias("lengths"), F.coalesce(F.sum(b), F.lit(0)).alias("n"), F.coalesce(F.sum(b * b), F.lit(0)).alias("squares")).first()
    covers = F.filter(F.array(*[F.lit(n) for n in sorted(facts["lengths"])]).cast("array<int>"), lambda n: n > a * F.lit(least))
    cut = fragments.select("*", F.explode(_substrings(norm, covers)).alias("_s"))
    inside = cut.join(_small(phrases, facts["n"]), F.col("_s") == phrase).withColumn("score", (b / a).cast("double"))
    enough = F.sequence(F.greatest(F.lit(1), F.floor(b * F.lit(least)).cast("int")), F.greatest(F.lit(1), b))
    index = phrases.where(b > 0).select("*", F.explode(_substrings(phrase, enough)).alias("_s"))
    around = fragments.join(_small(index, facts["squares"]), norm == F.col("_s")).withColumn("score", (a / b).cast("double"))
    found = inside.drop("_s").unionByName(around.drop("_s"))
    best = Window.partitionBy("norm").orderBy(F.desc("score"), "pos")
    return found.where(F.col("score") > least).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def keyword_scores(fragments: DataFrame, keywords: Mapping[str, Sequence[str]], blend: bool = True) -> DataFrame:
    """norm, pos, feature, score of every feature with a keyword in the fragment.

    The share of keywords found, times 1.5 (1 at most) if more than one is; blended 9 : 1 with the similarity to the
    feature's name if asked for. Substrings at the lengths that keywords have meet them by value.
    """
    spark = importable(fragments.sparkSession)
    norm = F.col("norm")
    rows = [(k, i, f, len(ks)) for i, (f, ks) in enumerate(keywords.items()) for k in ks]
    table = spark.createDataFrame(rows, "keyword string, pos int, feature string, size int")
    lengths = F.array(*[F.lit(n) for n in sorted({len(k) for k, *_ in rows if k})]).cast("array<int>")
    cut = fragments.select("norm", F.explode(F.concat(_substrings(norm, lengths), F.array(F.lit("")))).alias("_s"))
    met = cut.join(_small(table, sum(len(k) + 1 for k, *_ in rows)), F.col("_s") == F.col("keyword"))
    found = met.groupBy("norm", "pos", "feature", "size").agg(F.count("*").alias("hits"))
    share = F.col("hits") / F.col("size")
    score = F.when(F.col("hits") > 1, F.least(F.lit(1.0), share * 1.5)).otherwise(share)
    if blend:
        score = score * 0.9 + T.similarity(norm, F.col("feature")) * 0.1
    return found.select("norm", "pos", "feature", score.alias("score"))


def map_keywords(fragments: DataFrame, keywords: Mapping[str, Sequence[str]], least: float = V.KEYWORDS, blend: bool = True) -> DataFrame:
    best = Window.partitionBy("norm").orderBy(F.desc("score"), "pos")
    return keyword_scores(fragments, keywords, blend).withColumn("_r", F.row_number().over(best)).where((F.col("_r") == 1) & (F.col("score") >= least)).drop("_r")


def letter_counts(text: Column) -> Column:
    """How often each of a to z, 0 to 9 and blank stands in a text, and all else together."""
    signs = "abcdefghijklmnopqrstuvwxyz0123456789 "
    each = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in signs]
    return F.array(*each, F.length(F.translate(text, signs, "")))


def similarity_bound(a: Column, b: Column, of_a: Column, of_b: Column) -> Column:
    """What the sequence similarity of two texts can't exceed: twice their common letters by both lengths."""
    common = F.aggregate(F.zip_with(of_a, of_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2.0 * common / (F.length(a) + F.length(b)))


def fuzzy_pairs(fragments: DataFrame, selected: DataFrame, least: float) -> DataFrame:
    """Pairs of fragments and selected names of which neither contains the other and that may be similar enough.

    Letters are counted once a fragment and once a name.
    """
    norm, name = F.col("norm"), F.col("feature")
    some = fragments.select("*", letter_counts(norm).alias("_of_norm"))
    names = selected.select("*", letter_counts(name).alias("_of_name"))
    # every distinct fragment meets every selected name: a short list, given by hand
    pairs = some.join(F.broadcast(names)).where(~(norm.contains(name) | name.contains(norm)))
    return pairs.where(similarity_bound(norm, name, F.col("_of_norm"), F.col("_of_name")) >= least - 1e-9).drop("_of_norm", "_of_name")


def map_fuzzy(fragments: DataFrame, selected: DataFrame, least: float = V.FUZZY) -> DataFrame:
    """fragments with the selected name (pos, feature) that is nearest: the share contained, else sequence similarity.

    Only pairs whose letters allow the similarity reach the Python function.
    """
    importable(fragments.sparkSession)
    norm, name = F.col("norm"), F.col("feature")
    a, b = F.length(norm), F.length(name)
    held = F.when(norm.contains(name), b / F.greatest(a, F.lit(1))).when(name.contains(norm), a / F.greatest(b, F.lit(1)))
    inside = fragments.join(F.broadcast(selected)).where(norm.contains(name) | name.contains(norm)).withColumn("score", held.cast("double"))
    found = inside.unionByName(fuzzy_pairs(fragments, selected, least).withColumn("score", T.similarity(norm, name)))
    best = Window.partitionBy("norm").orderBy(F.desc("score"), "pos")
    return found.where(F.col("score") >= least).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def canonicalise(fragments: DataFrame, phrases: Mapping[str, str], keywords: Mapping[str, Sequence[str]] | None = None, selected: Sequence[str] = (), text: str = "fragment", fuzzy: bool = True) -> DataFrame:
    """fragment, norm, feature, strategy of the fragments that map: exact phrase, containment, keywords, name, fuzzy name.

    Each strategy counts only for the distinct fragments that those before left over; those that need similarities see
    no others. What a group of strategies found is written, so that the next ones don't repeat it.
    """
    spark = fragments.sparkSession
    own = materialize(fragments.select(F.col(text).alias("fragment")).distinct().withColumn("norm", T.normalise(F.col("fragment"))), "distinct-fragments")
    todo, table, found = own.select("norm").distinct(), dictionary(spark, phrases), None
    names = spark.createDataFrame([(i, f) for i, f in enumerate(selected)], "pos int, feature string")
    groups = [[("exact", lambda x: map_exact(x, table)), ("containment", lambda x: map_containment(x, table))]]
    if keywords:
        groups.append([("keywords", lambda x: map_keywords(x, keywords))])
    if selected:
        groups.append([("name", lambda x: x.join(F.broadcast(names), F.col("norm") == F.col("feature")))])
        if fuzzy:
            groups.append([("fuzzy", lambda x: map_fuzzy(x, names))])
    for steps in groups:
        got = None
        for i, (strategy, step) in enumerate(steps):
            one = step(todo).select("norm", F.struct(F.lit(i).alias("i"), "feature", F.lit(strategy).alias("strategy")).alias("_m"))
            got = one if got is None else got.unionByName(one)
        # the first strategy that maps a fragment; each maps it once
        got = materialize(got.groupBy("norm").agg(F.min("_m").alias("_m")).select("norm", "_m.feature", "_m.strategy"), "mapped-fragments")
        found = got if found is None else found.unionByName(got)
        todo = todo.join(got.select("norm"), "norm", "left_anti")
    return own.join(found, "norm").select("fragment", "norm", "feature", "strategy")


def first_matches(parts_: DataFrame, names: DataFrame, key: str, label: str) -> DataFrame:
    """The triples: of each feature in a chain the first match by pattern, match and part.

    names: fragment, feature. Outcomes of flexible and incomplete patterns are read from their words, others looked up.
    """
    joined = parts_.join(names.select("fragment", "feature"), "fragment")
    order = Window.partitionBy(key, "chain", "feature").orderBy("prio", "match", "part")
    first = joined.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    told, y = F.col("outcome_text"), F.col(label)
    meaning = F.when((F.col("pattern") == "incomplete") & (told == ""), T.by_label(y)).when(F.col("pattern").isin("flexible", "incomplete"), T.semantic_outcome(told, y)).otherwise(T.outcome(told, y))
    return first.select(key, "chain", "pattern", "prio", "match", "part", "feature", T.mechanism(F.col("mechanism_text")).alias("mechanism"), meaning.alias("outcome"), T.confidence(F.col("piece")).alias("confidence"))
