"""Text column expressions. All are JVM-side except the sequence similarity, which Spark has no function for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def null_tokens(text: Column, tokens: Sequence[str] = V.NULL_TOKENS) -> Column:
    """Null where the trimmed text is a token for a missing value; else the text as it is."""
    return F.when(~F.btrim(text, F.lit(" \t\n\r\x0b\x0c")).isin(list(tokens)), text)


def normalise(text: Column, stop: Sequence[str] = V.STOP_WORDS) -> Column:
    """Lower case, single spaces, without stop words; an empty text if nothing else is left."""
    words = F.split(F.btrim(F.lower(text), F.lit(" \t\n\r")), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(list(stop)) & (w != "")), " ")


def chains(text: Column) -> Column:
    """The parts between semicolons, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.btrim(x, F.lit(" \t\n\r"))), lambda x: x != "")


def is_compound(text: Column) -> Column:
    low = F.lower(text)
    return F.greatest(*[low.contains(m).cast("int") for m in V.COMPOUND_MARKS]) == 1


def compound_parts(text: Column) -> Column:
    """The parts of a compound text that are long enough, in order, without repeats; a plain text is its own part.

    The separators take their turns: each splits all parts that those before it left.
    """
    trim = lambda x: F.btrim(x, F.lit(" \t\n\r"))
    split = lambda pattern: lambda p: F.split(p, f"(?i){pattern}")
    parts = F.array(text)
    for pattern in V.COMPOUND_SPLITS:
        pieces = F.transform(parts, split(pattern))
        parts = F.flatten(F.transform(pieces, lambda p: F.when(F.size(p) > 1, F.transform(p, trim)).otherwise(p)))
    return F.array_distinct(F.filter(F.transform(parts, trim), lambda x: F.length(x) >= V.SHORTEST_PART))


def mechanism(text: Column) -> Column:
    return F.substring(F.btrim(text, F.lit(V.MECHANISM_STRIP)), 1, V.MECHANISM_LENGTH)


def confidence(text: Column) -> Column:
    """The first confidence that a text states, in [0, 1]; null if it states none."""
    stated = F.regexp_extract(text, V.CONFIDENCE, 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(stated > 1, stated / 100).otherwise(stated))) + F.when(stated.isNotNull(), 0.0)


def by_label(label: Column) -> Column:
    return F.when(label == 1, "success").otherwise("failure")


def outcome(text: Column, label: Column, words: Mapping[str, str] = V.OUTCOMES) -> Column:
    """What an outcome word means; what the label says if the word is unknown."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.btrim(F.lower(text), F.lit(" \t\n\r"))), by_label(label))


def semantic_outcome(text: Column, label: Column, share: float = V.OUTCOME_SHARE) -> Column:
    """The outcome that enough of a text's distinct words speak for; what the label says otherwise."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    n = F.size(words)
    part = lambda known: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in known]))) / F.greatest(n, F.lit(1))
    good, bad = part(V.SUCCESS_WORDS), part(V.FAILURE_WORDS)
    return F.when((good > bad) & (good >= share), "success").when((bad > good) & (bad >= share), "failure").otherwise(by_label(label))


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity. Apply it to distinct pairs only."""
    return F.pandas_udf(_similar, "double")(a, b)


def _fixed(digits: int):
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else f"{v:.{digits}f}" for v in x], dtype=object)

    return run


def fixed(number: Column, digits: int) -> Column:
    """A number with so many decimals, rounded from its exact binary value: 0.175 is 0.17, where the JVM says 0.18.

    For tables of rules and edges, which are short.
    """
    return F.pandas_udf(_fixed(digits), "string")(number.cast("double"))


def clip(text: Column, length: int, mark: str = "...") -> Column:
    """The text, cut to length with a mark at the end if it is longer."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)


def table_cell(text: Column) -> Column:
    """Fit for a cell of a Markdown table."""
    return F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("&#124;"))
