"""License scans by diagonal voting (DataFrame functions only).

Every rolling word k-gram of a document is joined by its hash to the places where templates hold it. A meeting of
document position i and template position j votes for the diagonal i - j, which is where the template would start.
Votes are counted a diagonal, diagonals that lie a few words apart are merged, since words that were added or left out
move what follows, and a merged span counts if enough of the template's k-grams and of the span's own words agree.

The hash is only the join's key: the k-grams themselves are compared too, so a full diagonal is the template's words
one after the other. All that belongs to a document is brought together once, by a number of its row; a document is one
row, so no group is larger than the words of one text.

Defined results: a null text is an empty one; a text with fewer than k words has no spans; repeated rows and null keys
each come back; an empty table gives an empty result; texts are scanned whole; other columns than the key and the text
are not read. A template with fewer than k words is an error. Without templates no document has spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What lies between words: all ASCII that is neither a digit nor a small letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Templates of up to so many characters in all are broadcast; beyond it Spark chooses the join.
_BROADCAST = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """Words to look for. share: the part of its k-grams, in percent, that a span must hold; 100 takes exact places only."""

    label: str
    text: str
    share: int = 60
    base: bool = False


# fixed values: phrases that must stand word by word, and the known openings of public licenses
TEMPLATES = (
    Template("mit", "mit license", 100, True),
    Template("apache", "apache license", 100, True),
    Template("gpl", "general public license", 100, True),
    Template("cc-by-nc", "licensed under cc by nc", 100),
    Template("cc-by", "creative commons attribution", 100),
    Template("mpl", "mozilla public license", 100),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
)


def words(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, other letters as they are. The faster function serves pure ASCII."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, GAP, -1), "")


def _grams(words: Column, k: int) -> Column:
    """The k-gram that starts at each word, null where the text ends before."""
    return F.transform(words, lambda w, i: F.concat(w, *[x for j in range(1, k) for x in (F.lit(" "), F.get(words, i + j))]))


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES, k: int = 2) -> DataFrame:
    """(gram, tno, tpos): the places of all k-grams in the templates; tno -1 meets the empty gram that stands for a document itself."""
    rows = [("", -1, 0)]
    for no, t in enumerate(templates):
        said = t.text.split()
        if len(said) < k:
            raise ValueError(f"template {t.text!r} has fewer than {k} words")
        rows += [(" ".join(said[i : i + k]), no, i) for i in range(len(said) - k + 1)]
    return spark.createDataFrame(rows, "gram string, tno int, tpos int")


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = 2, slack: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_words, places and spans.

    places: where a base template stands word by word, array of (start, label). spans: what any template was found in,
    array of (start, end, label, matched, total), in words with the end exclusive, matched and total in k-grams. Both
    are in the order of their starts.

    slack: how far apart, in words, two diagonals may lie to be merged. Of templates over eight k-grams a diagonal
    needs two votes, so that a frequent pair of words alone builds none. A span must have a vote in half of its words.
    """
    spark = docs.sparkSession
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(F.col(text)).alias("words"))
    # words are counted before they are dealt out, so that no row of a k-gram carries all words of its text
    counted = split.select("row", "key", F.size("words").cast("long").alias("n_words"), _grams(F.col("words"), k).alias("grams"))
    grams = counted.select("row", "key", "n_words", F.posexplode(F.concat(F.array(F.lit("")), F.col("grams"))).alias("pos", "gram"))
    found = template_grams(spark, templates, k).withColumn("h", F.xxhash64("gram")).withColumnRenamed("gram", "said")
    if sum(len(t.text) for t in templates) <= _BROADCAST:
        found = F.broadcast(found)
    # the hash is the join's key; equal hashes with other words don't meet
    hits = grams.withColumn("h", F.xxhash64("gram")).join(found, "h").where("gram = said")
    # one shuffle: what follows groups by row first, so it stays where it is
    near = hits.select("row", "key", "n_words", "tno", "tpos", (F.col("pos") - 1).alias("pos")).repartition("row")
    whose = ["row", "key", "n_words", "tno"]
    diagonals = near.groupBy(*whose, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_list("tpos").alias("met")
    )
    size = _by_template(lambda t: len(t.text.split()) - k + 1, templates)
    strong = diagonals.where((F.col("tno") < 0) | (F.col("votes") >= F.when(size > 8, 2).otherwise(1)))
    exact = _by_template(lambda t: t.share >= 100, templates)
    order = Window.partitionBy(*whose).orderBy("diagonal")
    apart = exact | (F.col("diagonal") - F.lag("diagonal", 1).over(order) > slack)
    merged = strong.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order))
    spans = merged.groupBy(*whose, "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    share = _by_template(lambda t: t.share, templates)
    enough = (F.size("met") * 100 >= share * size) & (F.col("votes") * 2 >= F.col("last") - F.col("first") + 1) & (F.col("tno") >= 0)
    label, base = _by_template(lambda t: t.label, templates), _by_template(lambda t: t.base, templates)
    span = F.struct(F.col("first").cast("long").alias("start"), (F.col("last") + k).cast("long").alias("end"), label.alias("label"), F.size("met").alias("matched"), size.alias("total"))
    place = F.struct(F.col("first").cast("long").alias("start"), label.alias("label"))
    return (
        spans.groupBy("row", F.col("key"), "n_words")
        .agg(F.sort_array(F.collect_list(F.when(enough & base, place))).alias("places"), F.sort_array(F.collect_list(F.when(enough, span))).alias("spans"))
        .select(F.col("key").alias(key), "n_words", "places", "spans")
    )


def _by_template(field: Callable[[Template], object], templates: tuple[Template, ...]) -> Column:
    """The field of the row's template; that of an empty one for rows that stand for a document, which no result reads."""
    return F.get(F.array(*[F.lit(field(t)) for t in (Template("", ""), *templates)]), F.col("tno") + 1)


def labels(found: Column) -> Column:
    """The distinct labels of places or spans, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")


def score(spans: Column) -> Column:
    """The largest share of a template that was found, 0 without any."""
    return F.coalesce(F.array_max(F.transform(spans, lambda s: s["matched"].cast("double") / s["total"])), F.lit(0.0))
