"""Secret scans with an incremental blob ledger (DataFrame functions only).

Every version of every file is addressed by the SHA-256 of its content. A ledger holds the pairs of blob and rule
version that were scanned, with their findings. A run reads the stored ledger, scans only the pairs it lacks, each
blob once however many paths hold it, appends them, and joins the ledger's findings back to all paths.

Defined results: a null text is an empty one and has no findings; equal texts share a blob; repeated rows and null
keys each come back; an empty table gives an empty result; texts are scanned whole. Other columns pass through in
`redact_documents` and are not read otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose group is shorter than least are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: In the order in which spans with the same start are listed.
RULES = (
    # least characters of hex and access are in the pattern: the first long enough match starts where the run starts
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[opsu]_[A-Za-z0-9]{36,}"),
)
_SPANS = "array<struct<start:bigint,kind_no:int,end:bigint>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: Column, rule: Rule, no: int) -> Column:
    """For each match its number, the length of the text since the match before, its own length, and whether it counts."""
    pattern = F.lit(rule.pattern)
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    rows = F.transform(
        F.sequence(F.lit(0), F.size(found) - 1),
        lambda i: F.struct(F.lit(no).alias("kind_no"), i.alias("i"), F.length(F.get(gaps, i)).cast("long").alias("gap"), F.length(F.get(found, i)).cast("long").alias("len"), (F.length(F.get(held, i)) >= rule.least).alias("ok")),
    )
    return F.when(text.rlike(rule.pattern), rows)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans (blob_id, text, pending: names of kinds); returns (blob_id, spans) of blobs that have findings.

    Positions count code points. Spark has no function that gives positions of matches, so they are summed up from the
    lengths of the matches and of the pieces between them, in a window over the matches of one blob and kind.
    """
    none = F.array().cast("array<struct<kind_no:int,i:int,gap:bigint,len:bigint,ok:boolean>>")
    found = F.concat(*[F.coalesce(F.when(F.array_contains("pending", r.kind), _matches(F.col("text"), r, no)), none) for no, r in enumerate(rules)])
    upto = Window.partitionBy("blob_id", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blobs.select("blob_id", F.explode(found).alias("m")).select("blob_id", "m.*")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).where("ok").withColumn("start", F.col("end") - F.col("len"))
    return placed.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "end"))).cast(_SPANS).alias("spans"))


def _now(rules: tuple[Rule, ...]) -> Column:
    """The kinds with their present versions."""
    return F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.lit("").alias("blob_id"), F.lit("").alias("kind"), F.lit(0).alias("version"), F.array().cast(_SPANS).alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """One incremental run: the new ledger rows (blob_id, kind, version, spans) of pairs that the ledger lacks.

    Each unseen pair gets a row even without findings, so that it is never scanned again. Identities are compared
    first, and only texts of blobs with an unseen pair move. Copies of a blob meet in a partial aggregation before the
    shuffle, so a blob with very many copies is no hot key.
    """
    blobs = versions.select(blob_id(F.col(text)).alias("blob_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = F.array(*[F.lit(r.kind) for r in rules])
    ids = blobs.select("blob_id").distinct()
    if ledger is None:
        todo = ids.withColumn("pending", every)
        pending = blobs.groupBy("blob_id").agg(F.first("text").alias("text")).withColumn("pending", every)
    else:
        seen = ledger.where(F.array_contains(_now(rules), F.struct("kind", F.col("version").cast("int").alias("version")))).groupBy("blob_id").agg(F.collect_set("kind").alias("_seen"))
        lacks = F.array_except(every, F.coalesce("_seen", F.array().cast("array<string>")))
        todo = materialize(ids.join(seen, "blob_id", "left").select("blob_id", lacks.alias("pending")).where(F.size("pending") > 0), "unseen-blobs")
        pending = blobs.join(todo.select("blob_id"), "blob_id", "left_semi").groupBy("blob_id").agg(F.first("text").alias("text")).join(todo, "blob_id")
    found = materialize(scan_blobs(pending, rules), "findings")
    kinds = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(no).alias("no")) for no, r in enumerate(rules)])
    one = todo.join(found, "blob_id", "left").select("blob_id", "spans", F.explode(F.filter(kinds, lambda k: F.array_contains("pending", k["kind"]))).alias("k"))
    own = F.filter(F.coalesce("spans", F.array().cast(_SPANS)), lambda s: s["kind_no"] == F.col("k.no"))
    return one.select("blob_id", "k.kind", "k.version", own.alias("spans"))


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """One run against the ledger stored at path: scans what it lacks, appends that, and returns the whole ledger.

    A ledger that isn't there yet starts empty. Spark commits the appended rows as a whole, so a run that fails leaves
    the ledger as it was; of two runs at once both may append a pair, which `ledger_spans` takes once.
    """
    spark = versions.sparkSession
    empty_ledger(spark).write.mode("ignore").parquet(path)
    stored = spark.read.schema(empty_ledger(spark).schema).parquet(path)
    scan_versions(versions, stored, rules, text).write.mode("append").parquet(path)
    return spark.read.schema(stored.schema).parquet(path)


def ledger_spans(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, spans) of blobs with findings, from ledger rows of the rules' present versions.

    A span's kind_no is the rule's place in rules, whatever place it had when it was scanned.
    """
    number = F.create_map(*[x for no, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(no))])
    rows = ledger.where(F.array_contains(_now(rules), F.struct("kind", F.col("version").cast("int").alias("version"))) & (F.size("spans") > 0))
    placed = rows.select("blob_id", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(number, F.col("kind")).alias("kind_no"), s["end"].alias("end"))).alias("spans"))
    found = placed.groupBy("blob_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).cast(_SPANS).alias("spans"))
    # written: a join with it then meets a table of findings only, and may split a blob with many paths
    return materialize(found, "ledger-spans")


def findings_by_path(versions: DataFrame, spans: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every row of versions (its keys) with the spans of its blob, null without findings."""
    return versions.select(*keys, blob_id(F.col(text)).alias("blob_id")).join(spans, "blob_id", "left")


def describe(spans: Column, rules: tuple[Rule, ...] = RULES, base: bool = False) -> Column:
    """kind:start:end of the spans by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    chosen = F.filter(spans, lambda s: s["kind_no"].isin([no for no, r in enumerate(rules) if r.base])) if base else spans
    return F.coalesce(F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))


def count_kind(spans: Column, kind: str, rules: tuple[Rule, ...] = RULES) -> Column:
    no = [r.kind for r in rules].index(kind)
    return F.coalesce(F.size(F.filter(spans, lambda s: s["kind_no"] == no)), F.lit(0)).cast("long")


def _merged(spans: Column) -> Column:
    """Spans joined where they overlap or touch."""
    kind = "array<struct<start:bigint,end:bigint>>"
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(pair(last["start"], F.greatest(last["end"], s["end"]))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(pair(s["start"], s["end"]))))

    first = F.slice(F.transform(spans, lambda s: pair(s["start"], s["end"])), 1, 1)
    return F.aggregate(F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))), first.cast(kind), add)


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every stretch covered by spans replaced by mask; unchanged without spans."""
    parts = _merged(spans)
    at = F.transform(parts, lambda p, i: F.concat(F.substring(text, F.when(i == 0, F.lit(1)).otherwise(F.get(parts, i - 1)["end"].cast("int") + 1), (p["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(parts, i - 1)["end"])).cast("int")), F.lit(mask)))
    last = F.element_at(parts, -1)["end"].cast("int")
    return F.when(F.size(spans) > 0, F.concat(F.array_join(at, ""), F.substring(text, last + 1, F.length(text)))).otherwise(text)


def redact_documents(docs: DataFrame, spans: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with the secrets of their texts masked; all rows and columns stay."""
    own, found = free_names(docs, "_blob", "_spans")
    keyed = docs.withColumn(own, blob_id(F.col(text))).join(spans.select(F.col("blob_id").alias(own), F.col("spans").alias(found)), own, "left")
    return keyed.withColumn(text, redact(F.col(text), F.col(found), mask)).select(*docs.columns)
