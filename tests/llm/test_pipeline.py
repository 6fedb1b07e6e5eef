import base64
import random
import zlib

import corpus_pipeline as C
import numpy as np
from pyspark.sql import functions as F

from rulemill.llm import shingle_join
from rulemill.llm.queries import END_ID, TOKENIZER, vocabulary
from rulemill.llm.word_ids import word_ids

from .helpers import WORDS, Union, frame, odd_documents
from .test_documents import ASCII, base_spans, key


def masked(text):
    """Base spans only: the rows of this test hold no other kinds."""
    out, end = "", 0
    for a, _, z in base_spans(text):
        if a > end or not out:
            out += text[end:a] + "[SECRET]"
        end = max(end, z)
    return out + text[end:]


def five_words(text):
    words = text.translate(ASCII).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


NOISE = base64.b64encode(random.Random(4).randbytes(400)).decode()


def similar(a, b):
    both = len(a & b)
    return both >= 0.8 * (len(a) + len(b) - both) - 1e-9


def plain_pipeline(rows):
    """(doc_id, text) that reach the last stage, by brute force."""
    docs = [(i, t) for i, t, *_ in rows if t and any(map(str.isalpha, t)) and t != NOISE]
    found = {}
    for d in set(docs):
        for k in {key(x) for x in d[1].split("\n") if key(x)}:
            found[k] = found.get(k, 0) + 1
    docs = [(i, "\n".join(x for x in t.split("\n") if not key(x) or found[key(x)] < 10)) for i, t in docs]
    sets, union = [five_words(t) for _, t in docs], Union(len(docs))
    for i in range(len(docs)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                union.join(i, j)
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(union.find(i), []).append(d)
    return sorted((min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()), key=str)


def test_stages_equal_brute_force(spark, tmp_path):
    rows = [*odd_documents(), (408, NOISE, None, "s", 1), (409, NOISE, None, "t", 1), (None, "also no key", "en", "s", 1)]
    docs = frame(spark, rows)
    for name, stage in C.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, None), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [(i, masked(t)) for i, t in plain_pipeline(rows)]
    got = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(got, key=str) == want
    packed = C.STAGES[-1][1](spark, docs, None).collect()
    ids = {i: np.array(word_ids(vocabulary(TOKENIZER)).library.encode(t, add_special_tokens=False).ids + [END_ID], "<u4") for i, t in want if i is not None}
    seen = dict.fromkeys(ids, 0)
    for r in sorted((r for r in packed if r["doc_id"] is not None), key=lambda r: (r["doc_id"], r["start"])):
        x = ids[r["doc_id"]]
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(x)
        assert r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) for i, x in ids.items()}
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    run = C.run(spark, str(tmp_path))
    assert sorted(r["ids_crc32"] for r in run.collect()) == sorted(r["ids_crc32"] for r in packed)


def test_a_corpus_without_labels_stays(spark):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["plain words", "ein Wort", None, "", "123 !!!", "слово"])]
    assert sorted(r["doc_id"] for r in C.language(spark, frame(spark, rows), None).collect()) == [0, 1, 5]


def test_unique_texts_under_one_doc_id_stay(spark):
    a = "one two three four five six seven eight"
    for b in ("an unrelated text of other words", "b", "zz top of the world tonight", "the house by the river is green"):
        rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (None, a, "en", "s", 1), (None, b + " more", "en", "s", 1)]
        got = C.near_duplicates(spark, frame(spark, rows), None).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, a), (5, b), (None, b + " more")], key=str)


def test_stages_on_odd_tables(spark):
    for docs in (frame(spark, []), frame(spark, odd_documents(0)).withColumn("_r", F.lit(1)).withColumn("score", F.lit(2)).withColumn("fp", F.lit(3))):
        columns = docs.columns
        for name, stage in C.STAGES[:-1]:
            docs = C.materialize(stage(spark, docs, None), name)
            assert docs.columns == columns
        C.STAGES[-1][1](spark, docs, None).collect()


def test_five_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["language", "lines", "near_duplicates", "secrets", "pack"]


def edited_documents():
    """Originals with copies of which one word in 12 to 70 is another one; two texts under one doc_id; a chain."""
    rng = random.Random(3)
    say = lambda k: [f"w{rng.randrange(4000)}" for _ in range(k)]
    rows = []
    for i in range(40):
        base = say(rng.randint(60, 260))
        rows.append((10 * i, " ".join(base)))
        for j in range(1, 5):
            edited = [rng.choice(WORDS) if rng.random() < 1 / rng.randint(12, 70) else w for w in base]
            rows.append((10 * i + j, " ".join(edited)))
    chain = say(120)
    for i in range(12):
        rows.append((1000 + i, " ".join(chain)))
        chain = chain[8:] + say(8)
    return rows


def test_near_duplicates_equal_brute_force_jaccard(spark):
    rows = edited_documents()
    sets, union, linked = [five_words(t) for _, t in rows], Union(len(rows)), 0
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                union.join(i, j)
                linked += 1
    want = {}
    for i, (d, _) in enumerate(rows):
        want.setdefault(union.find(i), []).append(d)
    assert linked > 60 and len(want) < len(rows)
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = sorted(r["doc_id"] for r in C.near_duplicates(spark, docs, None).collect())
    assert got == sorted(min(g) for g in want.values())


def test_long_runs_are_dealt_in_chunks(spark):
    rows = [(i, " ".join(f"a{k}" for k in range(i % 7, 60 + i % 7)) + f" b{i}") for i in range(40)]
    texts = spark.createDataFrame(rows, "node long, text string")
    links = shingle_join.near_links(texts, chunk=5).collect()
    union = Union(40)
    for r in links:
        union.join(r["a"], r["b"])
    assert len({union.find(i) for i in range(40)}) == 1
