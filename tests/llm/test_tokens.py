import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulemill.llm import packing, token_files
from rulemill.llm.elias_fano import EliasFano, TokenFile, TokenFileWriter
from rulemill.llm.merge_rounds import MergeRounds, encode_documents, merge_rounds
from rulemill.llm.queries import END_ID, PIECES, TOKENIZER, vocabulary
from rulemill.llm.word_ids import word_ids

from .helpers import frame, odd_documents

ODD = ["", "  a  B\tc's it'S don't x\x1cy \x85z", "ΑΣ ΣΑ İI J̌ é ẞ", "<|endoftext|> hi <|ENDOFTEXT|>", "12345 a1b2_c-d %%% 😀‍🔥 日本語テキスト Ǆ ﬁ ½ Ⅷ ٣", "'s 'T ''re x'll'd a'b'c", "ÁB̀", "naïve naïve"]


@pytest.fixture(scope="module")
def words():
    return word_ids(vocabulary(TOKENIZER))


def test_word_ids_equal_the_library(words):
    texts = ODD + [t for _, t, *_ in odd_documents()]
    for text, ids in zip(texts, words.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == words.library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_ids_on_any_text(text):
    w = word_ids(vocabulary(TOKENIZER))
    assert np.frombuffer(w.encode([text])[0], "<u4").tolist() == w.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aehinostr  \n▁é-=#<>0x"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_merge_rounds_equal_the_library(text):
    import sentencepiece

    model = merge_rounds(vocabulary(PIECES))
    sp = test_merge_rounds_equal_the_library.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES)))
    ids, decimal = model.encode([text])[0]
    want = sp.encode(text, add_eos=True)
    assert ids.tolist() == want and decimal.decode() == " ".join(map(str, want))
    assert model.decode(ids) == sp.decode(want)


def test_long_words_and_repeats():
    import sentencepiece

    model, sp, rng = merge_rounds(vocabulary(PIECES)), sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES)), random.Random(1)
    texts = ["a" * 3001, "ab" * 2000, " " * 500 + "x", "".join(rng.choice("abcdefghijklmnop") for _ in range(6000)), "====---" * 300]
    for text, (ids, _) in zip(texts, model.encode(texts)):
        assert ids.tolist() == sp.encode(text, add_eos=True)
    for _ in range(300):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(3, 258)]) for _ in range(rng.randint(0, 9))]
        assert model.decode(np.array(ids, np.int64)) == sp.decode(ids)


@pytest.mark.parametrize("lie", [{"is_byte": lambda i: False}, {"decode": lambda ids: "ﬁ".replace("ﬁ", "fi")}, {"get_score": lambda i: -0.5 * i}])
def test_other_models_are_refused(lie):
    import sentencepiece

    class Told:
        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))

        def __getattr__(self, name):
            return lie.get(name) or getattr(self.sp, name)

    MergeRounds._check(Told.sp)
    with pytest.raises(ValueError):
        MergeRounds._check(Told())


def test_encode_documents(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    rows = odd_documents()
    got = encode_documents(frame(spark, rows), vocabulary(PIECES), digest=True).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    each = [(i, sp.encode(t or "", add_eos=True)) for i, t, *_ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, len(e), sha(" ".join(map(str, e))), sha(sp.decode(e)))) for i, e in each)
    full = encode_documents(frame(spark, rows), vocabulary(PIECES)).collect()
    assert sorted(str((r["doc_id"], list(r["ids"]))) for r in full) == sorted(map(str, each))
    assert encode_documents(frame(spark, []), vocabulary(PIECES), digest=True).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=700).map(sorted))
def test_elias_fano_round_trip(values):
    coded, at = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert coded.decode().tolist() == values and [coded[i] for i in range(len(coded))] == values


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 20_000))
    assert len(EliasFano.encode(values).to_bytes()) * 8 / len(values) < 14  # 64-bit offsets take 64


class Counted(np.ndarray):
    """A packed vector that notes the longest stretch read of it."""

    longest = 0

    def __getitem__(self, at):
        if isinstance(at, slice):
            Counted.longest = max(Counted.longest, at.stop - at.start)
        return np.asarray(self)[at]


@pytest.mark.parametrize("gaps", ["even", "wide", "one"])
def test_select_reads_a_bounded_stretch(gaps):
    """Wherever a number lies, select counts at most SPARSE bits, wide gaps included."""
    rng = np.random.default_rng(2)
    values = {"even": lambda: rng.integers(0, 900, 200_000), "wide": lambda: np.where(rng.random(200_000) < 0.001, 10**6, 1), "one": lambda: np.r_[np.ones(100_000), 10**8, np.ones(100_000)]}[gaps]().astype(np.int64).cumsum()
    coded, _ = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    coded.high, Counted.longest = coded.high.view(Counted), 0
    for i in [0, 1, 255, 256, 257, len(values) - 1, *rng.integers(0, len(values), 500).tolist()]:
        assert coded[i] == values[i]
    assert Counted.longest <= 16_384 // 8 + 1
    for a, b in ((0, 0), (0, 1), (99_990, 100_300), (len(values) - 5, len(values))):
        assert coded.part(a, b).tolist() == values[a:b].tolist()


def token_file(keys, ids, width):
    import io

    out = io.BytesIO()
    writer = TokenFileWriter(out, width)
    for k, x in zip(keys, ids):
        writer.add(k, x)
    writer.finish()
    data = out.getvalue()
    return TokenFile(lambda at, count: data[at : at + count], len(data))


def test_token_file_reads_single_documents():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 5)]
    f = token_file([None, -4, 9], ids, 2)
    assert f.keys(0, 3) == [None, -4, 9] and f.document(2).tolist() == [0, 1, 2, 3, 4] and f.document(1).tolist() == []
    assert f.keys(1, 2) == [-4] and f.keys(0, 1) == [None] and f.starts(1, 3).tolist() == [3, 3, 8]
    far = token_file([-(2**63), 2**63 - 1], ids[:2], 4)
    assert far.keys(0, 2) == [-(2**63), 2**63 - 1]
    for size in (100, 3):
        with pytest.raises(ValueError):
            TokenFile(lambda at, count: b"x" * count, size)


@pytest.mark.parametrize(("file_ids", "docs"), [(2_000_000, 8192), (2_000_000, 5), (50, 8192), (2000, 3)])
def test_token_files(spark, words, file_ids, docs):
    rows = odd_documents()
    folder, manifest = token_files.write_token_files(frame(spark, rows), vocabulary(TOKENIZER), END_ID, file_ids=file_ids)
    got = token_files.read_token_files(spark, folder, manifest, ids=True, docs=docs).orderBy("start").collect()
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(got) == len(rows)
    want, at = {}, 0
    for i, t, *_ in rows:
        want.setdefault(i, []).append(words.library.encode(t or "", add_special_tokens=False).ids + [END_ID])
    for r in got:
        assert r["start"] == at and list(r["ids"]) in want[r["doc_id"]]
        assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    folder, manifest = token_files.write_token_files(frame(spark, []), vocabulary(TOKENIZER), END_ID)
    assert token_files.read_token_files(spark, folder, manifest).collect() == []


def test_differencing():
    assert packing.difference(np.array([], int), 3) == []
    found = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sum(np.array([8, 7, 6, 5, 4])[w]) for w in found) == [14, 16]  # Karmarkar and Karp's own example
    sizes = np.random.default_rng(0).integers(1, 500, 400)
    found = packing.difference(sizes, 40)
    sums = [sizes[w].sum() for w in found]
    assert sorted(i for w in found for i in w) == list(range(400)) and max(sums) - min(sums) < 20


def test_windows_rise_above_capacity():
    window, offset = packing.pack_group(np.array([600, 600, 600, 248]), 1024)  # two windows can't hold them
    assert window.max() == 2 and (offset >= 0).all()


def test_packing(spark, words):
    rows = odd_documents()
    pieces = packing.cut_documents(frame(spark, rows), vocabulary(TOKENIZER), END_ID, capacity=256, piece=64)
    got = packing.pack_pieces(pieces, capacity=256, group_pieces=100).collect()
    sequences, documents = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        documents.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(words.library.encode(t or "", add_special_tokens=False).ids + [END_ID])
    for i, texts in want.items():
        if len(texts) == 1:
            parts = sorted(documents[i])
            assert sum((p[1] for p in parts), []) == texts[0] and {p[2] for p in parts} == {len(texts[0])}
        else:
            assert sorted(x for p in documents[i] for x in p[1]) == sorted(x for t in texts for x in t)
    filled = sum(r["length"] for r in got)
    assert filled / (256 * len(sequences)) > 0.97
    none = packing.pack_pieces(packing.cut_documents(frame(spark, []), vocabulary(TOKENIZER), END_ID))
    assert none.collect() == []


def test_files_close_by_documents(spark):
    """Very many very short texts: a file holds a bounded number of documents, and what it holds stays small."""
    rows = [(i, "" if i % 3 else "a b", None, None, 0) for i in range(700)] + [(None, None, None, None, 0)] * 3
    folder, manifest = token_files.write_token_files(frame(spark, rows), vocabulary(TOKENIZER), END_ID, file_docs=50)
    assert manifest.agg({"docs": "max"}).first()[0] == 50 and manifest.agg({"docs": "sum"}).first()[0] == 703
    got = token_files.read_token_files(spark, folder, manifest, docs=16).collect()
    assert len(got) == 703 and sum(r["doc_id"] is None for r in got) == 3 and sorted(r["start"] for r in got)[1] >= 1


def test_memory_of_short_documents():
    """A file of the most documents, with keys and boundaries, takes less than 400 MB."""
    import tracemalloc

    class Sink:
        def write(self, data):
            pass

    ids = np.arange(10, dtype="<u4").tobytes()
    tracemalloc.start()
    writer = TokenFileWriter(Sink(), 2)
    for i in range(token_files.FILE_DOCS):
        writer.add(7 * i, ids)
    writer.finish()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5e8
