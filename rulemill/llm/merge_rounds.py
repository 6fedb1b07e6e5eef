"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of many texts become one flat array of symbols, cut into segments that no merge can cross. In each
round every segment finds its best pair (by score, then leftmost) with one segmented minimum, merges it, and the array
is compacted; segments without a pair are done. Occurrences of a segment's best pair merge together as long as none of
them makes a pair that would have come first. The library serves to read the model file only.

Defined results: a null or empty text has the end id alone; null and repeated keys each come back; texts are encoded
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import prepare

_NONE = np.int64(1 << 60)
_WORD = regex.compile("▁+[^▁]*|[^▁]+")
#: Words remembered by a worker; then it starts anew.
CACHE_WORDS = 500_000


class MergeRounds:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix; any other one is refused."""

    @staticmethod
    def _check(sp) -> None:
        n = sp.get_piece_size()
        if sum(map(sp.is_byte, range(n))) != 256:
            raise ValueError("the model has no byte fallback")
        odd = "ﬁ Ａ e\u0301 ½ ẞ  two  spaces \t and\n\nlines "
        if sp.decode(sp.encode(odd)) != odd or sp.encode(" a") == sp.encode("a") or sp.encode("a", out_type=str) != ["▁a"]:
            raise ValueError("the model normalises texts, or has no dummy prefix")
        plain = [sp.get_score(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(s != round(s) for s in plain):
            raise ValueError("the model isn't BPE: its scores are no merge ranks")

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self._check(sp)
        n = self.n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.eos = sp.eos_id()
        self.byte_ids = np.zeros(256, np.int64)
        normal: dict[str, int] = {}
        self.surface: list[bytes] = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[1:-1], 16)] = i
                self.surface.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unused(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                normal[p] = i
                self.surface.append(p.replace("▁", " ").encode())
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.spaced = {i for p, i in normal.items() if p[0] == "▁"}
        # symbols: piece numbers, then n + code point for characters that are no piece
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int64)
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.width = np.int64(n + 0x110000)
        scores = sorted({-sp.get_score(i) for i in normal.values()})
        rank = {s: r for r, s in enumerate(scores)}
        name = lambda s: normal.get(s, n + ord(s) if len(s) == 1 else None)
        pairs, beside = {}, set()
        for p, i in normal.items():
            beside.update(zip(p[:-1], p[1:], strict=True))
            for cut in range(1, len(p)):
                a, b = name(p[:cut]), name(p[cut:])
                if a is not None and b is not None:
                    pairs[a * int(self.width) + b] = (rank[-sp.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.beside = np.array(sorted(int(self.of_char[ord(a)]) * int(self.width) + int(self.of_char[ord(b)]) for a, b in beside), np.int64)
        if any(b == "▁" and a != "▁" for a, b in beside):
            raise ValueError("pieces of this model join words; words can't be encoded on their own")
        self.lines_apart = not any("\n" in pair for pair in beside)
        self.decimal = [str(i).encode() for i in range(n)]
        #: word -> (ids as unsigned 32-bit bytes, ids in decimal); words with the leading mark, and words without
        self.marked: dict[str, tuple[bytes, bytes]] = {}
        self.bare: dict[str, tuple[bytes, bytes]] = {}

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, _NONE if it makes no piece, and where it stands in the table."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), at

    def _rounds(self, sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges until no pair remains. start: True where a segment starts. Returns symbols and their first positions."""
        pos = np.arange(len(sym))
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(~start[1:])
        rank[inner], _ = self._look(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(start)
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(sym)])
            if (least == _NONE).any():
                over = np.repeat(least == _NONE, sizes)
                done.append((sym[over], pos[over]))
                go = ~over
                sym, pos, rank, start = sym[go], pos[go], rank[go], start[go]
                continue
            segment = np.repeat(np.arange(len(first)), sizes)
            hit = np.flatnonzero(rank == least[segment])
            # of overlapping occurrences, the leftmost and every second one after it
            if len(hit) > len(first):
                breaks = np.r_[True, (np.diff(hit) > 1) | (segment[hit[1:]] != segment[hit[:-1]])]
                run = np.cumsum(breaks) - 1
                hit = hit[(np.arange(len(hit)) - np.flatnonzero(breaks)[run]) % 2 == 0]
            _, at = self._look(sym[hit], sym[hit + 1])
            new = self.merged[at]
            if len(hit) > len(first):
                hit, new = self._safe(sym, start, hit, new, segment, least)
            sym[hit] = new
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            where = np.cumsum(keep) - 1
            touched = where[hit]
            sym, pos, rank, start = sym[keep], pos[keep], rank[keep], start[keep]
            again = np.unique(np.concatenate([touched, touched[~start[touched]] - 1]))
            last = np.r_[start[1:], True][again]
            rank[again[last]] = _NONE
            again = again[~last]
            rank[again], _ = self._look(sym[again], sym[again + 1])
        if not done:
            return sym, pos
        sym, pos = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(pos, kind="stable")
        return sym[order], pos[order]

    def _safe(self, sym: np.ndarray, start: np.ndarray, hit: np.ndarray, new: np.ndarray, segment: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences of each segment up to the first that makes a pair as good as the best or better."""
        n, bar = len(sym), least[segment[hit]]
        bad = np.zeros(len(hit), bool)
        right = hit + 2
        has = right < n
        has[has] = ~start[right[has]]
        bad[has] |= self._look(new[has], sym[right[has]])[0] <= bar[has]
        has = ~start[hit]
        bad[has] |= self._look(sym[hit[has] - 1], new[has])[0] <= bar[has]
        has = np.r_[False, (hit[1:] - hit[:-1] == 2) & (segment[hit[1:]] == segment[hit[:-1]])]
        where = np.flatnonzero(has)
        bad[where] |= self._look(new[where - 1], new[where])[0] <= bar[where]
        of = segment[hit]
        before = np.cumsum(bad) - bad  # bad ones ahead, over all segments
        heads = np.r_[True, of[1:] != of[:-1]]
        base = before[heads][np.cumsum(heads) - 1]
        ok = before == base
        return hit[ok], new[ok]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, its leading marks included in it."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        if not len(points):
            return [np.zeros(0, np.int64) for _ in words]
        sym = self.of_char[points]
        start = np.zeros(len(sym), bool)
        heads = (np.cumsum(sizes) - sizes)[sizes > 0]
        start[heads] = True
        key = sym[:-1] * self.width + sym[1:]
        start[1:] |= self.beside[np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)] != key
        sym, pos = self._rounds(sym.copy(), start)
        odd = sym >= self.n
        if odd.any():  # characters without a piece become bytes
            parts, at = [], np.flatnonzero(odd)
            data = [np.frombuffer(chr(int(s) - self.n).encode(), np.uint8) for s in sym[at]]
            times = np.ones(len(sym), np.int64)
            times[at] = [len(d) for d in data]
            pos, sym = np.repeat(pos, times), np.repeat(sym, times)
            parts = np.flatnonzero(np.repeat(odd, times))
            sym[parts] = self.byte_ids[np.concatenate(data)]
        return np.split(sym, np.searchsorted(pos, np.cumsum(sizes)[:-1]))

    def _learn(self, words: list[str], memory: dict[str, tuple[bytes, bytes]], mark: str) -> None:
        ids = self.encode_words([mark + w for w in words])
        name = self.decimal.__getitem__
        memory.update((w, (i.astype("<u4").tobytes(), b" ".join(map(name, i.tolist())))) for w, i in zip(words, ids, strict=True))

    def _words(self, text: str) -> list[tuple[dict[str, tuple[bytes, bytes]], list[str]]]:
        """The text's words in order, each run of them with the memory that they are looked up in."""
        text = text.replace("▁", " ")
        lines = text.split("\n") if self.lines_apart else [text]
        plan: list[tuple[dict[str, tuple[bytes, bytes]], list[str]]] = []
        for no, line in enumerate(lines):
            if no:
                plan.append((self.bare, ["\n"]))
            if "  " in line or line[:1] == " " or line[-1:] == " " or not line:
                marked = ("" if no else "▁") + line.replace(" ", "▁")
                plan.append((self.bare, _WORD.findall(marked)))
            else:
                words = line.split(" ")
                if no:
                    plan.append((self.bare, words[:1]))
                    words = words[1:]
                plan.append((self.marked, words))
        return plan

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bytes]]:
        """For each text its ids with the end id, and the same in decimal, joined by one space."""
        if len(self.marked) + len(self.bare) > CACHE_WORDS:
            self.marked.clear()
            self.bare.clear()
        plans = [self._words(t) if t else [] for t in texts]
        for memory, mark in ((self.marked, "▁"), (self.bare, "")):
            new = {w for plan in plans for m, words in plan if m is memory for w in words}.difference(memory)
            if new:
                self._learn(list(new), memory, mark)
        end, out = np.array([self.eos], "<u4").tobytes(), []
        for plan in plans:
            got = [x for memory, words in plan for x in map(memory.__getitem__, words)]
            ids = np.frombuffer(b"".join([x[0] for x in got]) + end, "<u4")
            out.append((ids, b" ".join([*(x[1] for x in got if x[1]), self.decimal[self.eos]])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks become spaces, the dummy prefix goes, bytes that are no UTF-8 become U+FFFD."""
        numbers = ids.tolist()
        first = next((i for i in numbers if i not in self.control), None)
        data = b"".join(map(self.surface.__getitem__, numbers))
        if first in self.spaced:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="_rulemill_bytes")


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    """One U+FFFD for one byte, then on with the next."""
    return "�", error.start + 1


def _register() -> None:
    import codecs

    codecs.register_error("_rulemill_bytes", _each_byte)


_register()
_open: dict[str, MergeRounds] = {}


def merge_rounds(path: str) -> MergeRounds:
    """One model a worker and file."""
    if path not in _open:
        _open[path] = MergeRounds(path)
    return _open[path]


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """key, ids and the text decoded from them; digest returns key, n_tokens, ids_sha256 and decoded_sha256 instead."""
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merge_rounds(model)
        for b in batches:
            got = bpe.encode(b[text].to_pylist())
            if digest:
                rows = [(len(ids), hashlib.sha256(dec).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()) for ids, dec in got]
                n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.record_batch([b[key], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.record_batch([b[key], pa.array([i.tolist() for i, _ in got], pa.list_(pa.int32())), pa.array([bpe.decode(i) for i, _ in got], pa.string())], names=[key, "ids", "decoded"])

    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {rest}")
