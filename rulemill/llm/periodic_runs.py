"""Runs of words that repeat with a period, found on a harmonic grid with prefix hashes.

A run of period q is a longest stretch in which words q apart are the same, at least four periods and six words long.
Whatever its place, it holds a block of 2q words that starts at a multiple of 2q, so for every period the grid points
2q apart are enough: n/2q points a period, about n ln(n) / 2 pairs in all. For all pairs at once (numpy arrays), the
first probes compare one word and one block; for those left, binary searches over prefix hashes find how far the words
at the point and a period later agree to the right and to the left. Both reaches make a run. Hashes (two moduli of 31
bits) can only make words look the same that aren't, so every run is compared word by word; a wrong one repeats the
work with other hashes.

Stretches found for several periods are one run of the smallest: if a stretch of at least four periods q has a smaller
one, the smallest divides q and has the same longest stretch.

Defined results: a null text is an empty one; texts without words have no runs; repeated rows and null keys each come
back; an empty table gives an empty result; texts are taken whole, one at a time if long; columns that aren't kept are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import free_names, prepare

#: Texts are taken together until they have this many words; pairs are searched when there are this many.
_WORDS, _PAIRS = 100_000, 500_000
_MODULI = (2**31 - 1, 2**31 - 19)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Hashes:
    """Prefix hashes of a sequence of numbers from 0, for one seed."""

    def __init__(self, ids: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.parts = []
        for p in _MODULI:
            power = np.ones(1, np.int64)  # doubled: powers of the base from 0 to the length
            step = int(rng.integers(2**20, p))
            while len(power) <= len(ids):
                power = np.concatenate([power, power * step % p])
                step = step * step % p
            power = power[: len(ids) + 1]
            values = rng.integers(1, p, int(ids.max()) + 1 if len(ids) else 1)
            prefix = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(values[ids] * power[:-1] % p, out=prefix[1:])
            self.parts.append((p, power, prefix % p))

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of these lengths at a and at b > a look the same."""
        out = np.ones(len(a), bool)
        for p, power, prefix in self.parts:
            left, right = prefix[a + length] - prefix[a], prefix[b + length] - prefix[b]
            out &= left * power[b - a] % p == right % p
        return out

    def reach(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool) -> np.ndarray:
        """How far the words from a and from b on (or before them) are the same, all searched at once; low is known to hold."""
        low, high = low.copy(), high.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo] + 1) // 2
            off = middle if back else 0
            good = self.same(a[todo] - off, b[todo] - off, middle)
            low[todo[good]] = middle[good]
            high[todo[~good]] = middle[~good] - 1
            todo = todo[low[todo] < high[todo]]
        return low


def _stretches(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: _Hashes, least: int, times: int) -> Iterator[np.ndarray]:
    """Rows (start, end, period) of the stretches that grid points find, not yet told apart."""
    points: list[np.ndarray] = []
    periods: list[np.ndarray] = []
    held = 0

    def search() -> np.ndarray:
        at, q = np.concatenate(points), np.concatenate(periods)
        good = at + 2 * q <= len(ids)
        at, q = at[good], q[good]
        good = hashes.same(at, at + q, q)
        at, q = at[good], q[good]
        text = np.searchsorted(begin, at, "right") - 1
        right = hashes.reach(at, at + q, q, end[text] - at - q, back=False)
        left = hashes.reach(at, at + q, np.zeros_like(q), at - begin[text], back=True)
        found = np.stack([at - left, at + q + right, q], axis=1)
        return np.unique(found[found[:, 1] - found[:, 0] >= np.maximum(least, times * q)], axis=0)

    for q in range(1, int((end - begin).max(initial=0)) // times + 1):
        at = np.flatnonzero(ids[: len(ids) - q : 2 * q] == ids[q :: 2 * q]) * (2 * q)
        if len(at):
            points.append(at)
            periods.append(np.full(len(at), q))
            held += len(at)
        if held >= _PAIRS:
            yield search()
            points, periods, held = [], [], 0
    if held:
        yield search()


def _holds(ids: np.ndarray, run: np.ndarray, begin: int, end: int) -> bool:
    """Whether a run is one, word by word, and no neighbour extends it."""
    s, e, q = (int(x) for x in run)
    return bool((ids[s : e - q] == ids[s + q : e]).all()) and (s == begin or ids[s - 1] != ids[s - 1 + q]) and (e == end or ids[e] != ids[e - q])


def runs_of(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """The runs (start, end, period) of texts that lie one after the other in ids, in the order of start and period.

    begin and end are the texts' places; between two texts lies a number that stands nowhere else.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods may pass between the grid's points")
    for seed in range(16):
        hashes = _Hashes(ids, seed)
        found = np.zeros((0, 3), np.int64)
        for more in _stretches(ids, begin, end, hashes, least, times):
            found = np.unique(np.concatenate([found, more]), axis=0)  # by start, end, period
            first = np.ones(len(found), bool)
            first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
            found = found[first]  # the smallest period of each stretch
        text = np.searchsorted(begin, found[:, 0], "right") - 1
        if all(_holds(ids, r, int(begin[t]), int(end[t])) for r, t in zip(found, text, strict=True)):
            return found[np.lexsort((found[:, 2], found[:, 0]))]
    raise RuntimeError("no seed tells these words apart")


def _together(texts: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Texts as lists of words, as many at a time as the words' bound allows, one at least."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        said = (t or b"").split()  # bytes split at ASCII white space only
        if held and n + len(said) > _WORDS:
            yield first, held
            first, held, n = i, [], 0
        held.append(said)
        n += len(said) + 1
    if held:
        yield first, held


def _flat(said: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as numbers, with a number of its own after each text, and where the texts lie."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in said], np.int64)
    end = np.cumsum(sizes + 1) - 1
    ids = np.empty(int(end[-1]) + 1, np.int64)
    own = np.ones(len(ids), bool)
    own[end] = False
    ids[own] = [number.setdefault(w, len(number)) for words in said for w in words]
    ids[end] = len(number) + np.arange(len(end))
    return ids, end - sizes, end


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = 6, times: int = 4) -> DataFrame:
    """The kept columns of each row with n_words, runs (start, length, period; in words, by start, then period) and collapsed.

    Words are split at ASCII white space. A run has `times` periods and `least` words at least. collapsed is the text
    without the words that lie in a run after its first period, words joined by one space.
    """
    prepare(docs.sparkSession)
    plain = [f"c{i}" for i in range(len(keep))]
    chosen = docs.select(*[docs[k].alias(p) for k, p in zip(keep, plain, strict=True)], docs[text].cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, said in _together(b["text"].to_pylist()):
                ids, begin, end = _flat(said)
                found = runs_of(ids, begin, end, least, times)
                text_of = np.searchsorted(begin, found[:, 0], "right") - 1
                gone = np.zeros(len(ids) + 1, np.int64)
                np.add.at(gone, found[:, 0] + found[:, 2], 1)
                np.add.at(gone, found[:, 1], -1)
                kept = np.cumsum(gone[:-1]) == 0
                bounds = np.searchsorted(text_of, np.arange(len(said) + 1))
                runs, collapsed = [], []
                for i, words in enumerate(said):
                    rows = found[bounds[i] : bounds[i + 1]]
                    runs.append([{"start": int(s - begin[i]), "length": int(e - s), "period": int(q)} for s, e, q in rows])
                    left = words if not len(rows) else [w for w, k in zip(words, kept[begin[i] : end[i]].tolist(), strict=True) if k]
                    collapsed.append(b" ".join(left).decode())
                columns = [b.column(j).slice(first, len(said)) for j in range(len(plain))]
                out = [*columns, pa.array([len(w) for w in said], pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[*plain, "n_words", "runs", "collapsed"])

    kinds = [f"{p} {chosen.schema[p].dataType.simpleString()}" for p in plain]
    found = chosen.mapInArrow(run, ", ".join([*kinds, "n_words bigint", f"runs {RUNS}", "collapsed string"]))
    names = free_names(docs.select(*keep), "n_words", "runs", "collapsed")
    return found.toDF(*keep, *names)
