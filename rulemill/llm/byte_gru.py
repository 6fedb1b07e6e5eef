"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions, gives each position a distribution over the languages, and
a document's probabilities are the means over all its positions. It is trained here, in numpy, by backpropagation
through time, on windows of a bounded sample of labelled documents. Texts are read whole: long ones as consecutive
segments that the network reads side by side.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text if there is nothing
to learn from; ties go to the language first in order; null and repeated keys each come back; a null key is never
held out; an empty table gives an empty result; other columns are not read by a prediction. All languages that occur
are learned, however many: the bounded sample is spread over them.

A model may also learn a class of noise (`train(noise=True)`), made from windows of the sample with their bytes
shuffled and from random characters. Every position of a text is then evidence for noise or for the likeliest language:
`identify` sums the log-odds over all positions, whatever the length, and gives `und` to texts whose sum exceeds a
fixed prior. The fit sets the prior to twice the largest sum among the labelled windows, so a few odd bytes can't
outweigh it, and what the labels call a language isn't noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, released

#: The fit's bounds: sampled documents a language and in all, windows a document, bytes a window.
SAMPLE_DOCS, SAMPLE_ALL, WINDOWS, WINDOW = 500, 128_000, 8, 64
HIDDEN, STEPS, BATCH, RATE = 8, 200, 256, 0.02
#: Bytes of a segment, and the most segments read side by side; numbers held for them.
SEGMENT, ABREAST, HELD = 128, 4096, 1 << 24
#: The name of what is no language; the least probability that a position gives a class when evidence is summed; how
#: much more evidence than the labelled sample's worst window a text needs to be noise; windows that this is taken from.
NOISE, FLOOR, BEYOND, JUDGED = "und", 1e-3, 2.0, 20_000
#: Up to so many languages, with a count each, are broadcast.
BROADCAST = 10_000
_GATES = ("z", "r", "n")


@dataclass
class ByteGRU:
    """Parameters: for each direction and gate an input table (256 x H) and a matrix (H x H); an output layer."""

    languages: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float = 0.0

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 0) -> ByteGRU:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            for g in _GATES:
                p[f"{d}x{g}"] = rng.normal(0, 0.3, (256, hidden)) + (g == "z")
                p[f"{d}h{g}"] = rng.normal(0, hidden**-0.5, (hidden, hidden))
            p[f"{d}o"] = rng.normal(0, 0.3, (hidden, len(languages)))
        p["o"] = np.zeros(len(languages))
        return cls(languages, {k: v.astype(np.float32) for k, v in p.items()})

    def _steps(self, d: str, data: np.ndarray, mask: np.ndarray | None) -> list[tuple[np.ndarray, ...]]:
        """States of one direction, in order of time; data: time x windows."""
        p, h, out = self.p, np.zeros((data.shape[1], self.p["fhz"].shape[0]), np.float32), []
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            b = data[t]
            z = 1 / (1 + np.exp(-(p[d + "xz"][b] + h @ p[d + "hz"])))
            r = 1 / (1 + np.exp(-(p[d + "xr"][b] + h @ p[d + "hr"])))
            u = h @ p[d + "hn"]
            n = np.tanh(p[d + "xn"][b] + r * u)
            new = n + z * (h - n)
            if mask is not None:
                new = new * mask[t][:, None]
            out.append((t, h, z, r, u, n, new))
            h = new
        return out

    def loss_and_gradient(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
        p, grad = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {d: self._steps(d, data, mask) for d in "fb"}
        states = {d: np.stack([s[-1] for s in sorted(runs[d], key=lambda s: s[0])]) for d in "fb"}
        logit = states["f"] @ p["fo"] + states["b"] @ p["bo"] + p["o"]
        logit -= logit.max(axis=2, keepdims=True)
        prob = np.exp(logit)
        prob /= prob.sum(axis=2, keepdims=True)
        total = mask.sum()
        at = np.arange(len(label))
        loss = -(np.log(prob[:, at, label] + 1e-9) * mask).sum() / total
        delta = prob
        delta[:, at, label] -= 1
        delta *= (mask / total)[:, :, None]
        grad["o"] = delta.sum(axis=(0, 1))
        for d in "fb":
            grad[d + "o"] = np.einsum("tbh,tbc->hc", states[d], delta)
            back = np.zeros_like(states[d][0])
            into = {g: np.empty_like(states[d]) for g in _GATES}
            for t, h, z, r, u, n, _ in reversed(runs[d]):
                dh = (back + delta[t] @ p[d + "o"].T) * mask[t][:, None]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * u * r * (1 - r)
                du = dn * r
                into["z"][t], into["r"][t], into["n"][t] = dz, dr, dn
                grad[d + "hz"] += h.T @ dz
                grad[d + "hr"] += h.T @ dr
                grad[d + "hn"] += h.T @ du
                back = dh * z + dz @ p[d + "hz"].T + dr @ p[d + "hr"].T + du @ p[d + "hn"].T
            hidden = back.shape[1]
            cell = (data[:, :, None].astype(np.int64) * hidden + np.arange(hidden)).ravel()
            for g in _GATES:
                grad[f"{d}x{g}"] += np.bincount(cell, into[g].ravel(), 256 * hidden).reshape(256, hidden).astype(back.dtype)
        return float(loss), grad

    def fit(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 0) -> ByteGRU:
        """Adam on random batches of windows (windows x time), languages equally likely."""
        rng = np.random.default_rng(seed)
        each = [e for e in (np.flatnonzero(label == c) for c in range(len(self.languages))) if len(e)]
        batch = max(1, min(batch, HELD // (data.shape[1] * len(self.languages))))  # a step's probabilities stay bounded
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            drawn = each if len(each) <= batch else [each[c] for c in rng.choice(len(each), batch, replace=False)]
            some = np.concatenate([rng.choice(e, -(-batch // len(drawn))) for e in drawn])
            _, grad = self.loss_and_gradient(data[some].T, mask[some].T, label[some])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def _fast(self) -> dict[str, np.ndarray]:
        """Parameters with the gates' inputs halved: sigmoid(x) = (1 + tanh(x / 2)) / 2."""
        return {k: np.ascontiguousarray(v * np.float32(0.5 if k[1:] in ("xz", "xr", "hz", "hr") else 1), np.float32) for k, v in self.p.items()}

    @staticmethod
    def _run(p: dict[str, np.ndarray], d: str, data: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """All states (time x segments x H), written in place."""
        steps, wide = data.shape
        hidden = p["fhz"].shape[0]
        out = np.empty((steps, wide, hidden), np.float32)
        h = np.zeros((wide, hidden), np.float32)
        z, r, n, u = (np.empty((wide, hidden), np.float32) for _ in range(4))
        half = np.float32(0.5)
        xz, xr, xn, hz, hr, hn = (p[d + k] for k in ("xz", "xr", "xn", "hz", "hr", "hn"))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            b = data[t]
            np.matmul(h, hz, out=z)
            z += xz.take(b, axis=0)
            np.tanh(z, out=z)
            z *= half
            z += half
            np.matmul(h, hr, out=r)
            r += xr.take(b, axis=0)
            np.tanh(r, out=r)
            r *= half
            r += half
            np.matmul(h, hn, out=u)
            u *= r
            u += xn.take(b, axis=0)
            np.tanh(u, out=n)
            new = out[t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            if mask is not None:
                new *= mask[t][:, None]
            h = new
        return out

    def positions(self, data: np.ndarray, mask: np.ndarray | None, p: dict[str, np.ndarray]) -> np.ndarray:
        """Probabilities of each position (time x segments x languages)."""
        logit = self._run(p, "f", data, mask) @ p["fo"]
        logit += self._run(p, "b", data, mask) @ p["bo"]
        logit += p["o"]
        np.exp(np.minimum(logit, 60, out=logit), out=logit)
        logit /= logit.sum(axis=2, keepdims=True)
        return logit

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes of each text (texts x languages); zeros for an empty one."""
        return self._sums(texts, False)[0]

    def odds(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The mean probabilities, and the log-odds of noise against the likeliest language, summed over all bytes."""
        mean, logs = self._sums(texts, True)
        no = self.languages.index(NOISE)
        return mean, logs[:, no] - np.delete(logs, no, axis=1).max(axis=1, initial=-np.inf)

    def _sums(self, texts: list[bytes], logs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities, and sums of their logarithms if asked for."""
        sizes = np.array([len(x) for x in texts], np.int64)
        sums = np.zeros((len(texts), len(self.languages)))
        total = np.zeros_like(sums)
        if not sizes.sum():
            return sums, total
        flat, p = np.frombuffer(b"".join(texts) + bytes(SEGMENT), np.uint8), self._fast()
        begin = np.cumsum(sizes) - sizes
        count = -(-sizes // SEGMENT)
        of = np.repeat(np.arange(len(texts)), count)
        no = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[of] + no * SEGMENT
        length = np.minimum(SEGMENT, begin[of] + sizes[of] - at)
        order = np.argsort(-length, kind="stable")
        hidden = p["fhz"].shape[0]
        abreast = max(1, min(ABREAST, HELD // (SEGMENT * (len(self.languages) + 2 * hidden))))
        for some in (order[i : i + abreast] for i in range(0, len(order), abreast)):
            longest, shortest = int(length[some[0]]), int(length[some[-1]])
            data = flat[at[some][None, :] + np.arange(longest)[:, None]]
            mask = None if shortest == longest else (np.arange(longest)[:, None] < length[some][None, :]).astype(np.float32)
            prob = self.positions(data, mask, p)
            if logs:
                evidence = np.log(np.maximum(prob, FLOOR))
                if mask is not None:
                    evidence *= mask[:, :, None]
                np.add.at(total, of[some], evidence.sum(axis=0, dtype=np.float64))
            if mask is not None:
                prob *= mask[:, :, None]
            np.add.at(sums, of[some], prob.sum(axis=0, dtype=np.float64))
        return sums / np.maximum(sizes, 1)[:, None], total


def held_out(key: str = "doc_id") -> Column:
    """True where the key, as text, has a CRC-32 with remainder 1 by 3."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1


def _windows(text: str, language: int) -> list[tuple[int, bytes]]:
    data = text.encode()
    if len(data) <= WINDOW:
        return [(language, data)] if data else []
    rng = np.random.default_rng(zlib.crc32(data))
    return [(language, data[a : a + WINDOW]) for a in rng.integers(0, len(data) - WINDOW + 1, min(WINDOWS, len(data) // WINDOW)).tolist()]


def _noise(windows: list[bytes]) -> list[bytes]:
    """As many windows of noise: bytes of the windows shuffled, random characters of several kinds, random bytes."""
    rng = np.random.default_rng(5)
    letters = b"abcdefghijklmnopqrstuvwxyz"
    kinds = [b"0123456789abcdef", letters + letters.upper() + b"0123456789+/", letters, letters.upper(), bytes(range(33, 127)), bytes(range(128, 256))]
    out = []
    for i, w in enumerate(windows):
        if i % 2:
            out.append(bytes(rng.permutation(np.frombuffer(w, np.uint8))))
        else:
            out.append(bytes(rng.choice(np.frombuffer(kinds[i // 2 % len(kinds)], np.uint8), WINDOW)))
    return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", noise: bool = False) -> ByteGRU:
    """Fits on windows of at most SAMPLE_DOCS labelled documents of each language, SAMPLE_ALL in all or one a language.

    Only documents that aren't held out count. Windows are cut before they move, and what reaches the driver is bounded
    by the parameters above. noise adds a class for what is no language; noise that the sample's labels call a language
    is learned as that, so far as the sample holds it.
    """
    prepare(docs.sparkSession)
    known = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = known.groupBy("l").agg(F.count("*").alias("n"))  # a row a language
    languages = sorted(r["l"] for r in counts.select("l").collect())
    if not languages:
        return ByteGRU.fresh([])
    each = min(SAMPLE_DOCS, max(1, SAMPLE_ALL // len(languages)))
    number = {x: i for i, x in enumerate(languages)}
    # twice as many by hash, so that most of the table stays where it is; then exactly the first ones by rank.
    span = 1 << 30
    # few languages join by broadcast, since as keys they would bring all texts to few tasks
    few = F.broadcast(counts) if len(languages) <= BROADCAST else counts
    drawn = known.join(few, "l").where(F.pmod("h", F.lit(span)) < F.lit(2.0 * each * span) / F.col("n")).select("l", "h", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(*w, h, i) for t, x, h in zip(b["t"].to_pylist(), b["l"].to_pylist(), b["h"].to_pylist(), strict=True) for i, w in enumerate(_windows(t, number[x]))]
            yield pa.record_batch([pa.array([g[n] for g in got], kind) for n, kind in enumerate((pa.int32(), pa.binary(), pa.int64(), pa.int32()))], names=["l", "w", "h", "i"])

    first = Window.partitionBy("l").orderBy("h", "i", "w")
    ranked = drawn.mapInArrow(run, "l int, w binary, h long, i int").withColumn("r", F.row_number().over(first)).where(F.col("r") <= each * WINDOWS)
    rows = sorted((r["l"], bytes(r["w"])) for r in ranked.select("l", "w").collect())
    if not rows:
        return ByteGRU.fresh([])
    if noise:
        if NOISE not in number:
            number[NOISE] = len(languages)
            languages.append(NOISE)
        # as many as of a language, drawn evenly over all
        rows += [(number[NOISE], w) for w in _noise([w for _, w in rows[:: len(number)]])]
    data, mask = np.zeros((len(rows), WINDOW), np.uint8), np.zeros((len(rows), WINDOW), np.float32)
    for i, (_, w) in enumerate(rows):
        data[i, : len(w)] = np.frombuffer(w, np.uint8)
        mask[i, : len(w)] = 1
    model = ByteGRU.fresh(languages).fit(data, mask, np.array([r[0] for r in rows]))
    if noise:
        own = [w for x, w in rows if x != number[NOISE]]
        judged = own[:: -(-len(own) // JUDGED)] if own else []
        model.prior = max(1.0, BEYOND * float(model.odds(judged)[1].max(initial=0.0)))
    return model


def identify(docs: DataFrame, model: ByteGRU, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with lang_pred and score (the mean probability of that language).

    With a class of noise, a text is that if the evidence of its positions exceeds the model's prior; else it is the
    likeliest language.
    """
    prepare(docs.sparkSession)
    no = model.languages.index(NOISE) if NOISE in model.languages else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b[text].to_pylist()
            good = [bool(t) and any(map(str.isalpha, t)) and bool(model.languages) for t in texts]
            data = [t.encode() if g else b"" for t, g in zip(texts, good, strict=True)]
            if no is None:
                prob = model.predict(data)
            else:
                prob, evidence = model.odds(data)
                noise = evidence > model.prior
                prob[~noise, no] = 0
                prob[noise] *= np.arange(len(model.languages)) == no
            best = prob.argmax(axis=1) if model.languages and len(texts) else np.zeros(len(texts), int)
            name = [model.languages[i] if g else "und" for i, g in zip(best.tolist(), good, strict=True)]
            score = [float(min(1.0, prob[i, j])) if g else 0.0 for i, (j, g) in enumerate(zip(best.tolist(), good, strict=True))]
            yield pa.record_batch([*(b[c] for c in keep), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    columns = list(dict.fromkeys([*keep, text]))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])
    return docs.select(*columns).mapInArrow(released(run), schema)
