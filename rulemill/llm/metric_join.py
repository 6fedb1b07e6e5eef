"""Embedding near-dedup: an exact metric range join with pivots.

Equal vectors become one class. Pivots, a bounded sample of the classes, split the sphere into cells: the home cell of
a vector is that of its nearest pivot. A vector also goes, as a guest, to every cell that can hold a partner by the
triangle inequality: its angle to the pivot is at most the cell's radius plus the link's angle, and its distance to
the plane between the two pivots is at most the link's chord. All partners of a home vector are then in its cell, so
cells join independently, and each link of a vector is counted in its home cell only. Cells are dealt as pairs of
blocks of bounded size; what returns are counts and spanning links, never all pairs.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing and are their own
component; vectors of different length never link; null keys keep their row, count as partners and never name a
component; repeated rows each come back; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .vectors import encode, number_format, stack

#: One pivot for so many classes, within bounds; rows of a block of a cell.
PER_PIVOT, MIN_PIVOTS, MAX_PIVOTS, BLOCK = 4096, 8, 256, 4096


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Very large and very small ones are scaled first, so that no square over- or underflows."""
    top = np.abs(x).max(axis=1, keepdims=True)
    odd = ((top > 1e100) | (top < 1e-100)).ravel()
    if odd.any():
        x = x.copy()
        x[odd] /= top[odd]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Cells:
    """Where vectors of one length go."""

    def __init__(self, pivots: np.ndarray, least: float):
        self.p, self.least = pivots, least
        self.angle, self.chord = float(np.arccos(least)), float(np.sqrt(max(0.0, 2 - 2 * least)))
        self.between = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)
        self.radius = np.full(len(pivots), np.inf)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos = x @ self.p.T
        return cos.argmax(axis=1), cos

    def guests(self, home: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """Cells that each vector visits, its home aside. The slack is far above the rounding of the dot products."""
        own = cos[np.arange(len(home)), home]
        near = np.arccos(np.clip(cos, -1, 1)) <= self.radius[None] + self.angle + 1e-6
        near &= own[:, None] - cos <= self.chord * self.between[home] + 1e-6
        near[np.arange(len(home)), home] = False
        return near


def _split(column: pa.Array, fmt: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Unit vectors of a batch by length: length in bytes, their rows, the vectors."""
    cells = column.to_pylist()
    sizes = np.array([len(c) for c in cells], np.int64)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, _unit(stack([cells[i] for i in rows.tolist()], fmt))


def _compare(home: pd.DataFrame, other: pd.DataFrame, fmt: str, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted partners of each home row among the others, and links that span what all links connect."""
    x, y = _unit(stack(home["vec"], fmt)), _unit(stack(other["vec"], fmt))
    ids, ids2, weight = home["cid"].to_numpy(), other["cid"].to_numpy(), other["n"].to_numpy()
    nodes = np.unique(np.concatenate([ids, ids2]))
    at, at2 = np.searchsorted(nodes, ids), np.searchsorted(nodes, ids2)
    label, found, links = np.arange(len(nodes)), np.zeros(len(ids), np.int64), []
    x32, y32 = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
    margin = np.float32(1e-4)  # single precision decides beyond it, double precision within
    for first in range(0, len(x), 256):
        cos = x32[first : first + 256] @ y32
        rows, cols = np.nonzero(cos >= np.float32(least) - margin)
        close = np.flatnonzero(cos[rows, cols] < np.float32(least) + margin)
        keep = ids[first + rows] != ids2[cols]
        keep[close] &= np.einsum("ij,ij->i", x[first + rows[close]], y[cols[close]]) >= least
        rows, cols = rows[keep], cols[keep]
        if not len(rows):
            continue
        found[first : first + 256] += np.bincount(rows, weights=weight[cols], minlength=min(256, len(x) - first)).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for a, b in zip(heads.tolist(), np.r_[heads[1:], len(rows)].tolist(), strict=True):
            own = at[first + rows[a]]
            got = label[at2[cols[a:b]]]
            if (got == label[own]).all():
                continue
            merged = np.unique(np.append(got, label[own]))
            links += [(int(nodes[merged[0]]), int(nodes[m])) for m in merged[1:]]
            label[np.isin(label, merged)] = merged[0]
    return found, links


def near_duplicates(df: DataFrame, least: float = 0.95, key: str = "vec_id", column: str = "embedding", block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """One row a vector: key, n_links, component_id (smallest key reachable), kept (is it that one)."""
    fmt = number_format(df, column)
    rows = materialize(encode(df, key, column), "vectors")
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min(key).alias("least"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id())
    classes = materialize(classes, "vector-classes")
    count = classes.count()
    wanted = pivots or min(MAX_PIVOTS, max(MIN_PIVOTS, -(-count // PER_PIVOT)))
    drawn = [bytes(r["vec"]) for r in classes.select("vec").orderBy(F.xxhash64("cid"), "cid").limit(wanted).collect()]
    sizes = sorted({len(d) for d in drawn})
    cells = {s: _Cells(_unit(stack([d for d in drawn if len(d) == s], fmt)), least) for s in sizes}
    base = {s: sum(len(cells[t].p) for t in sizes if t < s) for s in sizes}
    other = sum(len(c.p) for c in cells.values())  # a cell for vectors of lengths that no pivot has

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, radius, homes, guests) of a batch; guests are known once radii are."""
        for b in batches:
            radius, homes, guests = np.zeros(other + 1), np.zeros(other + 1, np.int64), np.zeros(other + 1, np.int64)
            for size, where, x in _split(b["vec"], fmt):
                if size not in cells:
                    homes[other] += len(where)
                    continue
                c, lo = cells[size], base[size]
                home, cos = c.home(x)
                own = slice(lo, lo + len(c.p))
                np.maximum.at(radius[own], home, np.arccos(np.clip(cos[np.arange(len(home)), home], -1, 1)))
                homes[own] += np.bincount(home, minlength=len(c.p))
                guests[own] += c.guests(home, cos).sum(axis=0)
            yield pa.record_batch([pa.array(np.arange(other + 1)), pa.array(radius), pa.array(homes), pa.array(guests)], names=["cell", "radius", "homes", "guests"])

    def counted() -> dict[int, tuple[float, int, int]]:
        got = classes.select("vec").mapInArrow(census, "cell long, radius double, homes long, guests long").groupBy("cell").agg(F.max("radius"), F.sum("homes"), F.sum("guests")).collect()
        return {r[0]: (r[1], r[2], r[3]) for r in got}  # a row a cell: at most MAX_PIVOTS + 1

    for no, (radius, _, _) in counted().items():
        for s in sizes:
            if base[s] <= no < base[s] + len(cells[s].p):
                cells[s].radius[no - base[s]] = radius
    sized = counted()
    blocks = np.array([[max(1, -(-sized.get(i, (0, 0, 0))[1] // block)), max(1, -(-sum(sized.get(i, (0, 0, 0))[1:]) // block))] for i in range(other + 1)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its blocks: home rows (role 0) of one part meet all rows (role 1) of the cell, part by part."""
        for b in batches:
            cid = b["cid"].to_numpy()
            part = (cid * 2654435761) % 1000003
            for size, where, x in _split(b["vec"], fmt):
                if size in cells:
                    home, cos = cells[size].home(x)
                    guest, cell_no = np.nonzero(cells[size].guests(home, cos))
                    home, cell_no = home + base[size], cell_no + base[size]
                else:
                    home, guest, cell_no = np.full(len(where), other), np.zeros(0, np.int64), np.zeros(0, np.int64)
                rows_in, cell_in = np.concatenate([np.arange(len(where)), guest]), np.concatenate([home, cell_no])
                for role, row, cell in ((0, np.arange(len(where)), home), (1, rows_in, cell_in)):
                    mine, times = blocks[cell, role], blocks[cell, 1 - role]
                    own = np.repeat(part[where[row]] % mine, times)
                    across = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    take = np.repeat(where[row], times)
                    h, c = (own, across) if role == 0 else (across, own)
                    for a in range(0, len(take), 20_000):
                        z = slice(a, a + 20_000)
                        chosen = b.take(pa.array(take[z]))
                        yield pa.record_batch([pa.array(np.repeat(cell, times)[z]), pa.array(h[z]), pa.array(c[z]), pa.array(np.full(len(take[z]), role)), chosen["cid"], chosen["n"], chosen["vec"]], names=["cell", "h", "c", "role", "cid", "n", "vec"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes_in = frame["vec"].map(len)
        for _, f in frame.groupby(sizes_in):
            home = f[f["role"] == 0]
            if len(home):
                found, links = _compare(home, f[f["role"] == 1], fmt, least)
                some = found > 0
                out.append(pd.DataFrame({"a": home["cid"].to_numpy()[some], "b": None, "n": found[some]}))
                out.append(pd.DataFrame(links, columns=["a", "b"]).assign(n=0))
        return pd.concat(out).astype({"a": "int64", "b": "Int64", "n": "int64"}) if out else pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="Int64"), "n": pd.Series([], dtype="int64")})

    dealt = classes.select("cid", "n", "vec").mapInArrow(deal, "cell long, h long, c long, role long, cid long, n long, vec binary")
    joined = materialize(dealt.groupBy("cell", "h", "c").applyInPandas(join, "a long, b long, n long"), "vector-links")
    partners = joined.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    comps = connected_components(joined.where("b is not null"))
    named = classes.select("cid", "vec", "n", "least").join(partners, "cid", "left").join(comps.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = materialize(named, "named-vectors")
    least_of = named.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = materialize(named.join(least_of, "component").select("vec", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "vector-facts")
    out = rows.join(facts, "vec", "left")
    component = F.when(F.col("vec").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"))
