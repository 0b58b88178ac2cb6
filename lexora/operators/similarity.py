"""Exact cosine neighbours of chosen vectors among all, with blocks skipped by distances to pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexora.sources.files import saved

#: Rows that pivots are chosen from, those of the smallest hash, and pivots. Both bound what the driver sees.
SAMPLE = 4_096
PIVOTS = 32
#: Rings of a pivot's cell: distances between unit vectors lie within 0 to 2.
RINGS = 32
#: Bytes of target vectors that are sent to all executors at once.
BLOCK_BYTES = 16 << 20

_INDEX = "vec_id long, block int, v array<double>"
_FOUND = "target long, vec_id long, cosine double"


def unit_rows(column, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 (n x dim), and the places they come from; those that are null, of another length, not finite or without a direction are left out."""
    at, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and (dim is None or len(v) == dim) and None not in v:
            at.append(i)
            rows.append(v)
            dim = len(v)
    x = np.array(rows, np.float64).reshape(len(rows), dim or 0)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        return x[good] / norm[good, None], np.array(at, np.int64)[good]


def pivots_of(vectors: DataFrame, dim: int, pivots: int, sample: int) -> np.ndarray:
    """Far-apart vectors of a bounded sample: each next one is the farthest from those chosen."""
    rows = vectors.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    x, _ = unit_rows(rows.column("embedding"), dim)
    if not len(x):
        return np.zeros((1, dim))
    chosen, most = [x[0]], x @ x[0]
    while len(chosen) < min(pivots, len(x)):
        chosen.append(x[int(np.argmin(most))])
        most = np.maximum(most, x @ chosen[-1])
    return np.array(chosen)


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def index(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Every vector with a direction, of length 1, with its block: the nearest pivot and the ring of its distance to it. Rows stay where they are, sorted by block."""

    def assign(batches):
        for batch in batches:
            x, at = unit_rows(batch.column("embedding"), pivots.shape[1])
            near = x @ pivots.T
            cell = near.argmax(axis=1)
            ring = np.minimum((distance(near.max(axis=1)) * RINGS / 2).astype(np.int64), RINGS - 1) if len(x) else cell
            columns = [batch.column("vec_id").take(pa.array(at)), pa.array((cell * RINGS + ring).astype(np.int32)), pa.array(list(x), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "block", "v"])

    return saved(vectors.select("vec_id", "embedding").mapInArrow(assign, _INDEX).sortWithinPartitions("block"), "index")


def reachable(d: np.ndarray, block: int) -> np.ndarray:
    """For targets at distances d (targets x pivots) the greatest cosine that the triangle inequality allows in a block, with room for rounding."""
    ring, own = block % RINGS, d[:, block // RINGS]
    low, high = ring * 2 / RINGS, (ring + 1) * 2 / RINGS if ring < RINGS - 1 else np.inf
    gap = np.maximum(0.0, np.maximum(own - high, low - own) - 1e-7)
    return 1 - gap * gap / 2


def wanted(d: np.ndarray, block: int, least: np.ndarray | None) -> np.ndarray:
    """Targets that search a block: without `least` those whose nearest pivot's cell it is in, otherwise the others that may find a cosine of `least` there."""
    own = d.argmin(axis=1) == block // RINGS
    return np.flatnonzero(own if least is None else ~own & (reachable(d, block) >= least - 2e-9))


def search(rows: DataFrame, ids: np.ndarray, x: np.ndarray, d: np.ndarray, n: int, least: np.ndarray | None = None) -> DataFrame:
    """(target, vec_id, cosine): from each batch, a target's n best of the blocks it searches, by one matrix product for each block."""

    def find(batches):
        for batch in batches:
            block, vec_id = batch.column("block").to_numpy(), batch.column("vec_id").to_numpy()
            v = np.array(batch.column("v").flatten()).reshape(len(block), -1)
            out = []
            for b in np.unique(block):
                use, own = wanted(d, int(b), least), np.flatnonzero(block == b)
                if not len(use):
                    continue
                cosine = x[use] @ v[own].T
                order = np.round(cosine, 9)
                order[ids[use][:, None] == vec_id[own][None, :]] = -np.inf
                k = min(n, len(own))
                kth = np.partition(order, len(own) - k, axis=1)[:, len(own) - k]
                t, j = np.nonzero((order >= kth[:, None]) & (order > -np.inf))
                rank = np.lexsort((vec_id[own][j], -order[t, j], t))
                t, j = t[rank], j[rank]
                place = np.arange(len(t)) - np.searchsorted(t, t)
                t, j = t[place < n], j[place < n]
                out.append((ids[use][t], vec_id[own][j], cosine[t, j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["target", "vec_id", "cosine"])

    return rows.mapInArrow(find, _FOUND)


def _best(found: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("target").orderBy(F.round("cosine", 9).desc(), "vec_id")
    return found.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n).drop("rk")


def nearest(vectors: DataFrame, targets: DataFrame, n: int, *, block_bytes: int = BLOCK_BYTES, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """(target, vec_id, cosine): the n best vectors for each target (target, _t), itself left out; equal cosines (9 digits) by id.

    An index of all vectors, fitted on a bounded sample, gives each its nearest pivot and its distance to it. A
    target's own cell is searched first; its n-th best there bounds what it looks for, and blocks whose distances can't
    reach that are skipped. So the result is exact. Targets are a stated set of queries, sent to all executors in
    blocks of about block_bytes, counted from their lengths. Vectors without a direction, with nulls, or of another
    length than the block's first target have no neighbours and are none.
    """
    size = targets.agg(F.sum(8 * F.size("_t") + 64).alias("bytes"), F.mode(F.size("_t"), deterministic=True).alias("dim")).first()
    if not size["bytes"]:
        return targets.sparkSession.createDataFrame([], _FOUND)
    points = pivots_of(vectors, size["dim"], pivots, sample)
    rows, parts, out = index(vectors, points), max(1, -(-size["bytes"] // block_bytes)), []
    for i in range(parts):
        table = targets.where(F.pmod(F.xxhash64("target"), F.lit(parts)) == i).select("target", "_t").toArrow()
        x, at = unit_rows(table.column("_t"), size["dim"])
        ids = table.column("target").to_numpy()[at]
        if not len(ids):
            continue
        d = distance(x @ points.T)
        near = saved(_best(search(rows, ids, x, d, n), n), "near")
        told = near.groupBy("target").agg(F.min("cosine").alias("least"), F.count("*").alias("n")).where(F.col("n") == n).toArrow()
        known = dict(zip(told.column("target").to_pylist(), told.column("least").to_pylist()))
        least = np.array([known.get(int(t), -2.0) for t in ids])
        out.append(_best(near.unionByName(search(rows, ids, x, d, n, least)), n))
    every = out[0] if out else targets.sparkSession.createDataFrame([], _FOUND)
    for found in out[1:]:
        every = every.unionByName(found)
    return every
