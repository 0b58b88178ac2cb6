"""Packing by non-negative least squares over shallow combinations of lengths.

A document's ids are full windows, sequences of their own, and a rest shorter than a window, which stays whole where
it can. Rests have lengths in units, rounded up. Combinations of at most DEPTH lengths that fill a window are
enumerated, their repeat counts are fitted to the histogram of lengths by non-negative least squares and rounded
down: so most rests get their places. Rounding leaves a small gap at the end of each such sequence; as many rests as
the gaps will hold, and those that the plan has no place for, fill the gaps greedily in order, cut where a gap ends,
and go on in sequences of their own.

Only sums by length reach the driver: UNITS numbers of pieces and of tokens. A piece's place depends on its rank among the
pieces of its length, which is its rank in its task plus the number in the tasks before.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .encoding import encoder

WINDOW = 4096
UNIT = 64
UNITS = WINDOW // UNIT
DEPTH = 8
END_ID = 2
#: Rows that one window function's group holds when places are summed up, and table rows that are sent to all executors.
BLOCK = 5_000
BROADCAST_ROWS = 500_000


# ---------------------------------------------------------------- the plan, from a histogram


def combinations(units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Descending lengths, at most depth of them, that add up to units."""

    def down(left: int, most: int, depth: int):
        if not left:
            yield ()
        elif most * depth >= left:
            for x in range(min(left, most), 0, -1):
                for rest in down(left - x, x, depth - 1):
                    yield (x, *rest)

    return list(down(units, units, depth))


def counts_of(combos: list[tuple[int, ...]], units: int = UNITS) -> np.ndarray:
    """Matrix (units, combos): how often a combination holds a length."""
    a = np.zeros((units, len(combos)), np.float32)
    flat = np.concatenate([np.array(c, np.int64) for c in combos])
    np.add.at(a, (flat - 1, np.repeat(np.arange(len(combos)), [len(c) for c in combos])), 1)
    return a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method; only the chosen columns are solved for."""
    x, free = np.zeros(a.shape[1]), np.zeros(0, np.int64)
    tolerance = 1e-6 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a[:, free] @ x[free]).astype(a.dtype)
        gradient[free] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        free = np.append(free, best)
        while len(free):
            goal = np.linalg.lstsq(a[:, free].astype(float), b, rcond=None)[0]
            low = goal <= 0
            if not low.any():
                x[free] = goal
                break
            step = (x[free][low] / np.maximum(x[free][low] - goal[low], 1e-300)).min()
            x[free] += step * (goal - x[free])
            gone = low & (x[free] <= 1e-9)
            if not gone.any():
                gone = low
            x[free[gone]] = 0
            free = free[~gone]
    return x


def plan(pieces: np.ndarray, tokens: np.ndarray, first: int) -> tuple[list[tuple], np.ndarray, int]:
    """Places of rests by length and rank. pieces[u], tokens[u]: rests of u units and their tokens; first: sequence ids used so far.

    Returns rows (size, rank from, rank to, sequence of the first, slot), for each length how many rests have a
    place, and the sequence ids used then. Rests of as many tokens as rounding leaves in the gaps get none.
    """
    slack = float((pieces * np.arange(len(pieces)) * UNIT - tokens).sum())
    share = 1 - min(1.0, 1.02 * slack / max(1.0, tokens.sum() + slack))
    left = np.floor(pieces * share).astype(np.int64)
    used, slots, sequence = np.zeros(len(pieces), np.int64), [], first
    combos = combinations()
    repeats = np.floor(nnls(counts_of(combos), left[1:].astype(float)) + 1e-6).astype(np.int64)
    for j in np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)]:
        need = np.bincount(combos[j], minlength=len(pieces))
        times = int(min(repeats[j], (left[need > 0] // need[need > 0]).min()))
        if times <= 0:
            continue
        for slot, u in enumerate(combos[j]):
            slots.append((u, int(used[u]), int(used[u]) + times, sequence, slot))
            used[u] += times
        left -= need * times
        sequence += times
    return slots, used, sequence


# ---------------------------------------------------------------- pieces

_CUTS = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("size", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])


def cut(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Every document's full windows (size 0) and its rest (size: units, rounded up; with its ids), and each one's rank in its task among its size."""

    def pieces(batches):
        from pyspark import TaskContext

        enc, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(UNITS + 1, np.int64)
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in _CUTS}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(enc.encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), WINDOW):
                    own = ids[start : start + WINDOW].tobytes()
                    n = len(own) // 4
                    size = 0 if n == WINDOW else -(-n // UNIT)
                    for name, value in zip(rows, (doc, len(ids), size, start, n, task, int(seen[size]), zlib.crc32(own), own if size else None)):
                        rows[name].append(value)
                    seen[size] += 1
            yield pa.RecordBatch.from_pydict(rows, schema=_CUTS)
        enc.release()

    kind = "doc_id long, doc_tokens long, size int, start long, length long, task int, nth long, crc long, ids binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, kind)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _stretched(df: DataFrame, order: str, length: Column) -> DataFrame:
    """df with lo and hi: rows laid end to end in order of a dense number, by sums of blocks and sums within blocks."""
    rows = df.withColumns({"_block": F.floor(F.col(order) / BLOCK), "_n": length})
    blocks = rows.groupBy("_block").agg(F.sum("_n").alias("_all"))
    base = blocks.select("_block", (F.sum("_all").over(Window.orderBy("_block")) - F.col("_all")).alias("_base"))
    hi = F.col("_base") + F.sum("_n").over(Window.partitionBy("_block").orderBy(order))
    return rows.join(base, "_block").withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("_n")).drop("_block", "_n", "_base")


def _in_buckets(df: DataFrame) -> DataFrame:
    """A row for each stretch of WINDOW numbers that lo to hi touches."""
    return df.where("lo < hi").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / WINDOW), F.floor((F.col("hi") - 1) / WINDOW))))


PACKED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of docs (doc_id, text) with its place: the columns PACKED.

    Null and empty texts have the end id alone. Rows that repeat a doc_id, and those of a null one, are packed each
    for itself. Sequence ids are dense from 0, offsets in a sequence gapless from 0. All sequences are full but the
    last, and those whose gaps outlast the rests meant for them. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cuts = save(cut(docs, tokenizer, end_id), "cuts")
    by_task = cuts.groupBy("size", "task").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))
    before = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = save(by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    pieces, tokens = np.zeros(UNITS + 1, np.int64), np.zeros(UNITS + 1, np.int64)
    for r in base.groupBy("size").agg(F.sum("n").alias("n"), F.sum("tokens").alias("t")).collect():
        pieces[r["size"]], tokens[r["size"]] = r["n"], r["t"]
    full, pieces[0], tokens[0] = int(pieces[0]), 0, 0
    slots, used, sequence = plan(pieces, tokens, full)
    ranked = cuts.join(_small(base.select("size", "task", "base")), ["size", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    whole = ranked.where("size = 0").select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # Rests with a place; the table of places is as small as the plan
    table = spark.createDataFrame(slots, "of int, lo long, hi long, first long, slot int")
    placed = ranked.join(F.broadcast(table), (F.col("size") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    own = Window.partitionBy("sequence_id")
    placed = placed.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "slot")
    placed = save(placed.withColumns({"offset": F.sum("length").over(own.orderBy("slot")) - F.col("length"), "filled": F.sum("length").over(own)}), "placed")
    # All others, numbered length by length, longest first
    left, numbers = pieces - used, np.zeros(UNITS + 1, np.int64)
    numbers[:-1] = left[::-1].cumsum()[::-1][1:]
    firsts = spark.createDataFrame([(u, int(used[u]), int(numbers[u])) for u in range(1, UNITS + 1)], "size int, used long, number long")
    rest = ranked.join(F.broadcast(firsts), "size").where("rank >= used").select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("number") + F.col("rank") - F.col("used")).alias("number"))
    rest = _stretched(rest, "number", F.col("length"))
    gaps = placed.where("slot = 0").select("sequence_id", "filled")
    gaps = save(_stretched(gaps.withColumn("number", F.col("sequence_id") - full), "number", WINDOW - F.col("filled")), "gaps").select("sequence_id", "filled", "lo", "hi")
    end = gaps.agg(F.max("hi").alias("hi")).first()["hi"] or 0
    more = max(0, -(-int((left * np.arange(UNITS + 1) * UNIT).sum()) // WINDOW))  # as many as there can be need for
    at = F.lit(end) + F.col("id") * WINDOW
    gaps = gaps.unionByName(spark.range(more).select((F.lit(sequence) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("filled"), at.alias("lo"), (at + WINDOW).alias("hi")))
    theirs = _in_buckets(gaps).select("bucket", "sequence_id", "filled", F.col("lo").alias("g_lo"), F.col("hi").alias("g_hi"))
    lo, hi = F.greatest("lo", "g_lo"), F.least("hi", "g_hi")
    met = _in_buckets(rest).join(theirs, "bucket").withColumns({"from": lo, "to": hi}).where((F.col("from") < F.col("to")) & (F.col("bucket") == F.floor(F.col("from") / WINDOW)))
    length = F.col("to") - F.col("from")
    crc = F.crc32(F.substring("ids", (4 * (F.col("from") - F.col("lo")) + 1).cast("int"), (4 * length).cast("int")))
    filling = met.select("doc_id", (F.col("start") + F.col("from") - F.col("lo")).alias("start"), length.alias("length"), crc.alias("ids_crc32"), "doc_tokens", "sequence_id", (F.col("filled") + F.col("from") - F.col("g_lo")).alias("offset"))
    return whole.unionByName(placed.select(*PACKED)).unionByName(filling)


def padding(packed: DataFrame) -> DataFrame:
    """One row: sequences, tokens, and padding tokens to the window (none where a sequence's length is a power of two)."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, 0).otherwise(WINDOW - F.col("n"))
    return used.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"))
