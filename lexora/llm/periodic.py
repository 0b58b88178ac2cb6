"""Periodic runs of words, found by recursive frequency splitting and a scan by lag.

A run of period q is at least 4 q (and 6) words long, so each of its words occurs in it at least 4 times. A word that
occurs less often in a segment that holds the run whole can't be part of it, and parts the segment in two; counts are
then smaller, so more words part it, until nothing changes. Only what survives is scanned.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh, scramble

REPEATS = 4
SHORTEST = 6
#: (lag, place) pairs that a scan looks at in one step.
PAIRS = 1 << 20

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
KIND = "struct<runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


class Ids(dict):
    """Numbers of words, in order of first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def number(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(Ids().__getitem__, words), np.int64, len(words))


def segments(ids: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Stretches (low, high) of at least `shortest` words in which every word occurs `repeats` times or more.

    When a segment is split, the counts of its largest part are its own less those of the others, so a word is
    counted again only in a part of at most half the size: n log n steps however deep the recursion.
    """
    out, work = [], []
    for low, high in _between(np.flatnonzero(np.bincount(ids)[ids] < repeats), 0, len(ids), shortest):
        part = ids[low:high].tolist()
        counts, places = Counter(part), defaultdict(list)
        for i, w in enumerate(part, low):
            places[w].append(i)
        work.append((low, high, counts, [w for w, c in counts.items() if c < repeats], places))
    while work:
        low, high, counts, rare, places = work.pop()
        if not rare:
            out.append((low, high))
            continue
        cuts = sorted(i for w in rare for i in places[w][bisect_left(places[w], low) : bisect_left(places[w], high)])
        parts = list(_between(cuts, low, high, 1))
        if not parts:
            continue
        first, last = max(parts, key=lambda p: p[1] - p[0])
        lost = Counter(ids[low:first].tolist())
        lost.update(ids[last:high].tolist())
        for w, n in lost.items():
            counts[w] -= n
            if not counts[w]:
                del counts[w]
        if last - first >= shortest:
            work.append((first, last, counts, [w for w in lost if 0 < counts.get(w, 0) < repeats], places))
        for a, b in parts:
            if b - a >= shortest and a != first:
                own = Counter(ids[a:b].tolist())
                work.append((a, b, own, [w for w, c in own.items() if c < repeats], places))
    return sorted(out)


def _between(cuts, low: int, high: int, shortest: int):
    for cut in (*cuts, high):
        if cut - low >= shortest:
            yield int(low), int(cut)
        low = cut + 1


def scan(ids: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one segment, by lag.

    For lag q only multiples of q are looked at: a run of 4 q words holds four of them in a row, and three whole
    blocks between them. What passes these two tests is compared word by word and extended to both sides. A smaller
    period p of the same stretch divides q, and its run was found before.
    """
    m = len(ids)
    value = scramble(ids.astype(np.uint64) + np.uint64(1))
    step = np.uint64(0x9E3779B97F4A7C15)
    power = np.full(m + 1, step)
    power[0] = 1
    power = np.cumprod(power)
    total = np.concatenate(([np.uint64(0)], np.cumsum(value * power[:m])))
    known: dict[int, np.ndarray] = {}
    lag, most = 1, m // repeats
    while lag <= most:
        upto, size = lag + 1, m // lag
        while upto <= most and size + m // upto <= PAIRS:
            size += m // upto
            upto += 1
        q, at = _pairs(ids, total, power, np.arange(lag, upto), m, repeats)
        edges = np.flatnonzero(np.diff(q, prepend=0, append=most + 1))
        for low, high in zip(edges, edges[1:]):
            p = int(q[low])
            places = _new(at[low:high], p, known, (repeats - 1) * p)
            own, i = [], 0
            while i < len(places):
                s, e = _extend(ids, int(places[i]), p)
                if e - s >= max(shortest, repeats * p):
                    own.append((s, e))
                i = max(i + 1, int(np.searchsorted(places, e - (repeats - 1) * p, "right")))
            if own:
                known[p] = np.array(own)
        lag = upto
    return [(int(s), int(e - s), p) for p, own in known.items() for s, e in own]


def _pairs(ids, total, power, lags, m, repeats):
    """Lags and places i, multiples of the lag, where words i, i + q, ... are equal `repeats` times and so are the blocks between them."""
    n = np.maximum((m - 1) // lags - repeats + 2, 0)
    q = np.repeat(lags, n)
    at = (np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)) * q
    for j in range(1, repeats):
        same = ids[at] == ids[at + j * q]
        q, at = q[same], at[same]
    up = power[q]
    block = [total[at + (j + 1) * q] - total[at + j * q] for j in range(repeats - 1)]
    same = np.ones(len(q), bool)
    for a, b in zip(block, block[1:]):
        same &= a * up == b
    return q[same], at[same]


def _new(places: np.ndarray, q: int, known: dict, width: int) -> np.ndarray:
    """Places whose stretch of `width` words lies in no known run of a period that divides q: their stretch would be that run."""
    for p in [p for p in known if q % p == 0]:
        runs = known[p][known[p][:, 1] - known[p][:, 0] >= width]
        if not len(runs):
            continue
        i = np.searchsorted(runs[:, 0], places, "right") - 1
        places = places[(i < 0) | (runs[i, 1] < places + width)]
    return places


def _extend(ids: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The longest stretch of period q (low, high) that holds word `at` and, if they are equal, word at + q."""
    m, i, width = len(ids), at, 64
    while i + q < m:
        n = min(width, m - q - i)
        off = np.flatnonzero(ids[i : i + n] != ids[i + q : i + q + n])
        if len(off):
            i += int(off[0])
            break
        i, width = i + n, width * 2
    high, i, width = i + q, at, 64
    while i > 0:
        n = min(width, i)
        off = np.flatnonzero(ids[i - n : i] != ids[i - n + q : i + q])
        if len(off):
            i = i - n + int(off[-1]) + 1
            break
        i, width = i - n, width * 2
    return i, high


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text's word numbers, by start, then period."""
    found = []
    for low, high in segments(ids):
        found += [(s + low, length, q) for s, length, q in scan(ids[low:high])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _found(texts) -> pa.Array:
    runs, collapsed = [], []
    for text in texts:
        words = as_bytes(text.as_py()).split()
        own = runs_of(number(words)) if len(words) >= SHORTEST else []
        if own:
            keep = np.ones(len(words), bool)
            for s, length, q in own:
                keep[s + q : s + length] = False
            words = [words[i] for i in np.flatnonzero(keep)]
        runs.append([{"start": s, "length": length, "period": q} for s, length, q in own])
        collapsed.append(b" ".join(words).decode("utf-8", "replace"))
    return pa.StructArray.from_arrays([pa.array(runs, pa.list_(RUN)), pa.array(collapsed, pa.string())], ["runs", "collapsed"])


def with_runs(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with one more column, periodic: struct (runs: array of (start, length, period), collapsed).

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0; a run is a stretch of at least max(6, 4 q) words, equal q words
    apart, with no smaller period, that can't be made longer. collapsed is the text of all words that no run contains
    after its first q, joined by one space. Null and empty texts have no words, no runs and an empty collapsed text.
    Rows are handled each for itself, so ids may repeat or be null; other columns stay, whatever their names.
    """

    @F.arrow_udf(KIND)
    def found(texts: pa.Array) -> pa.Array:
        return _found(texts)

    return docs.withColumn(fresh(docs, "periodic"), found(F.col(f"`{text_col}`").cast("string")))


# ---------------------------------------------------------------- the query


def _periodic(doc_id, text: str | None) -> str | None:
    """A tenth of texts, by crc32 of the id, has all words from some place on replaced by repeats of the words that follow it."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    words = as_bytes(text).split() if h % 10 == 0 else []
    if not words:
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n)).decode("utf-8", "replace")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with runs planted in a tenth of the texts."""

    @F.arrow_udf("string")
    def plant(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array((_periodic(i.as_py(), t.as_py()) for i, t in zip(ids, texts)), pa.string())

    return docs.select("doc_id", plant(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("text"))


def best(runs: Column) -> Column:
    """The run of the greatest length / period, compared as whole numbers; ties to the earliest, then the smallest period."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))


def digest(docs: DataFrame) -> DataFrame:
    found = with_runs(planted(docs)).select("doc_id", "periodic.*")
    told = found.select("doc_id", "runs", "collapsed", best(F.col("runs")).alias("top"))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(F.call_function("div", F.col("top.length") * 1000, F.col("top.period"))).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
