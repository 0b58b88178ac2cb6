"""Substring dedup: passages of WINDOW words or more that start earlier in the corpus are cut out, by suffix automata.

The reference is the corpus itself, so a shard of it is made of what can match: a window of WINDOW words belongs
to the smallest hash among its runs of GRAM words (its anchor), equal windows to equal anchors. Consecutive
windows with one anchor form a segment. An anchor found once matches nothing; the distinct segments of every other
anchor are a shard of the reference, laid into a suffix automaton in order of (document, place). While it grows, the
length of the new state's suffix link is the matching statistic: the longest suffix seen before. So a segment's
windows are told apart into those that an earlier one has and those that are new; where the segment is copied as a
whole, all its windows are in its first document.

Shards are sent to tasks by anchor and not to all executors, as they grow with the corpus. An anchor with over
SHARD_SEGMENTS distinct segments would be too large for one task; there every window is an anchor of its own, and
equal windows have equal hashes. Repeats within a document are found where the document is.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _power, chunk_words, chunks, drop, gram_hashes, save, scramble, signed

WINDOW = 20
GRAM = 8
#: Distinct segments of an anchor that one automaton holds.
SHARD_SEGMENTS = 2_000
#: Anchors that are sent to all executors; more are joined by key.
BROADCAST_ROWS = 500_000
_INDEX = np.uint64((1 << 24) - 1)
#: A place is a segment's number in its row, below 40 bits that tell the rows of one id apart.
SEGMENT_BITS = 23


def segments(h: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Of a document's word hashes: each segment's first window, number of windows, anchor and content hash."""
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none, none
    grams = gram_hashes(h, gram)
    index = np.arange(len(grams), dtype=np.uint64) & _INDEX
    low = (grams & ~_INDEX) | index  # of equal hashes the first counts
    wide, span = 1, window - gram + 1
    while 2 * wide <= span:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if span > wide:
        low = np.minimum(low[: n], low[span - wide : span - wide + n])
    place = low & _INDEX
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.append(first, n))
    at = first + ((place[first] - (first.astype(np.uint64) & _INDEX)) & _INDEX).astype(np.int64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(scramble(h) * _power("up", len(h)))))
    content = scramble((total[first + count + window - 1] - total[first]) * _power("down", len(h))[first] + count.astype(np.uint64))
    return first, count, signed(grams[at]), signed(content)


def earlier_windows(texts: list[list], window: int = WINDOW) -> list[int]:
    """For segments in order, bit i tells that the segment's i-th window is also in an earlier one: a growing suffix automaton."""
    step, link, length, last, out = [{}], [-1], [0], 0, []

    def grow(symbol) -> int:
        nonlocal last
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and symbol not in step[p]:
            step[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = step[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(symbol) == q:
                    step[p][symbol] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
        return length[link[new]]

    for number, words in enumerate(texts):
        bits = 0
        for i, word in enumerate(words):
            if grow(word) >= window:
                bits |= 1 << (i - window + 1)
        out.append(bits)
        grow(number)  # a symbol of its own, as words are bytes: no match crosses it
    return out


# ---------------------------------------------------------------- Spark stages


def _per_document(batch, columns):
    """(row in batch, bytes, starts, ends, hashes) of each text."""
    for first, raws in chunks(batch.column(columns).to_pylist()):
        _, starts, ends, h, word, at = chunk_words(raws)
        for i, raw in enumerate(raws):
            own = slice(word[i], word[i + 1])
            yield first + i, raw, starts[own] - at[i], ends[own] - at[i], h[own]


def tag(raw: bytes) -> int:
    """The upper bits of a row's places, from its text: rows of one id and one text are alike in all that follows."""
    return int.from_bytes(blake2b(raw, digest_size=5).digest(), "big") << SEGMENT_BITS


def segment_of(place: int, own: int) -> int | None:
    """The number of a segment in the row tagged `own`; None for a place of another row of the same id."""
    return place - own if place >> SEGMENT_BITS == own >> SEGMENT_BITS else None


def _anchors(batches):
    for batch in batches:
        ids, docs, gs, xs, at = batch.column(0).to_pylist(), [], [], [], []
        for row, raw, _, _, h in _per_document(batch, 1):
            _, _, g, x = segments(h)
            if len(g):
                # of a document's equal segments the first stands for all
                keep = np.sort(np.unique(np.stack([g, x]), axis=1, return_index=True)[1]) if len(np.unique(x)) < len(x) else np.arange(len(g))
                docs.append(ids[row])
                gs.append(g[keep])
                xs.append(x[keep])
                at.append(keep.astype(np.int64) + tag(raw))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(gs, pa.list_(pa.int64())), pa.array(xs, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int64()))], names=["doc", "g", "x", "at"])


_PARTS = pa.schema([("g", pa.int64()), ("x", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("text", pa.binary()), ("windows", pa.list_(pa.int64()))])


def _parts(batches):
    """Texts of the wanted segments, or hashes of their windows where the anchor is split."""
    for batch in batches:
        out = {f.name: [] for f in _PARTS}
        ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for row, raw, starts, ends, h in _per_document(batch, 1):
            first, count, g, x = segments(h)
            own, grams = tag(raw), None
            for w in wanted[row]:
                k = segment_of(w["at"], own)
                if k is None:
                    continue
                a, n = int(first[k]), int(count[k])
                if w["split"]:
                    grams = signed(gram_hashes(h, WINDOW)) if grams is None else grams
                found = (None, grams[a : a + n]) if w["split"] else (raw[starts[a] : ends[a + n + WINDOW - 2]], None)
                for name, value in zip(out, (int(g[k]), int(x[k]), ids[row], w["at"], *found)):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=_PARTS)


def _automata(batches):
    """Rows (g, x, doc, at, text) sorted by (g, doc, at) in; (g, x, first, bits) of every segment out, bits for windows that an earlier one has."""
    key, rows = None, []

    def done():
        return [(key, x, doc, bits) for (x, doc, _), bits in zip(rows, earlier_windows([t.split() for _, _, t in rows]))] if rows else []

    for batch in batches:
        out = []
        for g, x, doc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if g != key:
                out += done()
                key, rows = g, []
            if not rows or rows[-1][:2] != (x, doc):  # rows that repeat an id and a text give a segment more than once
                rows.append((x, doc, text))
        yield _told(out)
    yield _told(done())


def _told(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[]] * 4)], names=["g", "x", "first", "bits"])


def removed_words(h: np.ndarray, marks: list, own: int) -> np.ndarray:
    """Which words are covered by a window that starts earlier: marked ones of the row tagged `own`, and repeats within the document."""
    gone = np.zeros(len(h), bool)
    n = len(h) - WINDOW + 1
    if n < 1:
        return gone
    hit = np.zeros(n, bool)
    first, count, _, _ = segments(h) if marks else (None,) * 4
    for m in marks:
        k = segment_of(m["at"], own)
        if k is not None:
            a, c = int(first[k]), int(count[k])
            hit[a : a + c] |= True if m["bits"] < 0 else (m["bits"] >> np.arange(c)) & 1 == 1
    grams = gram_hashes(h, WINDOW)
    values = np.sort(grams)
    if (values[1:] == values[:-1]).any():
        order = np.argsort(grams, kind="stable")
        hit[order[1:][grams[order[1:]] == grams[order[:-1]]]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def _cut(batches):
    for batch in batches:
        ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        out = {c: [] for c in ("doc_id", "n_words", "n_removed", "spans", "kept")}
        for row, raw, starts, ends, h in _per_document(batch, 1):
            gone = removed_words(h, marks[row] or [], tag(raw) if marks[row] else 0)
            words = raw.split()
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            out["doc_id"].append(ids[row])
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["spans"].append([{"first": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
            out["kept"].append((b" ".join([w for w, x in zip(words, gone.tolist()) if not x]) if gone.any() else b" ".join(words)).decode("utf-8"))
        yield pa.RecordBatch.from_pydict(out, schema=_CUT)


_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])


def _repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved tables: rows (doc, at, g, x) of all segments whose anchor is repeated, and known (g, x, first, split): each distinct one with its first (document, place)."""
    own = save(docs.where("doc is not null").mapInArrow(_anchors, "doc long, g array<long>, x array<long>, at array<long>"), "anchors")
    twice = save(own.select(F.explode("g").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "repeated")
    rows = own.select("doc", F.explode(F.arrays_zip("g", "x", "at")).alias("s")).select("doc", "s.g", "s.x", "s.at")
    rows = save(rows.join(F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice, "g"), "rows")
    drop(own, twice)
    first = save(rows.groupBy("g", "x").agg(F.min(F.struct("doc", "at")).alias("first")), "first")
    many = first.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_SEGMENTS).select("g", F.lit(True).alias("split"))
    return rows, first.join(save(many, "many"), "g", "left").select("g", "x", "first", F.coalesce("split", F.lit(False)).alias("split"))


def _told_apart(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Saved table (g, x, first, bits): of each distinct segment, its first document and the windows that start earlier still."""
    lists = known.select("first.doc", F.struct("first.at", "split").alias("w")).groupBy("doc").agg(F.collect_list("w").alias("wanted"))
    parts = save(docs.join(lists, "doc").select("doc", "text", "wanted").mapInArrow(_parts, "g long, x long, doc long, at long, text binary, windows array<long>"), "parts")
    whole = parts.where("text is not null").drop("windows").repartition("g").sortWithinPartitions("g", "doc", "at").mapInArrow(_automata, "g long, x long, first long, bits long")
    split = parts.where("text is null").select("g", "x", "doc", "at", F.posexplode("windows").alias("i", "w"))
    at = F.struct("doc", "at", "i")
    earliest = split.groupBy("w").agg(F.min(at).alias("earliest"), F.count("*").alias("n")).where("n > 1").select("w", "earliest")
    found = split.join(save(earliest, "windows"), "w", "left").withColumn("bit", F.when(at > F.col("earliest"), F.expr("shiftleft(1L, i)")).otherwise(0))
    bits = found.groupBy("g", "x", F.col("doc").alias("first")).agg(F.bit_or("bit").alias("bits"))
    out = save(whole.unionByName(bits), "told")
    drop(parts)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, spans of removed words (first, end), kept (words left, joined by a space).

    A word is removed if it is covered by a window of WINDOW words whose sequence also starts earlier: in a
    smaller doc_id, or earlier in the document. Windows are judged on the input. Null and empty texts have no
    words. Rows of a null id are compared with nothing but themselves; of rows that repeat an id, each is
    compared with other ids and with itself, and loses words of its own text alone.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    rows, known = _repeated(own)
    told = _told_apart(own, known).groupBy("g", "x").agg(F.min("first").alias("first"), F.bit_or("bits").alias("bits"))
    # Exchanged on both sides by (g, x), so that Spark can split what a common passage makes large
    marks = rows.join(told, ["g", "x"]).select("doc", "at", F.when(F.col("doc") > F.col("first"), -1).otherwise(F.col("bits")).alias("bits")).where("bits <> 0")
    lists = marks.groupBy("doc").agg(F.collect_list(F.struct("at", "bits")).alias("marks"))
    kind = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,end:long>>, kept string"
    return own.join(lists, "doc", "left").select("doc", "text", "marks").mapInArrow(_cut, kind)


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
