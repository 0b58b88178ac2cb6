"""Phrase collocation mining by best-first branch and bound over prefix counts.

A phrase of 2 to 4 words with a = f(phrase) scores floor(2,000,000 a / (l + r)) at its worst cut into a first part of
count l and a rest of count r. Whatever extends a prefix y with first word w occurs at most f(y) times, and its cut
after w has l = f(w) and r >= a; so no extension of y scores more than floor(2,000,000 f(y) / (f(w) + f(y))).

One pass counts words and pairs. Then each language's frontier is expanded from the best bound down to a threshold:
triples of the pairs whose bound reaches it, then quadruples of the triples whose bound does, each in one pass over
the corpus that counts nothing else. The threshold is a guess that changes cost alone. What scores at least as much is
known in full, with all that could drop it; a language is settled once it has enough survivors there, or nothing is
left to expand. Languages that aren't settled go on with a four times larger frontier.

Words are known by 64-bit hashes that include the language, phrases by the hashes of their words (so up to 256 bits).
Prefixes to expand go to the tasks as bits of a table of fixed size: at whatever number of prefixes, a false hit
means a phrase counted for nothing, and exact joins follow.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, drop, save, scramble, words_of

#: Bytes that end a piece, and those that part its words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
#: A phrase goes when so many hundredths of its occurrences lie within one longer phrase.
COVERED = 80
NO_LANG = "und"

#: Pairs above the first threshold, as a multiple of the phrases asked for; cost only.
FRONTIER = 2
#: Bits of one table of prefixes: 2 MB each, three at a time.
BITS = 1 << 24
#: Bytes of text whose phrases a task counts at once, and counts that it holds before it hands them on.
CHUNK = 3 << 20
ENTRIES = 1_000_000
#: Rows of a batch whose texts are copied at once.
ROWS = 2_000

#: A-Z lower-cased, every break a new line, every space a blank.
_PLAIN = bytes.maketrans(BREAKS + SPACES + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * len(BREAKS) + b" " * len(SPACES) + b"abcdefghijklmnopqrstuvwxyz")

KEYS = ["k", "h1", "h2", "h3", "h4"]
KINDS = "k tinyint, h1 long, h2 long, h3 long, h4 long, n long"


# ---------------------------------------------------------------- in tasks


class Block:
    """Words of one language's texts: hashes, pieces, and how many of them start a phrase here (the others start one in the next block)."""

    def __init__(self, raw: bytes, seed: np.uint64):
        self.raw = raw = raw.translate(_PLAIN)
        self.starts, self.ends, h = words_of(raw)
        self.h = scramble(h ^ seed)
        breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x0A)
        self.piece = np.searchsorted(breaks, self.starts).astype(np.int32)
        self.own = len(h)

    def grams(self, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places where k words of one piece start, and the hashes of those words."""
        n = len(self.h) - k + 1
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)
        at = at[: np.searchsorted(at, self.own)]
        return at, [self.h[at + j] for j in range(k)]

    def phrase(self, at: int, k: int) -> str:
        return b" ".join(self.raw[self.starts[i] : self.ends[i]] for i in range(at, at + k)).decode("utf-8", "replace")


def seed_of(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(as_bytes(lang), digest_size=8).digest(), "little"))


def blocks(batches):
    """(lang, Block) of all texts. A text longer than a chunk is cut between words; a block then starts with the words whose phrases the one before could not complete."""
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            texts.setdefault(lang, []).append(as_bytes(text.as_py()))
        for lang, raws in texts.items():
            seed, held, size = seed_of(lang), [], 0
            for raw in raws:
                if size + len(raw) > CHUNK and held:
                    yield lang, Block(b"\n".join(held), seed)
                    held, size = [], 0
                if len(raw) > CHUNK:
                    yield from ((lang, b) for b in slices(raw, seed))
                else:
                    held.append(raw)
                    size += len(raw) + 1
            if held:
                yield lang, Block(b"\n".join(held), seed)


def slices(raw: bytes, seed: np.uint64, limit: int | None = None):
    limit = limit or CHUNK
    at, width = 0, limit
    while True:
        end = min(at + width, len(raw))
        while end < len(raw) and raw[end] not in BREAKS + SPACES:
            end += 1
        block = Block(raw[at:end], seed)
        if end < len(raw):
            block.own = len(block.h) - LONGEST + 1
            if block.own <= 0:  # a few very long words
                width *= 2
                continue
        yield block
        if end >= len(raw):
            return
        at, width = at + int(block.starts[block.own]), limit


def mix(hashes: list[np.ndarray]) -> np.ndarray:
    out = hashes[0]
    for h in hashes[1:]:
        out = scramble(out + (h >> np.uint64(1)) + (h << np.uint64(63)) + np.uint64(len(hashes)))
    return out


def grouped(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal phrases stand together, and where each group of them starts."""
    mixed = mix(hashes)
    order = np.argsort(mixed)
    first = _changes(hashes, order)
    if len(hashes) > 1 and len(first) != len(_changes([mixed], order)):  # two phrases with one mixed hash
        order = np.lexsort(hashes)
        first = _changes(hashes, order)
    return order, first


def _changes(hashes: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    new = np.zeros(len(order), bool)
    new[:1] = True
    for h in hashes:
        h = h[order]
        new[1:] |= h[1:] != h[:-1]
    return np.flatnonzero(new)


def tally(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct phrase and the number of its occurrences."""
    order, first = grouped(hashes)
    return order[first], np.diff(np.append(first, len(order)))


def bit_of(hashes: list[np.ndarray]) -> np.ndarray:
    out = hashes[0]
    for j, h in enumerate(hashes[1:], 1):
        out = out ^ (h >> np.uint64(20 * j))
    return (out & np.uint64(BITS - 1)).astype(np.int64)


def within(bits: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    at = bit_of(hashes)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _rows(k: int, hashes: list[np.ndarray], counts: np.ndarray, phrases: list) -> pa.RecordBatch:
    n = len(counts)
    held = [h.view(np.int64) for h in hashes] + [np.zeros(n, np.int64)] * (LONGEST - len(hashes))
    return pa.RecordBatch.from_pydict({"k": pa.array(np.full(n, k, np.int8)), **{f"h{j + 1}": pa.array(h) for j, h in enumerate(held)}, "n": pa.array(counts.astype(np.int64)), "phrase": pa.array(phrases, pa.string())})


def count_short(buckets: int):
    """A task's counts of words, pairs, and (k = 0) each language's words in all: rows of packed entries, a bucket of hashes each.

    A word's entry is (hash, seed of its language), a pair's (hash, hash).
    """

    def count(batches):
        held: dict[int, list[tuple]] = {1: [], 2: []}
        size, totals = 0, {}
        for lang, block in blocks(batches):
            totals[lang] = totals.get(lang, 0) + block.own
            for k in (1, 2):
                _, hashes = block.grams(k)
                index, counts = tally(hashes)
                second = hashes[1][index] if k == 2 else np.full(len(index), seed_of(lang))
                held[k].append((hashes[0][index], second, counts))
                size += len(index)
            if size > ENTRIES:
                yield from packed(held, buckets)
                held, size = {1: [], 2: []}, 0
        yield from packed(held, buckets)
        for lang, n in totals.items():
            seed = np.array([seed_of(lang)])
            yield _packed_rows([0], 0, lang, *([x.tobytes()] for x in (seed, seed, np.array([n]))))

    return count


def packed(held: dict[int, list[tuple]], buckets: int):
    """Rows (bucket, k, lang, h1, h2, n) of entries (h1, h2, n): the bytes of each bucket's hashes and counts."""
    for k, entries in held.items():
        if entries:
            h1, h2, n = (np.concatenate(x) for x in zip(*entries))
            bucket = (mix([h1, h2][:k]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            yield _packed_rows(bucket[order][edges[:-1]].tolist(), k, None, cut(h1[order]), cut(h2[order]), cut(n[order].astype(np.int64)))


def _packed_rows(bucket: list[int], k: int, lang: str | None, h1: list[bytes], h2: list[bytes], n: list[bytes]) -> pa.RecordBatch:
    size = len(bucket)
    columns = {"bucket": pa.array(bucket, pa.int32()), "k": pa.array([k] * size, pa.int8()), "lang": pa.array([lang] * size, pa.string())}
    return pa.RecordBatch.from_pydict(columns | {c: pa.array(x, pa.binary()) for c, x in (("h1", h1), ("h2", h2), ("n", n))})


def merged(min_count: int):
    """Counts (k, lang, h1, h2, f) of min_count at least from packed rows in the order of k; totals pass. What is held is merged again and again, so it grows with a bucket's distinct entries alone."""

    def summed(k: int, parts: list[tuple]) -> tuple:
        h1, h2, n = (np.concatenate(x) for x in zip(*parts))
        order, first = grouped([h1, h2][:k])
        return h1[order[first]], h2[order[first]], np.add.reduceat(n[order], first) if len(first) else n

    def told(k: int, parts: list[tuple]) -> pa.RecordBatch:
        h1, h2, f = summed(k, parts)
        hit = f >= min_count
        n = int(hit.sum())
        return pa.RecordBatch.from_pydict({"k": pa.array(np.full(n, k, np.int8)), "lang": pa.nulls(n, pa.string()), "h1": pa.array(h1[hit].view(np.int64)), "h2": pa.array(h2[hit].view(np.int64)), "f": pa.array(f[hit])})

    def merge(batches):
        key, parts, size = None, [], 0
        for batch in batches:
            for k, lang, *data in zip(*(batch.column(c).to_pylist() for c in ("k", "lang", "h1", "h2", "n"))):
                h1, h2, n = (np.frombuffer(x, kind) for x, kind in zip(data, ("<u8", "<u8", "<i8")))
                if k == 0:
                    yield pa.RecordBatch.from_pydict({"k": pa.array([0], pa.int8()), "lang": pa.array([lang], pa.string()), "h1": pa.array(h1.view(np.int64)), "h2": pa.array([0], pa.int64()), "f": pa.array(n)})
                    continue
                if k != key:
                    if parts:
                        yield told(key, parts)
                    key, parts, size = k, [], 0
                parts.append((h1, h2, n))
                size += len(n)
                if size > ENTRIES:
                    parts = [summed(k, parts)]
                    size = len(parts[0][2]) // 2  # at least as much again comes before the next merge
        if parts:
            yield told(key, parts)

    return merge


def counter(k: int, bits: dict[str, np.ndarray]):
    """A task's counts of phrases of 3 words (k = 3), or of 4 and all texts (k = 4), where prefixes and suffixes are among those to expand."""

    def wanted(size: int, h: list[np.ndarray]) -> np.ndarray:
        if size == k == 3:
            return within(bits["grow2"], h[:2]) | within(bits["held2"], h[1:])
        if size == 4:
            return within(bits["grow3"], h[:3]) | within(bits["held3"], h[1:])
        return within(bits["rest2"], h[:2]) | within(bits["held3"], h) if size == 3 else within(bits["held2"], h)

    def count(batches):
        for _, block in blocks(batches):
            for size in (3,) if k == 3 else (2, 3, 4):
                at, hashes = block.grams(size)
                hit = np.flatnonzero(wanted(size, hashes))
                hashes = [h[hit] for h in hashes]
                index, counts = tally(hashes)
                phrases = [block.phrase(int(i), size) for i in at[hit[index]]] if k == 4 else [None] * len(index)
                yield _rows(size, [h[index] for h in hashes], counts, phrases)

    return count


# ---------------------------------------------------------------- as tables


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(2,000,000 a / (left + right)) in decimals: products may pass 64 bits."""
    of = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(12,0)") * of(a), of(left) + of(right))


def worst(a: Column, *cuts: tuple[Column, Column]) -> Column:
    """struct(score, cut, l, r) of the cut with the lowest score, ties to the first."""
    each = [F.struct(score(a, x, y).alias("score"), F.lit(i).alias("cut"), x.alias("l"), y.alias("r")) for i, (x, y) in enumerate(cuts, 1)]
    return F.array_min(F.array(*each))


def bit_tables(sets: dict[str, DataFrame]) -> dict[str, np.ndarray]:
    """Bits of fixed-size tables, or-ed together on Spark, for the phrases (h1, ...) of each set."""
    parts = []
    for name, df in sets.items():
        at = F.col("h1")
        for j, c in enumerate([c for c in df.columns if c != "h1"], 1):
            at = at.bitwiseXOR(F.shiftrightunsigned(F.col(c), 20 * j))
        at = at.bitwiseAND(F.lit(BITS - 1))
        parts.append(df.select(F.lit(name).alias("name"), F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = every.groupBy("name", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    names = np.array(got.column("name").to_pylist())
    word, bits = (np.asarray(got.column(c)) for c in ("word", "bits"))
    out = {}
    for name in sets:
        own = names == name
        out[name] = np.zeros(BITS >> 6, np.uint64)
        out[name][word[own].astype(np.int64)] = bits[own].astype(np.int64).view(np.uint64)
    return out


def thresholds(pairs: DataFrame, size: int) -> DataFrame:
    """(lang, theta): a score that `size` pairs of the language reach, or 0 where it has fewer; from counts of thousandths."""
    n = pairs.groupBy("lang", F.floor(F.col("w.score") / 1000).alias("mill")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("mill")))
    reached = n.withColumn("above", above).where(F.col("above") >= size)
    return pairs.select("lang").distinct().join(reached.groupBy("lang").agg(F.max("mill").alias("mill")), "lang", "left").select("lang", (F.coalesce("mill", F.lit(0)) * 1000).alias("theta"))


def short_counts(texts: DataFrame, min_count: int) -> DataFrame:
    """Saved counts (k, lang, h1, h2, f) of words and pairs found min_count times, and (k = 0) of each language's words in all.

    Tasks count chunks of text before anything is shuffled, so a word or pair, however frequent, is one entry a chunk.
    Entries go to shuffle partitions by the hash of the word, or of both words, packed into one row a partition.
    """
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(count_short(partitions), "bucket int, k tinyint, lang string, h1 binary, h2 binary, n binary")
    rows = rows.repartitionById(partitions, "bucket").sortWithinPartitions("k")
    return save(rows.mapInArrow(merged(min_count), "k tinyint, lang string, h1 long, h2 long, f long"), "short")


def long_counts(rows: DataFrame, label: str, min_count: int, *values: Column) -> DataFrame:
    keys = [c for c in KEYS if c in rows.columns]
    return save(rows.groupBy(*keys).agg(F.sum("n").alias("f"), *values).where(F.col("f") >= min_count), label)


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", top: int = TOP, min_count: int = MIN_COUNT, covered: int = COVERED, frontier: int = FRONTIER) -> DataFrame:
    """Each language's `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split into pieces and words; a null text has none, a null language counts as
    "und". Rows count as often as they occur; ids are not needed, other columns are ignored. Candidates, counts and
    drops are those of all rows. Ties in score go by count, then by the phrase's bytes. An empty table, and a language
    without a phrase of min_count occurrences, gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    short = short_counts(texts, min_count)
    totals = save(short.where("k = 0").groupBy("lang", F.col("h1").alias("seed")).agg(F.sum("f").alias("n")), "totals")
    words = save(short.where("k = 1").select("h1", F.col("h2").alias("seed"), "f").join(totals, "seed").select("lang", "h1", "f"), "words")
    pairs = short.where("k = 2").select("h1", "h2", "f").join(words.withColumnRenamed("f", "f1"), "h1").join(named(words, "f2", "h2"), "h2")
    pairs = save(pairs.select("lang", "h1", "h2", "f", "f1", "f2", worst(F.col("f"), (F.col("f1"), F.col("f2"))).alias("w"), score(F.col("f"), F.col("f1"), F.col("f")).alias("bound")), "pairs")
    drop(short)

    every, left, size = None, pairs.select("lang").distinct(), frontier * top
    while True:
        theta = save(thresholds(pairs.join(left, "lang", "left_semi"), size), "theta")
        found = expand(texts.join(theta.select("lang"), "lang", "left_semi"), words, pairs, theta, min_count, covered)
        n = found.groupBy("lang").agg(F.count("*").alias("n"))
        status = save(theta.join(n, "lang", "left").select("lang", ((F.col("theta") == 0) | (F.coalesce("n", F.lit(0)) >= top)).alias("settled")), "settled")
        done = found.join(status.where("settled"), "lang", "left_semi")
        every = done if every is None else every.unionByName(done)
        drop(theta)
        left, size = status.where("not settled").select("lang"), size * 4
        if left.limit(1).count() == 0:
            break
    drop(words, pairs)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals.drop("seed"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def named(counts: DataFrame, name: str, *hashes: str) -> DataFrame:
    """Counts of words, pairs or triples with their hashes and count renamed, to be joined as a part of a longer phrase."""
    return counts.select(*[F.col(f"h{j}").alias(h) for j, h in enumerate(hashes, 1)], F.col("f").alias(name))


def expand(texts: DataFrame, words: DataFrame, pairs: DataFrame, theta: DataFrame, min_count: int, covered: int) -> DataFrame:
    """All surviving phrases that score theta or more in the languages of theta: lang, phrase, a, l, r, score.

    Prefixes whose bound reaches theta are grown; pairs and triples that score as much themselves are also counted
    as suffixes, so that whatever could drop them is known: a phrase of two words more that covers one holds a phrase
    of one word more that does. The last words of a quadruple are counted in the pass that counts it.
    """
    c = F.col
    two = pairs.join(theta, "lang")
    held2 = two.where("w.score >= theta")
    bits = bit_tables({"grow2": two.where("bound >= theta").select("h1", "h2"), "held2": held2.select("h1", "h2")})
    threes = long_counts(texts.mapInArrow(counter(3, bits), f"{KINDS}, phrase string").drop("h4"), "threes", min_count)

    scored = threes.join(words.join(theta, "lang").withColumnRenamed("f", "f1"), "h1").join(named(pairs, "f12", "h1", "h2"), ["h1", "h2"])
    scored = scored.join(named(pairs, "f23", "h2", "h3"), ["h2", "h3"]).join(named(words, "f3", "h3"), "h3")
    w = worst(c("f"), (c("f1"), c("f23")), (c("f12"), c("f3")))
    scored = save(scored.select("lang", "theta", "h1", "h2", "h3", "f", "f1", "f12", w.alias("w"), score(c("f"), c("f1"), c("f")).alias("bound")), "scored")
    held3, grow3 = scored.where("w.score >= theta"), scored.where("bound >= theta")
    rest2 = grow3.select(c("h2").alias("h1"), c("h3").alias("h2"))
    bits = bit_tables({"held2": held2.select("h1", "h2"), "grow3": grow3.select("h1", "h2", "h3"), "held3": held3.select("h1", "h2", "h3"), "rest2": rest2})
    longer = long_counts(texts.mapInArrow(counter(4, bits), f"{KINDS}, phrase string"), "longer", min_count, F.min("phrase").alias("phrase"))

    triples = threes.select("h1", "h2", "h3", "f").unionByName(longer.where("k = 3").select("h1", "h2", "h3", "f")).groupBy("h1", "h2", "h3").agg(F.max("f").alias("f"))
    fours = longer.where("k = 4").select("h1", "h2", "h3", "h4", "f")
    held4 = fours.join(grow3.select("lang", "theta", "h1", "h2", "h3", c("f").alias("f123"), "f1", "f12"), ["h1", "h2", "h3"]).join(named(triples, "f234", "h2", "h3", "h4"), ["h2", "h3", "h4"])
    held4 = held4.join(named(pairs, "f34", "h3", "h4"), ["h3", "h4"]).join(named(words, "f4", "h4"), "h4")
    held4 = held4.withColumn("w", worst(c("f"), (c("f1"), c("f234")), (c("f12"), c("f34")), (c("f123"), c("f4")))).where("w.score >= theta")

    def keyed(df: DataFrame, hashes: list[str], *more: Column | str) -> DataFrame:
        return df.select(F.lit(len(hashes)).cast("tinyint").alias("k"), *[(c(hashes[j]) if j < len(hashes) else F.lit(0).cast("long")).alias(f"h{j + 1}") for j in range(LONGEST)], *more)

    h = ["h1", "h2", "h3", "h4"]
    own = ("lang", c("f").alias("a"), "w.l", "w.r", "w.score")
    contenders = keyed(held2, h[:2], *own).unionByName(keyed(held3, h[:3], *own)).unionByName(keyed(held4, h, *own))
    covers = [(triples, h[:2]), (triples, h[1:3]), (fours, h[:3]), (fours, h[1:])]
    most = reduce(DataFrame.unionByName, [keyed(df, part, "f") for df, part in covers]).groupBy(*KEYS).agg(F.max("f").alias("most"))
    dec = lambda x: x.cast("decimal(22,0)")
    kept = contenders.join(most, KEYS, "left").where(c("most").isNull() | (dec(c("most")) * 100 < dec(c("a")) * covered))
    out = save(kept.join(longer.select(*KEYS, "phrase"), KEYS).select("lang", "phrase", "a", "l", "r", "score"), "above")
    drop(threes, scored, longer)
    return out


def digest(docs: DataFrame) -> DataFrame:
    return collocations(docs.select("lang", "text"))
