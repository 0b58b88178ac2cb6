"""N-gram Jaccard join: documents link when their shingle sets are alike, found by prefix-tree joins.

Sets are cut into parts by ranges of their hashes. Two sets that are alike enough differ in fewer elements than they
have parts, so some parts are equal, and only documents with an equal part can link; documents so connected form a
cluster. In a cluster the sets are put in one order, rare shingles first, and stored in a prefix tree; each set walks
it, sharing the overlap of common beginnings, and leaves a subtree as soon as what remains on either side cannot
reach the needed overlap.

Equal sets are one class from the start. A cluster above one task's size is cut once more: sets that are alike enough
also share one of the first elements (the prefix) of that order. What is still too large is first held against one of
its members (the pivot): what links to it is connected. Jaccard distance is a metric, so members further from the
pivot than two link distances can't link to what is connected; all others are compared block by block, one tree for a
block. No set, link or count passes through the driver but counts of rows.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunk_words, chunks, drop, fresh, gram_hashes, save, scramble, signed
from .components import components

SHINGLE = 4
#: Links from so many hundredths of the union on.
PERCENT = 85
#: Shingle hashes have so many bits.
BITS = 56
#: Shingles and documents of a cluster, and of a block of a larger one, that one task compares; a longer set is a block by itself.
BLOCK_SHINGLES = 150_000
BLOCK_DOCS = 500
#: Documents that one task sends through a block's tree.
WALKERS = 2_000
#: Rounds in which clusters above that are held against a pivot.
ROUNDS = 3
BROADCAST_ROWS = 500_000
#: Bits of the table of documents in clusters, so that few texts of others are shuffled: 2^18 rows at whatever size.
TABLE_BITS = 1 << 24


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes (BITS bits) of a document's word hashes; a shorter text is one shingle, no words none."""
    if not len(h):
        return h
    grams = gram_hashes(h, size) if len(h) >= size else scramble(gram_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(grams >> np.uint64(64 - BITS))


def _sets(texts, size: int = SHINGLE):
    for first, raws in chunks(texts):
        _, _, _, h, word, _ = chunk_words([r.lower() for r in raws])  # bytes: A-Z alone
        for i in range(len(raws)):
            yield first + i, shingles(h[word[i] : word[i + 1]], size)


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Smallest overlap of sets of a and b elements that links them: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def most_apart(total: int, percent: int = PERCENT) -> int:
    """Most elements that one of two linked sets has and the other lacks, if they have `total` elements together or fewer."""
    return max(0, *(t - 2 * needed(t, 0, percent) for t in (total - 1, total)))  # grows from every second total to the next


@lru_cache(256)
def _cuts(bits: int, percent: int) -> np.ndarray:
    """Hashes at which the parts of sets below 2^bits elements begin, but the first: more parts than linked sets can differ in."""
    apart = most_apart(2 * (2**bits - 1), percent)
    parts = apart + 2 + apart // 16
    return np.array([(i << BITS) // parts for i in range(1, parts)], np.uint64)


def part_hashes(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes (BITS bits) of a set's parts; linked sets that differ have one in common.

    The larger set's size, as a power of two, says how many parts there are, so a set that may link to one of the next
    power is cut in both ways. Of p parts at most d differ if d elements do. The p - d or more equal ones can't all be
    among the last p - d - 1 of a set in an order that all sets have in common, large parts first, so these last ones
    are left out.
    """
    n = len(s)
    bits, partner = n.bit_length(), n * 100 // percent
    total, out = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scramble(s)))), []
    for b, largest in ((bits, min(partner, 2**bits - 1)), (bits + 1, partner)):
        apart = most_apart(n + largest, percent)
        if not apart or b > bits and not largest >> bits:  # none differ, or no partner has so many elements
            continue
        cuts = _cuts(b, percent)
        at = np.concatenate((np.zeros(1, np.int64), np.searchsorted(s, cuts), np.full(1, n)))
        place = np.arange(len(cuts) + 1, dtype=np.uint64) + np.uint64(b << 40)
        h = scramble(total[at[1:]] - total[at[:-1]] + scramble(place)) >> np.uint64(64 - BITS)
        out.append(h[np.lexsort((h, at[:-1] - at[1:]))[: apart + 1]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def counted_below(percent: int) -> int:
    """Hashes below this are counted and come first in the order: somewhat more of a set than its prefix."""
    return int(min(1.0, 0.016 * (100 - percent)) * (1 << BITS))


# ---------------------------------------------------------------- the tree


def local_order(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a block's sets, sorted, and each one's place in the block's order, rare ones first."""
    known, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    place = np.empty(len(known), np.int64)
    place[np.lexsort((known, count))] = np.arange(len(known))
    return known, place


def ordered(s: np.ndarray, known: np.ndarray, place: np.ndarray) -> list[int]:
    """The set as places; elements that the block doesn't have are the rarest: negative numbers, which match nothing."""
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    have = known[at] == s if len(known) else np.zeros(len(s), bool)
    found = np.sort(place[at[have]])
    return list(range(len(found) - len(s), 0)) + found.tolist()


class Tree:
    """A prefix tree of ordered sets; runs without a branch are one node.

    Linked sets share an element of their prefixes, so a walk enters subtrees alone that hold such a member.
    """

    def __init__(self, sets: list[list[int]], percent: int = PERCENT):
        self.sets, self.percent = sets, percent
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * len(sets)))  # a branch leaves one set out at least
        self.order = sorted((i for i in range(len(sets)) if sets[i]), key=lambda i: sets[i])
        self.entry: dict[int, list[int]] = {}
        for place, i in enumerate(self.order):
            for x in sets[i][: prefix_length(len(sets[i]), percent)]:
                self.entry.setdefault(x, []).append(place)
        self.root = self._node(0, len(self.order), 0)

    def _node(self, lo: int, hi: int, at: int) -> tuple:
        """Of places lo to hi: (run, length after it, places that end here, children and their first places, smallest and largest set, smallest member)"""
        if lo == hi:
            return ([], at, [], [], [], 0, 0, 0)
        low, high = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]  # sorted: what these share, all share
        end, most = at, min(len(low), len(high))
        if hi - lo == 1:
            end = len(low)
        else:
            while end < most and low[end] == high[end]:
                end += 1
        here, children, starts = [], [], []
        first = lo
        while first < hi and len(self.sets[self.order[first]]) == end:
            here.append(first)
            first += 1
        while first < hi:
            last, x = first + 1, self.sets[self.order[first]][end]
            while last < hi and self.sets[self.order[last]][end] == x:
                last += 1
            starts.append(first)
            children.append(self._node(first, last, end))
            first = last
        own = self.order[lo:hi]
        sizes = [len(self.sets[i]) for i in own]
        return (low[at:end], end, here, children, starts, min(sizes), max(sizes), min(own))

    def walk(self, query: list[int], skip) -> list[int]:
        """Members that link to the ordered query; skip(member, member) leaves one out, skip(None, smallest member) a subtree."""
        n = len(query)
        able = sorted({p for x in query[: prefix_length(n, self.percent)] for p in self.entry.get(x, ())}) if n else []
        if not able:
            return []
        own, found, stack = set(query), [], [(self.root, 0, 0, len(able))]
        while stack:
            (run, end, here, children, starts, least, most, first), shared, lo, hi = stack.pop()
            if skip(None, first) or 100 * min(n, most) < self.percent * max(n, least):
                continue
            if run:
                shared += len(own.intersection(run))
                left = n - bisect_right(query, run[-1])
                if shared + min(left, most - end) < needed(n, max(least, end), self.percent):
                    continue
            if here and shared >= needed(n, end, self.percent):
                for p in able[lo : bisect_right(able, here[-1], lo, hi)]:
                    if not skip(i := self.order[p], i):
                        found.append(i)
            if here:
                lo = bisect_right(able, here[-1], lo, hi)
            while lo < hi:
                child = bisect_right(starts, able[lo]) - 1
                after = bisect_left(able, starts[child + 1], lo, hi) if child + 1 < len(starts) else hi
                stack.append((children[child], shared, lo, after))
                lo = after
        return found


class Forest:
    """Union-find over documents; join() tells whether two were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def cluster_links(docs: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """(document, smallest document) of every component of a cluster with links."""
    if len(docs) < 2:
        return []
    known, place = local_order(sets)
    own = [ordered(s, known, place) for s in sets]
    tree, forest = Tree(own, percent), Forest()
    for q, d in enumerate(docs):
        for i in tree.walk(own[q], lambda i, first, q=q, d=d: first >= q or (i is not None and forest.find(docs[i]) == forest.find(d))):
            forest.join(docs[i], d)
    return [(d, root) for d in docs if (root := forest.find(d)) != d]


class Block:
    """The tree of one block, walked by sets of another; what is known to be connected is not looked at again."""

    def __init__(self, docs: list[int], sets: list[np.ndarray], percent: int):
        self.docs, self.forest = docs, Forest()
        self.known, self.place = local_order(sets)
        self.tree = Tree([ordered(s, self.known, self.place) for s in sets], percent)

    def links(self, doc: int, s: np.ndarray, near: int | None) -> list[tuple[int, int]]:
        """New links of a walker; near: the pivot that it is known to link to."""
        find = self.forest.find
        if near is not None:
            self.forest.join(doc, near)
        mine = self.tree.walk(ordered(s, self.known, self.place), lambda i, first: i is not None and find(self.docs[i]) == find(doc))
        return [(doc, self.docs[i]) for i in mine if self.forest.join(doc, self.docs[i])]


# ---------------------------------------------------------------- Spark stages

_HEADS = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("parts", pa.list_(pa.int64()))])


def _heads(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Saved table of every row's set size and signature, and its parts' hashes; of equal sets that come together, the smallest document has these."""

    def heads(batches):
        none = np.zeros(0, np.int64)
        for batch in batches:
            ids, out, first = batch.column(0).to_pylist(), {f.name: [] for f in _HEADS}, {}
            for i, s in _sets(batch.column(1).to_pylist(), size):
                n, mixed, parts = len(s), scramble(s), none
                sig = int(signed(mixed.sum(keepdims=True))[0]), int(signed(scramble(mixed + np.uint64(n)).sum(keepdims=True))[0])
                if ids[i] is not None and n:
                    if (old := first.get(sig)) is None:
                        parts = signed(part_hashes(s, percent))
                    elif ids[i] < ids[old]:
                        parts, out["parts"][old] = out["parts"][old], none
                    if old is None or ids[i] < ids[old]:
                        first[sig] = i
                for name, value in zip(out, (ids[i], n, *sig, parts)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_HEADS)

    return save(docs.select("doc", "text").mapInArrow(heads, "doc long, n long, sig1 long, sig2 long, parts array<long>"), "heads")


def _candidates(heads: DataFrame) -> DataFrame:
    """Saved table (node, component): documents connected by equal parts."""
    rows = heads.select("doc", F.explode("parts").alias("part")).withColumn("b", F.min("doc").over(Window.partitionBy("part")))
    return components(rows.where("doc <> b").select(F.col("doc").alias("a"), "b"))


def _clustered(heads: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Saved table (doc, cluster, blocks): the first documents of the classes of every cluster with more than one set."""
    first = classes.select(F.col("class").alias("doc")).distinct().join(found.select(F.col("node").alias("doc"), F.col("component").alias("cluster")), "doc")
    first = save(first, "first")
    sets = heads.where("n > 0").join(first, "doc").select("cluster", "doc", "n")
    sizes = sets.groupBy("cluster").agg(_n_blocks().alias("blocks"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
    out = save(first.join(sizes, "cluster").select("doc", "cluster", "blocks"), "clustered")
    drop(first)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is a saved table of few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _prefixes(members: DataFrame, percent: int) -> DataFrame:
    """Saved table (cluster, doc, s): of each set, the elements of its prefix that another set of its cluster has too.

    The order: counted elements by their number of sets, then all others by hash. Elements of one set alone
    take their places at the front of the prefix, but match nothing.
    """
    limit = counted_below(percent)
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    sets = members.select("cluster", "doc", F.xxhash64("doc", "keys").alias("set"), "n", "keys", F.size(F.filter("keys", lambda x: x < limit)).alias("counted"))
    sets = save(sets.select("cluster", "doc", "set", "n", "counted", F.slice("keys", F.lit(1), F.greatest(F.col("counted"), length).cast("int")).alias("low")), "sets")
    rows = sets.select("cluster", "set", F.explode("low").alias("s"))
    repeated = save(rows.groupBy("cluster", "s").agg(F.count("*").alias("f")).where("f > 1"), "repeated")
    # Merged at every size, so that work and disk grow in proportion, and Spark can split what a common shingle makes large
    hits = rows.join(repeated.hint("merge"), ["cluster", "s"]).select("set", F.struct((F.col("s") >= limit).alias("later"), F.when(F.col("s") < limit, F.col("f")).otherwise(0).alias("f"), "s").alias("e"))
    lists = hits.groupBy("set").agg(F.array_sort(F.collect_set("e")).alias("e"))  # no longer than one document's elements
    alone = F.col("counted") - F.size(F.filter("e", lambda x: ~x["later"]))
    taken = F.greatest(F.lit(0), length - alone).cast("int")
    out = save(sets.select("cluster", "doc", "set", "n", "counted").join(lists, "set").select("cluster", "doc", F.explode(F.slice("e", F.lit(1), taken)).alias("e")).select("cluster", "doc", "e.s"), "prefixes")
    drop(sets, repeated)
    return out


def _parted(members: DataFrame, percent: int) -> DataFrame:
    """Saved table: members of large clusters by clusters of their own, connected by shared prefix elements, and each one's blocks."""
    prefixes = _prefixes(members, percent)
    shared = save(prefixes.groupBy("cluster", "s").agg(F.min("doc").alias("b"), F.max("doc").alias("last")).where("b < last").select("cluster", "s", "b"), "shared")
    found = components(prefixes.join(small(shared), ["cluster", "s"]).where("doc <> b").select(F.col("doc").alias("a"), "b"))
    drop(prefixes, shared)
    apart = save(members.drop("cluster").join(small(found.select(F.col("node").alias("doc"), F.col("component").alias("cluster"))), "doc"), "parted")
    return apart.join(small(save(_blocks(apart), "blocks")), "cluster")


_MEMBERS = pa.schema([("cluster", pa.int64()), ("blocks", pa.int32()), ("doc", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _members(docs: DataFrame, clustered: DataFrame, size: int) -> DataFrame:
    """Saved table (cluster, blocks, doc, n, keys) of the sets of all clustered documents.

    Few texts of other documents reach the join: a table of bits, as large whatever the input, tells most of them.
    """

    def members(batches):
        for batch in batches:
            own = [batch.column(i).to_pylist() for i in (0, 1, 2)]
            out = {f.name: [] for f in _MEMBERS}
            for i, s in _sets(batch.column(3).to_pylist(), size):
                if len(s):
                    for name, value in zip(out, (*(x[i] for x in own), len(s), signed(s))):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_MEMBERS)

    at = F.xxhash64("doc").bitwiseAND(F.lit(TABLE_BITS - 1))
    word, bit = F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit")
    bits = save(clustered.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")), "bits")
    some = docs.select("doc", "text", word, bit).join(F.broadcast(bits), "word").where(F.col("bit").bitwiseAND(F.col("bits")) != 0)
    # Merged at every size, so that what is shuffled grows in proportion
    texts = some.select("doc", "text").join(clustered.hint("merge"), "doc").select("cluster", "blocks", "doc", "text")
    out = save(texts.mapInArrow(members, "cluster long, blocks int, doc long, n long, keys array<long>"), "members")
    drop(bits)
    return out


def _pairs(rows) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _set(keys) -> np.ndarray:
    return keys.values.to_numpy(zero_copy_only=False)


def _within(members: DataFrame, percent: int) -> DataFrame:
    """Links within clusters that one task compares."""

    def linked(batches):
        cluster, docs, sets = None, [], []
        for batch in batches:
            out = []
            for c, d, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if c != cluster:
                    out += cluster_links(docs, sets, percent)
                    cluster, docs, sets = c, [], []
                docs.append(d)
                sets.append(_set(k))
            yield _pairs(out)
        yield _pairs(cluster_links(docs, sets, percent))

    return members.select("cluster", "doc", "keys").repartition("cluster").sortWithinPartitions("cluster", "doc").mapInArrow(linked, "a long, b long")


def _across(jobs: DataFrame, percent: int) -> DataFrame:
    """Links of jobs (cluster, part, walks, doc, keys, near): in each part, rows that don't walk are the tree, the others walk it."""

    def linked(batches):
        part, docs, sets, block = None, [], [], None
        for batch in batches:
            out = []
            for *p, walks, d, k, near in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), batch.column(5).to_pylist()):
                if p != part:
                    part, docs, sets, block = p, [], [], None
                if not walks:
                    docs.append(d)
                    sets.append(_set(k))
                    continue
                block = block or Block(docs, sets, percent)
                out += block.links(d, _set(k), near)
            yield _pairs(out)

    rows = jobs.select("cluster", "part", "walks", "doc", "keys", "near")
    return rows.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "walks", F.col("near").isNull(), "doc").mapInArrow(linked, "a long, b long")


def _n_blocks() -> Column:
    """How many blocks the sets of a group make."""
    return F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")


def _blocks(members: DataFrame) -> DataFrame:
    """(cluster, blocks)"""
    return members.groupBy("cluster").agg(_n_blocks().alias("blocks"))


def _own_block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("doc", "n"), blocks).cast("int")


def _against_pivots(members: DataFrame, percent: int) -> DataFrame:
    """Saved table: members of large clusters with p, their cluster's pivot (its smallest document), near (they link to it) and mid (within two link distances)."""
    pivots = members.join(members.groupBy("cluster").agg(F.min("doc").alias("doc")), ["cluster", "doc"]).dropDuplicates(["cluster"])
    both = members.join(save(pivots.select("cluster", F.struct("doc", "keys", "n").alias("p")), "pivots"), "cluster")
    shared = F.size(F.array_intersect("keys", "p.keys"))
    union = F.col("n") + F.col("p.n") - shared
    near, mid = 100 * shared >= percent * union, 100 * shared >= (2 * percent - 100) * union
    return save(both.select("cluster", "doc", "n", "keys", F.col("p.doc").alias("p"), near.alias("near"), mid.alias("mid")), "measured")


def _large(members: DataFrame, percent: int) -> tuple[list[DataFrame], DataFrame]:
    """Links of clusters above one task's size that pivots and blocks show, and the members left, whose clusters fit a task."""
    links, jobs, left, rest = [], [], [], members
    for k in range(ROUNDS):
        measured = _against_pivots(rest, percent)
        links.append(measured.where("near and doc <> p").select(F.col("doc").alias("a"), F.col("p").alias("b")))
        # What isn't near but within two link distances may link to what is: trees of the former, walked by the latter
        mid = measured.where("mid and not near")
        groups = measured.where("near").groupBy("cluster").agg(F.ceil(F.count("*") / WALKERS).cast("int").alias("groups"))
        blocks = small(save(_blocks(mid).join(groups, "cluster"), "blocks"))
        part = lambda i, j, name=f"mid{k}": F.concat_ws(":", F.lit(name), i, j).alias("part")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        trees = mid.join(blocks, "cluster").withColumn("to", every("groups"))
        jobs.append(trees.select("cluster", part(_own_block("blocks"), F.col("to")), F.lit(False).alias("walks"), "doc", "keys", F.lit(None).cast("long").alias("near")))
        walkers = measured.where("near").join(blocks, "cluster").withColumn("to", every("blocks"))
        jobs.append(walkers.select("cluster", part(F.col("to"), _own_block("groups")), F.lit(True).alias("walks"), "doc", "keys", F.col("p").alias("near")))
        apart = measured.where("not near").select("cluster", "doc", "n", "keys")
        sized = apart.join(small(save(_blocks(apart), "blocks")), "cluster")
        left.append(sized.where("blocks = 1").drop("blocks"))
        rest = save(sized.where("blocks > 1"), "apart")
        if not rest.limit(1).count():
            break
        rest, sized = rest.drop("blocks"), rest
    else:
        # Every pair of blocks once: block i is a tree for the sets of block j, up to its own
        own, none = _own_block("blocks"), F.lit(None).cast("long").alias("near")
        part = lambda i, j: F.concat_ws(":", F.lit("all"), i, j).alias("part")
        trees = sized.withColumn("to", F.explode(F.sequence(F.lit(0), own)))
        jobs.append(trees.select("cluster", part(own, F.col("to")), F.lit(False).alias("walks"), "doc", "keys", none))
        walkers = sized.withColumn("to", F.explode(F.sequence(own, F.col("blocks") - 1)))
        jobs.append(walkers.select("cluster", part(F.col("to"), own), F.lit(True).alias("walks"), "doc", "keys", none))
    return links + [_across(_union(jobs), percent)], _union(left)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest id reachable by links, its own included).

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct shingles of
    `size` words, of a shorter text its whole sequence. Null, empty and blank texts have no shingle and link with nothing. Rows that
    repeat an id are one document; rows of a null id have no component. percent: above 50.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    full = _heads(own, size, percent)
    heads = save(full.select("doc", "n", "sig1", "sig2"), "slim")
    classes = save(heads.where("n > 0 and doc is not null").groupBy("sig1", "sig2").agg(F.min("doc").alias("class")), "classes")
    clusters = _candidates(full)
    drop(full)
    clustered = _clustered(heads, classes, clusters)
    members = _members(own.where("doc is not null"), clustered, size)
    within, links = members.where("blocks = 1").drop("blocks"), []
    large = save(members.where("blocks > 1").drop("blocks"), "large")
    if large.limit(1).count():
        parted = _parted(large, percent)
        within = within.unionByName(parted.where("blocks = 1").select(*within.columns))
        rest = save(parted.where("blocks > 1").select(*within.columns), "rest")
        if rest.limit(1).count():
            links, left = _large(rest, percent)
            within = within.unionByName(left.select(*within.columns))
    # a document is in more than one class if its id is repeated; it links them
    same = save(heads.where("n > 0 and doc is not null").join(classes, ["sig1", "sig2"]).select("doc", "class"), "same")
    links.append(same.groupBy("doc").agg(F.max("class").alias("a"), F.min("class").alias("b"), F.collect_set("class").alias("all")).where("a <> b").select(F.explode("all").alias("a"), "b"))
    found = components(_union([_within(within, percent), *links])).withColumnRenamed("node", "class")
    placed = same.join(found, "class", "left").select("doc", F.coalesce("component", "class").alias("component"))
    placed = placed.groupBy("doc").agg(F.min("component").alias("component"))
    drop(clusters, clustered, members, large)
    return heads.select("doc", "n").join(placed, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs without documents that link to one of a smaller id; columns as they were. Rows of a null id stay."""
    id_col = options.get("id_col", "doc_id")
    gone = fresh(docs, "gone")
    found = near_duplicates(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(save(found, "copies"), F.col(id_col) == F.col(gone), "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"))
