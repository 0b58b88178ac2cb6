"""Benchmark decontamination [native]: spaced seeds find places to look at, an aligned comparison decides.

A block is BLOCK consecutive tokens; a mask picks two blocks whose starts are 1 to FAR blocks apart and ignores the
others, so that a hash of the picked tokens survives substitutions elsewhere. Documents and items are both hashed at
every position. Every overlap that the rule accepts is hit: cut into blocks, its 20 tokens hold 6 with at most 4
substitutions, 15 to 19 tokens hold at least 5 with at most 3, 12 to 14 hold 4 with at most 2, so two blocks are
always whole. Documents are compared with an item along the diagonal of a hit. Items below 12 tokens allow no
substitution: all their tokens in a row are one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, save

#: Tokens of a block, and how many blocks apart the two blocks of a mask start at most.
BLOCK = 3
FAR = 5
#: Fixed masks: the token positions that are hashed.
MASKS = tuple((0, 1, 2, BLOCK * far, BLOCK * far + 1, BLOCK * far + 2) for far in range(1, FAR + 1))
#: Tokens from which an item may have substitutions.
SPAN = 12

#: An overlap counts if in some WINDOW consecutive aligned tokens (the whole item if shorter) MATCH_PERCENT are equal.
WINDOW = 20
MATCH_PERCENT = 80
#: Tokens on either side of the hits that are compared; after them, counted from the last hit's first token and SPAN more.
#: Every window that holds a hit lies within.
AROUND = 24

#: Rows up to which seeds and hits are sent to all executors; above, Spark joins them by key.
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null or empty texts."""
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " ", -1), lambda w: w != "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def blocks(hashes: Column) -> Column:
    """At every position: the hash of the block there, and of those 1 to FAR blocks on (null beyond the end)."""
    n = F.size(hashes) - (BLOCK - 1)
    own = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(BLOCK)]))).otherwise(F.array().cast("array<bigint>"))
    return let(own, lambda b: F.transform(b, lambda x, i: F.struct(x.alias("block"), *[F.get(b, i + BLOCK * far).alias(f"b{far}") for far in range(1, FAR + 1)])))


def seeds(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each mask that ends within the text, from the columns of blocks()."""
    masked = [F.when(F.col(f"b{far}").isNotNull(), F.xxhash64(F.lit(far), "block", f"b{far}")) for far in range(1, FAR + 1)]
    return df.select(*keep, F.explode(F.array_compact(F.array(*masked))).alias("seed"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is a saved table of few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def hits(docs: DataFrame, items: DataFrame, *, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """Saved table (doc, item, diagonal, first and last item position hit); a diagonal is document position - item position."""
    at = lambda column: F.posexplode(let(token_hashes(F.col(column)), blocks)).alias("at", "b")
    theirs = items.where(F.col(item_col).isNotNull() & (F.size(tokens(F.col(item_text))) >= SPAN)).select(F.col(item_col).alias("item"), at(item_text))
    theirs = save(theirs.select("item", F.col("at").alias("item_at"), "b.*"), "blocks")
    first = save(theirs.select("block").distinct(), "first")
    known = save(seeds(theirs, "item", "item_at").distinct(), "seeds")
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), at(text_col)).select("doc", "at", "b.*")
    # Few positions begin with a block that an item has, and only these are hashed by all masks
    own = seeds(own.join(small(first), "block", "left_semi"), "doc", "at")
    met = own.join(small(known), "seed")
    met = met.withColumn("diagonal", (F.col("at") - F.col("item_at")).cast("int")).select("doc", "item", "diagonal", "item_at")
    met = _short_hits(met, docs, items, id_col, text_col, item_col, item_text)
    return save(met.groupBy("doc", "item", "diagonal").agg(F.min("item_at").alias("first"), F.max("item_at").alias("last")), "hits")


def _short_hits(met: DataFrame, docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """met, and the last place in each document of each item of 1 to SPAN - 1 tokens, for the lengths that there are; all places of such an item are equal."""
    theirs = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), token_hashes(F.col(item_text)).alias("h"))
    theirs = theirs.where(F.size("h").between(1, SPAN - 1)).select("item", F.size("h").alias("n"), F.xxhash64("h").alias("run"))
    lengths = [r["n"] for r in theirs.select("n").distinct().orderBy("n").collect()]  # SPAN - 1 at most
    if not lengths:
        return met
    theirs = save(theirs, "short")

    def runs(h: Column) -> Column:
        at = lambda n: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.xxhash64(F.slice(h, i + 1, n)).alias("run")))).otherwise(F.array().cast("array<struct<n:int,at:int,run:bigint>>"))
        return F.concat(*[at(n) for n in lengths])

    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.explode(let(token_hashes(F.col(text_col)), runs)).alias("r")).select("doc", "r.*")
    found = own.join(small(theirs), ["n", "run"]).groupBy("doc", "item").agg(F.max("at").cast("int").alias("diagonal")).withColumn("item_at", F.lit(0))
    return met.unionByName(found)


def overlaps(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that overlap: doc, item, matched (equal tokens compared on the best diagonal), compared, item_tokens, doc_start (token).

    Items of fewer than SPAN tokens match where all their tokens stand in a row, even an item of one token. Null and empty texts on either side match nothing, nor does an empty table; rows of a null
    id are left out; rows that repeat an id are compared each for itself and told once.
    """
    found = hits(docs, items, id_col=id_col, text_col=text_col, item_col=item_col, item_text=item_text)
    lists = found.groupBy("doc").agg(F.collect_list(F.struct("item", "diagonal", "first", "last")).alias("hits"))
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(lists) if found.count() <= BROADCAST_ROWS else lists, "doc")
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, e: s + e)

    def near(a: Column, hit: Column) -> Column:
        """Of a document's token hashes, those around a hit; lo: the item's position that the first is compared with."""
        lo = F.greatest(F.lit(0), -hit["diagonal"], hit["first"] - AROUND)
        hi = F.least(F.size(a) - hit["diagonal"], hit["last"] + SPAN + AROUND)
        return F.struct(hit["item"].alias("item"), hit["diagonal"].alias("diagonal"), lo.alias("lo"), F.slice(a, lo + hit["diagonal"] + 1, F.greatest(F.lit(0), hi - lo)).alias("a"))

    # Tokens are hashed once for a document, however many hits it has
    around = own.select("doc", F.explode(let(token_hashes(F.col("text")), lambda a: F.transform("hits", lambda h: near(a, h)))).alias("c")).select("doc", "c.*")
    theirs = items.select(F.col(item_col).alias("item"), token_hashes(F.col(item_text)).alias("b"))
    both = around.join(theirs, "item")
    size = F.least(F.size("a"), F.size("b") - F.col("lo"))
    equal = F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.when(F.get(F.col("a"), j) == F.get(F.col("b"), j + F.col("lo")), 1).otherwise(0))
    both = both.where(size > 0).select("doc", "item", "diagonal", "lo", equal.alias("equal"), F.size("b").alias("n"))
    width = F.least(F.lit(WINDOW), F.col("n"))

    def best_of(equal: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(equal) - width + 1))
        return F.array_max(F.transform(starts, lambda s: total(F.slice(equal, s, width))))

    best = let(F.col("equal"), best_of)
    good = both.where(best * 100 >= width * F.when(F.col("n") < SPAN, 100).otherwise(MATCH_PERCENT))
    row = F.struct(total(F.col("equal")).alias("matched"), F.size("equal").alias("compared"), F.col("n").alias("item_tokens"), (F.col("lo") + F.col("diagonal")).alias("doc_start"))
    return good.groupBy("doc", "item").agg(F.max(row).alias("r")).select("doc", "item", "r.*")


def remove_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the documents that overlap an item; columns as they were."""
    bad = fresh(docs, "bad")
    found = save(overlaps(docs, items, id_col=id_col, text_col=text_col, item_col=item_col, item_text=item_text).select(F.col("doc").alias(bad)).distinct(), "leaks")
    return docs.join(small(found), F.col(id_col) == F.col(bad), "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = overlaps(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), *[F.col(c).cast("long").alias(c) for c in ("matched", "compared", "item_tokens", "doc_start")])
