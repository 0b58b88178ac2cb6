"""Line dedup [native]: lines whose normalised form is found in many documents are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, save

#: ASCII white space, and the letters whose case is ignored.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MIN_DOCS = 10
MIN_CHARS = 1


def lines_of(text: Column) -> Column:
    """A text's lines; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def text_key(text: Column) -> list[Column]:
    """Two xxhash64 values that tell texts of one id apart."""
    own = F.coalesce(text, F.lit(""))
    return [F.xxhash64(own), F.xxhash64(F.lit(1), own)]


def common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """The lines as a saved table (doc, t1, t2, pos, h1, h2; t1 and t2 know the text), and the key hashes found in at least min_docs documents.

    A key is known by two xxhash64 values with different seeds, 128 bits together. A document counts once
    however often it has a line: keys are made distinct per document before anything is shuffled by key.
    """
    t1, t2 = text_key(F.col(text_col))
    lines = docs.select(F.col(id_col).alias("doc"), t1.alias("t1"), t2.alias("t2"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keyed = lines.select("doc", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keyed = save(keyed.select("doc", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    # (document, key) pairs are made distinct first, then counted by key; both steps combine before the shuffle
    once = keyed.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    return keyed, save(once.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"), "common")


def drop_common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with common lines removed from text_col, and two more columns: n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of at least min_chars
    code points found in at least min_docs documents lose all their lines. Null and empty texts have one empty
    line and stay as they are; rows of a null id and rows of an
    equal id count as one document, but each loses only lines of its own text. All other columns are kept.
    """
    keyed, common = common_lines(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_chars=min_chars)
    gone, row = fresh(docs, "gone"), fresh(docs, "row")
    # Both sides are exchanged by key, so that large keys can be split
    hit = keyed.join(common, ["h1", "h2"]).groupBy("doc", "t1", "t2").agg(F.collect_set("pos").alias(gone))
    hit = hit.select(F.struct("doc", "t1", "t2").alias(row), gone)
    t1, t2 = text_key(F.col(text_col))
    mine = F.struct(F.col(id_col).alias("doc"), t1.alias("t1"), t2.alias("t2"))
    out = docs.join(hit, mine.eqNullSafe(F.col(row)), "left").drop(row)
    lost = F.coalesce(F.col(gone), F.array().cast("array<int>"))

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.array_join(F.transform(kept, lambda i: lines[i]), "\n")

    text = F.when(F.size(lost) == 0, F.col(text_col)).otherwise(let(lines_of(F.col(text_col)), without))
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    names = [F.col(f"`{c}`") if c != text_col else text.alias(text_col) for c in docs.columns]
    return out.select(*names, F.size(lines_of(F.col(text_col))).cast("long").alias(n_lines), F.size(lost).cast("long").alias(n_dropped))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    out = drop_common_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), flagged AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
