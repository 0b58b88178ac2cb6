"""From raw documents to packed training sequences: each stage works on all that the one before kept.

All stages but the last keep the columns of their input, whatever others there are beside doc_id and text. A stage
never fails on nulls, empty or long texts, ties, repeated rows or an empty table; what it does with them is said below.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from lexora.llm.common import drop, save_alone, table
from lexora.llm.encoding import tokenizer_path


#: Near copies in the pipeline share this many hundredths of their shingles of so many words; op8 keeps its own values.
SHINGLE = 5
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts do, copies share a fate, ids don't matter."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; n_chars follows the text where there is such a column.

    All rows stay, null and empty texts as they are. Rows of one id, or of a null one, count as one document, but each
    loses lines of its own text alone.
    """
    out = line_dedup.drop_common_lines(docs)
    names = [F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return out.select(*names)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by 5-word shingles and 80 %, directly or through others, the one of the smallest id stays.

    Rows of one id stay or go together; rows of a null id, and texts without words, stay.
    """
    return jaccard_join.keep_first(docs, size=SHINGLE, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, with all rows of their id; rows of a null id stay, and so does all where the benchmark is empty."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens; each row is packed for itself, an empty text as its end id."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join_stage),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: The first stage's fit and the fourth's tokens are beyond SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage saved on its way goes with it, its table when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = save_alone(spark, partial(stage, spark, docs, sf_dir), name)
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
