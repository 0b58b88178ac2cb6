"""File formats of the study: tables, ranked counts, n-gram shards, word lists, norms, response sheets, results, manifests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lexora.functions.text import POLICIES, require


#: Session setting that names the folder of the current run, see run_folder().
RUN = "spark.lexora.run"


def scratch_dir(spark: SparkSession) -> str:
    """The current run's folder, or else the cluster's shared folder; one of this machine only where spark.checkpoint.dir is unset and the session is local."""
    if run := spark.conf.get(RUN, None):
        return run
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-lexora-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in scratch_dir()."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Tables saved within the block lie in one folder, emptied at its end, also after an error: write the result, elsewhere, before.

    The folder is a setting of the session, so runs in threads of one session need a session each (spark.newSession()).
    Blocks may be nested.
    """
    outer = spark.conf.get(RUN, None)
    path = scratch_path(spark, "run")
    spark.conf.set(RUN, path)
    try:
        yield path
    finally:
        if outer:
            spark.conf.set(RUN, outer)
        else:
            spark.conf.unset(RUN)
        spark.range(0).write.mode("overwrite").parquet(path)  # an overwrite deletes all that lies there


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and what reads it reads the same rows."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, label: str, keep: Column | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """df saved, and aggregates over all its rows seen while it is written; with keep, only such rows are written.

    So a check needs no job of its own, and what is checked is what later steps read.
    """
    seen = Observation()
    watched = df.observe(seen, *[m.alias(k) for k, m in metrics.items()])
    return saved(watched if keep is None else watched.where(keep), label), seen.get


def read_table(spark: SparkSession, path: str, required: Iterable[str], schema: str | None = None) -> DataFrame:
    """A CSV with a header; an error lists the missing columns before any work is done."""
    reader = spark.read.option("header", True)
    return require((reader.schema(schema) if schema else reader).csv(path), *required)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """token <tab> count lines as (token, count, line); the file's own rank is its line order, kept by the writer as a column."""
    return spark.read.option("sep", "\t").schema("token string, count long, rank long").csv(path)


def frequency_counts(tokens: DataFrame, unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(token, count) of wanted tokens: those with a space from bigrams, others from unigrams; of repeated lines the first wins."""
    wanted = tokens.select("token").distinct()
    both = unigrams.where("instr(token, ' ') = 0").unionByName(bigrams.where("instr(token, ' ') > 0"))
    return both.join(wanted, "token", "left_semi").groupBy("token").agg(F.min_by("count", "rank").alias("count"))


def scan_ngrams(spark: SparkSession, path: str, policy: str = "letters_only", n: int = 1, prefixes: list[str] | None = None) -> DataFrame:
    """(token, count) over all years from lines token, year, match_count, volume_count; other lines are left out.

    Shards lie in folders prefix2=..; with prefixes, only theirs are opened, and one without a shard is an error.
    """
    lines = spark.read.text(path)
    if prefixes is not None:
        lines = lines.where(F.col("prefix2").isin(*prefixes))
        wanted = spark.createDataFrame([(p,) for p in prefixes], "prefix2 string")
        if absent := [r["prefix2"] for r in wanted.join(shard_names(spark, path), "prefix2", "left_anti").collect()]:
            raise ValueError(f"no shard for: {', '.join(sorted(absent))}")
    parts = F.split("value", "\t")
    word = POLICIES.get(policy, policy)
    pattern = "^" + " ".join([f"(?:{word})"] * n) + "$"
    rows = lines.where(F.size(parts) >= 3).select(F.lower(parts[0]).alias("token"), parts[2].try_cast("long").alias("n"))
    return rows.where(F.col("token").rlike(pattern) & F.col("n").isNotNull()).groupBy("token").agg(F.sum("n").alias("count"))


def shard_prefix(word: Column) -> Column:
    """The first two letters of a word, a one-letter word padded by _."""
    return F.rpad(F.substring(word, 1, 2), 2, "_")


def shard_names(spark: SparkSession, path: str) -> DataFrame:
    """The prefixes (column prefix2) that have a shard, from the listing alone: a file's content is a column that isn't read."""
    return spark.read.format("binaryFile").load(path).select(F.col("prefix2").cast("string").alias("prefix2")).distinct()


def missing_shards(words: DataFrame, shards: DataFrame) -> DataFrame:
    """Wanted prefixes (column prefix2) that no shard has."""
    return words.select(shard_prefix(F.col("token")).alias("prefix2")).distinct().join(shards.select("prefix2").distinct(), "prefix2", "left_anti")


def collect_results(spark: SparkSession, path: str, structures: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Files <structure>_results_<source>.csv below path, both parsed from the name."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("inferSchema", True).csv(path)
    name = F.regexp_extract("_metadata.file_path", r"/([a-z]+)_results_([^/]+)\.csv", 1)
    source = F.regexp_extract("_metadata.file_path", r"/([a-z]+)_results_([^/]+)\.csv", 2)
    out = raw.withColumns({"structure": name, "source": source}).where("structure <> ''")
    if structures:
        out = out.where(F.col("structure").isin(*structures))
    return out.where(F.col("source").isin(*sources)) if sources else out


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(line, token) with 1-based line numbers, and the columns of partition folders; blank lines are counted but left out.

    A folder's parts are one list, in order of their names. Large files are read in splits: a line's number is its
    place in the split and the lines of the splits before.
    """
    lines = spark.read.text(path)
    keys = [c for c in lines.columns if c != "value"]
    at = [F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("_folder"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = saved(lines.select(*keys, *at, F.col("value").alias("token"), F.monotonically_increasing_id().alias("_m")), "vocab")
    splits = rows.groupBy("_folder", "_file", "_start").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.partitionBy("_folder").orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).drop("_n", "_first")
    numbered = rows.join(splits, ["_folder", "_file", "_start"])
    return numbered.select((F.col("_m") + F.col("_base")).alias("line"), F.trim("token").alias("token"), *keys).where("token <> ''")


def parse_norms(texts: DataFrame, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """(doc, sentence, word, probability) of numbered sentence lines and the "* word (p)" lines below each.

    "no response" and ** lines are left out; dashes become spaces; outer quotes go. A document is one list.
    """
    lines = texts.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^\s*\d+[.)]\s*(.+)$", 1)
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("sentence", F.last(F.when(head != "", F.regexp_replace(head, "^[\"']|[\"']$", "")), True).over(w))
    word = F.regexp_extract("line", r"^\s*\*\s*([^(*]+?)\s*\(([0-9.]+)\)", 1)
    p = F.regexp_extract("line", r"^\s*\*\s*([^(*]+?)\s*\(([0-9.]+)\)", 2)
    out = marked.where((word != "") & F.col("sentence").isNotNull() & (F.lower(word) != "no response"))
    return out.select("doc", "sentence", F.translate(word, "-", " ").alias("word"), p.cast("double").alias("probability"))


def unpivot_responses(df: DataFrame, keys: list[str], contexts: dict[str, str], n: int = 6) -> DataFrame:
    """Wide columns <ctx>1..n or <ctx>_1..n to (keys, context, slot, response), whichever full family is there."""
    rows = []
    for short, name in contexts.items():
        family = next((f for f in ([f"{short}{i}" for i in range(1, n + 1)], [f"{short}_{i}" for i in range(1, n + 1)]) if set(f) <= set(df.columns)), None)
        rows += [F.struct(F.lit(name).alias("context"), F.lit(i + 1).alias("slot"), F.col(c).cast("string").alias("response")) for i, c in enumerate(family or [])]
    if not rows:
        raise ValueError("no full family of response columns")
    return df.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


RESULT_SCHEMA = "set_boundary int, num_reps int, context string, trigger string, query string, neg int, log_likelihood double, negation_probability double, probability_query_observed double"


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """The nine result columns by structure and source; overwrite replaces only the partitions that df has."""
    names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    writer = df.select(*names, "structure", "source").write.option("partitionOverwriteMode", "dynamic")
    writer.mode(mode).partitionBy("structure", "source").parquet(path)


def write_slices(df: DataFrame, path: str) -> None:
    """One folder for each source."""
    df.write.mode("overwrite").partitionBy("source").parquet(path)


def manifest(selected: DataFrame, **settings) -> DataFrame:
    """One JSON record per context: its tokens' number, tokens per selection source, first and last token, and the run's settings."""
    per = selected.groupBy("context", "selection_source").agg(F.count("*").alias("n"), F.min("token").alias("first"), F.max("token").alias("last"))
    rows = per.groupBy("context").agg(F.sum("n").alias("tokens"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("selection_source", "n")))).alias("sources"), F.min("first").alias("first"), F.max("last").alias("last"))
    fixed = [F.lit(v).alias(k) for k, v in sorted(settings.items())]
    return rows.select("context", F.to_json(F.struct("tokens", "sources", "first", "last", *fixed)).alias("record"))


def write_scores(df: DataFrame, path: str) -> None:
    df.select("context", "token", "logprob").write.mode("overwrite").partitionBy("context").parquet(path)


def read_scores(spark: SparkSession, path: str, contexts: list[str] | None = None) -> DataFrame:
    """(context, token, logprob); a token without a row, or with NaN, is unscored. Only listed contexts are opened."""
    out = spark.read.parquet(path)
    out = out.where(F.col("context").isin(*contexts)) if contexts else out
    return out.where(~F.isnan("logprob"))
