"""A study derived from the driver's tables, in DataFrames and in the oracle's SQL.

Languages are contexts, sources play models, users answer trials. VIEWS is the SQL of the same views.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexora.functions.text import uniform
from lexora.operators.vocab import with_total
from lexora.sources.files import saved

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


#: Tables that the query being built in a thread has saved already: each is made once in a call, however many views read it.
_building = threading.local()


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL over VIEWS and the driver's tables that it must equal."""

    def add(f):
        def call(spark, d):
            _building.made = {}
            try:
                return f(spark, d)
            finally:
                del _building.made

        QUERIES[name] = call
        if sql is not None:
            body = sql.strip()
            SQL[name] = VIEWS + (", " + body[5:] if body[:5].upper() == "WITH " else "\n" + body)
        return f

    return add


def once(name: str):
    """Have a view saved by the first of a query's steps that reads it."""

    def add(view):
        def get(spark, d):
            made = getattr(_building, "made", {})
            if (name, d) not in made:
                made[name, d] = saved(view(spark, d), name)
            return made[name, d]

        return get

    return add


def u_sql(*cols: str, seed: int | str = 7) -> str:
    """SQL of functions.text.uniform."""
    text = "concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"
    return f"((('0x' || substr(md5({text}), 1, 7))::BIGINT + 0.5) / 268435456.0)"


VIEWS = f"""
WITH words AS (
  SELECT lang AS context, source, doc_id, token, pos FROM (
    SELECT lang, source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token,
           generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS pos FROM documents)
), counts AS (
  SELECT context, token, count(*) AS n FROM words WHERE length(token) >= 4 GROUP BY context, token
), dist AS (
  SELECT context, token, n, row_number() OVER (PARTITION BY context ORDER BY n DESC, token) AS rk FROM counts
), global_dist AS (
  SELECT token, sum(n)::BIGINT AS n FROM counts GROUP BY token
), pairs AS (
  SELECT a.context, a.token AS trigger, b.token AS query, a.rk AS rt, b.rk AS rq
  FROM dist a JOIN dist b ON a.context = b.context AND a.token <> b.token WHERE a.rk <= 6 AND b.rk <= 6
), users AS (
  SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL
), trials AS (
  SELECT context, trigger, query, user_id, rt, rq,
         CASE WHEN {u_sql("context", "trigger", "query", "user_id")} < 0.2 + 0.4 * (rq < rt)::INT + 0.2 * (rq <= 3)::INT THEN 1 ELSE 0 END AS neg
  FROM pairs CROSS JOIN users
), scores AS (
  SELECT context, token, n, ln(n / sum(n) OVER (PARTITION BY context)) AS logprob FROM dist
), model_counts AS (
  SELECT source, context, token, count(*) AS n FROM words WHERE length(token) >= 4 GROUP BY source, context, token
)"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def words(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    split = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    return docs.select(F.col("lang").alias("context"), "source", "doc_id", F.posexplode(split).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)


def pieces() -> Column:
    """A text cut at all that is no letter: its words, and an empty text where it begins or ends with something else. Cheaper than finding the words one by one."""
    return F.split(F.lower("text"), "[^a-z]+")


def bare_words(spark: SparkSession, d: str) -> DataFrame:
    """words() without positions."""
    return documents(spark, d).select(F.col("lang").alias("context"), "source", "doc_id", F.explode(pieces()).alias("token")).where("token <> ''")


@once("unigrams")
def unigrams(spark: SparkSession, d: str) -> DataFrame:
    """(context, token, n) of words of any length."""
    return bare_words(spark, d).groupBy("context", "token").agg(F.count("*").alias("n"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    return unigrams(spark, d).where(F.length("token") >= 4)


def dist(spark: SparkSession, d: str) -> DataFrame:
    """The whole next-word distribution: (context, token, n)."""
    return counts(spark, d)


def top(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The k most frequent words of a context with their rank rk; a task keeps k rows of each."""
    w = Window.partitionBy("context").orderBy(F.desc("n"), "token")
    return counts(spark, d).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def global_dist(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).groupBy("token").agg(F.sum("n").alias("n"))


@once("pairs")
def pairs(spark: SparkSession, d: str) -> DataFrame:
    """30 pairs for each language."""
    best = top(spark, d, 6)
    a = best.select("context", F.col("token").alias("trigger"), F.col("rk").alias("rt"))
    b = best.select("context", F.col("token").alias("query"), F.col("rk").alias("rq"))
    return a.join(b, "context").where("trigger <> query")


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("user_id is not null").select("user_id").distinct()


#: Answers in one file of the saved trials. Spark reads some 32 small files in one task, which bounds a task's rows at every size.
ANSWERS = 50_000


@once("trials")
def trials(spark: SparkSession, d: str) -> DataFrame:
    """The study's answers: every user is asked every pair (30 for each language), which is what a full design is.

    Users are few bytes but many answers, so the answers' number decides on the tasks that make them.
    """
    asked = pairs(spark, d).agg(F.collect_list(F.struct("context", "trigger", "query", "rt", "rq")).alias("asked"))
    known = saved(users(spark, d), "users")
    parts = -(-known.count() * pairs(spark, d).count() // ANSWERS)
    each = known.repartition(max(parts, 1), "user_id").withColumn("pair", F.explode(asked.scalar())).select("user_id", "pair.*")
    p = 0.2 + 0.4 * (F.col("rq") < F.col("rt")).cast("int") + 0.2 * (F.col("rq") <= 3).cast("int")
    u = uniform(F.col("context"), F.col("trigger"), F.col("query"), F.col("user_id"))
    return each.withColumn("neg", F.when(u < p, 1).otherwise(0)).select("context", "trigger", "query", "user_id", "rt", "rq", "neg")


@once("scores")
def scores(spark: SparkSession, d: str) -> DataFrame:
    return with_total(dist(spark, d), F.sum("n"), "all_n").select("context", "token", "n", F.log(F.col("n") / F.col("all_n")).alias("logprob"))


def model_counts(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).where(F.length("token") >= 4).groupBy("source", "context", "token").agg(F.count("*").alias("n"))


@once("grams")
def grams(spark: SparkSession, d: str) -> DataFrame:
    """(w1, w2, count) of each word and the next one over all languages, paired within its array and counted in one shuffle; w2 is empty after a document's last word.

    No filter stands before the pairs: Spark would move it below the split and cut every text twice.
    """
    both = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))
    rows = documents(spark, d).select(pieces().alias("w")).select(F.explode(both).alias("p")).where("p.a <> ''")
    return rows.select(F.col("p.a").alias("w1"), F.coalesce("p.b", F.lit("")).alias("w2")).groupBy("w1", "w2").agg(F.count("*").alias("count"))


def bigrams(spark: SparkSession, d: str) -> DataFrame:
    """(token, count) of adjacent words over all languages."""
    return grams(spark, d).where("w2 <> ''").select(F.concat("w1", F.lit(" "), "w2").alias("token"), "count")


def first_words(spark: SparkSession, d: str) -> DataFrame:
    """(token, count) of all words: each begins one row of grams(), so no text is cut again."""
    return grams(spark, d).groupBy(F.col("w1").alias("token")).agg(F.sum("count").alias("count"))
