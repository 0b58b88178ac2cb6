"""Scalar functions on words, prompts and keys (columns in, columns out)."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Answers that say nothing, and texts that mean true.
NO_ANSWER = ("", "nan", "none", "na", "n/a", "x")
TRUE_TEXTS = ("true", "1", "t", "yes", "y")

POLICIES = {"letters_only": "[a-z]+", "letters_apostrophe_hyphen": "[a-z]+(?:['-][a-z]+)*"}


def clean_word(c: Column) -> Column:
    """Trimmed, lower case, without one leading article and its space; not trimmed again."""
    return F.regexp_replace(F.lower(F.trim(c)), "^(a|an) ", "")


def normalize_display(c: Column) -> Column:
    """Null as empty; trimmed, lower case, without one leading a/an/my, white space as single spaces."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"^(?:a|an|my)\s+", ""), r"\s+", " "))


def match_key(c: Column) -> Column:
    """Letters and digits alone, in a simple singular: the first rule that fits decides."""
    k = F.regexp_replace(normalize_display(c), "[^a-z0-9]", "")
    n = F.length(k)
    return (
        F.when(n <= 3, k)
        .when(k.rlike("ies$") & (n > 4), F.concat(k.substr(F.lit(1), n - 3), F.lit("y")))
        .when(k.rlike("(ss|sh|ch|x|z)es$"), k.substr(F.lit(1), n - 2))
        .when(k.rlike("s$") & ~k.rlike("(ss|us|is)$"), k.substr(F.lit(1), n - 1))
        .otherwise(k)
    )


def ngram_kind(c: Column, policy: str = "letters_only", strip_articles: bool = False) -> Column:
    """1gram, 2gram, or unsupported, by the number of parts that all fit the policy (a name above or a pattern)."""
    word = clean_word(c) if strip_articles else F.lower(F.trim(c))
    parts = F.split(word, r"\s+")
    fits = F.forall(parts, lambda p: p.rlike(f"^(?:{POLICIES.get(policy, policy)})$"))
    return F.when(fits & (F.size(parts) == 1), "1gram").when(fits & (F.size(parts) == 2), "2gram").otherwise("unsupported")


@F.pandas_udf(T.StringType())
def norm_text(s: pd.Series) -> pd.Series:
    """Unicode NFC, then stripped; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).strip())


def informative(c: Column) -> Column:
    """The answer trimmed and in lower case; null where it says nothing."""
    low = F.lower(F.trim(c))
    return F.when(~low.isin(*NO_ANSWER), low)


def parse_bool(c: Column, strict: bool = False) -> Column:
    """Lenient: anything but a text for true is false. Strict: only true, false, 1 and 0, else an error."""
    low = F.lower(F.trim(c.cast("string")))
    if not strict:
        return F.coalesce(low.isin(*TRUE_TEXTS), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(low, F.lit("null"))))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).otherwise(wrong.cast("boolean"))


def to_number(c: Column, mode: str = "coerce", *, least: int = 0, tolerance: float = 1e-9) -> Column:
    """coerce: null unless a finite number; raise: ANSI cast; integer: a whole number of at least `least`, else null."""
    if mode == "raise":
        return c.cast("double")
    x = c.try_cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    if mode == "integer":
        return F.when((F.abs(x - F.round(x)) <= tolerance) & (F.round(x) >= least), F.round(x).cast("long"))
    return x


#: Words of source names with a spelling of their own.
NAMES = {"llm": "LLM", "bert": "BERT", "src": "Source"}


def pretty_name(c: Column, names: dict[str, str] = NAMES) -> Column:
    """Parts between _ and - by their known names, else capitalised, joined by spaces."""
    one = lambda p: reduce(lambda e, kv: e.when(p == kv[0], kv[1]), names.items(), F.when(F.lit(False), "")).otherwise(F.initcap(p))
    return F.array_join(F.transform(F.filter(F.split(F.lower(c), "[_-]"), lambda p: p != ""), one), " ")


def key(*cols: Column, style: str = "::") -> Column:
    """Composite key: joined by a separator, or a compact JSON array."""
    if style == "json":
        return F.to_json(F.array(*[c.cast("string") for c in cols]))
    return F.concat_ws(style, *cols)


def make_prompt(prompt: Column, trigger: Column, style: str = "mask") -> Column:
    """mask: what follows the last "only have/has " up to the closing quote becomes the trigger and a mask. but_not: the trigger and "but not" are appended."""
    if style == "but_not":
        return F.concat(F.rtrim(prompt), F.lit(" "), trigger, F.lit(" but not "))
    head = F.regexp_extract(prompt, r"(?s)^(.*only ha(?:ve|s) )", 1)
    rest = F.regexp_extract(prompt, r"(?s)^.*only ha(?:ve|s) [^']*'(.*)$", 1)
    return F.when(head != "", F.concat(head, trigger, F.lit(" and [MASK].'"), rest)).otherwise(prompt)


def split_boundary(prompt: Column, candidate: Column) -> Column:
    """struct(prefix, continuation): white space at the prompt's end goes to the candidate; null if there is none or the candidate is empty."""
    space, own = F.regexp_extract(prompt, r"(?s)^.*\S(\s+)$", 1), F.trim(candidate)
    prefix = F.regexp_extract(prompt, r"(?s)^(.*\S)\s+$", 1)
    return F.when((space != "") & (own != ""), F.struct(prefix.alias("prefix"), F.concat(space, own).alias("continuation")))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, sha256) for a table's content, whatever the order of its rows: hashes of rows are counted, summed by their leading digits, and hashed.

    No task holds the rows: every row's SHA-256 enters as four sums of 60-bit parts, which combine map-side.
    """
    own = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns]), 256)
    parts = [F.sum(F.conv(F.substring(own, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    sums = df.agg(F.count("*").alias("rows"), *parts)
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", *[F.coalesce(F.col(f"p{i}"), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(4)]), 256).alias("sha256"))


def valid_word(c: Column, style: str = "ascii") -> Column:
    """ascii: more than one ASCII letter and no subword mark; loose: letters, then also hyphens and apostrophes."""
    return c.rlike("^[A-Za-z]{2,}$") if style == "ascii" else c.rlike("^[A-Za-z][A-Za-z'-]*$")


def uniform(*cols: Column, seed: int | str = 7) -> Column:
    """A number in (0, 1) that depends on the values alone, so that results don't depend on partitions: 28 bits of md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("double") + 0.5) / float(1 << 28)


def require(df: DataFrame, *names: str) -> DataFrame:
    """df, or an error that lists the missing columns before any work is done."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
