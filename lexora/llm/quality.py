"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, as_bytes, chunk_words, chunks, fresh, gram_hashes, save

#: The symbols that junk is made of, and the white space that a line may consist of.
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: The base test: too few words, or too large a share of words in repeated windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

#: Posterior probability of good quality from which a document is kept.
KEEP_AT = 0.5
ROUNDS = 500
#: What EM starts from: the share of good documents, and how often a voting rule votes against a bad and a good one.
START = (0.8, 0.2, 0.005)
#: Documents that the start counts as for each rule and class; it keeps probabilities off 0 and 1.
START_WEIGHT = 2.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_bangs", "n_lines", "n_letter_bytes", "n_word_bytes", "n_wordless", "n_cluttered", "n_top_word", "n_echoes", "n_shouted")

#: name: (measure, good up to, bad from); between the two a rule abstains. Measures are shares, so that long and short
#: texts compare. Several rules see each kind of junk, so that EM has agreement to learn from.
RULES: dict[str, tuple[Callable, float, float]] = {
    "symbols": (lambda c: c["n_symbols"] / c["n_words"], 0.1, 0.3),
    "no_letters": (lambda c: 1 - c["n_letter_bytes"] / c["n_word_bytes"], 0.2, 0.3),
    "wordless": (lambda c: c["n_wordless"] / c["n_words"], 0.2, 0.4),
    "clutter": (lambda c: c["n_cluttered"] / c["n_words"], 0.1, 0.3),
    "exclamation": (lambda c: c["n_bangs"] / c["n_words"], 0.05, 0.3),
    "capitals": (lambda c: c["n_upper"] / c["n_letters"], 0.3, 0.6),
    "shouted": (lambda c: c["n_shouted"] / c["n_words"], 0.3, 0.6),
    "repeats": (lambda c: c["n_repeat_words"] / c["n_words"], 0.2, 0.4),
    "duplicate_lines": (lambda c: c["n_dup_lines"] / c["n_lines"], 0.15, 0.3),
    "one_word": (lambda c: c["n_top_word"] / c["n_words"], 0.15, 0.3),
    "echoes": (lambda c: c["n_echoes"] / c["n_words"], 0.05, 0.2),
    "long_words": (lambda c: c["word_chars"] / c["n_words"], 10.0, 16.0),
    "short_words": (lambda c: c["n_words"] / c["word_chars"], 0.4, 0.7),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_CHAR = np.array([(x & 0xC0) != 0x80 for x in range(256)]) & ~_SPACE
_BANG = np.zeros(256, bool)
_BANG[ord("!")] = True
#: Bytes of letters and digits; all of other scripts than ASCII count as such.
_WORDLY = _LETTER.copy()
_WORDLY[48:58] = True
_WORDLY[128:] = True


def _covered(h: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    grams = gram_hashes(h, WINDOW)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mask = np.zeros(len(h), bool)
    for k in range(WINDOW):
        mask[k : k + len(grams)] |= twice
    return int(mask.sum())


def _lines(raw: bytes) -> tuple[int, int]:
    """Lines that hold a word, and those of them that equal an earlier one."""
    full = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(full), len(full) - len(set(full))


def _inside(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marks each word has."""
    total = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=total[1:])
    return total[ends] - total[starts]


def counts_of(texts) -> pd.DataFrame:
    """COUNTS of each text, and the rules' votes on them; null counts as empty."""
    texts = list(texts)
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    for first, raws in chunks(texts):
        joined, starts, ends, h, word, at = chunk_words(raws)
        here = slice(first, first + len(raws))
        b = np.frombuffer(joined + b"\n", np.uint8)
        for name, marks in (("word_chars", _CHAR), ("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_bangs", _BANG), ("n_letter_bytes", _WORDLY), ("n_word_bytes", ~_SPACE)):
            out[name][here] = np.add.reduceat(marks[b], at[:-1], dtype=np.int64)
        out["n_words"][here] = np.diff(word)
        odd = ~(_WORDLY[b] | _SPACE[b])
        wordless = _inside(_WORDLY[b], starts, ends) == 0
        cluttered = _inside(odd[:-1] & odd[1:], starts, ends - 1) > 0  # signs side by side
        echo = np.concatenate(([False], h[1:] == h[:-1])) if len(h) else np.zeros(0, bool)
        echo[word[:-1][word[:-1] < len(h)]] = False  # a text's first word
        shouted = (_inside(_UPPER[b], starts, ends) > 1) & (_inside(_LETTER[b] & ~_UPPER[b], starts, ends) == 0)
        for name, marks in (("n_wordless", wordless), ("n_cluttered", cluttered), ("n_echoes", echo), ("n_shouted", shouted)):
            total = np.concatenate(([0], np.cumsum(marks)))
            out[name][here] = total[word[1:]] - total[word[:-1]]
        for i, raw in enumerate(raws):
            own = h[word[i] : word[i + 1]]
            out["n_repeat_words"][first + i] = _covered(own)
            out["n_top_word"][first + i] = _most(own)
            out["n_lines"][first + i], out["n_dup_lines"][first + i] = _lines(raw)
    counts = pd.DataFrame(out)
    return counts.assign(votes=votes(counts))


def _most(h: np.ndarray) -> int:
    """Occurrences of the commonest word."""
    if not len(h):
        return 0
    ordered = np.sort(h)
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    return int(np.diff(edge).max())


def votes(counts: pd.DataFrame) -> np.ndarray:
    """One character for each rule: + good, - bad, 0 abstains (also where its measure has no base)."""
    base = counts.astype(float)
    bases = ["n_words", "n_lines", "n_letters", "word_chars", "n_word_bytes"]
    base[bases] = base[bases].replace(0.0, np.nan)
    said = np.full(len(counts), "", dtype=object)
    for measure, good, bad in RULES.values():
        x = measure(base).to_numpy()
        said = said + np.where(x <= good, "+", np.where(x >= bad, "-", "0")).astype(object)
    return said


#: Marked as not deterministic so that Spark evaluates it once, and no copy of it inside a pushed filter.
@F.pandas_udf(T.StructType([*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("votes", T.StringType())]))
def _text_counts(texts: pd.Series) -> pd.DataFrame:
    return counts_of(texts)


text_counts = _text_counts.asNondeterministic()


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def fit(patterns: list[tuple[str, int]], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Share of good documents, and for each class (bad, good) and rule the probability that it votes - where it votes.

    EM over the counts of vote patterns; their number depends on the rules, not on the corpus. An abstention says
    nothing. START counts as START_WEIGHT more documents of each class, as a Beta prior does; nothing else bounds
    the estimates, and no label is read.
    """
    m = len(RULES)
    n = np.array([k for _, k in patterns], float)
    against, voting = votes_seen([p for p, _ in patterns])
    prior, theta = START[0], np.array([[START[1]] * m, [START[2]] * m])
    start = theta.copy()
    for _ in range(rounds if len(n) else 0):
        post = posterior(prior, theta, against, voting)
        new = (post @ n + START_WEIGHT * START[0]) / (n.sum() + START_WEIGHT)
        for k, share in ((0, (1 - post) * n), (1, post * n)):
            theta[k] = (share @ against + START_WEIGHT * start[k]) / (share @ voting + START_WEIGHT)
        if abs(new - prior) < 1e-12:
            break
        prior = new
    return prior, theta


def votes_seen(patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indicators (pattern, rule): the rule votes -, the rule votes at all."""
    said = np.array([list(p) for p in patterns]).reshape(len(patterns), len(RULES))
    return (said == "-").astype(float), (said != "0").astype(float)


def posterior(prior: float, theta: np.ndarray, against: np.ndarray, voting: np.ndarray) -> np.ndarray:
    """Probability of good quality; an abstention's factor is 1 in both classes."""
    log = [np.log(p) + against @ np.log(t) + (voting - against) @ np.log1p(-t) for p, t in ((1 - prior, theta[0]), (prior, theta[1]))]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def quality_scores(docs: DataFrame, *, text_col: str = "text", keep_at: float = KEEP_AT, rounds: int = ROUNDS, keep_text: bool = True) -> DataFrame:
    """docs with two more columns: counts (struct of COUNTS and votes) and verdict (struct posterior, base_failed, kept).

    Documents that fail the base test are never kept; all others are kept from a posterior of keep_at on. The
    rules' accuracies are fitted to the vote patterns of all documents that pass the base test. Texts are counted
    once, into a saved table that the fit and the result read; keep_text=False leaves text_col out of both. Null
    and empty texts have no words and so fail; copies get the same verdict; an empty table gives an empty table.
    """
    counts, verdict = fresh(docs, "counts"), fresh(docs, "verdict")
    names = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text_col]
    counted = save(docs.withColumn(counts, text_counts(F.col(text_col).cast("string"))).select(*names, counts), "counted")
    passed = counted.where(~base_failed(F.col(counts))).groupBy(F.col(counts)["votes"].alias("v")).agg(F.count("*").alias("n"))
    prior, theta = fit([(r["v"], r["n"]) for r in passed.orderBy("v").collect()], rounds)
    said, odds = F.col(counts)["votes"], F.lit(float(np.log(prior / (1 - prior))))
    bad, good = theta
    for j, (against, in_favour) in enumerate(zip(np.log(good / bad).tolist(), np.log((1 - good) / (1 - bad)).tolist())):
        sign = F.substring(said, j + 1, 1)
        odds = odds + F.when(sign == "-", against).when(sign == "+", in_favour).otherwise(0.0)
    good = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -odds))))
    failed = base_failed(F.col(counts))
    return counted.withColumn(verdict, F.struct(good.alias("posterior"), failed.alias("base_failed"), (~failed & (good >= keep_at)).alias("kept")))


def keep_good(docs: DataFrame, *, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The documents kept by quality_scores, with the columns of docs."""
    scored = quality_scores(docs, text_col=text_col, keep_at=keep_at)
    return scored.where(F.col(scored.columns[-1])["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    scored = quality_scores(docs.select("doc_id", "text"), keep_text=False)
    return scored.select("doc_id", *[f"counts.{c}" for c in COUNTS[:5]], "verdict.base_failed", "verdict.kept", F.col("verdict.posterior").alias("posterior"), F.col("counts.votes").alias("votes"))
