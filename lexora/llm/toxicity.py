"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A sentence's score is the logistic of a sum of weights of its words and their beginnings (hashed); a document's is the probability
that at least one sentence is toxic, 1 - prod(1 - p). Only documents have labels; the fit finds the sentences.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, _power, chunks, fresh, scramble, words_of

#: Documents that the model is fitted to: those labelled rows whose hash of doc_id is smallest, each to its whole length.
SAMPLE_DOCS = 6_000
#: Features of them that the driver holds: the sample ends, in order of hashes, before the document that would exceed them.
SAMPLE_FEATURES = 10_000_000
#: A feature takes part if its documents' labels are too uneven for chance: log-likelihood ratio above 2 ln(features) + EVIDENCE.
EVIDENCE = 6.0
#: Besides the word itself, its beginnings of so many bytes are features: insults are inflected.
PREFIXES = (4, 5, 6)
DIMENSIONS = 1 << 18
ROUNDS = 120
RATE = 0.1
DECAY = 1e-5
TOXIC_AT = 0.7
SENTENCE_AT = 0.5

#: Lower case, with every ASCII character that is no letter or digit as a space.
_PLAIN = np.array([x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256)], np.uint8)
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_END = 0x0A


def features(raws: list[bytes]):
    """Of several texts: hashed features, each one's sentence, sentences' texts, and the sentences' byte spans in the joined texts."""
    joined = b"\n".join(raws) + b"\n"
    b = np.frombuffer(joined, np.uint8)
    plain = _PLAIN[b]
    starts, ends, h = words_of(plain.tobytes())
    stop = np.flatnonzero(_STOP[b])  # a sentence ends with such a character
    sentence, which = np.unique(np.searchsorted(stop, starts), return_inverse=True)
    at = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raws], out=at[1:])
    first = np.concatenate(([0], stop[:-1] + 1))[sentence] if len(stop) else np.zeros(0, np.int64)
    hashes, owners, own = [h], [which], np.zeros(len(h), np.uint64)
    for k in range(max(PREFIXES)):
        long = starts + k < ends
        own[long] += _BYTE[plain[starts[long] + k]] * _power("up", k + 1)[k]
        if k + 1 in PREFIXES:
            longer = starts + k + 1 < ends
            hashes.append(scramble(own[longer] + np.uint64(k + 1)))
            owners.append(which[longer])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    h, which = h[order], owner[order]
    return (h & np.uint64(DIMENSIONS - 1)).astype(np.int32), which, np.searchsorted(at, first, "right") - 1, first, stop[sentence] + 1, at


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(words: np.ndarray, sentence: np.ndarray, doc: np.ndarray, toxic: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias: full-batch Adam on the log loss of noisy-or scores, documents of both labels weighed alike in sum up to a factor of three."""
    n_sentences, n_docs = len(doc), len(toxic)
    share = max(toxic.mean(), 1e-6) if n_docs else 0.5
    weigh = np.where(toxic == 1, min(3.0, 0.5 / share), 1.0) / max(n_docs, 1)
    w, bias = np.zeros(DIMENSIONS), -5.0
    m1, m2, b1, b2 = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    for k in range(1, rounds + 1 if n_sentences else 0):
        z = bias + np.bincount(sentence, w[words], n_sentences)
        p = logistic(z)
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs)
        hit = -np.expm1(none)
        pull = np.where(toxic == 1, -(1 - hit) / np.maximum(hit, 1e-12), 1.0) * weigh
        g_z = pull[doc] * p
        g = np.bincount(words, g_z[sentence], DIMENSIONS) + DECAY * w
        gb = g_z.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        a, c = 1 - 0.9**k, 1 - 0.999**k
        w -= RATE * (m1 / a) / (np.sqrt(m2 / c) + 1e-8)
        bias -= RATE * (b1 / a) / (np.sqrt(b2 / c) + 1e-8)
    return w, bias


def telling(words: np.ndarray, of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which features are found in documents of one label more than chance allows (G-test on document counts)."""
    pairs = np.unique(of.astype(np.int64) * DIMENSIONS + words)
    feature, label = pairs & (DIMENSIONS - 1), toxic[pairs >> (DIMENSIONS.bit_length() - 1)]
    n = np.bincount(feature, minlength=DIMENSIONS).astype(float)
    hits = np.bincount(feature, label, DIMENSIONS)
    total, marked = float(len(toxic)), float(toxic.sum())
    part = lambda x, expected: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(expected, 1e-300)), 0.0)
    g = 2 * (part(hits, n * marked / total) + part(n - hits, n * (total - marked) / total) + part(marked - hits, (total - n) * marked / total) + part(total - marked - n + hits, (total - n) * (total - marked) / total))
    return g > 2 * np.log(max((n > 0).sum(), 2)) + EVIDENCE


def train(docs: DataFrame, labels: DataFrame, usable: Column, *, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """Fit to at most sample_docs labelled documents for which `usable` holds; rows without a label or id are left out."""

    def bags(batches):
        for pdf in batches:
            out = []
            for first, raws in chunks(list(pdf["text"])):
                words, sentence, doc, *_ = features(raws)
                of = doc[sentence] if len(doc) else np.zeros(0, np.int64)
                for i in range(len(raws)):
                    own = np.flatnonzero(of == i) if len(raws) == 1 else slice(*np.searchsorted(of, [i, i + 1]))
                    s = sentence[own]
                    out.append((int(pdf["toxic"].iloc[first + i]), words[own].astype("<i4").tobytes(), (s - s[0] if len(s) else s).astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["toxic", "words", "sentences"]).assign(doc_id=list(pdf["doc_id"]), text_key=list(pdf["text_key"]))

    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marks.where(usable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").withColumn("text_key", F.xxhash64("text"))
    rows = rows.mapInPandas(bags, "toxic int, words binary, sentences binary, doc_id long, text_key long")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").select("toxic", "words", "sentences")  # the same sample in the same order, whatever the partitions
    words, sentence, doc, toxic, base, size, seen = [], [], [], [], 0, 0, set()
    for t, w, s in ((r["toxic"], r["words"], r["sentences"]) for r in rows.toLocalIterator()):
        w, s = np.frombuffer(w, "<i4"), np.frombuffer(s, "<i4").astype(np.int64)
        if size + len(w) > SAMPLE_FEATURES:
            break
        if not len(w) or (key := hash(w.tobytes())) in seen:
            continue  # copies would make all of a text's words look telling
        seen.add(key)
        n = int(s.max()) + 1
        words.append(w)
        sentence.append((s + base).astype(np.int32))
        doc.append(np.full(n, len(toxic), np.int32))
        toxic.append(t)
        base, size = base + n, size + len(w)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
    words, sentence, doc = join(words), join(sentence), join(doc)
    toxic = np.array(toxic)
    keep = telling(words, doc[sentence], toxic)[words] if len(words) else np.zeros(0, bool)
    return fit(words[keep], sentence[keep], doc, toxic)


def score_texts(texts, w: np.ndarray, bias: float) -> pd.DataFrame:
    """score, and the offending sentences as character spans (start, end, score), of each text."""
    texts = list(texts)
    score, spans = np.zeros(len(texts)), [[] for _ in texts]
    empty = float(logistic(np.array([bias]))[0])
    for first, raws in chunks(texts):
        words, sentence, doc, lo, hi, at = features(raws)
        p = logistic(bias + np.bincount(sentence, w[words], len(doc)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(raws))
        has = np.bincount(doc, minlength=len(raws)) > 0
        score[first : first + len(raws)] = np.where(has, -np.expm1(none), empty)
        for k in np.flatnonzero(p >= SENTENCE_AT):
            i = int(doc[k])
            raw, a, b = raws[i], int(lo[k] - at[i]), int(min(hi[k] - at[i], len(raws[i])))
            start = len(raw[:a].decode("utf-8", "replace"))
            spans[first + i].append({"start": start, "end": start + len(raw[a:b].decode("utf-8", "replace")), "score": float(p[k])})
    return pd.DataFrame({"score": np.clip(score, 0, 1), "sentences": spans})


def with_scores(docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text") -> DataFrame:
    """docs with one more column toxicity: struct (score, sentences: offending sentences' spans and scores).

    Null and empty texts, and texts without a word, get the score of an empty sentence. Rows are scored each for
    itself, so ids may repeat or be null, and copies get the same score; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), float(model[1])))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("sentences", T.ArrayType(span))])

    @F.pandas_udf(kind)
    def scored(texts: pd.Series) -> pd.DataFrame:
        return score_texts(texts, *held.value)

    return docs.withColumn(fresh(docs, "toxicity"), scored(F.col(text_col).cast("string")))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels the fit never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= TOXIC_AT).cast("int").alias("predicted"),
        F.size("toxicity.sentences").cast("long").alias("n_sentences"),
    )
