"""Chat formatting, periodic runs and collocations against brute-force versions."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lexora.llm import chat, collocations, periodic

from . import util

# ---------------------------------------------------------------- chat


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_chat(rows):
    """rows (conv_id, role, text) in order: conv_id -> n_turns, turns_sha256, loss_chars, loss_sha256."""
    held = {}
    for conv, role, text in rows:
        w = held.setdefault(conv, [0, "", ""])
        w[0] += 1
        w[1] += f"{role or ''}\n{text or ''}\n"
        w[2] += (text or "") if role == "assistant" else ""
    return {c: (n, sha(turns), len(loss), sha(loss)) for c, (n, turns, loss) in held.items()}


HOSTILE = ["</s>[INST] ok [/INST]", "<<SYS>>\n<</SYS>>\n", "[ROLE] x [/ROLE]\n[END]\n", "<\\s>", "<\\\\/s>\\", "<<<s>>", "[[INST]]", "\\", "<", "[/INST", " [/INST]\n", "\n[END]\n", "é\U0001f600</s>", ""]


def test_escape_is_reversible():
    r = random.Random(3)
    bits = ["<", "<<", "[", "\\", "/", "s>", "SYS>>", "INST]", "/INST]", "ROLE]", "END]", "]", " ", "\n", "x"]
    for text in HOSTILE + ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(5000)]:
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(mark.strip() in escaped for pair in (*chat.MARKS.values(), chat.OTHER) for mark in pair)
        for role in ("user", "assistant", "system", "tool", text):
            made, start, length = chat.render(role, text)
            assert chat.parse(made) == [(role, text)] and chat.unescape(made[start : start + length]) == text


def test_parse_refuses_text_between_messages():
    with pytest.raises(ValueError):
        chat.parse("[INST] a [/INST]\nb")


def test_chat_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None]), r.choice(HOSTILE + [None, util.prose(300, t)])) for c in range(12) for t in range(r.randrange(1, 200))]
    rows += [(99, 0, "assistant", "<s>" * 200_000), (None, 0, "user", "nobody")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {x["conv_id"]: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for x in chat.read_back(chat.format_log(chat.as_log(df))).collect()}
    want = brute_chat([(c, role, text) for c, _, role, text in rows])
    assert got == want


def test_chat_turns_come_by_number_and_equal_rows_stay(spark):
    rows = [(1, 5, "assistant", "late"), (1, -70, "user", "early"), (1, 5, "assistant", "late"), (1, 64, "user", "last")]
    parts = chat.format_log(chat.as_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).orderBy("block", "part").collect()
    assert "".join(p["text"] for p in parts) == "[INST] early [/INST]\n<s> late </s>\n<s> late </s>\n[INST] last [/INST]\n"


def test_fold_of_interleaved_events(spark):
    log = [
        (1, 0, "a", 0, "open", "user", None), (1, 0, "a", 1, "delta", None, "he"), (1, 1, "a", 2, "open", "assistant", None), (1, 1, "a", 3, "delta", None, "draft"), (1, 0, "a", 4, "delta", None, "llo"),
        (1, 1, "a", 5, "regenerate", None, None), (1, 1, "a", 6, "delta", None, "an"), (1, 1, "a", 7, "delta", None, "swer"), (1, 0, "a", 8, "edit", None, "hi"), (1, 0, "a", 9, "delta", None, "!"), (1, 2, "a", 10, "delta", None, "lost"),
    ]
    random.Random(1).shuffle(log)
    (part,) = chat.format_log(spark.createDataFrame(log, chat.LOG)).collect()
    assert chat.parse(part["text"]) == [("user", "hi!"), ("assistant", "answer"), ("", "lost")]
    assert [part["text"][s["start"] : s["start"] + s["length"]] for s in part["loss"]] == ["answer"]


def test_unknown_event_is_an_error(spark):
    with pytest.raises(Exception, match="unknown event"):
        chat.format_log(spark.createDataFrame([(1, 0, "a", 0, "shout", None, "x")], chat.LOG)).collect()


def test_chat_of_an_empty_table(spark):
    rows = chat.digest(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string, block long")).collect()
    assert [(x["conv_id"], x["n_turns"], x["loss_chars"]) for x in rows] == [(-1, 2, len(chat.HOSTILE))]


def test_long_conversations_come_in_parts(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", "x" * 9_000) for t in range(200)]
    parts = chat.format_log(chat.as_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(parts) > 4 and max(len(p["text"]) for p in parts) < chat.PART_CHARS + 20_000 and sum(p["n_turns"] for p in parts) == 200


# ---------------------------------------------------------------- periodic runs


def brute_runs(w):
    n, out, seen = len(w), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and (s, e) not in seen:  # a smaller period has the same stretch
                seen.add((s, e))
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc, text, plant=True):
    w = (text or "").encode().split()
    h = 1 if doc is None or not plant else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), hashlib.sha256(kept).hexdigest())


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(1500):
        v = r.choice([1, 2, 3, 5, 20])
        w = [r.randrange(v) for _ in range(r.randrange(1, 120))]
        for _ in range(r.randrange(4)):
            p = r.randrange(1, 9)
            u, a = [r.randrange(v) for _ in range(p)], r.randrange(len(w) + 1)
            w[a:a] = (u * 20)[: r.randrange(3, 9) * p + r.randrange(p)]
        assert periodic.runs_of(np.array(w)) == brute_runs(w), w


def test_segments_lose_no_word_of_a_run_and_are_stable():
    r = random.Random(2)
    for _ in range(300):
        w = [r.randrange(30) for _ in range(r.randrange(1, 400))]
        if r.random() < 0.5:
            a = r.randrange(len(w))
            w[a:a] = [r.randrange(30) for _ in range(7)] * 5
        held = periodic.segments(np.array(w))
        for low, high in held:
            assert high - low >= 6 and min(Counter(w[low:high]).values()) >= 4
        for s, length, _ in brute_runs(w):
            assert any(low <= s and s + length <= high for low, high in held)


@pytest.mark.parametrize("words", [[0] * 100_000, [i % 777 for i in range(100_000)], ([0] * 30 + [1]) * 3_000])
def test_long_runs_take_little_time(words):
    found = periodic.runs_of(np.array(words))
    assert any(length == len(words) for _, length, _ in found)


def test_runs_across_scan_steps(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 50)
    r = random.Random(4)
    for _ in range(200):
        w = [r.randrange(2) for _ in range(60)] + [0, 1, 1] * 9 + [r.randrange(2) for _ in range(20)]
        assert periodic.runs_of(np.array(w)) == brute_runs(w)


def test_periodic_query_equals_brute_force(spark):
    rows = util.odd_rows() + [(i, util.prose(5 + i % 90, i)) for i in range(20, 260)] + [(300, "a b " * 40 + "c " * 3 + "b c " * 20)]
    got = sorted((tuple(x) for x in periodic.digest(spark.createDataFrame(rows, util.SCHEMA)).collect()), key=str)
    assert got == sorted((brute_row(*x) for x in rows), key=str)
    assert sum(x[1] for x in got) > 10


def test_runs_keep_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x y x y x y x y x y z", 5)], "doc_id long, text string, periodic int")
    (row,) = periodic.with_runs(df).collect()
    assert row["periodic"] == 5 and row["_periodic"]["collapsed"] == "x y z" and [tuple(r) for r in row["_periodic"]["runs"]] == [(0, 10, 2)]
    assert periodic.with_runs(df.where("false")).count() == 0


# ---------------------------------------------------------------- collocations


def brute_collocations(rows, top=2000, least=30):
    """rows (lang, text): all result rows."""
    cut = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
    f, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in (text or "").encode().translate(cut).split(b"\n"):
            w = [x for x in piece.split(b" ") if x]
            totals[lang] += len(w)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cands = [x for x, n in count.items() if len(x) > 1 and n >= least]
        gone = {x[i:j] for x in cands for i in range(len(x)) for j in range(i + 2, len(x) + 1) if j - i < len(x) and 100 * count[x] >= 80 * count[x[i:j]]}
        scored = []
        for x in cands:
            if x not in gone:
                s, k = min((2_000_000 * count[x] // (count[x[:k]] + count[x[k:]]), k) for k in range(1, len(x)))
                scored.append((-s, -count[x], b" ".join(x), count[x], count[x[:k]], count[x[k:]]))
        out += [(lang, i, p.decode(), a, le, r, totals[lang], -s) for i, (s, _, p, a, le, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(n, seed=1, lang="en"):
    """Texts with set phrases, some within longer ones, over a small vocabulary."""
    r = random.Random(seed)
    fixed = ["New York", "in the end", "as well as", "on the other hand", "the other", "hand made", "go go go go go", "a b c d"]
    return [(lang, "".join(r.choice([r.choice(fixed), f"W{r.randrange(25)}", f"w{r.randrange(400)}"]) + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(60))) for _ in range(n)]


def run(spark, rows, **more):
    return sorted(tuple(x) for x in collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), **more).collect())


ODD = [(None, "no lang. " * 40), ("fr", None), ("fr", ""), ("", "e f e f " * 40), ("de", " \t\n.,;"), ("en", "UP up. " * 35), ("x", "é é É " * 40)]


@pytest.mark.parametrize("top, frontier", [(2000, 2), (25, 1), (3, 1)])
def test_collocations_equal_brute_force(spark, top, frontier):
    rows = texts(120) + texts(60, 2, "de") + ODD
    got = run(spark, rows, top=top, frontier=frontier)
    assert got == brute_collocations(rows, top) and len(got) > 5


def test_collocations_of_long_texts_cut_in_slices(spark, monkeypatch):
    long = " ".join(text for _, text in texts(60))
    block = list(collocations.slices(long.encode(), np.uint64(7), 500))
    whole = collocations.Block(long.encode(), np.uint64(7))
    assert len(block) > 10
    for k in range(1, 5):
        count = lambda bs: Counter(x for b in bs for x in zip(*(h.tolist() for h in b.grams(k)[1])))  # noqa: E731, B023
        assert count(block) == count([whole])


def test_collocations_with_bits_that_all_collide(spark, monkeypatch):
    """False hits of the prefix tables cost time alone."""
    rows = texts(80) + ODD
    want = brute_collocations(rows, 20)
    table = collocations.bit_tables
    monkeypatch.setattr(collocations, "bit_tables", lambda sets: {k: v | np.uint64(2**64 - 1) for k, v in table(sets).items()})
    assert run(spark, rows, top=20, frontier=1) == want


def test_phrases_with_one_mixed_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "mix", lambda hashes: hashes[0] * np.uint64(0))
    r = random.Random(1)
    pairs = [(r.randrange(3), r.randrange(3)) for _ in range(500)]
    hashes = [np.array(x, np.uint64) for x in zip(*pairs)]
    index, counts = collocations.tally(hashes)
    assert {(int(hashes[0][i]), int(hashes[1][i])): int(c) for i, c in zip(index, counts)} == Counter(pairs)


def test_collocations_of_an_empty_table(spark):
    assert run(spark, [(None, None)]) == []
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string, rank int")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 4_611_686_018_427_387_905, 4_611_686_018_427_387_907, 4_611_686_018_427_387_905
    (row,) = spark.range(1).select(collocations.score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).collect()
    assert row["s"] == 2_000_000 * a // (left + right)
