"""Substring dedup, line dedup and the Jaccard join against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from lexora.llm import common, components, jaccard_join, line_dedup, substring_dedup

from .util import SCHEMA, odd_rows, prose, words


def substring_expected(rows):
    seen, out = {}, {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        mine = set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in mine or seen.get(k, d) < d:
                gone[i : i + 20] = [True] * 20
            mine.add(k)
        for k in mine:
            seen.setdefault(k, d)
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substring_dedup(spark):
    base = prose(300, 9).split()
    rows = odd_rows() + [(100, " ".join(base[:90])), (101, " ".join(base[20:60] + ["cut"] + base[60:140])), (102, " ".join(base[:45] * 3)), (103, " ".join(base[100:119]))]
    rows += [(200 + i, f"w{i} x{i} " * 3 + " ".join(base[200:260]) + f" e{i} f{i}" * 4) for i in range(220)]  # a passage of many documents
    got = substring_dedup.digest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = substring_expected(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_substring_splits_anchors_of_many_segments(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", 3)
    base = prose(60, 21)
    rows = [(i, f"{prose(25, 600 + i)} {' '.join(base.split()[i : i + 30])} {prose(22, 900 + i)}") for i in range(25)] + [(40, base), (41, base + " " + base)]
    want = substring_expected(rows)
    for r in substring_dedup.digest(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_substring_keeps_rows_of_one_id_apart(spark):
    """A text that repeats nowhere stays, whatever other rows of its id lose."""
    a, b, c = prose(60, 31), prose(60, 32), prose(60, 34)
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (5, c), (5, c), (6, c), (None, a), (None, prose(60, 33))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    removed = sorted((r.doc_id or 0, r.n_removed) for r in got)
    assert removed == [(0, 0), (0, 0), (1, 0), (2, 0), (2, 60), (3, 60), (3, 60), (5, 0), (5, 0), (6, 60)]


def test_substring_empty_table(spark):
    assert substring_dedup.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_automaton_matches_windows():
    r = np.random.default_rng(4)
    for _ in range(20):
        texts = [[bytes([x]) for x in r.integers(0, 2, 12)] for _ in range(6)]
        seen = set()
        for own, bits in zip(texts, substring_dedup.earlier_windows(texts, 4)):
            mine = [tuple(own[i : i + 4]) for i in range(9)]
            here = set()
            for i, w in enumerate(mine):
                assert bool(bits >> i & 1) == (w in seen or w in here)
                here.add(w)
            seen |= here


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = (prose(500, 5) + " a\x0bb\x0cc").encode()
    whole = common.words_of(text)
    monkeypatch.setattr(common, "BLOCK", 64)
    for a, b in zip(whole, common.words_of(text)):
        assert (a == b).all()
    assert [text[a:b] for a, b in zip(whole[0], whole[1])] == text.split()


def line_expected(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower()))
    n = Counter(k for d, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return {d: (len((t or "").split("\n")), sum(n[key(x)] >= least for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if n[key(x)] < least)) for d, t in rows}


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  Common LINE\t\nÉté {i % 2}\n\ncommon line") for i in range(12)] + [(20, None), (21, ""), (22, "\n\n"), (23, "été 0"), (24, "COMMON line")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", n_lines string, gone int")
    out = line_dedup.drop_common_lines(df, min_docs=5)
    assert out.columns == ["doc_id", "text", "n_lines", "gone", "_n_lines", "n_dropped"]
    want = line_expected(rows, 5)
    for r in out.collect():
        assert (r._n_lines, r.n_dropped, r.text or "") == want[r.doc_id]
    assert line_dedup.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_keeps_texts_of_one_id_apart(spark):
    rows = [(i, f"own {i}\ncommon") for i in range(5)] + [(None, "common\nmine"), (None, "clean\nlines"), (9, "common\nmine"), (9, "short"), (9, None)]
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows, SCHEMA), min_docs=5).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.text, r.n_dropped) for r in got if r.doc_id in (None, 9)} == {(None, "mine", 1), (None, "clean\nlines", 0), (9, "mine", 1), (9, "short", 0), (9, None, 0)}


def test_line_dedup_of_long_texts_and_repeated_rows(spark):
    rows = [(i, f"own {i}\ncommon") for i in range(6)] + [(7, "\n".join(f"line {k}" if k % 3 else "Common " for k in range(30_000))), (8, "x" * 2_000_000 + "\ncommon"), (9, "common"), (9, "common"), (9, "common\nonce")]
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), min_docs=5).collect()
    expected = [(d, "\n".join(x for x in t.split("\n") if x.strip().lower() != "common"), sum(x.strip().lower() == "common" for x in t.split("\n"))) for d, t in rows]
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got) == sorted(expected)


def sets_of(rows):
    out = {}
    low = str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower())
    for d, t in rows:
        w = words((t or "").translate(low))
        out[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    return out


def components_expected(sets):
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def near_copies(n, seed):
    import random

    r, base = random.Random(seed), prose(150, 7).split()
    rows = [x for x in odd_rows() if x[0] is not None and x[0] != 8]
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((300 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("block", "rounds", "rows"), [(150_000, 3, 500_000), (2_000, 1, 500_000), (1_000, 2, 0), (600, 9, 500_000)])
def test_jaccard_join(spark, monkeypatch, block, rounds, rows):
    """In one task, and in clusters cut into blocks of a few documents, with few and many pivots."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard_join, "WALKERS", max(5, block // 100))
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", rows)
    docs = near_copies(60, 6)
    sets = sets_of(docs)
    want = components_expected(sets)
    got = jaccard_join.digest(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert len(got) == len(docs)
    for x in got:
        assert (x.n_shingles, x.component_id) == (len(sets[x.doc_id]), want[x.doc_id])


def test_jaccard_keeps_first_with_odd_columns(spark):
    docs = [(d, t, "x", 1) for d, t in near_copies(10, 3)] + [(None, prose(150, 7), "x", 2), (None, None, "x", 3)]
    df = spark.createDataFrame(docs, SCHEMA + ", gone string, cluster int")
    out = jaccard_join.keep_first(df)
    want = components_expected(sets_of([(d, t) for d, t, *_ in docs if d is not None]))
    assert out.columns == df.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect()) == sorted([(True, d) for d, *_ in docs if d is not None and want[d] == d] + [(False, 0)] * 2)


def test_jaccard_rows_of_one_id_are_one_document(spark):
    """Texts that share an id link what each of them links to."""
    a, b = prose(40, 51), prose(40, 52)
    rows = [(1, a), (2, b), (2, prose(40, 53)), (5, a), (5, b), (6, b + " x"), (7, prose(40, 54))]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 1), (7, 7)}


def test_jaccard_null_id_and_empty(spark):
    got = jaccard_join.digest(spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e")], SCHEMA)).collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(None, None), (1, 1)}
    assert jaccard_join.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_finds_all_links():
    r = np.random.default_rng(8)
    base = np.arange(40)
    sets = [np.unique(np.where(r.random(40) < 0.06, r.integers(100, 140, 40), base)) for _ in range(60)]
    known, place = jaccard_join.local_order(sets[:40])
    tree = jaccard_join.Tree([jaccard_join.ordered(s, known, place) for s in sets[:40]])
    for q in sets:
        want = [i for i, s in enumerate(sets[:40]) if 100 * len(set(q.tolist()) & set(s.tolist())) >= 85 * len(set(q.tolist()) | set(s.tolist()))]
        assert sorted(tree.walk(jaccard_join.ordered(q, known, place), lambda i, first: False)) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(20, 40)] + [(5, 3), (3, 9), (9, 9), (50, 40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(20, 41)}, 3: 3, 5: 3, 9: 3, 50: 20}


@pytest.mark.parametrize("percent", [51, 80, 85, 99])
def test_linked_sets_share_a_part(percent):
    """Sets of all sizes, as different as a link allows, in either direction."""
    r = np.random.default_rng(percent)
    for n in [*range(1, 140), 255, 256, 300, 1023, 1500]:
        for m in {n, n + 1, min(n + n // 20, n * 100 // percent), n * 100 // percent}:
            o = jaccard_join.needed(n, m, percent)
            if o <= n:  # else no sets of these sizes link
                x = r.choice(1 << jaccard_join.BITS, n + m - o, replace=False).astype(np.uint64) if n < 300 else np.unique(r.integers(0, 1 << jaccard_join.BITS, n + m - o).astype(np.uint64))
                r.shuffle(x)
                a, b = np.sort(x[:n]), np.sort(x[n - o :])
                shared = set(jaccard_join.part_hashes(a, percent).tolist()) & set(jaccard_join.part_hashes(b, percent).tolist())
                assert shared or (a.tolist() == b.tolist()), (n, m)


def passages(k, common):
    """k texts with a few words of their own and some of 20 common lines; every tenth has a near copy."""
    lines = [prose(7, 7000 + i) for i in range(20)]
    rows = [(i, " ".join([prose(12, 8000 + i).replace(" ", f"{i} "), *(lines[(i * 7 + j * (1 + i % 5)) % 20] for j in range(common))])) for i in range(k)]
    return rows + [(k + i, f"{rows[i][1]} end") for i in range(0, k, 10)]


def test_jaccard_shared_passages_make_no_large_cluster(spark, monkeypatch):
    """Short texts with common lines are not compared with all others that have some: what tasks get grows as the texts do."""
    got, within, across = [], jaccard_join._within, jaccard_join._across
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 20)
    monkeypatch.setattr(jaccard_join, "_within", lambda df, *a: got.append(df.count()) or within(df, *a))
    monkeypatch.setattr(jaccard_join, "_across", lambda df, *a: got.append(df.count()) or across(df, *a))
    for k in (150, 600):
        docs = passages(k, 2)
        want = components_expected(sets_of(docs))
        got.clear()
        assert {r.doc_id: r.component_id for r in jaccard_join.digest(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()} == want
        assert sum(d != c for d, c in want.items()) >= k // 12
        assert sum(got) <= len(docs), (k, got)


def test_jaccard_large_cluster_is_cut_by_prefixes(spark, monkeypatch):
    """Texts with a common quarter have equal parts, but rare shingles of their own: few are compared with others."""
    base = prose(90, 71)
    docs = [(i, f"{base} {' '.join(f'own{i}x{j}' for j in range(240))}") for i in range(200)] + [(300, f"{base} {' '.join(f'own7x{j}' for j in range(241))}")]
    seen, got, parted, across = [], [], jaccard_join._parted, jaccard_join._across
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 10)
    monkeypatch.setattr(jaccard_join, "_parted", lambda df, *a: seen.append(df.count()) or parted(df, *a))
    monkeypatch.setattr(jaccard_join, "_across", lambda df, *a: got.append(df.count()) or across(df, *a))
    found = {r.doc_id: r.component_id for r in jaccard_join.digest(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()}
    assert found == {**{i: i for i in range(200)}, 300: 7}
    assert sum(seen) > 40
    assert sum(got) <= 20
