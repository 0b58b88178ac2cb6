"""Token files and packing: exact round trips against the library."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexora.llm import encoding, packing, token_file

from .util import SCHEMA, odd_rows

TEXTS = ["a  b\n\n c \t d\n", "don't I'LL\n 1234 foo!!", "<|endoftext|> hi", "\xa0 x", "ÉÈ ß İstanbul", "á b", "½ ² ª", "日本語", " \n a", "x\r\ny"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name):
    path = encoding.tokenizer_path(name)
    whole, own = Tokenizer.from_file(path), encoding.Encoder(path)
    for t in TEXTS + [r[1] for r in odd_rows()]:
        assert own.encode(t).tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBER", 5)
    path = encoding.tokenizer_path("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), encoding.Encoder(path)
    monkeypatch.setattr(encoding, "LONG", 7)
    for t in TEXTS * 2 + ["some words of a longer text 123  and\n\n more, it's so"]:
        assert own.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, u in ((1, 5), (10, 1000), (1000, 10**6), (500, 300), (77, 0)):
        v = np.sort(r.integers(0, u + 1, n))
        low, lows, upper, samples = token_file.ef_encode(v)
        assert [token_file.ef_select(i, low, lows, upper, samples) for i in range(n)] == v.tolist()
        assert len(lows) + len(upper) + len(samples) <= n * (3 + max(0, np.log2(max(u, 1) / n))) / 8 + n / 16 + 16


def test_token_file(spark, tmp_path, monkeypatch):
    rows = [r for r in odd_rows() if r[0] is not None]
    path = encoding.tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    token_file.write(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "f"), path, block_tokens=500)
    blocks = token_file.read(spark, str(tmp_path / "f"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_file.documents(blocks).collect())
    at = 0
    assert len(got) == len(rows)
    for (d, t), g in zip(sorted(rows, key=lambda r: r[0]), got):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert g == (at, d, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    b = blocks.orderBy("base").first().asDict(True)
    assert token_file.tokens_at(b, 0).tolist() == whole.encode(sorted(rows)[0][1], add_special_tokens=False).ids + [0]


def test_token_file_nulls_and_empty(spark):
    path = encoding.tokenizer_path("byte_bpe_50k.json")
    odd = [(None, "a"), (None, None), (-(2**63), "b"), (-5, ""), (1, None), (1, "c"), (2**63 - 1, "d")]
    got = token_file.digest(spark.createDataFrame(odd, SCHEMA), path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(2**63), -5, 1, 1, 2**63 - 1] and sorted(r.n_tokens for r in got) == [1, 1, 1, 2, 2, 2, 2]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    assert token_file.digest(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_packing(spark):
    rows = odd_rows()
    path = encoding.tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(100 + i, "word " * (i * 37 % 900)) for i in range(60)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4), path).toPandas()
    for d, t in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = got[got.doc_id == d].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096
    assert got.sequence_id.nunique() == got.sequence_id.max() + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_packing_keeps_rests_whole_and_sequences_full(spark):
    """Many rests of mixed lengths: most are placed whole by the plan, hardly a token is padding, and every id is in one piece."""
    r = np.random.default_rng(5)
    path = encoding.tokenizer_path("word_bpe_49k.json")
    rows = [(i, "word " * int(n)) for i, n in enumerate(r.gamma(1.5, 350, 3000))] + [(7, "again"), (None, "no id"), (None, None), (5000, "long " * 20_000)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4), path)
    assert (line := packing.padding(got).first()).padding < 0.01 * line.tokens
    pdf = got.toPandas()
    whole = Tokenizer.from_file(path)
    assert pdf.length.sum() == line.tokens == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    for _, own in pdf.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096
    assert pdf.sequence_id.nunique() == pdf.sequence_id.max() + 1
    pieces = pdf[pdf.doc_id.notna() & (pdf.doc_id < 3000) & (pdf.doc_id != 7) & (pdf.doc_tokens < 4096)].groupby("doc_id").size()
    assert (pieces == 1).mean() > 0.9


def test_plan_gives_each_rest_one_place():
    r = np.random.default_rng(1)
    pieces = r.integers(0, 300, packing.UNITS + 1)
    pieces[0] = 0
    slots, used, after = packing.plan(pieces, pieces * np.arange(packing.UNITS + 1) * packing.UNIT - pieces * 20, 3)
    ranks, filled = {}, {}
    for size, lo, hi, first, slot in slots:
        for k in range(lo, hi):
            assert (size, k) not in ranks
            ranks[size, k] = True
            filled[first + k - lo] = filled.get(first + k - lo, 0) + size
    assert set(filled) == set(range(3, after)) and set(filled.values()) == {packing.UNITS}
    assert all(used[u] == sum(s == u for s, _ in ranks) <= pieces[u] for u in range(1, packing.UNITS + 1))
    assert used.sum() > 0.8 * pieces.sum()


def test_nnls():
    r = np.random.default_rng(2)
    a, x = r.random((30, 12)), np.maximum(0, r.normal(size=12))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    assert (packing.nnls(a, -np.ones(30)) == 0).all()
