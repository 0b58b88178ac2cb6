"""Shared helpers: scratch tables in the cluster's shared folder and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.sources.files import run_folder, scratch_dir

#: Bytes of text that one vectorised step handles at a time.
BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and return the reread table; lineage ends there."""
    return _written(df, f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


def save_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """save(make(), label); whatever tables make() saved on the way go when its result is written."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with run_folder(spark):
        return _written(make(), path)


def drop(*tables: DataFrame) -> None:
    """Empty tables made by save() that no later plan reads: an overwrite deletes their files."""
    for df in tables:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(df._scratch_path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f and its lambdas read it."""
    return F.get(F.transform(F.array(value), f), 0)


def as_bytes(text) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


# ---------------------------------------------------------------- word hashing

_rng = np.random.default_rng(20240613)
_BYTE = _rng.integers(1, 2**63 - 1, 256).astype(np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """Powers of the step, or of its inverse; those of a block are kept, those of a longer word are not."""
    made = _powers.get(which)
    if made is None or len(made) < n:
        base = np.full(max(n, BLOCK + 4096), _STEP if which == "up" else _STEP_INV, dtype=np.uint64)
        base[0] = 1
        made = np.cumprod(base)
        if n <= BLOCK + 4096:
            _powers[which] = made
    return made[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _block_words(b: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[b] * _power("up", len(b)))))
    return starts + at, ends + at, scramble((total[ends] - total[starts]) * _power("down", len(b))[starts])


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and 64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of a UTF-8 text, in blocks cut between words."""
    b = np.frombuffer(raw, dtype=np.uint8)
    parts, at = [], 0
    while at < len(b):
        end = min(at + BLOCK, len(b))
        if end < len(b):
            gap = np.flatnonzero(_SPACE[b[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:  # one word longer than a block
                rest = np.flatnonzero(_SPACE[b[end:]])
                end = end + int(rest[0]) if len(rest) else len(b)
        parts.append(_block_words(b[at:end], at))
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def chunks(texts: list, limit: int = BLOCK):
    """Groups of whole texts of about `limit` bytes: yields (index of the first, their UTF-8 forms)."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = as_bytes(text)
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def chunk_words(raws: list[bytes]):
    """Words of several texts in one pass: joined bytes, starts, ends, hashes, and each text's first word and first byte (one more entry at the end)."""
    joined = b"\n".join(raws)
    starts, ends, hashes = words_of(joined)
    at = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raws], out=at[1:])
    return joined, starts, ends, hashes, np.searchsorted(starts, at), at


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from their word hashes; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, at, width, power = None, 0, 1, h
    while k:
        if k & 1:
            part = power[at : at + n]
            done = scramble(part + np.uint64(width)) if done is None else scramble(done * _STEP + part + np.uint64(width))
            at += width
        k >>= 1
        if k:
            power = scramble(power[:-width] * _STEP_INV + power[width:]) if len(power) > width else power[:0]
            width *= 2
    return done


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
