"""Token-id output: ids of all documents one after another, document boundaries in Elias-Fano code.

A written table has one row for each block of whole documents. Its columns are block key (shard, block), the
counts, the concatenated token ids (16 bits each if the vocabulary allows, else 32), the boundaries, and the
documents' ids less the first: n non-decreasing numbers up to u take about n * (2 + log2(u / n)) bits, against 64 n
in a table of offsets. Every SAMPLE-th one of the upper bits is recorded, so that select needs to look at few bytes.
Reading asks select alone; nothing is unpacked.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir
from .encoding import encoder

END_ID = 0
#: Tokens from which a block is closed; a longer document makes a longer block.
BLOCK_TOKENS = 1 << 18
SAMPLE = 64
#: Rows of the block index that are sent to all executors; above, Spark joins it by its key.
INDEX_BROADCAST = 200_000

_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


# ---------------------------------------------------------------- Elias-Fano


def ef_encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(low bits each, packed low parts, unary upper parts, select samples) of non-decreasing numbers."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    if not n:
        return 0, b"", b"", b""
    low = max(0, int(int(v[-1]) // n).bit_length() - 1)
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    place = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(place[-1]) + 1, np.uint8)
    upper[place] = 1
    samples = place[::SAMPLE].astype("<u4")
    return low, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes(), samples.tobytes()


def ef_select(i: int, low: int, lows: bytes, upper: bytes, samples: bytes) -> int:
    """The i-th number: start at the sample before it, then count ones byte by byte."""
    at = int(np.frombuffer(samples, "<u4")[i // SAMPLE])
    need = i % SAMPLE
    byte = at >> 3
    word = upper[byte] & (0xFF << (at & 7)) & 0xFF
    while need >= (have := int(_ONES[word])):
        need -= have
        byte += 1
        word = upper[byte]
    for _ in range(need):
        word &= word - 1
    place = 8 * byte + (word & -word).bit_length() - 1
    first = i * low
    part = int.from_bytes(lows[first >> 3 : (first + low + 7) >> 3], "little") >> (first & 7)
    return ((place - i) << low) | (part & ((1 << low) - 1))


# ---------------------------------------------------------------- writing

_EF = "struct<low:int,lows:binary,upper:binary,samples:binary>"
SCHEMA = f"shard int, block long, n_docs long, n_nulls long, n_tokens long, first_doc long, docs {_EF}, width int, ids binary, ends {_EF}"


def _coded(values: np.ndarray) -> dict:
    return dict(zip(("low", "lows", "upper", "samples"), ef_encode(values)))


def _block(shard: int, number: int, docs: list, parts: list[np.ndarray], width: int) -> dict:
    """A block's row; documents come by ascending id, nulls first."""
    ends, known = np.cumsum([len(p) for p in parts]), np.array([d for d in docs if d is not None], np.int64)
    beyond = known.view(np.uint64) - known[:1].view(np.uint64)  # modulo 2 ** 64, so that negative ids do too
    ids = np.concatenate(parts).astype("<u2" if width == 16 else "<u4").tobytes()
    first = int(known[0]) if len(known) else None
    return {"shard": shard, "block": number, "n_docs": len(docs), "n_nulls": len(docs) - len(known), "n_tokens": int(ends[-1]), "first_doc": first, "docs": _coded(beyond), "width": width, "ids": ids, "ends": _coded(ends)}


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order and write the file at path.

    Null and empty texts have the end id alone. Null doc_ids come first. Rows that repeat a doc_id all stay.
    Documents are sorted by range of doc_id, so no task holds more than its range; a task holds one block.
    """

    def blocks(batches):
        from pyspark import TaskContext

        enc, shard, number, held, parts, size = encoder(tokenizer), TaskContext.get().partitionId(), 0, [], [], 0
        width = 16 if max(enc.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 32
        last = np.array([end_id], np.uint32)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([enc.encode(text.as_py()), last])
                held.append(doc)
                parts.append(ids)
                size += len(ids)
                if size >= block_tokens:
                    yield pa.RecordBatch.from_pylist([_block(shard, number, held, parts, width)], schema=_ARROW)
                    number, held, parts, size = number + 1, [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([_block(shard, number, held, parts, width)], schema=_ARROW)
        enc.release()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, SCHEMA).write.option("compression", "zstd").parquet(path)


_CODE = pa.struct([("low", pa.int32()), ("lows", pa.binary()), ("upper", pa.binary()), ("samples", pa.binary())])
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n_docs", pa.int64()), ("n_nulls", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("docs", _CODE), ("width", pa.int32()), ("ids", pa.binary()), ("ends", _CODE)])


# ---------------------------------------------------------------- reading


def read(spark: SparkSession, path: str) -> DataFrame:
    """The file's blocks with base, the number of ids in all blocks before; read with (shard, block) order."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    # Blocks are summed by shard, then shards in order: no window holds more than one shard's blocks
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.withColumn("shard_base", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.select("shard", "block", "n_tokens").withColumn("inner_base", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    index = index.join(before, "shard").select("shard", "block", (F.col("shard_base") + F.col("inner_base")).alias("base"))
    if blocks.count() <= INDEX_BROADCAST:
        index = F.broadcast(index)
    return blocks.join(index, ["shard", "block"])


def documents(blocks: DataFrame) -> DataFrame:
    """Each document of read()'s blocks: doc_id, start, n_tokens, ids_crc32, its places by select."""

    def parse(batches):
        for batch in batches:
            for r in batch.to_pylist():
                start, out = 0, []
                for i in range(r["n_docs"]):
                    ids = tokens_at(r, i, start)
                    out.append((doc_at(r, i), r["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(parse, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _selected(code: dict, i: int) -> int:
    return ef_select(i, code["low"], code["lows"], code["upper"], code["samples"])


def tokens_at(block: dict, i: int, start: int | None = None) -> np.ndarray:
    """The ids of a block's i-th document, by two selects, or by one from a known start."""
    if start is None:
        start = _selected(block["ends"], i - 1) if i else 0
    return np.frombuffer(block["ids"], "<u2" if block["width"] == 16 else "<u4")[start : _selected(block["ends"], i)]


def doc_at(block: dict, i: int) -> int | None:
    """The id of a block's i-th document."""
    return None if i < block["n_nulls"] else block["first_doc"] + _selected(block["docs"], i - block["n_nulls"])


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = f"{scratch_dir(docs.sparkSession)}/token-file-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return documents(read(docs.sparkSession, path))
