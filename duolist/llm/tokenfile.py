"""Token-id files in bit planes.

A file holds one shard: blocks of a fixed number of ids, each transposed into byte or bit planes that are compressed one by one
with zstandard; then the table of its documents and the index of its blocks and planes; then a trailer of fixed size that says
where those begin. Shards are written and read by Spark, so they can lie in any store that Spark reaches, and a lost executor's
files never become part of the output.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duolist.llm.common import Batches, id_and_text, materialise, record, texts
from duolist.llm.tokens import encode_all

END_ID = 2
BLOCK_IDS = 65_536
SHARD_IDS = 1 << 22
LEVEL = 3
MAGIC = b"DLPLANE1"
#: part, number within the part, documents, ids, ids a block, first byte of the document table, of the index, whether bit planes
_TRAILER = struct.Struct("<8Q8s")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte or bit planes of a block of ids, lowest first, without planes above the highest that is used."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if not bits:
        return [raw[:, i].tobytes() for i in range((top + 7) // 8)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, i], bitorder="little").tobytes() for i in range(top)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The n ids of a block."""
    if not bits:
        raw = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(planes):
            raw[:, i] = np.frombuffer(p, np.uint8)
    else:
        each = np.zeros((n, 32), np.uint8)
        for i, p in enumerate(planes):
            each[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n]
        raw = np.packbits(each, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def write_shard(part: int, number: int, doc_ids: list[int | None], ids: list[np.ndarray], bits: bool = False, block: int = BLOCK_IDS) -> bytes:
    """The bytes of one shard."""
    pack, out, at = zstandard.ZstdCompressor(level=LEVEL), [], 0
    index: list[int] = []
    stream = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    for i in range(0, len(stream), block):
        planes = [pack.compress(p) for p in to_planes(stream[i : i + block], bits)]
        index.append(len(planes))
        for p in planes:
            index += (at, len(p))
            at += len(p)
        out += planes
    table = b"".join((np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(x) for x in ids], "<i8").tobytes()))
    table, listed = pack.compress(table), pack.compress(np.array(index, "<u8").tobytes())
    return b"".join((*out, table, listed, _TRAILER.pack(part, number, len(doc_ids), len(stream), block, at, at + len(table), bits, MAGIC)))


def read_shard(content: bytes) -> tuple[int, int, list[int | None], list[np.ndarray]]:
    """(part, number, document ids, ids of each document) of the bytes of a shard; what follows the trailer is ignored."""
    end = content.rindex(MAGIC) + len(MAGIC)
    part, number, n_docs, n_ids, block, table_at, index_at, bits, _ = _TRAILER.unpack(content[end - _TRAILER.size : end])
    unpack = zstandard.ZstdDecompressor()
    table = unpack.decompress(content[table_at:index_at]) if n_docs else b""
    there = np.frombuffer(table, np.uint8, n_docs)
    doc_ids, lengths = np.frombuffer(table, "<i8", 2 * n_docs, n_docs).reshape(2, -1)
    index, parts, at = np.frombuffer(unpack.decompress(content[index_at : end - _TRAILER.size]), "<u8").tolist() if n_ids else [], [], 0
    for i in range(0, n_ids, block):
        planes, n = [], index[at]
        for k in range(n):
            start, size = index[at + 1 + 2 * k : at + 3 + 2 * k]
            planes.append(unpack.decompress(content[start : start + size]))
        at += 1 + 2 * n
        parts.append(from_planes(planes, min(block, n_ids - i), bool(bits)))
    stream = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    return part, number, [int(d) if t else None for d, t in zip(doc_ids, there, strict=True)], np.split(stream, np.cumsum(lengths)[:-1]) if n_docs else []


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary: str | None = None, bits: bool = False, shard_ids: int = SHARD_IDS, block: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each followed by end_id, in ascending doc_id order.

    Nulls come first, rows that share a doc_id in the order of a hash of their text. One doc_id, or one text, may have any share
    of the rows: ranges are cut within both, and rows that agree in both go in any order.
    """

    def run(batches: Batches) -> Batches:
        part, number, held, names, n = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for doc_id, tokens in zip(doc_ids, encode_all(texts(batch.column(1)), vocabulary), strict=True):
                names.append(doc_id)
                held.append(np.append(tokens, np.uint32(end_id)))
                n += len(held[-1])
                if n >= shard_ids:
                    yield record(content=[write_shard(part, number, names, held, bits, block)])
                    number, held, names, n = number + 1, [], [], 0
        if names:
            yield record(content=[write_shard(part, number, names, held, bits, block)])

    rows = id_and_text(docs, id_col, text_col).withColumns({"hash": F.xxhash64("text"), "turn": F.xxhash64(F.monotonically_increasing_id())})
    shards = rows.repartitionByRange("doc_id", "hash", "turn").sortWithinPartitions("doc_id", "hash", "turn").select("doc_id", "text").mapInArrow(run, "content binary")
    # one record a file; the text writer only adds a line end behind it
    shards.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """(part, number, pos, doc_id, n_tokens, ids), or ids_crc32 in place of ids, of every document in the files below path."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for value in batch.column(0):
                if not (content := value.as_py()):
                    continue  # an empty table's file
                part, number, doc_ids, ids = read_shard(content)
                n = len(doc_ids)
                last = {"ids_crc32": pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids], pa.int64())} if digests else {"ids": pa.array(ids, pa.list_(pa.int64()))}
                yield record(part=np.full(n, part), number=np.full(n, number), pos=np.arange(n), doc_id=pa.array(doc_ids, pa.int64()), n_tokens=pa.array([len(x) for x in ids], pa.int64()), **last)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "part long, number long, pos long, doc_id long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>"))


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before this one, in file order."""
    rows = materialise(rows, "token-rows")
    shards = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))  # one row per shard of millions of ids
    base = shards.select("part", "number", (F.sum("n").over(Window.orderBy("part", "number")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part", "number").orderBy("pos")) - F.col("n_tokens")
    return rows.join(base, ["part", "number"]).withColumn("start", F.col("base") + within)


def round_trip(docs: DataFrame, path: str, **options: object) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from files written below path.

    Null and empty texts are the end id alone; null doc_ids come first; repeated rows are written as often as they come; other
    columns are not read; an empty table gives an empty table.
    """
    write_tokens(docs, path, **options)
    return with_starts(read_tokens(docs.sparkSession, path, digests=True)).select("doc_id", "start", "n_tokens", "ids_crc32")
