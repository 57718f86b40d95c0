"""Token-id files with fixed-width bit packing.

A file image holds consecutive documents. Every id takes the bits of the largest id of the
vocabulary. Sixty-four ids fill ``bits`` 64-bit words exactly, so packing and unpacking are 64
vector operations whatever the width, and a block of ids can be unpacked alone: its place
follows from the block offset table.

Layout (little-endian): header ``<8sIIQQQ`` (magic, bits, ids in a block, documents, ids,
blocks); doc ids int64 (null: the least int64, marked in a byte per document); null marks uint8;
document starts uint64, one more than documents; block offsets uint64, one more than blocks,
counted from the payload; payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._common import BATCH_BYTES, SLICE_BYTES, doc_columns, shared_path, slices, small_batches
from auditloom.llm.tokens import chunk_tokenizer

MAGIC = b"ALBITS01"
HEADER = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 4096
#: Ids after which a file image is closed (a longer document has an image of its own).
FILE_IDS = 1 << 20


def id_bits(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids as 64-bit words; the last group of 64 is filled up with zeros."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((64, groups), dtype=np.uint64)
    lanes.T.reshape(-1)[:] = 0
    padded = np.zeros(groups * 64, dtype=np.uint64)
    padded[: len(ids)] = ids
    lanes = padded.reshape(groups, 64)
    words = np.zeros((groups, bits), dtype="<u8")
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack_ids(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    words = words.reshape(-1, bits)
    ids = np.empty((len(words), 64), dtype="<u4")
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | words[:, word + 1] << np.uint64(64 - shift)
        ids[:, i] = lane & mask
    return ids.reshape(-1)[:n]


def file_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    if block_ids % 64:
        raise ValueError("block_ids has to be a multiple of 64")
    blocks = -(-len(ids) // block_ids)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    words = pack_ids(ids, bits)
    offsets = np.minimum(np.arange(blocks + 1, dtype="<u8") * np.uint64(block_ids // 64 * bits * 8), np.uint64(words.nbytes)).astype("<u8")
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    keys = np.array([-(1 << 63) if d is None else d for d in doc_ids], dtype="<i8")
    return b"".join([HEADER.pack(MAGIC, bits, block_ids, len(doc_ids), len(ids), blocks), keys.tobytes(), nulls.tobytes(), starts.tobytes(), offsets.tobytes(), words.tobytes()])


class TokenFile:
    """Reads a file image; ids come block by block, from any place."""

    def __init__(self, image: bytes):
        magic, self.bits, self.block_ids, self.n_docs, self.n_ids, self.n_blocks = HEADER.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token file of this format")
        at = HEADER.size
        parts = []
        for kind, n in (("<i8", self.n_docs), ("u1", self.n_docs), ("<u8", self.n_docs + 1), ("<u8", self.n_blocks + 1)):
            parts.append(np.frombuffer(image, dtype=kind, count=n, offset=at))
            at += parts[-1].nbytes
        keys, nulls, self.starts, self.offsets = parts
        self.doc_ids = [None if null else int(k) for k, null in zip(keys, nulls, strict=True)]
        self._payload = memoryview(image)[at:]

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from ``begin`` to ``end``, unpacking only the blocks that hold them."""
        end = self.n_ids if end is None else end
        first, last = begin // self.block_ids, -(-end // self.block_ids)
        if begin >= end:
            return np.zeros(0, dtype="<u4")
        words = np.frombuffer(self._payload[int(self.offsets[first]) : int(self.offsets[last])], dtype="<u8")
        got = unpack_ids(words, self.bits, len(words) // self.bits * 64)
        return got[begin - first * self.block_ids : end - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


FILES = "shard int, part int, ids_before long, n_docs long, n_ids long, image binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shards: int | None = None, file_ids: int = FILE_IDS, words: bool = True) -> None:
    """Encode whole documents and write their ids in ascending doc_id order to ``path``.

    ``path`` becomes a Parquet dataset with a file image in each row, so that Spark's committer
    makes it whole in any store even if executors are lost. The rows of a shard are a range of
    doc_id; shards follow each other in order (bounds: quantiles of doc_id). A null doc_id comes
    first; rows with the same doc_id come in the order of their ids. Null and empty texts consist
    of ``end_id``. The ids are encoded before the shuffle and travel at two or four bytes each.
    ``words``: the tokenizer file drops white space and lower-cases.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = doc_columns(docs, "doc_id", "text")
    shards = shards or min(4096, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = [i / shards for i in range(1, shards)]
    got = rows.agg(F.percentile_approx("doc_id", marks, 100 * shards).alias("q")).first().q if marks else None
    bounds = np.unique(np.asarray(got or [], dtype=np.int64))
    vocabulary = chunk_tokenizer(tokenizer_path).vocabulary
    bits, narrow = id_bits(max(vocabulary, end_id + 1)), "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = chunk_tokenizer(tokenizer_path, words).encode_array
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES if words else SLICE_BYTES):
                ids, starts = encode_all(part.column(1), end)
                at = (starts * np.dtype(narrow).itemsize).astype(np.int64)
                ids = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at), pa.py_buffer(ids.astype(narrow))]).cast(pa.binary())
                keys = part.column(0)
                shard = np.where(np.asarray(keys.is_null()), 0, np.searchsorted(bounds, np.asarray(keys.fill_null(0)), side="left"))
                yield pa.RecordBatch.from_arrays([pa.array(shard, type=pa.int32()), keys, ids], names=["shard", "doc_id", "ids"])

    def image_rows(shard, part, before, held):
        ids = np.concatenate([np.frombuffer(x, dtype=narrow) for _, x in held])
        image = file_image([d for d, _ in held], [len(x) // np.dtype(narrow).itemsize for _, x in held], ids, bits)
        values = [[shard], [part], [before], [len(held)], [len(ids)], [image]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return len(ids), pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(values, kinds, strict=True)], names=["shard", "part", "ids_before", "n_docs", "n_ids", "image"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, before, held, size = None, 0, 0, [], 0
        width = np.dtype(narrow).itemsize
        for batch in batches:
            for shard, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and (shard != now or size >= file_ids * width):
                    n, out = image_rows(now, part, before, held)
                    yield out
                    part, before, held, size = part + 1, before + n, [], 0
                if shard != now:
                    now, part, before = shard, 0, 0
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield image_rows(now, part, before, held)[1]

    encoded = rows.mapInArrow(encode, "shard int, doc_id long, ids binary")
    ordered = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(write, FILES).write.parquet(path)


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, width) of each document, read from the file images."""
    totals = {r.shard: r.n for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # one row for each shard
    base, at = {}, 0
    for shard in sorted(totals):
        base[shard] = at
        at += totals[shard]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, before = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                file = TokenFile(batch.column(2)[row].as_py())
                ids, starts = file.ids().tobytes(), file.starts.astype(np.int64)
                crc = [zlib.crc32(memoryview(ids)[4 * a : 4 * b]) for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, type=pa.int64()), pa.array(starts[:-1] + base[shard] + before), pa.array(np.diff(starts)), pa.array(crc, type=pa.int64()), pa.array([file.bits] * file.n_docs, type=pa.int32())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "bits"],
                )

    return files.select("shard", "ids_before", "image").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, bits int")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return what is read back from them.

    One row for each row of ``docs``; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(spark.read.schema(FILES).parquet(path))
