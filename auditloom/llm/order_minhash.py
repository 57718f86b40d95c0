"""Order MinHash fingerprints: sketches of whole texts that follow edit distance.

Each k-mer of code points is paired with its occurrence number, so repeated k-mers count as
often as they occur. For each of ``sketches`` hash functions the ``length`` pairs of least hash
are taken, put back into text order, and their k-mers hashed as a tuple. Two texts agree in a
sketch when they share both the selected k-mers and their order, hence the likeness falls with
edits and with rearrangements, unlike that of plain MinHash.

Neighbours in doc_id order are found by one range shuffle of the texts: each range is sorted and
streamed, and the first documents of a range are also sent to the range before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._common import doc_columns, mixed, small_batches

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Hash values that one numpy pass works on.
PASS_VALUES = 1 << 20
LEAST = -(1 << 63)


class OrderMinHash:
    """Signatures of ``sketches`` 16-bit values from tuples of ``length`` k-mers of ``k`` code points."""

    def __init__(self, k: int = 6, length: int = 2, sketches: int = 64, seed: int = 20_19):
        random = np.random.default_rng(seed)
        self.k, self.length, self.sketches = k, length, sketches
        self.powers = random.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.multipliers = random.integers(0, 1 << 63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def kmers(self, text: str) -> np.ndarray:
        """Hashes of all k-mers; a text of under k code points is one k-mer."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        n = max(1, len(points) - self.k + 1)
        hashes = np.full(n, len(points) < self.k, dtype=np.uint64)
        for j, p in enumerate(self.powers[: len(points)]):
            hashes += points[j : j + n] * p
        return mixed(hashes)

    def signature(self, text: str) -> np.ndarray:
        kmers = self.kmers(text)
        n = len(kmers)
        order = np.argsort(kmers, kind="stable")
        ordered = kmers[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        occurrence = np.empty(n, dtype=np.uint64)
        occurrence[order] = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        pairs = mixed(kmers + (occurrence + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        take = min(self.length, n)
        found = np.empty((self.sketches, take), dtype=np.int64)
        step = max(1, PASS_VALUES // n)
        for begin in range(0, self.sketches, step):
            hashes = pairs[None, :] * self.multipliers[begin : begin + step, None]
            rows = np.arange(len(hashes))
            for t in range(take):
                at = hashes.argmin(axis=1)
                found[begin : begin + step, t] = at
                hashes[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        found.sort(axis=1)
        sketch = self.multipliers.copy()
        for t in range(take):
            sketch = mixed(sketch * np.uint64(31) + kmers[found[:, t]])
        return (sketch >> np.uint64(48)).astype(">u2")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _shard_of(key, bounds: list[int]):
    """The number of bounds below ``key``, by binary search in an array literal."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    marks = F.array(*(F.lit(b) for b in bounds))

    def probe(at, i):
        to = at + F.pow(F.lit(2), F.lit(steps) - i).cast("int")
        return F.when((to <= len(bounds)) & (F.get(marks, to - 1) < key), to).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), probe)


def fingerprints(docs: DataFrame, shards: int | None = None, method: OrderMinHash | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The next document is the one after it in descending doc_id; null doc_ids come last, equal
    ones in the order of their texts, and the first document follows the last one (with a single
    document, itself). Null texts count as empty; the empty text has a fingerprint of its own.
    Repeated rows each get a row; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    method = method or OrderMinHash()
    shards = shards or min(4096, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = doc_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LEAST)).alias("key"))
    marks = [i / shards for i in range(1, shards)]
    got = rows.agg(F.percentile_approx("key", marks, 100 * shards).alias("q")).first().q if marks else None
    bounds = sorted(set(got or []))
    rows = rows.withColumn("shard", _shard_of(F.col("key"), bounds))
    tops = {r.shard: r.top for r in rows.groupBy("shard").agg(F.max("key").alias("top")).collect()}  # a row for each shard
    there = sorted(tops)
    before = dict(zip(there, [*there[1:], *there[:1]], strict=True))  # first documents also go to the range above, those of the top to the lowest
    top = F.array(*(F.lit(tops.get(s, LEAST)) for s in range(len(bounds) + 1)))
    goes = F.array(*(F.lit(before.get(s, 0)) for s in range(len(bounds) + 1)))
    place = lambda shard, extra: F.struct(shard.cast("int").alias("part"), F.lit(extra).alias("extra"))
    own, more = place(F.col("shard"), 0), place(F.get(goes, F.col("shard")), 1)
    placed = rows.select("doc_id", "text", "key", F.explode(F.when(F.col("key") == F.get(top, F.col("shard")), F.array(own, more)).otherwise(F.array(own))).alias("to"))
    dealt = placed.repartitionById(len(bounds) + 1, F.col("to.part")).sortWithinPartitions("to.extra", F.col("key").desc(), "text")

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last own document: (doc_id, text, signature)
        for batch in batches:
            out = []
            for doc, text, extra in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if extra and held is None:
                    continue
                signature = method.signature(text)
                if held is not None:
                    out.append(_row(method, *held, text, signature))
                held = None if extra else (doc, text, signature)
            if out:
                yield _batch(out)

    return dealt.select("doc_id", "text", F.col("to.extra").alias("extra")).mapInArrow(sketch, SCHEMA)


def _row(method: OrderMinHash, doc: int | None, text: str, signature: np.ndarray, following: str, next_signature: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    changed = method.signature(edited) if edited != text else signature
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, signature.tobytes().hex(), changed.tobytes().hex(), float((signature == changed).mean()), float((signature == next_signature).mean())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
