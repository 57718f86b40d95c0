"""Tools that share, imitate or talk about names of other servers."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.names import name_key
from auditloom.operators.ranking import least_members
from auditloom.relations import as_findings, finding
from auditloom.sources.storage import small_batches, stored

NAME = "shadowing"
#: Members of a group that a finding lists, the least ones.
LISTED = 100
#: Bytes (of UTF-8) of the grams that names and texts are joined on; shorter names are grams of their own length.
GRAM = 6
#: A bitmap of 2^27 bits (16 MB), two for each gram of a name, is sent to all tasks whatever the number of names.
GRAM_BITS, BLOCK_BITS = 27, 15
#: Bytes of text that one numpy pass works on (a longer text is a pass of its own).
PASS_BYTES = 1 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def name_collisions(tools: DataFrame) -> DataFrame:
    """(name, servers, n_servers, n_descriptions, severity) of names that several servers have; at most LISTED servers are listed (``collision_members`` has all)."""
    found = tools.groupBy("name").agg(F.countDistinct("server").alias("n_servers"), F.countDistinct("description").alias("n_descriptions")).where("n_servers >= 2")
    listed = least_members(tools, "name", "server", LISTED).withColumnRenamed("name", "_name")
    found = found.join(listed, F.col("name").eqNullSafe(F.col("_name")))
    return found.select("name", "servers", F.col("n_servers").cast("int").alias("n_servers"), "n_descriptions", F.when(F.col("n_descriptions") >= 2, "high").otherwise("medium").alias("severity"))


def collision_members(tools: DataFrame) -> DataFrame:
    """(name, server): every server of each name that several servers have."""
    pairs = tools.where("server is not null").select("name", "server").distinct()
    shared = pairs.groupBy("name").agg(F.min("server").alias("_first"), F.max("server").alias("_last")).where("_first <> _last").select(F.col("name").alias("_name"))
    return pairs.join(shared, F.col("name").eqNullSafe(F.col("_name")), "left_semi")


def near_duplicate_names(tools: DataFrame) -> DataFrame:
    """(key, names, servers) of names alike but for case and punctuation, on several servers; at most LISTED names and servers are listed."""
    keyed = tools.withColumn("key", name_key(F.col("name"))).select("key", "name", "server").distinct()
    ends = keyed.groupBy("key").agg(*(f(c).alias(f"_{f.__name__}_{c}") for c in ("name", "server") for f in (F.min, F.max)))
    found = ends.where("_min_name <> _max_name and _min_server <> _max_server").select("key")
    for member in ("name", "server"):
        listed = least_members(keyed, "key", member, LISTED).withColumnRenamed("key", "_key")
        found = found.join(listed, F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
    return found.select("key", "names", "servers")


def name_owners(tools: DataFrame) -> DataFrame:
    """(other, lowered, owner, shared) of each distinct name."""
    owners = tools.where("name <> ''").groupBy("name").agg(F.min("server").alias("owner"), F.max("server").alias("last")).where("owner is not null")
    return owners.select(F.col("name").alias("other"), F.lower("name").alias("lowered"), "owner", (F.col("owner") != F.col("last")).alias("shared"))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on."""
    found = np.full(max(0, len(data) - size + 1), size, dtype=np.uint64)
    for k in range(size):
        found = (found ^ data[k : k + len(found)]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found


def _among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64((1 << GRAM_BITS) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bitmap(index: DataFrame) -> np.ndarray:
    """The packed bits of the grams (column gram) of names; tasks make whole blocks of it."""
    mask = (1 << GRAM_BITS) - 1
    both = F.array(F.col("gram").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(mask)))
    places = index.select(F.explode(both).alias("bit")).distinct().withColumn("block", F.shiftright("bit", BLOCK_BITS)).repartition("block")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            bit, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(block):
                own = made.setdefault(int(b), np.zeros(1 << BLOCK_BITS, dtype=bool))
                own[bit[block == b] & ((1 << BLOCK_BITS) - 1)] = True
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), type=pa.int64()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in made.values()])], names=["block", "bits"])

    bits, size = np.zeros(1 << GRAM_BITS - 3, dtype=np.uint8), 1 << BLOCK_BITS - 3
    found = places.mapInArrow(blocks, "block long, bits binary").toArrow()
    for block, some in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        bits[block * size : (block + 1) * size] |= np.frombuffer(some, dtype=np.uint8)
    return bits


def _distinct_grams(text: pa.Array, sizes: Callable[[np.ndarray], list[tuple[int, np.ndarray]]], bits: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, hashes) of the distinct grams of texts; ``sizes``: from the lengths of rows to (size, rows that have such grams)."""
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64 if pa.types.is_large_string(text.type) else np.int32, count=text.offset + len(text) + 1)[text.offset :].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    begin = 0
    while begin < len(text):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PASS_BYTES, side="right")) - 1)
        own, length = data[offsets[begin] : offsets[end]], np.diff(offsets[begin : end + 1])
        row, starts = np.repeat(np.arange(len(length)), length), offsets[begin:end] - offsets[begin]
        for size, has in sizes(length):
            hashes = gram_hashes(own, size)
            place = np.arange(len(hashes))
            number = row[: len(hashes)]
            keep = has[number] & (place + size <= (starts + length)[number])
            if bits is not None:
                keep &= _among(bits, hashes) & _among(bits, hashes >> np.uint64(32))
            number, hashes = number[keep], hashes[keep]
            order = np.lexsort((hashes, number))
            number, hashes = number[order], hashes[order]
            new = np.r_[True, (number[1:] != number[:-1]) | (hashes[1:] != hashes[:-1])] if len(number) else np.zeros(0, dtype=bool)
            yield number[new] + begin, hashes[new].view(np.int64)
        begin = end


def _with_grams(rows: DataFrame, column: str, sizes, bits=None) -> DataFrame:
    """(server, name, gram) or, of names, (other, lowered, owner, shared, gram): a row for each distinct gram."""
    kept = [c for c in rows.columns if c != column or column == "lowered"]
    at = rows.columns.index(column)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, hashes in _distinct_grams(batch.column(at), sizes, bits.value if bits is not None else None):
                for a in range(0, len(number), 1 << 17):
                    some = pa.array(number[a : a + (1 << 17)])
                    columns = [batch.column(rows_names.index(c)).take(some) for c in kept]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(hashes[a : a + (1 << 17)])], names=[*kept, "gram"])

    rows_names = rows.columns
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return small_batches(rows).mapInArrow(find, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", gram long")


def _foreign(pairs: DataFrame, text, strict: bool) -> DataFrame:
    """Of pairs of a tool and a name those where the text has the name and another server owns it."""
    found = pairs.where(F.contains(text, F.col("lowered")) & (F.col("other") != F.col("name")) & (F.col("shared") | (F.col("owner") != F.col("server"))))
    if strict:
        found = found.where(F.regexp_count(text, F.concat(F.lit(r"(?<![a-z0-9_])\Q"), F.col("lowered"), F.lit(r"\E(?![a-z0-9_])"))) > 0)
    return found


def references_by_pairs(tools: DataFrame, strict: bool = False, dictionary: DataFrame | None = None) -> DataFrame:
    """``cross_references`` by every pair of a tool and a name: quadratic, for checks on small inputs."""
    pairs = tools.crossJoin(F.broadcast(name_owners(tools if dictionary is None else dictionary)))
    return _foreign(pairs, F.lower(F.coalesce("description", F.lit(""))), strict).groupBy("server", "name").agg(F.array_sort(F.collect_set("other")).alias("refs"))


def cross_references(tools: DataFrame, strict: bool = False, dictionary: DataFrame | None = None) -> DataFrame:
    """(server, name, refs): names of other servers' tools within a description, sorted.

    An inverted index: each name stands under the one of its grams that the fewest names have, each
    description under its distinct grams, and equal grams are joined; only the pairs that come of it
    are looked at in the text. A bitmap of fixed size keeps grams that no name has from the shuffle
    (the more names there are, the fewer it keeps away). ``strict`` wants the name to stand as a word of its own.
    ``dictionary``: tools whose names are looked for, if not those of ``tools`` themselves.
    """
    gram = GRAM
    owners = name_owners(tools if dictionary is None else dictionary)
    of_names = lambda length: [(n, np.minimum(length, gram) == n) for n in np.unique(np.minimum(length, gram)) if n]
    spelled = _with_grams(owners, "lowered", of_names)
    common = spelled.groupBy("gram").agg(F.count("*").alias("names"))
    rarest = spelled.join(common, "gram").groupBy("other", "lowered", "owner", "shared").agg(F.min_by("gram", F.struct("names", "gram")).alias("gram"))
    index = stored(rarest, "names")
    sizes = [r.n for r in index.select(F.least(F.octet_length("lowered"), F.lit(gram)).alias("n")).distinct().collect()]  # at most GRAM numbers
    texts = tools.select("server", "name", F.lower(F.coalesce("description", F.lit(""))).alias("text")).where("name is not null")
    of_texts = lambda length: [(n, length >= n) for n in sizes]
    found = _with_grams(texts, "text", of_texts, tools.sparkSession.sparkContext.broadcast(_bitmap(index))).join(index, "gram")
    # which names a tool may have; the text is looked at where the tool is
    likely = found.where((F.col("other") != F.col("name")) & (F.col("shared") | (F.col("owner") != F.col("server")))).drop("gram").distinct()
    likely = likely.select(F.col("server").alias("_server"), F.col("name").alias("_name"), "other", "lowered", "owner", "shared")
    pairs = texts.join(likely, (F.col("name") == F.col("_name")) & F.col("server").eqNullSafe(F.col("_server")))
    return _foreign(pairs, F.col("text"), strict).groupBy("server", "name").agg(F.array_sort(F.collect_set("other")).alias("refs"))


def shadowing(tools: DataFrame, strict: bool = False) -> DataFrame:
    same, near, refs = name_collisions(tools), near_duplicate_names(tools), cross_references(tools, strict)
    found = as_findings(same, finding(NAME, F.col("severity"), F.format_string("Tool name '%s' is offered by %d servers", "name", "n_servers"), F.col("servers")[0], F.col("name"), F.struct("servers")))
    found = found.unionByName(as_findings(near, finding(NAME, "medium", F.concat(F.lit("Nearly equal tool names: "), F.array_join("names", ", ")), F.col("servers")[0], evidence=F.struct("names", "servers"))))
    return found.unionByName(as_findings(refs, finding(NAME, "high", F.concat(F.lit("Description names tools of another server: "), F.col("name")), F.col("server"), F.col("name"), F.struct("refs"))))
