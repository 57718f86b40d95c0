"""N-gram Jaccard join: linked groups of documents by blocked products of their incidence matrix.

The rows of the matrix are the classes of documents with the same set of word shingles, its
columns the shingles. The product of the matrix with its transpose counts the shingles that two
classes share; two classes link when that count reaches what the similarity asks for.

1. Columns are ranked from rare to frequent (the frequent ones by their counts over all rows, the
   rest by hash). A linked pair shares one of the first n - ceil(t n) + 1 columns of both, so the
   candidate product needs that part of each row alone.
2. It is computed in blocks of columns. A pair is discarded where the sizes, or the columns that
   are left in both rows after the shared one, cannot reach the overlap asked for.
3. In a column with many rows, the row that holds it earliest leads: it is paired with all others
   first. Pairs of others count only where their links left them in different groups, so a large
   group of copies costs as many pairs as it has members. The rows of a column that is known
   to have very many are dealt over several tasks; each part has a leader, and these are led too.
   Second looks are taken only at columns whose rows are in different groups, in parts as well.
4. A pair is discarded where the parity bitmaps of its rows (a bit or two for each shingle) differ
   in more bits than the symmetric difference of linked sets of these sizes may have items.
5. Overlaps of the pairs that are left are counted over whole rows, each led row beside its leader.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm._common import doc_columns, mixed, slices, small_batches, stored, utf8
from auditloom.llm.components import components

WORDS = 5
#: Similarity in hundredths: linked when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Most columns whose frequency is told apart: the broadcast table has at most so many rows.
FREQUENT_COLUMNS = 1 << 18
#: Columns counted together by a task, and the least count within them that is reported.
COUNT_WINDOW, COUNT_LEAST = 1 << 22, 3
#: Entries of the incidence matrix that a block of columns should hold.
BLOCK_ENTRIES = 1 << 21
#: Entries that a task gathers before it sends them to their blocks.
SEND_ENTRIES = 1 << 20
#: Rows above which a column is led.
LED_ROWS = 8
#: Rows of one column that a task should hold, above that they are dealt over several.
PART_ROWS = 1 << 12
#: Led rows that are verified in one task.
LED_PER_TASK = 512
#: Rows of wanted sets up to which they are broadcast to the documents instead of joined by a shuffle.
BROADCAST_ROWS = 50_000

_random = np.random.default_rng(1974)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the documents in them) from UTF-8 bytes."""
    blank = _BLANK[data]
    opens = ~blank
    opens[1:] &= blank[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[first] = ~blank[first]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))))
    place = np.arange(starts[0], len(data)) - starts[number]
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, _STEP, dtype=np.uint64))
    values = _BYTE[data[starts[0] :]] * powers[place]
    values[blank[starts[0] :]] = 0
    return mixed(np.add.reduceat(values, starts - starts[0])), np.searchsorted(starts, offsets)


def shingle_sets(text: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document (null and empty: none)."""
    data, offsets = utf8(text)
    hashes, at = word_hashes(data, offsets)
    n = max(0, len(hashes) - words + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        grams += hashes[k : k + n] * _PLACE[k]
    grams = mixed(grams)
    found = []
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= words:
            found.append(np.unique(grams[a : b - words + 1]))
        elif b > a:  # a short document is one shingle, told from others by its length
            found.append(mixed((hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found


def class_id(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a shingle set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: np.ndarray, m: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """The least intersection of sets of n and m items that links them."""
    return -(-similarity * (n + m) // (100 + similarity))


def prefix_length(n: int, similarity: int = SIMILARITY) -> int:
    return n - -(-similarity * n // 100) + 1


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bitmap whose bits are the parities of the shingles that fall on them; 8 bits at least."""
    size = 1 << max(3, int(len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles >> np.uint64(8)).astype(np.int64) % size, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Items that are in one of two sets only, at least: the bits in which their bitmaps differ."""
    a, b = (np.frombuffer(z, dtype=np.uint8) for z in ((x, y) if len(x) <= len(y) else (y, x)))
    while len(b) > len(a):  # a bit of the half-sized bitmap is the parity of two bits
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


# ---------------------------------------------------------------- rows and frequent columns


def _count_rows(docs: DataFrame, words: int) -> DataFrame:
    """For each document (doc_id, n, id, bits), and for each window of a task the columns seen often in it (column, seen)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column(1), words)
                yield _typed(doc_id=(part.column(0), pa.int64()), n=([len(s) for s in sets], pa.int32()), id=([class_id(s) for s in sets], pa.int64()), bits=([parity_bits(s) if len(s) else None for s in sets], pa.binary()), column=([None] * len(sets), pa.int64()), seen=([None] * len(sets), pa.int64()))
                window += sets
                size += sum(map(len, sets))
                if size >= COUNT_WINDOW:
                    yield often(window)
                    window, size = [], 0
        if window:
            yield often(window)

    def often(window):
        columns, seen = np.unique(np.concatenate(window), return_counts=True)
        keep = seen >= COUNT_LEAST
        columns, seen = columns[keep].view(np.int64), seen[keep]
        nothing = [None] * len(columns)
        return _typed(doc_id=(nothing, pa.int64()), n=(nothing, pa.int32()), id=(nothing, pa.int64()), bits=(nothing, pa.binary()), column=(columns, pa.int64()), seen=(seen, pa.int64()))

    return docs.mapInArrow(count, "doc_id long, n int, id long, bits binary, column long, seen long")


def _typed(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in columns.values()], names=list(columns))


class ColumnOrder:
    """Ranks columns: those not known to be frequent first (by hash), then by rising count."""

    def __init__(self, columns: np.ndarray, counts: np.ndarray):
        order = np.argsort(columns)
        self.columns, self.counts = columns[order], counts[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(columns >> np.uint64(42)).astype(np.int64)] = True

    def seen(self, shingles: np.ndarray) -> np.ndarray:
        """The count of each shingle, 0 for those not known to be frequent."""
        count = np.zeros(len(shingles), dtype=np.int64)
        some = np.flatnonzero(self.maybe[(shingles >> np.uint64(42)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.columns, shingles[some]), len(self.columns) - 1)
            known = self.columns[at] == shingles[some]
            count[some[known]] = self.counts[at[known]]
        return count

    def first(self, shingles: np.ndarray, length: int) -> np.ndarray:
        """The ``length`` first of a sorted set of shingles."""
        return shingles[np.argsort(self.seen(shingles), kind="stable")[:length]]


# ---------------------------------------------------------------- blocks of columns

_BLOCK = "block int, home int, ids binary, sizes binary, columns binary, rows binary, places binary"


def _send_blocks(docs: DataFrame, order, blocks: int, words: int, part_rows: int) -> DataFrame:
    """The prefix of every class, cut into blocks of columns; a task sends each class once.

    A column of more than ``part_rows`` rows is dealt over blocks by its rows; ``home`` is then the
    block that names the column (else -1).
    """

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for shingles in shingle_sets(part.column(1), words):
                    key = class_id(shingles)
                    if len(shingles) and key not in seen:
                        seen.add(key)
                        held.append((key, len(shingles), order.value.first(shingles, prefix_length(len(shingles)))))
                        size += len(held[-1][2])
                if size >= SEND_ENTRIES or len(held) >= 1 << 16:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        ids = np.array([k for k, _, _ in held], dtype=np.int64)
        sizes = np.array([n for _, n, _ in held], dtype=np.int32)
        lengths = [len(p) for _, _, p in held]
        columns = np.concatenate([p for _, _, p in held])
        rows = np.repeat(np.arange(len(held)), lengths)
        places = np.arange(len(columns)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        block = (columns % np.uint64(blocks)).astype(np.int64)
        home = np.full(len(columns), -1, dtype=np.int64)
        seen = order.value.seen(columns)
        dealt = np.flatnonzero(seen > part_rows)
        home[dealt] = block[dealt]
        part = ids[rows[dealt]].view(np.uint64) % (-(-seen[dealt] // part_rows)).astype(np.uint64)
        block[dealt] = (mixed(columns[dealt] + part * _STEP) % np.uint64(blocks)).astype(np.int64)
        by = np.lexsort((home, block))
        cuts = np.flatnonzero(np.r_[True, (block[by][1:] != block[by][:-1]) | (home[by][1:] != home[by][:-1]), True])
        for s, e in zip(cuts, cuts[1:], strict=False):
            own = by[s:e]
            used, local = np.unique(rows[own], return_inverse=True)
            fields = [ids[used], sizes[used], (columns[own] >> np.uint64(32)).astype(np.uint32), local.astype(np.uint32), np.minimum(places[own], 65535).astype(np.uint16)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[own[0]]], type=pa.int32()) for x in (block, home)), *(pa.array([f.tobytes()], type=pa.binary()) for f in fields)], names=[x.split()[0] for x in _BLOCK.split(", ")])

    return docs.mapInArrow(send, _BLOCK)


def _read_block(batches: Iterable[pa.RecordBatch]) -> list[np.ndarray]:
    """columns, ids, sizes, places and homes of the entries of a block, one for each column and class."""
    kinds = (np.int64, np.int32, np.uint32, np.uint32, np.uint16)
    parts = []
    for batch in batches:
        for r in range(batch.num_rows):
            ids, sizes, columns, rows, places = (np.frombuffer(batch.column(c + 2)[r].as_buffer(), dtype=k) for c, k in enumerate(kinds))
            parts.append((columns, ids[rows], sizes[rows], places, np.full(len(rows), batch.column(1)[r].as_py(), dtype=np.int32)))
    if not parts:
        return [np.zeros(0, dtype=np.int64)] * 5
    columns, ids, sizes, places, homes = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, columns, homes))
    columns, ids, sizes, places, homes = columns[order], ids[order], sizes[order], places[order], homes[order]
    new = np.r_[True, (columns[1:] != columns[:-1]) | (ids[1:] != ids[:-1]) | (homes[1:] != homes[:-1])]  # a class of several tasks comes once
    return [columns[new], ids[new], sizes[new].astype(np.int64), places[new].astype(np.int64), homes[new].astype(np.int64)]


def _reach(n, m, p, q) -> np.ndarray:
    """Whether sets of n and m items whose first shared column is at places p and q can link."""
    small, large = np.minimum(n, m), np.maximum(n, m)
    return (100 * small >= SIMILARITY * large) & (np.minimum(n - p, m - q) >= least_overlap(n, m))


def _pairs_within(starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of all pairs within the given runs, run lengths taken together."""
    for k in np.unique(counts):
        i, j = np.triu_indices(k, 1)
        at = starts[counts == k]
        step = max(1, (1 << 20) // max(1, len(i)))
        for a in range(0, len(at), step):
            yield (at[a : a + step, None] + i).reshape(-1), (at[a : a + step, None] + j).reshape(-1)


def _block_product(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a leads b), and the entries of led and dealt columns (column, id, n, place; lead: 1 for the leader)."""
    columns, ids, sizes, places, homes = _read_block(batches)
    starts = np.flatnonzero(np.r_[True, (columns[1:] != columns[:-1]) | (homes[1:] != homes[:-1])]) if len(columns) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.r_[starts, len(columns)])
    kept = (counts > LED_ROWS) | (homes[starts] >= 0)
    leads = np.zeros(len(columns), dtype=np.int64)
    found = [np.zeros((0, 2), dtype=np.int64)]
    few = (counts > 1) & (counts <= LED_ROWS)
    for i, j in _pairs_within(starts[few], counts[few]):
        ok = _reach(sizes[i], sizes[j], places[i], places[j])
        found.append(np.stack([ids[i[ok]], ids[j[ok]]], axis=1))
    for s, k in zip(starts[kept], counts[kept], strict=True):
        rows = slice(s, s + k)
        leader = s + int(np.lexsort((ids[rows], places[rows] / sizes[rows]))[0])
        leads[leader] = 1
        if k <= LED_ROWS:  # all pairs are there
            continue
        ok = _reach(sizes[rows], sizes[leader], places[rows], places[leader]) & (ids[rows] != ids[leader])
        found.append(np.stack([np.full(int(ok.sum()), ids[leader]), ids[rows][ok]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0) if len(found) > 1 else found[0]
    for a in range(0, len(pairs), 1 << 16):
        some = pairs[a : a + (1 << 16)]
        yield _entry(a=some[:, 0], b=some[:, 1])
    where = np.flatnonzero(np.repeat(kept, counts))
    for a in range(0, len(where), 1 << 16):
        w = where[a : a + (1 << 16)]
        yield _entry(column=columns[w].astype(np.int64), id=ids[w], n=sizes[w], place=places[w], home=homes[w], lead=leads[w])


_ENTRY = ("a", "b", "column", "id", "n", "place", "home", "lead")


def _entry(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], type=pa.int64()) if c in columns else pa.nulls(size, pa.int64()) for c in _ENTRY], names=list(_ENTRY))


def _leader_pairs(made: DataFrame) -> DataFrame:
    """(a, b): the leaders of the parts of a dealt column, led by the earliest of them."""
    leaders = made.where("home >= 0 and lead = 1").select("block", "column", "id", "n", "place")
    first = leaders.groupBy("block", "column").agg(F.min_by(F.struct("id", "n", "place"), F.struct(F.col("place") / F.col("n"), "id")).alias("first"))
    reach = F.expr("100 * least(n, first.n) >= 75 * greatest(n, first.n) and least(n - place, first.n - first.place) >= (75 * (n + first.n) + 174) div 175")
    return leaders.join(first, ["block", "column"]).where(F.col("id") != F.col("first.id")).where(reach).select(F.col("first.id").alias("a"), F.col("id").alias("b"))


def _second_look(entries: DataFrame, part_rows: int) -> DataFrame:
    """The entries of columns whose rows are in different groups, dealt over parts of about ``part_rows`` rows.

    Rows of the largest group of a column (main) go to one part each, the others to all parts and
    are own in one of them.
    """
    by_group = entries.groupBy("block", "column", "group").agg(F.count("*").alias("rows"))
    columns = by_group.groupBy("block", "column").agg(F.sum("rows").alias("all"), F.max(F.struct("rows", "group")).alias("most")).where("all > most.rows")
    columns = stored(columns.select("block", "column", F.col("most.group").alias("largest"), F.ceil(F.col("all") / part_rows).cast("int").alias("parts")), "columns")
    if columns.count() <= BROADCAST_ROWS:
        columns = F.broadcast(columns)
    home = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = entries.join(columns, ["block", "column"]).withColumn("main", (F.col("group") == F.col("largest")).cast("int")).withColumn("own_part", home)
    rows = rows.withColumn("part", F.explode(F.when(F.col("main") == 1, F.array("own_part")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    return rows.select("block", "column", "part", "main", (F.col("part") == F.col("own_part")).cast("int").alias("own"), "group", "id", "n", "place")


def _pairs_between(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of different groups, from the entries of ``_second_look`` sorted by column and part."""

    def product(parts):
        key, (main, own, group, ids, n, place) = _keys(parts), (np.concatenate([np.asarray(p.column(c)) for p in parts]) for c in range(3, 9))
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        found, size = [], 0
        for s, e in zip(starts, np.r_[starts[1:], len(main)], strict=True):
            for i in s + np.flatnonzero(main[s:e] == 0):
                # rows of the largest group are met by all others, which meet each other in the part of the one of lesser id
                j = s + np.flatnonzero((group[s:e] != group[i]) & ((main[s:e] == 1) | ((own[i] == 1) & (ids[s:e] > ids[i]))))
                j = j[_reach(np.full(len(j), n[i]), n[j], place[i], place[j])]
                if len(j):
                    found.append((np.full(len(j), ids[i]), ids[j]))
                    size += len(j)
                if size > 1 << 16:
                    yield _typed(a=(np.concatenate([a for a, _ in found]), pa.int64()), b=(np.concatenate([b for _, b in found]), pa.int64()))
                    found, size = [], 0
        if found:
            yield _typed(a=(np.concatenate([a for a, _ in found]), pa.int64()), b=(np.concatenate([b for _, b in found]), pa.int64()))

    held: list[pa.RecordBatch] = []
    seen: set = set()
    for batch in batches:
        key = _keys([batch])
        if held and (key[:, :1] != _keys([held[-1].slice(held[-1].num_rows - 1)])).any():
            for out in product(held):
                yield from _unseen(out, seen)
            held = []
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if len(new):
            for out in product([*held, batch.slice(0, int(new[-1]))]):
                yield from _unseen(out, seen)
            held, batch = [], batch.slice(int(new[-1]))
        held.append(batch)
    if held:
        for out in product(held):
            yield from _unseen(out, seen)


def _keys(parts: list[pa.RecordBatch]) -> np.ndarray:
    return np.stack([np.concatenate([np.asarray(p.column(c)).astype(np.int64) for p in parts]) for c in range(3)])


def _unseen(batch: pa.RecordBatch, seen: set) -> Iterator[pa.RecordBatch]:
    keep = []
    for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        key = (a, b) if a < b else (b, a)
        keep.append(key not in seen)
        seen.add(key)
    if len(seen) > SEND_ENTRIES:
        seen.clear()
    if any(keep):
        yield batch.filter(pa.array(keep))


# ---------------------------------------------------------------- whole rows


def _alike(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.asarray(batch.column(c)).astype(np.int64) for c in (2, 3))
            most = n + m - 2 * least_overlap(n, m)
            ok = [least_difference(x, y) <= d for x, y, d in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, type=pa.bool_()))

    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(compare, "a long, b long")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) that link. A leader's set goes to each of its tasks, b's set beside it."""
    pairs = stored(_alike(classes, pairs), "alike")
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / LED_PER_TASK).alias("tasks"))
    led = pairs.join(tasks, "a").select(F.col("b").alias("id"), F.struct(F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("led")).alias("role"))
    leads = tasks.select(F.col("a").alias("id"), F.explode(F.transform(F.sequence(F.lit(0), F.col("tasks").cast("int") - 1), lambda t: F.struct(F.col("a").alias("leader"), t.alias("task"), F.lit(0).alias("led")))).alias("role"))
    roles = led.unionByName(leads).groupBy("id").agg(F.collect_list("role").alias("roles"))  # bounded: the blocks that a class meets a leader in
    wanted = stored(roles.join(classes, "id").select("id", F.col("rep").alias("doc_id"), "roles"), "wanted")
    if (wanted.agg(F.sum(F.size("roles")).alias("n")).first().n or 0) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for want, shingles, roles in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), words), part.column(2).to_pylist(), strict=True):
                    if class_id(shingles) == want:  # another row may have the same doc_id
                        rows += [(r["leader"], r["task"], r["led"], want, shingles.tobytes()) for r in roles]
                for a in range(0, len(rows), 256):
                    some = list(zip(*rows[a : a + 256], strict=True))
                    yield _typed(leader=(some[0], pa.int64()), task=(some[1], pa.int32()), led=(some[2], pa.int32()), id=(some[3], pa.int64()), shingles=(some[4], pa.binary()))

    def overlaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leader = None, None
        for batch in batches:
            links = []
            for lead, led, i, packed in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                shingles = np.frombuffer(packed, dtype=np.uint64)
                if not led:
                    now, leader = lead, shingles
                elif now == lead:
                    small, large = (leader, shingles) if len(leader) < len(shingles) else (shingles, leader)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    if (large[at] == small).sum() >= least_overlap(len(small), len(large)):
                        links.append((lead, i))
            if links:
                a, b = zip(*links, strict=True)
                yield _typed(a=(a, pa.int64()), b=(b, pa.int64()))

    rows = docs.join(wanted, "doc_id").select("id", "text", "roles").mapInArrow(sets, "leader long, task int, led int, id long, shingles binary")
    beside = rows.repartition("leader", "task").sortWithinPartitions("leader", "task", "led")
    return beside.mapInArrow(overlaps, "a long, b long").distinct()


def ngram_groups(docs: DataFrame, words: int = WORDS, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the least doc_id that links lead to. A document of under ``words`` words has
    its whole sequence as its one shingle; null, empty and blank texts have none and link with
    nothing. A row with a null doc_id gets a null component_id and links with nothing. Repeated
    rows each get a row; an empty table gives no rows; other columns are ignored. ``part_rows`` only
    deals the work.
    """
    return _grouped(docs, words, part_rows).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, words: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``ngram_groups`` with the class of each row (id) and of its group (root; null where nothing can link)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = doc_columns(docs, "doc_id", "text")
    counted = stored(_count_rows(docs, words), "shingles")
    rows = counted.where("column is null").select("doc_id", "n", "id")
    linkable = counted.where("column is null and n > 0 and doc_id is not null")
    classes = stored(linkable.groupBy("id").agg(F.min(F.struct("doc_id", "n", "bits")).alias("least")).select("id", F.col("least.doc_id").alias("rep"), "least.n", "least.bits"), "classes")
    docs_with_id = docs.where("doc_id is not null")

    total = linkable.agg(F.sum(F.col("n").cast("long")).alias("n")).first().n or 0
    seen = counted.where("column is not null").groupBy("column").agg(F.sum("seen").alias("seen"))
    seen = stored(seen, "frequent")
    sizes = seen.groupBy(F.floor(F.log2("seen")).cast("int").alias("size")).count().collect()  # a row for each power of two
    least, room = 0, FREQUENT_COLUMNS
    for row in sorted(sizes, key=lambda r: -r["size"]):
        room -= row["count"]
        if room < 0:
            least = 2 ** (row["size"] + 1)
            break
    often = seen.where(F.col("seen") >= least).toArrow()
    order = spark.sparkContext.broadcast(ColumnOrder(np.asarray(often["column"]).view(np.uint64), np.asarray(often["seen"])))
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * (100 - SIMILARITY) // 100 // BLOCK_ENTRIES))

    sent = _send_blocks(docs_with_id, order, blocks, words, part_rows)
    made = stored(sent.repartitionById(blocks, F.col("block")).mapInArrow(_block_product, ", ".join(f"{c} long" for c in _ENTRY)).withColumn("block", F.when(F.col("home") >= 0, F.col("home").cast("int")).otherwise(F.spark_partition_id())), "candidates")
    once = lambda p: p.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b").groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
    first = stored(_verified(docs_with_id, classes, once(made.where("a is not null").select("a", "b").unionByName(_leader_pairs(made))), words), "links")
    groups = components(first)

    led = made.where("column is not null").select("block", "column", "id", "n", "place")
    entries = led.join(groups, "id", "left").select("block", "column", F.coalesce("root", "id").alias("group"), "id", "n", "place")
    between = _second_look(entries, part_rows).repartition("block", "column", "part").sortWithinPartitions("block", "column", "part").mapInArrow(_pairs_between, "a long, b long")
    left = stored(once(between), "candidates")
    if not left.isEmpty():
        groups = components(groups.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(_verified(docs_with_id, classes, left, words)))

    named = classes.join(groups, "id", "left").select("id", "rep", F.coalesce("root", "id").alias("root"))
    least_doc = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = named.join(least_doc, "root").select("id", "root", "component_id")
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return rows.join(labels, "id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "id", F.when(linkable, F.col("root")).alias("root"))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return _orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def _with_class(texts: DataFrame, words: int) -> DataFrame:
    """(text, id) of the rows of ``texts`` (text)."""

    def classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _typed(text=(part.column(0), pa.string()), id=([class_id(s) for s in shingle_sets(part.column(0), words)], pa.int64()))

    return texts.mapInArrow(classes, "text string, id long")


def keep_one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents, with all their columns, without those that link to one of a lesser doc_id.

    Of rows with the same doc_id in a group the one of least text stays (then of least other
    columns, as far as they have an order), and so of those without words; rows with the same
    doc_id in different groups are judged apart; rows with null doc_id stay.
    """
    groups = stored(_grouped(docs, words), "groups")
    key = docs["doc_id"].cast("bigint")
    again = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    if again.isEmpty():
        return docs.join(gone, key == gone["_gone"], "left_anti")
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in ("doc_id", "text") and _orderable(f.dataType)]
    repeated = docs.join(again, key == again["_again"], "left_semi")
    rows = repeated.groupBy(key.alias("doc_id"), F.col("text").cast("string").alias("text")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.lit(0), *others)).alias("row"))
    rows = stored(rows, "repeated")
    classed = rows.join(_with_class(rows.select("text").distinct(), words).withColumnRenamed("text", "_text"), F.col("text").eqNullSafe(F.col("_text")))
    members = groups.join(again, groups["doc_id"] == again["_again"], "left_semi").select("doc_id", "id", "root", "component_id").distinct()
    stay = classed.join(members.where("doc_id = component_id"), ["doc_id", "id"]).groupBy("doc_id", "root").agg(F.min_by("row", F.struct("text")).alias("row"))
    kept = stay.select("row.*")
    alone = docs.join(gone, key == gone["_gone"], "left_anti").join(again, key == again["_again"], "left_anti")
    return alone.unionByName(kept)
