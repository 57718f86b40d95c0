"""Substring dedup by seed and extend: stretches of words that occur more than once are removed.

1. Seeds. Of the word 8-grams in every 35 consecutive words the one of least hash is an anchor
   (winnowing), so two equal stretches of 35 words have the same anchor at the same place. A text
   sends its anchors, each with the run of stretches that chose it.
2. Join. An anchor that occurs once in the corpus seeds nothing. The others are joined with the
   places where they stand.
3. Extend. A seed is extended both ways, as far as its stretches reach (27 words to either side
   at most), with all of its places at once: places whose surroundings are equal repeat each
   other. Where the surroundings differ, the seed is extended word by word: each stretch
   around it, from the most words on its left to the most on its right, is compared with those of
   the other places, of which one of each surroundings is enough.
4. Repeats. Stretches that were found twice are joined, in their text, to maximal repeats.

No step pairs the places of a seed with each other. Texts are told apart by a 128-bit digest, so
rows with the same text are one text that repeats as a whole, and stretches by 128 bits of word
hashes. Joins on seeds, surroundings, stretches and texts give the frequent ones (each more than
1/256 of the rows, so at most 256) by broadcast and deal the rows that hold them over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._common import join_counted, mixed, slices, small_batches, stored, utf8

#: Words of a stretch and of an anchor.
STRETCH, ANCHOR = 35, 8

_random = np.random.default_rng(35)
_BYTES = _random.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BASES = (0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)
_PLACES = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a number, modulo 2^64."""
    found = np.full(n, base, dtype=np.uint64)
    found[:1] = 1
    return np.multiply.accumulate(found)


class Words:
    """The words of a slice of texts as hashes; codes of stretches of them.

    ``at`` are the offsets of the texts in the words.
    """

    def __init__(self, text: pa.Array):
        self.data, offsets = utf8(text)
        blank = _BLANK[self.data]
        opens = ~blank
        opens[1:] &= blank[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[first] = ~blank[first]
        self.starts = np.flatnonzero(opens)
        self.at = np.searchsorted(self.starts, offsets)
        self.n = len(self.starts)
        self._blank = blank

    def hashes(self, which: int) -> np.ndarray:
        """A 64-bit hash of every word, of two independent ones."""
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        begin = self.starts[0]
        number = np.repeat(np.arange(self.n), np.diff(np.append(self.starts, len(self.data))))
        place = np.arange(begin, len(self.data)) - self.starts[number]
        values = _BYTES[which][self.data[begin:]] * _powers(_STEPS[which], int(place.max()) + 1)[place]
        values[self._blank[begin:]] = 0
        return mixed(np.add.reduceat(values, self.starts - begin))

    def codes(self, which: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit code of the words from ``begin`` to ``end``, the same wherever they stand."""
        sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(self.hashes(which) * _powers(_BASES[which], self.n), out=sums[1:])
        back = _powers(pow(_BASES[which], -1, 1 << 64), self.n + 1)
        return mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * _PLACES[0])


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value among ``width`` from each place on."""
    place, size = np.arange(len(values)), 1

    def joined(place, by):
        left, right = place[: len(place) - by], place[by:]
        return np.where(values[right] < values[left], right, left)

    while size * 2 <= width:
        place, size = joined(place, size), size * 2
    return joined(place, width - size) if size < width else place


def anchors_of(words: Words, stretch: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, code of surroundings, text number, place in the text, words before, words less after) of each anchor.

    The stretches that chose an anchor begin ``before`` to ``less after`` words in front of it.
    """
    nothing = np.zeros(0, dtype=np.int64)
    if words.n < stretch:
        return (nothing,) * 6
    hashes = words.hashes(0)
    grams = np.zeros(words.n - gram + 1, dtype=np.uint64)
    for k in range(gram):
        grams += hashes[k : k + len(grams)] * _PLACES[k]
    grams = mixed(grams)
    chosen = _least_places(grams, stretch - gram + 1)
    size = np.maximum(np.diff(words.at) - stretch + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + words.at[text]
    if not len(begin):
        return (nothing,) * 6
    place = chosen[begin]
    new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(begin)] - 1
    place, number = place[first], text[first]
    before, after = place - begin[first], place - begin[last]
    code = mixed(words.codes(0, begin[first], begin[last] + stretch) + before.astype(np.uint64) * _PLACES[1] + after.astype(np.uint64) * _PLACES[2])
    return grams[place].view(np.int64), code.view(np.int64), number, place - words.at[number], before, after


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    """(ka, kb, text) and further columns: the digest of a text is both keys; null is the empty text."""
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    hexed = F.sha2(text, 256)
    half = lambda k: F.conv(F.substring(hexed, k, 15), 16, 10).cast("long")  # noqa: E731 - 60 bits each
    return docs.select(*(F.col(f"`{c}`").cast("bigint").alias(c) for c in more), half(1).alias("ka"), half(16).alias("kb"), text.alias("text"))


def _anchors(texts: DataFrame, stretch: int, gram: int) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seed, code, number, place, before, after = anchors_of(Words(part.column(2)), stretch, gram)
                keys = (part.column(c).take(pa.array(number)) for c in (0, 1))
                counts = (pa.array(x, type=pa.int32()) for x in (place, before, after))
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(code), *keys, *counts], names=["seed", "code", "ka", "kb", "place", "before", "after"])

    return texts.mapInArrow(find, "seed long, code long, ka long, kb long, place int, before int, after int")


def _stretches(texts: DataFrame, stretch: int) -> DataFrame:
    """The codes of the stretches around the open places of each text: (a, b, ka, kb, begin)."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(2))
                found = part.column(3)
                number = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
                first, last = (found.flatten().field(c).to_numpy().astype(np.int64) for c in (0, 1))
                size = last - first + 1
                begin = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                number = np.repeat(number, size)
                at = words.at[number] + begin
                a, b = (words.codes(w, at, at + stretch).view(np.int64) if len(at) else at for w in (0, 1))
                for s in range(0, len(at), 1 << 17):
                    own = slice(s, s + (1 << 17))
                    keys = (part.column(c).take(pa.array(number[own])) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own]), *keys, pa.array(begin[own], type=pa.int32())], names=["a", "b", "ka", "kb", "begin"])

    return texts.mapInArrow(find, "a long, b long, ka long, kb long, begin int")


def repeated_stretches(docs: DataFrame, stretch: int = STRETCH, gram: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """Texts that occur more than once (ka, kb, n), and of the others the runs of repeated stretches (ka, kb, first, last).

    A run is given by the first words of its first and last stretch.
    """
    texts = _texts(docs)
    copied = stored(texts.groupBy("ka", "kb").agg(F.count("*").alias("n")).where("n > 1"), "copied")
    anchors = stored(_anchors(texts, stretch, gram), "anchors")
    seeds = anchors.groupBy("seed").agg(F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high"))
    seeds = stored(seeds.where("n > 1").select("seed", "n", (F.col("low") != F.col("high")).alias("mixed")), "seeds")
    places = stored(join_counted(anchors, seeds, ["seed"], "n", ["mixed"]), "places")
    runs = lambda rows: rows.select("ka", "kb", (F.col("place") - F.col("before")).alias("first"), (F.col("place") - F.col("after")).alias("last"))
    alike = runs(places.where("not mixed"))
    # seeds with several surroundings: equal ones repeat, and one of each is extended word by word
    mixed_places = places.where("mixed")
    where = F.struct("ka", "kb", "place")
    kinds = mixed_places.groupBy("seed", "code").agg(F.count("*").alias("n"), F.min(where).alias("one"))
    kinds = stored(kinds, "kinds")
    told = join_counted(mixed_places, kinds.where("n > 1"), ["seed", "code"], "n", [])
    ones = runs(join_one(mixed_places, kinds))
    open_texts = ones.distinct().groupBy("ka", "kb").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    around = stored(_stretches(texts.join(open_texts, ["ka", "kb"]), stretch), "stretches")
    source = F.struct("ka", "kb", "begin")
    twice = around.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(source).alias("low"), F.max(source).alias("high")).where("low != high")
    twice = stored(twice.select("a", "b", "n"), "twice")
    found = join_counted(around, twice, ["a", "b"], "n", []).select("ka", "kb", F.col("begin").alias("first"), F.col("begin").alias("last"))
    return copied, alike.unionByName(runs(told)).unionByName(found)


def join_one(places: DataFrame, kinds: DataFrame) -> DataFrame:
    """The place that stands for each kind of surroundings: places of a text are few, so this joins by text."""
    ones = kinds.select("seed", "code", F.col("one.ka").alias("ka"), F.col("one.kb").alias("kb"), F.col("one.place").alias("place"))
    return places.join(ones, ["seed", "code", "ka", "kb", "place"], "left_semi")


def _covered(first: np.ndarray, last: np.ndarray, n: int, stretch: int) -> list[tuple[int, int]]:
    """The maximal runs of words (begin, end) under the given runs of stretches."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + stretch, -1)
    under = np.r_[0, np.cumsum(step)[:-1] > 0, 0].astype(np.int8)
    edges = np.diff(under)
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def remove_repeats(docs: DataFrame, stretch: int = STRETCH, gram: int = ANCHOR, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, repeats[, text]) of every row of ``docs``.

    A word goes where it lies in ``stretch`` consecutive words of its text that also start at
    another place of any text. ``repeats`` are the maximal runs of such words (begin, length);
    ``text`` has the words that are kept, joined by one blank (left out unless ``texts``).
    A null or empty text has no words. Rows with one text repeat each other, whatever their
    doc_ids; texts of fewer words than a stretch keep all. A null doc_id stays null; an empty table
    gives no rows; other columns are ignored.
    """
    if not 0 < gram <= stretch:
        raise ValueError("an anchor has at least one word and fits in a stretch")
    small_batches(docs.sparkSession)
    copied, runs = repeated_stretches(docs, stretch, gram)
    # a text that occurs again is covered as a whole, so the runs of copied texts are not needed
    spans = runs.select("ka", "kb", F.struct("first", "last").alias("run"), F.lit(0).alias("n"))
    spans = spans.unionByName(copied.select("ka", "kb", F.lit(None).cast("struct<first:int,last:int>").alias("run"), "n"))
    spans = spans.groupBy("ka", "kb").agg(F.max("n").alias("n"), F.collect_set("run").alias("runs"))
    spans = stored(spans.select("ka", "kb", F.greatest("n", F.lit(1)).alias("n"), (F.col("n") > 1).alias("whole"), F.when(F.col("n") <= 1, F.col("runs")).alias("runs")), "spans")
    rows = join_counted(_texts(docs, "doc_id"), spans, ["ka", "kb"], "n", ["whole", "runs"], how="left").select("doc_id", "text", "whole", "runs")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats", *(["text"] if texts else [])]
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<begin:long,length:long>>" + ", text string" * texts
    repeats_type = pa.list_(pa.struct([("begin", pa.int64()), ("length", pa.int64())]))

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = [[] for _ in names]
                for doc_id, text, whole, found in zip(*(part.column(c) for c in range(4)), strict=True):
                    words = (text.as_py() or "").encode().split()
                    if whole.as_py():
                        gone = [(0, len(words))] if len(words) >= stretch else []
                    elif found.is_valid and len(found):
                        first, last = (found.values.field(c).to_numpy().astype(np.int64) for c in (0, 1))
                        gone = _covered(first, last, len(words), stretch)
                    else:
                        gone = []
                    kept, at = [], 0
                    for begin, end in gone:
                        kept += words[at:begin]
                        at = end
                    kept = b" ".join(kept + words[at:])
                    row = [doc_id.as_py(), len(words), sum(e - b for b, e in gone), hashlib.sha256(kept).hexdigest(), [{"begin": b, "length": e - b} for b, e in gone], *([kept.decode()] if texts else [])]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), repeats_type, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=False)], names=names)

    return rows.mapInArrow(remove, kinds)


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT doc_id, unnest(generate_series(1, len(words) - {STRETCH - 1})) AS s, words FROM texts WHERE len(words) >= {STRETCH}),
stretches AS (SELECT doc_id, s, array_to_string(list_slice(words, s, s + {STRETCH - 1}), ' ') AS stretch FROM starts),
twice AS (SELECT doc_id, s FROM stretches JOIN (SELECT stretch FROM stretches GROUP BY stretch HAVING count(*) > 1) USING (stretch)),
gone AS (SELECT DISTINCT doc_id, s + o AS place FROM twice, (SELECT unnest(generate_series(0, {STRETCH - 1})) AS o)),
words AS (SELECT doc_id, unnest(generate_series(1, len(words))) AS place, unnest(words) AS word FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
