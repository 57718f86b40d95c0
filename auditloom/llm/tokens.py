"""Token ids of whole texts with a public tokenizer file, word by word through a cache.

Both tokenizer files used here split a text at white space before any merge is applied, so
the ids of a text are the ids of its chunks (a run of white space and the word after it) one
after another. Each task therefore hands every distinct chunk to the tokenizers library once.
A run of Latin letters before an ASCII mark other than the apostrophe is a chunk too, as both
files always cut there. Texts holding U+001C to U+001F, which Python and the library do not class
alike, are encoded whole.

For a file that drops white space and lower-cases (``words``), Arrow cuts all texts of a batch at
ASCII white space and before marks and numbers the distinct chunks, so Python sees each of them
once a batch. Texts within Latin-1, which Arrow and the library lower-case alike, are lower-cased
before. Chunks of Latin letters alone go to the library many at a time, joined by
spaces, where every word ends with an id of its own kind (``</w>``): ids are cut after those. If
there are not as many of them as chunks, the chunks are encoded one by one.

The library is used as it is after loading the file, so the string of a special token in a text
becomes that token. Texts that hold such a string (or would in lower case) are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from auditloom.llm._common import utf8

_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
_CHUNK = re.compile(rf"\s*+{_LETTER}++(?={_MARK})|\s*\S+|\s+")
_LETTERS = re.compile(rf"{_LETTER}+")
_UNSURE = re.compile("[\x1c-\x1f]")
#: Entries after which a worker's cache starts anew, and characters above which a chunk is not kept.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 48
#: Chunks of letters that are handed to the library as one text.
JOINED = 100


class ChunkTokenizer:
    def __init__(self, path: str, words: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.cache: dict[str, bytes] = {}
        self.words = words
        if words:
            self.added = added
            suffix, vocabulary = getattr(self.library.model, "end_of_word_suffix", None), self.library.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  #: ids that end a word
            self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    @property
    def vocabulary(self) -> int:
        return self.library.get_vocab_size()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.words:
            ids, offsets = self.encode_words(pa.array(texts, type=pa.string()))
            return [ids[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        parts = [[] if not x or _UNSURE.search(x) or self.special.search(x) else _CHUNK.findall(x) for x in texts]
        new = list({c for p in parts for c in p}.difference(self.cache))
        known = self.cache
        long = {}
        for chunk, ids in zip(new, self._encode(new), strict=True):
            if len(chunk) <= CACHE_CHARS:
                known[chunk] = ids
            else:
                long[chunk] = ids
        if long:
            known = {**long, **{c: known[c] for p in parts for c in p if c not in long}}
        look = known.__getitem__
        return [b"".join(map(look, p)) if p or not x else self._encode([x])[0] for x, p in zip(texts, parts, strict=True)]

    def encode_array(self, text: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, ``end`` (ids as bytes) after each row, and the offsets of the rows."""
        if self.words:
            return self.encode_words(text, end)
        rows = [x + end for x in self.encode(text.to_pylist())]
        return np.frombuffer(b"".join(rows), dtype="<u4"), np.cumsum([0, *(len(x) // 4 for x in rows)])

    def encode_words(self, text: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_array``, for a file that drops white space and lower-cases."""
        text = text.fill_null("")
        data, offsets = utf8(text)
        wide = np.zeros(len(text), dtype=bool)  # beyond Latin-1
        wide[np.searchsorted(offsets, np.flatnonzero(data >= 0xC4), side="right") - 1] = True
        low = pc.utf8_lower(text)
        if wide.any():
            low = pc.if_else(pa.array(wide), text, low)
        whole = self._special(text) | self._special(low)
        if whole.any():
            low = pc.if_else(pa.array(whole), "", low)
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(low, pattern=f"({_LETTER})({_MARK})", replacement=r"\1 \2"))
        starts = np.asarray(cut.offsets).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        values, places = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.array(coded.indices)
        if whole.any():  # the one chunk of such a row, which is empty, stands for all of its ids
            rows = np.flatnonzero(whole)
            places[starts[rows]] = len(values) + np.arange(len(rows))
            values += self._encode(text.take(pa.array(rows)).to_pylist())
        places = np.insert(places, starts[1:], len(values))
        got = pa.array([*values, end], type=pa.large_binary()).take(pa.array(places))
        at = np.frombuffer(got.buffers()[1], dtype=np.int64, count=len(got) + 1) // 4
        return np.frombuffer(got.buffers()[2] or b"", dtype="<u4")[: at[-1]], at[starts + np.arange(len(starts))]

    def _special(self, text: pa.Array) -> np.ndarray:
        if not self.added:
            return np.zeros(len(text), dtype=bool)
        return np.asarray(pc.match_substring_regex(text, pattern=self.special.pattern))

    def _known(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of these distinct chunks, from the cache or the library."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        found = list(map(self.cache.get, chunks))
        new = [c for c, ids in zip(chunks, found, strict=True) if ids is None]
        if not new:
            return found
        joined = [c for c in new if _LETTERS.fullmatch(c)] if self.ends.any() else []
        learned: dict[str, bytes] = {}
        for begin in range(0, len(joined), JOINED):
            group = joined[begin : begin + JOINED]
            learned.update(zip(group, self._encode_joined(group), strict=True))
        apart = [c for c in new if c not in learned]
        learned.update(zip(apart, self._encode(apart), strict=True))
        self.cache.update((c, ids) for c, ids in learned.items() if len(c) <= CACHE_CHARS)
        return [learned[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]

    def _encode_joined(self, chunks: list[str]) -> list[bytes]:
        ids = np.asarray(self.library.encode(" ".join(chunks), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(chunks) or ends[-1] != len(ids):
            return self._encode(chunks)
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=4)
def chunk_tokenizer(path: str, words: bool = False) -> ChunkTokenizer:
    """One tokenizer, and one cache, for each file and Python worker."""
    return ChunkTokenizer(path, words)
