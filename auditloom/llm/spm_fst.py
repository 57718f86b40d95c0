"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file and composed with each input lazily:

* the normaliser N: a text to its escaped form (dummy prefix, blanks to U+2581), for models whose
  rule is ``identity``;
* the lexicon P: a trie of the normal pieces, with an arc for each other character that emits
  its UTF-8 bytes as byte pieces (byte fallback);
* the grammar G over neighbouring pieces. A unigram model has no grammar, its arcs weigh minus
  the piece's score. In a merge (BPE) model a segmentation is the one that merging gives exactly
  if each two neighbours in it are what merging their concatenation gives; G gives other
  neighbours infinite weight and an arc weighs its one piece.

The segmentation is the tropical-semiring shortest path. No piece reaches from another character
into U+2581, so the path of a text is the paths of its units (blanks and the word after them) one
after another, and each distinct unit is composed once for a worker.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm._common import doc_columns, slices, small_batches

BLANK = "▁"
#: ASCII marks at which a unit may end, if no piece joins them to what stands before them.
_MARKS = "\n\t!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~"
#: Entries after which the caches of units and of neighbours start anew; characters of a unit kept.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 48
INFINITE = float("inf")


class PieceTransducer:
    """N, P and G of a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError("only identity normalisation can be compiled")
        self.prefix = BLANK if rules.add_dummy_prefix else ""
        self.merges = proto.trainer_spec.model_type == 2  # BPE
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.ids = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.lexicon = self.trie()
        self.unit = re.compile(self._unit_pattern())
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece holds a blank after another character")
        self.output = [b"" if special[i] else model.id_to_piece(i).replace(BLANK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes):
            self.output[i] = bytes([b])
        self._meets: dict[str, dict[str, bool]] = {}
        self._met = 0
        self._units: dict[str, bytes] = {}

    def _unit_pattern(self) -> str:
        """Units end before a blank, and before a mark that follows a Latin letter in no piece."""
        joined = {d for p in self.ids for c, d in zip(p, p[1:], strict=False) if c.isalpha()}
        apart = "".join(re.escape(c) for c in _MARKS if c not in joined)
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        first = f"{BLANK}*+[{letters}]++(?=[{BLANK}{apart}])|" if apart else ""
        return f"{first}{BLANK}*[^{BLANK}]+|{BLANK}+"

    # P

    def trie(self) -> dict:
        """Nodes by character; under the empty one, where a piece ends, its arc."""
        root: dict = {}
        for piece in self.ids:
            node = root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (piece, 1.0 if self.merges else -self.scores[piece])
        return root

    # N

    def normalised(self, text: str) -> str:
        return self.prefix + text.replace(" ", BLANK) if text else ""

    # G

    def merged(self, text: str) -> list[str]:
        """What merging gives for a short text: the best-scored neighbours first, the left of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, left: str, right: str) -> float:
        """The weight of ``right`` after ``left``: 0 or infinite."""
        if not self.merges:
            return 0.0
        known = self._meets.setdefault(right, {})
        met = known.get(left)
        if met is None:
            if self._met > CACHE_ENTRIES:
                self._meets, self._met = {right: {}}, 0
                known = self._meets[right]
            self._met += 1
            met = known[left] = self.merged(left + right) == [left, right]
        return 0.0 if met else INFINITE

    # composition

    def arcs(self, unit: str, at: int) -> list[tuple[str, float]]:
        """(piece, weight) of the lexicon's arcs from a place; a character that is no piece has one for its bytes."""
        found, node = [], self.lexicon
        for end in range(at, len(unit)):
            node = node.get(unit[end])
            if node is None:
                break
            if "" in node:
                found.append(node[""])
        if not found or len(found[0][0]) > 1:
            found.append((unit[at], 1.0 if self.merges else 1e4))
        return found

    def shortest_path(self, unit: str) -> list[str]:
        """The pieces on the best path of a unit through the composition of P and G.

        A state is a place in the unit and a state of G: the piece before it in a merge model, none
        in a unigram model. States are composed lazily and relaxed in order of place, as all arcs
        lead forward; an arc of infinite weight makes no state. Of equal paths the first stays.
        """
        n, merges = len(unit), self.merges
        states: list[dict[str, tuple[float, str, str]] | None] = [None] * (n + 1)  #: state of G: weight, piece, state before
        states[0] = {"": (0.0, "", "")}
        for at in range(n):
            here = states[at]
            if here is None:
                continue
            for piece, weight in self.arcs(unit, at):
                after, ahead, met = piece if merges else "", states[at + len(piece)], self._meets.get(piece, {})
                for last, (so_far, _, _) in here.items():
                    if last and not (met[last] if last in met else self.neighbours(last, piece) < INFINITE):
                        continue  # infinite weight
                    if ahead is None:
                        ahead = states[at + len(piece)] = {}
                    if after not in ahead or so_far + weight < ahead[after][0]:
                        ahead[after] = (so_far + weight, piece, last)
        if not states[n]:
            raise ValueError(f"no path for {unit!r}")
        state, at, path = min(states[n], key=lambda s: states[n][s][0]), n, []
        while at:
            _, piece, before = states[at][state]
            path.append(piece)
            at, state = at - len(piece), before
        return path[::-1]

    def unit_ids(self, unit: str) -> bytes:
        known = self._units.get(unit)
        if known is None:
            ids = array("I")
            for piece in self.shortest_path(unit):
                one = self.ids.get(piece)
                ids.extend([one] if one is not None else [self.bytes[b] for b in piece.encode("utf-8")])
            known = ids.tobytes()
            if len(unit) <= CACHE_CHARS:
                if len(self._units) > CACHE_ENTRIES:
                    self._units.clear()
                self._units[unit] = known
        return known

    def encode(self, text: str | None) -> bytes:
        """Piece ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.unit_ids, self.unit.findall(self.normalised(text or ""))))

    def decode(self, ids: bytes) -> str:
        """The inverse: the outputs of the pieces, without the dummy prefix; bad UTF-8 becomes U+FFFD."""
        out = b"".join(map(self.output.__getitem__, memoryview(ids).cast("I")))
        if self.prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    """One compiled model, and its caches, for each file and Python worker."""
    return PieceTransducer(path)


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, fallback_bytes long, decoded_sha256 string, round_trip boolean"


def encode_and_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both.

    One row for each row of ``docs``: number of pieces, crc32 of the ids as little-endian unsigned
    32-bit integers, byte-fallback pieces, SHA-256 of the decoded text (UTF-8), and whether that
    is the text (U+2581 in a text comes back as a blank). Null and empty texts have no pieces and
    decode to the empty text; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        spelled = set(machine.bytes)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column(1).to_pylist():
                    ids = machine.encode(text)
                    view = memoryview(ids).cast("I")
                    back = machine.decode(ids)
                    fallback = 0 if text is None or text.isascii() and text.isprintable() else sum(i in spelled for i in view)
                    rows.append((len(view), zlib.crc32(ids), fallback, hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
