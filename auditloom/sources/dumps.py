"""Tool dumps in one JSON file of any size: read in splits, written in parts.

A dump is one JSON object with a list ``servers``, whose members have lists ``tools``. Spark's text reader
cuts the file at ``}``, which it may do anywhere, in a string as well. Three passes over the same splits
find out where each split stands: the parity of quotes tells which splits begin in a string, the brackets
that a split closes and opens give the containers around the next one, and with these each split deals
its text out to the tools and servers that it belongs to. The driver sees one row for each split.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from auditloom.sources import storage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Bytes of a split: a task holds the text of one.
SPLIT_BYTES = 16 << 20
#: Places of text: the number of the split above, characters from its beginning below.
PLACE_BITS = 40

SERVER = "name string, transport string, command string, args array<string>, env map<string,string>, url string"
_OUTLINE = "file string, block long, closes string, opens array<struct<key:string,kind:string,place:long>>"
_PIECES = "server long, tool long, place long, whole boolean, text string"
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)|[{}\[\]:,]', re.S)
_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_PAIR = {"}": "{", "]": "["}


def brackets(text: str, inside: bool) -> Iterator[tuple[str, str | None, int]]:
    """(bracket, its key with quotes, index) of brackets outside strings; ``inside``: the text begins in a string."""
    first = _STRING_END.match(text) if inside else None
    if inside and not first:
        return
    string = key = None
    for m in _TOKEN.finditer(text, first.end() if first else 0):
        token = text[m.start()]
        if token == '"':
            string = m.span()
        elif token == ":":
            key = text[slice(*string)] if string and string[1] - string[0] < 64 else None
        else:
            if token != ",":
                yield token, key, m.start()
            string = key = None


def outline(text: str, inside: bool, number: int) -> tuple[str, list[tuple[str | None, str, int]]]:
    """What a split does to the containers around it: brackets that it closes, then (key, bracket, place) that it leaves open."""
    closes, opens = [], []
    for token, key, at in brackets(text, inside):
        if token in "{[":
            opens.append((key, token, (number << PLACE_BITS) + at))
        elif not opens:
            closes.append(_PAIR[token])
        elif opens.pop()[1] != _PAIR[token]:
            raise ValueError(f"a bracket closes another kind in split {number}")
    return "".join(closes), opens


def owner(stack: list[tuple[str | None, str, int]]) -> tuple[int, int] | None:
    """(server, tool) whose text stands within these containers, -1 for none; None between members of a list."""
    if len(stack) < 2 or stack[0][1] != "{" or stack[1][:2] != ('"servers"', "["):
        return -1, -1
    if len(stack) == 2 or stack[2][1] != "{":
        return None
    if len(stack) < 4 or stack[3][:2] != ('"tools"', "["):
        return stack[2][2], -1
    return None if len(stack) == 4 or stack[4][1] != "{" else (stack[2][2], stack[4][2])


def pieces(text: str, inside: bool, number: int, stack: list[tuple[str | None, str, int]]) -> Iterator[tuple[int, int, int, bool, str]]:
    """(server, tool, place, whole, text) of each stretch of one owner; ``whole``: a tool from its first to its last bracket."""
    stack, base, mark = list(stack), number << PLACE_BITS, 0
    held = owner(stack)
    for token, key, at in brackets(text, inside):
        if token in "{[":
            stack.append((key, token, base + at))
        elif stack:
            stack.pop()
        if len(stack) > 5:
            continue
        now = owner(stack)
        if now == held:
            continue
        cut = at if now else at + 1  # a bracket belongs to the one of both that owns text
        if held and cut > mark:
            yield *held, base + mark, held[1] >= base, text[mark:cut]
        held, mark = now, cut
    if held and mark < len(text):
        yield *held, base + mark, False, text[mark:]


def _splits(batches, open_ends: set[tuple[str, int]]) -> Iterator[tuple[str, int, str]]:
    """(file, block, text) of each split; the last text of ``open_ends`` is not followed by a bracket."""
    held, values = None, []

    def joined() -> tuple[str, int, str]:
        return *held, "}".join(values) + ("" if tuple(held) in open_ends else "}")

    for batch in batches:
        for *key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held != key:
                if held:
                    yield joined()
                held, values = key, []
            values.append(value)
    if held:
        yield joined()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _follow(path: str, around: list[tuple[str | None, str, int]], closes: str, opens) -> list[tuple[str | None, str, int]]:
    """The containers around what follows a split."""
    kept = around[: len(around) - len(closes)]
    if len(closes) > len(around) or closes != "".join(k for _, k, _ in reversed(around[len(kept) :])):
        raise ValueError(f"{path}: no dump: brackets do not match")
    return kept + [tuple(o) for o in opens]


def read_texts(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(server, tool, text) of a dump or of each dump in a folder, in the shared folder.

    server and tool are the places where the two begin. tool is -1 for the rest of a server without its tools, server
    less than 0 for the rest of a file without its servers. Members of the two lists that are no objects are left out. Brackets that do not
    match, an open string and a missing file are a ValueError. Compressed files are one split, and have to end with ``}``.
    """
    cuts = spark.newSession()  # its own settings, so that all three passes see the same splits
    cuts.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    cuts.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        lines = cuts.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")
        found = lines.select("file", "block", F.make_valid_utf8("value").alias("value"))
        quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '[^"]', ""))
        parities = sorted((r.file, r.block, r.odd, r.held, r.size) for r in lines.groupBy("file", "block", "size").agg((F.sum(quotes) % 2 == 1).alias("odd"), F.sum(F.octet_length("value") + 1).alias("held")).collect())
    except PySparkException as e:
        raise ValueError(f"{path}: cannot be read: {str(e).splitlines()[0]}") from e
    if not parities:
        raise ValueError(f"{path}: no dump: the file is empty")
    last = {file: block for file, block, *_ in parities}
    number = {(file, block): i for i, (file, block, *_) in enumerate(parities)}
    first = {file: i for (file, _), i in reversed(number.items())}
    inside, within, read, open_ends = {}, False, Counter(), set()
    for file, block, odd, held, size in parities:
        inside[file, block] = within
        within ^= odd
        read[file] += held
        if last[file] == block and read[file] - size in (1, -2):  # more than the file by a bracket; a byte-order mark is not read
            open_ends.add((file, block))
        if last[file] == block and within:
            raise ValueError(f"{path}: no dump: a string does not end")
    states: dict[tuple[str, int], list[tuple[str | None, str, int]]] = {}
    kind = pa.schema([("file", pa.string()), ("block", pa.int64()), ("closes", pa.string()), ("opens", pa.list_(pa.struct([("key", pa.string()), ("kind", pa.string()), ("place", pa.int64())])))])
    dealt = pa.schema([("server", pa.int64()), ("tool", pa.int64()), ("place", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])

    def outlines(batches):
        for file, block, text in _splits(batches, open_ends):
            closes, opens = outline(text, inside[file, block], number[file, block])
            yield _table([(file, block, closes, [dict(zip(("key", "kind", "place"), o, strict=True)) for o in opens])], kind)

    def deal(batches):
        for file, block, text in _splits(batches, open_ends):
            rows, held = [], 0
            for server, *row in pieces(text, inside[file, block], number[file, block], states[file, block]):
                rows.append((server if server >= 0 else -1 - first[file], *row))
                held += len(row[-1])
                if held > 1 << 20:
                    yield _table(rows, dealt)
                    rows, held = [], 0
            if rows:
                yield _table(rows, dealt)

    try:
        seen = {(r.file, r.block): r for r in found.mapInArrow(outlines, _OUTLINE).collect()}
    except PySparkException as e:
        raise ValueError(f"{path}: no dump: brackets do not match") from e
    around: list[tuple[str | None, str, int]] = []
    for file, block, *_ in parities:
        states[file, block] = around
        around = _follow(path, around, seen[file, block].closes, seen[file, block].opens)
        if last[file] == block and around:
            raise ValueError(f"{path}: no dump: brackets are left open")
    target = storage.shared_path(spark, "dump")
    found.mapInArrow(deal, _PIECES).write.parquet(target)
    rows = spark.read.schema(_PIECES).parquet(target)
    of_parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), "")
    parts = rows.where("not whole").groupBy("server", "tool").agg(of_parts.alias("text"))
    return rows.where("whole").select("server", "tool", "text").unionByName(parts)


def server_columns(s: str, ord: Column) -> list[Column]:
    """SERVERS from a struct of SERVER."""
    return [
        F.col(f"{s}.name"), F.col(f"{s}.command"), F.col(f"{s}.args"), F.col(f"{s}.env"), F.col(f"{s}.url"),
        F.coalesce(f"{s}.transport", F.lit("stdio")).alias("transport"), F.lit("").alias("source_path"), ord.cast("long").alias("ord"),
    ]


def tools_from(rows: DataFrame, ord: Column) -> DataFrame:
    """TOOLS from (server, t), t a tool as VARIANT; those without a name are skipped."""
    get = lambda k: F.try_variant_get("t", f"$.{k}", "string")
    part = lambda *ks: F.coalesce(*(F.to_json(F.try_variant_get("t", f"$.{k}", "map<string,variant>")) for k in ks), F.lit("{}"))
    return rows.where(F.coalesce(get("name"), F.lit("")) != "").select(
        "server", get("name").alias("name"), F.coalesce(get("description"), F.lit("")).alias("description"), part("inputSchema", "input_schema").alias("input_schema"),
        part("annotations").alias("annotations"), F.lit("tool").alias("kind"), ord.cast("long").alias("ord"),
    )


@F.pandas_udf(BooleanType())
def _lists_servers(texts: pd.Series) -> pd.Series:
    """Whether texts are objects with a list of servers, and nothing after them, which Spark's parser would pass over."""

    def lists(text: str) -> bool:
        try:
            data = json.loads(text.removeprefix("\ufeff"))
        except ValueError:
            return False
        return isinstance(data, dict) and isinstance(data.get("servers"), list)

    return texts.map(lists).astype(bool)


def read_tool_dump(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(servers, tools) of captured definitions. Entries without a name are skipped; what is no dump is a ValueError."""
    texts = read_texts(spark, path, split_bytes)
    rest = texts.where("server < 0").select(_lists_servers("text").alias("lists"))  # a row for each file
    if not rest.where("not lists").isEmpty() or not texts.where(F.try_parse_json("text").isNull()).isEmpty():
        raise ValueError(f"{path}: no dump: JSON with a list of servers is expected")
    server = texts.where("server >= 0 and tool < 0").select("server", F.from_json("text", SERVER).alias("s")).where("coalesce(s.name, '') <> ''")
    # a stored table has a size that Spark knows, so small lists of servers go to the tools and the texts are not shuffled
    names = storage.stored(server.select(F.col("server").alias("at"), F.col("s.name").alias("server")), "names")
    tool = texts.where("tool >= 0").select(F.col("server").alias("at"), "tool", F.try_parse_json("text").alias("t"))
    return server.select(*server_columns("s", F.col("server"))), tools_from(tool.join(names, "at"), F.col("tool"))
