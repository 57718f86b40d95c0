"""Dumps in one file: cut anywhere, read in many tasks, written in many parts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from auditloom.sources import dumps, sinks, tables

ODD = ['a } b', '{"x": [1}', 'quote " and } brace', "back\\slash}", 'ends in \\"}', "новый } ключ", "", "line\nfeed }", "}" * 40, ", ] } [ {"]


def invented(seed: int, servers: int, tools: int) -> dict:
    dice = random.Random(seed)
    word = lambda: dice.choice(ODD) * dice.randint(1, 3)
    listed = []
    for i in range(servers):
        found = [{"name": f"t{j}", "description": word(), "inputSchema": {"properties": {"k": {"default": word(), "enum": [word(), [{}]]}}}} for j in range(dice.randint(0, tools))]
        found += dice.sample([{"description": "nameless"}, None, 5, "x } y", [{"name": "no tool"}]], dice.randint(0, 3))
        dice.shuffle(found)
        fields = [("name", f"s{i}"), ("tools", found), ("env", {"K": word()}), ("args", [word()]), ("extra", {"tools": [{"name": "not ours"}]})]
        dice.shuffle(fields)
        listed.append(dict(fields))
    listed += [{"tools": [{"name": "of nobody"}]}, None, 7, "s } {", [{"name": "no server", "tools": []}]]
    dice.shuffle(listed)
    return {"note": {"servers": [{"name": "not ours", "tools": [{"name": "t"}]}]}, "servers": listed, "more": [ODD], "last": {"x": {}}}


def expected(data: dict) -> tuple[list, list]:
    named = [s for s in data["servers"] if isinstance(s, dict) and s.get("name")]
    tools = [(s["name"], t["name"], t["description"], t["inputSchema"]) for s in named for t in s["tools"] if isinstance(t, dict) and t.get("name")]
    return [(s["name"], s["args"], s["env"]) for s in named], tools


def got(spark, path: str, split: int) -> tuple[list, list]:
    servers, tools = dumps.read_tool_dump(spark, path, split)
    of_tools = [(r.server, r.name, r.description, json.loads(r.input_schema)) for r in tools.orderBy("ord").collect()]
    return [(r.name, r.args, r.env) for r in servers.orderBy("ord").collect()], of_tools


@pytest.mark.parametrize(("seed", "indent", "split"), [(1, None, 97), (2, 2, 1500), (3, None, 1 << 20), (4, 1, 400)])
def test_any_cut_gives_the_same_rows(spark, tmp_path, seed, indent, split):
    data = invented(seed, 6, 8)
    (tmp_path / "d.json").write_text(json.dumps(data, indent=indent, ensure_ascii=seed % 2 == 0) + "\n" * (seed % 3), encoding="utf-8")
    assert got(spark, str(tmp_path / "d.json"), split) == expected(data)


def test_splits_of_every_size_without_spark():
    """The scanner alone: pieces of all splits, joined by owner, are the tools and servers."""
    data = invented(5, 4, 4)
    whole = json.dumps(data)
    fragments = whole.split("}")
    for size in (1, 2, 3, 7, 50, len(fragments)):
        inside, around, owned = False, [], {}
        for number, start in enumerate(range(0, len(fragments) - 1, size)):
            text = "".join(f + "}" for f in fragments[start : min(start + size, len(fragments) - 1)])
            for server, tool, place, _, piece in dumps.pieces(text, inside, number, around):
                owned.setdefault((server, tool), []).append((place, piece))
            closes, opens = dumps.outline(text, inside, number)
            around = dumps._follow("d", around, closes, opens)
            unescaped = text.replace("\\\\", "").replace('\\"', "")
            inside ^= unescaped.count('"') % 2 == 1
        assert not around and not inside
        texts = {k: json.loads("".join(p for _, p in sorted(v))) for k, v in owned.items()}
        named = {k[0]: v["name"] for k, v in texts.items() if k[0] >= 0 and k[1] < 0 and v.get("name")}
        tools = [(named[k[0]], v["name"], v["description"], v["inputSchema"]) for k, v in sorted(texts.items()) if k[1] >= 0 and k[0] in named and v.get("name")]
        assert tools == expected(data)[1]


@pytest.mark.parametrize("text", ['{"servers": []', '{"servers": [{"name": "a}]}', '{"servers": [}]}', '{"servers": []}}', '{"servers": []}{"servers": []}', '{"servers": [{"name": x}]}', '{"servers": {}}', "\n"])
def test_what_is_no_dump(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(ValueError, match="d.json"):
        dumps.read_tool_dump(spark, str(tmp_path / "d.json"), 64)


def test_empty_lists_marks_and_folders(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{"servers": []}', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"servers": [{"name": "b", "tools": [{"name": "t", "annotations": {"x": 1}}]}, {"name": "c"}]}')
    servers, tools = dumps.read_tool_dump(spark, str(tmp_path))
    assert {r.name for r in servers.collect()} == {"b", "c"}
    assert [(r.server, r.name, r.description, r.annotations) for r in tools.collect()] == [("b", "t", "", '{"x":1}')]


def test_a_hot_server_is_read_and_written_by_many_tasks(spark, tmp_path):
    n = 3000
    tools = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("server"), F.concat(F.lit("t"), "id").alias("name"),
        F.concat(F.lit('says } "'), F.repeat(F.lit("x"), 200)).alias("description"), F.lit('{"a":{"b":1}}').alias("input_schema"), F.lit("{}").alias("annotations"), F.lit("tool").alias("kind"), (F.col("id") % 7).alias("ord"),
    )
    path = str(tmp_path / "d.json")
    servers = tables.tool_servers(tools)
    sinks.write_tool_dump(servers, tools, path)
    data = json.loads((tmp_path / "d.json").read_text(encoding="utf-8"))
    assert sum(len(s["tools"]) for s in data["servers"]) == n and [s["name"] for s in data["servers"]] == sorted(s["name"] for s in data["servers"])
    texts = dumps.read_texts(spark, path, 20_000)
    assert texts.where("tool >= 0").count() == n
    found = dumps.read_tool_dump(spark, path, 20_000)[1]
    assert found.drop("ord").exceptAll(tools.drop("ord")).isEmpty() and found.count() == n
    by_split = [r[0] for r in texts.where("tool >= 0").groupBy(F.shiftright("tool", dumps.PLACE_BITS)).count().select("count").collect()]
    assert len(by_split) > 20 and max(by_split) < 3 * sorted(by_split)[len(by_split) // 2]


def test_empty_dump_round_trip(spark, tmp_path):
    servers, tools = tables.fixed_servers(spark), tables.fixed_tools(spark)
    sinks.write_tool_dump(servers.limit(0), tools, str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"servers": []}
    assert got(spark, str(tmp_path / "none.json"), 64) == ([], [])
