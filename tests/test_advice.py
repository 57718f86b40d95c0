
import random

import duckdb
import pytest
from conftest import SF

from auditloom.functions import lexicon
from auditloom.operators import flows, shadowing
from auditloom.plans import cli, report
from auditloom.plans import queries as catalogue
from auditloom.relations import TOOLS
from auditloom.sources import sinks, tables


def tools(spark, *rows):
    return spark.createDataFrame([(*r, "{}", "{}", "tool", i) for i, r in enumerate(rows)], TOOLS)


def view(*names):
    con = duckdb.connect()
    for name in names:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("gram", [shadowing.GRAM, 3])
def test_references_read_whole_texts_and_know_all_tools(spark, monkeypatch, gram):
    monkeypatch.setattr(shadowing, "GRAM", gram)
    con = view("documents", "region", "nation")
    named = [*tables.TOOL_ROWS, *((s, f"doc_{i}", t or "") for i, s, t in con.execute("select doc_id, source, text from documents").fetchall())]
    named += [(f"{t}s", n, n) for t in ("region", "nation") for (n,) in con.execute(f"select {t[0]}_name from {t}").fetchall()]
    owners = {}
    for server, name, _ in named:
        owners.setdefault(name, set()).add(server)
    expected = {}
    for server, name, text in named:
        low = text.lower()
        if refs := {o for o, by in owners.items() if o.lower() in low and o != name and by != {server}}:
            expected.setdefault((server, name), set()).update(refs)
    got = {(r.server, r.name): r.refs for r in catalogue.QUERIES["cross_server_refs_full"](spark, SF).collect()}
    assert got == {k: sorted(v) for k, v in expected.items()}
    assert any("hint" in refs for (_, name), refs in got.items() if name.startswith("doc_"))
    sql = con.execute(catalogue.ORACLES["cross_server_refs_full"]).fetchall()
    assert got == {(s, n): r for s, n, r in sql}


@pytest.mark.parametrize("strict", [False, True])
def test_both_ways_to_find_document_names(spark, monkeypatch, strict):
    rows = tools(spark, ("a", "doc_1", "See doc_12 and DOC_2."), ("b", "doc_12", "doc_1"), ("b", "doc_2", "xdoc_1 doc_1y"), ("c", "doc_2", "doc_2"), ("a", "doc_3", None), (None, "doc_4", "doc_1"), ("d", None, "doc_4 doc_1"))
    expected = sorted(map(str, shadowing.references_by_pairs(rows, strict).collect()))
    for gram in (1, 4, 6, 40):
        monkeypatch.setattr(shadowing, "GRAM", gram)
        assert expected and sorted(map(str, shadowing.cross_references(rows, strict).collect())) == expected


def test_references_to_very_many_names(spark):
    """Names with a common beginning, names of a character, names with line ends and other scripts."""
    n = 30_000
    texts = [("s%d" % (i % 7), f"tool_number_{i}", f"before tool_number_{i + 1} and TOOL_NUMBER_{i * 7 % n}x, é\nß日本") for i in range(0, n, 100)]
    names = [("z", f"Tool_Number_{i}", "") for i in range(n)] + [("z", x, None) for x in ("é\nß", "日本", "q", "E", "a.b*c", "\U0001f600x")]
    dictionary = tools(spark, *names)
    got = {(r.server, r.name): set(r.refs) for r in shadowing.cross_references(tools(spark, *texts), dictionary=dictionary).collect()}
    spelled = [m[1] for m in names]
    assert len(got) == len(texts)
    for server, name, text in texts[::25]:
        assert got[server, name] == {m for m in spelled if m.lower() in text.lower() and m != name}


def test_scan_covers_all_documents_and_fixed_tools(spark):
    rows = catalogue.QUERIES["scan_all"](spark, SF).where("detector in ('drift', 'semantic', 'shadowing', 'toxic_flow')").collect()
    docs = {f"doc_{i}": (s, g) for i, s, g in view("documents").execute("select doc_id, source, lang from documents").fetchall()}
    assert {r.detector for r in rows} == {"drift", "semantic", "shadowing", "toxic_flow"}
    named = {r.tool for r in rows if r.detector == "shadowing"}
    assert "send_mail" in named and any("Send-Mail" in r.title for r in rows if r.detector == "shadowing")
    expected = {(r.server, r.name) for r in catalogue.QUERIES["cross_server_refs_full"](spark, SF).collect() if "hint" in r.refs and r.name in docs}
    assert expected <= {(r.server, r.tool) for r in rows if r.detector == "shadowing"}
    assert any(docs[n][1] == "fr" or docs[n][0] == "src2" for _, n in expected)


@pytest.mark.parametrize("seed", range(2))
def test_flow_members_are_all_tools_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    caps = list(lexicon.CAPABILITIES)
    rows = {(s, f"{s}.t{rng.randint(0, 9)}", rng.choice(caps)) for s in "abcd" for _ in range(rng.randint(0, 25))}
    expected = set()
    for rule, (source, sink, _) in enumerate(lexicon.TOXIC_PAIRS):
        for a, t, c in rows:
            for b, u, d in rows:
                if c == source and d == sink and t != u:
                    expected |= {(rule, a != b, "source", a, t), (rule, a != b, "sink", b, u)}
    got = [tuple(r) for r in flows.members(spark.createDataFrame(sorted(rows), "server string, tool string, cap string")).collect()]
    assert sorted(got) == sorted(expected)


def test_flow_members_equal_sql(spark):
    con = view("documents")
    got = catalogue.QUERIES["toxic_flow_members"](spark, SF).select("rule", "crosses", "role", "server", "tool").collect()
    assert got and sorted(map(tuple, got)) == sorted(con.execute(catalogue.ORACLES["toxic_flow_members"]).fetchall())


def test_a_missing_model_is_an_error(spark, tmp_path, capsys):
    dump = str(tmp_path / "d.json")
    sinks.write_tool_dump(tables.fixed_servers(spark), tables.fixed_tools(spark), dump)
    assert cli.main(["scan", "--tools-json", dump, "--model", str(tmp_path / "none.json")], spark) == 2
    assert "no model" in capsys.readouterr().err


def test_the_text_report_has_all_findings(spark):
    findings = spark.range(1200).selectExpr("'drift' as detector", "'low' as severity", "1 as severity_rank", "concat('t', id) as title", "'s' as server", "cast(id as string) as tool", "'{}' as evidence")
    assert report.render_text(findings).count("[LOW]") == 1200
    some = report.render_text(findings, most=1000)
    assert some.count("[LOW]") == 1000 and "200 findings more are not shown" in some
