"""Inputs that are missing or broken end in exit code 2; the default model and its corpus."""

import json

import pytest

from auditloom.operators import scoring, training
from auditloom.operators.features import FEATURES, with_features
from auditloom.plans import cli, engine
from auditloom.relations import ADVICE
from auditloom.sources import configs, corpus, sinks, tables


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dump") / "d.json")
    fixed, tools = tables.fixed_servers(spark), tables.fixed_tools(spark)
    sinks.write_tool_dump(fixed.unionByName(tables.tool_servers(tools).join(fixed, "name", "left_anti").select(fixed.columns)), tools, path)
    return path


@pytest.mark.parametrize("text", ['{"servers": [{"name": "a"', '{"servers": 5}', "[]", "", "no json"])
def test_a_broken_dump_does_not_pass(spark, tmp_path, text, capsys):
    (tmp_path / "d.json").write_text(text)
    assert cli.main(["scan", "--tools-json", str(tmp_path / "d.json"), "--enable", "pinning"], spark) == 2
    assert "d.json" in capsys.readouterr().err


@pytest.mark.parametrize("flags", [["--tools-json", "/nowhere/d.json"], ["--config", "/nowhere/c.json"]])
def test_missing_inputs(spark, flags, capsys):
    assert cli.main(["scan", *flags, "--enable", "pinning"], spark) == 2
    assert "/nowhere/" in capsys.readouterr().err


def test_broken_models_and_baselines(spark, tmp_path, dump):
    (tmp_path / "m.json").write_text('{"weights": [1]}')
    (tmp_path / "b.json").write_text('{"format": 7, "servers": {}}')
    scan = ["scan", "--tools-json", dump, "--enable", "drift"]
    assert cli.main([*scan, "--model", str(tmp_path / "m.json")], spark) == 2
    assert cli.main([*scan, "--baseline", str(tmp_path / "none")], spark) == 2
    assert cli.main([*scan, "--baseline", str(tmp_path / "b.json")], spark) == 2


def test_json_baselines_from_the_command_line(spark, tmp_path, dump):
    base = str(tmp_path / "base.json")
    assert cli.main(["baseline", "--tools-json", dump, "--out", base], spark) == 0
    assert json.loads((tmp_path / "base.json").read_text())["format"] == 1
    assert cli.main(["scan", "--tools-json", dump, "--baseline", base, "--enable", "drift"], spark) == 0
    changed = json.loads(open(dump, encoding="utf-8").read())
    next(t for s in changed["servers"] if s["name"] == "mail" for t in s["tools"])["description"] += " And more."
    (tmp_path / "new.json").write_text(json.dumps(changed))
    out = tmp_path / "o.json"
    assert cli.main(["scan", "--tools-json", str(tmp_path / "new.json"), "--baseline", base, "--enable", "drift", "--format", "json", "--output", str(out)], spark) == 1
    found = json.loads(out.read_text())["findings"]
    assert [f["severity"] for f in found] == ["critical"] and found[0]["detail"] and found[0]["remediation"]


def test_a_failing_detector_leaves_the_others(spark, tmp_path, dump, monkeypatch, capsys):
    from pyspark.sql import functions as F

    monkeypatch.setitem(engine.DETECTORS, "drift", lambda r, c: r.tools.select(F.raise_error(F.lit("broken")).alias("detector")))
    assert cli.main(["scan", "--tools-json", dump, "--enable", "drift", "--enable", "pinning"], spark) == 2
    said = capsys.readouterr()
    assert "drift:" in said.err and "Package is not pinned" in said.out


def test_the_default_model_is_that_of_the_corpus(spark):
    rows = with_features(corpus.as_tools(corpus.corpus(spark))).cache()
    shipped, trained = configs.default_model(), training.train(rows.where("split = 'train'"))
    assert shipped.features == list(FEATURES) and max(abs(a - b) for a, b in zip(shipped.weights, trained.weights, strict=True)) < 1e-3
    held = training.confusion(rows.where("split = 'holdout'"), shipped.probability()).first()
    assert held.precision >= 0.8 and held.recall >= 0.8
    assert shipped.metrics["cv"]["f1"] >= 0.7
    assert corpus.overlap(corpus.corpus(spark)).isEmpty()
    rows.unpersist()


def test_a_scan_scores_without_a_named_model(spark, tmp_path, dump, capsys):
    assert cli.main(["scan", "--tools-json", dump, "--enable", "semantic", "--fail-on", "never"], spark) == 0
    out = capsys.readouterr().out
    assert "Invisible characters" in out and "Description reads as orders" in out and "No model" not in out


def test_every_kind_of_finding_has_advice(spark):
    from auditloom.operators import drift
    from auditloom.plans import queries as catalogue
    from auditloom.relations import with_advice

    frames = engine.Relations(tables.fixed_servers(spark), tables.fixed_tools(spark))
    findings, _ = engine.scan(frames, engine.Context(drift.snapshot(tables.fixed_tools(spark).where("server <> 'web'")), catalogue.SMALL_MODEL))
    assert with_advice(findings).where("detail = '' or remediation = ''").isEmpty() and len(ADVICE) > 20


def test_ablation_silences_words_of_one_language():
    assert len(training.LEXICON) == 13 and set(training.LEXICON) <= set(FEATURES) and "exfiltration" not in training.LEXICON
    assert scoring.LogisticModel([1.0], 0.0, [0.0], [0.0], ["x"]).std == [1.0]
