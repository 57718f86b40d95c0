"""Gradient training, folds and out-of-fold scores against slow versions; shared storage."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import ranking, training
from auditloom.operators.features import FEATURES
from auditloom.plans import cli
from auditloom.sources import configs, probe, storage


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    made = [(f"k{i}", int(r.random() < 0.3), r.choice(["en", "fr"])) + tuple(round(r.gauss(0, 1) + (j % 3 == 0) * i % 2, 3) if j != 4 else 7.0 for j in range(len(FEATURES))) for i in range(120)]
    return spark.createDataFrame(made, "key string, label int, lang string, " + ", ".join(f"{n} double" for n in FEATURES)).repartition(5)


def slow_model(x, y, epochs, rate, l2):
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std == 0] = 1
    z = (x - mean) / std
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        error = (1 / (1 + np.exp(-(z @ w + b))) - y) * weight
        w, b = w - rate * (error @ z / len(y) + l2 * w), b - rate * error.mean()
    return lambda v: 1 / (1 + np.exp(-((v - mean) / std @ w + b))), w, b, lambda v: (v - mean) / std * w


def test_descent_is_the_slow_one(rows):
    have = rows.toPandas()
    model = training.descend(rows, 1e-2, epochs=9, rate=0.4)
    _, w, b, _ = slow_model(have[list(FEATURES)].to_numpy(), have.label.to_numpy(), 9, 0.4, 1e-2)
    assert np.allclose(model.weights, w, atol=1e-9) and abs(model.bias - b) < 1e-9
    with pytest.raises(ValueError, match="both labels"):
        training.descend(rows.where("label = 0"), epochs=1)
    with pytest.raises(ValueError, match="both labels"):
        training.descend(rows.where("false"), epochs=1)


def test_descent_comes_to_what_the_solver_finds(rows):
    names = FEATURES[:3]
    near, exact = training.descend(rows, 0.1, names, epochs=60), training.train(rows, 0.1, names)
    assert np.allclose(near.weights, exact.weights, atol=2e-2)


def test_folds_are_dealt_round_within_labels(rows):
    parts = training.folds(rows, "key", 7).select("key", "label", "fold").collect()
    assert len(parts) == len({p.key for p in parts}) == 120
    for label in (0, 1):
        sizes = [sum(p.label == label and p.fold == f for p in parts) for f in range(7)]
        assert max(sizes) - min(sizes) <= 1
    again = training.folds(rows.repartition(2), "key", 7).select("key", "label", "fold").collect()
    assert set(map(tuple, again)) == set(map(tuple, parts)) != set(map(tuple, training.folds(rows, "key", 7, seed=1).select("key", "label", "fold").collect()))


def test_numbers_within_groups_span_partitions(spark):
    made = [(g, i) for g, n in ((None, 3), (1, 500), (2, 1), (3, 40)) for i in range(n)]
    rows = spark.createDataFrame(made, "g int, i int").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    got = ranking.numbered_within(rows, "g", F.col("i")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(str(tuple(r)) for r in got) == sorted(str((g, i, i)) for g, i in made)


def test_out_of_fold_scores_and_attributions_are_the_slow_ones(rows):
    scored, models = training.out_of_fold(rows, "key", 3, 1e-3, epochs=6)
    have = scored.toPandas()
    kept = [n for n in FEATURES if n not in training.LEXICON]
    found = {}
    for fold in range(3):
        rest, own = have[have.fold != fold], have[have.fold == fold]
        for names, column in ((list(FEATURES), "p"), (kept, "p_without")):
            score, *_, parts = slow_model(rest[names].to_numpy(), rest.label.to_numpy(), 6, training.RATE, 1e-3)
            assert np.allclose(score(own[names].to_numpy()), own[column], atol=1e-9)
            if column == "p":
                for lang, label, values in zip(own.lang, own.label, parts(own[names].to_numpy()), strict=True):
                    found.setdefault((lang, label), []).append(values)
    got = {(r.lang, r.label, r.feature): r["mean"] for r in training.attributions(scored, models).collect()}
    for (lang, label), values in found.items():
        assert np.allclose([got[lang, label, n] for n in FEATURES], np.mean(values, axis=0), atol=1e-9)
    by_language = training.ablation(rows, "key", epochs=3).collect()
    assert sorted((r.lang, r.features) for r in by_language) == [(g, f) for g in ("en", "fr") for f in ("all", "without_lexicon")]


# ---------------------------------------------------------------- storage and inputs


def fake(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder or d), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))


def test_shared_folder_of_a_cluster_has_to_be_named():
    assert storage.shared_folder(fake("local[2]")).startswith("file:///tmp/") and storage.shared_folder(fake("spark://h:7077", "hdfs://n/cp/")) == "hdfs://n/cp"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_path(fake("spark://h:7077"), "scan")


def test_a_probe_asks_each_server_once(spark, tmp_path):
    script = tmp_path / "s.py"
    script.write_text(f"open({str(tmp_path / 'starts')!r}, 'a').write('x')\nimport sys, json\nfor line in sys.stdin:\n m = json.loads(line)\n if 'id' in m: print(json.dumps({{'id': m['id'], 'result': {{'tools': [{{'name': 'x'}}]}}}}), flush=True)\n")
    servers = spark.createDataFrame([("s", "python", [str(script)], {}, None)], "name string, command string, args array<string>, env map<string,string>, url string")
    tools, refused = probe.probe(servers, 20)
    assert tools.count() == tools.count() == 1 and refused.count() == 0
    assert (tmp_path / "starts").read_text() == "x"


def test_only_named_files_have_to_be_readable(spark, tmp_path, monkeypatch, capsys):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"mcpServers": {"x": {"command": "npx", "args": ["pkg@1.0.0"]}}}')
    bad.write_text("{")
    monkeypatch.setattr(configs, "discover_configs", lambda: [str(bad)])
    scan = ["scan", "--enable", "drift", "--fail-on", "never"]
    assert cli.main([*scan, "--config", str(good), "--discover"], spark) == 0 and "bad.json" in capsys.readouterr().err
    assert cli.main([*scan, "--config", str(bad)], spark) == 2


@pytest.mark.parametrize("crowded", ["near one", "one heavy score", "few"])
def test_auc_of_crowded_scores(spark, crowded):
    """Scores within a millionth of 1 are split over several ranges; a score of half of all rows is one of them."""
    random = np.random.default_rng(2)
    n = 60 if crowded == "few" else 4000
    score = 1 - random.random(n) * 1e-6
    if crowded == "one heavy score":
        score[: n // 2] = 0.5
    if crowded == "few":
        score = random.integers(0, 4, n) / 4
    label = (random.random(n) < 0.3).astype(int)
    frame = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, score, strict=True)] + [(1, None)], "label int, score double")
    found = training.roc_auc(frame, F.col("score")).first()
    good, bad = score[label == 1], score[label == 0]
    wins = (good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()
    assert (found.n_pos, found.n_neg) == (len(good), len(bad)) and abs(found.auc - wins / (len(good) * len(bad))) < 1e-12
    with_parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables are read by one task otherwise
    try:
        sizes = [r["count"] for r in training.score_ranges(frame, F.col("score")).groupBy("part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_parts)
    assert sum(sizes) == len(set(score.tolist())) and (crowded == "few" or max(sizes) < 2 * sum(sizes) / len(sizes))


def test_auc_without_rows(spark):
    frame = spark.createDataFrame([], "label int, score double")
    assert training.roc_auc(frame, F.col("score")).first().asDict() == {"auc": 0.0, "n_pos": 0, "n_neg": 0}
