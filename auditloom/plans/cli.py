"""Command line: scan, baseline, capture, train, detectors."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from auditloom.operators import ranking, training
from auditloom.operators.drift import snapshot
from auditloom.operators.features import with_features
from auditloom.plans import engine, report
from auditloom.relations import SEVERITIES, TOOLS, with_advice
from auditloom.sources import configs, corpus, probe, sinks, storage


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="auditloom")
    commands = top.add_subparsers(dest="command", required=True)
    made = {n: commands.add_parser(n) for n in ("scan", "baseline", "capture", "train", "detectors")}
    for name in ("scan", "baseline", "capture"):
        made[name].add_argument("--config", action="append", default=[])
        made[name].add_argument("--discover", action="store_true")
        made[name].add_argument("--timeout", type=float, default=20.0)
    for name in ("scan", "baseline"):
        made[name].add_argument("--tools-json")
        made[name].add_argument("--probe", action="store_true", help="start or contact the servers (runs their code)")
    scan = made["scan"]
    for flag in ("--baseline", "--model", "--output"):
        scan.add_argument(flag)
    scan.add_argument("--semantic-threshold", type=float, default=0.5)
    scan.add_argument("--enable", action="append", default=[])
    scan.add_argument("--disable", action="append", default=[])
    scan.add_argument("--format", choices=("text", "json", "sarif"), default="text")
    scan.add_argument("--fail-on", choices=(*SEVERITIES, "never"), default="high")
    scan.add_argument("--evidence", action="store_true")
    scan.add_argument("--strict", action="store_true")
    made["baseline"].add_argument("--out", default="baseline")
    made["capture"].add_argument("--out", default="tools.json")
    made["train"].add_argument("--labelled", help="Parquet with text and label; without it the corpus of the engine")
    made["train"].add_argument("--out", default="model.json")
    made["train"].add_argument("--l2", type=float, default=1e-3)
    made["train"].add_argument("--cv", type=int, default=5)
    made["train"].add_argument("--epochs", type=int, help="take so many full-batch gradient steps instead of solving to the end")
    made["train"].add_argument("--rate", type=float, default=training.RATE, help="size of a gradient step")
    return top


def relations(spark: SparkSession, args) -> tuple[engine.Relations, list[str]]:
    if getattr(args, "tools_json", None):
        return engine.Relations(*configs.read_tool_dump(spark, args.tools_json)), []
    found = [p for p in configs.discover_configs() if p not in args.config] if args.discover else []
    if not args.config and not found:
        raise ValueError("no input: give --config, --discover or --tools-json")
    servers, failed = configs.read_configs(spark, args.config)
    others, passed = configs.read_configs(spark, found)
    servers, named = servers.unionByName(others), [r.message for r in failed.collect()]  # a row for each file
    args.named_failed = bool(named)  # only files that were asked for have to be readable
    errors = named + [r.message for r in passed.collect()]
    tools = spark.createDataFrame([], TOOLS)
    if args.command == "capture" or getattr(args, "probe", False):
        tools, refused = probe.probe(servers, args.timeout)
        errors += [r.message for r in refused.collect()]
    return engine.Relations(servers, tools), errors


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "detectors":
        print("\n".join(f"{n}: {report.DESCRIPTIONS.get(n, '')}" for n in engine.DETECTORS))
        return 0
    spark = spark or SparkSession.builder.appName("auditloom").getOrCreate()
    try:
        return {"scan": _scan, "baseline": _baseline, "capture": _capture, "train": _train}[args.command](spark, args)
    except (ValueError, PySparkException) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


def _scan(spark, args) -> int:
    engine.choose(args.enable, args.disable)
    frames, errors = relations(spark, args)
    baseline = sinks.load_baseline(spark, args.baseline) if args.baseline else None
    model = configs.named_model(args.model) if args.model else configs.default_model()
    context = engine.Context(baseline, model, args.semantic_threshold, args.strict)
    # each detector runs at once and apart: one that fails is an error of the report, the others count
    findings, failed = engine.scan(frames, context, args.enable, args.disable, storage.shared_path(spark, "scan"))
    findings, errors = with_advice(findings), errors + failed
    if args.format == "json":
        text = report.render_json(findings, frames.servers, frames.tools, errors)
    else:
        text = report.render_sarif(findings, errors) if args.format == "sarif" else report.render_text(findings, errors, evidence=args.evidence)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as out:
            out.write(text)
    else:
        print(text)
    for message in errors:
        print(f"error: {message}", file=sys.stderr)
    if failed or getattr(args, "named_failed", False):
        return 2
    return 0 if args.fail_on == "never" else ranking.gate(findings, args.fail_on)


def _baseline(spark, args) -> int:
    frames, _ = relations(spark, args)
    if frames.tools.isEmpty():
        raise ValueError("no tools: a baseline would approve nothing")
    sinks.write_baseline(snapshot(frames.tools, servers=frames.servers), args.out)
    return 0


def _capture(spark, args) -> int:
    frames, errors = relations(spark, args)
    sinks.write_tool_dump(frames.servers, frames.tools, args.out)
    return 1 if errors else 0


def _train(spark, args) -> int:
    """Train on labelled texts, or on the corpus that comes with the engine, and measure by folds and on its holdout."""
    labelled = corpus.corpus(spark) if not args.labelled else spark.read.parquet(args.labelled).select("text", "label", F.lit("train").alias("split"), F.sha2("text", 256).alias("key"))
    ready = with_features(corpus.as_tools(labelled)).cache()
    rows, held = ready.where("split = 'train'"), ready.where("split = 'holdout'")
    model = training.train(rows, args.l2) if args.epochs is None else training.descend(rows, args.l2, epochs=args.epochs, rate=args.rate)
    rates = lambda frame: training.confusion(frame, model.probability()).first().asDict() | {"auc": training.roc_auc(frame, model.probability()).first().auc}
    model.metrics = {"train": rates(rows), "cv": training.cross_validate(rows, "key", args.cv, args.l2, epochs=args.epochs, rate=args.rate).first().asDict()}
    if not held.isEmpty():
        model.metrics["holdout"] = rates(held)
    ready.unpersist()
    sinks.write_model(model, args.out)
    print(model.metrics)
    return 0


if __name__ == "__main__":
    sys.exit(main())
