"""Reports of a scan as text, JSON and SARIF."""

from __future__ import annotations

import json
import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.ranking import by_severity, ranked, summary
from auditloom.relations import SEVERITIES, with_advice

TOOL, VERSION = "auditloom", "1.0"
# Fixed values of the SARIF format.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
DESCRIPTIONS = {
    "pinning": "Launch lines, images and remote servers that can change or leak.",
    "drift": "Definitions that differ from the approved baseline.",
    "semantic": "Descriptions that steer the model or hide text.",
    "shadowing": "Names shared across servers and references to other servers' tools.",
    "toxic_flow": "Capabilities that are dangerous together.",
}


def advised(findings: DataFrame) -> DataFrame:
    return findings if "detail" in findings.columns else with_advice(findings)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, name, level, results): a rule for each detector; its level is that of its worst finding."""
    worst = findings.groupBy("detector").agg(F.max("severity_rank").alias("rank"), F.count("*").alias("results"))
    level = F.get(F.array(*(F.lit(SARIF_LEVELS[s]) for s in SEVERITIES)), F.col("rank"))
    return worst.select(F.concat(F.lit(f"{TOOL}/"), "detector").alias("rule_id"), F.col("detector").alias("name"), level.alias("level"), "results")


def sarif_level_counts(findings: DataFrame) -> DataFrame:
    """(level, n) of the results."""
    level = F.get(F.array(*(F.lit(SARIF_LEVELS[s]) for s in SEVERITIES)), F.col("severity_rank"))
    return findings.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def sarif_results(findings: DataFrame, uri: str = "mcp.json") -> DataFrame:
    """One JSON object for each finding, in rank order."""
    level = F.get(F.array(*(F.lit(SARIF_LEVELS[s]) for s in SEVERITIES)), F.col("severity_rank"))
    place = F.array(F.struct(F.struct(F.struct(F.lit(uri).alias("uri")).alias("artifactLocation"), F.struct(F.lit(1).alias("startLine"), F.struct(F.col("location").alias("text")).alias("snippet")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.concat(F.lit(f"{TOOL}/"), "detector").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), place.alias("locations"), F.struct("severity", "server", "tool", "detail", "remediation", F.try_parse_json("evidence").alias("evidence")).alias("properties"))
    return ranked(advised(findings)).select(F.to_json(result).alias("json"))


def render_sarif(findings: DataFrame, errors: list[str] = (), uri: str = "mcp.json") -> str:
    rules = [
        {"id": r.rule_id, "name": r.name, "shortDescription": {"text": f"{r.name} detector"}, "fullDescription": {"text": DESCRIPTIONS.get(r.name, r.name)}, "defaultConfiguration": {"level": r.level}}
        for r in sarif_rules(findings).orderBy("rule_id").collect()  # a row for each detector
    ]
    results = [json.loads(r.json) for r in sarif_results(findings, uri).toLocalIterator()]
    run = {
        "tool": {"driver": {"name": TOOL, "version": VERSION, "rules": rules}}, "results": results,
        "invocations": [{"executionSuccessful": not errors, "toolExecutionNotifications": [{"level": "error", "message": {"text": e}} for e in errors]}],
    }
    return json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [run]}, indent=2, ensure_ascii=False)


def render_json(findings: DataFrame, servers: DataFrame, tools: DataFrame, errors: list[str] = ()) -> str:
    head = summary(findings, servers, tools).first()
    counts = {r.severity: r.n for r in by_severity(findings).collect()}  # a row for each severity
    rows = [{k: v for k, v in r.asDict().items() if k != "severity_rank"} for r in ranked(advised(findings)).toLocalIterator()]
    for row in rows:
        row["evidence"] = json.loads(row["evidence"])
    listed = [r.asDict() for r in servers.select("name", "transport", "command", "args", "url").orderBy("name").toLocalIterator()]
    report = {"tool": {"name": TOOL, "version": VERSION}, "summary": {"servers": head.servers, "tools": head.tools, "findings": head.findings, "worst_severity": head.worst, "by_severity": counts}, "servers": listed, "findings": rows, "errors": list(errors)}
    return json.dumps(report, indent=2, ensure_ascii=False)


def render_text(findings: DataFrame, errors: list[str] = (), width: int = 92, most: int | None = None, evidence: bool = False) -> str:
    """All findings, or the worst ``most`` with how many were left out, and the counts, wrapped for a console."""
    lines, rows = [], ranked(advised(findings))
    for r in (rows if most is None else rows.limit(most)).toLocalIterator():
        lines += [f"[{r.severity.upper()}] {r.detector}  {r.location}", *textwrap.wrap(r.title, width, initial_indent="  ", subsequent_indent="  ")]
        for said in (r.detail, r.remediation):
            lines += textwrap.wrap(said, width, initial_indent="    ", subsequent_indent="    ")
        if evidence and r.evidence != "{}":
            lines += textwrap.wrap(r.evidence, width, initial_indent="    ", subsequent_indent="    ")
    counts = {r.severity: r.n for r in by_severity(findings).collect()}
    if most is not None and (left_out := sum(counts.values()) - most) > 0:
        lines.append(f"{left_out} findings more are not shown")
    lines.append(", ".join(f"{counts[s]} {s}" for s in reversed(SEVERITIES)))
    return "\n".join([*lines, *(f"error: {e}" for e in errors)])
