"""The relations of the engine: their schemas and small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERVERS = "name string, command string, args array<string>, env map<string,string>, url string, transport string, source_path string, ord long"
TOOLS = "server string, name string, description string, input_schema string, annotations string, kind string, ord long"
FINDINGS = "detector string, severity string, severity_rank int, title string, detail string, remediation string, server string, tool string, evidence string, seq long"
FINGERPRINTS = "server string, tool string, fingerprint string, description_fingerprint string, schema_fingerprint string, annotations_fingerprint string, preview string"

#: Severities from least to worst.
SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def severity_of(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank)


def downgraded(severity: Column) -> Column:
    """One step less severe, ``info`` at least."""
    return severity_of(F.greatest(severity_rank(severity) - 1, F.lit(0)))


def qualified_name(server: Column, tool: Column) -> Column:
    """``server.tool``, or the server alone where there is no tool."""
    return F.concat_ws(".", server, tool)


def finding(detector: str, severity: Column | str, title: Column, server: Column, tool: Column | None = None, evidence: Column | None = None) -> Column:
    """A row of FINDINGS as a struct; ``evidence`` is a struct, stored as JSON."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(
        F.lit(detector).alias("detector"), level.alias("severity"), severity_rank(level).alias("severity_rank"), title.alias("title"),
        server.cast("string").alias("server"), (F.lit(None) if tool is None else tool).cast("string").alias("tool"),
        (F.lit("{}") if evidence is None else F.to_json(evidence)).alias("evidence"),
    )


def as_findings(rows: DataFrame, *found: Column) -> DataFrame:
    """The findings that are not null among ``found``, which are structs of ``finding``."""
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*")


#: What a finding means and what to do, by the beginning of its title.
ADVICE = {
    "Package is not pinned": ("A launch line without a version runs whatever was published last.", "Name an exact version or a digest."),
    "Launch line runs code": ("The code behind a URL can change at any time and is not checked.", "Install a pinned package instead."),
    "Container image is not": ("A tag that moves lets another image run under the same line.", "Pin the image by its digest."),
    "Remote server is reached": ("Requests and credentials travel unencrypted.", "Use https."),
    "Remote server has an unexpected": ("The scheme is neither http nor https, so nothing is known about its protection.", "Use https."),
    "Remote server has no": ("Anyone who can reach the server may be able to use it.", "Configure a token, or make sure that the server needs none."),
    "Secret stored": ("A configuration file is read by many programs and often shared.", "Refer to a variable or a secret store."),
    "Secret passed": ("Command lines are visible to other users of the machine.", "Pass the secret by the environment or a file."),
    "No baseline": ("Without an approved state, changes of definitions cannot be seen.", "Record a baseline."),
    "Server is not in": ("Nobody has approved the tools of this server.", "Review them, then record a new baseline."),
    "Server of the baseline": ("A server that was approved is not there any more.", "Record a new baseline if that is meant."),
    "Tool is new": ("The tool appeared after the approval.", "Review it, then record a new baseline."),
    "Tool of the baseline": ("A tool that was approved is not there any more.", "Record a new baseline if that is meant."),
    "Description changed": ("What the model reads about the tool is not what was approved.", "Compare both texts before the tool is used again."),
    "Definition changed": ("Schema or annotations are not what was approved.", "Compare both definitions."),
    "Input schema changed": ("The tool takes other arguments than were approved.", "Review the new arguments."),
    "Annotations changed": ("Hints on what the tool does are not what was approved.", "Review the new hints."),
    "No model": ("Descriptions are not scored.", "Train a model, or name one."),
    "Description reads": ("The text has signs of orders to the model and scores like steering texts.", "Read the description; remove the server if it gives orders."),
    "Encoded payload": ("The text holds an encoded part that reads as orders once decoded.", "Remove the server, or ask its authors what the part is for."),
    "Invisible characters": ("The model reads characters that a person does not see.", "Remove the characters; treat the server as hostile."),
    "Tool claims": ("The text asks to be used before tools of other servers.", "Do not run the server beside others."),
    "Description speaks": ("The text addresses the model and not the reader.", "Read the description; remove the server if it gives orders."),
    "Mixed scripts": ("Letters of another script imitate Latin ones within a word.", "Compare the name with what it imitates."),
    "Tool name": ("Which server answers a call depends on the order of loading.", "Rename one of the tools, or run one of the servers."),
    "Nearly equal": ("Names that differ in case or marks are easily taken for each other.", "Rename one of the tools."),
    "Description names": ("A tool that talks about tools of other servers can redirect their use.", "Read the description."),
    "read_": ("What one tool reads another can send out or write.", "Run the two servers apart, or ask before the second tool runs."),
    "exec to": ("What one tool executes another can send out or write.", "Run the two servers apart, or ask before the second tool runs."),
}


def with_advice(findings: DataFrame) -> DataFrame:
    """``findings`` with detail (what it means) and remediation (what to do)."""
    detail, mend = F.lit(""), F.lit("")
    for start, (means, do) in ADVICE.items():
        here = F.startswith("title", F.lit(start))
        detail, mend = F.when(here, means).otherwise(detail), F.when(here, do).otherwise(mend)
    return findings.withColumns({"detail": detail, "remediation": mend})


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "detector string, severity string, severity_rank int, title string, server string, tool string, evidence string")


def tools_of(rows: DataFrame) -> DataFrame:
    """``rows`` in the shape of TOOLS: missing columns get neutral values, nulls become empty."""
    defaults = {"server": "", "name": "", "description": "", "input_schema": "{}", "annotations": "{}", "kind": "tool"}
    have = set(rows.columns)
    columns = [F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c) if c in have else F.lit(d).alias(c) for c, d in defaults.items()]
    order = F.col("ord").cast("long") if "ord" in have else F.lit(0).cast("long")
    return rows.select(*columns, order.alias("ord"))
