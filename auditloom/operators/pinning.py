"""Supply-chain rules on launch lines: a row-wise filter with several findings for a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import names as N
from auditloom.relations import as_findings, finding

NAME = "pinning"


def _clean(servers: DataFrame) -> DataFrame:
    return servers.withColumns({
        "command": F.coalesce("command", F.lit("")), "url": F.coalesce("url", F.lit("")),
        "args": F.coalesce("args", F.array().cast("array<string>")), "env": F.coalesce("env", F.create_map().cast("map<string,string>")),
    })


def container_image(args: Column, strict: bool = False) -> Column:
    """The first argument that is no flag; ``strict`` skips the ``run`` or ``pull`` before the image."""
    plain = F.filter(args, lambda a: ~a.startswith("-"))
    return F.get(F.filter(plain, lambda a: ~a.isin("run", "pull", "exec", "container", "image")), 0) if strict else F.get(plain, 0)


def unpinned_image(image: Column, strict: bool = False) -> Column:
    last = F.element_at(F.split(image, "/"), -1)
    moving = ~F.contains(last, F.lit(":")) | last.endswith(":latest")
    return moving & ~F.contains(image, F.lit("@sha256:")) if strict else moving


def launch_rules(strict: bool = False) -> dict[str, Column]:
    """Conditions of the rules on a cleaned server row. Those of launch lines hold without a url."""
    base, local = N.base_name(F.col("command")), F.col("url") == ""
    runners = N.RULE_RUNNERS if not strict else tuple(dict.fromkeys(N.RULE_RUNNERS + N.MODEL_RUNNERS))
    floating = N.floating_package(F.col("command"), F.col("args"), N.MODEL_RUNNERS if not strict else runners)
    image = container_image(F.col("args"), strict)
    secret = F.exists(F.map_keys("env"), lambda k: k.rlike(N.SECRET_NAME))
    web = F.col("url").startswith("http://") | F.col("url").startswith("https://")
    return {
        "unpinned_package": local & base.isin(*runners) & floating.isNotNull(),
        "code_from_url": local & base.isin("npx", "npx.cmd") & F.exists("args", lambda a: a.startswith("http")),
        "unpinned_container": local & base.isin(*N.CONTAINER_RUNNERS) & F.coalesce(unpinned_image(image, strict), F.lit(False)),
        "plain_http": F.col("url").startswith("http://"),
        "odd_scheme": ~local & ~web,
        "no_credential": ~local & ~secret,
    }


def pinning(servers: DataFrame, strict: bool = False) -> DataFrame:
    """Findings of all rules. One pass over ``servers``; no shuffle."""
    rows = _clean(servers)
    rule, name = launch_rules(strict), F.col("name")
    spec = N.floating_package(F.col("command"), F.col("args"))
    image = container_image(F.col("args"), strict)
    agrees = F.exists("args", lambda a: a.isin(*N.AGREE_FLAGS))
    when = lambda key, severity, title, evidence: F.when(rule[key], finding(NAME, severity, title, name, evidence=evidence))
    launch = as_findings(
        rows,
        when("unpinned_package", "high", F.concat(F.lit("Package is not pinned to a version: "), spec), F.struct(spec.alias("package"), agrees.alias("auto_confirm"))),
        when("code_from_url", "critical", F.lit("Launch line runs code from a URL"), F.struct("args")),
        when("unpinned_container", "high", F.concat(F.lit("Container image is not pinned: "), image), F.struct(image.alias("image"))),
        when("plain_http", "high", F.lit("Remote server is reached over plain HTTP"), F.struct("url")),
        when("odd_scheme", "medium", F.concat(F.lit("Remote server has an unexpected scheme: "), F.substring_index("url", ":", 1)), F.struct("url")),
        when("no_credential", "low", F.lit("Remote server has no credential configured"), F.struct("url")),
    )
    return launch.unionByName(env_secrets(servers)).unionByName(argument_secrets(servers))


def env_secrets(servers: DataFrame) -> DataFrame:
    """Stored secrets: a secret-like key with a value that is no placeholder."""
    entries = _clean(servers).select("name", F.explode(F.map_entries("env")).alias("e"))
    hits = entries.where(F.col("e.key").rlike(N.SECRET_NAME) & (F.coalesce("e.value", F.lit("")) != "") & ~N.is_placeholder(F.col("e.value")))
    return as_findings(hits, finding(NAME, "low", F.concat(F.lit("Secret stored in the configuration: "), F.col("e.key")), F.col("name"), evidence=F.struct(F.col("e.key").alias("variable"))))


def argument_secrets(servers: DataFrame) -> DataFrame:
    """Secrets on the command line: only the part before ``=`` is reported."""
    args = _clean(servers).select("name", F.explode("args").alias("arg"))
    hits = args.where(F.col("arg").rlike(N.SECRET_NAME) & F.contains("arg", F.lit("=")))
    return as_findings(hits, finding(NAME, "medium", F.lit("Secret passed on the command line"), F.col("name"), evidence=F.struct(F.substring_index("arg", "=", 1).alias("argument"))))
