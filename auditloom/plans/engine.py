"""The scan: relations in, one table of findings out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from auditloom.operators import drift, flows, pinning, semantic, shadowing
from auditloom.operators.scoring import LogisticModel
from auditloom.relations import no_findings


@dataclass
class Context:
    """What a scan runs with. ``strict`` mends quirks that the default keeps for comparable results."""

    baseline: tuple[DataFrame, DataFrame] | None = None
    model: LogisticModel | None = None
    threshold: float = 0.5
    strict: bool = False
    interop: bool = False


@dataclass
class Relations:
    servers: DataFrame
    tools: DataFrame


Detector = Callable[[Relations, Context], DataFrame]

#: In order; further detectors may be added under other names.
DETECTORS: dict[str, Detector] = {
    "pinning": lambda r, c: pinning.pinning(r.servers, c.strict),
    "drift": lambda r, c: drift.drift(r.tools, c.baseline, c.interop, r.servers),
    "semantic": lambda r, c: semantic.semantic(r.tools, c.model, c.threshold, c.strict),
    "shadowing": lambda r, c: shadowing.shadowing(r.tools, c.strict),
    "toxic_flow": lambda r, c: flows.toxic_flows(r.tools),
}


def choose(enable: Iterable[str] = (), disable: Iterable[str] = ()) -> list[str]:
    """Names of the detectors to run, in order. Unknown names are an error."""
    wanted, not_wanted = ({n.lower() for n in names} for names in (enable, disable))
    if unknown := (wanted | not_wanted) - set(DETECTORS):
        raise ValueError(f"unknown detectors: {', '.join(sorted(unknown))}")
    return [n for n in DETECTORS if (not wanted or n in wanted) and n not in not_wanted]


def scan(relations: Relations, context: Context | None = None, enable: Iterable[str] = (), disable: Iterable[str] = (), isolate: str | None = None) -> tuple[DataFrame, list[str]]:
    """(findings, errors). The plan is lazy; only the chosen detectors are in it.

    ``isolate``: a folder. Each detector's findings are then written there at once, so that one
    that fails while running becomes an error and the others still count.
    """
    context = context or Context()
    spark: SparkSession = relations.tools.sparkSession
    parts, errors = [no_findings(spark)], []
    for name in choose(enable, disable):
        try:
            found = DETECTORS[name](relations, context)
            if isolate:
                found.write.mode("overwrite").parquet(f"{isolate}/{name}")
                found = spark.read.parquet(f"{isolate}/{name}")
            parts.append(found)
        except (PySparkException, Py4JError, ValueError) as e:
            errors.append(f"{name}: {type(e).__name__}: {str(e).splitlines()[0]}")
    return reduce(DataFrame.unionByName, parts), errors
