"""Manifests of runs: what went in, by hash, what came out, by count; and replay of a recorded run."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks.writers import digest

VERSION = "1.0"


def hash_of(value) -> str:
    """Of a JSON value, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def run_manifest(command: str, config: dict, inputs: dict[str, DataFrame], counts: dict[str, int], ontology: dict | None = None,
    prompts: dict[str, str] | None = None,
                 spend: dict | None = None, dry_run: bool = False) -> dict:
    """The manifest of a run. Inputs are tables; their hashes do not depend on the order of rows."""
    return {"manifest_version": VERSION, "command": command, "dry_run": dry_run, "config": config, "config_hash": hash_of(config),
            "inputs": {name: digest(df) for name, df in sorted(inputs.items())},
            "ontology_hash": None if ontology is None else hash_of(ontology),
            "prompts": dict(sorted((prompts or {}).items())), "counts": counts, "spend": spend or {}}


def newer_minor(version: str, reads: str) -> bool:
    """Whether a file of `version` is of a later minor version than a reader of `reads` knows. Another major version is an error."""
    (a, b), (c, d) = (map(int, v.split(".")[:2]) for v in (version, reads))
    if a != c:
        raise ValueError(f"format version {version} cannot be read by {reads}")
    return b > d


def readable(record: dict, known: set[str], reads: str = VERSION, key: str = "manifest_version") -> dict:
    """A record of this or a later minor version without the fields that only the later one has; unknown fields of this version are an error."""
    extra = record.keys() - known
    if newer_minor(record[key], reads):
        return {k: v for k, v in record.items() if k in known}
    if extra:
        raise ValueError(f"unknown fields: {', '.join(sorted(extra))}")
    return record


_KNOWN = {"manifest_version", "command", "dry_run", "config", "config_hash", "inputs", "ontology_hash", "prompts", "counts", "spend"}


def write(spark: SparkSession, manifest: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> dict:
    return readable(json.loads(spark.read.text(path, wholetext=True).first()[0]), _KNOWN)


def replay_problems(manifest: dict, inputs: dict[str, DataFrame], ontology: dict | None = None,
    prompts: dict[str, str] | None = None) -> list[str]:
    """Why a recorded run cannot be run again as it was: inputs, ontology or prompts that have changed. Empty if it can."""
    out = [] if manifest["config_hash"] == hash_of(manifest["config"]) else ["config: differs from its hash"]
    for name in sorted(manifest["inputs"].keys() | inputs.keys()):
        if name not in inputs:
            out.append(f"input {name}: missing")
        elif name not in manifest["inputs"]:
            out.append(f"input {name}: not in the manifest")
        elif digest(inputs[name]) != manifest["inputs"][name]:
            out.append(f"input {name}: changed")
    if manifest["ontology_hash"] != (None if ontology is None else hash_of(ontology)):
        out.append("ontology: changed")
    if prompts is not None and manifest["prompts"] != dict(sorted(prompts.items())):
        out.append("prompts: changed")
    return out


def ground_summary(facts: DataFrame) -> DataFrame:
    """facts (verdict, span_status, refused) -> one row: rows, verdict counts, refusals, those without a span or with a located one."""
    count = F.count_if
    return facts.agg(F.count(F.lit(1)).alias("rows"),
        *[count(F.col("verdict") == v).alias(v) for v in ("supported", "contradicted", "not_found", "unchecked")],
                     count(F.col("refused")).alias("refused"), count(F.col("span_status") == "no_span").alias("no_span"),
                     count(F.col("span_status") == "located").alias("located"))
