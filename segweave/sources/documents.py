"""Documents and the workspace: text files of uncertain encoding, discovery, configuration."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import closure, edges, roots

# Folders that discovery leaves out, and the form of a variable in a configuration.
SKIPPED = r"(^|/)(\.[^/]+|i18n)/"
VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are not UTF-8, by native functions only."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def read_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below a folder; paths are relative to it. Hidden folders and ``i18n`` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(base), "")
    return files.select(path.alias("path"), decoded(F.col("content")).alias("content")).where(~F.col("path").rlike(SKIPPED))


def project(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all that the project's root documents reach, sorted."""
    files = read_texts(spark, root)
    return closure(roots(files), edges(files))


def project_from(spark: SparkSession, root: str, entry: str) -> DataFrame:
    """(path) of all that one document reaches."""
    files = read_texts(spark, root)
    return closure(files.where(F.col("path") == entry).select("path"), edges(files))


def under(workspace: str, path: str) -> bool:
    """Whether a path lies in the workspace, links resolved."""
    real, base = os.path.realpath(path), os.path.realpath(workspace)
    return real == base or real.startswith(base + os.sep)


def interpolate(value: str, env: dict[str, str] | None = None) -> str:
    """Every ``${NAME}`` and ``${NAME:-default}`` of one value; a name that is unset and has no default is an error."""
    env = dict(os.environ) if env is None else env

    def one(m: re.Match) -> str:
        found = env.get(m.group(1), m.group(2))
        if found is None:
            raise KeyError(f"environment variable {m.group(1)} is not set")
        return found

    return VARIABLE.sub(one, value)


def load_config(text: str, env: dict[str, str] | None = None) -> dict:
    """A configuration in YAML (or JSON, which is YAML too) with variables filled in; its root and ``llm`` are mappings."""
    try:
        import yaml
    except ImportError:
        import json

        parsed = json.loads(text)
    else:
        parsed = yaml.safe_load(text)
    fill = lambda x: {k: fill(v) for k, v in x.items()} if isinstance(x, dict) else [fill(v) for v in x] if isinstance(x, list) else interpolate(x, env) if isinstance(x, str) else x
    if not isinstance(parsed, dict) or not parsed:
        raise ValueError("the configuration is not a mapping")
    if not isinstance(parsed.get("llm", {}), dict):
        raise ValueError("llm is not a mapping")
    return fill(parsed)


def configured_macros(found: pd.DataFrame, config: dict) -> list[dict]:
    """Macros (name, args) that the configuration lacks."""
    have = {m.get("name") for m in config.get("parser", {}).get("custom_macros", [])}
    return [{"name": r.name, "args": int(r.args)} for r in found.itertuples(index=False) if r.name not in have]
