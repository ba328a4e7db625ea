"""A workspace on the driver's file system: its folder of settings, the configuration that discovery writes, built documents."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import load_config
from .leases import DURABILITY

SETTINGS = ".segweave"
CONFIG = "config.yaml"
DEFAULTS = {"llm": {"context_window": 3, "max_tokens": 4096, "model_context_limit": 8192}, "parser": {"custom_macros": [], "environment_aliases": {}}, "tm": {"durability": "strict"}}
IGNORED = "tm/\n*.db\n.env\n"


@dataclass(frozen=True)
class Workspace:
    folder: str
    config_path: str
    memory_path: str
    durability: str


def _put(path: str, text: str) -> None:
    """A whole new file, or the old one."""
    draft = f"{path}.{os.getpid()}"
    with open(draft, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(draft, path)


def as_text(config: dict) -> str:
    """YAML where it can be written, else JSON, which is YAML too."""
    try:
        import yaml
    except ImportError:
        return json.dumps(config, indent=2, ensure_ascii=False) + "\n"
    return yaml.safe_dump(config, sort_keys=False, allow_unicode=True)


def initialised(folder: str) -> tuple[str, bool]:
    """(path of the configuration, whether the folder is a git repository). What exists stays as it is."""
    inner = os.path.join(folder, SETTINGS)
    os.makedirs(inner, exist_ok=True)
    for name, text in ((CONFIG, as_text(DEFAULTS)), (".env", "# keys of generators, one NAME=value a line\n"), (".gitignore", IGNORED)):
        if not os.path.exists(os.path.join(inner, name)):
            _put(os.path.join(inner, name), text)
    return os.path.join(inner, CONFIG), os.path.isdir(os.path.join(folder, ".git"))


def opened(folder: str) -> Workspace:
    """The state a run begins with; only durability is read from the configuration, strict where that fails."""
    inner = os.path.join(os.path.abspath(folder), SETTINGS)
    path, durability = os.path.join(inner, CONFIG), "strict"
    try:
        with open(path, encoding="utf-8") as f:
            durability = str(load_config(f.read()).get("tm", {}).get("durability", "strict"))
    except (OSError, ValueError, KeyError, AttributeError):
        pass
    return Workspace(os.path.abspath(folder), path, os.path.join(inner, "tm"), durability if durability in DURABILITY else "strict")


def configured(path: str, macros: DataFrame | None = None, aliases: DataFrame | None = None) -> tuple[int, int]:
    """Adds the macros (name, args) and aliases (name, type, env) that a configuration lacks; how many of each are new.

    The file is written only where something is. Names are those of macros, which are few, so they are collected.
    """
    with open(path, encoding="utf-8") as f:
        config = load_config(f.read())
    parser = config.setdefault("parser", {})
    own = parser.setdefault("custom_macros", [])
    have = {m.get("name") for m in own}
    new = [{"name": r["name"], "args": int(r["args"]), "translatable": False} for r in (macros.orderBy("name").collect() if macros is not None else []) if r["name"] not in have]
    own += new
    known = parser.setdefault("environment_aliases", {})
    more = {r["name"]: {"type": r["type"], "env": r["env"]} for r in (aliases.orderBy("name").collect() if aliases is not None else []) if r["name"] not in known}
    known |= more
    if new or more:
        _put(path, as_text(config))
    return len(new), len(more)


def write_document(blocks: DataFrame, namespace: str, path: str, text_col: str = "text") -> int:
    """One document from its blocks in order, as one file; its length. A partition of blocks is held at a time."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    rows = blocks.where(F.col("namespace") == namespace).orderBy("seq").select(text_col)
    draft, n = f"{path}.{os.getpid()}", 0
    with open(draft, "w", encoding="utf-8", newline="") as f:
        for r in rows.toLocalIterator():
            n += f.write(r[0] or "")
    os.replace(draft, path)
    return n
