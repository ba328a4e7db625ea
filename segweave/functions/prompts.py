"""Prompt templates: files of an own folder before the built-in ones, versions by content, rendering as Columns.

A template is text with ``{{ name }}`` for a value and ``{% if name %} ... {% endif %}`` around what is left out where the value
is empty. Rendering is a ``concat`` of literals and Columns, so it runs inside the engine.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, token_count

PART = re.compile(r"\{\{\s*(\w+)\s*\}\}|\{%\s*if\s+(\w+)\s*%\}(.*?)\{%\s*endif\s*%\}", re.DOTALL)
BUILT_IN = {
    "system": "You translate from {{ source_lang }} to {{ target_lang }}.{% if domain %} The texts are about {{ domain }}.{% endif %}\nKeep every tag such as <macro id=\"1\"/> exactly once and in a fitting place. Give the translation alone.",
    "draft": "{{ context }}\nTranslate:\n{{ source }}",
    "critique": "{{ context }}\nSource:\n{{ source }}\nDraft:\n{{ draft }}\nGive one JSON object with requires_refine (true or false) and issues, a list of category (fluency, consistency, accuracy, other) and description.",
    "refine": "{{ context }}\nSource:\n{{ source }}\nDraft:\n{{ draft }}\nCritique:\n{{ critique }}\nGive the better translation alone.",
}


def source_of(name: str, folder: str | None = None) -> str:
    """A template's text; KeyError where neither the folder nor the library has it."""
    path = os.path.join(folder, f"{name}.txt") if folder else ""
    if path and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    return BUILT_IN[name]


def version(name: str, folder: str | None = None) -> str:
    """The name and eight digits of the hash of its text; ``unknown`` where there is no such template."""
    try:
        return f"{name}:{hashlib.sha256(source_of(name, folder).encode()).hexdigest()[:8]}"
    except (KeyError, OSError):
        return "unknown"


def rendered(template: str, **values: Column) -> Column:
    """The template with its values, without white space around it; values that are not given are empty."""
    value = lambda name: F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit("")
    parts, at = [], 0
    for m in PART.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(value(m.group(1)) if m.group(1) else F.when(value(m.group(2)) != "", rendered_inner(m.group(3), values)).otherwise(""))
        at = m.end()
    return strip(F.concat(*parts, F.lit(template[at:])))


def rendered_inner(template: str, values: dict[str, Column]) -> Column:
    """As ``rendered``, with its white space."""
    pieces = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*(F.lit(p) if k % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("") for k, p in enumerate(pieces)))


def fixed_tokens(stage: str, folder: str | None = None, count: Callable[[Column], Column] = token_count, **values: Column) -> Column:
    """Tokens of the system prompt and of a stage's prompt."""
    return (count(rendered(source_of("system", folder), **values)) + count(rendered(source_of(stage, folder), **values))).cast("long")
