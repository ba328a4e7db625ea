"""What a LaTeX text uses: macros with the brace groups after them, environments, verbatim macros."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Macros and environments whose bodies are not LaTeX.
VERBATIM_MACROS = ("lstinline", "verb")
VERBATIM_ENVIRONMENTS = ("verbatim", "verbatim*", "lstlisting", "minted", "comment")
NODE = re.compile(r"%[^\n]*|\\(?:([a-zA-Z]+)\*?|(.))", re.DOTALL)
BRACE = re.compile(r"\\.|[{}]", re.DOTALL)
BODY = re.compile(r"\s*\{([^{}]*)\}")
BETWEEN = re.compile(r"\s*(?:\[[^\]{}\\$%]*\]\s*)?")


def closings(text: str) -> dict[int, int]:
    """Where each brace group ends, by where it opens; groups that never end are left out."""
    stack: list[int] = []
    out: dict[int, int] = {}
    for m in BRACE.finditer(text):
        if m.group() == "{":
            stack.append(m.start())
        elif m.group() == "}" and stack:
            out[stack.pop()] = m.end()
    return out


def groups_after(text: str, at: int, ends: dict[int, int], most: int) -> int:
    """Brace groups that follow, with white space or one bracket between; no more than ``most`` are counted."""
    n = 0
    while n < most:
        at = BETWEEN.match(text, at).end()
        if at not in ends:
            break
        at, n = ends[at], n + 1
    return n


def counted(text: str, most: int = 2) -> Iterator[tuple[str, str, int]]:
    """(kind, name, brace arguments) of each macro, environment and verbatim macro, but for those in comments and verbatim."""
    at, ends = 0, closings(text)
    while m := NODE.search(text, at):
        at, name = m.end(), m.group(1)
        if name in ("begin", "end") and (body := BODY.match(text, m.end())):
            at = body.end()
            if name == "begin":
                yield "environment", body.group(1), 0
                if body.group(1) in VERBATIM_ENVIRONMENTS:
                    close = text.find(f"\\end{{{body.group(1)}}}", at)
                    at = close if close >= 0 else len(text)
        elif name in VERBATIM_MACROS:
            yield "macro", name, 0
            yield "verbatim", name, 0
            at = BETWEEN.match(text, at).end()
            if at < len(text):
                close = text.find("}" if text[at] == "{" else text[at], at + 1)
                at = close + 1 if close >= 0 else len(text)
        elif name:
            yield "macro", name, groups_after(text, m.end(), ends, most)
        elif m.group(2):
            yield "macro", m.group(2), 0
