"""LaTeX documents as blocks: tolerant scan, opaque ranges, boundaries, placeholder masks.

``segment`` is the one table function: a document gives its blocks in order. The scan is a recursive descent over the text
that calls back with spans; nothing is kept but intervals and boundaries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import functions as F

# Which environments and macros are opaque, transparent, or split a segment.
OPAQUE_ENVIRONMENTS = {"equation", "equation*", "align", "align*", "gather", "gather*", "eqnarray", "eqnarray*", "cases", "lstlisting", "tikzpicture"}
MATH_ENVIRONMENTS = {"math", "displaymath", "multline", "multline*", "flalign", "flalign*", "split", "subequations", "dmath", "alignat", "alignat*"}
VERBATIM_ENVIRONMENTS = {"verbatim", "verbatim*", "lstlisting", "minted", "alltt"}
BLOCK_MACROS = {"section", "chapter", "subsection", "subsubsection", "paragraph", "title", "author", "date", "thanks", "item", "part", "subparagraph", "caption", "abstract"}
INLINE_MACROS = {"textbf", "textit", "emph", "underline", "hl", "textsc", "textsf", "texttt"}
SPLIT_MACROS = {"AND", "noindent"}
REFERENCE_MACROS = {"ref", "cref", "Cref", "autoref", "pageref", "eqref"}
CITATION_MACROS = {"cite", "citet", "citep", "citeyear"}
FORMAT_MACROS = {"textcolor", "href"}
# Numbers of arguments of common macros; * optional star, [ optional, { required.
ARGUMENTS = {
    "": "", "section": "*[{", "chapter": "*[{", "subsection": "*[{", "subsubsection": "*[{", "paragraph": "*[{", "subparagraph": "*[{", "part": "*[{",
    "title": "{", "author": "{", "date": "{", "thanks": "{", "caption": "[{", "item": "[", "textbf": "{", "textit": "{", "emph": "{", "underline": "{", "hl": "{",
    "textsc": "{", "textsf": "{", "texttt": "{", "ref": "{", "cref": "{", "Cref": "{", "autoref": "{", "pageref": "{", "eqref": "{", "label": "{", "cite": "[[{",
    "citet": "*[[{", "citep": "*[[{", "citeyear": "{", "textcolor": "[{{", "href": "{{", "url": "{", "includegraphics": "*[{", "usepackage": "[{",
    "RequirePackage": "[{", "documentclass": "[{", "input": "{", "include": "{", "footnote": "[{", "newcommand": "*{[[{", "renewcommand": "*{[[{", "frac": "{{",
    "vspace": "*{", "hspace": "*{", "bibliography": "{", "bibliographystyle": "{", "setlength": "{{", "color": "[{", "mbox": "{", "subfile": "{",
}
#: environments whose begin has arguments
ENVIRONMENT_ARGUMENTS = {"figure": "[", "table": "[", "tabular": "[{", "minipage": "[{", "frame": "[[", "tikzpicture": "[", "lstlisting": "[", "minted": "[{", "thebibliography": "{"}
TOKEN = re.compile(r'<[a-z_]+ id="\d+"/>', re.IGNORECASE)
LITERAL_END = re.compile(r"\\end\{[a-zA-Z*@]+\}")
PARAGRAPH = re.compile(r"\n\s*\n")
NAME = re.compile(r"\\([a-zA-Z@]+\*?|.)", re.DOTALL)


@dataclass
class Config:
    """What a project adds: macros with their argument counts, environments, aliases, terms, the longest segment."""

    macros: dict[str, int] = field(default_factory=dict)
    opaque: set[str] = field(default_factory=set)
    block: set[str] = field(default_factory=set)
    inline: set[str] = field(default_factory=set)
    aliases: dict[str, tuple[str, str]] = field(default_factory=dict)  # macro: (begin or end, environment)
    terms: tuple[str, ...] = ()
    most_chars: int | None = None


@dataclass
class Block:
    start: int
    end: int
    raw: str
    masked: str
    placeholders: dict[str, str]


class Scan:
    """One document: collects opaque ranges (start, end, kind) and boundaries."""

    def __init__(self, text: str, config: Config) -> None:
        self.text, self.config = text, config
        self.ranges: list[tuple[int, int, str]] = []
        self.bounds = {0, len(text)}
        self.open_aliases: list[tuple[str, int]] = []
        self.terms = [re.compile(rf"\b{re.escape(t)}\b") for t in config.terms]
        self.signatures = ARGUMENTS | {name: "{" * n for name, n in config.macros.items()}

    def opaque(self, start: int, end: int, kind: str) -> None:
        if end > start:
            self.ranges.append((start, end, kind))

    def run(self) -> None:
        self.walk(0, len(self.text))
        for _, start in self.open_aliases:
            self.opaque(start, len(self.text), "ENV")

    def plain(self, start: int, end: int) -> None:
        """Text without markup: terms, stray ends, paragraph breaks."""
        part = self.text[start:end]
        for pattern in self.terms:
            for m in pattern.finditer(part):
                self.opaque(start + m.start(), start + m.end(), "TERM")
        for m in LITERAL_END.finditer(part):
            self.opaque(start + m.start(), start + m.end(), "MACRO")
        for m in PARAGRAPH.finditer(part):
            self.bounds.add(start + m.end())

    def walk(self, at: int, end: int) -> None:
        text, begun = self.text, at
        while at < end:
            c = text[at]
            if c not in "\\%${":
                at += 1
                continue
            self.plain(begun, at)
            if c == "%":
                stop = text.find("\n", at, end)
                stop = end if stop < 0 else stop + 1 + (len(text[stop + 1 : end]) - len(text[stop + 1 : end].lstrip(" \t")))
                if PARAGRAPH.match(text, stop - 1, end):  # an empty line after a comment still ends the paragraph
                    stop = text.find("\n", at, end)
                self.opaque(at, stop, "COMMENT")
            elif c == "$":
                stop = self.math(at, end)
                self.opaque(at, stop, "MATH")
            elif c == "{":
                stop = self.group(at, end)
            else:
                stop = self.command(at, end)
            at = begun = max(stop, at + 1)
        self.plain(begun, end)

    def math(self, at: int, end: int) -> int:
        mark = "$$" if self.text.startswith("$$", at) else "$"
        close = re.compile(r"(?<!\\)" + re.escape(mark)).search(self.text, at + len(mark), end)
        return close.end() if close else end

    def closing(self, at: int, end: int, pair: str = "{}") -> int:
        """The place after the bracket that closes the one at ``at``; ``end`` + 1 where none does."""
        depth, i, text = 0, at, self.text
        while i < end:
            c = text[i]
            if c == "\\":
                i += 2
                continue
            if c == "%":
                i = text.find("\n", i, end)
                if i < 0:
                    break
            depth += (c == pair[0]) - (c == pair[1])
            if depth == 0:
                return i + 1
            i += 1
        return end + 1

    def group(self, at: int, end: int, kinds: tuple[str, str] = ("GROUP_START", "GROUP_END")) -> int:
        stop = self.closing(at, end)
        self.opaque(at, at + 1, kinds[0])
        if stop > end:  # never closed: what follows is its content
            self.walk(at + 1, end)
            return end
        self.walk(at + 1, stop - 1)
        self.opaque(stop - 1, stop, kinds[1])
        return stop

    def arguments(self, at: int, end: int, signature: str) -> tuple[list[tuple[int, int] | None], int]:
        """Spans of the arguments that follow ``at``, brackets included, and where they end."""
        spans: list[tuple[int, int] | None] = []
        for kind in signature:
            look = re.compile(r"[ \t]*\n?[ \t]*").match(self.text, at, end).end()
            if look < end and kind == "*" and self.text[look] == "*":
                spans.append((look, look + 1))
            elif look < end and kind in "[{" and self.text[look] == kind and (stop := self.closing(look, end, "[]" if kind == "[" else "{}")) <= end:
                spans.append((look, stop))
            elif look < end and kind == "{" and self.text[look] not in "{}%\\$":
                spans.append((look, look + 1))
            elif look < end and kind == "{" and self.text[look] == "\\":
                spans.append((look, NAME.match(self.text, look, end).end()))
            else:
                spans.append(None)
                continue
            at = spans[-1][1]
        return spans, at

    def argument(self, span: tuple[int, int]) -> None:
        """An argument that is read: braces become tokens, its content is walked."""
        start, stop = span
        if self.text[start] == "{":
            self.group(start, stop)
        elif self.text[start] == "[":
            self.opaque(start, start + 1, "GROUP_START")
            self.walk(start + 1, stop - 1)
            self.opaque(stop - 1, stop, "GROUP_END")
        else:
            self.walk(start, stop)

    def command(self, at: int, end: int) -> int:
        text = self.text
        found = NAME.match(text, at, end)
        if not found:
            return end
        name, stop = found.group(1), found.end()
        if name in ("[", "("):
            close = text.find("\\]" if name == "[" else "\\)", stop, end)
            close = end if close < 0 else close + 2
            self.opaque(at, close, "MATH")
            return close
        name = name.removesuffix("*") if name not in self.signatures and len(name) > 1 else name
        if name == "begin" and (env := re.compile(r"\s*\{([^}]*)\}").match(text, stop, end)):
            return self.environment(at, env.group(1).strip(), env.end(), end)
        if name in ("verb", "lstinline"):
            if stop < end and text[stop] == "{" and name == "lstinline":
                stop = min(self.closing(stop, end), end)
            elif stop < end:
                close = text.find(text[stop], stop + 1, end)
                stop = end if close < 0 else close + 1
            self.opaque(at, stop, "MACRO")
            return stop
        spans, stop = self.arguments(stop, end, self.signatures.get(name, ""))
        given = [s for s in spans if s]
        if name in self.config.aliases:
            self.alias(name, at, stop)
        elif name in BLOCK_MACROS | self.config.block:
            self.bounds.add(at)
            if name == "item":
                self.opaque(at, stop, "MACRO")
            for s in given if name != "item" else ():
                self.argument(s)
        elif name in SPLIT_MACROS:
            self.bounds.add(at)
        elif name in INLINE_MACROS | self.config.inline:
            for s in given:
                self.argument(s)
        elif name in REFERENCE_MACROS:
            self.opaque(at, stop, "REF")
        elif name in CITATION_MACROS:
            self.opaque(at, stop, "CITE")
        elif name in FORMAT_MACROS:
            required = [s for s in spans[-2:] if s]
            if required:
                self.opaque(*required[0], "ARG")
            for s in required[1:]:
                self.argument(s)
        else:
            self.opaque(at, stop, "MACRO")
            if name == "includegraphics" and len(spans) > 1 and spans[1]:
                self.alt_text(spans[1])
        return stop

    def alt_text(self, span: tuple[int, int]) -> None:
        """Opens the description of an image within the range that hides its macro."""
        if m := re.compile(r"alt\s*=\s*\{").search(self.text, *span):
            stop = self.closing(m.end() - 1, span[1])
            if stop <= span[1]:
                self.punch(m.end(), stop - 1)

    def punch(self, lo: int, hi: int) -> None:
        self.ranges = [piece for a, b, kind in self.ranges for piece in (((a, min(b, lo), kind), (max(a, hi), b, kind)) if a < hi and b > lo else ((a, b, kind),)) if piece[1] > piece[0]]

    def alias(self, name: str, at: int, stop: int) -> None:
        kind, env = self.config.aliases[name]
        if kind == "begin":
            self.open_aliases.append((env, at))
            return
        for i in range(len(self.open_aliases) - 1, -1, -1):
            if self.open_aliases[i][0] == env:
                self.opaque(self.open_aliases.pop(i)[1], stop, "ENV")
                return

    def environment(self, at: int, name: str, body: int, end: int) -> int:
        finish = self.end_of(name, body, end)
        hidden = name in OPAQUE_ENVIRONMENTS | MATH_ENVIRONMENTS | VERBATIM_ENVIRONMENTS | self.config.opaque
        if finish is None or hidden:
            stop = end if finish is None else finish[1]
            self.opaque(at, stop, "ENV")
            return stop
        _, body = self.arguments(body, finish[0], ENVIRONMENT_ARGUMENTS.get(name, ""))
        self.opaque(at, body, "BEGIN_ENV")
        self.walk(body, finish[0])
        self.opaque(*finish, "END_ENV")
        return finish[1]

    def end_of(self, name: str, at: int, end: int) -> tuple[int, int] | None:
        """Where the environment ends, past comments, verbatim stretches and environments of the same name within it."""
        depth, text = 1, self.text
        mark = re.compile(r"%[^\n]*|\\(?:verb|lstinline)\*?([^a-zA-Z\s{*])|\\(begin|end)\s*\{([^}]*)\}|\\.", re.DOTALL)
        if name in VERBATIM_ENVIRONMENTS:
            close = text.find(f"\\end{{{name}}}", at, end)
            return None if close < 0 else (close, close + len(name) + 6)
        while m := mark.search(text, at, end):
            at = m.end()
            if m.group(1):
                close = text.find(m.group(1), at, end)
                at = end if close < 0 else close + 1
            elif m.group(2) and m.group(3).strip() in VERBATIM_ENVIRONMENTS and m.group(2) == "begin":
                close = text.find(f"\\end{{{m.group(3).strip()}}}", at, end)
                at = end if close < 0 else close + len(m.group(3).strip()) + 6
            elif m.group(2) and m.group(3).strip() == name:
                depth += 1 if m.group(2) == "begin" else -1
                if depth == 0:
                    return m.start(), m.end()
        return None


def outermost(ranges: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Ranges by start, longest first, without those that begin inside one that is kept."""
    kept: list[tuple[int, int, str]] = []
    for r in sorted(ranges, key=lambda r: (r[0], -r[1])):
        if not kept or r[0] >= kept[-1][1]:
            kept.append(r)
    return kept


def mask(raw: str, ranges: list[tuple[int, int, str]]) -> tuple[str, dict[str, str]]:
    """Ranges replaced by tokens numbered by kind from the end of the text; then runs of tokens by block tokens from its start."""
    numbers: dict[str, int] = {}
    mapping: dict[str, str] = {}
    parts, last = [], len(raw)
    for start, end, kind in reversed(ranges):
        numbers[kind] = numbers.get(kind, 0) + 1
        token = f'<{kind.lower()} id="{numbers[kind]}"/>'
        mapping[token] = raw[start:end]
        parts += [raw[end:last], token]
        last = start
    text = "".join(reversed([*parts, raw[:last]]))
    run = re.compile(rf"{TOKEN.pattern}(?:\s*{TOKEN.pattern})+", re.IGNORECASE)
    blocks = 0

    def block(m: re.Match) -> str:
        nonlocal blocks
        blocks += 1
        mapping[token := f'<block id="{blocks}"/>'] = TOKEN.sub(lambda t: mapping.pop(t.group(), t.group()), m.group())
        return token

    return run.sub(block, text), mapping


def blocks_of(text: str, config: Config | None = None) -> list[Block]:
    """The blocks of a document, in order; joined they are the document."""
    config = config or Config()
    scan = Scan(text, config)
    scan.run()
    ranges = outermost(scan.ranges)
    inside = iter(ranges)
    current = next(inside, None)
    bounds = []
    for b in sorted(scan.bounds):  # never split a range
        while current and current[1] <= b:
            current = next(inside, None)
        if not current or not current[0] < b < current[1]:
            bounds.append(b)
    out, at = [], 0
    for start, end in zip(bounds, bounds[1:]):
        raw = text[start:end]
        if config.most_chars and len(raw) > config.most_chars:
            raise ValueError(f"segment of {len(raw)} characters exceeds {config.most_chars}")
        own = []
        while at < len(ranges) and ranges[at][1] <= end:
            own.append((ranges[at][0] - start, ranges[at][1] - start, ranges[at][2]))
            at += 1
        masked, mapping = mask(raw, own) if raw.strip() else (raw, {})
        out.append(Block(start, end, raw, masked, mapping))
    return out


SEGMENT_TYPE = "seq bigint, start int, end int, raw_text string, masked_text string, placeholders map<string,string>"


def segment_udtf(config: Config | None = None):
    """The table function; joined laterally it gives (seq, start, end, raw_text, masked_text, placeholders) of each document."""
    config = config or Config()

    class Segment:
        def eval(self, text: str) -> Iterator[tuple]:
            for seq, b in enumerate(blocks_of(text or "", config)):
                yield seq, b.start, b.end, b.raw, b.masked, b.placeholders

    return F.udtf(Segment, returnType=SEGMENT_TYPE)


def segmented(files, config: Config | None = None):
    """``files`` (namespace, content) as blocks with id, source hash and whether they are translatable."""
    from .text import source_hash, with_linguistic

    fn = segment_udtf(config)
    rows = files.select("namespace", "content").lateralJoin(fn(F.col("content").outer()))
    rows = rows.drop("content").withColumn("source_hash", source_hash(F.col("raw_text"))).withColumn("id", F.substring("source_hash", 1, 12))
    return with_linguistic(rows, "masked_text", "translatable")
