"""The segmenter: lossless blocks, masks that restore, stated cases."""

import random

import pytest

from segweave.functions.analysis import counted
from segweave.functions.latex import Config, blocks_of
from .texts import DOCUMENTS

PARTS = ["\\", "{", "}", "$", "%", "\n", "\n\n", " ", "a", "bc", "\\begin{x}", "\\end{x}", "\\item", "\\textbf{", "\\verb|", "|", "[", "]", "\\section{", "\\[", "\\]", "\\begin{equation}", "\\end{equation}"]


def restored(block):
    text = block.masked
    for token, raw in block.placeholders.items():
        text = text.replace(token, raw)
    return text


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
def test_lossless(name):
    blocks = blocks_of(DOCUMENTS[name])
    assert "".join(b.raw for b in blocks) == DOCUMENTS[name]
    assert all(restored(b) == b.raw for b in blocks)


def test_random_documents_are_lossless():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))
        blocks = blocks_of(text)
        assert "".join(b.raw for b in blocks) == text
        assert all(restored(b) == b.raw for b in blocks)


def masks(text, **config):
    return [b.masked for b in blocks_of(text, Config(**config))]


def test_stated_cases():
    assert masks(r"El código está en \lineref{kernel/trap.c}.", macros={"lineref": 1}) == ['El código está en <macro id="1"/>.']
    assert masks(r"\textbf{negrita") == ['\\textbf<group_start id="1"/>negrita']
    assert len(masks("\\noindent\\emph{one a}\n\\noindent\\emph{two b}")) == 2
    (coloured,) = masks(r"\textcolor{red}{Hello}")
    assert "Hello" in coloured and "red" not in coloured
    assert masks("one\n\ntwo") == ["one\n\n", "two"]
    assert masks("$a$ x $b$") == ['<math id="2"/> x <math id="1"/>']
    assert masks("$a$ $b$") == ['<block id="1"/>']
    assert masks("the Kernel runs", terms=("Kernel",)) == ['the <term id="1"/> runs']
    assert masks(r"a \be x \ee b", aliases={"be": ("begin", "equation"), "ee": ("end", "equation")}) == ['a <env id="1"/> b']
    with pytest.raises(ValueError):
        masks("x" * 50, most_chars=10)


def test_counted():
    text = r"""\foo{a}{b}{c} \bar [x] {y} z \foo % \no{a}
\begin{equation*}\sum_{i}\end{equation*}\verb|\no{x}| \begin{lstlisting}\no\end{lstlisting}\baz{\foo{a}} \% \open{never"""
    found = list(counted(text))
    assert [(n, a) for k, n, a in found if k == "macro"] == [("foo", 2), ("bar", 1), ("foo", 0), ("sum", 0), ("verb", 0), ("baz", 1), ("foo", 1), ("%", 0), ("open", 0)]
    assert [n for k, n, _ in found if k == "environment"] == ["equation*", "lstlisting"] and [n for k, n, _ in found if k == "verbatim"] == ["verb"]
    assert list(counted("")) == [] and len(list(counted("\\x{" * 20_000))) == 20_000
