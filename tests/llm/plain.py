"""Plain versions that the operators are held against, and texts that are hard on them."""

from __future__ import annotations

import random
import re

WORDS = "the of and to in that it is was for on are with as his they at be this from have or by one had not but what all were when we there".split()


def texts(seed: int, n: int = 60) -> list[str | None]:
    """Prose, copies, near copies, shared passages, repeats, odd characters, empty and null texts."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(k))
    shared = [say(80) for _ in range(3)]
    out: list[str | None] = [None, "", " ", "\n\t", "a", "déjà vu 日本 😀" * 30, "x" * 3000, "ab " * 900]
    while len(out) < n:
        kind = rng.randrange(6)
        text = say(rng.randrange(1, 160))
        if kind == 1:
            text = rng.choice(out) or text
        elif kind == 2:
            words = (rng.choice(out) or text).split(" ")
            words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        elif kind == 3:
            text = f"{say(rng.randrange(20))} {rng.choice(shared)} {say(rng.randrange(20))}"
        elif kind == 4:
            text = f"{rng.choice(shared)}\n{rng.choice(shared)}"
        out.append(text)
    return out


def table(spark, values: list[str | None], **more):
    """doc_id and text, with columns that could clash; ids are shuffled."""
    ids = list(range(len(values)))
    random.Random(1).shuffle(ids)
    rows = [(i, t, "x", 1.0, True, 7) for i, t in zip(ids, values)]
    return spark.createDataFrame(rows, "doc_id long, text string, `rank` string, score double, removed boolean, n long")


def components(ids, edges) -> dict:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def words_of(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
