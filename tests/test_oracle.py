"""Every query with SQL gives the rows that DuckDB gives for it."""

import json
import math
from difflib import SequenceMatcher

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as entry
from segweave.operators import context
from segweave.plans import queries, views
from segweave.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows_of(df):
    df = df[sorted(df.columns)]
    plain = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    ours, theirs = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def tokens(text):
    return len(text) // 4


def packed_plainly(back, ahead, room):
    """Neighbours in turn; a side closes at the first text that does not fit."""
    used, b, f, b_open, f_open = 0, [], [], True, True
    for i in range(max(len(back), len(ahead))):
        b_open = b_open and i < len(back) and used + tokens(back[-1 - i]) <= room
        if b_open:
            used, b = used + tokens(back[-1 - i]), [back[-1 - i], *b]
        f_open = f_open and i < len(ahead) and used + tokens(ahead[i]) <= room
        if f_open:
            used, f = used + tokens(ahead[i]), [*f, ahead[i]]
    return used if b or f else 0, b, f


def test_context_pack(spark, data):
    rows = {(r["namespace"], r["seq"]): r for r in context.positional(queries._turns(spark, data), 3, 3).collect()}
    got = QUERIES["context_pack"](spark, data).collect()
    assert len(got) == len(rows) > 50
    for r in got:
        own = rows[r["namespace"], r["seq"]]
        used, b, f = packed_plainly(own["backward"], own["forward"], 120)
        parts = [["<context>"], ["<previous_segments>", *b, "</previous_segments>"] if b else [], ["<target_segment_position/>"], ["<next_segments>", *f, "</next_segments>"] if f else [], ["</context>"]]
        assert r["block"] == ("\n".join(x for p in parts for x in p) if b or f else "")
        assert (r["tokens"], r["truncated"]) == (used, len(b) + len(f) < len(own["backward"]) + len(own["forward"]))


def least_limit(need):
    """The smallest context limit that leaves room, by trying."""
    lo, hi = 1, 262_145
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if mid - max(64, mid // 50) >= need else (mid + 1, hi)
    return lo if lo <= 262_144 else None


def test_context_recommendation_and_verdict(spark, data):
    want = {}
    for stage, (window, ahead, multiplier, floor, margin, texts) in {"draft": (3, 0, 1.5, 1536, 64, 1), "critique": (1, 1, 0.75, 1024, 32, 2), "refine": (2, 2, 1.5, 1536, 64, 2)}.items():
        for r in context.positional(views.segments(spark, data), window, ahead).collect():
            n = tokens(r["source_text"])
            fixed = 120 + n * texts + (16 if stage == "refine" else 0)
            reserved = min(4096, max(floor, int(n * multiplier) + margin))
            near = math.ceil(sum(map(tokens, [*r["backward"], *r["forward"]])) * 1.2)
            base = reserved + math.ceil(fixed * 1.1) + 48
            have = want.setdefault((r["namespace"], stage), [0, 0])
            have[:] = max(have[0], least_limit(base) or 262_144), max(have[1], least_limit(base + near) or 262_144)
    got = {(r["namespace"], r["stage"]): r for r in QUERIES["context_recommendation"](spark, data).collect()}
    assert {k: [r["min_bare"], r["min_full_neighbors"]] for k, r in got.items()} == want and want
    for r in QUERIES["context_verdict"](spark, data).collect():
        need = max(v[1] for k, v in want.items() if k[0] == r["namespace"])
        assert r["need"] == need and r["verdict"] == ("raise_config" if need > 8192 else "oversized_vs_need" if 8192 > 2 * need > 0 else "ok")
    said = {r["namespace"]: r["message"] for r in QUERIES["budget_messages"](spark, data).collect()}
    assert set(said) == {k[0] for k in want} and all("below recommended min" in m for m in said.values())


def test_latex_segment(spark, data):
    files = {r["path"]: r["content"] for r in views.tex_files(spark, data).collect()}
    blocks = {}
    for r in QUERIES["latex_segment"](spark, data).collect():
        blocks.setdefault(r["namespace"], []).append(r)
    assert set(blocks) == set(files)
    for path, own in blocks.items():
        own.sort(key=lambda r: r["seq"])
        assert [r["start"] for r in own] == [0, *(r["end"] for r in own[:-1])] and own[-1]["end"] == len(files[path])
        assert [r["seq"] for r in own] == list(range(len(own)))
        for r in own:
            text = r["masked_text"]
            for token, raw in json.loads(r["placeholders"]).items():
                text = text.replace(token, raw)
            assert text == files[path][r["start"] : r["end"]] and len(r["id"]) == 12


def test_alignment(spark, data):
    """Pairs are one to one within a document, of a new block and a stored row with a translation, and as similar as they say."""
    old = {(r["namespace"], r["id"]): r for r in views.stored_lines(spark, data).collect()}
    new = {(r["namespace"], r["id"]): r for r in views.edited_lines(spark, data).collect()}
    got = QUERIES["identity_alignment"](spark, data).collect()
    assert len(got) > 20 and len({(r["namespace"], r["id"]) for r in got}) == len({(r["namespace"], r["from_id"]) for r in got}) == len(got)
    for r in got:
        a, b = old[r["namespace"], r["from_id"]], new[r["namespace"], r["id"]]
        assert a["translation"] != "" and r["similarity"] >= 0.85 and r["similarity"] == SequenceMatcher(None, a["source_text"], b["masked_text"]).ratio()
    carried = QUERIES["sync_with_carryover"](spark, data).toPandas()
    plain = QUERIES["sync_counters"](spark, data).toPandas()
    assert sorted(carried.columns) == sorted(plain.columns) and len(carried) == len(plain)


def test_segment_tokens_bpe(spark, data):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["segment_tokens_bpe"](spark, data).collect()}
    assert got == {k: len(own.encode(t or "", add_special_tokens=False).ids) for k, t in texts.items()}


def test_all_are_held_against_something():
    """Queries without SQL have a test of their own here or in test_operators."""
    assert set(QUERIES) - set(SQL) == {"context_pack", "context_recommendation", "context_verdict", "budget_messages", "latex_segment", "identity_alignment", "identity_similarity", "sync_with_carryover", "segment_tokens_bpe"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
