"""Stages with stated generators, the workspace scan and configuration."""

import pytest
from pyspark.sql import functions as F

from segweave.operators import translate
from segweave.schema import SEGMENTS
from segweave.sources import documents


def made(spark, *texts):
    base = dict(namespace="ns", source_hash="h", status="generated", translation="", doc_type="segment", history=[], placeholders={})
    return spark.createDataFrame([tuple((base | {"seq": i, "id": f"seg{i}", "source_text": t}).get(c) for c in SEGMENTS.names) for i, t in enumerate(texts)], SEGMENTS)


def states(df):
    return {r["id"]: (r["status"], r["translation"]) for r in df.collect()}


def now():
    return F.lit("2024-01-01 00:00:00")


def test_workflow_accepts_drafts(spark):
    def speak(stage, source, draft, critique, near):
        return '{"requires_refine": false, "issues": []}' if stage == "critique" else source.replace("Hello", "Hola")

    rows = made(spark, "Hello world of prose", '<macro id="1"/>')
    assert states(translate.workflow(rows, speak, now=now())) == {"seg0": ("refined", "Hola world of prose"), "seg1": ("refined", '<macro id="1"/>')}


def test_workflow_refines_and_fails(spark):
    def speak(stage, source, draft, critique, near):
        if stage == "critique":
            return "no JSON here" if "plain" in source else '{"requires_refine": true, "issues": []}'
        if stage == "draft":
            return "" if "nothing" in source else source + " {"
        return source.upper() if "good" in source else source + " }"

    rows = made(spark, "a good one for all", "the bad one for all", "say nothing to the end", "a plain good one here")
    got = states(translate.workflow(rows, speak, now=now()))
    assert got["seg0"] == ("refined", "A GOOD ONE FOR ALL") and got["seg3"] == ("refined", "A PLAIN GOOD ONE HERE")
    assert got["seg1"][0] == "conflict" and got["seg2"][0] == "error"


def test_sequential_sees_what_came_before(spark):
    def speak(stage, source, draft, critique, near):
        return '{"requires_refine": false}' if stage == "critique" else f"{source[0]}<{near}>"

    rows = translate.sequential(made(spark, "apples and the pears", "berries and the plums"), speak, 1).orderBy("seq").collect()
    assert [r["answer"] for r in rows] == ["a<>", "b<a<>>"]


def test_preflight(spark):
    assert translate.preflight(made(spark, "word " * 30_000), 8192).count() == 3
    assert translate.preflight(made(spark, "short text for the test"), 8192).count() == 0


def test_workspace(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.tex").write_text("\\documentclass{a}")
    (tmp_path / "main.tex").write_text("\\documentclass{article}\n\\input{sub/one}\n")
    (tmp_path / "sub" / "one.tex").write_bytes("caf\u00e9".encode("latin-1"))
    (tmp_path / "other.tex").write_text("x")
    texts = {r["path"]: r["content"] for r in documents.read_texts(spark, str(tmp_path)).collect()}
    assert sorted(texts) == ["main.tex", "other.tex", "sub/one.tex"] and texts["sub/one.tex"] == "café"
    assert [r["path"] for r in documents.project(spark, str(tmp_path)).collect()] == ["main.tex", "sub/one.tex"]
    assert [r["path"] for r in documents.project_from(spark, str(tmp_path), "other.tex").collect()] == ["other.tex"]
    assert documents.under(str(tmp_path), str(tmp_path / "a" / "b")) and not documents.under(str(tmp_path), str(tmp_path / ".." / "x"))


def test_config():
    assert documents.load_config('{"llm": {"key": "${A:-b}", "n": 1}, "x": ["${C}"]}', {"C": "d"}) == {"llm": {"key": "b", "n": 1}, "x": ["d"]}
    for bad in ('{"llm": 1}', "[]", '{"a": "${NOPE_NOT_SET}"}'):
        with pytest.raises((ValueError, KeyError)):
            documents.load_config(bad, {})
