"""Leases, workspaces, prompts, rules of calls, batches of changes."""

import json
import os
import socket

import pytest
from pyspark.sql import functions as F

from segweave.functions import calls, prompts
from segweave.functions.budget import policy
from segweave.functions.text import truncate_tokens
from segweave.operators import memory, stats, translate
from segweave.sources import leases, workspace
from segweave.sources import segments as src
from segweave.streaming import changelog

from .test_translate import made, now, states


def test_leases(tmp_path):
    folder = str(tmp_path)
    with leases.session(folder, "ns", "sync") as own:
        path = f"{folder}/ns.session"
        assert leases.read(path) == own and own.pid == os.getpid()
        with pytest.raises(leases.Busy) as held, leases.session(folder, "ns"):
            pass
        assert held.value.holder == own
        with leases.session(folder, "other"):
            pass
    assert leases.read(path) is None and not os.listdir(folder)
    dead = leases.Lease(2**22 + 1, socket.gethostname(), "then", "x")
    away = leases.Lease(1, "another-host", "then", "x")
    assert leases.reclaimable(None) and leases.reclaimable(dead) and not leases.reclaimable(away) and not leases.alive(0)
    leases.write(path, dead)
    with leases.session(folder, "ns") as own:
        assert leases.read(path) == own
    leases.write(path, away)
    with pytest.raises(leases.Busy), leases.session(folder, "ns"):
        pass
    (tmp_path / "bad").write_text("{")
    assert leases.read(f"{folder}/bad") is None


def test_locks(tmp_path):
    folder = str(tmp_path)
    with leases.locked(folder, "ns"):
        with pytest.raises(leases.Busy), leases.locked(folder, "ns", tries=2, patience=0.01, pause=0.01):
            pass
    with leases.locked(folder, "ns", patience=0.01):
        pass
    leases.append_lines(f"{folder}/log", ["a", "b"], "batched", last=False)
    assert leases.append_lines(f"{folder}/log", ["c"]) >= 0 and open(f"{folder}/log").read() == "a\nb\nc\n"
    with pytest.raises(ValueError):
        leases.append_lines(f"{folder}/log", [], "never")


def test_workspace(spark, tmp_path):
    path, git = workspace.initialised(str(tmp_path))
    assert not git and workspace.opened(str(tmp_path)).durability == "strict"
    macros = spark.createDataFrame([("mine", 2), ("other", 0)], "name string, args int")
    aliases = spark.createDataFrame([("be", "begin", "equation")], "name string, type string, env string")
    assert workspace.configured(path, macros, aliases) == (2, 1)
    before = os.stat(path).st_mtime_ns
    assert workspace.configured(path, macros, aliases) == (0, 0) and os.stat(path).st_mtime_ns == before
    assert workspace.configured(path, macros.unionByName(spark.createDataFrame([("third", 1)], "name string, args int"))) == (1, 0)
    text = open(path).read()
    assert workspace.initialised(str(tmp_path))[0] == path and open(path).read() == text
    config = workspace.load_config(text)
    assert [m["name"] for m in config["parser"]["custom_macros"]] == ["mine", "other", "third"] and config["parser"]["environment_aliases"]["be"]["env"] == "equation"
    (tmp_path / workspace.SETTINGS / workspace.CONFIG).write_text('{"tm": {"durability": "batched"}}')
    assert workspace.opened(str(tmp_path)).durability == "batched"
    blocks = spark.createDataFrame([("a", 1, "two\n"), ("a", 0, "one "), ("b", 0, "x")], "namespace string, seq long, text string")
    assert workspace.write_document(blocks, "a", f"{tmp_path}/out/a.tex") == 8 and open(f"{tmp_path}/out/a.tex").read() == "one two\n"


def test_prompts(spark, tmp_path):
    (tmp_path / "draft.txt").write_text("  {{ source }}{% if domain %} on {{ domain }}{% endif %}! ")
    rows = spark.createDataFrame([("a", "b"), ("c", ""), ("d", None)], "source string, domain string")
    got = rows.select(prompts.rendered(prompts.source_of("draft", str(tmp_path)), source=F.col("source"), domain=F.col("domain")).alias("p")).collect()
    assert [r["p"] for r in got] == ["a on b!", "c!", "d!"]
    assert prompts.version("draft", str(tmp_path)) != prompts.version("draft") == prompts.version("draft", "/none") and prompts.version("draft").startswith("draft:") and len(prompts.version("draft")) == 14
    assert prompts.version("nothing") == "unknown"


def test_calls(spark):
    first = calls.Attempt(1000)
    second = first.after_starving(4096)
    assert (second.thinking, second.reason, second.number) == ("off", "thinking_disabled", 2)
    third = second.after_starving(4096, 2000)
    assert (third.most, third.reason, third.number) == (3000, "reasoning_budget", 3) and third.after_starving(4096) is None
    assert calls.Attempt(4096, "off").after_starving(4096) is None
    seen = []

    def call(attempt):
        seen.append(attempt)
        if len(seen) == 1:
            raise ConnectionError
        if attempt.most < 1500:
            raise calls.Starved
        return "fine"

    assert calls.answered(call, first, 4096)[0] == "fine" and [a.number for a in seen] == [1, 1, 2, 3]
    with pytest.raises(ValueError):
        calls.answered(lambda a: int("x"), first, 10)
    limited = type("Limited", (Exception,), {"status_code": 429})
    assert calls.retryable(TimeoutError()) and calls.retryable(limited()) and not calls.retryable(ValueError())
    assert calls.thinking_hint("off") == {"reasoning_effort": "none"} and calls.thinking_hint("on") == {}
    speak = calls.routed(lambda stage, *r: "all", critique=lambda stage, *r: stage)
    assert speak("draft", "x") == "all" and speak("critique", "x") == "critique"
    said = spark.range(1).select(calls.footprint_error(F.lit(100), F.lit(50), F.lit(247), F.lit(1.5), F.lit(48)).alias("a"), calls.footprint_error(F.lit(100), F.lit(50), F.lit(248), F.lit(1.5), F.lit(48)).alias("b"), calls.output_fault(F.lit(True), F.lit(" ")).alias("c"), policy(F.lit("nowhere"))["floor"].alias("d"), truncate_tokens(F.lit("abcd efgh ijkl"), F.lit(1)).alias("e")).first()
    assert "effective_prompt=150" in said["a"] and said["b"] is None and said["c"] == "empty_output" and said["d"] == 1536 and said["e"] == "abcd ef"
    assert stats.window_average({"a": 2, "b": 4}) == 3.0 and stats.window_average(5) == 5.0 and stats.window_average(None) == 3.0


def test_retries_of_stages(spark):
    """A critique without JSON is asked for once more; refinements are told what was wrong, and given up after three."""
    texts = ["the one that is mended", "the one that never is", "one to be left alone now", "one that breaks the call"]

    def speak(stage, source, draft, critique, near):
        if "alone" in source:
            raise calls.Precondition
        if "breaks" in source:
            raise OSError("gone")
        if stage == "critique":
            return '{"requires_refine": true, "issues": []}' if draft.endswith(translate.HINT) else "prose"
        if stage == "refine" and "mended" in source and critique.count("Validation Error") == 2 and "Unbalanced" in critique:
            return source.upper()
        return source + " {" if stage == "refine" or "never" in source else source

    rows = made(spark, *texts)
    got = translate.workflow(rows, speak, now=now())
    state = states(got)
    assert state["seg0"] == ("refined", "THE ONE THAT IS MENDED") and state["seg1"][0] == "conflict" and state["seg2"] == ("generated", "") and state["seg3"][0] == "error"
    assert "gone" in [r for r in got.collect() if r["id"] == "seg3"][0]["error_meta"]["message"]
    with translate.abortable(spark, "g"):
        translate.abort(spark, "other")


def test_changes(spark, tmp_path):
    target, rows = str(tmp_path / "t"), lambda *r: spark.createDataFrame(r, "id string, at long, v string")
    record = spark.createDataFrame([("r",)], "id string")
    assert changelog.append(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")), target, 0, ["id"], "at", telemetry=record, telemetry_target=f"{tmp_path}/m") >= 0
    changelog.append(rows(("a", 3, "w")), target, 1, ["id"], "at", out=f"{tmp_path}/out")
    assert {r["id"]: r["v"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a": "w", "b": "z"}
    assert spark.read.parquet(f"{tmp_path}/m").first()["checkpoint_ms"] >= 0


def test_appended_lines(spark, tmp_path):
    rows = made(spark, "one of them", "two of them").withColumn("translation", F.when(F.col("seq") == 0, "eins").otherwise(""))
    src.append(rows, str(tmp_path / "tm"))
    again = memory.succeed(rows, F.col("seq") == 1, F.lit("zwei"), now())
    src.append(again.where("seq = 1"), str(tmp_path / "tm"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "tm")).collect()]
    assert len(lines) == 3
    before = {r["id"]: (r["translation"], r["before"]) for r in memory.latest(again.withColumn("history", memory.archived(now())).withColumn("translation", F.lit("neu"))).collect()}
    assert before["seg1"] == ("neu", "zwei")
