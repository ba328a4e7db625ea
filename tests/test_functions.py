"""Text, placeholder, validation and budget functions on stated cases."""

import random
from math import ceil

import pytest
from pyspark.sql import functions as F

from segweave.functions import budget, critique, placeholders, validate
from segweave.functions.text import namespace_of, source_hash, with_linguistic
from segweave.schema import authoring_allowed, resolve_status, transition_allowed

PROSE = ["Hello world", "Hola mundo", 'See Figure <ref id="1"/> for details.', "你好", "مرحبا", '\\section<group_start id="1"/>Introduction<group_end id="1"/>', "Fig. 1"]
NOT_PROSE = ['<macro id="1"/>', '<math id="1"/> . <math id="2"/>', "123.45", "( ) - , .", "", "  \n "]


def test_linguistic(spark):
    rows = spark.createDataFrame([(t, True) for t in PROSE] + [(t, False) for t in NOT_PROSE] + [(None, False)], "source_text string, wanted boolean")
    wrong = [r for r in with_linguistic(rows).collect() if r["linguistic"] != r["wanted"]]
    assert not wrong


def one(spark, column, **values):
    kinds = {str: "string", int: "long", bool: "boolean", dict: "map<string,string>", type(None): "string"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def fixed(spark, source, text):
    row = spark.createDataFrame([(source, text)], "s string, t string")
    return validate.checked(row, "s", "t", "fixed", "error").first()


M1, M2 = '<macro id="1"/>', '<macro id="2"/>'


@pytest.mark.parametrize(
    ("source", "text", "result", "error"),
    [
        (f"a {M1} b {M2}", f"{M2} x {M1}", f"{M2} x {M1}", None),
        (f"a {M1}", "x", "x", "Placeholder mismatch. Missing"),
        (f"a {M1}", f"x {M1} {M2}", f"x {M1} ", None),
        (f"a {M1}", 'x <macro id="1/>', f"x {M1}", "any"),
        (f"a {M1}", f"x {M1}</macro>", f"x {M1}", None),
        (f"a {M1}", f"x {M1} {M1}", f"x {M1} {M1}", "Placeholder mismatch. Count mismatch"),
        ("a {b}", "a {b", "a {b", "Unbalanced braces"),
        ("a", r"a \{", r"a \{", None),
        ("a", "a $x", "a $x", "Unbalanced inline math"),
        ("a", r"a \[ x", r"a \[ x", "Unbalanced display math"),
        ("a", "a^2", "a^2", "Hallucinated unescaped caret"),
        ("a_1^2", "b_1^2", "b_1^2", None),
        ("a", "b_1", "b_1", "Hallucinated unescaped underscore"),
        ('p <comment id="1"/> q', "one\n\ntwo", 'one\n\n<comment id="1"/>two', None),
        ("a", "", "", None),
    ],
)
def test_validation(spark, source, text, result, error):
    row = fixed(spark, source, text)
    if error != "any":
        assert row["fixed"] == result
        assert (row["error"] or "").startswith(error or "") and (row["error"] is None) == (error is None)


def test_unescaped_counts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("\\{}$a") for _ in range(rng.randrange(12))) for _ in range(300)]

    def plain(t):
        n = i = 0
        while i < len(t):
            if t[i] == "\\":
                i += 2
                continue
            n += t[i] == "{"
            i += 1
        return n

    rows = spark.createDataFrame([(t, plain(t)) for t in texts], "t string, n int")
    assert rows.where(validate.unescaped(F.col("t"), "{") != F.col("n")).count() == 0


def test_restore(spark):
    r = one(spark, placeholders.restore(F.col("t"), F.col("m")), t='a <MACRO id="1"/> b', m={M1: r"\x{$1}"})
    assert (r["text"], r["error"]) == (r"a \x{$1} b", None)
    assert one(spark, placeholders.restore(F.col("t"), F.col("m")), t="a", m={M1: "x"})["error"].startswith("missing placeholder")
    assert one(spark, placeholders.restore(F.col("t"), F.col("m")), t=M1 + M2, m={M1: "x"})["error"].startswith("unresolved")


def test_accuracy(spark):
    rows = spark.createDataFrame([(f"a {M1}", f"b {M1}"), (f"a {M1}", "b"), ("a", ""), ("a", "b $")], "s string, d string")
    got = [[i["description"] for i in r["issues"]] for r in validate.with_accuracy(rows, "s", "d").collect()]
    assert got == [[], ["Missing or under-counted placeholder macro#1 (expected 1, got 0)"], ["Draft is empty"], ["Unbalanced inline math ($): found 1 unescaped dollar signs."]]


def test_drift(spark):
    d = placeholders.drift(F.col("a"), F.col("b"))
    assert one(spark, d, a={"k": "v"}, b={"k": "v"}) is None
    assert "fresh" in one(spark, d, a={"k": "v"}, b={})
    assert "persisted" in one(spark, d, a={}, b={"k": "v"})
    assert "missing [j]" in one(spark, d, a={"k": "v"}, b={"j": "v"})
    assert "content" in one(spark, d, a={"k": "v"}, b={"k": "w"})


def test_critiques():
    parse = critique.parse_text
    assert parse('x\n```json\n{"requires_refine": true, "issues": []}\n```')["requires_refine"] is True
    assert parse('{"a": {"requires_refine": 1}} {"requires_refine": false}') == {"requires_refine": False, "issues": [], "repaired": False}
    assert parse('{"requires_refine": true, "issues": [{"category": "accuracy", "description": "<macro id="1"/>"}]}')["repaired"] is True
    assert parse('{"requires_refine": true, "issues": [{"category": "zzz"}]}')["issues"] == []
    assert parse("prose") is parse("") is parse(None) is None


def test_budgets(spark):
    plan = lambda limit, most, fixed, split: one(spark, budget.plan(F.lit(limit), F.lit(most), F.lit(fixed), F.lit(split), F.lit(512), F.lit(1.1), F.lit(48)), x=1)
    assert plan(8192, 2048, 500, False)["reserved_output"] == 2048
    assert plan(8192, 2048, 500, True)["reserved_output"] == 2560
    assert plan(2048, 1024, 2000, False)["infeasible"]
    assert [one(spark, budget.safety_margin(F.lit(n)), x=1) for n in (1000, 10000)] == [64, 200]
    out = lambda n, top: one(spark, budget.adaptive_output(F.lit(n), F.lit(top), F.lit(1.5), F.lit(256), F.lit(64)), x=1)
    assert [out(100, 4096), out(2000, 4096), out(10000, 2048), out(5, 0)] == [256, 3064, 2048, 0]


def test_smallest_limit(spark):
    def least(c):
        lo = next(x for x in range(1, 3000) if x - c - max(64, x // 50) >= 0)
        return lo

    rows = spark.range(0, 2000, 7).select(F.col("id"), budget.smallest_limit(F.col("id"), F.lit(0), F.lit(1.0), F.lit(0), F.lit(0)).alias("n")).collect()
    assert all(r["n"] == least(r["id"]) for r in rows)
    assert one(spark, budget.smallest_limit(F.lit(300_000), F.lit(0), F.lit(1.0), F.lit(0), F.lit(0)), x=1) is None
    assert ceil(1.1) == 2


def test_status(spark):
    assert [one(spark, resolve_status(F.lit(s)), x=1) for s in (" Pending ", "machine_done", "APPROVED", "what")] == ["generated", "refined", "approved", None]
    move = lambda a, b, force=False: one(spark, transition_allowed(F.lit(a), F.lit(b), F.lit(force)), x=1)
    assert move("locked", "approved", True) and not move("locked", "approved") and not move("deprecated", "generated", True) and move("approved", "generated", True)
    assert not one(spark, authoring_allowed(F.lit("locked"), F.lit("reviewed")), x=1)


def test_identity(spark):
    a = one(spark, source_hash(F.col("t")), t=" a \n b\u00a0c ")
    assert a == one(spark, source_hash(F.col("t")), t="a b c")
    assert one(spark, namespace_of(F.col("t")), t="chapters/intro.v2.tex") == "chapters__intro.v2"
