"""Loading, updating, syncing, packing and building segments on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from segweave.functions.similarity import ratio
from segweave.plans import views
from segweave.operators import build, context, graph, memory, sync, telemetry
from segweave.plans.queries import QUERIES
from segweave.schema import INFERENCE, SEGMENTS
from segweave.sources import segments as src

def now():
    return F.lit("2024-01-01 00:00:00")



def made(spark, *rows):
    base = dict(namespace="ns", source_hash="h", source_text="text", status="generated", translation="", doc_type="segment", history=[], placeholders={})
    return spark.createDataFrame([tuple((base | {"seq": i, "id": f"seg{i}"} | r).get(c) for c in SEGMENTS.names) for i, r in enumerate(rows)], SEGMENTS)


@pytest.fixture
def inventory(spark):
    states = ["generated", "reviewed", "approved", "deprecated", "refined", "locked"]
    return made(spark, *({"status": s, "translation": "" if s == "generated" else f"t{i}", "source_text": f"source {i}"} for i, s in enumerate(states)))


def statuses(df):
    return {r["id"]: r["status"] for r in df.collect()}


def test_load(spark, tmp_path):
    row = lambda i, t: json.dumps({"id": i, "source_hash": "h", "source_text": "s", "translation": t, "status": "refined", "extra": 1})
    (tmp_path / "ns.jsonl").write_text("\n".join([row("a", "1"), "{not valid json}", "", row("b", "2"), row("a", "3"), '{"id": "c"}']) + "\n")
    decoded = src.decode(src.read_lines(spark, str(tmp_path)))
    assert [(r["line"], r["namespace"]) for r in src.corrupt_lines(decoded).orderBy("line").collect()] == [(2, "ns"), (6, "ns")]
    kept = src.load(spark, str(tmp_path), skip_corrupt=True).orderBy("seq").collect()
    assert [(r["id"], r["seq"], r["translation"]) for r in kept] == [("a", 1, "3"), ("b", 4, "2")]
    with pytest.raises(Exception, match="corrupt line"):
        src.load(spark, str(tmp_path)).collect()
    out = str(tmp_path / "out")
    src.save(src.load(spark, str(tmp_path), skip_corrupt=True), out)
    assert spark.read.text(out).count() == 2


def test_lines_of_split_files(spark, tmp_path):
    """Line numbers hold where a file is read in many splits."""
    lines = [f"{{\"n\": {i}}}" + " " * (i % 50) if i % 7 else "" for i in range(5000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("x\r\n\r\ny")
    (tmp_path / "c.jsonl").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "8k")
        rows = src.read_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r["line"]: r["value"] for r in rows if r["namespace"] == "a"} == dict(enumerate(lines, 1))
    assert sorted((r["line"], r["value"]) for r in rows if r["namespace"] == "b") == [(1, "x"), (2, ""), (3, "y")] and len(rows) == 5003


def test_reset_prune_export(spark, inventory, tmp_path):
    assert statuses(memory.reset(inventory, now=now()))["seg4"] == "generated"
    forced = memory.reset(inventory, force=True, now=now())
    assert statuses(forced) == {"seg0": "generated", "seg1": "generated", "seg2": "generated", "seg3": "deprecated", "seg4": "generated", "seg5": "locked"}
    assert {r["id"]: len(r["history"]) for r in forced.collect()}["seg1"] == 1
    assert memory.prune(inventory).count() == 5
    src.write_csv(inventory, str(tmp_path / "csv"))
    assert src.read_csv(spark, str(tmp_path / "csv")).count() == 5
    (tmp_path / "x.json").write_text(json.dumps([{"ID": "seg1", "Translation": "neu", "Status": "Approved"}]))
    assert [tuple(r) for r in src.read_json(spark, str(tmp_path / "x.json")).select("id", "translation", "status").collect()] == [("seg1", "neu", "Approved")]


def test_import(spark, inventory):
    rows = spark.createDataFrame([(0, "seg0", "first", None), (1, "seg1", "new", None), (2, "seg2", "t2", "locked"), (3, "seg5", "x", None), (4, "seg4", "bad {", None), (5, "none", "x", None)], "at long, id string, translation string, status string")
    done = {r["id"]: (r["status"], r["outcome"]) for r in memory.imported(inventory, rows, now()).collect()}
    assert done == {"seg0": ("generated", "skipped"), "seg1": ("reviewed", "updated"), "seg2": ("locked", "updated"), "seg3": ("deprecated", None), "seg4": ("refined", "skipped"), "seg5": ("locked", "skipped")}


def test_status_updates(spark, inventory):
    assert statuses(memory.set_status(inventory, "ns", "seg2", "locked", now=now()))["seg2"] == "locked"
    assert statuses(memory.set_status(inventory, "ns", "seg0", "approved", now=now()))["seg0"] == "generated"
    assert statuses(memory.set_status(inventory, "ns", "seg2", "pending", now=now()))["seg2"] == "generated"
    assert memory.by_prefix(inventory, "seg").first()["verdict"] == "ambiguous"
    assert memory.search(inventory, "T1").count() == 1 and memory.search(inventory, "%").count() == 0


def blocks(spark, *texts):
    from segweave.functions.text import source_hash

    rows = spark.createDataFrame([("ns", i, t) for i, t in enumerate(texts)], "namespace string, seq long, masked_text string")
    return rows.withColumn("source_hash", source_hash(F.col("masked_text"))).withColumn("id", F.substring("source_hash", 1, 12)).withColumn("placeholders", F.create_map().cast("map<string,string>"))


def stored(spark, *rows):
    parsed = blocks(spark, *(r[0] for r in rows)).select("seq", F.col("id").alias("_id"), F.col("source_hash").alias("_h"))
    base = made(spark, *({"source_text": t, "status": s, "translation": tr} for t, s, tr in rows))
    return base.join(parsed, "seq").withColumn("id", F.col("_id")).withColumn("source_hash", F.col("_h")).select(*SEGMENTS.names)


def test_sync_carries_over(spark):
    old = stored(spark, ("The quick brown fox jumps.", "reviewed", "Der Fuchs"), ("Same here.", "refined", "Gleich"), ("To go away for good.", "approved", "Weg"))
    out = {r["source_text"]: r for r in sync.merged(old, blocks(spark, "The quick brown fox jumps quickly.", "Same here.", "Nothing like it at all!"), now(), 0.7).collect()}
    carried = out["The quick brown fox jumps quickly."]
    assert (carried["change"], carried["status"], carried["translation"]) == ("carried", "conflict", "Der Fuchs")
    assert (out["Same here."]["change"], out["Same here."]["translation"]) == ("kept", "Gleich")
    assert out["To go away for good."]["change"] == "deprecated" and len(out["To go away for good."]["history"]) == 1
    assert out["Nothing like it at all!"]["change"] == "new"
    none = sync.merged(old, blocks(spark, "The quick brown fox jumps quickly."), now(), 0.99).where("change = 'carried'")
    assert none.count() == 0


def test_sync_drops_what_is_not_valid(spark):
    old = stored(spark, ('The quick brown <macro id="1"/> fox jumps', "reviewed", 'Der <macro id="1"/>'))
    row = sync.merged(old, blocks(spark, 'The quick brown <macro id="1"/> fox <macro id="2"/> jumps'), now(), 0.5).where("change = 'carried'").first()
    assert (row["status"], row["translation"]) == ("conflict", "")


def test_sync_revives(spark):
    old = stored(spark, ("Back again.", "approved", "Wieder da"), ("Stays.", "refined", "Bleibt"))
    gone = sync.merged(old, blocks(spark, "Stays."), now(), None).drop("change")
    back = {r["source_text"]: r for r in sync.merged(gone.select(*SEGMENTS.names), blocks(spark, "Back again.", "Stays."), now(), None).collect()}
    assert back["Back again."]["status"] == "approved" and back["Back again."]["translation"] == "Wieder da"


def test_neighbours(spark):
    rows = made(spark, {"translation": "ta", "refined": ("ra", "m", None)}, {}, {"draft": ("dc", "m", None)}, {"status": "deprecated", "translation": "x"}, {"translation": "te"})
    got = {r["id"]: (r["backward"], r["forward"]) for r in context.neighbours(rows, 1, 1).collect()}
    assert got == {"seg0": ([], ["dc"]), "seg1": (["ta"], ["dc"]), "seg2": (["ta"], ["te"]), "seg3": (["dc"], ["te"]), "seg4": (["dc"], [])}


def test_packing(spark):
    texts = lambda *sizes: ["x" * (4 * n) for n in sizes]
    rows = spark.createDataFrame([(texts(20, 20), [], 30), (texts(5, 5), texts(5, 5), 12), (texts(50, 1), texts(1, 50), 10), (texts(1), [], 0), ([], [], 10)], "b array<string>, f array<string>, room long")
    got = [(r["p"]["tokens"], r["p"]["truncated"]) for r in rows.withColumn("p", context.packed(F.col("b"), F.col("f"), F.col("room"))).collect()]
    assert got == [(20, True), (10, True), (2, True), (0, True), (0, False)]


def test_telemetry(spark):
    rows = [("a", "seg1", "intro", "draft", 10, 5), ("b", "seg1", "intro", "critique", 20, 8), ("c", "seg1", "intro", "refine", 15, 12)]
    df = spark.createDataFrame(rows, "id string, segment_id string, namespace string, stage string, prompt_tokens long, completion_tokens long").withColumn("duration_ms", F.lit(100).cast("long")).withColumn("started_at", now()).withColumn("finished_at", now())
    r = telemetry.workflow_summary(df, "intro").collect()
    assert [(x["used_critique"], x["used_refine"], x["total_tokens"], x["total_duration_ms"]) for x in r] == [(1, 1, 70, 300)]
    assert telemetry.global_summary(df, "other").count() == 0
    assert telemetry.migrated(df).columns == INFERENCE.names


def test_build(spark):
    b = blocks(spark, 'Hi <macro id="1"/>', "No.", "Gone").withColumn("raw_text", F.concat(F.lit(" "), F.replace(F.col("masked_text"), F.lit('<macro id="1"/>'), F.lit("\\x")), F.lit("\n"))).withColumn("translatable", F.lit(True))
    marks = F.when(F.contains(F.col("masked_text"), F.lit("<macro")), F.create_map(F.lit('<macro id="1"/>'), F.lit("\\x"))).otherwise(F.create_map().cast("map<string,string>"))
    b = b.withColumn("placeholders", marks)
    tm = stored(spark, ('Hi <macro id="1"/>', "approved", 'Hallo <macro id="1"/> '), ("No.", "drafted", "Nein."))
    tm = tm.withColumn("placeholders", F.when(F.contains("source_text", F.lit("<macro")), F.create_map(F.lit('<macro id="1"/>'), F.lit("\\x"))).otherwise(F.col("placeholders")))
    rows = build.joined(b, tm)
    assert [(r["text"], r["skipped"]) for r in rows.orderBy("seq").collect()] == [(" Hallo \\x\n", None), (" No.\n", "status=drafted"), (" Gone\n", "segment not in translation memory")]
    assert build.documents(rows).first()["text"] == " Hallo \\x\n No.\n Gone\n"
    with pytest.raises(Exception, match="build blocked"):
        build.checked(rows).collect()
    assert build.checked(rows, allow_partial=True).count() == 3
    assert build.skips(rows).first()["n_skipped"] == 2


def linked(spark, files):
    return {(r["path"], r["target"], r["fallback"]) for r in graph.edges(spark.createDataFrame(list(files.items()), "path string, content string")).collect()}


def test_graph(spark):
    files = spark.createDataFrame([("main.tex", "\\documentclass{a}\\usepackage{mypkg}\\input{chapter1}"), ("chapter1.tex", "\\input{main} % \\input{yes}"), ("mypkg.sty", ""), ("yes.tex", ""), ("no.tex", ""), ("a/b.tex", ""), ("a__b.tex", "")], "path string, content string")
    links = graph.edges(files)
    reached = graph.closure(files.where("path = 'main.tex'").select("path"), links)
    assert [r["path"] for r in reached.collect()] == ["chapter1.tex", "main.tex", "mypkg.sty", "yes.tex"]
    assert graph.collisions(files).first()["paths"] == ["a/b.tex", "a__b.tex"]
    assert [r["path"] for r in graph.roots(files).collect()] == ["main.tex"]


def test_edges(spark):
    files = {
        "a/one.tex": "\\input two \\input{sub/three}\\include{top}\\subfile{latex.out/built}\\subfix{../elsewhere/last}\\input{./v1.intro}\\input{gone}\\input{../top.tex}",
        "a/two.tex": "\\usepackage[x]{here, there}\\RequirePackage{a/inner}",
        "a/sub/three.tex": "\\input{two}",
        "a/there.sty": "", "here.sty": "", "a/inner.sty": "", "top.tex": "\\input{a/one}\\input{a/one.tex}", "built.tex": "", "last.tex": "", "a/v1.intro.tex": "", "two.tex": "", "a/last": "",
    }
    assert linked(spark, files) == {
        ("a/one.tex", "a/two.tex", False), ("a/one.tex", "a/sub/three.tex", False), ("a/one.tex", "top.tex", False), ("a/one.tex", "built.tex", False), ("a/one.tex", "last.tex", True),
        ("a/one.tex", "a/v1.intro.tex", False), ("a/two.tex", "here.sty", False), ("a/two.tex", "a/inner.sty", False), ("a/sub/three.tex", "two.tex", False), ("top.tex", "a/one.tex", False),
    }
    assert linked(spark, {"x.tex": ""}) == set()


def test_deep_closure(spark):
    """Deeper than the levels that are kept apart, with a cycle at the end."""
    links = spark.createDataFrame([(f"p{i:02}", f"p{i + 1:02}") for i in range(12)] + [("p12", "p03")], "path string, target string")
    got = graph.closure(spark.createDataFrame([("p01",)], "path string"), links, merge_every=3).collect()
    assert [r["path"] for r in got] == [f"p{i:02}" for i in range(1, 13)]


def test_analysis(spark):
    files = spark.createDataFrame([("a.tex", "\\newcommand{\\mine}[3]{x}\\newcommand{\\plain}{y}\\providecommand\\other[1]{z}\\def\\pair#1#2{x}\\def\\none{x}\\def\\x#1{y}\\mine{a}{b}{c}\\plain\\other\\emph{x}\\left(\\strange{q}"), ("b.tex", "\\newcommand\\be{\\begin{equation}}\\def\\ee{\\end{equation}}\\newcommand\\bi{\\begin{itemize}}")], "path string, content string")
    defined = graph.definitions(files)
    assert {r["name"]: r["args"] for r in defined.collect()} == {"mine": 2, "other": 1, "pair": 2}
    assert {r["name"]: (r["type"], r["env"]) for r in graph.aliases(files).collect()} == {"be": ("begin", "equation"), "ee": ("end", "equation")}
    known, configured = (spark.createDataFrame([(x,) for x in names], "name string") for names in (["emph"], ["other"]))
    got = {r["name"]: r["args"] for r in graph.unknown(graph.usage(files), known, configured, defined).collect()}
    assert got == {"mine": 2, "plain": 0, "pair": 2, "none": 1, "strange": 1, "be": 1, "ee": 1, "bi": 1}


def test_identity_similarity_against_all_pairs(spark, tmp_path):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["la", "de", "of", "river", "not", "sun", "transformations"]) for _ in range(n)) for n in (3, 8, 20, 60)]
    base += ["今天天气很好我们去公园散步吧", "мы идём в лес", "a" * 12, "x", "ab" * 150]
    lines = base + [t[: len(t) // 2] + "q" + t[len(t) // 2 :] for t in base] + [t + t[: len(t) // 2] for t in base] + [t[::-1] for t in base]
    docs = [(0, "\n".join(lines)), (1, "\n".join(lines[::2])), (2, None), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["identity_similarity"](spark, str(tmp_path)).collect())
    old, new = views.stored_lines(spark, str(tmp_path)).collect(), views.edited_lines(spark, str(tmp_path)).collect()
    known = [{(r["namespace"], r["id"]) for r in side} for side in (old, new)]
    want = [(o["namespace"], o["id"], n["id"], r) for o in old for n in new if o["namespace"] == n["namespace"] and (o["namespace"], o["id"]) not in known[1] and (n["namespace"], n["id"]) not in known[0] and (r := ratio(o["source_text"], n["masked_text"])) >= 0.85]
    assert got == sorted(want) and len(got) > 5
