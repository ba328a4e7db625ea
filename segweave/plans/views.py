"""The model's tables as views of a folder of source tables, in DataFrames and in the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import source_hash
from ..schema import SEGMENTS, STATUSES

TAG = r"<[^>]+>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A source table; one that is read in fewer tasks than there are cores is dealt out, as its rows cost more than moving them."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "pages") and rows.rdd.getNumPartitions() < cores else rows


def status_of(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUSES)), (F.pmod(number, F.lit(10)) + 1).cast("int"))


def segments(spark: SparkSession, folder: str, reflection: bool = False) -> DataFrame:
    """Documents as segments: source as namespace, id as order, a status each, translations with planted faults."""
    docs = table(spark, folder, "documents")
    rows = docs.select(
        F.col("source").alias("namespace"),
        F.col("doc_id").alias("seq"),
        F.substring(source_hash(F.col("text")), 1, 12).alias("id"),
        source_hash(F.col("text")).alias("source_hash"),
        F.col("text").alias("source_text"),
        status_of(F.col("doc_id")).alias("status"),
        F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" {"))).otherwise(F.replace(F.col("text"), F.lit("e"), F.lit("E"))).alias("translation"),
    )
    if reflection:
        labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        met = F.struct(F.lit(True).alias("used"), (F.col("quality") == 1).alias("draft_accepted"), F.lit(None).cast("string").alias("critique_feedback"))
        rows = rows.join(labels.withColumnRenamed("doc_id", "seq"), "seq", "left").withColumn("reflection_meta", F.when(F.col("quality").isNotNull(), met))
    empty = {"history": F.array(), "placeholders": F.create_map(), "doc_type": F.lit("segment")}
    return rows.select(*((F.col(f.name) if f.name in rows.columns else empty.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in SEGMENTS.fields))


SEGMENTS_SQL = r"""
seg AS (
  SELECT source AS namespace, doc_id AS seq, text AS source_text,
    sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS source_hash,
    substr(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 12) AS id,
    (['generated','drafted','critiqued','refined','reviewed','approved','locked','conflict','error','deprecated'])[CAST(doc_id % 10 AS INTEGER) + 1] AS status,
    CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 7 = 0 THEN text || ' {' ELSE replace(text, 'e', 'E') END AS translation
  FROM documents)
"""


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as inference records."""
    e = table(spark, folder, "events")
    stage = F.when(F.col("event_type") == "click", "draft").when(F.col("event_type") == "view", "critique").when(F.col("event_type") == "purchase", "refine").otherwise("sequential")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("segment_id"),
        F.concat(F.lit("ns"), (F.col("user_id") % 10).cast("string")).alias("namespace"),
        stage.alias("stage"),
        F.col("ts").alias("started_at"),
        F.col("ts").alias("finished_at"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        F.floor("value").cast("long").alias("prompt_tokens"),
        F.get_json_object("props", "$.k").cast("long").alias("completion_tokens"),
    )


RECORDS_SQL = """
rec AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS segment_id, 'ns' || CAST(user_id % 10 AS VARCHAR) AS namespace,
    CASE event_type WHEN 'click' THEN 'draft' WHEN 'view' THEN 'critique' WHEN 'purchase' THEN 'refine' ELSE 'sequential' END AS stage,
    ts AS started_at, ts AS finished_at, CAST(floor(value * 10) AS BIGINT) AS duration_ms, CAST(floor(value) AS BIGINT) AS prompt_tokens,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS completion_tokens
  FROM events)
"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents as parsed blocks of a namespace each."""
    rows = table(spark, folder, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("namespace"), F.posexplode(F.split("text", "\n")).alias("at", "raw_text"))
    return rows.where(F.trim("raw_text") != "").select("namespace", F.col("at").cast("long").alias("seq"), "raw_text")


def stored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as stored segments: the last of equal lines of a document wins, statuses by their length."""
    rows = lines(spark, folder).withColumn("source_hash", source_hash(F.col("raw_text"))).withColumn("id", F.substring("source_hash", 1, 12))
    one = rows.groupBy("namespace", "id").agg(F.min("seq").alias("seq"), F.max("source_hash").alias("source_hash"), F.max_by("raw_text", "seq").alias("source_text"))
    one = one.withColumn("status", status_of(F.char_length("source_text")))
    one = one.withColumn("translation", F.when(F.col("status") == "generated", "").otherwise(F.replace(F.col("source_text"), F.lit("e"), F.lit("E"))))
    empty = {"history": F.array(), "placeholders": F.create_map(), "doc_type": F.lit("segment")}
    return one.select(*((F.col(f.name) if f.name in one.columns else empty.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in SEGMENTS.fields))


def edited_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The next parse of the same documents: some lines gone, some respaced (same id, other text), some new."""
    rows = lines(spark, folder).where(F.char_length("raw_text") % 11 != 0)
    n = F.char_length("raw_text")
    text = F.when(n % 5 == 0, F.concat(F.lit("New "), "raw_text")).when(n % 7 == 0, F.concat("raw_text", F.lit(" "))).otherwise(F.col("raw_text"))
    rows = rows.withColumn("masked_text", text).withColumn("source_hash", source_hash(F.col("masked_text"))).withColumn("id", F.substring("source_hash", 1, 12))
    one = rows.groupBy("namespace", "id").agg(F.min("seq").alias("seq"), F.max("source_hash").alias("source_hash"), F.max_by("masked_text", "seq").alias("masked_text"))
    return one.withColumn("placeholders", F.create_map().cast("map<string,string>"))


LINES_SQL = r"""
raw AS (SELECT 'doc' || CAST(doc_id AS VARCHAR) AS namespace, string_split(text, chr(10)) AS parts FROM documents),
line AS (SELECT namespace, CAST(u.i - 1 AS BIGINT) AS seq, parts[u.i] AS raw_text FROM raw, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u WHERE trim(parts[u.i]) <> ''),
hashed AS (SELECT *, sha256(trim(regexp_replace(raw_text, '\s+', ' ', 'g'))) AS source_hash FROM line),
stored0 AS (SELECT namespace, substr(source_hash, 1, 12) AS id, min(seq) AS seq, max(source_hash) AS source_hash, arg_max(raw_text, seq) AS source_text FROM hashed GROUP BY 1, 2),
stored1 AS (SELECT *, (['generated','drafted','critiqued','refined','reviewed','approved','locked','conflict','error','deprecated'])[CAST(length(source_text) % 10 AS INTEGER) + 1] AS status FROM stored0),
stored AS (SELECT *, CASE WHEN status = 'generated' THEN '' ELSE replace(source_text, 'e', 'E') END AS translation FROM stored1),
edit0 AS (SELECT namespace, seq, CASE WHEN length(raw_text) % 5 = 0 THEN 'New ' || raw_text WHEN length(raw_text) % 7 = 0 THEN raw_text || ' ' ELSE raw_text END AS masked_text FROM line WHERE length(raw_text) % 11 <> 0),
edit1 AS (SELECT *, sha256(trim(regexp_replace(masked_text, '\s+', ' ', 'g'))) AS source_hash FROM edit0),
fresh AS (SELECT namespace, substr(source_hash, 1, 12) AS id, min(seq) AS seq, max(source_hash) AS source_hash, arg_max(masked_text, seq) AS masked_text FROM edit1 GROUP BY 1, 2)
"""


def masked(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the tags of each line as numbered placeholders, and a draft of each line that loses or invents some."""
    rows = table(spark, folder, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("line", "html")).where(F.trim("html") != "")
    parts = F.split("html", TAG)
    numbered = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit('<macro id="'), i.cast("string"), F.lit('"/>'), p)))
    rows = rows.withColumn("source", F.array_join(numbered, ""))
    n = F.char_length("html")
    draft = (
        F.when(n % 5 == 0, F.regexp_replace("source", '<macro id="1"/>', ""))
        .when(n % 5 == 1, F.concat("source", F.lit('<macro id="1"/>')))
        .when(n % 5 == 2, F.concat("source", F.lit(" $x^2_1$ {")))
        .otherwise(F.col("source"))
    )
    return rows.select("page_id", F.col("line").cast("long").alias("line"), "source", draft.alias("draft"))


MASKED_SQL = r"""
html AS (SELECT page_id, string_split(html, chr(10)) AS parts FROM pages),
hline AS (SELECT page_id, CAST(u.i - 1 AS BIGINT) AS line, parts[u.i] AS html FROM html, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u WHERE trim(parts[u.i]) <> ''),
hpart AS (SELECT page_id, line, html, regexp_split_to_array(html, '<[^>]+>') AS p FROM hline),
msrc AS (SELECT page_id, line, html, (SELECT string_agg(CASE WHEN i = 1 THEN p[i] ELSE '<macro id="' || CAST(i - 1 AS VARCHAR) || '"/>' || p[i] END, '' ORDER BY i) FROM (SELECT unnest(range(1, len(p) + 1)) AS i)) AS source FROM hpart),
mask AS (SELECT page_id, line, source, CASE length(html) % 5 WHEN 0 THEN regexp_replace(source, '<macro id="1"/>', '', 'g') WHEN 1 THEN source || '<macro id="1"/>' WHEN 2 THEN source || ' $x^2_1$ {' ELSE source END AS draft FROM msrc)
"""



#: A LaTeX project around the whole text of every document, and critiques around it, in expressions that both engines read.
TEX_PATH = """CASE WHEN doc_id % 50 = 0 THEN 'top' || CAST(doc_id AS STRING) || '.tex' WHEN doc_id % 50 = 7 THEN 'pack' || CAST(doc_id AS STRING) || '.sty'
WHEN doc_id % 11 = 5 THEN 'd' || CAST(doc_id % 20 AS STRING) || '/v' || CAST(doc_id AS STRING) || '.intro.tex' ELSE 'd' || CAST(doc_id % 20 AS STRING) || '/p' || CAST(doc_id AS STRING) || '.tex' END"""
TEX_CONTENT = """concat(
CASE WHEN doc_id % 50 = 0 THEN '!documentclass[11pt]{article}' || chr(10) || '!usepackage{other, pack' || CAST(doc_id + 7 AS STRING) || '}' || chr(10) ELSE '' END,
'!providecommand{!own', chr(CAST(97 + doc_id % 5 AS INT)), '}[', CAST(doc_id % 4 AS STRING), ']{!emph{#1}}', chr(10),
CASE WHEN doc_id % 3 = 0 THEN '!def!pairs#1#2{(#1, #2)}' || chr(10) || '!newcommand!eq' || chr(CAST(97 + doc_id % 7 AS INT)) || '{!begin{equation}}' || chr(10) ELSE '' END,
'!section{Part ', CAST(doc_id AS STRING), '}', chr(10), replace(replace(replace(coalesce(text, ''), '!', '.'), '{', '('), '}', ')'), chr(10),
'!begin{itemize}', chr(10), '!item One !strange [x] {a}{b}{c} and !odd{a}.', chr(10), '!end{itemize}', chr(10),
'!input{p', CAST(doc_id + 20 AS STRING), '}', chr(10), '!include{d', CAST((doc_id + 1) % 20 AS STRING), '/p', CAST(doc_id + 1 AS STRING), '.tex}', chr(10),
'!input v', CAST(doc_id + 20 AS STRING), '.intro', chr(10), '!subfile{latex.out/top', CAST(doc_id - doc_id % 50 AS STRING), '}', chr(10), '!subfix{gone/top', CAST(doc_id - doc_id % 50 + 50 AS STRING), '.tex}', chr(10))""".replace("!", "' || chr(92) || '")
TEX_CONTENT = TEX_CONTENT.replace("coalesce(text, ''), '' || chr(92) || '', '.')", "coalesce(text, ''), chr(92), '/')")
CRITIQUE = """CASE doc_id % 6
WHEN 0 THEN chr(10) || '```json' || chr(10) || '{"requires_refine": true, "issues": [{"category": "fluency", "description": "stiff"}, {"description": "' || CAST(doc_id AS STRING) || '"}]}' || chr(10) || '```'
WHEN 1 THEN ' First {"a": {"b": 1}} then {"requires_refine": false, "issues": []} and {"a": 2}'
WHEN 2 THEN ' {"requires_refine": true, "issues": [{"category": "accuracy", "description": "lost <macro   id="1" />"}]}'
WHEN 3 THEN ' ```{"requires_refine": false}``` ```json {"requires_refine": "yes"} ```'
WHEN 4 THEN ' {"requires_refine": true, "issues": [{"category": "nope", "description": "x"}]} Done.'
ELSE ' Looks fine.' END"""


def tex_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): a LaTeX project with a file around the whole text of every document."""
    return table(spark, folder, "documents").selectExpr(f"{TEX_PATH} AS path", f"{TEX_CONTENT} AS content")


def critiques(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, critique): a critique of some form after the whole text of every document."""
    return table(spark, folder, "documents").selectExpr("doc_id", f"concat(translate(coalesce(text, ''), '{{}}', '()'), {CRITIQUE}) AS critique")


TEX_SQL = f"tex AS (SELECT {TEX_PATH} AS path, {TEX_CONTENT} AS content FROM documents)"
