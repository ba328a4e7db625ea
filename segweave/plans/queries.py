"""The catalogue: each operator over the views, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import budget, calls, critique, latex, prompts, validate
from ..functions import placeholders as ph
from ..functions.similarity import close_ratio, upper_bound
from ..functions.text import is_linguistic, linguistic_features, namespace_of, preview, source_hash, strip, token_count, tokenizer_count, truncate_tokens, with_linguistic
from ..operators import build, context, graph, memory, stats, sync, telemetry, translate
from ..schema import STATUSES, TRANSITIONS, authoring_allowed, resolve_status, transition_allowed
from ..sources import segments
from ..sources.segments import exported, last_wins, with_positions
from ..streaming import changelog
from . import views
from .views import LINES_SQL, MASKED_SQL, RECORDS_SQL, SEGMENTS_SQL, TEX_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
def now():
    return F.lit("2024-01-01 00:00:00")



def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Registers a query, with the SQL of its rows where SQL has any."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = ("WITH " + ", ".join(c.strip() for c in ctes) + " " if ctes else "") + sql
        return fn

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"

# ---------------------------------------------------------------- telemetry


@query("SELECT count(*) AS total_requests, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms FROM rec HAVING count(*) > 0", RECORDS_SQL)
def telemetry_global_summary(spark, d):
    return telemetry.global_summary(views.records(spark, d))


@query("SELECT stage, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(duration_ms) AS DOUBLE) / count(duration_ms) AS avg_duration_ms FROM rec GROUP BY stage", RECORDS_SQL)
def telemetry_stage_breakdown(spark, d):
    return telemetry.stage_breakdown(views.records(spark, d))


@query("SELECT segment_id, stage, count(id) AS inference_count, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens FROM rec GROUP BY 1, 2", RECORDS_SQL)
def telemetry_stage_metrics(spark, d):
    return telemetry.stage_metrics(views.records(spark, d))


_WORKFLOW = (
    "SELECT segment_id, namespace, " + STAMP.format("min(started_at)") + " AS started_at, " + STAMP.format("max(finished_at)") + " AS finished_at, "
    "CAST(max(CASE WHEN stage = 'critique' THEN 1 ELSE 0 END) AS INTEGER) AS used_critique, CAST(max(CASE WHEN stage = 'refine' THEN 1 ELSE 0 END) AS INTEGER) AS used_refine, "
    "CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM rec {0} GROUP BY 1, 2"
)


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({c: stamp(c) for c in ("started_at", "finished_at")})


@query(_WORKFLOW.format(""), RECORDS_SQL)
def telemetry_workflow_metrics(spark, d):
    return _stamped(telemetry.workflow_metrics(views.records(spark, d)))


@query(_WORKFLOW.format("WHERE namespace = 'ns3'") + " ORDER BY started_at, segment_id", RECORDS_SQL)
def telemetry_workflow_summary(spark, d):
    return _stamped(telemetry.workflow_summary(views.records(spark, d), "ns3"))


@query("SELECT segment_id AS id, arg_max(stage, CAST(id AS BIGINT)) AS stage, arg_max(prompt_tokens, CAST(id AS BIGINT)) AS prompt_tokens FROM rec GROUP BY 1", RECORDS_SQL)
def telemetry_upsert(spark, d):
    rows = views.records(spark, d).select(F.col("segment_id").alias("id"), F.col("id").cast("long").alias("at"), "stage", "prompt_tokens")
    return telemetry.upserted(rows, "at").select("id", "stage", "prompt_tokens")


@query("SELECT id, segment_id, stage, 1::BIGINT AS attempt, 0::BIGINT AS reasoning_tokens, 'locally_estimated' AS usage_source, prompt_tokens FROM rec", RECORDS_SQL)
def telemetry_migration(spark, d):
    return telemetry.migrated(views.records(spark, d)).select("id", "segment_id", "stage", "attempt", "reasoning_tokens", "usage_source", "prompt_tokens")


# ---------------------------------------------------------------- text and the linguistic rules

_PLAIN = r"""
feat0 AS (SELECT key, text, trim(regexp_replace(regexp_replace(text, '<[a-z_]+ id="[0-9]+"/>', '', 'g'), '\\[a-z]+([A-Za-z])', '\1', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS plain,
    length(text) - length(regexp_replace(text, '<[a-z_]+ id="[0-9]+"/>', '', 'g')) AS marks FROM src),
feat AS (SELECT key, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' AS blank, CASE WHEN length(text) > 0 THEN CAST(marks AS DOUBLE) / length(text) ELSE 0.0 END AS placeholder_ratio,
    CAST(len(regexp_extract_all(plain, '[a-zA-ZÀ-ɏЀ-ӿ]{3,}')) AS INTEGER) AS words,
    CAST(length(regexp_replace(plain, '[^\p{L}]', '', 'g')) AS INTEGER) AS alpha,
    CAST(len(regexp_extract_all(plain, '#[0-9]')) AS INTEGER) AS params,
    CAST(len(regexp_extract_all(plain, '(?i)(?:[0-9]*\.[0-9]+|[0-9]+)\s*(?:in|pt|em|ex|true|false)(?:[^\p{L}\p{N}_]|$)')) AS INTEGER) AS dimensions,
    CAST(len(regexp_extract_all(plain, '@[\p{L}\p{N}_]+')) AS INTEGER) AS ats,
    regexp_matches(plain, '(?i)(?:^|[^\p{L}\p{N}_])(?:the|and|or|for|with|from|that|this|are|was|were|have|has|been|will|see|fig|figure|hello|hola)(?:[^\p{L}\p{N}_]|$)') AS hint,
    regexp_matches(plain, '[\p{L}\p{N}_][.!?](?:\s|$)') AS sentence,
    regexp_matches(plain, '[一-鿿぀-ヿ가-힯؀-ۿ]{2,}') AS non_latin FROM feat0),
ling AS (SELECT key, CASE WHEN blank OR alpha = 0 THEN false WHEN non_latin THEN true WHEN words = 0 THEN false WHEN params >= 2 THEN false
    WHEN params = 0 AND placeholder_ratio < 0.85 AND words = 1 AND alpha >= 3 AND dimensions = 0 AND ats = 0 THEN true
    WHEN hint AND params = 0 AND alpha >= 5 AND placeholder_ratio < 0.85 THEN true
    WHEN params >= 1 AND (placeholder_ratio > 0.15 OR alpha < 25) THEN false
    WHEN words >= 3 AND hint THEN true WHEN words >= 2 AND alpha >= 8 AND params = 0 AND (hint OR sentence) THEN true
    WHEN dimensions >= 2 AND placeholder_ratio > 0.3 THEN false WHEN ats >= 2 AND alpha < 30 THEN false
    WHEN placeholder_ratio > 0.7 AND alpha < 40 THEN false WHEN placeholder_ratio > 0.5 AND words < 2 THEN false
    WHEN words = 1 AND alpha < 12 THEN false ELSE alpha >= 8 END AS linguistic FROM feat)
"""
_BY_DOC = "src AS (SELECT doc_id AS key, text FROM documents)"
_BY_SEG = "src AS (SELECT seq AS key, source_text AS text FROM seg)"


@query("SELECT key AS doc_id, words, alpha, params, dimensions, ats, hint, sentence, non_latin, placeholder_ratio FROM feat", _BY_DOC, _PLAIN)
def linguistic_text_features(spark, d):
    rows = linguistic_features(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", *(f"features.{c}" for c in ("words", "alpha", "params", "dimensions", "ats", "hint", "sentence", "non_latin", "placeholder_ratio")))


@query("SELECT page_id, line, linguistic FROM mask JOIN ling ON ling.key = page_id * 100000 + line", MASKED_SQL, "src AS (SELECT page_id * 100000 + line AS key, source AS text FROM mask)", _PLAIN)
def linguistic_filter_masked(spark, d):
    return with_linguistic(views.masked(spark, d), "source").select("page_id", "line", "linguistic")


@query("SELECT key AS doc_id FROM ling WHERE linguistic", _BY_DOC, _PLAIN)
def linguistic_filter(spark, d):
    rows = linguistic_features(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.where(is_linguistic()).select("doc_id")


@query("SELECT seq AS doc_id, source_hash, id, CAST(floor(length(source_text) / 4) AS BIGINT) AS tokens, CASE WHEN length(source_text) > 50 THEN substr(source_text, 1, 50) || '...' ELSE source_text END AS preview FROM seg", SEGMENTS_SQL)
def segment_identity(spark, d):
    h = source_hash(F.col("text"))
    return table(spark, d, "documents").select("doc_id", h.alias("source_hash"), F.substring(h, 1, 12).alias("id"), token_count(F.col("text")).alias("tokens"), preview(F.col("text")).alias("preview"))


@query("SELECT namespace, id, min(seq) AS seq, arg_max(status, seq) AS status, arg_max(translation, seq) AS translation FROM seg GROUP BY 1, 2", SEGMENTS_SQL)
def tm_last_wins(spark, d):
    rows = views.segments(spark, d).select("namespace", "id", F.col("seq").alias("line"), "status", "translation")
    return last_wins(rows).select("namespace", "id", "seq", "status", "translation")


@query("SELECT id, count(*) AS n, min(seq) AS first_seq FROM seg GROUP BY id HAVING count(*) > 1", SEGMENTS_SQL)
def duplicate_paragraphs(spark, d):
    return views.segments(spark, d).groupBy("id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).where("n > 1")


@query("SELECT DISTINCT namespace FROM seg ORDER BY 1", SEGMENTS_SQL)
def tm_namespaces(spark, d):
    return views.segments(spark, d).select("namespace").distinct().orderBy("namespace")


@query("SELECT namespace, id, seq, CAST(row_number() OVER (PARTITION BY namespace ORDER BY seq) - 1 AS BIGINT) AS position FROM seg WHERE status <> 'deprecated'", SEGMENTS_SQL)
def tm_positions(spark, d):
    return with_positions(views.segments(spark, d)).select("namespace", "id", "seq", "position")


# ---------------------------------------------------------------- statistics

_STATS = (
    "stat AS (SELECT namespace, "
    + ", ".join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS \"{s}\", CAST(coalesce(sum(tok) FILTER (status = '{s}'), 0) AS BIGINT) AS tokens_{s}" for s in STATUSES)
    + ", count(*) AS total, CAST(sum(tok) AS BIGINT) AS tokens_total, CAST(coalesce(sum(tok) FILTER (status = 'generated'), 0) AS BIGINT) AS tokens_pending, "
    "count(*) FILTER (q IS NOT NULL) AS reflection_used, count(*) FILTER (q = 1) AS draft_accepted, count(*) FILTER (q <> 1) AS reflection_refined, "
    "CAST(floor(count(*) FILTER (linguistic) * 600.0::DOUBLE * (2.0::DOUBLE + 0.7::DOUBLE) + coalesce(sum(tok) FILTER (linguistic), 0)::DOUBLE * (1.2::DOUBLE * 3.0::DOUBLE * (2.0::DOUBLE + 0.7::DOUBLE) + 2.4::DOUBLE)) AS BIGINT) AS tokens_reflection_estimate "
    "FROM (SELECT seg.*, floor(length(source_text) / 4) AS tok, linguistic, q FROM seg JOIN ling ON ling.key = seq LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = seq) GROUP BY namespace)"
)
_STAT_CTES = (SEGMENTS_SQL, _BY_SEG, _PLAIN, _STATS)


def _stats(spark, d):
    return stats.namespace_stats(views.segments(spark, d, reflection=True))


@query("SELECT * FROM stat", *_STAT_CTES)
def tm_status_counts(spark, d):
    return _stats(spark, d)


@query("SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in [f'"{s}"' for s in STATUSES] + [f"tokens_{s}" for s in STATUSES] + ["total", "tokens_total", "tokens_pending", "reflection_used", "draft_accepted", "reflection_refined", "tokens_reflection_estimate"]) + " FROM stat", *_STAT_CTES)
def tm_status_all(spark, d):
    return stats.global_stats(_stats(spark, d))


@query("SELECT s.namespace, st AS status, count(seg.id) AS n, CAST(coalesce(sum(floor(length(source_text) / 4)), 0) AS BIGINT) AS tokens, round(count(seg.id) * 100.0::DOUBLE / any_value(total), 1) AS percent FROM (SELECT namespace, total, unnest([" + ", ".join(f"'{s}'" for s in STATUSES) + "]) AS st FROM stat) s LEFT JOIN seg ON seg.namespace = s.namespace AND seg.status = st GROUP BY 1, 2", *_STAT_CTES)
def tm_status_shares(spark, d):
    return stats.status_shares(_stats(spark, d))


@query("SELECT namespace, count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'generated') AS generated FROM seg GROUP BY 1", SEGMENTS_SQL)
def tm_namespace_overview(spark, d):
    return stats.overview(views.segments(spark, d))


@query("SELECT namespace, count(*) FILTER (status IN ('conflict', 'error')) AS blocked FROM seg GROUP BY 1", SEGMENTS_SQL)
def tm_blocked(spark, d):
    return stats.blocked(views.segments(spark, d))


@query("SELECT namespace, tokens_total * 5.0::DOUBLE / 1e6::DOUBLE AS cost_total, tokens_pending * 5.0::DOUBLE / 1e6::DOUBLE AS cost_pending, tokens_reflection_estimate * 5.0::DOUBLE / 1e6::DOUBLE AS cost_reflection_estimate FROM stat", *_STAT_CTES)
def tm_cost_estimate(spark, d):
    return stats.costs(_stats(spark, d))


@query("SELECT namespace, arg_max(id, (tok, -seq)) AS id, CAST(max(tok) AS BIGINT) AS tokens FROM (SELECT *, CAST(floor(length(source_text) / 4) AS BIGINT) AS tok FROM seg) GROUP BY 1", SEGMENTS_SQL)
def preflight_worst(spark, d):
    return stats.worst_source(views.segments(spark, d))


# ---------------------------------------------------------------- filters and updates


def _ids(df: DataFrame) -> DataFrame:
    return df.select("namespace", "seq", "id", "status")


_IDS = "SELECT namespace, seq, id, status FROM seg WHERE "


@query(_IDS + "contains(lower(translation), 'thE%'::VARCHAR) OR contains(lower(translation), 'ent')", SEGMENTS_SQL)
def tm_search_translation(spark, d):
    return _ids(memory.search(views.segments(spark, d), "Ent"))


@query(_IDS + "contains(lower(source_text), 'the on')", SEGMENTS_SQL)
def tm_search_source(spark, d):
    return _ids(memory.search(views.segments(spark, d), "The On", in_source=True))


@query(_IDS + "status = 'refined' AND (contains(lower(source_text), 'une') OR contains(lower(translation), 'une'))", SEGMENTS_SQL)
def tm_list_filtered(spark, d):
    return _ids(memory.listed(views.segments(spark, d), "machine_done", "une"))


@query("SELECT raw, CASE lower(trim(raw)) WHEN 'untranslated' THEN 'generated' WHEN 'pending' THEN 'generated' WHEN 'machine_done' THEN 'refined' WHEN 'nonsense' THEN NULL ELSE lower(trim(raw)) END AS status, n FROM (SELECT CASE event_type WHEN 'click' THEN ' Pending ' WHEN 'view' THEN 'MACHINE_DONE' WHEN 'purchase' THEN 'nonsense' WHEN 'signup' THEN 'untranslated' ELSE 'Approved' END AS raw, count(*) AS n FROM events GROUP BY 1)")
def status_alias_resolve(spark, d):
    e = F.col("event_type")
    raw = F.when(e == "click", " Pending ").when(e == "view", "MACHINE_DONE").when(e == "purchase", "nonsense").when(e == "signup", "untranslated").otherwise("Approved")
    return table(spark, d, "events").groupBy(raw.alias("raw")).agg(F.count("*").alias("n")).select("raw", resolve_status(F.col("raw")).alias("status"), "n")


@query(_IDS + "status IN ('refined', 'reviewed') AND trim(translation) <> ''", SEGMENTS_SQL)
def review_queue(spark, d):
    return _ids(views.segments(spark, d).where(memory.reviewable()))


@query(_IDS + "status IN ('generated', 'error')", SEGMENTS_SQL)
def eligible_sequential(spark, d):
    return _ids(views.segments(spark, d).where(memory.eligible_sequential()))


@query(_IDS + "status = 'reviewed' AND starts_with(id, 'a')", SEGMENTS_SQL)
def eligible_sequential_forced(spark, d):
    return _ids(views.segments(spark, d).where(memory.eligible_sequential(force=True, status="reviewed", prefix="a")))


@query("SELECT namespace, seq, id, status, status IN ('generated', 'error') AS draft, status NOT IN ('locked', 'deprecated') AS draft_forced, status = 'drafted' AS critique, status = 'critiqued' AS refine FROM seg", SEGMENTS_SQL)
def eligible_stages(spark, d):
    e = memory.eligible_stage
    return views.segments(spark, d).select("namespace", "seq", "id", "status", e("draft").alias("draft"), e("draft", True).alias("draft_forced"), e("critique").alias("critique"), e("refine").alias("refine"))


@query("SELECT namespace, 'a1' AS prefix, count(*) FILTER (starts_with(id, 'a1')) AS n, min(CASE WHEN starts_with(id, 'a1') THEN id END) AS id, CASE count(*) FILTER (starts_with(id, 'a1')) WHEN 0 THEN 'not found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS verdict FROM seg GROUP BY 1", SEGMENTS_SQL)
def segment_by_prefix(spark, d):
    return memory.by_prefix(views.segments(spark, d), "a1")


_RULES = "rule(frm, tos) AS (VALUES " + ", ".join(f"('{a}', [{', '.join(repr(b) for b in bs)}]::VARCHAR[])" for a, bs in TRANSITIONS.items()) + ")"
_PAIRS = "pair AS (SELECT a.frm AS f, b.frm AS t, force, a.tos AS tos FROM rule a, rule b, (VALUES (true), (false)) x(force))"


def _pairs(spark):
    every = F.array(*map(F.lit, STATUSES))
    return spark.range(1).select(F.explode(every).alias("f")).select("f", F.explode(every).alias("t")).select("f", "t", F.explode(F.array(F.lit(True), F.lit(False))).alias("force"))


@query("SELECT f, t, force, CASE WHEN f = t THEN true WHEN f = 'deprecated' THEN false WHEN f = 'locked' AND NOT force THEN false WHEN t = 'generated' AND force THEN true ELSE list_contains(tos, t) END AS allowed FROM pair", _RULES, _PAIRS)
def transition_check(spark, d):
    return _pairs(spark).select("f", "t", "force", transition_allowed(F.col("f"), F.col("t"), F.col("force")).alias("allowed"))


@query("SELECT DISTINCT f, t, CASE WHEN f = t THEN true WHEN f IN ('locked', 'deprecated') THEN false ELSE t IN ('generated', 'conflict', 'reviewed', 'approved') END AS allowed FROM pair", _RULES, _PAIRS)
def human_authoring_check(spark, d):
    return _pairs(spark).select("f", "t", authoring_allowed(F.col("f"), F.col("t")).alias("allowed")).distinct()


_RESET = "status IN ('refined', 'conflict', 'error', 'drafted', 'critiqued', 'reviewed', 'approved')"


@query(f"SELECT namespace, seq, id, CASE WHEN {_RESET} THEN 'generated' ELSE status END AS status, CASE WHEN {_RESET} THEN '' ELSE translation END AS translation, CAST(CASE WHEN {_RESET} AND translation <> '' THEN 1 ELSE 0 END AS INTEGER) AS archived FROM seg", SEGMENTS_SQL)
def tm_reset(spark, d):
    return memory.reset(views.segments(spark, d), force=True, now=now()).select("namespace", "seq", "id", "status", "translation", F.size("history").alias("archived"))


@query(_IDS + "status <> 'deprecated'", SEGMENTS_SQL)
def tm_prune(spark, d):
    return _ids(memory.prune(views.segments(spark, d)))


@query('SELECT id AS "ID", status AS "Status", source_text AS "Source", translation AS "Translation" FROM seg WHERE status <> \'deprecated\'', SEGMENTS_SQL)
def tm_export(spark, d):
    return exported(views.segments(spark, d))


_IMPORT = r"""
imp AS (SELECT id, arg_max(CASE WHEN seq % 3 = 0 THEN replace(source_text, 'a', 'A') WHEN seq % 3 = 1 THEN translation ELSE source_text || ' $' END, seq) AS t,
               arg_max(CASE WHEN seq % 2 = 0 THEN 'Approved' ELSE 'bogus' END, seq) AS s FROM seg GROUP BY id),
one AS (SELECT namespace, id, min(seq) AS seq, arg_max(status, seq) AS status, arg_max(source_text, seq) AS source_text, arg_max(translation, seq) AS translation FROM seg GROUP BY 1, 2),
chk AS (SELECT one.*, t, lower(s) AS s, status IN ('refined', 'reviewed', 'approved', 'conflict') AS legal, t <> source_text || ' {' AS sound FROM one JOIN imp USING (id)),
act AS (SELECT *, t <> '' AND status NOT IN ('locked', 'deprecated') AND translation <> t AND legal AND sound
             AND NOT (length(regexp_replace(t, '\\.', '', 'g')) - length(replace(regexp_replace(t, '\\.', '', 'g'), '$', ''))) % 2 <> 0 AS writes,
          t <> '' AND status NOT IN ('locked', 'deprecated') AND translation = t AND s = 'approved' AND status IN ('refined', 'reviewed', 'conflict') AND NOT contains(translation, '{')
             AND (length(regexp_replace(translation, '\\.', '', 'g')) - length(replace(regexp_replace(translation, '\\.', '', 'g'), '$', ''))) % 2 = 0 AS moves FROM chk)
"""


@query("SELECT namespace, seq, id, CASE WHEN writes THEN 'reviewed' WHEN moves THEN 'approved' ELSE status END AS status, CASE WHEN writes THEN t ELSE translation END AS translation, CASE WHEN writes OR moves THEN 'updated' ELSE 'skipped' END AS outcome FROM act", SEGMENTS_SQL, _IMPORT)
def tm_import_apply(spark, d):
    seg = views.segments(spark, d)
    n = F.col("seq")
    text = F.when(n % 3 == 0, F.replace(F.col("source_text"), F.lit("a"), F.lit("A"))).when(n % 3 == 1, F.col("translation")).otherwise(F.concat("source_text", F.lit(" $")))
    rows = seg.select(F.col("seq").alias("at"), "id", text.alias("translation"), F.when(n % 2 == 0, "Approved").otherwise("bogus").alias("status"))
    one = last_wins(seg.withColumnRenamed("seq", "line"))
    return memory.imported(one, rows, now()).select("namespace", "seq", "id", "status", "translation", "outcome")


@query("SELECT namespace, count(*) FILTER (status <> 'deprecated') AS active, count(*) FILTER (status = 'drafted') AS drafted, CASE WHEN count(*) FILTER (status <> 'deprecated') = 0 THEN 'no active segments' WHEN count(*) FILTER (status IN ('drafted', 'critiqued')) > 0 THEN 'in mid-pipeline' WHEN count(*) FILTER (status IN ('generated', 'error')) > 0 THEN 'eligible' WHEN count(*) FILTER (status IN ('conflict', 'error')) > 0 THEN 'blocked' ELSE 'already translated' END AS reason FROM seg GROUP BY 1", SEGMENTS_SQL)
def idle_classification(spark, d):
    return memory.idle_reason(views.segments(spark, d)).select("namespace", "active", "drafted", "reason")


@query("SELECT namespace, seq, id, CASE WHEN seq % 4 = 1 AND status NOT IN ('locked', 'deprecated') THEN 'reviewed' ELSE status END AS status, CASE WHEN seq % 4 = 1 AND status NOT IN ('locked', 'deprecated') THEN source_text ELSE translation END AS translation FROM one WHERE (length(regexp_replace(source_text, '\\\\.', '', 'g')) - length(replace(regexp_replace(source_text, '\\\\.', '', 'g'), '$', ''))) % 2 = 0", SEGMENTS_SQL, "one AS (SELECT namespace, id, min(seq) AS seq, arg_max(status, seq) AS status, arg_max(source_text, seq) AS source_text, arg_max(translation, seq) AS translation FROM seg GROUP BY 1, 2)")
def human_submit(spark, d):
    one = last_wins(views.segments(spark, d).withColumnRenamed("seq", "line"))
    edits = one.where("seq % 4 = 1").select("namespace", "id", F.col("source_text").alias("text"), F.lit("reviewed").alias("to_status"))
    even = validate.unescaped(F.col("source_text"), "$") % 2 == 0
    return memory.submitted(one, edits, now()).where(even).select("namespace", "seq", "id", "status", "translation")


# ---------------------------------------------------------------- sync

_SYNC = r"""
pairs AS (SELECT coalesce(s.namespace, f.namespace) AS namespace, coalesce(s.id, f.id) AS id, s.seq, f.seq AS new_seq, s.status, s.translation, s.source_text, f.masked_text
         FROM (SELECT * FROM stored WHERE namespace IN (SELECT namespace FROM fresh)) s FULL OUTER JOIN fresh f ON s.namespace = f.namespace AND s.id = f.id),
act AS (SELECT *, CASE WHEN seq IS NULL OR new_seq IS NULL THEN NULL WHEN status = 'deprecated' THEN 'restart' WHEN source_text = masked_text THEN 'keep'
        WHEN translation <> '' AND status IN ('locked', 'approved', 'reviewed') THEN 'conflict' WHEN status IN ('refined', 'drafted', 'critiqued', 'generated', 'error') THEN 'restart' ELSE 'retext' END AS action FROM pairs),
syn AS (SELECT namespace, id, coalesce(new_seq, seq + 1099511627776) AS seq,
        CASE WHEN seq IS NULL THEN 'generated' WHEN new_seq IS NULL THEN 'deprecated' WHEN action = 'restart' THEN 'generated' WHEN action = 'conflict' THEN 'conflict' ELSE status END AS status,
        CASE WHEN seq IS NULL OR action = 'restart' THEN '' ELSE translation END AS translation, coalesce(masked_text, source_text) AS source_text,
        CASE WHEN seq IS NULL THEN 'new' WHEN new_seq IS NULL AND status <> 'deprecated' THEN 'deprecated' WHEN new_seq IS NULL THEN 'gone' WHEN action = 'conflict' THEN 'conflict'
             WHEN source_text <> masked_text OR (action = 'restart' AND status <> 'generated') THEN 'updated' ELSE 'kept' END AS change FROM act)
"""


def _synced(spark, d, threshold=None):
    return sync.merged(views.stored_lines(spark, d), views.edited_lines(spark, d), now(), threshold)


@query("SELECT * FROM syn", LINES_SQL, _SYNC)
def sync_merge(spark, d):
    return _synced(spark, d).select("namespace", "id", "seq", "status", "translation", "source_text", "change")


@query("SELECT namespace, count(*) FILTER (change = 'new') AS new_segments, count(*) FILTER (change IN ('updated', 'conflict')) AS updated_segments, count(*) FILTER (change = 'conflict') AS new_conflicts, count(*) FILTER (change = 'deprecated') AS deprecated_marked, count(*) FILTER (status <> 'deprecated') AS total_active FROM syn GROUP BY 1", LINES_SQL, _SYNC)
def sync_counters(spark, d):
    return sync.counters(_synced(spark, d))


@query()
def sync_with_carryover(spark, d):
    return sync.counters(_synced(spark, d, 0.85))


@query()
def identity_alignment(spark, d):
    return sync.carryovers(views.stored_lines(spark, d), views.edited_lines(spark, d), 0.85)


@query()
def identity_similarity(spark, d):
    """Stored lines against new lines of the same document, where neither's id is known to the other side: pairs with a ratio
    of 0.85. Lengths meet in buckets: a ratio of 0.85 needs lengths that differ by less than a factor of 1.36."""
    size = lambda c: F.floor(F.log(F.greatest(F.char_length(c), F.lit(1))) / F.log(F.lit(1.36))).cast("int")
    old, new = views.stored_lines(spark, d), views.edited_lines(spark, d)
    lost = old.join(new.select("namespace", "id"), ["namespace", "id"], "left_anti").select("namespace", F.col("id").alias("old_id"), F.col("source_text").alias("a"), size("source_text").alias("size"))
    fresh = new.join(old.select("namespace", "id"), ["namespace", "id"], "left_anti").select("namespace", F.col("id").alias("new_id"), F.col("masked_text").alias("b"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: size("masked_text") + i)).alias("size"))
    near = lost.join(fresh, ["namespace", "size"]).where(upper_bound(F.col("a"), F.col("b")) >= 0.85)
    return near.withColumn("ratio", close_ratio("a", "b", 0.85)).where("ratio is not null").select("namespace", "old_id", "new_id", "ratio")


# ---------------------------------------------------------------- placeholders and validation

_TOK = "regexp_extract_all(lower({0}), '<[a-z_]+ id=\"[0-9]+\"/>')"
_FIXED = "fix AS (SELECT page_id, line, source, draft, CASE WHEN source = '' OR NOT contains(draft, '<macro id=\"1\"/>') OR contains(source, '<macro id=\"1\"/>') THEN draft ELSE replace(draft, '<macro id=\"1\"/>', '') END AS fixed FROM mask)"


@query(f"SELECT page_id, line, array_to_string({_TOK.format('source')}, ' ') AS tokens FROM mask", MASKED_SQL)
def placeholder_extract(spark, d):
    return views.masked(spark, d).select("page_id", "line", F.array_join(ph.extract(F.col("source")), " ").alias("tokens"))


@query(f"SELECT page_id, line, list_sort({_TOK.format('source')}) = list_sort({_TOK.format('fixed')}) AS same FROM fix", MASKED_SQL, _FIXED)
def placeholder_validate(spark, d):
    rows = ph.repaired(views.masked(spark, d), "source", "draft", "fixed")
    return rows.select("page_id", "line", ph.same_tokens(ph.extract(F.col("source")), ph.extract(F.col("fixed"))).alias("same"))


@query(
    f"SELECT page_id, line, token, CAST(sum(e) AS INTEGER) AS expected, CAST(sum(g) AS INTEGER) AS got FROM (SELECT page_id, line, unnest({_TOK.format('source')}) AS token, 1 AS e, 0 AS g FROM fix UNION ALL SELECT page_id, line, unnest({_TOK.format('fixed')}) AS token, 0 AS e, 1 AS g FROM fix) GROUP BY 1, 2, 3 HAVING sum(e) <> sum(g)",
    MASKED_SQL,
    _FIXED,
)
def placeholder_count_diff(spark, d):
    rows = validate.checked(views.masked(spark, d), "source", "draft", "fixed", "error", "diff")
    # the outer form, as the inner one would push a copy of the whole expression down as a filter
    return rows.select("page_id", "line", F.inline_outer("diff")).where("token is not null")


_BARE = "regexp_replace({0}, '(?s)\\\\.', '', 'g')"


def _n(text: str, c: str) -> str:
    bare = _BARE.format(text)
    return f"(length({bare}) - length(replace({bare}, '{c}', '')))"


_ERR = (
    f"CASE WHEN {_n('source', '{')} - {_n('source', '}')} <> {_n('fixed', '{')} - {_n('fixed', '}')} THEN 'braces' WHEN {_n('fixed', '$')} % 2 <> 0 THEN 'dollars' "
    f"WHEN {_n('fixed', '^')} > {_n('source', '^')} THEN 'caret' WHEN {_n('fixed', '_')} > {_n('source', '_')} THEN 'underscore' END"
)


@query(f"SELECT page_id, line, {_ERR} AS fault FROM fix", MASKED_SQL, _FIXED)
def syntax_validate(spark, d):
    rows = ph.repaired(views.masked(spark, d), "source", "draft", "fixed")
    e = validate.syntax_error(F.col("source"), F.col("fixed"))
    kind = F.when(e.startswith("Unbalanced braces"), "braces").when(e.startswith("Unbalanced inline"), "dollars").when(e.startswith("Unbalanced display"), "display").when(e.contains("caret"), "caret").when(e.contains("underscore"), "underscore")
    return rows.select("page_id", "line", kind.alias("fault"))


@query(f"SELECT page_id, line, (list_sort({_TOK.format('source')}) = list_sort({_TOK.format('fixed')}) AND {_ERR} IS NULL AND draft <> '') AS accurate FROM fix", MASKED_SQL, _FIXED)
def accuracy_gate(spark, d):
    rows = views.masked(spark, d)
    return validate.with_accuracy(rows, "source", "draft").select("page_id", "line", (F.size("issues") == 0).alias("accurate"))


@query("SELECT p AS parse_ok, a AS accurate, r AS requires, (NOT a) OR (p AND r) AS requires_refine, NOT p AS degraded, NOT a AS accuracy_forced, (NOT p AND a) AS bypass, CASE WHEN NOT p THEN 'critique_parse_degraded' WHEN NOT a AND NOT r THEN 'accuracy_gate_forced_refine' END AS retry_reason FROM (VALUES (true), (false)) x(p), (VALUES (true), (false)) y(a), (VALUES (true), (false)) z(r)")
def critique_merge(spark, d):
    two = F.array(F.lit(True), F.lit(False))
    rows = spark.range(1).select(F.explode(two).alias("parse_ok")).select("parse_ok", F.explode(two).alias("accurate")).select("parse_ok", "accurate", F.explode(two).alias("requires"))
    none = F.array().cast("array<struct<category:string,description:string>>")
    m = validate.merged_critique(F.col("parse_ok"), F.col("accurate"), F.col("requires"), F.lit("text"), none, F.lit(False), F.lit(None).cast("string"))
    return rows.withColumn("m", m).select("parse_ok", "accurate", "requires", "m.requires_refine", "m.degraded", "m.accuracy_forced", "m.bypass", "m.retry_reason")


@query("SELECT doc_id, (['true', 'false', 'true', 'false', 'true', 'none'])[CAST(doc_id % 6 + 1 AS INT)] AS requires_refine, ([2, 0, 1, 0, 0, -1])[CAST(doc_id % 6 + 1 AS INT)] AS n_issues, doc_id % 6 = 2 AS repaired FROM documents")
def critique_parse(spark, d):
    rows = views.critiques(spark, d).withColumn("c", critique.parse_critique("critique"))
    issues = F.when(F.col("c.issues").isNull(), -1).otherwise(F.size("c.issues"))
    return rows.select("doc_id", F.coalesce(F.col("c.requires_refine").cast("string"), F.lit("none")).alias("requires_refine"), issues.alias("n_issues"), F.coalesce("c.repaired", F.lit(False)).alias("repaired"))


# ---------------------------------------------------------------- context and budgets

_TURNS = "turn0 AS (SELECT conv_id AS namespace, turn AS seq, role, CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS own, text FROM conversations)"


def _turns(spark, d):
    t = table(spark, d, "conversations")
    rows = t.select(F.col("conv_id").alias("namespace"), F.col("turn").alias("seq"), F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text")).alias("translation"), F.col("text").alias("source_text"))
    return rows.withColumns({"status": F.lit("refined"), "id": F.concat_ws("-", "namespace", "seq"), "refined": F.lit(None).cast("struct<content:string>"), "draft": F.lit(None).cast("struct<content:string>")})


_NEAR = "array_to_string(list_slice(coalesce((SELECT list(b.own ORDER BY b.seq) FROM turn0 b WHERE b.namespace = a.namespace AND b.seq {0} a.seq AND b.own <> ''), []), {1}), '|')"


@query(f"SELECT namespace, seq, {_NEAR.format('<', '-3, -1')} AS backward FROM turn0 a", _TURNS)
def neighbors_backward(spark, d):
    return context.neighbours(_turns(spark, d), 3).select("namespace", "seq", F.array_join("backward", "|").alias("backward"))


@query(f"SELECT namespace, seq, {_NEAR.format('<', '-2, -1')} AS backward, {_NEAR.format('>', '1, 2')} AS forward FROM turn0 a", _TURNS)
def neighbors_bidirectional(spark, d):
    return context.neighbours(_turns(spark, d), 2, 2).select("namespace", "seq", F.array_join("backward", "|").alias("backward"), F.array_join("forward", "|").alias("forward"))


@query(
    "SELECT namespace, seq, coalesce(array_to_string(list(text) OVER (PARTITION BY namespace ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS backward, coalesce(array_to_string(list(text) OVER (PARTITION BY namespace ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|'), '') AS forward FROM turn0",
    _TURNS,
)
def neighbors_positional(spark, d):
    return context.positional(_turns(spark, d), 2, 2).select("namespace", "seq", F.array_join("backward", "|").alias("backward"), F.array_join("forward", "|").alias("forward"))


@query()
def context_pack(spark, d):
    rows = context.positional(_turns(spark, d), 3, 3).withColumn("p", context.packed(F.col("backward"), F.col("forward"), F.lit(120)))
    return rows.select("namespace", "seq", "p.block", "p.tokens", "p.truncated")


_PLAN = "8192 - most - CASE WHEN split THEN 512 ELSE 0 END - CAST(ceil(fixed * 1.1::DOUBLE) AS BIGINT) - 48 - 163"
_SIZED = "sized AS (SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS fixed, CAST(1024 + (doc_id % 5) * 1024 AS BIGINT) AS most, doc_id % 2 = 1 AS split FROM documents)"


def _sized(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("fixed"), (1024 + (n % 5) * 1024).alias("most"), (n % 2 == 1).alias("split"))


@query(f"SELECT doc_id, CAST(most + CASE WHEN split THEN 512 ELSE 0 END AS BIGINT) AS reserved_output, CAST({_PLAN} AS BIGINT) AS neighbor_budget, 163::BIGINT AS safety_margin, {_PLAN} < 0 AS infeasible FROM sized", _SIZED)
def token_budget_plan(spark, d):
    p = budget.plan(F.lit(8192), F.col("most"), F.col("fixed"), F.col("split"), F.lit(512), F.lit(1.1), F.lit(48))
    return _sized(spark, d).withColumn("p", p).select("doc_id", "p.*")


@query("SELECT doc_id, CAST(least(most, greatest(256, floor(fixed * 1.5::DOUBLE) + 64)) AS BIGINT) AS output FROM sized", _SIZED)
def adaptive_output(spark, d):
    return _sized(spark, d).select("doc_id", budget.adaptive_output(F.col("fixed"), F.col("most"), F.lit(1.5), F.lit(256), F.lit(64)).alias("output"))


@query("SELECT doc_id, CAST(CASE WHEN need <= 262144 THEN need END AS BIGINT) AS smallest FROM (SELECT doc_id, greatest(1, c + 64, CAST(floor(50 * (c - 1) / 49.0::DOUBLE) AS BIGINT) + 1) AS need FROM (SELECT doc_id, most + CAST(ceil(fixed * 1.1::DOUBLE) AS BIGINT) + 48 + 100 AS c FROM sized))", _SIZED)
def smallest_context_limit(spark, d):
    return _sized(spark, d).select("doc_id", budget.smallest_limit(F.col("most"), F.col("fixed"), F.lit(1.1), F.lit(48), F.lit(100)).alias("smallest"))


@query()
def context_recommendation(spark, d):
    return context.capacity(views.segments(spark, d))


@query()
def context_verdict(spark, d):
    return context.verdict(context.capacity(views.segments(spark, d)))


# ---------------------------------------------------------------- build

_BUILD = r"""
blk AS (SELECT namespace, seq, raw_text, substr(source_hash, 1, 12) AS id FROM hashed),
bj AS (SELECT blk.*, s.status AS tm, s.translation, coalesce(s.status IN ('refined', 'reviewed', 'approved', 'locked') AND s.translation <> '', false) AS use FROM blk LEFT JOIN (SELECT * FROM stored WHERE length(source_text) % 13 <> 0) s ON s.namespace = blk.namespace AND s.id = blk.id),
bout AS (SELECT namespace, seq, id, CASE WHEN use THEN regexp_extract(raw_text, '^(\s*)', 1) || trim(translation, chr(32) || chr(9) || chr(13)) || regexp_extract(raw_text, '(\s*)$', 1) ELSE raw_text END AS text,
         CASE WHEN tm IS NULL THEN 'segment not in translation memory' WHEN use THEN NULL WHEN tm IN ('conflict', 'error', 'generated', 'drafted', 'critiqued') THEN 'status=' || tm WHEN translation = '' THEN 'missing translation' END AS skipped, coalesce(tm, 'missing') AS status FROM bj)
"""


def _built(spark, d):
    rows = views.lines(spark, d).withColumn("source_hash", source_hash(F.col("raw_text"))).withColumn("id", F.substring("source_hash", 1, 12))
    rows = rows.withColumn("placeholders", F.create_map().cast("map<string,string>")).withColumn("translatable", F.lit(True))
    return build.joined(rows, views.stored_lines(spark, d).where(F.char_length("source_text") % 13 != 0))


@query("SELECT namespace, seq, id, text, skipped, status FROM bout", LINES_SQL, _BUILD)
def build_join(spark, d):
    return _built(spark, d).select("namespace", "seq", "id", "text", "skipped", "status")


@query("SELECT namespace, count(*) AS n_skipped, array_to_string(list_slice(list(substr(id, 1, 8) || '(' || skipped || ')' ORDER BY seq), 1, 5), ', ') AS \"first\" FROM bout WHERE skipped IS NOT NULL GROUP BY 1", LINES_SQL, _BUILD)
def build_skips(spark, d):
    return build.skips(_built(spark, d))


@query("SELECT namespace, string_agg(text, '' ORDER BY seq) AS text FROM bout GROUP BY 1", LINES_SQL, _BUILD)
def build_documents(spark, d):
    return build.documents(_built(spark, d))


# ---------------------------------------------------------------- graph

_LINKS = "link AS (SELECT page_id AS path, (page_id * 7 + 3) % (SELECT count(*) FROM pages) AS target FROM pages WHERE page_id % 5 <> 4 UNION SELECT page_id, page_id // 2 FROM pages WHERE page_id % 3 = 0)"


@query("SELECT DISTINCT path FROM walk", "RECURSIVE " + _LINKS, "walk(path) AS (SELECT 1::BIGINT UNION SELECT target FROM walk JOIN link USING (path))")
def dependency_closure(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("path"))
    n = pages.count()
    links = pages.where("path % 5 <> 4").select("path", ((F.col("path") * 7 + 3) % n).alias("target")).union(pages.where("path % 3 = 0").select("path", F.floor(F.col("path") / 2).cast("long"))).distinct()
    return graph.closure(spark.range(1).select(F.lit(1).cast("long").alias("path")), links)


@query("SELECT namespace, array_to_string(list_sort(list(path)), ' ') AS paths FROM (SELECT path, replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '__') AS namespace FROM (SELECT DISTINCT 'a' || CAST(page_id % 40 AS VARCHAR) || CASE WHEN page_id % 3 = 0 THEN '/' ELSE '__' END || 'b' || CAST(page_id % 20 AS VARCHAR) || '.tex' AS path FROM pages)) GROUP BY 1 HAVING count(*) > 1")
def namespace_collisions(spark, d):
    n = F.col("page_id")
    path = F.concat(F.lit("a"), (n % 40).cast("string"), F.when(n % 3 == 0, "/").otherwise("__"), F.lit("b"), (n % 20).cast("string"), F.lit(".tex"))
    return graph.collisions(table(spark, d, "pages").select(path.alias("path")).distinct()).select("namespace", F.array_join("paths", " ").alias("paths"))


# ---------------------------------------------------------------- documents in LaTeX


def _tex(spark, d):
    return views.tex_files(spark, d).select(F.col("path").alias("namespace"), "content")


@query()
def latex_segment(spark, d):
    return latex.segmented(_tex(spark, d)).select("namespace", "seq", "start", "end", "id", "masked_text", F.to_json("placeholders").alias("placeholders"), "translatable")


@query("SELECT path AS namespace, true AS lossless, -1 AS first_difference FROM tex", TEX_SQL)
def latex_lossless(spark, d):
    files = _tex(spark, d)
    return build.lossless(latex.segmented(files), files).withColumn("first_difference", F.coalesce("first_difference", F.lit(-1)))


@query("SELECT path AS namespace, true AS same, 0 AS n_errors FROM tex", TEX_SQL)
def latex_round_trip(spark, d):
    rows = latex.segmented(_tex(spark, d)).withColumn("r", ph.restore(F.col("masked_text"), F.col("placeholders")))
    return rows.groupBy("namespace").agg(F.bool_and(F.col("r.text") == F.col("raw_text")).alias("same"), F.count("r.error").alias("n_errors"))


_USED = r"""used AS (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '\\([a-zA-Z]+)', 1)) AS name FROM tex WHERE path LIKE '%.tex') WHERE name NOT IN ('begin', 'end') GROUP BY 1)"""
_DEFINED = r"""defined AS (SELECT name, CAST(least(max(args), 2) AS INT) AS args FROM (
  SELECT unnest(regexp_extract_all(content, '\\(?:newcommand|renewcommand|providecommand)\*?\{?\\([a-zA-Z]+)\}?(?:\[(\d+)\])', 1)) AS name, CAST(unnest(regexp_extract_all(content, '\\(?:newcommand|renewcommand|providecommand)\*?\{?\\([a-zA-Z]+)\}?(?:\[(\d+)\])', 2)) AS INT) AS args FROM tex
  UNION ALL SELECT unnest(regexp_extract_all(content, '\\def\\([a-zA-Z@]+)((?:#\d)+)', 1)), CAST(length(unnest(regexp_extract_all(content, '\\def\\([a-zA-Z@]+)((?:#\d)+)', 2))) // 2 AS INT) FROM tex) GROUP BY 1)"""
_KNOWN = "known AS (SELECT unnest([" + ", ".join(f"'{m}'" for m in sorted(latex.ARGUMENTS)) + "]) AS name)"
_UNSAFE = ", ".join(f"'{m}'" for m in graph.UNSAFE)


@query("SELECT name, n FROM used", TEX_SQL, _USED)
def macro_usage(spark, d):
    return graph.usage(views.tex_files(spark, d)).select("name", "n")


@query(r"SELECT kind, name, count(*) AS n FROM (SELECT 'environment' AS kind, unnest(regexp_extract_all(content, '\\begin\{([a-zA-Z*]+)\}', 1)) AS name FROM tex WHERE path LIKE '%.tex') GROUP BY 1, 2", TEX_SQL)
def environment_usage(spark, d):
    return graph.analysis(views.tex_files(spark, d)).where("kind in ('environment', 'verbatim')").select("kind", "name", "n")


@query("SELECT name, args FROM defined", TEX_SQL, _DEFINED)
def macro_definitions(spark, d):
    return graph.definitions(views.tex_files(spark, d))


@query(f"SELECT used.name, CAST(greatest(coalesce(defined.args, 0), CASE WHEN used.name = 'strange' THEN 2 WHEN used.name IN ('odd', 'subfix') OR used.name LIKE 'eq_' THEN 1 ELSE 0 END) AS INT) AS args FROM used LEFT JOIN defined USING (name) WHERE used.name NOT IN (SELECT name FROM known) AND used.name NOT IN ({_UNSAFE}) AND length(used.name) > 1", TEX_SQL, _USED, _DEFINED, _KNOWN)
def unknown_macros(spark, d):
    files = views.tex_files(spark, d)
    known = spark.range(1).select(F.explode(F.array(*(F.lit(m) for m in latex.ARGUMENTS if m))).alias("name"))
    return graph.unknown(graph.usage(files), known, known.limit(0), graph.definitions(files))


@query(r"SELECT DISTINCT name, 'begin' AS type, 'equation' AS env FROM (SELECT unnest(regexp_extract_all(content, '\\newcommand\\([a-zA-Z]+)\{\\begin\{equation\}\}', 1)) AS name FROM tex)", TEX_SQL)
def environment_aliases(spark, d):
    return graph.aliases(views.tex_files(spark, d))


_EDGES = r"""wish AS (
  SELECT path, unnest(regexp_extract_all(content, '\\(?:input|include|subfile|subfix)\s*\{([^}]+)\}|\\input\s+([^\s%]+)', 1)) AS a, unnest(regexp_extract_all(content, '\\(?:input|include|subfile|subfix)\s*\{([^}]+)\}|\\input\s+([^\s%]+)', 2)) AS b, '' AS p FROM tex
  UNION ALL SELECT path, NULL, NULL, trim(unnest(string_split(x, ','))) FROM (SELECT path, unnest(regexp_extract_all(content, '\\usepackage\{([^}]+)\}', 1)) AS x FROM tex)),
wished AS (SELECT DISTINCT path, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS folder, CASE WHEN a <> '' THEN a ELSE b END AS name, p FROM wish),
place AS (SELECT path, name, p, unnest([0, 2, 4, 6]) AS rk, unnest([folder || name, name, CASE WHEN name LIKE 'latex.out/%' THEN substr(name, 11) END, regexp_extract(name, '([^/]*)$', 1)]) AS target FROM wished WHERE name IS NOT NULL
  UNION ALL SELECT path, name, p, 0, p || '.sty' FROM wished WHERE p <> ''),
way AS (SELECT * FROM place UNION ALL SELECT path, name, p, rk + 1, target || '.tex' FROM place WHERE target NOT LIKE '%.tex' AND p = ''),
found AS (SELECT way.path, name, p, min(rk) AS rk, arg_min(target, rk) AS target FROM way JOIN (SELECT DISTINCT path FROM tex) t ON t.path = way.target GROUP BY ALL),
edge AS (SELECT path, target, bool_and(p = '' AND rk >= 6) AS fallback FROM found GROUP BY 1, 2)"""


@query("SELECT path, target, fallback FROM edge", TEX_SQL, _EDGES)
def document_edges(spark, d):
    return graph.edges(views.tex_files(spark, d))


@query("SELECT DISTINCT path FROM reach", "RECURSIVE " + TEX_SQL, _EDGES, "reach(path) AS (SELECT path FROM tex WHERE path LIKE '%.tex' AND contains(content, chr(92) || 'documentclass') UNION SELECT target FROM reach JOIN edge USING (path))")
def document_closure(spark, d):
    files = views.tex_files(spark, d)
    return graph.closure(graph.roots(files), graph.edges(files))


@query("SELECT path, replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '__') AS namespace FROM (SELECT regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS path FROM pages)")
def namespace_derivation(spark, d):
    path = F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1)
    return table(spark, d, "pages").select(path.alias("path"), namespace_of(path).alias("namespace"))


# ---------------------------------------------------------------- translation and streams


@query("SELECT namespace, seq, id, CASE WHEN status IN ('generated', 'error') THEN 'drafted' ELSE status END AS status FROM one", SEGMENTS_SQL, "one AS (SELECT namespace, id, min(seq) AS seq, arg_max(status, seq) AS status FROM seg GROUP BY 1, 2)")
def translate_draft(spark, d):
    one = last_wins(views.segments(spark, d).withColumnRenamed("seq", "line")).select(*views.SEGMENTS.names)
    return translate.run_stage(one, "draft", now=now()).select("namespace", "seq", "id", "status")


_WORKED = "SELECT CASE WHEN status IN ('generated', 'error', 'drafted', 'critiqued') THEN CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'error' WHEN (length(text) - length(replace(text, '$', ''))) % 2 = 1 THEN 'conflict' ELSE 'refined' END ELSE status END AS status, count(*) AS n FROM one GROUP BY 1"


@query(_WORKED, SEGMENTS_SQL, "one AS (SELECT namespace, id, arg_max(status, seq) AS status, arg_max(source_text, seq) AS text FROM seg GROUP BY 1, 2)")
def translate_workflow(spark, d):
    one = last_wins(views.segments(spark, d).withColumnRenamed("seq", "line")).select(*views.SEGMENTS.names)
    return translate.workflow(one, now=now()).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT namespace, id, min(seq) AS seq, CASE WHEN arg_max(status, seq) IN ('generated', 'error') THEN arg_max(source_text, seq) END AS answer FROM seg GROUP BY 1, 2", SEGMENTS_SQL)
def translate_sequential(spark, d):
    one = last_wins(views.segments(spark, d).withColumnRenamed("seq", "line")).select(*views.SEGMENTS.names)
    return translate.sequential(one)


@query("SELECT segment_id, arg_max(stage, CAST(id AS BIGINT)) AS stage, arg_max(duration_ms, CAST(id AS BIGINT)) AS duration_ms FROM rec GROUP BY 1", RECORDS_SQL)
def changelog_latest(spark, d):
    rows = views.records(spark, d).select("segment_id", F.col("id").cast("long").alias("at"), "stage", "duration_ms")
    return changelog.latest(rows, ["segment_id"], "at").select("segment_id", "stage", "duration_ms")


@query("SELECT event_type, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last_event FROM events GROUP BY 1")
def changelog_stream_compaction(spark, d):
    """The events table as a stream (by a pattern, as it may be one file): micro-batches are compacted per user and type, and the state is read back."""
    target, checkpoint = changelog.places(spark)
    schema = table(spark, d, "events").schema
    changelog.follow(spark, f"{d}/event[s].parquet", schema, target, checkpoint, ["event_type", "event_id"], "ts").awaitTermination()
    return changelog.current(spark, target, ["event_type", "event_id"], "ts").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").cast("long").alias("last_event"))


# ---------------------------------------------------------------- files, prompts and calls


def _shared(spark, name):
    """A new folder below the one that all executors share."""
    return f"{changelog.places(spark)[0]}-{name}"


@query("SELECT namespace, min(seq) AS seq, id, arg_max(source_text, seq) AS source_text, arg_max(status, seq) AS status, arg_max(translation, seq) AS translation FROM seg GROUP BY 1, 3", SEGMENTS_SQL)
def tm_file_round_trip(spark, d):
    """Segments written as JSON lines, a file for each namespace, and loaded again; of lines with one id the last wins."""
    folder, rows = _shared(spark, "lines"), views.segments(spark, d)
    segments.save(rows, folder)
    found = last_wins(segments.strict(segments.decode(segments.read_lines(spark, folder)))).drop("seq")
    return found.join(rows.groupBy("namespace", "id").agg(F.min("seq").alias("seq")), ["namespace", "id"]).select("namespace", "seq", "id", "source_text", "status", "translation")


@query("SELECT id, translation, status FROM stored WHERE status <> 'deprecated' AND translation <> ''", LINES_SQL)
def tm_exchange_csv(spark, d):
    """The exchange file in CSV, written and read again; texts without a character beside blanks are none."""
    folder = _shared(spark, "csv")
    segments.write_csv(views.stored_lines(spark, d), folder)
    return segments.read_csv(spark, folder).where("translation is not null").select("id", "translation", "status")


@query("SELECT doc_id, 'Translate:' || chr(10) || text AS prompt, CAST(length('Translate:' || chr(10) || text) // 4 + length('You translate from ' || lang || ' to en. The texts are about ' || source || '.' || chr(10) || 'Keep every tag such as <macro id=\"1\"/> exactly once and in a fitting place. Give the translation alone.') // 4 AS BIGINT) AS tokens FROM (SELECT doc_id, lang, source, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM documents) WHERE text <> ''")
def prompt_render(spark, d):
    values = {"source_lang": F.col("lang"), "target_lang": F.lit("en"), "domain": F.col("source"), "source": F.col("text")}
    rows = table(spark, d, "documents").where(strip(F.col("text")) != "")
    return rows.select("doc_id", prompts.rendered(prompts.source_of("draft"), **values).alias("prompt"), prompts.fixed_tokens("draft", **values).alias("tokens"))


@query("SELECT doc_id, CASE WHEN CAST(ceil(fixed * 1.1::DOUBLE) AS BIGINT) + 48 + most > 4096 THEN 'Prompt plus reserved output exceeds model context limit. effective_prompt=' || CAST(CAST(ceil(fixed * 1.1::DOUBLE) AS BIGINT) AS VARCHAR) || ', overhead=48, reserved_output=' || CAST(most AS VARCHAR) || ', limit=4096, raw_prompt_tokens=' || CAST(fixed AS VARCHAR) || '.' ELSE '' END AS error FROM sized", _SIZED)
def call_footprint(spark, d):
    error = calls.footprint_error(F.col("fixed"), F.col("most"), F.lit(4096), F.lit(1.1), F.lit(48))
    return _sized(spark, d).select("doc_id", F.coalesce(error, F.lit("")).alias("error"))


@query("SELECT doc_id, CASE WHEN length(text) // 4 <= 40 THEN text ELSE rtrim(substr(text, 1, 163), chr(32) || chr(9) || chr(10) || chr(13)) END AS text FROM documents")
def truncated_text(spark, d):
    return table(spark, d, "documents").select("doc_id", truncate_tokens(F.col("text"), F.lit(40)).alias("text"))


@query(r"SELECT path, CASE WHEN contains(content, '\documentclass[11pt]{article}') THEN replace(content, '\documentclass[11pt]{article}', '\documentclass[11pt]{article}' || chr(10) || '% injected lines' || chr(10) || '\usepackage{x}' || chr(10) || '% end of injected lines' || chr(10)) ELSE content END AS content FROM tex", TEX_SQL)
def preamble_injection(spark, d):
    return views.tex_files(spark, d).select("path", build.injected(F.col("content"), [r"\usepackage{x}"]).alias("content"))


@query("SELECT bj.namespace, bj.seq, bj.id, coalesce(CASE WHEN use AND length(raw_text) % 4 = 0 THEN 'source changed since last sync' END, '') AS error FROM bj", LINES_SQL, _BUILD)
def build_stale(spark, d):
    """What a build says of blocks whose stored hash is another one: for every fourth length."""
    rows = views.lines(spark, d).withColumn("source_hash", source_hash(F.col("raw_text"))).withColumn("id", F.substring("source_hash", 1, 12))
    rows = rows.withColumn("placeholders", F.create_map().cast("map<string,string>")).withColumn("translatable", F.lit(True))
    rows = rows.withColumn("source_hash", F.when(F.char_length("raw_text") % 4 == 0, F.concat(F.lit("x"), "source_hash")).otherwise(F.col("source_hash")))
    stored = views.stored_lines(spark, d).where(F.char_length("source_text") % 13 != 0)
    return build.joined(rows, stored).select("namespace", "seq", "id", F.coalesce("error", F.lit("")).alias("error"))


@query("SELECT conv_id, turn, 'locally_estimated' AS usage_source, CAST(length(text) // 4 AS BIGINT) AS prompt_tokens, CASE WHEN turn % 2 = 0 THEN CAST(turn AS BIGINT) ELSE CAST(length(role) // 4 AS BIGINT) END AS completion_tokens FROM conversations")
def telemetry_usage(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), F.col("role").alias("content"), F.lit(None).cast("long").alias("prompt_tokens"), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("long")).alias("completion_tokens"))
    made = telemetry.record_of(rows.withColumns({"id": F.col("conv_id").cast("string"), "segment_id": F.col("turn").cast("string")}))
    return made.select(F.col("id").cast("long").alias("conv_id"), F.col("segment_id").cast("long").alias("turn"), "usage_source", "prompt_tokens", "completion_tokens")


@query()
def budget_messages(spark, d):
    return context.messages(context.capacity(views.segments(spark, d), 512), 512)


@query()
def segment_tokens_bpe(spark, d):
    """Token counts of whole texts by a public tokenizer, in place of a quarter of the length."""
    return table(spark, d, "documents").select("doc_id", tokenizer_count(F.col("text")).alias("n_tokens"))
