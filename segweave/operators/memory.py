"""Filters and updates of segments: eligibility, search, status changes, reset, prune, import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.validate import checked, with_validity
from ..schema import BUILDABLE, HUMAN_PROTECTED, HUMAN_RESETTABLE, IMMUTABLE, MACHINE_RESETTABLE, REVIEW_QUEUE, STATUSES, authoring_allowed, is_any, resolve_status, transition_allowed


def eligible_sequential(force: bool = False, status: str | None = None, prefix: str | None = None) -> Column:
    s = F.col("status")
    fits = F.col("id").startswith(prefix) if prefix else F.lit(True)
    chosen = ((~is_any(s, HUMAN_PROTECTED) | F.lit(force)) & (s == resolve_status(F.lit(status)))) if status else is_any(s, ("generated", "error")) | F.lit(force)
    return ~is_any(s, IMMUTABLE) & fits & chosen


def eligible_stage(stage: str, force: bool = False) -> Column:
    s = F.col("status")
    by_stage = {"draft": is_any(s, ("generated", "error")) | F.lit(force), "critique": s == "drafted", "refine": s == "critiqued"}
    return ~is_any(s, IMMUTABLE) & by_stage.get(stage, F.lit(False))


def reviewable(queue: tuple[str, ...] = REVIEW_QUEUE) -> Column:
    return is_any(F.col("status"), queue) & (strip(F.col("translation")) != "")


def contains(text: Column, query: str) -> Column:
    """A substring in any case; no character of the query is special."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def search(segments: DataFrame, query: str, in_source: bool = False, namespace: str | None = None) -> DataFrame:
    rows = segments if namespace is None else segments.where(F.col("namespace") == namespace)
    return rows.where(contains(F.col("source_text" if in_source else "translation"), query))


def listed(segments: DataFrame, status: str | None = None, query: str | None = None) -> DataFrame:
    rows = segments if status is None else segments.where(F.col("status") == resolve_status(F.lit(status)))
    return rows if query is None else rows.where(contains(F.col("source_text"), query) | contains(F.col("translation"), query))


def by_prefix(segments: DataFrame, prefix: str) -> DataFrame:
    """(namespace, prefix, n, id, verdict): found, not found or ambiguous in each namespace."""
    n = segments.groupBy("namespace").agg(F.count_if(F.col("id").startswith(prefix)).alias("n"), F.min(F.when(F.col("id").startswith(prefix), F.col("id"))).alias("id"))
    return n.select("namespace", F.lit(prefix).alias("prefix"), "n", "id", F.when(F.col("n") == 0, "not found").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("verdict"))


def archived(when: Column = None) -> Column:
    """The history with the current translation added, where there is one."""
    now = when if when is not None else F.current_timestamp()
    entry = F.struct(F.col("translation"), F.col("status"), now.cast("timestamp").alias("timestamp"))
    return F.when(F.col("translation") != "", F.concat("history", F.array(entry))).otherwise(F.col("history"))


def updated(segments: DataFrame, hit: Column, **values: Column) -> DataFrame:
    """``segments`` with new values where ``hit`` holds; all are computed from the old row."""
    rows = segments.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return rows.select(*(F.when(F.col("_hit"), values[c].cast(segments.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in segments.columns))


def cleared() -> dict[str, Column]:
    """Values that take a machine's work off a row."""
    return {"translation": F.lit("")} | {c: F.lit(None) for c in ("draft", "critique", "refined", "reflection_meta")}


def reset(segments: DataFrame, force: bool = False, now: Column = None) -> DataFrame:
    hit = is_any(F.col("status"), MACHINE_RESETTABLE) | (F.lit(force) & is_any(F.col("status"), HUMAN_RESETTABLE))
    return updated(segments, hit, history=archived(now), status=F.lit("generated"), error_meta=F.lit(None), **cleared())


def prune(segments: DataFrame) -> DataFrame:
    return segments.where("status <> 'deprecated'")


def set_status(segments: DataFrame, namespace: str, segment: str, status: str, force: bool = False, now: Column = None) -> DataFrame:
    """Moves one segment where the transition is allowed; back to generated resets it."""
    to = resolve_status(F.lit(status))
    hit = (F.col("namespace") == namespace) & (F.col("id") == segment) & transition_allowed(F.col("status"), to, F.lit(force))
    again = hit & (to == "generated")
    back = updated(segments, again, history=archived(now), status=F.lit("generated"), error_meta=F.lit(None), **cleared())
    return updated(back, hit & (to != "generated"), status=to)


def submitted(segments: DataFrame, edits: DataFrame, now: Column = None) -> DataFrame:
    """Translations by people (namespace, id, text, to_status) on their segments, where authoring and validation allow."""
    rows = segments.join(edits.select("namespace", "id", F.col("text").alias("_text"), F.col("to_status").alias("_to")), ["namespace", "id"], "left")
    rows = checked(rows, "source_text", "_text", "_fixed", "_error").withColumn("_clean", F.when(F.col("_error").isNull(), F.col("_fixed")))
    hit = F.col("_clean").isNotNull() & authoring_allowed(F.col("status"), F.col("_to"))
    changed = F.when(F.col("translation") != F.col("_clean"), archived(now)).otherwise(F.col("history"))
    return updated(rows, hit, history=changed, translation=F.col("_clean"), status=F.col("_to")).select(*segments.columns)


def imported(segments: DataFrame, rows: DataFrame, now: Column = None) -> DataFrame:
    """``segments`` after an exchange file (at, id, translation, status), with ``outcome``: updated, skipped or null.

    Where a file has an id more than once its last row counts.
    """
    last = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct("translation", "status"), "at").alias("new"))
    both = segments.join(last, "id", "left").withColumn("_new_text", F.coalesce(F.col("new.translation"), F.lit("")))
    # only rows of the file are validated; one that changes nothing but the status has the stored text, so one check serves both
    both = both.withColumn("_checked", F.when(F.col("new").isNotNull(), F.col("source_text")))
    both = with_validity(both, "_checked", "_new_text", "_valid")
    text, given = F.col("_new_text"), F.lower(F.col("new.status"))
    ready = F.col("new").isNotNull() & (text != "") & ~is_any(F.col("status"), IMMUTABLE)
    other = F.col("translation") != text
    no = F.lit(False)
    writes = ready & other & transition_allowed(F.col("status"), F.lit("reviewed"), no) & F.col("_valid")
    moves = ready & ~other & is_any(given, STATUSES) & (given != F.col("status")) & transition_allowed(F.col("status"), given, no) & (~is_any(given, BUILDABLE) | (F.col("translation") == "") | F.col("_valid"))
    marked = both.withColumn("_writes", F.coalesce(writes, no)).withColumn("_moves", F.coalesce(moves, no))
    outcome = F.when(F.col("_writes") | F.col("_moves"), "updated").when(F.col("new").isNotNull(), "skipped").alias("outcome")
    value = {
        "history": F.when(F.col("_writes"), archived(now)).otherwise(F.col("history")),
        "translation": F.when(F.col("_writes"), text).otherwise(F.col("translation")),
        "status": F.when(F.col("_writes"), "reviewed").when(F.col("_moves"), given).otherwise(F.col("status")),
    }
    return marked.select(*(value[c].alias(c) if c in value else F.col(c) for c in segments.columns), outcome)


def latest(segments: DataFrame) -> DataFrame:
    """Each translation beside the one before it."""
    last = F.try_element_at("history", F.lit(-1))
    return segments.select("namespace", "id", "status", "translation", last["translation"].alias("before"), last["status"].alias("status_before"))


def succeed(segments: DataFrame, hit: Column, text: Column, now: Column = None) -> DataFrame:
    """A machine's valid translation on the rows that ``hit`` picks."""
    history = F.when(F.col("translation") != text, archived(now)).otherwise(F.col("history"))
    return updated(segments, hit, history=history, translation=text, status=F.lit("refined"), draft=F.lit(None), critique=F.lit(None), refined=F.lit(None), error_meta=F.lit(None))


def fail(segments: DataFrame, hit: Column, kind: str, message: Column, now: Column = None) -> DataFrame:
    """Marks rows as in conflict, or as an error with its type, message and time."""
    at = now if now is not None else F.current_timestamp()
    status = "conflict" if kind == "conflict" else "error"
    return updated(segments, hit, status=F.lit(status), error_meta=F.struct(F.lit(kind).alias("error_type"), message.alias("message"), at.cast("timestamp").alias("timestamp")))


def idle_reason(segments: DataFrame, stage: str | None = None) -> DataFrame:
    """Why a run over a namespace finds nothing to do, by namespace."""
    s = F.col("status")
    n = segments.groupBy("namespace").agg(
        F.count_if(s != "deprecated").alias("active"),
        F.count_if(s == "drafted").alias("drafted"),
        F.count_if(s == "critiqued").alias("critiqued"),
        F.count_if(is_any(s, ("generated", "error"))).alias("open"),
        F.count_if(is_any(s, ("conflict", "error"))).alias("blocked"),
    )
    reason = (
        F.when(F.col("active") == 0, "no active segments")
        .when((F.lit(stage or "") == "critique") & (F.col("drafted") == 0), "critique needs drafted segments")
        .when((F.lit(stage or "") == "refine") & (F.col("critiqued") == 0), "refine needs critiqued segments")
        .when(F.col("drafted") + F.col("critiqued") > 0, "in mid-pipeline")
        .when(F.col("open") > 0, "eligible")
        .when(F.col("blocked") > 0, "blocked")
        .otherwise("already translated")
    )
    return n.withColumn("reason", reason)


def deduplicated(rows: DataFrame, order: str) -> DataFrame:
    """The latest value of each id at its first place."""
    by_id = Window.partitionBy("namespace", "id")
    return rows.withColumn("_first", F.min(order).over(by_id)).withColumn("_nth", F.row_number().over(by_id.orderBy(F.desc(order)))).where("_nth = 1").withColumn(order, F.col("_first")).drop("_first", "_nth")


