"""Schemas, status sets and the table of human status transitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The status domain, its sets and its aliases.
STATUSES = ("generated", "drafted", "critiqued", "refined", "reviewed", "approved", "locked", "conflict", "error", "deprecated")
IMMUTABLE = ("locked", "deprecated")
HUMAN_PROTECTED = ("locked", "approved", "reviewed")
LLM_ARTIFACT = ("refined", "drafted", "critiqued")
BUILDABLE = ("refined", "reviewed", "approved", "locked")
NON_BUILDABLE = ("conflict", "error", "generated", "drafted", "critiqued")
MACHINE_RESETTABLE = ("refined", "conflict", "error", "drafted", "critiqued")
HUMAN_RESETTABLE = ("reviewed", "approved")
REVIEW_QUEUE = ("refined", "reviewed")
ALIASES = {"untranslated": "generated", "pending": "generated", "machine_done": "refined"}
HUMAN_AUTHORING_TARGETS = ("generated", "conflict", "reviewed", "approved")
TRANSITIONS = {
    "generated": ("conflict", "error", "refined"),
    "drafted": ("conflict", "error", "generated"),
    "critiqued": ("conflict", "error", "generated"),
    "refined": ("reviewed", "approved", "conflict", "error", "generated"),
    "reviewed": ("approved", "conflict", "refined", "generated"),
    "approved": ("locked", "conflict", "reviewed", "generated"),
    "locked": ("conflict", "approved"),
    "conflict": ("generated", "refined", "reviewed", "approved"),
    "error": ("generated", "conflict"),
    "deprecated": (),
}

ARTIFACT = T.StructType([T.StructField("content", T.StringType()), T.StructField("model", T.StringType()), T.StructField("timestamp", T.TimestampType())])
HISTORY = T.ArrayType(T.StructType([T.StructField("translation", T.StringType()), T.StructField("status", T.StringType()), T.StructField("timestamp", T.TimestampType())]))
REFLECTION = T.StructType([T.StructField("used", T.BooleanType()), T.StructField("draft_accepted", T.BooleanType()), T.StructField("critique_feedback", T.StringType())])
ERROR = T.StructType([T.StructField("error_type", T.StringType()), T.StructField("message", T.StringType()), T.StructField("timestamp", T.TimestampType())])

#: what one JSON line of a segment file holds
SEGMENT_JSON = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source_hash", T.StringType()),
    T.StructField("source_text", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("translation", T.StringType()),
    T.StructField("draft", ARTIFACT),
    T.StructField("critique", ARTIFACT),
    T.StructField("refined", ARTIFACT),
    T.StructField("history", HISTORY),
    T.StructField("doc_type", T.StringType()),
    T.StructField("reflection_meta", REFLECTION),
    T.StructField("error_meta", ERROR),
    T.StructField("placeholders", T.MapType(T.StringType(), T.StringType())),
])
SEGMENTS = T.StructType([T.StructField("namespace", T.StringType()), T.StructField("seq", T.LongType()), *SEGMENT_JSON.fields])

INFERENCE = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("id", "segment_id", "namespace", "provider", "model", "stage", "prompt_version")),
    *(T.StructField(c, T.TimestampType()) for c in ("started_at", "finished_at")),
    *(T.StructField(c, T.LongType()) for c in ("duration_ms", "ttft_ms", "prompt_tokens", "completion_tokens", "cached_tokens")),
    *(T.StructField(c, T.StringType()) for c in ("usage_source", "finish_reason")),
    T.StructField("is_heuristic_simple", T.BooleanType()),
    T.StructField("attempt", T.LongType()),
    T.StructField("retry_reason", T.StringType()),
    *(T.StructField(c, T.LongType()) for c in ("pack_context_ms", "checkpoint_ms", "effective_max_tokens", "reasoning_tokens")),
])
#: defaults of columns that older telemetry lacks
INFERENCE_DEFAULTS = {"usage_source": "locally_estimated", "attempt": 1, "reasoning_tokens": 0}


def is_any(status: Column, of: tuple[str, ...]) -> Column:
    return status.isin(*of)


def resolve_status(given: Column) -> Column:
    """The status that a name or alias means, null where there is none."""
    name = F.lower(F.trim(given))
    known = F.when(name.isin(*STATUSES), name)
    for alias, status in ALIASES.items():
        known = F.when(name == alias, F.lit(status)).otherwise(known)
    return known


def transition_allowed(frm: Column, to: Column, force: Column) -> Column:
    """Whether a person or an import may move a segment between the two statuses."""
    allowed = F.lit(False)
    for source, targets in TRANSITIONS.items():
        if targets:
            allowed = allowed | ((frm == source) & to.isin(*targets))
    return F.when(frm == to, True).when(frm == "deprecated", False).when((frm == "locked") & ~force, False).when((to == "generated") & force, True).otherwise(allowed)


def authoring_allowed(frm: Column, to: Column) -> Column:
    """Whether a person may write a translation that moves a segment so."""
    return F.when(frm == to, True).when(is_any(frm, IMMUTABLE), False).otherwise(to.isin(*HUMAN_AUTHORING_TARGETS))
