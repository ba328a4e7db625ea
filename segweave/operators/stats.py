"""Status statistics and cost estimates of a translation memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count, with_linguistic
from ..schema import STATUSES

# Fixed values of the cost model: prompt tokens a call, share of refined drafts, context coefficients.
PROMPT_TOKENS, REFINE_SHARE, CONTEXT_FACTOR, CONTEXT_BASE = 600, 0.7, 1.2, 2.4


def namespace_stats(segments: DataFrame, window: float = 3.0, sequential: bool = False) -> DataFrame:
    """One row per namespace: counts and tokens by status (zeros included), reflection counts, expected tokens.

    One pass and one shuffle of partial aggregates, however many statuses there are.
    """
    rows = with_linguistic(segments).withColumn("_tokens", token_count(F.coalesce("source_text", F.lit(""))))
    used = F.coalesce(F.col("reflection_meta.used"), F.lit(False))
    accepted = F.coalesce(F.col("reflection_meta.draft_accepted"), F.lit(False))
    is_status = lambda s: F.col("status") == s
    n = rows.groupBy("namespace").agg(
        *(F.count_if(is_status(s)).alias(s) for s in STATUSES),
        F.count("*").alias("total"),
        *(F.coalesce(F.sum(F.when(is_status(s), F.col("_tokens"))), F.lit(0)).alias(f"tokens_{s}") for s in STATUSES),
        F.coalesce(F.sum("_tokens"), F.lit(0)).alias("tokens_total"),
        F.count_if(used).alias("reflection_used"),
        F.count_if(used & accepted).alias("draft_accepted"),
        F.count_if(used & ~accepted).alias("reflection_refined"),
        F.count_if("linguistic").alias("_n"),
        F.coalesce(F.sum(F.when(F.col("linguistic"), F.col("_tokens"))), F.lit(0)).alias("_t"),
    )
    return n.withColumn("tokens_pending", F.col("tokens_generated")).withColumn("tokens_reflection_estimate", expected_tokens(F.col("_n"), F.col("_t"), window, sequential)).drop("_n", "_t")


def expected_tokens(n: Column, tokens: Column, window: float, sequential: bool = False) -> Column:
    """Tokens a run over n linguistic segments takes, cut to a whole number."""
    calls = 2.0 if sequential else 2.0 + REFINE_SHARE
    return F.floor(n * float(PROMPT_TOKENS) * F.lit(calls) + tokens * (F.lit(CONTEXT_FACTOR) * F.lit(float(window)) * F.lit(calls) + F.lit(CONTEXT_BASE))).cast("long")


def global_stats(per_namespace: DataFrame) -> DataFrame:
    """Sums over namespaces; the estimate is cut per namespace before it is summed."""
    return per_namespace.agg(*(F.sum(c).alias(c) for c in per_namespace.columns if c != "namespace"))


def window_average(window) -> float:
    """The mean context window of a number or of the numbers of a mapping, 3 by default."""
    numbers = [float(v) for v in (window.values() if isinstance(window, dict) else [window]) if isinstance(v, (int, float))]
    return sum(numbers) / len(numbers) if numbers else 3.0


def status_shares(stats: DataFrame) -> DataFrame:
    """(namespace, status, n, tokens, percent), percent with one decimal."""
    rows = F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n"), F.col(f"tokens_{s}").alias("tokens")) for s in STATUSES))
    each = stats.select("namespace", "total", F.inline(rows))
    return each.select("namespace", "status", "n", "tokens", F.when(F.col("total") > 0, F.round(F.col("n") * 100.0 / F.col("total"), 1)).otherwise(0.0).alias("percent"))


def overview(segments: DataFrame) -> DataFrame:
    return segments.groupBy("namespace").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "generated").alias("generated"))


def blocked(segments: DataFrame) -> DataFrame:
    return segments.groupBy("namespace").agg(F.count_if(F.col("status").isin("conflict", "error")).alias("blocked"))


def costs(stats: DataFrame, price: float = 5.0) -> DataFrame:
    """US dollars at a price per million tokens."""
    return stats.select("namespace", *((F.col(c) * price / 1e6).alias(f"cost_{c.removeprefix('tokens_')}") for c in ("tokens_total", "tokens_pending", "tokens_reflection_estimate")))


def worst_source(segments: DataFrame) -> DataFrame:
    """The longest source of each namespace, the first among equals."""
    rows = segments.withColumn("_tokens", token_count(F.col("source_text")))
    return rows.groupBy("namespace").agg(F.max(F.struct("_tokens", (-F.col("seq")).alias("_back"), "id")).alias("w")).select("namespace", F.col("w.id").alias("id"), F.col("w._tokens").alias("tokens"))
