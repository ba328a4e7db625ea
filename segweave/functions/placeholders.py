"""Placeholder tokens: extraction, repair, comparison, restoration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Patterns of placeholder tokens and of their usual damage.
TOKEN = r'(?i)<[a-z_]+ id="[0-9]+"/>'
HTML_CLOSER = r"(?i)</(?:emph|block|group_start|group_end|macro)[^>]*>"
UNCLOSED_ID = r'(?i)(<[a-z_]+ id=")([0-9]+)/?(?=[^"]*/>)'
FUSED_EMPH = r'(?i)<emph\s+group_start\s+id="([0-9]+)"/>'
MERGED_TAIL = r'(?i)(<[a-z_]+ id="[0-9]+/)[^<]*(?=<[a-z_]+ id=)'
COMMENT = r'(?i)<comment id="[0-9]+"/>'


def extract(text: Column) -> Column:
    """All placeholder tokens in order, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def keep_known(text: Column, source: Column) -> Column:
    """Without tokens that the source does not have."""
    unknown = F.when(source != "", F.array_except(extract(text), extract(source))).otherwise(F.array().cast("array<string>"))
    # the tokens are plain text within the pattern but for their quotes and slash, which mean themselves
    return F.aggregate(unknown, text, lambda t, token: F.regexp_replace(t, F.concat(F.lit("(?i)"), token), F.lit("")))


def restore_comments(text: Column, source: Column) -> Column:
    """Puts comment tokens back between paragraphs where a translation has lost all of them."""
    comments = F.regexp_extract_all(source, F.lit(COMMENT), F.lit(0))
    parts = F.filter(F.transform(F.split(strip(text), r"\n\s*\n"), strip), lambda p: p != "")
    lost = (F.size(comments) > 0) & ~text.rlike(COMMENT) & (F.size(parts) == F.size(comments) + 1)
    rebuilt = F.concat(F.slice(parts, 1, 1), F.zip_with(comments, F.slice(parts, F.lit(2), F.size(comments)), lambda c, p: F.concat(c, p)))
    return F.when(lost, F.array_join(rebuilt, "\n\n")).otherwise(text)


def mended(text: Column, source: Column) -> Column:
    """Undoes damage within and around tokens."""
    fixed = F.regexp_replace(F.regexp_replace(text, HTML_CLOSER, ""), UNCLOSED_ID, r'$1$2"/>')
    fused = F.when(F.contains(source, F.lit(r"\emph<group_start")), F.lit(FUSED_EMPH)).otherwise(F.lit(r"(?!)"))
    fixed = F.regexp_replace(fixed, fused, F.lit(r'\\emph<group_start id="$1"/>'))
    return F.regexp_replace(fixed, MERGED_TAIL, "$1")


def repaired(df: DataFrame, source: str, text: str, out: str) -> DataFrame:
    """``df`` with the text after all repairs, in order. Each step is a column, so it is made once."""
    rows = df.withColumn("_mended", F.when(F.col(text) != "", mended(F.col(text), F.col(source))).otherwise(F.col(text)))
    rows = rows.withColumn("_known", keep_known(F.col("_mended"), F.col(source)))
    return rows.withColumn(out, F.when(F.col(text) != "", restore_comments(F.col("_known"), F.col(source))).otherwise(F.col(text))).drop("_mended", "_known")


def reference(token: Column) -> Column:
    """``<macro id="1"/>`` as ``macro#1``."""
    return F.when(token.rlike(r'(?i)^<[a-z_]+ id="[0-9]+"/>$'), F.lower(F.regexp_replace(token, r'(?i)^<([a-z_]+) id="([0-9]+)"/>$', "$1#$2"))).otherwise(strip(token))


def differences(a: Column, b: Column) -> Column:
    """Struct of each token whose number differs between two token arrays: token, expected, got; sorted by token."""
    keys = F.array_sort(F.array_union(a, b))
    rows = F.transform(keys, lambda k: F.struct(k.alias("token"), F.size(F.filter(a, lambda t: t == k)).alias("expected"), F.size(F.filter(b, lambda t: t == k)).alias("got")))
    return F.filter(rows, lambda r: r["expected"] != r["got"])


def same_tokens(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def mismatch(a: Column, b: Column) -> Column:
    """What is wrong with the tokens of a translation, given both token arrays; null where nothing is."""
    missing, added = F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))
    listed = lambda x: F.array_join(x, ", ")
    counted = F.array_join(F.transform(differences(a, b), lambda d: F.concat(d["token"], F.lit(": expected "), d["expected"].cast("string"), F.lit(", got "), d["got"].cast("string"))), "; ")
    detail = F.concat(
        F.when(F.size(missing) > 0, F.concat(F.lit(" Missing: "), listed(missing), F.lit("."))).otherwise(""),
        F.when(F.size(added) > 0, F.concat(F.lit(" Added (hallucinated): "), listed(added), F.lit("."))).otherwise(""),
        F.when((F.size(missing) == 0) & (F.size(added) == 0), F.concat(F.lit(" Count mismatch ("), counted, F.lit(")."))).otherwise(""),
    )
    return F.when(~same_tokens(a, b), F.concat(F.lit("Placeholder mismatch."), detail))


def drift(persisted: Column, fresh: Column) -> Column:
    """How the stored placeholder map differs from a fresh one; null where they are equal."""
    a, b = F.array_sort(F.map_keys(persisted)), F.array_sort(F.map_keys(fresh))
    changed = F.array_sort(F.filter(a, lambda k: F.element_at(persisted, k) != F.element_at(fresh, k)))
    return (
        F.when((F.size(a) == 0) & (F.size(b) > 0), F.lit("no persisted placeholders"))
        .when((F.size(a) > 0) & (F.size(b) == 0), F.lit("no fresh placeholders"))
        .when(a != b, F.concat(F.lit("keys differ: missing ["), F.array_join(F.array_except(b, a), ", "), F.lit("], stale ["), F.array_join(F.array_except(a, b), ", "), F.lit("]")))
        .when(F.size(changed) > 0, F.concat(F.lit("content differs: "), F.array_join(changed, ", ")))
    )


def restore(text: Column, mapping: Column) -> Column:
    """Struct(text, error): every token of the map replaced by what it stands for, whatever its case."""
    entries = F.map_entries(mapping)
    pattern = lambda key: F.concat(F.lit("(?i)"), F.regexp_replace(key, r"([^a-zA-Z0-9_ ])", r"\\$1"))
    lost = F.filter(F.map_keys(mapping), lambda k: ~F.contains(F.lower(text), F.lower(k)))
    literal = lambda value: F.regexp_replace(value, r"([\\$])", r"\\$1")
    done = F.aggregate(entries, text, lambda t, e: F.regexp_replace(t, pattern(e["key"]), literal(e["value"])))
    left = extract(done)
    error = F.when(F.size(lost) > 0, F.concat(F.lit("missing placeholder "), F.get(lost, F.lit(0)))).when(F.size(left) > 0, F.concat(F.lit("unresolved placeholders: "), F.array_join(left, ", ")))
    return F.struct(done.alias("text"), error.alias("error"))
