"""Scalar text functions as Column expressions: identity, counts and the linguistic-content rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character classes and patterns.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PLACEHOLDER = r'<[a-z_]+ id="[0-9]+"/>'
WORD = r"[a-zA-ZÀ-ɏЀ-ӿ]{3,}"
NON_LATIN = r"[一-鿿぀-ヿ가-힯؀-ۿ]{2,}"
TEX_PARAM = r"#[0-9]"
INTERNAL_AT = r"@[\p{L}\p{N}_]+"
DIMENSION = r"(?i)(?:[0-9]*\.[0-9]+|[0-9]+)\s*(?:in|pt|em|ex|true|false)(?:[^\p{L}\p{N}_]|$)"
PROSE_HINT = r"(?i)(?:^|[^\p{L}\p{N}_])(?:the|and|or|for|with|from|that|this|are|was|were|have|has|been|will|see|fig|figure|hello|hola)(?:[^\p{L}\p{N}_]|$)"
SENTENCE_END = r"[\p{L}\p{N}_][.!?](?:\s|$)"


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(SPACES))


def source_hash(text: Column) -> Column:
    """SHA-256 of the text with runs of white space as one blank."""
    return F.sha2(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")), 256)


def segment_id(text: Column) -> Column:
    return F.substring(source_hash(text), 1, 12)


def token_count(text: Column) -> Column:
    """Tokens by length: a quarter of the code points. ``tokens_by`` plugs in another counter."""
    return F.floor(F.char_length(text) / 4).cast("long")


def tokens_by(encode):
    """A pandas UDF that counts tokens with ``encode`` (text to ids)."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t or "")))

    return counted


def tokenizer_count(text: Column, path: str | None = None) -> Column:
    """Tokens by a ``tokenizers`` file, without special tokens; by default the byte-level BPE of 50k ids of the public set."""
    import public_tokenizers

    file = path or public_tokenizers.path("byte_bpe_50k.json")
    held: list = []

    def encode(t: str) -> list[int]:
        if not held:  # once a worker
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(file))
        return held[0].encode(t, add_special_tokens=False).ids

    return tokens_by(encode)(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def alpha_count(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))


def strip_commands(text: Column) -> Column:
    """Without command names that stand right before letters."""
    return F.regexp_replace(text, r"\\[a-z]+([A-Za-z])", "$1")


def linguistic_features(df: DataFrame, text_col: str = "source_text", out: str = "features") -> DataFrame:
    """``df`` with a struct of what the rules look at; each expression is computed once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = F.char_length(text) - F.char_length(F.regexp_replace(text, PLACEHOLDER, ""))
    step = df.withColumn("_plain", strip(strip_commands(F.regexp_replace(text, PLACEHOLDER, "")))).withColumn("_share", F.when(F.char_length(text) > 0, marks / F.char_length(text)).otherwise(0.0))
    plain = F.col("_plain")
    made = F.struct(
        (F.char_length(strip(text)) == 0).alias("blank"),
        F.col("_share").alias("placeholder_ratio"),
        word_count(plain).cast("int").alias("words"),
        alpha_count(plain).cast("int").alias("alpha"),
        F.regexp_count(plain, F.lit(TEX_PARAM)).cast("int").alias("params"),
        F.regexp_count(plain, F.lit(DIMENSION)).cast("int").alias("dimensions"),
        F.regexp_count(plain, F.lit(INTERNAL_AT)).cast("int").alias("ats"),
        plain.rlike(PROSE_HINT).alias("hint"),
        plain.rlike(SENTENCE_END).alias("sentence"),
        plain.rlike(NON_LATIN).alias("non_latin"),
    )
    # through a generator, as the optimizer would copy every feature into each place of a filter below a projection
    rows = step.withColumn("_made", F.array(made))
    return rows.select(*df.columns, F.explode_outer("_made").alias(out))


def is_linguistic(features: str = "features") -> Column:
    """The ordered rules over a features struct: the first that decides wins."""
    f = lambda name: F.col(f"{features}.{name}")
    ratio, words, alpha, params = f("placeholder_ratio"), f("words"), f("alpha"), f("params")
    return (
        F.when(f("blank") | (alpha == 0), False)
        .when(f("non_latin"), True)
        .when(words == 0, False)
        .when(params >= 2, False)
        .when((params == 0) & (ratio < 0.85) & (words == 1) & (alpha >= 3) & (f("dimensions") == 0) & (f("ats") == 0), True)
        .when(f("hint") & (params == 0) & (alpha >= 5) & (ratio < 0.85), True)
        .when((params >= 1) & ((ratio > 0.15) | (alpha < 25)), False)
        .when((words >= 3) & f("hint"), True)
        .when((words >= 2) & (alpha >= 8) & (params == 0) & (f("hint") | f("sentence")), True)
        .when((f("dimensions") >= 2) & (ratio > 0.3), False)
        .when((f("ats") >= 2) & (alpha < 30), False)
        .when((ratio > 0.7) & (alpha < 40), False)
        .when((ratio > 0.5) & (words < 2), False)
        .when((words == 1) & (alpha < 12), False)
        .otherwise(alpha >= 8)
    )


def with_linguistic(df: DataFrame, text_col: str = "source_text", out: str = "linguistic") -> DataFrame:
    return linguistic_features(df, text_col, "_features").withColumn(out, is_linguistic("_features")).drop("_features")


def namespace_of(path: Column) -> Column:
    """Namespace of a path below the workspace: without extension, separators as two underscores."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/", "__")


def preview(text: Column, size: int = 50) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def truncate_tokens(text: Column, cap: Column) -> Column:
    """The longest prefix within a token cap (by length), without trailing white space."""
    return F.when(cap <= 0, F.lit("")).when(token_count(text) <= cap, text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), (cap * 4 + 3).cast("int")), f"{SPACE}+$", ""))
