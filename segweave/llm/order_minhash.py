"""Document fingerprints by order MinHash, with DataFrame functions only.

A text is read as tokens: runs of up to eight letters or digits, and other single non-blank characters. Its k-mers are
k consecutive tokens (the last k - 1 of a text are shorter), each numbered by its occurrence. A hash deals every
numbered k-mer to one of ``buckets`` and ranks it there; a bucket keeps its ``length`` least k-mers, in text order,
and the hash of that tuple is one entry. Edits elsewhere leave an entry alone, and moved text changes it: the share of
equal entries falls with edit distance, not only with the set of k-mers. One ranking dealt over the buckets stands for
as many independent ones, so a k-mer is hashed twice in all.

Steps are kept in columns of their own, so that arrays are made once: packed longs hold (hash, position) and sort as
primitive values, which makes each step linear but for those sorts.

Defined cases: a null text is the empty text; texts without tokens have the empty fingerprint, which is alike to
itself only (1) and to no other (0). Texts hold up to 2**30 tokens. Rows with equal ids are ordered by a hash of
their texts; null ids come last. A table of one row is its own next document. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{M}]{1,8}|[^\p{L}\p{N}\p{M}\s]"
POS_BITS, HASH_BITS = 30, 33
POS, HASH = (1 << POS_BITS) - 1, (1 << HASH_BITS) - 1


def entries(df: DataFrame, texts: dict[str, str], k: int = 2, buckets: int = 64, length: int = 2) -> DataFrame:
    """``df`` with an array of entries (long: bucket and tuple hash) for each ``{text column: new column}``."""
    if buckets & (buckets - 1) or not 1 < buckets <= 256:
        raise ValueError("buckets is a power of two up to 256")
    drop = HASH_BITS + POS_BITS - (buckets.bit_length() - 1)
    outs = [*texts.values()]
    bucket = lambda x: F.shiftright(x, drop)

    def step(df: DataFrame, made: dict[str, Column], gone: list[str] = ()) -> DataFrame:
        return df.select(*(c for c in df.columns if c not in made and c not in gone), *(v.alias(n) for n, v in made.items()))

    def tokens(c: str) -> Column:
        return F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(TOKEN), F.lit(0))

    def hashed(c: str) -> Column:  # (hash of the k-mer, position), sorted
        own = F.col(c)
        return F.sort_array(F.transform(own, lambda x, i: F.shiftleft(F.xxhash64(x, *(F.get(own, i + j) for j in range(1, k))).bitwiseAND(F.lit(HASH)), POS_BITS).bitwiseOR(i.cast("long"))))

    def run_starts(c: str) -> Column:
        own = F.col(c)
        at = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.shiftright(F.get(own, i), POS_BITS) != F.shiftright(F.get(own, i - 1), POS_BITS)))
        return F.when(F.size(own) > 0, at).otherwise(F.array().cast("array<int>"))

    def ranked(c: str, starts: str) -> Column:  # (bucket, rank, position) of each numbered k-mer, sorted
        own, runs = F.col(c), F.col(starts)

        def run(s: Column, j: Column) -> Column:
            stop = F.coalesce(F.get(runs, j + 1), F.size(own)) - 1
            return F.transform(F.slice(own, s + 1, stop - s + 1), lambda p, t: F.shiftleft(F.xxhash64(F.shiftright(p, POS_BITS), t).bitwiseAND(F.lit(HASH)), POS_BITS).bitwiseOR(p.bitwiseAND(F.lit(POS))))

        return F.sort_array(F.flatten(F.transform(runs, run)))

    def least(c: str) -> Column:
        own = F.col(c)
        return F.filter(own, lambda x, i: (i < length) | (bucket(F.get(own, i - length)) != bucket(x)))

    def bucket_starts(c: str) -> Column:
        own = F.col(c)
        at = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (bucket(F.get(own, i)) != bucket(F.get(own, i - 1))))
        return F.when(F.size(own) > 0, at).otherwise(F.array().cast("array<int>"))

    def tuples(c: str, starts: str) -> Column:
        own, runs = F.col(c), F.col(starts)

        def entry(s: Column, j: Column) -> Column:
            part = F.slice(own, s + 1, F.coalesce(F.get(runs, j + 1), F.size(own)) - s)
            in_order = F.sort_array(F.transform(part, lambda e: F.shiftleft(e.bitwiseAND(F.lit(POS)), HASH_BITS).bitwiseOR(F.shiftright(e, POS_BITS))))
            tuple_hash = F.xxhash64(F.transform(in_order, lambda e: e.bitwiseAND(F.lit(HASH))))
            return F.shiftleft(bucket(F.get(own, s)), 24).bitwiseOR(tuple_hash.bitwiseAND(F.lit((1 << 24) - 1)))

        return F.transform(runs, entry)

    df = step(df, {o: tokens(c) for c, o in texts.items()})
    df = step(df, {o: hashed(o) for o in outs})
    df = step(df, {f"_s_{o}": run_starts(o) for o in outs})
    df = step(df, {o: ranked(o, f"_s_{o}") for o in outs}, [f"_s_{o}" for o in outs])
    df = step(df, {o: least(o) for o in outs})
    df = step(df, {f"_s_{o}": bucket_starts(o) for o in outs})
    return step(df, {o: tuples(o, f"_s_{o}") for o in outs}, [f"_s_{o}" for o in outs])


def as_text(entry_col: str) -> Column:
    """The fingerprint: eight hexadecimal digits per entry, the first two of which name the bucket."""
    return F.array_join(F.transform(F.col(entry_col), lambda e: F.lower(F.lpad(F.hex(e), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal entries among the buckets that either text fills; 1 for two empty fingerprints."""
    both = F.size(F.array_intersect(a, b))
    filled = F.size(F.array_union(F.transform(F.col(a), lambda e: F.shiftright(e, 24)), F.transform(F.col(b), lambda e: F.shiftright(e, 24))))
    return F.when(filled > 0, both / filled).otherwise(F.lit(1.0))


def with_ranges(df: DataFrame, id_col: str, ranges: int) -> DataFrame:
    """Deals rows to ranges of the id and adds, to each range, the row that follows its last one.

    New columns: ``_range``, ``_key`` (the id, null as least), ``_extra`` (true for an added row). Only numbers per range
    (bounds and greatest ids, ``ranges`` of them) reach the driver.
    """
    keyed = df.withColumn("_key", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    parts = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = sorted(set(keyed.agg(F.percentile_approx("_key", parts, 100 * ranges)).first()[0] or []))
    steps = [1 << i for i in range(len(bounds).bit_length(), -1, -1)]
    known = F.array(*map(F.lit, bounds)).cast("array<long>")
    search = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(F.get(known, lo + s - 1) <= F.col("_key"), lo + s).otherwise(lo))
    keyed = keyed.withColumn("_range", search)
    heads = sorted((r["_range"], r["head"]) for r in keyed.groupBy("_range").agg(F.max("_key").alias("head")).collect())
    after = {head: heads[(at + 1) % len(heads)][0] for at, (_, head) in enumerate(heads)}
    pairs = F.array(*(F.struct(F.lit(head).cast("long").alias("_key"), F.lit(to).cast("int").alias("_to")) for head, to in after.items()))
    extra = df.sparkSession.range(1).select(F.inline(pairs)) if after else df.sparkSession.sql("select 0L as _key, 0 as _to where false")
    homes = F.array(F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_extra")))
    more = F.array(F.struct(F.col("_to").alias("_range"), F.lit(True).alias("_extra")))
    joined = keyed.join(F.broadcast(extra), "_key", "left").withColumn("_home", F.explode(F.when(F.col("_to").isNull(), homes).otherwise(F.concat(homes, more))))
    return joined.select(*df.columns, "_key", "_home._range", "_home._extra")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, k: int = 2, buckets: int = 64, length: int = 2) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document (descending
    id; after the last the first). One exchange deals the texts by id range; both windows use it.
    """
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("_hash"))
    rows = with_ranges(rows, id_col, max(2, ranges))
    order = Window.partitionBy("_range").orderBy("_extra", F.desc("_key"), "_hash")
    rows = rows.withColumn("_next", F.coalesce(F.lead("_text").over(order), F.lit("")))
    rows = rows.withColumn("n_chars", F.char_length("_text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("_next", F.lit(1), half))
    rows = rows.select(id_col, "_range", "_extra", "_key", "_hash", "n_chars", "_text", edited.alias("_edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    rows = entries(rows, {"_text": "_own", "_edited": "_changed"}, k, buckets, length).drop("_text", "_edited")
    rows = rows.withColumn("_following", F.lead("_own").over(order)).where(~F.col("_extra"))
    return rows.select(id_col, "n_chars", "edited_sha256", as_text("_own").alias("fingerprint"), as_text("_changed").alias("edited_fingerprint"), likeness("_own", "_changed").alias("near_edited"), likeness("_own", "_following").alias("near_next"))
