"""The queries of the operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, langid, ngram_join, order_minhash, packing, phrase_dedup, suffix_dedup, token_counts, toxicity
from .common import Tables

MULTI = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; where fewer tasks than cores would read them they are dealt out, as tokenizing costs more than moving."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(texts(spark, sf_dir), Tables(spark, "op1")).select("doc_id", "n_links", "component_id", "kept")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(table(spark, sf_dir, "embeddings"), Tables(spark, "op2"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(texts(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(MULTI)
    docs = texts(spark, sf_dir).select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    both = bpe.decode(ids, path, public_tokenizers.PATTERN)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "op7")
    cut = packing.pieces(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packing.pack(tables.save(cut)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(texts(spark, sf_dir), Tables(spark, "op8"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = phrase_dedup.dedup(texts(spark, sf_dir), Tables(spark, "op9"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_embedding_dedup, op3_language_id, op4_byte_bpe, op5_toxicity, op6_order_minhash, op7_packing, op8_suffix_dedup, op9_phrase_dedup, op10_token_counts)
}
SQL: dict[str, str] = {
    "op1_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, u.i, u.i + least(5, len(ws)) - 1), ' ') AS gram FROM w, LATERAL (SELECT unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i) u WHERE len(ws) > 0),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM meet JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE shared / CAST(x.n + y.n - shared AS DOUBLE) >= 0.8),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r),
least_of AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY 1)
SELECT doc_id, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept FROM least_of LEFT JOIN n ON n.a = doc_id""",
    "op2_embedding_dedup": r"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(e) = len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, (SELECT min(r) FROM reach WHERE reach.vec_id = v.vec_id) AS component_id,
       v.vec_id = (SELECT min(r) FROM reach WHERE reach.vec_id = v.vec_id) AS kept FROM v""",
    "op8_suffix_dedup": r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, u.i, md5(substr(h, 2 * u.i + 1, 800)) AS k FROM d, LATERAL (SELECT unnest(range(0, CAST(length(h) // 2 - 399 AS BIGINT))) AS i) u),
often AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS starts FROM win SEMI JOIN often USING (k)),
run AS (SELECT doc_id, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS run, i FROM hit),
gone AS (SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM run GROUP BY 1, 2),
part AS (SELECT doc_id, 0 AS ord, 0::BIGINT AS a, coalesce(min(lo), length(any_value(h)) // 2) AS b FROM d LEFT JOIN gone USING (doc_id) GROUP BY 1
         UNION ALL SELECT doc_id, run, hi, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY run), length(h) // 2) FROM gone JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY ord) AS t FROM part JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(sum(hi - lo), 0) AS BIGINT) AS n_removed, count(lo) AS n_spans, sha256(unhex(any_value(t))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id) GROUP BY doc_id, h""",
    "op9_phrase_dedup": r"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, u.i, md5(array_to_string(list_slice(ws, u.i, u.i + 49), ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i) u),
first_of AS (SELECT h, min(doc_id) AS least FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first_of USING (h) WHERE least < doc_id),
hit AS (SELECT doc_id, list(p) AS ps, count(*) AS n_removed FROM gone GROUP BY 1),
word AS (SELECT doc_id, u.p, ws[u.p] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS p) u),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
