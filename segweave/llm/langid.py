"""Language ID: nearest centroid over normalised TF-IDF character n-grams, with distance-based rejection.

Texts are lower-cased; runs of anything but letters become one space; byte 2-, 3- and 4-grams of the UTF-8 bytes are hashed to
``DIM`` counts. A vector is log(1 + count) times the corpus IDF, scaled to length 1. Each language is described by
several centroids (spherical k-means); a text takes the language of the nearest centroid by cosine and is *rejected*
where it lies farther from that centroid than nearly all learning rows of the language lie from theirs. Short texts lie
farther off by chance: with n distinct n-grams the cosine grows like sqrt(n / (n + bend)), so it is taken as a multiple of
that, with one bend a language. The least multiple that is not rejected is ``margin`` times the ``tail`` quantile of the
language's learning rows, each measured from its centroid without itself.

Defined cases: null text or text without a letter gives ``und``, score 0, rejected. Rows whose language is null are
never learned from. A corpus without labelled rows gives ``und`` everywhere. Repeated rows are predicted alike;
ties go to the language that sorts first. Columns of the input that clash with the outputs are replaced by them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_rows

DIM = 8192
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
OUT = {"lang_pred": "string", "score": "double", "rejected": "boolean", "cosine": "double"}


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text, None where it has no letter."""
    if text is None:
        return None
    plain = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not regex.search(r"\p{L}", plain):
        return None
    total = np.zeros(DIM, np.int64)
    data = np.frombuffer(f" {plain} ".encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(data), 1 << 20):  # pieces overlap by 3 bytes; each n-gram counts in one of them
        part = data[at : at + (1 << 20) + 3].astype(np.uint32)
        two = (part[:-1] << 8) | part[1:]
        three = (two[:-1] << 8) | part[2:]
        four = (three[:-1] << 8) | part[3:]
        for width, code in ((2, two), (3, three), (4, four)):
            code = code[: max(0, min(len(code), (1 << 20)))] if at + (1 << 20) < len(data) else code
            total += np.bincount(((code * np.uint32(0x9E3779B1) + np.uint32(width * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(19)).astype(np.int64), minlength=DIM)
    return total


@dataclass
class LangModel:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # index into langs
    floor: np.ndarray  # least multiple of the expected cosine that is not rejected, by centroid
    bend: np.ndarray  # see expected(), by centroid
    sharpness: float = 24.0

    def vector(self, total: np.ndarray) -> np.ndarray:
        v = np.log1p(total).astype(np.float32) * self.idf
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float]]:
        found: list[tuple[str, float, bool, float]] = [("und", 0.0, True, 0.0)] * len(texts)
        if not self.langs:
            return found
        for at in range(0, len(texts), 128):
            rows = [(i, c) for i, t in enumerate(texts[at : at + 128], at) if (c := counts(t)) is not None]
            if not rows:
                continue
            cos = np.stack([self.vector(c) for _, c in rows]) @ self.centroids.T
            for (i, c), each in zip(rows, cos):
                best = int(np.argmax(each))
                least = self.floor[best] * expected(np.count_nonzero(c), self.bend[best])
                by_lang = np.array([each[self.owner == k].max() for k in range(len(self.langs))])
                odds = np.exp(self.sharpness * (by_lang - by_lang.max()))
                found[i] = (self.langs[self.owner[best]], float(odds.max() / odds.sum()), bool(each[best] < least), float(each[best]))
        return found


def expected(sizes, bend):
    """How the cosine to a text's own centroid grows with its distinct n-grams, up to a factor."""
    return np.sqrt(sizes / (sizes + bend))


def kmeans(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of at most k clusters. The start is drawn as in k-means++ from a fixed seed, so the same rows give
    the same centroids; a cluster of less than an eighth of its even share is given up, as outliers make no centroid."""
    rng = np.random.default_rng(seed)
    chosen, far = [int(np.argmax(rows @ rows.sum(0)))], np.full(len(rows), np.inf)
    while len(chosen) < min(k, len(rows)):
        far = np.minimum(far, np.maximum(0.0, 1.0 - (rows @ rows[chosen[-1]]).astype(np.float64)))
        if far.sum() < 1e-6:  # copies of one row
            break
        chosen.append(int(rng.choice(len(rows), p=far / far.sum())))
    centres = rows[chosen]
    for _ in range(rounds):
        near = np.argmax(rows @ centres.T, axis=1)
        n = np.bincount(near, minlength=len(centres))
        centres = np.stack([rows[near == j].sum(0) for j in np.flatnonzero(n >= min(n.max(), len(rows) / (8 * k)))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres, np.argmax(rows @ centres.T, axis=1)


def without_self(rows: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The cosine of each row to the sum of the other rows of its cluster; NaN where it has no other."""
    cos = np.full(len(rows), np.nan)
    for j in np.unique(near):
        own = np.flatnonzero(near == j)
        if len(own) > 1:
            total = rows[own].sum(0).astype(np.float64)
            # in slices, as the product makes doubles of its rows
            along = np.concatenate([rows[own[at : at + 64]] @ total for at in range(0, len(own), 64)])
            cos[own] = (along - 1) / np.sqrt(np.maximum(total @ total - 2 * along + 1, 1e-12))
    return cos


def limits(cos: np.ndarray, sizes: np.ndarray, tail: float, margin: float) -> tuple[float, float]:
    """(floor, bend) of a language: the bend that leaves the multiples of the expected cosine least scattered."""
    ok = np.isfinite(cos)
    if not ok.any():  # a language of single rows says nothing of its spread
        return 0.0, 1.0
    cos, sizes = np.maximum(cos[ok], 1e-3), sizes[ok]

    def scatter(bend: float) -> float:
        off = np.log(cos / expected(sizes, bend))
        return float(np.mean(np.abs(off - np.median(off))))

    bend = min((2.0 ** (i / 2) for i in range(27)), key=scatter)
    return margin * float(np.quantile(cos / expected(sizes, bend), tail)), bend


def packed(counted: np.ndarray) -> bytes:
    """The counts (65,535 at most) as unsigned 16-bit integers, deflated: most are 0."""
    return zlib.compress(np.minimum(counted, 65535).astype("<u2").tobytes(), 6)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u2")


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, per_lang: int = 600, k: int = 6, tail: float = 0.01, margin: float = 0.75) -> LangModel:
    """Learns from the rows of ``df`` that ``where`` keeps and that have a language.

    IDF counts documents over all these rows. The centroids are fitted on a sample of about ``per_lang`` distinct texts of
    each language, those of the least hashes, so that copies neither fill the sample nor change it from run to run (the
    bound: ``2 * per_lang`` a language on average, as hashed counts of fixed size; at most as many of one are used).
    """
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.where(where) if where is not None else known
    known = known.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text", F.lit(11)), 0.02).alias("n")).collect()}

    def frequency(batches):
        seen, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (c := counts(text.as_py())) is not None:
                    seen += c > 0
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM), pa.int32()), pa.array(np.concatenate([[n], seen]), pa.int64())], ["term", "n"])

    by_term = known.select("text").mapInArrow(frequency, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    if not by_term:
        return LangModel([], np.zeros(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0, np.float32), np.zeros(0, np.float32))
    seen, total = np.zeros(DIM), 0
    for r in by_term:
        if r["term"] < 0:
            total = r["n"]
        else:
            seen[r["term"]] = r["n"]
    idf = (np.log((1 + total) / (1 + seen)) + 0.05).astype(np.float32)

    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, min(1.0, per_lang / n)).otherwise(rate)
    # the place of a text in its language's sample, from 0; the sample ends at 1
    drawn = known.withColumn("at", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 40)) / (rate * (1 << 40))).where("at < 1").dropDuplicates(["lang", "text"])

    def sampled(batch):
        rows = [(lang.as_py(), at.as_py(), c) for text, lang, at in zip(*batch.columns) if (c := counts(text.as_py())) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in rows], pa.string()), pa.array([x for _, x, _ in rows], pa.float64()), pa.array([packed(c) for _, _, c in rows], pa.binary())], ["lang", "at", "counts"])

    rows = map_rows(drawn, sampled, "lang string, at double, counts binary").orderBy("at", "lang", "counts").limit(2 * per_lang * max(1, len(sizes))).collect()
    model = LangModel(sorted({r["lang"] for r in rows}), idf, np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0, np.float32), np.zeros(0, np.float32))
    parts, owner, floor, bend = [], [], [], []
    for at, lang in enumerate(model.langs):
        own = sorted([bytes(r["counts"]) for r in rows if r["lang"] == lang][: 2 * per_lang])
        vectors, filled = np.empty((len(own), DIM), np.float32), np.empty(len(own), np.int64)
        for i, data in enumerate(own):  # one at a time: the driver holds them once, as vectors
            counted = unpacked(data)
            vectors[i], filled[i] = model.vector(counted), np.count_nonzero(counted)
        centres, near = kmeans(vectors, k)
        least = limits(without_self(vectors, near), filled, tail, margin)
        for centre in centres:
            parts.append(centre)
            owner.append(at)
            floor.append(least[0])
            bend.append(least[1])
    model.centroids, model.owner, model.floor, model.bend = np.stack(parts).astype(np.float32), np.array(owner), np.array(floor, np.float32), np.array(bend, np.float32)
    return model


def annotate(df: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """``df`` with the columns lang_pred, score, rejected and cosine."""
    keep = [c for c in df.columns if c not in OUT]
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in OUT.items())])

    def run(batch):
        found = sent.value.predict(batch.column(keep.index(text_col)).to_pylist())
        more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_()), pa.array([f[3] for f in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*keep, *OUT])

    return map_rows(df.select(*keep), run, schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """Learns from the rows that are not held out, and predicts all: id, held_out and the columns of ``annotate``."""
    model = fit(df, text_col, lang_col, ~held_out(id_col), **fitting)
    rows = df.select(F.col(id_col), F.col(text_col), held_out(id_col).alias("held_out"))
    return annotate(rows, model, text_col).drop(text_col)
