"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), over the distinct terms i of a text, hashed to
``2**BITS`` places; x_i = 1 / terms**power. Terms are the lower-case words and, for inflected forms, their first four and
five letters. The pairwise part learns that an insult together with a group mention weighs more than the two apart. Only
places that a likelihood-ratio test ties to the label, at a level that expects less than one false tie over all
places, get weights; the others keep 0, so that few learning rows don't make rare words matter.

Defined cases: null or wordless texts score by the bias alone. Without labelled rows of both kinds every score is the
share of toxic labels (0 where there is none). Repeated rows score alike. Clashing input columns are replaced.
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
from xxhash import xxh32_intdigest

from .common import held_out, map_rows

BITS = 18
RANK = 6
STEMS = (4, 5)
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
OUT = {"score": "double", "predicted": "int"}


def terms(text: str | None) -> np.ndarray:
    """Hashed places of the distinct words of the whole text and of their beginnings."""
    words = set(WORD.findall(text.lower())) if text else set()
    words |= {f"^{w[:size]}" for w in words for size in STEMS if len(w) >= size}
    return np.unique(np.fromiter((xxh32_intdigest(w) >> (32 - BITS) for w in words), np.int64, len(words)))


@dataclass
class FactorMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    power: float = 0.25

    def logits(self, places: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of texts with ``sizes`` terms, given as (place, text) pairs; also the values x and the factor sums."""
        n = len(sizes)
        x = (sizes ** -self.power)[rows].astype(np.float32)
        vx = self.factors[places] * x[:, None]
        total = np.stack([np.bincount(rows, vx[:, f], n) for f in range(vx.shape[1])], axis=1)
        squares = np.bincount(rows, np.einsum("ij,ij->i", vx, vx), n)
        z = self.bias + np.bincount(rows, self.linear[places] * x, n) + 0.5 * (np.einsum("ij,ij->i", total, total) - squares)
        return z, x, total

    def scores(self, texts: list[str | None]) -> np.ndarray:
        each = [terms(t) for t in texts]
        sizes = np.array([max(1, len(e)) for e in each], np.float64)
        # places whose own weight the L1 step has set to 0 still count in pairs
        each = [e[(self.linear[e] != 0) | self.factors[e].any(axis=1)] for e in each]
        rows = np.repeat(np.arange(len(each)), [len(e) for e in each])
        z, _, _ = self.logits(np.concatenate([*each, np.empty(0, np.int64)]), rows, sizes)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def associated(samples: list[tuple[np.ndarray, int]], share: float, size: int) -> np.ndarray:
    """True for places whose presence depends on the label (G-test of presence by label)."""
    n = np.zeros((2, size))
    for places, y in samples:
        n[y, places] += 1
    rows = np.array([[len(samples) * (1 - share)], [len(samples) * share]])
    mean = n.sum(axis=0) / len(samples)
    g = np.zeros(size)
    with np.errstate(divide="ignore", invalid="ignore"):
        for had, expected in ((n, rows * mean), (rows - n, rows * (1 - mean))):
            g += 2 * np.nansum(np.where(had > 0, had * np.log(had / expected), 0.0), axis=0)
    return g >= 2 * np.log(2 * max(1, int((mean > 0).sum())))


def train(samples: list[tuple[np.ndarray, int]], steps: int = 1500, rate: float = 0.3, l1: float = 1e-4, l2: float = 1e-4, batch: int = 128, power: float = 0.0, seed: int = 5) -> FactorMachine:
    """Proximal AdaGrad on the logistic loss for about ``steps`` batches; toxic rows weigh up to four times as much."""
    y = np.array([s[1] for s in samples], np.float64)
    share = float(y.mean()) if len(y) else 0.0
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    model = FactorMachine(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(size, np.float32), np.zeros((size, RANK), np.float32), power)
    if not len(y) or share in (0.0, 1.0):
        return model
    known = associated(samples, share, size)
    model.factors[known] = rng.normal(0, 0.01, (int(known.sum()), RANK))
    # the sizes that x depends on count all terms, as in scoring
    each_size = np.array([max(1, len(s[0])) for s in samples], np.float64)
    each = [s[0][known[s[0]]].astype(np.int64) for s in samples]
    weight = np.where(y == 1, min(4.0, (1 - share) / share), 1.0)
    g_b, g_w, g_v = 1e-3, np.full(size, 1e-3, np.float32), np.full((size, RANK), 1e-3, np.float32)
    for _ in range(max(3, -(-steps * batch // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            rows = np.repeat(np.arange(len(pick)), [len(each[i]) for i in pick])
            places = np.concatenate([*(each[i] for i in pick), np.empty(0, np.int64)])
            z, x, total = model.logits(places, rows, each_size[pick])
            d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[pick]) * weight[pick] / len(pick)
            own, back = np.unique(places, return_inverse=True)
            grad_w = np.bincount(back, d[rows] * x, len(own))
            vx = (total[rows] - model.factors[places] * x[:, None]) * (d[rows] * x)[:, None]
            grad_v = np.stack([np.bincount(back, vx[:, f], len(own)) for f in range(RANK)], axis=1) + l2 * model.factors[own]
            g_b += float(d.sum()) ** 2
            model.bias -= rate * float(d.sum()) / np.sqrt(g_b)
            g_w[own] += grad_w**2
            pace = rate / np.sqrt(g_w[own])
            moved = model.linear[own] - pace * grad_w
            model.linear[own] = np.sign(moved) * np.maximum(np.abs(moved) - pace * l1, 0)  # the L1 step drops what is noise
            g_v[own] += grad_v**2
            model.factors[own] -= 0.2 * rate * grad_v / np.sqrt(g_v[own])
    return model


def packed(places: np.ndarray) -> bytes:
    """Ascending places as the deflated steps between them: a third of their size."""
    return zlib.compress(np.diff(places, prepend=0).astype("<i4").tobytes(), 6)


def unpacked(data: bytes) -> bytes:
    """The places as 32-bit integers."""
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype="<i4").tobytes()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None, most: int = 12_000) -> FactorMachine:
    """Learns from a sample of about ``most`` distinct labelled texts (the bound: at most ``2 * most`` reach the driver, as
    deflated hashed terms), those of the least hashes, so that copies neither fill the sample nor change it from run to run."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    rows = docs.where(where) if where is not None else docs
    rows = rows.select(id_col, F.col(text_col).alias("_t")).where(F.col("_t").isNotNull())
    rows = rows.withColumn("_at", F.pmod(F.xxhash64("_t", F.lit(3)), F.lit(1_000_000_000)))
    n = rows.select(id_col, "_at").join(marks, id_col).agg(F.approx_count_distinct("_at", 0.02)).first()[0]
    rows = rows.where(F.col("_at") < max(1, round(1_000_000_000 * min(1.0, most / max(1, n)))))

    def hashed(batch):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(terms(t.as_py())) for t in batch.column(1)], pa.binary()), batch.column(2)], ["_id", "places", "_at"])

    kind = rows.schema[id_col].dataType.simpleString()
    drawn = map_rows(rows, hashed, f"_id {kind}, places binary, _at long").join(marks.withColumnRenamed(id_col, "_id"), "_id").select("_y", "places", "_at").distinct()
    got = sorted((unpacked(r["places"]), r["_y"]) for r in drawn.orderBy("_at", "_y", "places").limit(2 * most).collect())
    return train([(np.frombuffer(p, "<i4"), int(y)) for p, y in got])


def annotate(df: DataFrame, model: FactorMachine, text_col: str = "text") -> DataFrame:
    """``df`` with the columns score and predicted."""
    keep = [c for c in df.columns if c not in OUT]
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in OUT.items())])

    def run(batch):
        score = sent.value.scores(batch.column(keep.index(text_col)).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], [*keep, *OUT])

    return map_rows(df.select(*keep), run, schema, 256)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """Learns from labelled rows that are not held out, and scores all: id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, where=~held_out(id_col), **fitting)
    rows = docs.select(F.col(id_col), F.col(text_col), held_out(id_col).alias("held_out"))
    return annotate(rows, model, text_col).drop(text_col)
