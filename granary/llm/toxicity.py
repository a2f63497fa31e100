"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>) over the distinct hashed terms of a text: pairwise
factors learn what linear weights can't, such as an insult together with the mention of a group. Terms enter by their own
G statistic against the label, or by that of a pair they make, against the larger rate of its two terms: so a pair of
terms is learned that are harmless alone. Trained on at most MAX_ROWS labelled rows (those with the smallest hash of
their id), full-batch, on the driver; the model has TERMS rows of 1 + RANK numbers, whatever the corpus.

Null and empty texts score sigmoid(w0). Without labels every score is near 0. A row labelled twice counts as toxic if any label says so; null labels don't count. Of
several texts with one id, the one whose packed terms come first is learned from; each is scored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import arrow_map, texts_of

MAX_ROWS = 8000
BUCKETS = 1 << 18
TERMS, RANK, STEPS, L2 = 512, 8, 250, 1e-3
#: Of all terms (or pairs) tried, chance lets in so many. Chosen among 0.05, 1, 10 and 50 by folds inside the training rows.
CHANCE = 1.0
#: Pairs are sought among so many terms that most rows hold.
PAIR_TERMS = 2048
_TERM = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> set[int]:
    return {zlib.crc32(w.encode()) % BUCKETS for w in set(_TERM.findall(text.lower()))}


@dataclass(frozen=True)
class Machine:
    terms: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, text: str) -> float:
        at = [k for t in terms_of(text) if (k := self.terms.get(t)) is not None]
        v = self.v[at]
        z = self.bias + self.w[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _excess(a: np.ndarray, n: np.ndarray, rate: np.ndarray | float) -> np.ndarray:
    """G statistic of a toxic rows among n where the rate is expected."""
    b = n - a
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.nan_to_num(a * np.log(a / (n * rate)), posinf=0) + np.nan_to_num(b * np.log(b / (n * (1 - rate))), posinf=0))


def _least(tried: int) -> float:
    """The G statistic that chance gives to CHANCE of so many tries."""
    low, high = 0.0, 200.0
    while high - low > 1e-3:
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) * tried > CHANCE else (low, mid)
    return high


def _paired(rows: list[set[int]], y: np.ndarray, seen: np.ndarray, bad: np.ndarray) -> list[int]:
    """Terms of pairs that are toxic more often than both of their terms, the strongest first."""
    often = [int(t) for t in np.argsort(-seen, kind="stable")[:PAIR_TERMS] if seen[t] > 1]
    place = {t: k for k, t in enumerate(often)}
    x = np.zeros((len(rows), len(often)), np.float32)
    for i, r in enumerate(rows):
        x[i, [place[t] for t in r if t in place]] = 1
    toxic, alone = x[y > 0], (bad / np.maximum(seen, 1))[often]
    least, found = _least(max(1, len(often) * (len(often) - 1) // 2)), {}
    for at in range(0, len(often), 256):
        a = (toxic[:, at : at + 256].T @ toxic).astype(np.float64)
        n = (x[:, at : at + 256].T @ x).astype(np.float64)
        rate = np.maximum(alone[at : at + 256, None], alone[None, :])
        g = np.where(a > n * rate, _excess(a, n, np.minimum(rate, 1 - 1e-9)), 0)
        for i, j in zip(*np.nonzero(g > least), strict=True):
            if at + i < j:
                for t in (often[at + i], often[j]):
                    found[t] = max(found.get(t, 0.0), float(g[i, j]))
    return sorted(found, key=lambda t: (-found[t], t))


def fit(rows: list[set[int]], labels: np.ndarray, seed: int = 1) -> Machine:
    """Terms by the G statistic of their own and of their pairs, then Adam on the log loss. No rows, or rows of one label: a constant."""
    y = np.asarray(labels, np.float64)
    n = len(y)
    if not n:
        return Machine({}, -20.0, np.zeros(0), np.zeros((0, RANK)))
    rate = y.mean()
    if not 0 < rate < 1:
        return Machine({}, 20.0 if rate else -20.0, np.zeros(0), np.zeros((0, RANK)))
    seen, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r, t in zip(rows, y, strict=True):
        at = np.fromiter(r, np.int64, len(r))
        seen[at] += 1
        bad[at] += t
    g = np.where(seen > 1, _excess(bad, seen, rate), 0)
    best = np.argsort(-g, kind="stable")
    single = best[g[best] > _least(max(1, (seen > 1).sum()))]
    chosen = dict.fromkeys(single.tolist()) | dict.fromkeys(_paired(rows, y, seen, bad))
    terms = {t: k for k, t in enumerate(list(chosen)[:TERMS])}
    x = np.zeros((n, len(terms)))
    for i, r in enumerate(rows):
        x[i, [terms[t] for t in r if t in terms]] = 1
    rng = np.random.default_rng(seed)
    bias = np.log((rate * n + 0.5) / ((1 - rate) * n + 0.5))
    p = [np.array([bias]), np.zeros(len(terms)), rng.normal(0, 0.1, (len(terms), RANK))]
    m = [np.zeros_like(q) for q in p]
    s = [np.zeros_like(q) for q in p]
    for step in range(1, STEPS + 1):
        xv = x @ p[2]
        z = p[0] + x @ p[1] + 0.5 * ((xv**2).sum(1) - x @ (p[2] ** 2).sum(1))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grads = [np.array([e.sum()]), x.T @ e + L2 * p[1] / 10, x.T @ (e[:, None] * xv) - (x.T @ e)[:, None] * p[2] + L2 * p[2]]
        for k, grad in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.999 * s[k] + 0.001 * grad**2
            p[k] = p[k] - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, float(p[0][0]), p[1], p[2])


def held_out(id_col: str = "doc_id", folds: int = 5):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == 0


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Learns from labelled rows outside the held-out fold."""
    marked = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(MAX_ROWS)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = marked.join(texts, "id").select("id", "y", "text")
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            packed = [np.fromiter(sorted(terms_of(t)), np.int32).tobytes() for t in texts_of(b.column(2))]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["id", "y", "terms"])

        return step

    one = arrow_map(rows, f"id {kind}, y int, terms binary", make).groupBy("id").agg(F.max("y").alias("y"), F.min("terms").alias("terms"))
    got = sorted((bytes(r.terms), r.y) for r in one.collect())
    return fit([set(np.frombuffer(t, np.int32).tolist()) for t, _ in got], np.array([y for _, y in got]))


def apply(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score and predicted."""
    kind = df.select(id_col).dtypes[0][1]

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            scores = [machine.score(t) for t in texts_of(b.column(1))]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

        return step

    scored = arrow_map(df.select(F.col(id_col), F.col(text_col).cast("string")), f"`{id_col}` {kind}, score double", make)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
