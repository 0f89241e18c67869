"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first four and five letters, each hashed to
2**20 buckets. score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), with x_i = 1 for the
terms present: the pairwise part learns combinations, such as an insult with a group mention, that
linear weights add up wrongly.

Fitting uses a bounded sample of the labelled rows (``SAMPLE`` in expectation, chosen by hash) and of
all buckets at most ``FEATURES``, those whose presence depends on the label beyond chance (G test).
Whole texts are scored.

Defined results: null text counts as empty and gets the score of no terms; labels null in doc_id or
toxic are left out, doc_ids labelled twice count as toxic if any label is 1; without labels every
score is 0; rows with null doc_id are scored and never held out; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.work import save

BUCKETS, SAMPLE, FEATURES, LEAST_G, LEAST_DOCS = 1 << 20, 20_000, 4096, 24.0, 4
RANK, ROUNDS, RATE, DECAY = 8, 300, 0.1, 1e-4
THRESHOLD = 0.7
#: Texts whose terms are in memory at once; changes no result.
TOGETHER = 256
WORDS = regex.compile(r"[\p{L}\p{N}]+")


def buckets(word: str) -> list[int]:
    """Of one piece of text between white space."""
    terms = {x for w in WORDS.findall(word) for x in (w, f"4 {w[:4]}", f"5 {w[:5]}")}
    return [xxhash.xxh64_intdigest(t) % BUCKETS for t in terms]


class Terms:
    """Cached buckets of words, reduced to ``number``: bucket → feature, if given."""

    def __init__(self, number: dict[int, int] | None = None, most: int = 200_000):
        self.number, self.most, self.known = number, most, {}

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        known, number = self.known, self.number
        for w in set((text or "").lower().split()):
            got = known.get(w)
            if got is None:
                got = buckets(w)
                if number is not None:
                    got = [number[x] for x in got if x in number]
                if len(known) > self.most:
                    known.clear()
                known[w] = got
            if got:
                out.update(got)
        return out


class Machine:
    """A fitted factorization machine."""

    def __init__(self, number: dict[int, int], w0: float, w: np.ndarray, v: np.ndarray):
        self.number, self.w0, self.w, self.v = number, w0, w, v

    def raw(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        out = self.w0 + np.bincount(row, self.w[feature], rows)
        for f in range(self.v.shape[1]):
            x = self.v[feature, f]
            out += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return out

    def score(self, column: pa.Array, terms: Terms) -> np.ndarray:
        """Of each text of ``column``; terms are held for ``TOGETHER`` texts at a time."""
        parts = [self._score(column.slice(at, TOGETHER).to_pylist(), terms) for at in range(0, len(column), TOGETHER)]
        return np.concatenate(parts) if parts else np.empty(0)

    def _score(self, texts: list[str | None], terms: Terms) -> np.ndarray:
        sets = [terms.of(t) for t in texts]
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        feature = np.fromiter((x for s in sets for x in sorted(s)), np.int64, len(row))
        return 1 / (1 + np.exp(-np.clip(self.raw(row, feature, len(sets)), -500, 500)))


def train(row: np.ndarray, feature: np.ndarray, y: np.ndarray, number: dict[int, int]) -> Machine:
    """Log loss with decay, by AdaGrad over all rows."""
    n, k = len(y), len(number)
    base = (y.sum() + 0.5) / (n + 1)
    rng = np.random.default_rng(3)
    m = Machine(number, float(np.log(base / (1 - base))), np.zeros(k), rng.normal(0, 0.01, (k, RANK)))
    if not k:
        return m
    g0, gw, gv = 1e-8, np.full(k, 1e-8), np.full((k, RANK), 1e-8)
    for _ in range(ROUNDS):
        error = (1 / (1 + np.exp(-np.clip(m.raw(row, feature, n), -30, 30))) - y) / n
        e = error[row]
        d0, dw = error.sum(), np.bincount(feature, e, k) + DECAY * m.w
        dv = np.empty_like(m.v)
        for f in range(RANK):
            x = m.v[feature, f]
            s = np.bincount(row, x, n)
            dv[:, f] = np.bincount(feature, e * (s[row] - x), k) + DECAY * m.v[:, f]
        g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
        m.w0 -= RATE * d0 / np.sqrt(g0)
        m.w -= RATE * dw / np.sqrt(gw)
        m.v -= RATE * dv / np.sqrt(gv)
    return m


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Machine | None:
    """``labels``: (doc_id, toxic), the rows to learn from. None without any."""
    y = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = y.count()
    if not n:
        return None
    y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n)))
    # at most about ``sample`` rows of two numbers: the bound that makes this broadcast safe
    rows = save(df.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("toxic", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        seen: dict[int, list[int]] = {}
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for x in terms.of(text.as_py()):
                    seen.setdefault(x, [0, 0])[toxic > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["bucket", "clean", "toxic"])

    clean, toxic = rows.agg(F.count(F.when(F.col("toxic") <= 0, 1)), F.count(F.when(F.col("toxic") > 0, 1))).first()
    if not clean + toxic:
        return None
    seen = rows.mapInArrow(count, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = F.lit(float(clean + toxic))

    def part(cell, a, b):
        return F.when(cell > 0, cell * F.log(cell * total / (a * b))).otherwise(F.lit(0.0))

    has = F.col("clean") + F.col("toxic")
    g = 2 * (
        part(F.col("clean"), has, F.lit(clean)) + part(F.col("toxic"), has, F.lit(toxic)) + part(F.lit(clean) - F.col("clean"), total - has, F.lit(clean)) + part(F.lit(toxic) - F.col("toxic"), total - has, F.lit(toxic))
    )
    best = seen.where((has >= LEAST_DOCS) & (has < total)).withColumn("g", g).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "bucket").limit(features)
    number = {r["bucket"]: i for i, r in enumerate(best.select("bucket").collect())}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(number)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(terms.of(t.as_py())) for t in b.column(1)], pa.list_(pa.int32()))], names=["toxic", "features"])

    # bounded as the sample is; sorted, so that sums and so the fit don't depend on the order of tasks
    got = sorted((tuple(r["features"]), int(r["toxic"] > 0)) for r in rows.mapInArrow(reduce, "toxic int, features array<int>").collect())
    row = np.repeat(np.arange(len(got)), [len(f) for f, _ in got])
    feature = np.fromiter((x for f, _ in got for x in f), np.int64, len(row))
    return train(row, feature, np.array([t for _, t in got], np.float64), number)


def score(df: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        terms = Terms(m.number) if m else None
        for b in batches:
            s = m.score(b.column(1), terms) if m else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def keep_clean(df: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without the rows that score ``threshold`` or more: scored in place, so no row needs an id."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    names = df.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        terms = Terms(m.number) if m else None
        for b in batches:
            yield b.filter(pa.array(m.score(b.column(at), terms) < threshold)) if m else b

    return df.mapInArrow(run, df.schema)
