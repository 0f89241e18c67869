"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``DEPTH`` bytes holds frozen symbol counts. A symbol
seen after the longest known context costs log2((total + distinct) / count) bits; an unseen one costs
the escape, log2((total + distinct) / distinct), and is then coded after the context without its first
byte, symbols that the longer context knows being excluded. Below the empty context all 256 byte
values are equally likely. So each context's costs are those of a proper distribution, and a text's
code length under a language is exact. The shortest code wins; the score is its posterior probability
under equal priors.

Learning uses a bounded sample of labelled rows: ``DOCS_PER_LANGUAGE`` rows of each language at most (in
expectation), chosen by hash. Every n-gram of the sample counts, those seen once too. ``CELLS`` bounds the
cost table that is broadcast: where the sample has more contexts than fit, they are kept from the most
frequent down. Whole texts are scored.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text when
there is nothing to learn from; ties go to the language that sorts first; rows with null doc_id are
learned from, never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.work import save

DEPTH, DOCS_PER_LANGUAGE, CELLS = 3, 1500, 12_000_000
#: Bytes scored together.
BATCH_BYTES = 2_000_000


def grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct byte n-grams of the texts, packed into int64 with the last byte lowest, and their counts."""
    keys = []
    for t in texts:
        b = np.frombuffer(t, np.uint8).astype(np.int64)
        if len(b) >= n:
            k = np.zeros(len(b) - n + 1, np.int64)
            for i in range(n):
                k = k << 8 | b[i : len(b) - n + 1 + i]
            keys.append(k)
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))


def count_grams(labelled: DataFrame, depth: int = DEPTH) -> DataFrame:
    """lang, n, gram, count over rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.encode())
            for lang, texts in by.items():
                for n in range(1, depth + 2):
                    g, c = grams(texts, n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(np.full(len(g), n, np.int32)), pa.array(g), pa.array(c)], names=["lang", "n", "gram", "count"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, n int, gram bigint, count bigint").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


class Model:
    """Frozen trees of all languages in one table: bits of (context, symbol) for each language.

    (lang, n, gram, count): arrays of all n-grams of contexts that occur ``least`` times or more. Context 0
    is the unknown one, 1 the empty one.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, n: np.ndarray, gram: np.ndarray, count: np.ndarray, depth: int = DEPTH, least: int = 1):
        self.langs, self.depth = langs, depth
        seen = np.unique(gram[n == 1])
        self.code = np.full(256, len(seen), np.int64)
        self.code[seen] = np.arange(len(seen))
        a = self.symbols = len(seen) + 1
        #: byte values that the last symbol, never seen, stands for
        other = 256 - len(seen)
        nodes: list[np.ndarray] = [np.zeros(1, np.int64)]  # of each depth the packed contexts, sorted
        for d in range(1, depth + 1):
            g, at = np.unique(gram[n == d], return_inverse=True)
            nodes.append(g[np.bincount(at, count[n == d], len(g)) >= least])
        self.first = np.cumsum([1, *map(len, nodes)])  # of each depth the number of its first context
        size = int(self.first[-1])
        self.step = np.zeros((size, a), np.int32)
        for d in range(1, depth + 1):
            before, last = self._find(nodes, d - 1, nodes[d] >> 8), self.code[nodes[d] & 255]
            self.step[before, last] = self.first[d] + np.arange(len(nodes[d]))
        self.bits = np.zeros((size * a, len(langs)), np.float32)
        for li in range(len(langs)):
            p = np.zeros((size, a))
            uniform = np.r_[np.full(a - 1, 1 / 256), other / 256]
            for d in range(depth + 1):
                lo, hi = int(self.first[d]), int(self.first[d + 1])
                c = np.zeros((hi - lo, a))
                mine = (lang == li) & (n == d + 1)
                at = self._find(nodes, d, gram[mine] >> 8)
                known = at > 0
                c[at[known] - lo, self.code[gram[mine][known] & 255]] = count[mine][known]
                up = np.broadcast_to(uniform, c.shape) if d == 0 else p[self._find(nodes, d - 1, nodes[d] & ((1 << 8 * (d - 1)) - 1))]
                total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                open_mass = np.where(c > 0, 0, up).sum(1, keepdims=True)
                full = open_mass <= 0  # every symbol is known: no escape
                whole = total + np.where(full, 0, distinct)
                with np.errstate(divide="ignore", invalid="ignore"):
                    q = np.where(c > 0, c / whole, distinct / whole * up / open_mass)
                p[lo:hi] = np.where(total > 0, q, up)
            p[:, -1] /= other
            with np.errstate(divide="ignore"):
                self.bits[:, li] = -np.log2(p).ravel()

    def _find(self, nodes: list[np.ndarray], d: int, packed: np.ndarray) -> np.ndarray:
        """Numbers of contexts of depth d, 0 where there is none."""
        if d == 0:
            return np.ones(len(packed), np.int64)
        if not len(nodes[d]):
            return np.zeros(len(packed), np.int64)
        at = np.minimum(np.searchsorted(nodes[d], packed), len(nodes[d]) - 1)
        return np.where(nodes[d][at] == packed, self.first[d] + at, 0)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (none empty) under each language."""
        starts = np.cumsum([0, *map(len, texts)])
        s = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        inner = np.ones(len(s), bool)
        inner[starts[:-1]] = False
        context = at = np.ones(len(s), np.int32)
        flat = self.step.ravel()
        for _ in range(self.depth):
            nxt = np.zeros(len(s), np.int32)
            nxt[1:] = flat[at[:-1] * np.int64(self.symbols) + s[:-1]]
            nxt *= inner
            at = nxt
            context = np.where(at > 0, at, context)
        cost = self.bits[context * np.int64(self.symbols) + s]
        return np.add.reduceat(cost, starts[:-1], axis=0, dtype=np.float64)


def fit(labelled: DataFrame, depth: int = DEPTH, docs_per_language: int = DOCS_PER_LANGUAGE, cells: int = CELLS) -> Model | None:
    """``labelled``: rows (doc_id, lang, text); null langs and texts are left out. None if nothing is left."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, docs_per_language / n)))])
    chance = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(chance < share[F.col("lang")])
    langs = sorted(sizes)
    number = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])
    grams = save(count_grams(sample, depth).withColumn("lang", number[F.col("lang")]), "grams")
    grams, least = bounded(grams, len(langs), depth, cells)
    t = grams.select("lang", "n", "gram", "count").toArrow()
    lang, n, gram, count = (t.column(i).to_numpy() for i in range(4))
    return Model(langs, lang, n, gram, count.astype(np.float64), depth, least) if len(n) else None


def bounded(grams: DataFrame, langs: int, depth: int, cells: int) -> tuple[DataFrame, int]:
    """The n-grams of the most frequent contexts, as many as ``cells`` costs allow, and the least count of those contexts."""
    contexts = grams.where(F.col("n") <= depth).groupBy("n", "gram").agg(F.sum("count").alias("total"))
    symbols = 1 + grams.where("n = 1").select("gram").distinct().count()
    past = contexts.orderBy(F.desc("total")).offset(max(0, cells // (symbols * langs) - 2)).limit(1).collect()
    if not past:
        return grams, 1
    least = past[0]["total"] + 1
    kept = contexts.where(F.col("total") >= least).select((F.col("n") + 1).alias("n"), F.col("gram").alias("context"))
    longer = grams.where("n > 1").withColumn("context", F.shiftright("gram", 8)).join(kept, ["n", "context"], "left_semi")
    return grams.where("n = 1").unionByName(longer.drop("context")), least


def predict(df: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            pred, score = ["und"] * len(b), np.zeros(len(b))
            todo, texts, size = [], [], 0

            def flush() -> None:
                bits = m.code_lengths(texts)
                best = bits.argmin(1)
                odds = np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)
                for i, k, o in zip(todo, best, odds, strict=True):
                    pred[i], score[i] = m.langs[k], 1 / o

            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                if m is not None and t and any(map(str.isalpha, t)):
                    todo.append(i)
                    texts.append(t.encode())
                    size += len(texts[-1])
                    if size >= BATCH_BYTES:
                        flush()
                        todo, texts, size = [], [], 0
            if todo:
                flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
