"""LM scoring with a log-frequency Bloom filter.

Training counts words and word pairs of the whole training corpus exactly (hashes of 64 and 48 bits
stand for them). Each task adds its counts up by key and sends them as packed, sorted runs; hash ranges
("segments") are then added up apart from one another, so no task gathers a hot key's rows.

The filter holds quantised counts. Level q stands for the counts from ``BOUNDS[q - 1]`` up to the next
bound: the distinct integers of a geometric series, so that small counts are exact and others lie
within 5 %. An n-gram is entered once for each level up to its own. Looking it up probes level after
level until one is missing; the last one found gives back the mean count of the training n-grams of
that level, so that all counts given back add up to the tokens counted. Each segment's part is built
where its counts are and sized from its own entries: the filter grows with what was counted and
nothing is dropped at any size.

The filter outgrows every bound for a broadcast, so its parts stay where they were built: the texts
are dealt into runs, each run's distinct n-grams are looked up in their segments, and the levels come
back to the run.

score = sum of log10 p(w | v), v the token before (the end token before a text's first), with
p(w | v) = L * min(1, c(v, w) / c(v)) + (1 - L) * (c(w) + 1) / (N + V + 1), counts as looked up, and
the second term alone (without its factor) after a v that training has not seen. Over all words, seen
and unseen, that adds up to 1 but for quantisation and the filter's false positives.

The base score takes the exact counts of words, which the same segments hold.

Defined results: null text is empty and has the end token alone; with no training rows N, V and all counts
are 0; rows with equal doc_ids are scored apart; rows with null doc_id train the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.work import save

PROBES, LAMBDA = 8, 0.4
#: Bits for an entry; tokens counted together; bytes of text scored together; bytes of input for a segment, and the most segments.
ENTRY_BITS, RUN_TOKENS, RUN_BYTES, SEGMENT_BYTES, MOST_SEGMENTS = 16, 1_000_000, 6 << 20, 8 << 20, 1 << 17
#: Ratio of the levels' bounds, and the bounds themselves.
RATIO = 1.05
BOUNDS = np.unique(np.floor(RATIO ** np.arange(int(np.log(2.0**62) / np.log(RATIO)))).astype(np.int64))
#: No word has white space in it.
END = b" "
END_HASH = np.uint64(xxhash.xxh64_intdigest(END))
#: The low half of a hash.
LOW = np.uint64(0xFFFFFFFF)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """48 bits, in the high part: of 10**11 pairs, 4 in 10 000 share them with another."""
    return scramble(v * MIX[0] + w) & ~np.uint64(0xFFFF)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split() + [END]


def segment(h: np.ndarray, segments: int) -> np.ndarray:
    """Ranges of hashes, in their order."""
    return ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


class WordHashes(dict):
    """word → XXH64, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        t = tokens(text)
        return np.fromiter(map(self.__getitem__, t), np.uint64, len(t))


def pairs_of(w: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of tokens, from the hashes of texts' words one text after another: a text's first token follows the end token."""
    return pair_hash(np.r_[END_HASH, w[:-1]], w)


# ---- packing


def planes(x: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones, and so on, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted hashes, as their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def by_segment(keys: np.ndarray, segments: int) -> Iterator[tuple[int, slice]]:
    """The segments that sorted hashes fall in, and their parts."""
    s = segment(keys, segments).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(s)], strict=False):
        yield int(s[a]), slice(a, b)


# ---- the filter


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(BOUNDS, counts, "right")


class Filter:
    """A segment's part of the log-frequency Bloom filter, for words (n = 1) or pairs (n = 2)."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @staticmethod
    def _start(h: np.ndarray, n: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        g = scramble(h + np.uint64((level * 4 + n) * int(MIX[0]) % 2**64))
        return g >> np.uint64(32), (g & LOW) | np.uint64(1)

    @staticmethod
    def build(h: np.ndarray, n: int, level: np.ndarray) -> Filter:
        size = min(max(64, -(-int(level.sum()) * ENTRY_BITS // 8) * 8), 1 << 32)
        bits = np.zeros(size, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            h, level = h[level >= q], level[level >= q]
            at, step = Filter._start(h, n, q)
            for _ in range(PROBES):
                bits[((at & LOW) * np.uint64(size)) >> np.uint64(32)] = True
                at += step
        return Filter(np.packbits(bits, bitorder="little"), size)

    def levels(self, h: np.ndarray, n: int) -> np.ndarray:
        """The last level found of each n-gram, 0 for what isn't found."""
        out, left, q = np.zeros(len(h), np.uint16), np.arange(len(h)), 0
        while len(left):
            q += 1
            at, step = self._start(h[left], n, q)
            for _ in range(PROBES):
                place = ((at & LOW) * np.uint64(self.size)) >> np.uint64(32)
                hit = ((self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                left, at, step = left[hit], at[hit], step[hit]
                at += step
            out[left] = q
        return out


# ---- training


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns.values()], names=list(columns))


COUNTS = "n int, seg int, keys binary, counts binary, levels array<int>, grams array<bigint>, sums array<bigint>, size bigint, bits binary"


def count_ngrams(texts: DataFrame, segments: int) -> DataFrame:
    """Words (n = 1) and pairs (n = 2) of ``texts``: a row for each n and segment, with its part of the filter.

    Words' keys and counts are packed as well, pairs need none beside the filter. Of each level that
    occurs: the n-grams at it and the sum of their counts.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0

        def flush() -> pa.RecordBatch:
            cols: list[list] = [[], [], [], []]
            w = np.concatenate(held)
            for n, h in ((1, w), (2, pairs_of(w))):
                k, c = np.unique(h, return_counts=True)
                for i, part in by_segment(k, segments):
                    for col, x in zip(cols, (n, i, pack(k[part]), planes(c[part].astype(np.uint32))), strict=True):
                        col.append(x)
            return _table({"n": (cols[0], pa.int32()), "seg": (cols[1], pa.int32()), "keys": (cols[2], pa.binary()), "counts": (cols[3], pa.binary())})

        for b in batches:
            for t in b.column(0):
                held.append(hashes.of(t.as_py()))
                size += len(held[-1])
                if size >= RUN_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def add_up(t: pa.Table) -> pa.Table:
        n = t["n"][0].as_py()
        k, c = _add_up(np.concatenate(list(map(unpack, t["keys"].to_pylist()))), np.concatenate([unplanes(x, np.uint32) for x in t["counts"].to_pylist()]).astype(np.int64))
        level = level_of(c)
        f = Filter.build(k, n, level)
        occurs, at, grams = np.unique(level, return_inverse=True, return_counts=True)
        sums = np.zeros(len(occurs), np.int64)
        np.add.at(sums, at, c)
        exact = (pack(k), planes(c)) if n == 1 else (b"", b"")
        row = (n, t["seg"][0].as_py(), *exact, occurs.tolist(), grams.tolist(), sums.tolist(), f.size, f.bits.tobytes())
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
        names = [x.split()[0] for x in COUNTS.split(", ")]
        return pa.Table.from_batches([_table({name: ([x], kind) for name, x, kind in zip(names, row, kinds, strict=True)})])

    return texts.select("text").mapInArrow(runs, "n int, seg int, keys binary, counts binary").groupBy("n", "seg").applyInArrow(add_up, COUNTS)


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of a scan, from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


# ---- scoring


RUNS = "run bigint, ids array<bigint>, lengths binary, kinds binary, counts binary, ranks binary"


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """The places of a run's words, commonest first."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def run_words(kinds: pa.Scalar, counts: pa.Scalar, ranks: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """A run's distinct hashes, and each token's place among them."""
    return unpack(kinds.as_buffer()), by_frequency(unplanes(counts.as_buffer(), np.uint32))[unplanes(ranks.as_buffer(), np.uint32)]


def in_runs(df: DataFrame) -> DataFrame:
    """Rows (doc_id, text) as ``RUNS``: about ``RUN_BYTES`` of text a run, as its distinct words' hashes and each token's rank among them.

    Ranks run from the run's commonest word down, so that most are small and compress well.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, hashes, ids, held, size = TaskContext.get().partitionId() << 32, WordHashes(), [], [], 0

        def flush() -> pa.RecordBatch:
            kinds, places, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            rank = np.empty(len(kinds), np.uint32)
            rank[by_frequency(counts)] = np.arange(len(kinds), dtype=np.uint32)
            packed = planes(np.array(list(map(len, held)), np.uint32)), pack(kinds), planes(counts.astype(np.uint32)), planes(rank[places])
            columns = {name: ([x], pa.binary()) for name, x in zip(("lengths", "kinds", "counts", "ranks"), packed, strict=True)}
            return _table({"run": ([run], pa.int64()), "ids": ([ids], pa.list_(pa.int64()))} | columns)

        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(doc_id)
                held.append(hashes.of(t.as_py()))
                size += len(t.as_buffer()) if t.is_valid else 0
                if size > RUN_BYTES:
                    yield flush()
                    run, ids, held, size = run + 1, [], [], 0
        if held:
            yield flush()

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal, RUNS)


class Totals:
    """What workers get: tokens, distinct words, and of words and pairs the count that each level stands for."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        """(n, level, n-grams, sum of counts)"""
        self.total, self.types = (sum(r[i] for r in rows if r[0] == 1) for i in (3, 2))
        self.values = {n: np.r_[0.0, BOUNDS.astype(np.float64)] for n in (1, 2)}
        for n, level, grams, count in rows:
            self.values[n][level] = count / grams

    def probability(self, before: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """p(w | v) from the counts of v, w and the pair."""
        one = (word + 1) / (self.total + self.types + 1)
        return np.where(before > 0, LAMBDA * np.minimum(1.0, pair / np.maximum(before, 1)) + (1 - LAMBDA) * one, one)

    def score(self, lengths: np.ndarray, kinds: np.ndarray, places: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, ...]:
        """Of each text of a run: known tokens, base score, score. ``answers``: those for the run's n-grams, by segment."""
        order = np.lexsort((answers["seg"].to_numpy(), answers["n"].to_numpy()))
        rows = [(n, answers["levels"][i].as_py(), answers["counts"][i].as_py()) for i, n in zip(order.tolist(), answers["n"].to_numpy()[order].tolist(), strict=True)]
        level = {n: np.concatenate([unplanes(x, np.uint16) for m, x, _ in rows if m == n]) for n in (1, 2)}
        exact = np.concatenate([unplanes(x, np.int64) for m, _, x in rows if m == 1])
        pairs, pair_places = np.unique(pairs_of(kinds[places]), return_inverse=True)
        if (len(kinds), len(pairs)) != (len(level[1]), len(level[2])):
            raise ValueError("answers don't fit the run's texts")
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        each = self.values[1][level[1]]
        seen = each[places]
        before = np.r_[each[np.searchsorted(kinds, END_HASH)], seen[:-1]]
        p = self.probability(before, seen, self.values[2][level[2]][pair_places])
        base = np.log10((exact + 1) / (self.total + self.types + 1))[places]
        return np.add.reduceat((exact > 0).astype(np.int64)[places], starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


class Trained:
    """Counts and filter in the shared folder, and the totals."""

    def __init__(self, texts: DataFrame, size: int):
        """``texts``: column text; ``size``: bytes of input, which sets the number of segments."""
        self.segments = 1 << int(np.clip(np.ceil(np.log2(max(1, size / SEGMENT_BYTES))), 4, np.log2(MOST_SEGMENTS)))
        self.counts = save(count_ngrams(texts, self.segments), "ngrams")
        each = self.counts.select("n", F.inline(F.arrays_zip("levels", "grams", "sums")))
        # a row for each level that occurs, at most two for each of ``BOUNDS``
        self.totals = Totals([tuple(r) for r in each.groupBy("n", "levels").agg(F.sum("grams"), F.sum("sums")).collect()])

    def score(self, df: DataFrame) -> DataFrame:
        """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of (doc_id, text)."""
        segments = self.segments
        shared = df.sparkSession.sparkContext.broadcast(self.totals)
        dealt = save(in_runs(df), "dealt")

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for run, *words in zip(*b.columns, strict=True):
                    kinds, places = run_words(*words)
                    cols: list[list] = [[], [], []]
                    for n, k in ((1, kinds), (2, np.unique(pairs_of(kinds[places])))):
                        for i, part in by_segment(k, segments):
                            for col, x in zip(cols, (n, i, pack(k[part])), strict=True):
                                col.append(x)
                    yield _table({"run": ([run.as_py()] * len(cols[0]), pa.int64()), "n": (cols[0], pa.int32()), "seg": (cols[1], pa.int32()), "keys": (cols[2], pa.binary())})

        def answer(asked: pa.Table, part: pa.Table) -> pa.Table:
            if not len(asked):
                return pa.table({"run": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "seg": pa.array([], pa.int32()), "levels": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
            n = asked["n"][0].as_py()
            each = [unpack(x.as_buffer()) for x in asked["keys"]]
            keys = np.unique(np.concatenate(each))  # what many runs ask is looked up once
            level, exact = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.int64)
            if len(part):
                level = Filter(np.frombuffer(part["bits"][0].as_py(), np.uint8), part["size"][0].as_py()).levels(keys, n)
                if n == 1:
                    known, count = unpack(part["keys"][0].as_py()), unplanes(part["counts"][0].as_py(), np.int64)
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    exact = np.where(known[at] == keys, count[at], 0)
            places = [np.searchsorted(keys, k) for k in each]
            levels = [planes(level[i]) for i in places]
            counts = [planes(exact[i]) if n == 1 else b"" for i in places]
            return pa.table({"run": asked["run"], "n": asked["n"], "seg": asked["seg"], "levels": pa.array(levels, pa.binary()), "counts": pa.array(counts, pa.binary())})

        asked = dealt.select("run", "kinds", "counts", "ranks").mapInArrow(ask, "run bigint, n int, seg int, keys binary").groupBy("n", "seg")
        answers = asked.cogroup(self.counts.select("n", "seg", "keys", "counts", "size", "bits").groupBy("n", "seg"))
        answers = answers.applyInArrow(answer, "run bigint, n int, seg int, levels binary, counts binary")

        def run(dealt: pa.Table, answered: pa.Table) -> pa.Table:
            lengths = unplanes(dealt["lengths"][0].as_buffer(), np.uint32).astype(np.int64)
            known, base, score = shared.value.score(lengths, *run_words(*(dealt[c][0] for c in ("kinds", "counts", "ranks"))), answered)
            return pa.table({"doc_id": dealt["ids"][0].values, "n_tokens": lengths, "n_known": known, "base_score": base, "score": score})

        scored = dealt.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
        return scored.select("doc_id", "n_tokens", "n_known", F.lit(self.totals.total).cast("long").alias("train_tokens"), "base_score", "score")
