"""Approximate nearest neighbours by collision counting over single projections.

Vectors are scaled to unit length, so that the largest cosine is the smallest distance. A block of
vectors is indexed by ``PROJECTIONS`` random directions, each a sorted array of projections. A query opens
a window around its own projection in each array; a vector found in at least ``SHARE`` of the windows
has collided often enough and is verified with its exact cosine. Windows reach ``WIDTH`` times the
search radius to each side: a vector at just that radius lies in a window with chance
erf(WIDTH / sqrt 2) = 0.770, and ``SHARE`` is one standard deviation below it. Virtual rehashing widens the
radius by ``STEP`` until the k-th best verified vector lies within it. The first radius is ``FIRST`` times
the k-th smallest distance to ``PROBE`` vectors of the block, which are verified for every query.

The first windows are counted in one pass over the block's places; each widening counts only the places
that it adds to each window. A task carries each query's k-th best from block to block, so that later
blocks stop there. Every vector is indexed.

Queries go out in chunks of ``QUERY_CHUNK``, which bounds each broadcast, one chunk after another, against
all blocks of vectors; blocks are at most ``BLOCK`` vectors, which bounds a task's memory. Each task gives
its k + 1 best of a query; a window over these picks the result.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components are neither
queries nor candidates; vectors of other lengths than the query's are no candidates; of equal scores the
smaller vec_id comes first; rows with null vec_id take no part. Of rows that repeat a query's vec_id and
vector, one is the query's own row and the others are candidates, as are rows with its vec_id and another
vector; each repeat that is a query gives its own result rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.work import save

#: At most 255 projections, as collisions have 8 bits.
PROJECTIONS, SHARE, WIDTH, FIRST, STEP, PROBE = 240, 0.7425, 1.2, 0.8, 1.04, 128
#: BLOCK: at most 65 535, as places have 16 bits.
BLOCK, QUERY_CHUNK = 16384, 20_000


def usable(v: str) -> Column:
    finite = F.forall(F.col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(F.col(v), lambda x: x != 0), F.lit(False))


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Index:
    """Sorted projections of a block of unit vectors; ``order``: the vectors in each, ``rank``: each vector's place in each."""

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        self.unit = unit
        self.directions = np.random.default_rng(11).normal(size=(unit.shape[1], PROJECTIONS))
        p = np.ascontiguousarray((unit @ self.directions).T)
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.uint16)
        # all sorted arrays in one, shifted apart
        self.span = float(np.abs(p).max()) + 1
        self.shift = np.arange(PROJECTIONS) * 4 * self.span
        self.sorted = (np.take_along_axis(p, self.order.astype(np.int64), axis=1) + self.shift[:, None]).ravel()
        self.rank = np.empty(p.shape, np.uint16)
        np.put_along_axis(self.rank, self.order.astype(np.int64), np.arange(n, dtype=np.uint16)[None, :], axis=1)
        self.row = np.arange(PROJECTIONS) * n
        self.probe = np.sort(np.random.default_rng(5).choice(n, min(PROBE, n), replace=False))
        #: vectors verified so far, over all queries
        self.verified = 0

    def windows(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries at (q, projections) each window's first place and the place past its last."""
        reach = WIDTH * radius[:, None]
        lo = np.searchsorted(self.sorted, np.maximum(at - reach, -self.span) + self.shift)
        return lo - self.row, np.searchsorted(self.sorted, np.minimum(at + reach, self.span) + self.shift, "right") - self.row

    def search(self, queries: np.ndarray, k: int, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each unit query the verified (vectors, cosines); ``bound``: cosines beyond which a k-th best is of no use."""
        n, need = len(self.unit), int(np.ceil(SHARE * PROJECTIONS))
        k = min(k, n)
        at = queries @ self.directions
        near = queries @ self.unit[self.probe].T
        kth = np.sort(near, axis=1)[:, -min(k, near.shape[1])]
        first = np.maximum(FIRST * np.sqrt(np.maximum(0, 2 - 2 * np.maximum(kth, bound))), 1e-6)
        offset, inside = np.empty(self.rank.shape, np.uint16), np.empty(self.rank.shape, bool)
        lows, highs = self.windows(at, first)
        everything = 4 * np.sqrt(self.unit.shape[1])
        for q, (radius, lo, hi) in enumerate(zip(first.tolist(), lows, highs, strict=True)):
            tested = np.zeros(n, bool)
            tested[self.probe] = True
            found, cosines = self.probe, near[q]
            # a place is in the window if it lies fewer places past its first; places before that wrap around
            width = np.minimum(hi - lo, 65535).astype(np.uint16)
            np.less(np.subtract(self.rank, lo.astype(np.uint16)[:, None], out=offset), width[:, None], out=inside)
            hits = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
            while True:
                fresh = np.flatnonzero((hits >= need) & ~tested)
                tested[fresh] = True
                found, cosines = np.r_[found, fresh], np.r_[cosines, self.unit[fresh] @ queries[q]]
                best = np.partition(cosines, -k)[-k] if len(found) >= k else -2.0
                if max(best, bound[q]) >= 1 - radius**2 / 2 or len(found) == n or radius > everything:
                    break
                radius *= STEP
                lo_, hi_ = (x[0] for x in self.windows(at[q : q + 1], np.array([radius])))
                new = self.order.ravel()[np.r_[_places(self.row + lo_, lo - lo_), _places(self.row + hi, hi_ - hi)]]
                hits += np.bincount(new, minlength=n).astype(np.uint8)
                lo, hi = lo_, hi_
            self.verified += len(found)
            yield found, cosines


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    return flat, ends


def nearest(df: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    rows = df.where(F.col(vec_id).isNotNull() & usable(embedding)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    asked = rows.where(F.col("vec_id") % every == 0)
    chunks = max(1, -(-asked.count() // QUERY_CHUNK))
    found = None
    for c in range(chunks):
        # bounded: about QUERY_CHUNK queries
        t = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).toArrow()
        part = _search_chunk(rows, t["vec_id"].to_numpy(), [np.asarray(x, np.float64) for x in t["v"].to_pylist()], k, chunks > 1)
        found = part if found is None else found.unionByName(part)
    query = W.partitionBy("query_id", "query_no")
    own = F.row_number().over(query.orderBy(F.desc("same"), "vec_id"))
    rest = found.withColumn("own", own).where(~(F.col("same") & (F.col("own") == 1)))
    rank = F.row_number().over(query.orderBy(F.desc("score"), "vec_id"))
    return rest.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_chunk(rows: DataFrame, ids: np.ndarray, queries: list[np.ndarray], k: int, keep: bool) -> DataFrame:
    """The k + 1 best of each query and task, the query's own row among them; written out, if ``keep``, to free the broadcast."""
    by: dict[int, list[int]] = {}
    for i, q in enumerate(queries):
        by.setdefault(len(q), []).append(i)
    packed = {d: (np.array(at), ids[at], np.stack([queries[i] for i in at])) for d, at in by.items()}
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    def search_block(d: int, block_ids: np.ndarray, x: np.ndarray, best: list[tuple[np.ndarray, ...]]) -> None:
        """Merges the block's best into ``best``: of each query its (scores, ids, same)."""
        _, qid, q = shared.value[d]
        norm, qnorm = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        bound = np.array([s[k] if len(s) > k else -2.0 for s, *_ in best])
        for i, (found, cosines) in enumerate(Index(x / norm[:, None]).search(q / qnorm[:, None], k + 1, bound)):
            if len(found) > k + 1:  # rounding aside, none below these can be among the best
                found = found[cosines >= np.partition(cosines, -k - 1)[-k - 1] - 1e-9]
            s = np.r_[best[i][0], (x[found] @ q[i]) / (norm[found] * qnorm[i])]
            v = np.r_[best[i][1], block_ids[found]]
            same = np.r_[best[i][2], (block_ids[found] == qid[i]) & (x[found] == q[i]).all(axis=1)]
            # the own row leads, as it's one more than the k wanted
            top = np.lexsort((v, -s, ~same))
            top = np.r_[top[:1], top[1:][np.lexsort((v[top[1:]], -s[top[1:]]))]][: k + 1]
            top = top[np.lexsort((v[top], -s[top]))]
            best[i] = s[top], v[top], same[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        best = {d: [(np.empty(0), np.empty(0, np.int64), np.empty(0, bool))] * len(x[0]) for d, x in shared.value.items()}
        for b in batches:
            flat, lengths = _matrix(b.column(1))
            starts, block_ids = np.r_[0, np.cumsum(lengths)[:-1]], b.column(0).to_numpy()
            for d in np.unique(lengths).tolist():
                if d not in shared.value:
                    continue
                at = np.flatnonzero(lengths == d)
                w = waiting.setdefault(d, [])
                w.append((block_ids[at], flat[starts[at][:, None] + np.arange(d)]))
                while sum(len(i) for i, _ in w) >= BLOCK:
                    i, x = np.concatenate([i for i, _ in w]), np.concatenate([x for _, x in w])
                    w[:] = [(i[BLOCK:], x[BLOCK:])]
                    search_block(d, i[:BLOCK], x[:BLOCK], best[d])
        for d, w in waiting.items():
            i, x = np.concatenate([i for i, _ in w]), np.concatenate([x for _, x in w])
            if len(i):
                search_block(d, i, x, best[d])
            number, qid, _ = shared.value[d]
            each = [len(s) for s, *_ in best[d]]
            cols = (np.repeat(qid, each), np.repeat(number, each), *(np.concatenate([t[j] for t in best[d]]) for j in (1, 0, 2)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["query_id", "query_no", "vec_id", "score", "same"])

    out = rows.mapInArrow(run, "query_id bigint, query_no bigint, vec_id bigint, score double, same boolean")
    if keep:
        out = save(out, "nearest")
        shared.destroy()
    return out
