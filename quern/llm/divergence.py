"""Source divergence audit: how far the sources of a language lie apart in their use of words, and which words tell.

Words are counted for each (lang, source) group; a language keeps those in at least ``least`` of its
documents. Shares are whole billionths, floor(10^9 * (count + 5) / (N + 5 * V)) + 1, and all arithmetic is
exact. Pairs of groups are compared by two-dimensional tiling: the kept words of a language are dealt into
vocabulary chunks, each group's counts of a chunk are packed into one row, groups are dealt into blocks, and
each block's rows go to every tile (block by block) that it is part of. A tile's task reads one chunk after
the other and adds up its submatrix of distances; a tile is cut into stripes of chunks, whose submatrices
are added, so that no task grows with the vocabulary. Words that neither group has are accounted for in
closed form, as ``V * |p0 - q0|`` of the shares of an unseen word.

A group that holds most rows is counted in parts, task by task; a task holds at most ``HELD`` counts before
it sends them on, one chunk of two blocks in a tile, and never a vocabulary.

Defined results: null text, lang and source are read as ''; a text without words gives its group none; a
group without kept words has the shares of unseen words; a language without kept words has distances 0; a
language of one group has no pairs; repeated rows count each; extra columns take no part; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.work import save

#: Words of a vocabulary chunk, chunks of a stripe, groups of a block.
CHUNK, STRIPE, BLOCK = 4096, 64, 16
#: Counts that a task holds.
HELD = 500_000
#: Rows of a table of groups that are broadcast; a larger one is joined by a shuffle.
FEW = 20_000
SCALE, ADDED = 10**9, 5
#: A word in UTF-8: ASCII letters and whatever isn't ASCII. Lowering bytes touches only A-Z.
WORD = re.compile(rb"[a-z\x80-\xff]+")


def counted(df: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each word in each group, in parts."""
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = Counter(WORD.findall(text.encode().lower()))
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(words)
                docs.update(words.keys())
                held += len(n)
                if held > HELD:
                    yield from _sent(groups)
                    groups, held = {}, 0
        yield from _sent(groups)

    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _sent(groups: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in groups.items():
        terms = list(n)
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )


def kept_counts(df: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n, lang_n: the words that a language keeps, in each group that has them. One shuffle, by word."""
    c = counted(df).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = W.partitionBy("lang", "term")
    c = c.withColumn("lang_n", F.sum("n").over(word)).withColumn("docs", F.sum("docs").over(word)).where(F.col("docs") >= least)
    first = F.row_number().over(word.orderBy("source")) == 1
    return save(c.select("lang", "source", "term", "n", "lang_n", first.alias("first")), "kept")


def small(df: DataFrame) -> DataFrame:
    """A broadcast side where it has few rows, as counted; joined by a shuffle beyond that."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * n / total) in whole numbers, for n <= total < 9 * 10^13: two steps of long division."""
    step, rest = F.lit(10**4), F.lit(SCALE // 10**4)
    high = F.call_function("div", n * step, total)
    return high * rest + F.call_function("div", (n * step % total) * rest, total) + 1


def _shares(n: np.ndarray, total: int) -> np.ndarray:
    """``share`` for an array of counts."""
    high, left = np.divmod(n * 10**4, total)
    return high * (SCALE // 10**4) + left * (SCALE // 10**4) // total + 1


def grouped(df: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, member, block, blocks, n, v, total, lang_total: each group's place among its language's, its kept words and denominators."""
    groups = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    v = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_sum"))
    n = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    g = groups.join(n, ["lang", "source"], "left").join(v, "lang", "left").fillna(0, ["n", "v", "lang_sum"])
    lang = W.partitionBy("lang")
    g = g.withColumn("place", F.row_number().over(lang.orderBy("source")) - 1).withColumn("groups", F.count("*").over(lang))
    cut = lambda c: F.floor(c / BLOCK).cast("int")
    g = g.select(
        "lang", "source", (F.col("place") % BLOCK).alias("member"), cut(F.col("place")).alias("block"), (cut(F.col("groups") - 1) + 1).alias("blocks"), "n", "v",
        (F.col("n") + F.col("v") * ADDED).alias("total"), (F.col("lang_sum") + F.col("v") * ADDED).alias("lang_total"),
    )
    return save(g, "groups")


class Tile:
    """A block of groups by a block of groups of one language: its submatrix of distances, added up chunk by chunk."""

    def __init__(self, lang: str, i: int, j: int, stripe: int):
        self.key, self.lang, self.i, self.j = (lang, i, j, stripe), lang, i, j
        self.totals: dict[int, dict[int, int]] = {i: {}, j: {}}
        self.chunk: int | None = None
        self.rows: list[tuple[int, int, list, list]] = []
        self.sums: np.ndarray | None = None

    def add(self, chunk: int, block: int, member: int, ids: list, counts: list, total: int) -> None:
        if chunk < 0:  # the groups of both blocks come first
            self.totals[block][member] = total
            return
        if chunk != self.chunk:
            self.close_chunk()
            self.chunk = chunk
        self.rows.append((block, member, ids, counts))

    def members(self, block: int) -> list[int]:
        return sorted(self.totals[block])

    def _matrix(self, block: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Each group's shares of the chunk's words, and of an unseen word."""
        at = {m: k for k, m in enumerate(self.members(block))}
        n = np.full((len(at), width), ADDED, np.int64)
        for b, m, ids, counts in self.rows:
            if b == block:
                n[at[m], ids] += counts
        totals = np.array([[self.totals[block][m]] for m in at], np.int64)
        return _shares(n, totals), _shares(np.full((len(at), 1), ADDED, np.int64), totals)

    def close_chunk(self) -> None:
        if not self.rows:
            return
        width = max(x[2][-1] for x in self.rows) + 1
        p, p0 = self._matrix(self.i, width)
        q, q0 = (p, p0) if self.i == self.j else self._matrix(self.j, width)
        part = np.stack([np.abs(row - q).sum(1) for row in p]) - width * np.abs(p0 - q0.T)
        self.sums = part if self.sums is None else self.sums + part
        self.rows = []

    def close(self) -> Iterator[pa.RecordBatch]:
        self.close_chunk()
        if self.sums is not None:
            a = np.array([self.i * BLOCK + m for m in self.members(self.i)], np.int32)
            b = np.array([self.j * BLOCK + m for m in self.members(self.j)], np.int32)
            x, y = np.nonzero(a[:, None] < b)
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(x)), pa.array(a[x]), pa.array(b[y]), pa.array(self.sums[x, y])], names=["lang", "a", "b", "part"])


def _submatrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of tile, stripe and chunk: a row for each pair of groups and stripe, its distance less that of unseen words."""
    tile = None
    for batch in batches:
        for lang, i, j, stripe, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tile is None or tile.key != (lang, i, j, stripe):
                yield from tile.close() if tile else ()
                tile = Tile(lang, i, j, stripe)
            tile.add(*row)
    yield from tile.close() if tile else ()


def distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (places of sources), part: the distance of each pair of groups over the words that one of them has, less that of as many unseen words."""
    words = kept.where("first").count()
    chunks = max(1, -(-words // CHUNK))
    at = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int"))
    own = F.dense_rank().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1
    packed = at.withColumn("id", own).groupBy("lang", "chunk", "source").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("s"))
    packed = packed.select("lang", "source", "chunk", F.col("s.id").alias("ids"), F.col("s.n").alias("counts"))
    rows = packed.join(small(groups), ["lang", "source"]).withColumn("stripe", F.floor(F.col("chunk") / STRIPE).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiles = F.transform(every, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    columns = ["lang", "t.i", "t.j", "stripe", "chunk", "block", "member", "ids", "counts", "total"]
    sent = rows.withColumn("t", F.explode(tiles)).select(*columns)
    # each stripe of a tile hears first of the groups of its blocks
    stripes = F.explode(F.sequence(F.lit(0), F.lit((chunks - 1) // STRIPE)))
    known = groups.where("v > 0").withColumn("stripe", stripes).withColumn("t", F.explode(tiles)).withColumns({"chunk": F.lit(-1), "ids": F.array().cast("array<int>"), "counts": F.array().cast("array<bigint>")}).select(*columns)
    tile = ["lang", "i", "j", "stripe"]
    ordered = sent.unionByName(known).repartition(*tile).sortWithinPartitions(*tile, "chunk")
    return ordered.mapInArrow(_submatrices, "lang string, a int, b int, part bigint").groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of each ordered pair of a language's groups."""
    g = groups.select("lang", "source", "v", (F.col("block") * BLOCK + F.col("member")).alias("place"), F.when(F.col("v") > 0, share(F.lit(ADDED).cast("long"), F.col("total"))).alias("unseen"))
    a = g.select("lang", "v", F.col("source").alias("source_a"), F.col("place").alias("a"), F.col("unseen").alias("unseen_a"))
    b = g.select("lang", F.col("source").alias("source_b"), F.col("place").alias("b"), F.col("unseen").alias("unseen_b"))
    both = a.join(b, "lang").where("a < b")  # the pairs are the result
    d = both.join(distances(kept, groups), ["lang", "a", "b"], "left")
    value = F.coalesce("part", F.lit(0)) + F.coalesce(F.col("v") * F.abs(F.col("unseen_a") - F.col("unseen_b")), F.lit(0))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return d.select("lang", ways.alias("w"), value.cast("long").alias("value")).select("lang", "w.*", "value")


def telling(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of each kept word that a group has more of than its language."""
    d = kept.join(small(groups.select("lang", "source", "total", "lang_total")), ["lang", "source"])
    more = share(F.col("n") + ADDED, F.col("total")) - share(F.col("lang_n") + ADDED, F.col("lang_total"))
    return d.select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")


def audit(df: DataFrame, least: int = 30, most_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has all other sources of the language, part ``term`` the first ``most_terms`` telling words."""
    kept = kept_counts(df, least)
    groups = grouped(df, kept)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda d, part: d.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part)).select("lang", "source", "part", "item", "value", "rank")
    return ranked(pairs(kept, groups), "pair").unionByName(ranked(telling(kept, groups), "term").where(F.col("rank") <= most_terms))


#: DuckDB SQL for ``audit`` with its defaults.
AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS n FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, k.lang_n, v.v, v.n AS all_n, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(t.n, 0) + 5 * v.v) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - 1 - (1000000000 * (lang_n + 5)) // (all_n + 5 * v))::BIGINT FROM p WHERE n > 0 AND p > 1 + (1000000000 * (lang_n + 5)) // (all_n + 5 * v)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""
