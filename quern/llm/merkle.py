"""Merkle manifest of a table by Pregel-style supersteps over RDDs.

Every row is a leaf. Each source's leaves, in the order of doc_id, make a tree of arity 3; the sources'
subroots, in the order of source, make another above them. A superstep spans ``DEPTH`` levels: nodes send
their digests to the ancestor that many levels up (a block of 3^DEPTH consecutive nodes), a block that has
all of them hashes its levels and sends its own digest on. The reverse supersteps send each block the
siblings on its way to the root, and it sends its nodes theirs, down to the leaves, which verify against
the root. Texts are hashed by Spark's own functions and never leave the scan; what moves is digests of 32
bytes, keyed by (tree, block), so a source that holds most rows is spread like any other. A block holds at
most 3^DEPTH nodes. Every superstep's blocks are written to the shared folder: a lost executor costs the
retry of its tasks. The driver sees one digest, the root, and one row a partition for the leaves' places.

Defined results: leaves with null doc_id come first in their source, leaves with equal doc_id go by digest,
so repeated rows are told apart by their places only; null and empty sources are two sources, null first; a
null text is a field of its own and isn't altered; rows with null doc_id aren't tampered with; an empty
table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.work import new_path, save
from quern.operators.order import ranked

ARITY, DEPTH = 3, 4
BLOCK = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: Iterable[Column]) -> Column:
    """Digest of a row's fields, each with its length, so that no two rows read alike."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tampered(df: DataFrame) -> Column:
    """The leaf of a row whose text has lost its line ends, where its doc_id is dealt one; null elsewhere."""
    dealt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(dealt, leaf(F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS))


def digest(nodes: list[bytes]) -> bytes:
    """H of digests as hex text."""
    return hashlib.sha256("".join([x.hex() for x in nodes]).encode()).digest()


def fewer(n: int) -> int:
    return -(-n // ARITY)


def hashed_up(nodes: list[bytes], n: int) -> list[list[bytes]]:
    """The levels of a block, from its nodes to its own digest. ``n``: the nodes of the whole tree on the block's lowest level."""
    levels = [nodes]
    while len(levels) <= DEPTH and n > 1:
        nodes = [digest(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        levels.append(nodes)
        n = fewer(n)
    return levels


def siblings(levels: list[list[bytes]], at: int) -> Iterator[bytes]:
    """The others of each run on the way from node ``at`` to the block's digest, from the bottom up, left to right."""
    for nodes in levels[:-1]:
        first = at - at % ARITY
        yield from nodes[first:at]
        yield from nodes[at + 1 : first + ARITY]
        at //= ARITY


def folded(node: bytes, at: int, n: int, path: Iterator[bytes]) -> bytes:
    """The top digest that a node, its place among n and its siblings give; takes from ``path`` what it needs."""
    while n > 1:
        k = at % ARITY
        others = [next(path) for _ in range(min(ARITY, n - (at - k)) - 1)]
        node = digest([*others[:k], node, *others[k:]])
        at, n = at // ARITY, fewer(n)
    return node


def _dealt(key: tuple[int, int]) -> int:
    return key[0] * 1_000_003 + key[1]


def _written(rdd: RDD, df: DataFrame) -> RDD:
    """``rdd`` written to the shared folder: each superstep is run once and outlives its executors."""
    path = new_path(df.sparkSession, "merkle")
    rdd.saveAsPickleFile(path)
    return df.sparkSession.sparkContext.pickleFile(path)


def _sent(node: tuple) -> tuple:
    """To the block of a node: (tree, place, nodes of the tree, digest, whatever goes with it)."""
    tree, at, n, own, more = node
    return (tree, at // BLOCK), (at % BLOCK, n, own, more)


def _block(item: tuple) -> tuple:
    """(tree, block) → nodes of the tree, the block's digests, what goes with each, its own digest."""
    key, got = item
    got = sorted(got, key=lambda x: x[0])
    n, nodes = got[0][1], [x[2] for x in got]
    return key, (n, nodes, [x[3] for x in got], hashed_up(nodes, n)[-1][0])


def _forward(item: tuple) -> tuple:
    (tree, at), (n, _, _, own) = item
    for _ in range(DEPTH):
        n = fewer(n)
    return tree, at, n, own, None


def climb(nodes: RDD, most: int, parts: int, df: DataFrame) -> tuple[list[RDD], RDD]:
    """The upward supersteps: blocks of each, and (tree, digest) of every tree's top. ``most``: nodes of the largest tree."""
    steps, tops = [], df.sparkSession.sparkContext.emptyRDD()
    while True:
        blocks = _written(nodes.map(_sent).groupByKey(max(1, parts), _dealt).map(_block), df)
        steps.append(blocks)
        done = blocks.map(_forward)
        tops = tops.union(done.filter(lambda x: x[2] == 1).map(lambda x: (x[0], x[3])))
        if most <= BLOCK:
            return steps, tops
        nodes, most, parts = done.filter(lambda x: x[2] > 1), -(-most // BLOCK), parts // BLOCK


def _down(last: bool, item: tuple) -> Iterator[tuple]:
    """A block that knows its siblings up to the root tells its nodes theirs; ``extra`` goes along."""
    (tree, block), (states, paths) = item
    for n, nodes, more, _ in states:
        for path, extra in paths:
            levels = hashed_up(nodes, n)
            for i, x in enumerate(nodes):
                own = (*siblings(levels, i), *path)
                at = block * BLOCK + i
                yield (tree, at, n, x, more[i], own, extra) if last else ((tree, at), (own, extra))


def descend(steps: list[RDD], above: RDD, df: DataFrame) -> RDD:
    """The downward supersteps: (tree, place, nodes of the tree, digest, what goes with it, its siblings up to the root, extra) of every leaf.

    ``above``: ((tree, 0), (siblings, extra)) of the trees' tops. A tree enters at the superstep where its top is.
    """
    waiting = above
    for i, blocks in reversed(list(enumerate(steps))):
        # a tree's top is block 0 of the last superstep that it has; below, block 0 hears from its parent
        tops = blocks.filter(lambda x: x[0][1] == 0 and x[1][0] <= BLOCK).map(lambda x: (x[0], None))
        entering = above.join(tops).mapValues(lambda x: x[0])
        told = entering if i == len(steps) - 1 else waiting.union(entering)
        out = blocks.cogroup(told, max(blocks.getNumPartitions(), told.getNumPartitions() if i else 1)).flatMap(partial(_down, i == 0))
        if i == 0:
            return out
        waiting = _written(out, df)
    raise AssertionError


def _verified(root: bytes, n_trees: int, item: tuple) -> tuple:
    tree, at, n, own, (doc_id, other), path, subroot = item
    way = iter(path)
    fold = folded(folded(other or own, at, n, way), tree, n_trees, way)
    return doc_id, own.hex(), subroot.hex(), root.hex(), digest(list(path)).hex(), fold.hex(), fold == root


def placed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (tree, at, leaves of the tree, leaf, doc_id, the tampered leaf), and the trees: source, leaves, tree.

    Leaves are range-sorted over the whole table; a partition's place in a source is what lies before it.
    """
    leaves = save(df.select("doc_id", "source", F.unhex(leaf(F.col(c) for c in FIELDS)).alias("leaf"), F.unhex(tampered(df)).alias("other")), "leaves")
    order = ["source", "doc_id", "leaf"]
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = save(leaves.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), here.alias("here")), "leaves")
    cells = save(rows.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("here").alias("first")), "cells")
    trees = save(ranked(cells.groupBy("source").agg(F.sum("n").alias("leaves")), ["source"], "tree"), "trees")
    numbered = cells.withColumnRenamed("source", "s").join(trees, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    offset = F.sum("n").over(W.partitionBy("tree").orderBy("part")) - F.col("n") - F.col("first")
    numbered = numbered.select("s", F.col("part").alias("p"), "tree", "leaves", offset.alias("offset"))
    out = rows.join(numbered, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return out.select("tree", (F.col("offset") + F.col("here")).alias("at"), "leaves", "leaf", "doc_id", "other"), trees


def manifest(df: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    rows, trees = placed(df)
    n_trees, largest = trees.agg(F.count("*"), F.max("leaves")).first()
    if not n_trees:
        return spark.createDataFrame([], schema)
    nodes = rows.rdd.map(lambda r: (r[0], r[1], r[2], bytes(r[3]), (r[4], r[5] and bytes(r[5]))))
    parts = nodes.getNumPartitions()
    steps, subroots = climb(nodes, largest, parts, df)
    over, top = climb(subroots.map(lambda x: (0, x[0], n_trees, x[1], None)), n_trees, 1 + parts // BLOCK, df)
    root = top.first()[1]
    ways = descend(over, sc.parallelize([((0, 0), ((), None))], 1), df)
    below = descend(steps, ways.map(lambda x: ((x[1], 0), (x[5], x[3]))), df)
    return spark.createDataFrame(below.map(partial(_verified, root, n_trees)), schema, verifySchema=False)


def manifest_sql(levels: int = 12, source_levels: int = 6) -> str:
    """DuckDB SQL for ``manifest`` over ``documents``: the levels one by one, so for up to 3^levels rows a source and 3^source_levels sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    own = lambda text: f"sha256({' || '.join(field(text if c == 'text' else c) for c in FIELDS)})"
    ctes = [
        "d AS (SELECT row_number() OVER () AS row, * FROM documents)",
        f"""lf AS (SELECT row, doc_id, source, {own("text")} AS d, {own("replace(text, chr(10), '')")} AS o FROM d)""",
        "a0 AS (SELECT source AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, d, row, doc_id, o FROM lf)",
    ]

    def up(a: str, by: str, n: int) -> None:
        for i in range(n):
            ctes.append(f"{a}r{i} AS (SELECT {by}, pos // 3 AS pos, any_value(n) AS n, list(d ORDER BY pos) AS ds FROM {a}{i} GROUP BY {by}, pos // 3)")
            ctes.append(f"{a}{i + 1} AS (SELECT {by}, pos, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {a}r{i})")

    up("a", "s", levels)
    ctes.append(f"b0 AS (SELECT 0 AS s, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, d, s AS source FROM a{levels})")
    up("b", "s", source_levels)
    bits = "[0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]"
    byte = f"list_reduce(list_prepend(xor(a, x), {bits}), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda y: CAST(ord(y) AS BIGINT))"
    odd = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, x: {byte}), 4294967295) % 2"
    ctes.append(f"z0 AS (SELECT row, doc_id, s, pos, d AS leaf, CASE WHEN doc_id IS NOT NULL AND {odd} = 0 THEN o ELSE d END AS fold, '' AS proof FROM a0)")

    def fold(a: str, z: str, key: str, n: int) -> None:
        for i in range(n):
            left, right = "array_to_string(ds[1 : pos % 3], '')", "array_to_string(ds[pos % 3 + 2 : ], '')"
            row = f"SELECT z.*, r.ds, r.n FROM {z}{i} z JOIN {a}r{i} r ON {key} AND z.pos // 3 = r.pos"
            ctes.append(f"{z}{i + 1} AS (SELECT * EXCLUDE (ds, n) REPLACE (pos // 3 AS pos, CASE WHEN n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold, CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof) FROM ({row}))")

    fold("a", "z", "z.s IS NOT DISTINCT FROM r.s", levels)
    ctes.append(f"y0 AS (SELECT z.* REPLACE (b.pos AS pos), b.d AS subroot FROM z{levels} z JOIN b0 b ON z.s IS NOT DISTINCT FROM b.source)")
    fold("b", "y", "r.s = 0", source_levels)
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, b.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b.d AS verified FROM y{source_levels}, b{source_levels} b"""
