"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint's bit is 1 if more than half of the shingle hashes have it. Fingerprints are made once a
text and reduced to the distinct ones, so exact copies cost nothing further. Each fingerprint is cut
into blocks; a key is the value of some of the blocks together, and close pairs share a key. A key's
fingerprints are compared in one numpy pass that returns a spanning forest of the close pairs, never
the pairs. A key of two or three fingerprints names its members by its aggregates alone, and their at
most three pairs are checked once, however many keys share them. A key with more than ``CHUNK``
distinct fingerprints is dealt into chunks by hash and compared chunk against chunk, so that no task
holds a hot key. Components of the forests' edges are the groups. For the pipeline's near copies
(``near_groups``) the components of the fingerprints of shingle sets are candidates, with keys of minima for
those that the fingerprints are too coarse for; all are decided on the exact shingle sets.

Defined results: null text counts as empty; a text without words has fingerprint zero, linked like any
other; fewer words than a shingle form one shingle; rows with equal texts share a group; a group is
named by its smallest doc_id (null if it has none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.work import free, save

SEED = 42
#: Distinct fingerprints of a key that are compared together.
CHUNK = 2048
#: Keys of so many distinct fingerprints or fewer are checked pair by pair.
FEW = 3
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ASCII-lower-cased words, repeats included."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)


def majority(hashes: np.ndarray) -> bytes:
    """Of hashes (n, w) uint64 the bits that more than half have, as w little-endian words."""
    n, width = hashes.shape
    if not n:
        return bytes(8 * width)
    cells = hashes.view(np.uint8).reshape(n, 8 * width) + np.arange(8 * width) * 256
    ones = np.bincount(cells.ravel(), minlength=2048 * width).reshape(8 * width, 256) @ BYTE_BITS
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").tobytes()


#: Odd multipliers that widen a 64-bit hash; the first word is the hash itself.
WIDEN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def widen(h: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(h), width), np.uint64)
    out[:, 0] = h
    for i in range(1, width):
        x = (h ^ (h >> np.uint64(29))) * WIDEN[i - 1]
        x = (x ^ (x >> np.uint64(32))) * WIDEN[i - 1]
        out[:, i] = x ^ (x >> np.uint64(29))
    return out


def fingerprint(text: str | None, words: int, width: int = 1) -> bytes:
    return majority(widen(shingle_hashes(text, words), width))


def fingerprints(df: DataFrame, words: int, width: int = 1) -> DataFrame:
    """doc_id, fp binary (8 * width bytes, little-endian) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), words, width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp binary")


def pigeonhole_keys(blocks: int, distance: int) -> list[np.ndarray]:
    """Bit positions of each key of a 64-bit fingerprint: of so many blocks, ``distance`` can differ, so the rest agree."""
    cuts = np.array_split(np.arange(64), blocks)
    return [np.concatenate(c) for c in combinations(cuts, blocks - distance)]


def _bits(fps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def key_rows(classes: DataFrame, keys: list[np.ndarray]) -> DataFrame:
    """(key, id): a row for each key of each fingerprint (id, fp); the key's number is in the key's high bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 4096):
                ids, fps = b.column(0).slice(at, 4096), b.column(1).slice(at, 4096)
                bits = _bits(fps.to_pylist())
                for i, k in enumerate(keys):
                    value = (bits[:, k].astype(np.int64) @ (1 << np.arange(len(k), dtype=np.int64))) | (i << 48)
                    yield pa.RecordBatch.from_arrays([pa.array(value), ids], names=["key", "id"])

    return classes.select("id", "fp").mapInArrow(run, "key bigint, id bigint")


def forest(left: np.ndarray, right: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at ``most`` bits or fewer, within ``left`` (n, w) or between ``left`` and ``right``.

    Indices run through left, then right.
    """
    points = left if right is None else np.concatenate([left, right])
    n, out = len(points), []
    root = np.arange(n)
    for i in range(len(left)):
        lo = i + 1 if right is None else len(left)
        if lo >= n:
            break
        near = np.bitwise_count(points[lo:] ^ points[i]).sum(axis=1, dtype=np.int64) if points.shape[1] > 1 else np.bitwise_count(points[lo:, 0] ^ points[i, 0])
        hit = np.flatnonzero(near <= most) + lo
        if not len(hit):
            continue
        roots, first = np.unique(root[hit], return_index=True)
        new = roots != root[i]
        if new.any():
            out += [(i, int(j)) for j in hit[first[new]]]
            root[np.isin(root, roots)] = root[i]
    return out


def close_edges(classes: DataFrame, keys: list[np.ndarray], most: int, chunk: int = CHUNK) -> DataFrame:
    """Of distinct fingerprints (id, fp), edges (a, b) of ids that connect each key's close fingerprints.

    Keys travel with the 8-byte id; only those that more than ``FEW`` fingerprints have are joined with the fingerprints.
    """
    rows = save(key_rows(classes, keys), "keys")
    members = (F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor("id").alias("x"))
    shared = save(rows.groupBy("key").agg(F.count("*").alias("n"), *members).where("n > 1"), "shared")
    few = _checked(_few_pairs(shared.where(F.col("n") <= FEW)), classes, most)
    parts = F.ceil(F.col("n") / chunk).cast("int")
    r = rows.join(shared.where(F.col("n") > FEW).select("key", "n"), "key").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    r = r.join(classes.select("id", "fp"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    r = r.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "fp")

    def compare(group: list[tuple[int, int, bytes]], i: int, j: int) -> list[tuple[int, int]]:
        members = [[(n, f) for o, n, f in group if o == s] for s in ([i] if i == j else [i, j])]
        sides = [np.frombuffer(b"".join(f for _, f in m), np.uint64).reshape(len(m), -1) for m in members if m]
        names = [n for m in members for n, _ in m]
        if len(names) < 2 or len(sides) < len(members):
            return []
        return [(names[a], names[b]) for a, b in forest(sides[0], sides[1] if i != j else None, most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for b in batches:
            out = []
            for key, i, j, own, n, fp in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (key, i, j) != at:
                    if len(group) > 1:
                        out += compare(group, *at[1:])
                    at, group = (key, i, j), []
                group.append((own, n, fp))
            if out:
                yield _edges(out)
        if len(group) > 1 and (out := compare(group, *at[1:])):
            yield _edges(out)

    by = ("key", "i", "j")
    return few.union(r.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a bigint, b bigint"))


def _few_pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of the members of keys of two or three ids, from each key's least, greatest and xor of ids."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    lo, hi = F.col("lo"), F.col("hi")
    mid = F.col("x").bitwiseXOR(lo).bitwiseXOR(hi)
    pairs = F.when(F.col("n") == 2, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, mid), pair(lo, hi), pair(mid, hi)))
    return shared.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _checked(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) of ids whose fingerprints differ in ``most`` bits or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            left, right = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(b), -1) for c in b.columns[2:])
            near = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64) <= most
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in b.columns[:2]], names=["a", "b"])

    for side in "ab":
        pairs = pairs.join(classes.select(F.col("id").alias(side), F.col("fp").alias("fp_" + side)), side)
    return pairs.select("a", "b", "fp_a", "fp_b").mapInArrow(run, "a bigint, b bigint")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def groups(prints: DataFrame, keys: list[np.ndarray], most: int) -> DataFrame:
    """(doc_id, fp) → (doc_id, fp, component_id)."""
    prints = save(prints, "fingerprints")
    classes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "classes")
    roots = components(close_edges(classes, keys, most))
    if roots is None:
        named = classes.select("fp", F.col("least").alias("component_id"))
    else:
        c = save(classes.join(roots, classes["id"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "id").alias("root")), "roots")
        named = c.join(c.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def link(df: DataFrame, words: int = 3, most: int = 3, blocks: int = 5) -> DataFrame:
    """doc_id, fp, component_id: 64-bit fingerprints linked at ``most`` or fewer differing bits, without loss."""
    return groups(fingerprints(df, words), pigeonhole_keys(blocks, most), most)


# ---- near copies by exact shingle sets

#: Bands and minima a band: at a resemblance of 0.8 a pair shares no band in (1 - 0.8 ** 5) ** 24 = 0.007 % of cases.
BANDS, MINIMA = 24, 5
_RNG = np.random.default_rng(7)
TIMES, PLUS = _RNG.integers(0, 1 << 63, (2, BANDS * MINIMA), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text, words))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """A 64-bit key for each band of minima of the set, none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * MINIMA, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * TIMES + PLUS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(m.tobytes(), i) for i, m in enumerate(least.reshape(BANDS, MINIMA))], np.uint64).view(np.int64).tolist()


def alike(sets: list[np.ndarray], left: int | None, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets at a resemblance of ``similarity`` or more; with ``left``, of pairs from before it to it or after it."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(name, kind="stable")
    holders = owner[order]
    starts = np.r_[0, np.cumsum(np.bincount(name))]
    at = np.r_[0, np.cumsum(size)]
    root, out = np.arange(len(sets)), []
    for i in range(len(sets) if left is None else left):
        shared = np.zeros(len(sets), np.int64)
        for x in name[at[i] : at[i + 1]]:
            shared[holders[starts[x] : starts[x + 1]]] += 1
        shared[: i + 1 if left is None else left] = 0
        hit = np.flatnonzero((shared > 0) & (shared >= similarity * (size + size[i] - shared) - 1e-9))
        roots, first = np.unique(root[hit], return_index=True)
        new = roots != root[i]
        if new.any():
            out += [(i, int(j)) for j in hit[first[new]]]
            root[np.isin(root, roots)] = root[i]
    return out


def simhash_keys(prints: DataFrame, most: int = 3, blocks: int = 5) -> DataFrame:
    """(key, id) of the sets (id, fp): sets whose 64-bit fingerprints link at ``most`` or fewer differing bits, without loss, share a key."""
    one = save(prints.select("id", "fp").distinct(), "fingerprints")
    classes = save(one.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    roots = components(close_edges(classes, pigeonhole_keys(blocks, most), most))
    named = one.join(classes.select("fp", F.col("id").alias("root")), "fp").select("id", "root")
    if roots is not None:
        named = named.join(roots.select(F.col("node").alias("root"), F.col("root").alias("__root")), "root", "left").select("id", F.coalesce("__root", "root").alias("root"))
    return named.select(F.xxhash64(F.lit("simhash"), "root").alias("key"), "id")


def near_edges(docs: DataFrame, prints: DataFrame, words: int, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) of set ids that connect the sets at ``similarity`` or more whose fingerprints link or which share a band.

    ``prints``: doc_id, id, keys, fp. Keys with the same members count once; the shingle sets are made again, for members of shared keys alone.
    """
    rows = save(prints.select(F.explode("keys").alias("key"), "id").union(simhash_keys(prints)).distinct(), "keys")
    members = (F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor("id").alias("x"))
    shared = rows.groupBy("key").agg(*members).where("n > 1").groupBy("n", "lo", "hi", "x").agg(F.min("key").alias("key"))
    shared = save(shared, "shared")
    held = rows.join(shared.select("key", "n"), "key")
    least = prints.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    wanted = least.join(held.select("id").distinct(), "id").select("doc_id").distinct()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                sets = [shingle_set(t.as_py(), words) for t in b.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "hashes"])

    sets = save(docs.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(make, "id bigint, hashes binary").dropDuplicates(["id"]), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = []
            for a, c, x, y in zip(*b.columns, strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    pairs.append((a.as_py(), c.as_py()))
            if pairs:
                yield _edges(pairs)

    few = _few_pairs(shared.where(F.col("n") <= FEW))
    for side in "ab":
        few = few.join(sets.select(F.col("id").alias(side), F.col("hashes").alias("hashes_" + side)), side)
    few = few.select("a", "b", "hashes_a", "hashes_b").mapInArrow(check, "a bigint, b bigint")

    r = held.where(F.col("n") > FEW).withColumn("parts", F.ceil(F.col("n") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    r = r.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    r = r.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "hashes")

    def compare(at: tuple[int, int, int], group: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        _, i, j = at
        group = sorted(group, key=lambda g: g[:2])
        left = None if i == j else sum(own == i for own, *_ in group)
        if len(group) < 2 or left in (0, len(group)):
            return []
        return [(group[a][1], group[b][1]) for a, b in alike([h for *_, h in group], left, similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for b in batches:
            for key, i, j, own, n, hashes in zip(*b.columns, strict=True):
                here = (key.as_py(), i.as_py(), j.as_py())
                if here != at:
                    if group and (out := compare(at, group)):
                        yield _edges(out)
                    at, group = here, []
                group.append((own.as_py(), n.as_py(), np.frombuffer(hashes.as_py(), np.uint64)))
        if group and (out := compare(at, group)):
            yield _edges(out)

    by = ("key", "i", "j")
    return few.union(r.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a bigint, b bigint"))


def near_groups(df: DataFrame, words: int = 5, similarity: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_hash, root, component_id of the rows with a doc_id: linked at a resemblance of shingle sets of ``similarity`` or more.

    Candidates are the sets that SimHash links (64-bit fingerprints of the sets, 3 bits at most, by blocks, as op 6
    does) and, as those are the closest alone, all that share one of ``BANDS`` keys of minima; each is then checked on
    the exact sets (64-bit hashes stand for the shingles). No cut of bits would do without the minima: of 256 bits, pairs at 0.8 differ in 39 +- 6, pairs at 0.7 in 49 +- 6, and no blocks of bits that such pairs surely
    share are long enough to tell other pairs apart. ``root`` is a group's own; a doc_id with several texts may
    name several groups.
    """
    docs = df.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column(1)]
            fps = [majority(s[:, None]) for s in sets]
            columns = [b.column(0), b.column(2), pa.array(map(set_id, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64())), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "id", "keys", "fp"])

    prints = save(docs.mapInArrow(run, "doc_id bigint, text_hash bigint, id bigint, keys array<bigint>, fp binary"), "sets")
    roots = components(near_edges(docs, prints, words, similarity, chunk))
    named = prints.select("doc_id", "text_hash", "id")
    if roots is None:
        named = named.withColumn("root", F.col("id"))
    else:
        named = named.join(roots, F.col("id") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "id").alias("root"))
    named = save(named, "roots")
    return named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "text_hash", "root", "component_id")


def keep_one(df: DataFrame, **options) -> DataFrame:
    """``df`` with one row of each near-duplicate group: that with the group's smallest doc_id, rows with null doc_id as they are.

    Of several rows with that doc_id the one whose text's hash is smallest stays, of its repeats any one. Rows
    with equal doc_ids whose texts are no near copies are in groups of their own, and stay.
    """
    hash_ = free(df, "__hash")
    kept = near_groups(df, **options).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"))
    kept = kept.select("m.doc_id", F.col("m.text_hash").alias(hash_))
    known = df.where("doc_id IS NOT NULL").withColumn(hash_, F.xxhash64("text")).join(kept, ["doc_id", hash_], "left_semi")
    known = known.dropDuplicates(["doc_id", hash_]).select(*[f"`{c}`" for c in df.columns])
    return known.unionByName(df.where("doc_id IS NULL"))
