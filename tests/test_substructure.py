import hashlib
import itertools

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quern.operators import descent
from quern.operators import substructure as S


def random_graphs(n, seed, labels="abc"):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        k = int(r.integers(1, 9))
        label = [labels[i] for i in r.integers(0, len(labels), k)]
        edges = {(int(a), int(b)) for a, b in r.integers(0, k, (int(r.integers(0, 2 * k)), 2))}
        out.append((label, edges))
    return out


def tables(spark, graphs, name=lambda g, i: i):
    nodes = [(g, name(g, i), x) for g, (label, _) in enumerate(graphs) for i, x in enumerate(label)]
    edges = [(g, name(g, a), name(g, b)) for g, (_, es) in enumerate(graphs) for a, b in es]
    return spark.createDataFrame(nodes, "graph_id long, node long, label string"), spark.createDataFrame(edges, "graph_id long, src long, dst long")


def near_of(label, edges):
    near = [set() for _ in label]
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
refine = lambda code, near: [md5(",".join([c, *sorted(code[j] for j in near[i])])) for i, c in enumerate(code)]


def packed(spark, graphs, name=lambda g, i: i):
    n, e = tables(spark, graphs, name)
    return S.pack(n.withColumnRenamed("label", "code"), e)


def test_fingerprints_equal_brute_force_under_any_numbering(spark):
    graphs = random_graphs(40, 1)
    shuffled = {g: np.random.default_rng(g).permutation(len(label)) * 7 + 2 for g, (label, _) in enumerate(graphs)}
    for name in (lambda g, i: i, lambda g, i: int(shuffled[g][i])):
        got = {r["graph_id"]: r["fp"] for r in S.fingerprint(packed(spark, graphs, name)).collect()}
        for g, (label, edges) in enumerate(graphs):
            code, near = [md5(x) for x in label], near_of(label, edges)
            seen = list(code)
            for _ in range(3):
                code = refine(code, near)
                seen += code
            assert got[g] == sorted({int(c[:8], 16) % 512 for c in seen})
    assert len({tuple(x) for x in got.values()}) > 30


def test_difference_and_its_components(spark):
    df = spark.createDataFrame([(1, [0, 3], [3, 4]), (2, [1], [1]), (3, None, [0]), (4, [0, 1], [2])], "k long, a array<int>, b array<int>")
    d = df.select("k", S.difference(F.col("a"), F.col("b"), 5).alias("d"))
    want = {1: [1, 0, 0, 0, -1], 2: [0] * 5, 3: [-1, 0, 0, 0, 0], 4: [1, 1, -1, 0, 0]}
    assert {r["k"]: r["d"] for r in d.collect()} == want
    got = {r["k"]: r["components"] for r in S.compressed(d, "k", "d", 5, 4).collect()}
    x = np.array([want[k] for k in (1, 3, 4)], float)
    c = x - x.mean(0)
    values = np.sort(np.linalg.svd(c)[1])[::-1]
    y = np.array([got[k] for k in (1, 3, 4)])
    # three rows span two directions; the others are zeros
    assert np.allclose(np.sort((y**2).sum(0))[::-1][:2], values[:2] ** 2) and np.allclose(y[:, 2:], 0) and len(got[2]) == 4
    assert S.compressed(d.where("false"), "k", "d", 5).count() == 0
    assert S.compressed(d.where("k = 2"), "k", "d", 5).first()["components"] == [0.0] * 16


def test_vectors_are_packed_and_read_few_blocks_at_a_time(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-1, 2, (300, 512))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)], "k long, v array<int>").repartition(3)
    # vectors of three values are small on disk, where hundreds of blocks fit one row group
    blocks = descent.vector_blocks(df.where("k < 301"), "k", "v", per_block=2)
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in blocks.inputFiles()]
    groups = [f.metadata.row_group(g).num_rows for f in files for g in range(f.metadata.num_row_groups)]
    assert max(groups) <= descent.GROUP and sum(groups) == blocks.count() > 100
    held = blocks.collect()
    assert sorted(k for b in held for k in b["key"]) == list(range(300)) and len({b["block"] for b in held}) == len(held)
    for b in held:
        assert b["rows"] == len(b["key"]) and b["key"] == sorted(b["key"]) and np.array_equal(np.reshape(b["x"], (-1, 512)), x[b["key"]])
    got = {r["k"]: r["components"] for r in S.compressed(df.where("k < 301"), "k", "v", 512, 4).collect()}
    mean, parts, _ = descent.principal(descent.vector_blocks(df.where("k < 300"), "k", "v"), 512, 4)
    assert len(got) == 301 and got[300] == [0.0] * 4 and np.allclose([got[k] for k in range(300)], (x - mean) @ parts)



def test_scaffolds_equal_brute_force(spark):
    ring = lambda k, tail: (["a"] * (k + tail), {(i, (i + 1) % k) for i in range(k)} | {(i, i + 1) for i in range(k - 1, k + tail - 1)})
    linked = (["a"] * 8, {(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 4), (3, 7)})
    graphs = [*random_graphs(40, 2), ring(5, 0), ring(5, 3), ring(6, 1), linked, (["a"], set())]
    name = lambda g, i: 100 - 3 * i if g % 2 else i
    got = {r["graph_id"]: r for r in S.scaffold(packed(spark, graphs, name)).collect()}
    for g, (label, edges) in enumerate(graphs):
        near, alive = near_of(label, edges), set(range(len(label)))
        while gone := {i for i in alive if len(near[i] & alive) < 2}:
            alive -= gone
        code = [md5(x) for x in label]
        for _ in alive:
            code = refine(code, [n & alive for n in near])
        assert got[g]["scaffold"] == sorted(name(g, i) for i in alive)
        assert got[g]["key"] == (md5(",".join(sorted(code[i] for i in alive))) if alive else S.ACYCLIC)
    # the linker stays, the tail goes
    assert len(got[43]["scaffold"]) == 7 and len(got[41]["scaffold"]) == 5


def test_equal_scaffolds_share_a_key_whatever_their_tails(spark):
    ring = lambda k, tail: (["a"] * (k + tail), {(i, (i + 1) % k) for i in range(k)} | {(i, i + 1) for i in range(k - 1, k + tail - 1)})
    keys = {r["graph_id"]: r["key"] for r in S.scaffold(packed(spark, [ring(5, 0), ring(5, 4), ring(6, 0), (["a", "a"], {(0, 1)})])).collect()}
    assert keys[0] == keys[1] != keys[2] and keys[3] == S.ACYCLIC


def test_matches_equal_a_search(spark):
    graphs = random_graphs(60, 3)
    templates = [(["a", "b", "c", None], [(0, 1), (1, 2), (2, 0), (2, 3)]), (["b", None, "b"], [(0, 1), (1, 2)]), ([None, "c"], [(0, 1)]), (["a"], [])]
    want = {}
    for g, (label, edges) in enumerate(graphs):
        near = near_of(label, edges)
        for t, (labels, es) in enumerate(templates):
            fits = [m for m in itertools.permutations(range(len(label)), len(labels)) if all(w in (None, label[i]) for w, i in zip(labels, m, strict=True)) and all(m[b] in near[m[a]] for a, b in es)]
            if fits:
                want[g] = (t, list(min(fits)))
                break
    n, e = tables(spark, graphs)
    got = {r["graph_id"]: (r["template"], r["match"]) for r in S.first_match(n, e, templates).collect()}
    assert got == want and len({t for t, _ in want.values()}) == 4
    assert S.first_match(n.where("false"), e, templates).count() == 0
