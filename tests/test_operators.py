import json
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import chem, geometry, labels, parse, vectors
from quern.operators import audit, ensembles, graphs, order, protocol, relational
from quern.operators import geometry as molecules
from quern.plans import molecules as plans
from quern.sources import scratch, tables
from quern.streaming import incremental

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("text", "number"), [("-78", -78.0), ("-78 - 20", -29.0), ("10; 20", 10.0), ("Ca. 5", 5.0), ("ca. 10 - 20", None), ("10 - 20 approx", 15.0), ("", None), (None, None), ("5d", None), ("x", None)]
)
def test_numeric_field(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse.numeric_field(F.col("t")).alias("n")).first()["n"] == number


@pytest.mark.parametrize(
    ("text", "strict", "want"),
    [("99 percent ee", True, (99.0, None, None)), ("90% ee, 80% de", True, (80.0, None, None)), ("90% ee, 80% de", False, (90.0, None, None)), ("dr >20:1", True, (None, 20 / 21, None)), ("non-evans syn", True, (None, None, "evans_syn")), ("non-evans syn", False, (None, None, "non_evans")), ("enantiomeric", True, (None, None, "anti")), ("enantiomeric", False, (None, None, None))],
)
def test_optical_yield(spark, text, strict, want):
    r = spark.createDataFrame([(text,)], "t string").select(parse.optical_yield(F.col("t"), strict).alias("o")).first()["o"]
    assert (r["ee"], r["dr"], r["kind"]) == want


def test_year_and_flip(spark):
    df = spark.createDataFrame([("X (1999); Y (2004)", "[C@@H]x[C@H]"), ("none", "@"), (None, None)], "c string, s string")
    assert [tuple(r) for r in df.select(parse.citation_year(F.col("c")), parse.flip_chirality(F.col("s"))).collect()] == [(2004, "[C@H]x[C@@H]"), (2010, "@@"), (2010, None)]


def test_step_summary(spark):
    df = spark.range(100)
    rules = [audit.Rule("a", "a", F.col("id") < 20), audit.Rule("b", "b", F.lit(False)), audit.Rule("c", "c", F.col("id") < 40)]
    assert [(r["dropped"], r["pct_dropped"]) for r in audit.step_summary(audit.with_reasons(df, rules), rules).orderBy("step_no").collect()] == [(20, 20.0), (0, 0.0), (20, 25.0)]


def test_weights(spark):
    e = spark.createDataFrame([(1, 0.0), (1, 0.5922)], "g int, e double")
    assert [round(r["weight"], 4) for r in ensembles.boltzmann(e, "g", "e").orderBy("e").collect()] == [0.7311, 0.2689]
    w = spark.createDataFrame([(1, 1.0, 1.0), (1, 3.0, 3.0)], "g int, x double, w double")
    r = ensembles.weighted_stats(w, "g", "x", "w").first()
    assert (round(r["mean"], 6), round(r["std"], 6)) == (2.5, 0.866025)


def test_dihedral_and_group_ids(spark):
    d = spark.range(1).select(vectors.dihedral(*[F.array(*map(F.lit, p)) for p in ([1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 1.0])]).alias("d")).first()["d"]
    assert abs(abs(d) - 1.5707963) < 1e-6
    k = spark.createDataFrame([("b",), ("a",), ("b",)], "k string")
    assert {r["k"]: r["group_id"] for r in relational.group_ids(k, "k").collect()} == {"a": 0, "b": 1}


def test_errors(spark):
    df = spark.createDataFrame([(1, 2)], "row_id int, x int")
    with pytest.raises(ValueError, match="no column"):
        relational.select_prefixes(df, include=("zz",))
    with pytest.raises(ValueError, match="more than one block"):
        relational.assemble([df, df], "row_id")
    with pytest.raises(ValueError, match="changed"):
        tables.aligned(df, spark.createDataFrame([(9, 1)], "row_id int, y int"), "y")
    s = spark.createDataFrame([("s", 1, "g", "train"), ("s", 2, "g", "test")], "split_name string, row_id int, group string, role string")
    with pytest.raises(ValueError, match="groups are shared"):
        relational.verify_split(s)
    with pytest.raises(chem.BackendUnavailable):
        chem.kernel("canonical", "string", True)


def test_assemble_keeps_rows_or_raises(spark):
    a = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "row_id int, x int")
    b = spark.createDataFrame([(3, 1), (1, 7), (2, 9)], "row_id int, y int")
    assert sorted(tuple(r) for r in relational.assemble([a, b], "row_id").collect()) == [(1, 2, 7), (2, 3, 9), (3, None, 1)]
    for wrong in (b.where("row_id < 3"), b.union(b.limit(1)), b.union(spark.createDataFrame([(4, 1)], "row_id int, y int"))):
        for blocks in ([a, wrong], [wrong, a]):
            with pytest.raises(Exception, match="not one row in every block"):
                relational.assemble(blocks, "row_id").collect()
    extra = b.withColumnRenamed("y", "m_y").withColumn("n_y", F.lit(1))
    assert tables.append_block(a, extra, ("m_",)).columns == ["row_id", "x", "m_y"]
    with pytest.raises(Exception, match="not one row in every block"):
        tables.append_block(a, extra.where("row_id <> 2"), ("m_",)).collect()
    with pytest.raises(Exception, match="no single metadata row"):
        relational.attach(a, b.union(b), "row_id").collect()
    with pytest.raises(Exception, match="no single metadata row"):
        relational.attach(a, b.where("row_id <> 2"), "row_id").collect()


def test_order_statistics(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice([None, 5, rng.randint(-50, 50), rng.randint(-(10**12), 10**12)]), float(rng.choice([1.5, 2.5, rng.random()])), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a long, b double, c double")
    a, b = sorted(x for x, *_ in rows if x is not None), sorted(y for _, y, _ in rows)
    for few in (50_000, 100, 5):
        monkeypatch.setattr(order, "FEW", few)
        ranks = [0, 1, 700, len(a) // 2, len(a) - 1]
        got = order.order_statistics(df, [("a", lambda n, k=k: k) for k in ranks] + [("b", lambda n: n // 3), ("c", lambda n: 0), ("a", lambda n: n)])
        assert got == [*(a[k] for k in ranks), b[len(b) // 3], None, None], few
        q = order.quantiles(df, [("a", 0.5), ("b", 0.25), ("c", 0.5), ("b", 0.0), ("b", 1.0)])
        assert q[2] is None and np.allclose([q[0], q[1], q[3], q[4]], [np.quantile(a, 0.5), np.quantile(b, 0.25), b[0], b[-1]])
    assert order.quantiles(df.where("a > 1e18"), [("a", 0.5)]) == [None]


def test_ranks(spark):
    rng = random.Random(2)
    keys = [f"http://a/{rng.randint(0, 10**6):07d}" for _ in range(500)]
    got = {r["k"]: r["group_id"] for r in relational.group_ids(spark.createDataFrame([(k,) for k in keys], "k string").repartition(7), "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(set(keys)))}
    assert relational.group_ids(spark.createDataFrame([], "k string"), "k").count() == 0
    rows = order.ranked(spark.createDataFrame([(x, 1) for x in keys], "k string, n int"), ["k"], "at").orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(500)) and [r["k"] for r in rows] == sorted(keys)


def test_temporary_tables_go_but_those_kept(spark):
    with scratch.Temporary() as t:
        a = scratch.save(spark.range(5), "a")
        at = a.inputFiles()[0].rsplit("/", 1)[0]
        b = t.keep(a.where("id > 2"))
        assert tables.exists(spark, at)
    assert not tables.exists(spark, at) and sorted(r["id"] for r in b.collect()) == [3, 4]


def test_label_expressions(spark):
    rows = [(0, 0, True), (0, 1, True), (0, 1, None), (None, None, True), (None, None, None), (1, None, False)]
    df = spark.createDataFrame(rows, "a int, b int, s boolean")
    got = [tuple(r) for r in df.select(labels.reconciled(F.col("a"), F.col("b"), F.col("s")).alias("r")).select("r.*").collect()]
    assert [g[2] for g in got] == ["high", "conflict", "medium", "low_optical_only", "none", "low_optical_only"]
    assert [g[:2] for g in got] == [(0, 0), (None, None), (0, 1), (None, None), (None, None), (None, None)]


def test_neighbours_and_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[100] = x[3]
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, g int, v array<double>").repartition(5)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for chunk in (20_000, 4):
        got: dict = {}
        for r in ensembles.neighbours(df.where("id % 20 = 0"), df, "id", "v", 4, chunk).collect():
            got.setdefault(r["query"], []).append((r["rank"], r["id"]))
        for q in range(0, 300, 20):
            want = sorted((d[q, j], j) for j in range(300) if j != q)[:4]
            assert [j for _, j in sorted(got[q])] == [j for _, j in want]
    assert ensembles.neighbours(df.where("id < 0"), df, "id", "v", 4).count() == 0
    for axes in (1, 2, 3):
        pairs = {(r["i"], r["j"]) for r in ensembles.pairs_within(df, "g", "id", "v", 1.3, axes).collect()}
        assert pairs == {(i, j) for i in range(300) for j in range(i + 1, 300) if i % 2 == j % 2 and d[i, j] <= 1.3} and pairs


def test_pairs_within_by_blocks_and_on_odd_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6)) * 0.4
    x[::40] = x[0]  # copies are pairs too
    rows = [(i // 2, i % 3, v.tolist()) for i, v in enumerate(x)]  # each key twice
    # lengths of their own, cells far out, and rows that are in no pair
    rows += [(900, 0, [0.1]), (901, 0, [0.2]), (902, 0, []), (903, 0, []), (904, 0, [3e200] * 6), (905, 0, [3e200] * 6), (906, 0, [1.0, 2.0]), (907, 0, [1.0, 2.5])]
    rows += [(910, 1, None), (911, 1, [None] * 6), (912, 1, [float("nan")] * 6), (913, 1, [float("inf")] * 6), (914, None, x[0].tolist()), (None, 0, x[0].tolist())]
    bad = lambda v: v is None or any(c is None or not np.isfinite(c) for c in v)
    good = [(k, g, np.array(v, float)) for k, g, v in rows if k is not None and g is not None and not bad(v)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>").repartition(3)
    for radius in (0.0, 0.8):
        want = sorted((g, a, b) for a, g, u in good for b, h, v in good if g == h and a < b and len(u) == len(v) and np.sqrt(((u - v) ** 2).sum()) <= radius)
        for block in (16, 4096):
            got = ensembles.pairs_within(df, "g", "id", "v", radius, block=block).collect()
            assert sorted((r["g"], r["i"], r["j"]) for r in got) == want and len(want) > 10
    named = df.select(F.concat(F.lit("k"), "id").alias("id"), "g", F.col("v").cast("array<float>").alias("v")).where("id < 'k2'")
    assert ensembles.pairs_within(named, "g", "id", "v", 0.8, block=16).where("i < j AND distance <= 0.8").count() > 10
    assert ensembles.pairs_within(df.where("false"), "g", "id", "v", 0.8).count() == 0


def test_mean_maps_are_summed_in_the_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, float(rng.uniform(0.1, 1)), rng.normal(size=15).tolist(), [6, 8, 7, 1, 16]) for i in range(40)]
    rows += [(50, 0, 0.5, None, [6]), (51, 1, None, rows[0][3], rows[0][4]), (52, 4, 0.5, None, [6]), (53, 5, None, rows[0][3], rows[0][4]), (54, None, 0.5, rows[1][3], rows[1][4])]
    df = spark.createDataFrame(rows, "id long, g int, w double, coords array<double>, z array<int>").repartition(4)
    mean = molecules.mean_maps(df, "g", "w")
    got = {(r["g"], r["cell"]): r["distance"] for r in mean.collect()}
    assert len(got) == 200 * 6
    for g in (0, 1, 2, None):
        of = [r for r in rows if r[1] == g and r[2] is not None]
        maps = [r[2] * geometry.spherical_map(np.array(r[3]).reshape(-1, 3), geometry.radii(np.array(r[4])), 0).ravel() for r in of if r[3]]
        assert np.allclose([got[g, c] for c in range(200)], sum(maps) / sum(r[2] for r in of))
    assert all(got[g, c] is None for g in (4, 5) for c in range(200))
    many = df.where("id < 40").crossJoin(spark.range(60).withColumnRenamed("id", "n")).select((F.col("id") + 40 * F.col("n")).alias("g"), "w", "coords", "z").coalesce(1)
    assert molecules.mean_maps(many, "g", "w").where("distance IS NOT NULL").count() == 200 * 2400
    # no join, so that no table that grows is sent through the driver
    assert "Join" not in plans.spherical_ensembles(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_bfs_equals_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(110)]
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for blocked in (set(), {1, 2, 3, 5, 8}):
        want, level = {0: 0, 7: 0}, [0, 7]
        for step in range(1, 5):
            level = [y for x in level for y in near.get(x, ()) if y not in want and y not in blocked and not want.update({y: step})]
        shut = spark.createDataFrame([(b,) for b in blocked], "node int") if blocked else None
        both = graphs.both_ways(spark.createDataFrame(edges, "src int, dst int"))
        got = {r["node"]: r["dist"] for r in graphs.bfs(both, spark.createDataFrame([(0,), (7,)], "node int"), 4, shut).collect()}
        assert got == want


def test_buried_volume_against_the_definition():
    rng = np.random.default_rng(5)
    x, r = rng.normal(size=(9, 3)) * 2, geometry.radii(np.array([6, 1, 8, 7, 6, 16, 6, 1, 99]))
    normal = geometry.plane_normal(x[0], x[1], x[2])
    ticks = [-3.5 + 0.25 * i for i in range(29)]
    n = {True: [0, 0], False: [0, 0]}
    for gx in ticks:
        for gy in ticks:
            for gz in ticks:
                if gx * gx + gy * gy + gz * gz > 12.25:
                    continue
                p = np.array([gx, gy, gz])
                cell = n[bool(p @ normal > 0)]
                cell[0] += 1
                cell[1] += any(((p - (x[j] - x[0])) ** 2).sum() <= r[j] ** 2 for j in range(1, 9))
    si, re = (100 * n[s][1] / n[s][0] for s in (True, False))
    total = 100 * (n[True][1] + n[False][1]) / (n[True][0] + n[False][0])
    assert np.allclose(geometry.buried_volume(x, r, 0, normal), [si, re, si - re, total])


def test_orientation_rotation_and_normals():
    rng = np.random.default_rng(6)
    for _ in range(20):
        x = rng.normal(size=(6, 3))
        y = geometry.standardised(x, 2)
        order_ = np.argsort(np.linalg.norm(x - x[2], axis=1))[1:3]
        assert np.allclose(y[2], 0) and np.allclose(y[order_[0]][:2], 0) and y[order_[0]][2] > 0
        assert abs(y[order_[1]][0]) < 1e-9 and y[order_[1]][1] >= 0
        assert np.allclose(geometry.rmsd(np.stack([x, x])), 0)
        assert np.allclose(np.linalg.norm(y[:, None] - y, axis=2), np.linalg.norm(x[:, None] - x, axis=2))
        assert np.isclose(np.linalg.det(np.stack([y[i] - y[0] for i in (1, 3, 4)])), np.linalg.det(np.stack([x[i] - x[0] for i in (1, 3, 4)])))
    k = geometry.rotation(np.array([0.0, 0.0, 1.0]), np.pi / 2)
    assert np.allclose(k @ [1, 0, 0], [0, 1, 0])
    down = geometry.standardised(np.array([[0.0, 0, 0], [0, 0, -1], [3, 0, 0]]), 0)
    assert np.allclose(down[1], [0, 0, 1]) and np.allclose(down[2], [0, 3, 0])
    flat = np.c_[rng.normal(size=(6, 2)), np.zeros(6)]
    assert np.allclose(geometry.best_normal(flat), [0, 0, 1]) and np.allclose(geometry.plane_normal(*np.zeros((3, 3))), [0, 0, 1])
    ring = geometry.chair(2.0)
    assert np.allclose(ring[:, 2], [0.3, -0.3] * 3) and np.allclose(np.hypot(ring[:, 0], ring[:, 1]), [1.4, 1.3, 1.4, 1.4, 1.4, 1.3])
    si, re, diff, clash = geometry.face_blocking(ring, np.array([[0.0, 0, 2], [0, 0, 4]]), ring[3])
    assert np.isclose(si + re, 1, atol=1e-6) and max(si, re) > 0.99 and np.isclose(diff, abs(si - re)) and clash == 0
    assert geometry.face_blocking(ring, np.empty((0, 3)), ring[3]) == (0.0, 0.0, 0.0, 0.0) and geometry.sterimol(ring, np.ones(6), 0, np.array([], int)) == (0, 0, 0)


def test_average_linkage_equals_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(15):
        x = rng.normal(size=(rng.integers(1, 14), 2))
        d = np.linalg.norm(x[:, None] - x, axis=2)
        cut, most = 1.0, int(rng.integers(1, 9))
        groups = [[i] for i in range(len(x))]
        while len(groups) > 1:
            best = min((np.mean([d[a, b] for a in p for b in q]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
            if best[0] > cut and len(groups) <= most:
                break
            groups[best[1]] += groups.pop(best[2])
        want = {frozenset(g) for g in groups}
        label = geometry.average_linkage(d, cut, most)
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in np.unique(label)} == want


def test_representatives_and_odd_molecules(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 3))
    rows = [("m", i, float(i), (base + (0 if i < 3 else 9 * np.eye(4, 3)) + rng.normal(size=(4, 3)) * 0.01).ravel().tolist()) for i in range(5)] + [("n", 9, 1.0, base.ravel().tolist()), ("n", 10, None, None)]
    df = spark.createDataFrame(rows, "g string, member int, energy double, coords array<double>")
    got = sorted(tuple(r) for r in molecules.representatives(df, "g", "member", "energy").collect())
    w = np.exp(-np.array([0, 3]) / ensembles.KT)
    assert [(r[0], r[1]) for r in got] == [("m", 0), ("m", 3), ("n", 9)] and np.allclose([r[4] for r in got], [*w / w.sum(), 1])
    odd = spark.createDataFrame([(1, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [6, 6, 6]), (2, None, [6]), (3, [1.0, 2.0], [6]), (4, [None, 0.0, 0.0], [6]), (5, [], [])], "id int, coords array<double>, z array<int>")
    assert [r["id"] for r in molecules.buried_volumes(odd, "id").where("vbur_total IS NOT NULL").collect()] == [1]
    assert molecules.spherical_maps(odd.where("id = 1"), "id").first()["map"][0] > 7


def test_greedy_leaders_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(int(g), i, float(e), v.tolist()) for i, (g, e, v) in enumerate(zip(rng.integers(0, 5, 60), rng.random(60), rng.normal(size=(60, 2)), strict=True))]
    want = set()
    for g in range(5):
        lead: list = []
        for _, i, e, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[2]):
            if len(lead) < 4 and all(np.linalg.norm(np.subtract(v, u)) >= 1.0 for _, u in lead):
                lead.append((i, v))
        want |= {(g, n, i) for n, (i, _) in enumerate(lead)}
    df = spark.createDataFrame(rows, "g int, k int, e double, v array<double>")
    assert {(r["g"], r["place"], r["k"]) for r in ensembles.greedy_leaders(df, "g", "k", "e", "v", 1.0, 4).collect()} == want


def test_shuffled_labels_keep_their_counts(spark):
    rows = [(i, "abc"[min(i % 7, 2)]) for i in range(500)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, y string")
    got = protocol.shuffled_labels(df, "id", "y", [1, 2, 3]).collect()
    for seed in (1, 2, 3):
        dealt = [(r["id"], r["null_label"]) for r in got if r["seed"] == seed]
        assert len(dealt) == 500 and all(sum(l == x for _, l in dealt) == sum(l == x for _, l in rows) for x in "abc")
        assert 0.2 < np.mean([l == rows[i][1] for i, l in dealt]) < 0.8


def test_permuted_keeps_each_column(spark):
    rows = [(i, i % 3, [float(i), float(-i), 0.5]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    got = {r["id"]: r["x"] for r in protocol.permuted(df, 1, [1]).collect()}
    assert all(v[0] == i and v[2] == 0.5 for i, v in got.items()) and sorted(v[1] for v in got.values()) == [float(-i) for i in reversed(range(200))]
    assert sum(v[1] == -i for i, v in got.items()) < 20


def test_kernel_states_failures(spark, tmp_path, monkeypatch):
    (tmp_path / "quern_fake_backend.py").write_text("import time\nclass Backend:\n    def weight(self, s):\n        if s == 'slow': time.sleep(5)\n        if s == 'bad': raise KeyError(s)\n        return float(len(s))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "quern_fake_backend.py"))
    f = chem.kernel("weight", "double", seconds=0.5, module="quern_fake_backend")
    df = spark.createDataFrame([("CC",), ("bad",), ("slow",), (None,)], "s string")
    got = {r["s"]: (r["k"]["value"], r["k"]["status"]) for r in df.select("s", f("s").alias("k")).collect()}
    assert got == {"CC": (2.0, "ok"), "bad": (None, "KeyError"), "slow": (None, "timeout"), None: (None, None)}
    sys.modules.pop("quern_fake_backend", None)


def test_streamed_cache_computes_new_keys_only(spark, tmp_path):
    schema, runs = "k long, v string", []

    def compute(df):
        runs.append(sorted(r["k"] for r in df.select("k").collect()))
        return df.withColumn("size", F.length("v"))

    for rows in ([(1, "a"), (2, "bb"), (2, "bb"), (None, "x")], [(2, "bb"), (3, "ccc")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        incremental.fill_cache(stream, f"{tmp_path}/cache", "k", compute, f"{tmp_path}/check").awaitTermination()
    assert runs == [[1, 2], [3]]
    assert sorted((r["k"], r["size"]) for r in spark.read.parquet(f"{tmp_path}/cache").collect()) == [(1, 1), (2, 2), (3, 3)]


def test_sinks_and_loaders(spark, tmp_path):
    df = spark.createDataFrame([(1, "evans", 2.0), (2, "other", 3.0)], "row_id int, kind string, f_x double")
    rules = [audit.Rule("a", "odd", F.col("row_id") == 2)]
    audited = audit.with_reasons(df, rules)
    tables.write_clean(audit.kept(audited), audit.row_audit(audited, "row_id"), audit.step_summary(audited, rules), str(tmp_path), "kind")
    assert [r["row_id"] for r in spark.read.parquet(f"{tmp_path}/clean/kind=evans").collect()] == [1]
    assert spark.read.parquet(f"{tmp_path}/row_audit").first()["reason"] == "odd" and spark.read.parquet(f"{tmp_path}/step_summary").count() == 1
    tables.write_report(audit.row_audit(audited, "row_id"), f"{tmp_path}/report")
    assert spark.read.csv(f"{tmp_path}/report", header=True).first()["reason"] == "odd"
    assert json.loads(json.dumps(tables.manifest(df, {"f": ("f_",)}))) == {"features": ["row_id", "kind", "f_x"], "widths": {"f": 1}}
    p = spark.createDataFrame([("m", "tscv_fold1", 1, 0, 0), ("m2", "scaffold", 2, 1, 0)], "model string, split string, idx int, y_true int, y_pred int")
    tables.write_predictions(p, f"{tmp_path}/pred")
    tables.write_predictions(p.where("model = 'm'").withColumn("y_pred", F.lit(1)), f"{tmp_path}/pred")
    assert sorted((r["model"], r["y_pred"]) for r in spark.read.parquet(f"{tmp_path}/pred").collect()) == [("m", 1), ("m2", 0)]
    (tmp_path / "csv").mkdir()
    for name in ("v4b_full_xgb_tscv_fold4", "et_optuna_scaffold"):
        (tmp_path / "csv" / f"{name}.csv").write_text("idx,y_true,y_pred\n3,1,0\n")
    got = tables.read_predictions(spark, f"{tmp_path}/csv/*.csv", "idx int, y_true int, y_pred int").collect()
    assert sorted((r["model"], r["split"], r["y_true"]) for r in got) == [("et_optuna", "scaffold", 1), ("v4b_full_xgb", "tscv_fold4", 1)]
    (tmp_path / "feat").mkdir()
    (tmp_path / "feat" / "labels.csv").write_text("row_id,y\n1,0\n")
    df.write.parquet(f"{tmp_path}/feat/features.parquet")
    assert tables.load_labels(spark, f"{tmp_path}/feat").first()["y"] == 0 and tables.row_total(tables.load_features(spark, f"{tmp_path}/feat")) == 2
    with pytest.raises(FileNotFoundError):
        tables.load_features(spark, f"{tmp_path}/none")
    np.save(tmp_path / "a.npy", np.arange(12).reshape(4, 3))
    got = {r["row"]: r["values"] for r in tables.read_arrays(spark, f"{tmp_path}/a.npy").collect()}
    assert got == {i: [3.0 * i, 3.0 * i + 1, 3.0 * i + 2] for i in range(4)}
    aligned = tables.aligned(spark.createDataFrame([(1, None), (2, 5.0)], "row_id int, x double"), spark.createDataFrame([(1, 0), (2, None)], "row_id int, y0 int"), "y0")
    assert sorted(tuple(r) for r in aligned.collect()) == [(1, 0.0, 0), (2, 5.0, None)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,"z"\n1,"two\nlines",3\n')
    assert [tuple(r) for r in tables.read_csv_known(spark, str(tmp_path / "a.csv"), ["y", "q"]).collect()] == [("two\nlines",)]
    (tmp_path / "l.csv").write_bytes("x\né\n".encode("latin-1"))
    assert tables.read_csv_known(spark, str(tmp_path / "l.csv"), ["x"], "ISO-8859-1").first()["x"] == "é"
    with pytest.raises(ValueError, match="none of the columns"):
        tables.read_csv_known(spark, str(tmp_path / "l.csv"), ["q"])
    (tmp_path / "s.json").write_text('{"train": [1, 2], "val": [3], "test": []}')
    assert sorted(tuple(r) for r in tables.read_splits(spark, str(tmp_path)).collect()) == [("s", "train", 1), ("s", "train", 2), ("s", "val", 3)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predictions_shuffle_no_test_row(spark):
    rows = [(i, i % 3, [float(i % 3), float(i % 7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y long, x array<double>")
    centres = scratch.save(protocol.centroids(df.where("id >= 20")), "centres")
    out = protocol.predict(df.where("id < 20"), centres)
    plan = _plan(out)
    assert plan.count("BroadcastNestedLoopJoin") == 1 and "hashpartitioning(id" not in plan and "SortMergeJoin" not in plan
    c = {r["y"]: r["c"] for r in centres.collect()}
    for r in out.collect():
        assert r["y_pred"] == min(c, key=lambda k: (sum((a - b) ** 2 for a, b in zip(r["x"], c[k], strict=True)), k))
    assert protocol.predict(df, centres.where("y < 0")).count() == 0


def test_messages_read_two_tables_a_round(spark):
    nodes = spark.createDataFrame([(i, float(i)) for i in range(5)], "node long, value double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 2)], "src long, dst long")
    out = ensembles.message_pass(nodes, edges, 5)
    assert _plan(out).count("FileScan parquet") == 3
    want = {i: float(i) for i in range(5)}
    for _ in range(5):
        into = {d: [want[s] for s, t in [(0, 1), (1, 2), (2, 0), (3, 2)] if t == d] for d in want}
        want = {n: v / 2 + (sum(into[n]) / len(into[n]) if into[n] else v) / 2 for n, v in want.items()}
    assert {r["node"]: r["value"] for r in out.collect()} == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 4, 5, 7, 16, 101])
def test_exact_group_split_has_exact_shares(spark, n):
    rows = [(i, None if i % n == 0 else f"g{i % n}") for i in range(3 * n)]
    out = relational.exact_group_split(spark.createDataFrame(rows, "id long, g string"), "id", "g", [1, 2]).collect()
    for seed in (1, 2):
        role = {}
        for r in out:
            if r["split_name"] == f"exact_seed{seed}":
                role.setdefault(r["group"], set()).add(r["role"])
        assert len(role) == n and all(len(x) == 1 for x in role.values())
        test = -(-n // 5)
        counts = [sum(x == {name} for x in role.values()) for name in ("test", "val", "train")]
        assert counts == [test, -(-(n - test) // 8), n - test - -(-(n - test) // 8)]
    assert len(out) == 6 * n
    assert relational.exact_group_split(spark.createDataFrame([], "id long, g string"), "id", "g", [1]).collect() == []
