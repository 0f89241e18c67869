import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import descent, messages
from quern.plans import catalogue
from quern.sources import scratch
from tests.conftest import DATA


def graphs(spark, n=40, seed=1):
    r = np.random.default_rng(seed)
    nodes, edges, labels = [], [], []
    for g in range(n):
        k = int(r.integers(1, 8))
        nodes += [(g, 10 * i + 3, r.standard_normal(3).tolist()) for i in range(k)]
        pairs = {(int(a), int(b)) for a, b in r.integers(0, k, (k + 2, 2))}
        edges += [(g, 10 * a + 3, 10 * b + 3) for a, b in pairs] + [(g, 3, 999)]
        labels.append((g, g % 3 if g else None))
    return spark.createDataFrame(nodes, "graph_id long, node long, x array<double>"), spark.createDataFrame(edges, "graph_id long, src long, dst long"), spark.createDataFrame(labels, "graph_id long, label int")


@pytest.mark.parametrize("on_edges", [True, False])
def test_gradients_equal_finite_differences(spark, on_edges):
    blocks = messages.graph_blocks(*graphs(spark), per_block=100)
    t = blocks.toArrow()
    assert blocks.agg(F.sum("rows")).first()[0] == 39
    block = next(descent.arrays(t.to_batches()[0]))
    w = messages.new_model(3, 3, 5)
    w |= {"bias": np.full(5, 0.1)}
    k = messages.kernel(3, on_edges)
    got = k(w, block)
    for n in w:
        for i in np.ndindex(w[n].shape):
            up, down = ({m: x.copy() for m, x in w.items()} for _ in range(2))
            up[n][i] += 1e-6
            down[n][i] -= 1e-6
            assert np.isclose((k(up, block)["loss"] - k(down, block)["loss"]) / 2e-6, got[n][i], rtol=1e-4, atol=1e-5), (n, i)


def test_edge_states_hear_all_but_their_reverse(spark):
    b = next(descent.arrays(messages.graph_blocks(*graphs(spark), per_block=100).toArrow().to_batches()[0]))
    g = messages.Wiring(b, True)
    h = np.random.default_rng(0).standard_normal((len(g.src), 4))
    line = np.array([[float(g.dst[j] == g.src[i] and g.src[j] != g.dst[i]) for j in range(len(g.src))] for i in range(len(g.src))])
    assert np.allclose(g.heard(h), line @ h) and np.allclose(g.heard_back(h), line.T @ h)


def test_loss_is_the_same_for_any_partitions_and_after_a_stop(spark):
    blocks = messages.graph_blocks(*graphs(spark, 120), per_block=8)
    one, losses = messages.train(blocks.coalesce(1), 3, 3, steps=8)
    four, same = messages.train(blocks.repartition(4), 3, 3, steps=8)
    assert losses == same and all((one[n] == four[n]).all() for n in one) and losses[-1] < losses[0]
    state = scratch.new_path(spark, "state")
    messages.train(blocks, 3, 3, steps=4, state=state)
    halfway = spark.read.parquet(state).count()
    resumed, rest = messages.train(blocks, 3, 3, steps=8, state=state)
    assert halfway == 1 and rest == losses and all((resumed[n] == one[n]).all() for n in one)
    empty, none = messages.train(blocks.where("false"), 3, 3, steps=2)
    assert none == [] and set(empty) == set(one)


@pytest.mark.parametrize("on_edges", [True, False])
def test_training_learns_what_edges_join(spark, on_edges):
    # a path of three: class 1 where the marked ends are joined through the middle, 0 where the bond is missing
    r = np.random.default_rng(2)
    kinds = r.integers(0, 2, 200)
    nodes = spark.createDataFrame([(g, i, [1.0, float(i == 1)]) for g in range(200) for i in range(3)], "graph_id long, node long, x array<double>")
    edges = spark.createDataFrame([(g, 0, 1) for g in range(200)] + [(g, 1, 2) for g in range(200) if kinds[g]], "graph_id long, src long, dst long")
    blocks = messages.graph_blocks(nodes, edges, spark.createDataFrame([(g, int(k)) for g, k in enumerate(kinds)], "graph_id long, label int"), per_block=64)
    w, losses = messages.train(blocks, 2, 2, 2, on_edges, steps=40, rate=0.03, width=8)
    got = messages.predict(blocks, w, 2, on_edges).collect()
    assert len(got) == 200 and all(r["y_true"] == r["y_pred"] for r in got) and losses[-1] < 0.1


def test_directed_messages_equal_the_dense_line_graph(spark):
    r = np.random.default_rng(5)
    rows = [(int(a), int(b), int(v)) for a, b, v in zip(r.integers(0, 12, 60), r.integers(0, 12, 60), r.integers(1, 9, 60), strict=True)] + [(0, 1, 2), (0, 1, 3)]
    first: dict = {}
    for a, b, v in rows:
        first[a, b] = first.get((a, b), 0) + v
    want = dict(first)
    for _ in range(3):
        want = {(a, b): first[a, b] + sum(v for (c, d), v in want.items() if d == a and c != b) for a, b in first}
    got = messages.directed_messages(spark.createDataFrame(rows, "src long, dst long, value long"), 3)
    assert {(r["src"], r["dst"]): r["value"] for r in got.collect()} == want
    assert messages.directed_messages(spark.createDataFrame([], "src long, dst long, value long"), 2).count() == 0


def test_principal_components_and_encoder(spark):
    r = np.random.default_rng(3)
    s = r.standard_normal((300, 2))
    x = np.c_[s, s[:, :1] ** 2, np.abs(s[:, 1:])] @ r.standard_normal((4, 10)) + 0.01 * r.standard_normal((300, 10)) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)], "k long, v array<double>")
    blocks = descent.vector_blocks(df, "k", "v", 64)
    mean, v, var = descent.principal(blocks, 10, 2, passes=8)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(0)) and np.allclose(var, values[::-1][:2], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(v * vectors[:, ::-1][:, :2], 0)), 1, atol=1e-6)
    w = descent.encoder(mean, v, 12)
    block = {"rows": 300, "x": x.ravel()}
    tilted = w | {n: w[n] + 0.1 for n in ("B", "D")}
    got = descent.encoder_kernel(tilted, block)
    for n in ("V", "U", "A", "B", "C", "D"):
        i = tuple(k // 2 for k in w[n].shape)
        up, down = (tilted | {n: tilted[n].copy()} for _ in range(2))
        up[n][i] += 1e-6
        down[n][i] -= 1e-6
        assert np.isclose((descent.encoder_kernel(up, block)["loss"] - descent.encoder_kernel(down, block)["loss"]) / 2e-6, got[n][i], rtol=1e-3, atol=1e-3), n
    fitted, losses = descent.descend(blocks, descent.encoder_kernel, w, 30, 0.02)
    pca = values[::-1][2:].sum()
    assert np.isclose(losses[0], pca, rtol=1e-6) and min(losses) < 0.8 * pca
    out = {r["k"]: r["code"] for r in descent.encode(df, "k", "v", fitted).collect()}
    assert out[1000] is None and np.allclose([out[i] for i in range(300)], descent.codes(fitted, x))
    with pytest.raises(Exception, match="too large"):
        descent.summed(descent.vector_blocks(spark.createDataFrame([(1, [float("nan")])], "k long, v array<double>"), "k", "v"), descent._moments, {}, {"mean": (1,)}, 1)


def test_queries_learn(spark):
    for name in ("edge_message_classes", "node_message_classes"):
        rows = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
        held = [r for r in rows if r["held_out"]]
        commonest = max(np.bincount([r["y_true"] for r in held])) / len(held)
        assert len(rows) == 500 and 0 < len(held) < 250 and np.mean([r["y_true"] == r["y_pred"] for r in held]) > commonest + 0.1
    assert catalogue.QUERIES["vector_codes"](spark, DATA).count() == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
