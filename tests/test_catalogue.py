import ast
import pathlib

import numpy as np
import pytest

import __spark_entry__
from quern.plans import catalogue, learning
from tests.conftest import DATA, assert_same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert_same(catalogue.QUERIES[name](spark, DATA), duck, catalogue.ORACLES[name])


def test_queries_without_sql_hold_what_they_promise(spark):
    run = lambda name: catalogue.QUERIES[name](spark, DATA).collect()
    inertia = [r["inertia"] for r in sorted(run("ml_kmeans_sweep"))]
    assert len(inertia) == 9 and all(b < a * 1.02 for a, b in zip(inertia, inertia[1:], strict=False)) and inertia[-1] < inertia[0]
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    clusters = run("ml_kmeans")
    assert sum(r["n"] for r in clusters) == len(e) and all(0 < r["purity"] <= 1 for r in clusters)
    # components: as many as asked, uncorrelated on the rows they were fitted on, in falling order of variance
    fold = {r["vec_id"]: r["fold"] for r in learning.data(spark, DATA).select("vec_id", "fold").collect()}
    x = np.array([r["components"] for r in run("ml_pca") if fold[r["vec_id"]]])
    c = np.cov(x.T)
    assert x.shape[1] == 16 and np.allclose(c - np.diag(np.diag(c)), 0, atol=1e-9) and (np.diff(np.diag(c)) <= 1e-9).all()
    fitted = np.array([r["embedding"] for r in e if fold[r["vec_id"]]])
    assert np.allclose(np.diag(c), np.sort(np.linalg.eigvalsh(np.cov(fitted.T)))[::-1][:16])
    for name in ("ml_rf", "ml_stack", "ml_ovr_gbt"):
        rows = run(name)
        assert {r["vec_id"] for r in rows} == {v for v, f in fold.items() if f == 0}
        assert np.mean([r["y_true"] == r["y_pred"] for r in rows]) > 0.05
    importances = [r["importance"] for r in run("ml_importances")]
    assert len(importances) == 64 and abs(sum(importances) - 1) < 1e-6 and min(importances) >= 0
    search = run("ml_search")
    assert [r["test"] is not None for r in search].count(True) == 1 and max(search, key=lambda r: r["val"])["test"] is not None
    weights: dict = {}
    for r in run("conformer_clusters"):
        weights.setdefault(r["ensemble"], []).append(r["weight"])
    assert all(abs(sum(w) - 1) < 1e-9 and len(w) <= 8 for w in weights.values())
    blocked = run("face_blocking")
    assert len(blocked) == len(e) and all(abs(r["si_share"] + r["re_share"] - 1) < 1e-6 and abs(r["asymmetry"] - abs(r["si_share"] - r["re_share"])) < 1e-9 and 0 <= r["clash"] <= 1 for r in blocked)
    x = np.array(e[0]["embedding"][:63]).reshape(21, 3) * 10
    n = np.linalg.svd(x[:6] - x[:6].mean(0))[2][-1]
    near = 1 / (np.linalg.norm(x[6:] - x[3], axis=1) + 0.5)
    side = near[(x[6:] - x[3]) @ n > 0].sum() / near.sum()
    own = next(r for r in blocked if r["vec_id"] == e[0]["vec_id"])
    assert np.isclose(max(own["si_share"], own["re_share"]), max(side, 1 - side), atol=1e-6)
    leaders = run("greedy_clusters")
    assert {r["place"] for r in leaders} <= set(range(8)) and len({r["ensemble"] for r in leaders}) == len(weights)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_nothing_else_imports_the_llm_subpackage():
    root = pathlib.Path(__file__).parent.parent / "quern"
    for p in root.rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, ast.Import | ast.ImportFrom) else []
            assert not any(n.startswith("quern.llm") or n == "llm" for n in names), p
