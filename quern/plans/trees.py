"""Tree models: boosted classes, extremely randomised trees, their split tables with SQL, Shapley values.

The labelled rows are the documents' quality and toxicity as one joint label, by counts of what a text is made of.
The split tables are those of the first trees over the embeddings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import forests, search, shap, trees
from quern.plans.common import Registry, table
from quern.plans.protocol import E_SQL, data
from quern.sources.scratch import save

REGISTRY = Registry()
query = REGISTRY.add

#: What a text is made of: name → pattern whose matches are counted, as shares of the text's length.
PARTS = {"upper": "[A-Z]", "digits": "[0-9]", "signs": r"[^\w\s]", "bars": r"\|", "spaces": r"\s", "other": r"[^\x00-\x7F]", "words": r"\S+", "short": r"\b\w{1,2}\b"}
FEATURES = ["length", "lines", *PARTS]


def features(text: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1))
    return F.array(F.log1p(F.length(text)), F.log1p(F.regexp_count(text, F.lit("\n"))), *[F.regexp_count(text, F.lit(p)) / n for p in PARTS.values()])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y (quality and toxicity as one label), x, fold of each labelled document with a text.

    Features are counted in the scan and written once: no text is shuffled, and a fit's passes read numbers only.
    """
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", features(F.col("text")).alias("x"))
    d = docs.join(table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL"), "doc_id")
    return save(d.select(F.col("doc_id").alias("id"), F.concat("quality", "toxic").alias("y"), "x", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold")), "labelled")


def _fold() -> Column:
    return F.when(F.col("fold") == 1, "val").otherwise("train")


BOOSTING = trees.Boosting(rounds=6, leaves=8, rate=0.4, bins=32, patience=2)


@query()
def boosted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees fitted on folds 2 to 4, stopped by fold 1, judging fold 0. Test: equal to brute force on small rows."""
    d = labelled(spark, sf_dir)
    model = trees.fit_boosted(d.where("fold <> 0"), BOOSTING, _fold())
    return trees.predict(model, d.where("fold = 0"), ["id", "y"])


@query()
def extra_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of random cuts fitted on folds 1 to 4, judging fold 0. Test: equal to brute force on small rows."""
    d = labelled(spark, sf_dir)
    return trees.predict(forests.fit_forest(d.where("fold <> 0"), forests.Forest(trees=30, depth=6)), d.where("fold = 0"), ["id", "y"])


@query()
def shap_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, class, mean_abs, mean of the Shapley values of boosted trees on fold 0. Test: equal to brute force over subsets of features."""
    d = labelled(spark, sf_dir)
    model = trees.fit_boosted(d.where("fold <> 0"), trees.Boosting(rounds=3, leaves=8, rate=0.4))
    out = shap.importance(shap.explain(model, d.where("fold = 0"), "id"))
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), F.col(i) + 1)
    return out.select(pick(FEATURES, "feature").alias("feature"), pick(model.classes, "class").alias("class"), "mean_abs", "mean")


def _paths(t: trees.Tree) -> list[tuple[str, int]]:
    """(way from the root as L and R, node) of each split."""
    way = {0: ""}
    for node, f in enumerate(t.feature):
        if f >= 0:
            way[t.left[node]], way[t.right[node]] = way[node] + "L", way[node] + "R"
    return [(way[node], node) for node, f in enumerate(t.feature) if f >= 0]


SPLITS = "class int, path string, feature int, cut double, n_left bigint, n_right bigint"
#: Two levels of the first round's trees: every node of the first is split where that gains.
FIRST_SQL = (
    E_SQL
    + """, t AS (SELECT id, y FROM r WHERE y IS NOT NULL), f AS (SELECT count(DISTINCT y) AS k, count(*) AS n FROM t), n AS (SELECT y, count(*) AS n FROM t GROUP BY y),
w AS (SELECT t.id, t.y, f.n / (f.k * n.n) AS w FROM t JOIN n USING (y), f), z AS (SELECT e.* FROM e JOIN t USING (id)),
u AS (SELECT pos, min(v) AS lo, max(v) AS hi FROM z GROUP BY pos),
b AS (SELECT id, pos, len(list_filter(range(1, 16), lambda i: lo + (hi - lo) * i / 16 <= v)) AS bin FROM z JOIN u USING (pos)),
g AS (SELECT id, n.y AS c, round((1 / f.k - CAST(w.y = n.y AS INT)) * w * 16777216)::BIGINT AS g, round(1 / f.k * (1 - 1 / f.k) * w * 16777216)::BIGINT AS h FROM w, n, f),
a0 AS (SELECT id, c, '' AS path FROM g)"""
    + "".join(
        f""", h{i} AS (SELECT c, path, pos, bin, sum(g)::DOUBLE / 16777216 AS g, sum(h)::DOUBLE / 16777216 AS h, count(*) AS n FROM a{i} JOIN g USING (id, c) JOIN b USING (id) GROUP BY ALL),
c{i} AS (SELECT c, path, pos, bin, sum(g) OVER l AS gl, sum(h) OVER l AS hl, sum(n) OVER l AS nl, sum(g) OVER q AS ga, sum(h) OVER q AS ha, sum(n) OVER q AS na FROM h{i}
  WINDOW q AS (PARTITION BY c, path, pos), l AS (PARTITION BY c, path, pos ORDER BY bin)),
o{i} AS (SELECT *, round(gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1), 9) AS gain FROM c{i} WHERE nl < na AND hl >= 1 AND ha - hl >= 1),
s{i} AS (SELECT c, path, pos, bin, nl, na - nl AS nr, lo + (hi - lo) * (bin + 1) / 16 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY c, path ORDER BY gain DESC, pos, bin) AS rn FROM o{i} WHERE gain > 0) JOIN u USING (pos) WHERE rn = 1),
a{i + 1} AS (SELECT a.id, a.c, a.path || CASE WHEN b.bin <= s.bin THEN 'L' ELSE 'R' END AS path FROM a{i} a JOIN s{i} s USING (c, path) JOIN b ON b.id = a.id AND b.pos = s.pos)"""
        for i in (0, 1)
    )
    + " SELECT c::INT AS class, path, pos::INT AS feature, round(cut, 9) AS cut, nl::BIGINT AS n_left, nr::BIGINT AS n_right FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1)"
)


@query(FIRST_SQL)
def boost_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits of the first round's trees, one tree a class, two levels deep."""
    d = data(spark, sf_dir)
    model = trees.fit_boosted(d, trees.Boosting(rounds=1, leaves=4, depth=2, bins=16), cuts=trees.width_cuts(trees.usable(d, 64), 16))
    rows = [(int(model.classes[k]), path, t.feature[n], round(t.cut[n], 9), int(t.cover[t.left[n]]), int(t.cover[t.right[n]])) for k, t in enumerate(model.trees[0]) for path, n in _paths(t)]
    return spark.createDataFrame(rows, SPLITS)


def _place(*key: str) -> str:
    return f"CAST('0x' || substr(md5({" || '|' || ".join(key)}), 1, 15) AS BIGINT) / 1152921504606846976.0"


FOREST_SQL = (
    E_SQL
    + """, t AS (SELECT id, y FROM r WHERE y IS NOT NULL), f AS (SELECT count(DISTINCT y) AS k, count(*) AS n FROM t), w AS (SELECT y, f.n / (f.k * count(*)) AS w FROM t, f GROUP BY y, f.n, f.k),
a0 AS (SELECT id, y, k AS tree, '' AS path, 0 AS node FROM t, (SELECT unnest(range(0, 5)) AS k))"""
    + "".join(
        f""", d{i} AS (SELECT tree, path, node FROM a{i} GROUP BY ALL HAVING count(DISTINCT y) > 1),
m{i} AS (SELECT *, row_number() OVER (PARTITION BY tree, path ORDER BY q, pos) - 1 AS j FROM (SELECT d{i}.*, p AS pos, {_place("'42|feature'", "tree", "node", "p")} AS q FROM d{i}, (SELECT unnest(range(0, 64)) AS p))),
x{i} AS (SELECT a.*, m.pos, m.j, e.v FROM a{i} a JOIN m{i} m USING (tree, path, node) JOIN e ON e.id = a.id AND e.pos = m.pos WHERE m.j < 8),
u{i} AS (SELECT tree, path, node, pos, j, greatest(min(v) + (max(v) - min(v)) * ({_place("'42|cut'", "tree", "node", "pos")}), nextafter(min(v), 'infinity'::DOUBLE)) AS cut FROM x{i} GROUP BY tree, path, node, pos, j HAVING min(v) < max(v)),
k{i} AS (SELECT tree, path, node, x.pos, u.j, cut, y, count(*) FILTER (v < cut) AS l, count(*) FILTER (v >= cut) AS r FROM x{i} x JOIN u{i} u USING (tree, path, node, pos) GROUP BY ALL),
s{i} AS (SELECT tree, path, node, pos, j, cut, sum(l) AS nl, sum(r) AS nr, round(sum(w * l * w * l) / sum(w * l) + sum(w * r * w * r) / sum(w * r), 9) AS pure FROM k{i} JOIN w USING (y) GROUP BY ALL),
b{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, path ORDER BY pure DESC, j) AS rn FROM s{i} WHERE nl > 0 AND nr > 0) WHERE rn = 1),
a{i + 1} AS (SELECT a.id, a.y, a.tree, a.path || CASE WHEN v < cut THEN 'L' ELSE 'R' END AS path, CASE WHEN v < cut THEN 1 ELSE 2 END AS node FROM a{i} a JOIN b{i} b USING (tree, path, node) JOIN e ON e.id = a.id AND e.pos = b.pos)"""
        for i in (0, 1)
    )
    + " SELECT tree::INT AS tree, path, pos::INT AS feature, round(cut, 9) AS cut, nl::BIGINT AS n_left, nr::BIGINT AS n_right FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1)"
)


@query(FOREST_SQL)
def extra_tree_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits of five randomised trees, two levels deep."""
    grown = forests.fit_forest(data(spark, sf_dir), forests.Forest(trees=5, depth=2))
    rows = [(k, path, t.feature[n], round(t.cut[n], 9), int(t.cover[t.left[n]]), int(t.cover[t.right[n]])) for k, (t,) in enumerate(grown.trees) for path, n in _paths(t)]
    return spark.createDataFrame(rows, SPLITS.replace("class", "tree"))


@query()
def adaptive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters proposed by what did well on fold 1, the chosen ones scored on fold 0, which has no say. Test: reproducible, finds a planted optimum in fewer trials than a grid."""
    role = F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train")
    return search.searched_centroids(labelled(spark, sf_dir), role)
