"""Model protocols as tables: out-of-fold scoring, comparison, honest subsets, null and permutation importance, ablation, gates.

The model is the nearest class centroid: its fit is one aggregate, its prediction a comparison with a row for
each class, so every protocol stays declarative. Rows are (id, y, x array<double>); ``id`` is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import squared_distance
from quern.operators import metrics as M
from quern.operators.order import order_statistics, ranked
from quern.sources.scratch import save

#: Classes that predictions compare with: the bound of a broadcast.
MOST_CLASSES = 10_000


def centroids(train: DataFrame, by: list[str] = [], components: list[int] | None = None) -> DataFrame:  # noqa: B006
    """by, y, c: each class's mean vector, of the given components only."""
    parts = train.select(*by, "y", F.posexplode("x").alias("pos", "v"))
    if components is not None:
        parts = parts.where(F.col("pos").isin(components))
    means = parts.groupBy(*by, "y", "pos").agg(F.avg("v").alias("m"))
    return means.groupBy(*by, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))


def take(x: str, components: list[int] | None) -> Column:
    return F.col(x) if components is None else F.array(*[F.get(x, F.lit(i)) for i in components])


def predict(test: DataFrame, centres: DataFrame, by: list[str] = [], components: list[int] | None = None) -> DataFrame:  # noqa: B006
    """``test`` with y_pred: the class of the nearest centroid, ties to the smallest class.

    A group's centroids, their number checked, are broadcast as one row: each test row is judged in place, none is shuffled.
    """
    n = centres.limit(MOST_CLASSES + 1).count()
    if n > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    each = centres.groupBy(*by).agg(F.collect_list(F.struct(F.col("y").alias("k"), "c")).alias("__cs")).where(F.size("__cs") > 0)
    pairs = test.join(F.broadcast(each), by) if by else test.crossJoin(F.broadcast(each))  # one row
    x = take("x", components)
    near = F.array_min(F.transform("__cs", lambda s: F.struct(squared_distance(x, s["c"]).alias("d"), s["k"].alias("k"))))
    return pairs.select(*test.columns, near["k"].alias("y_pred"))


def scored(p: DataFrame, by: list[str]) -> DataFrame:
    """Balanced accuracy, Matthews correlation and rows of each group of predictions (y, y_pred)."""
    t = p.withColumnsRenamed({"y": "y_true"})
    return M.balanced_accuracy(t, by).join(M.mcc(t, by), by).join(t.groupBy(*by).agg(F.count("*").alias("n_test")), by)


def compared(data: DataFrame, splits: DataFrame, models: dict[str, list[int] | None], least: tuple[int, int] = (10, 3)) -> DataFrame:
    """Each model (a name and its components; ``majority`` needs none) fitted on each split's train rows and scored on its test rows.

    Splits with fewer than ``least`` train or test rows are left out. ``splits``: split_name, row_id, role.
    """
    rows = splits.join(data.withColumnRenamed("id", "row_id"), "row_id")
    sizes = rows.groupBy("split_name").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))
    sizes = sizes.where((F.col("n_train") >= least[0]) & (F.col("n_test") >= least[1]))
    rows = save(rows.join(sizes.select("split_name", "n_train"), "split_name"), "compared")
    train = rows.where("role = 'train'")
    test = rows.where("role = 'test'").select(F.concat_ws("|", "split_name", "row_id").alias("id"), "split_name", "n_train", "y", "x")
    out = None
    for name, components in models.items():
        if name == "majority":
            p = test.join(M.majority_class(train, ["split_name"], "y"), "split_name").withColumnRenamed("majority", "y_pred")
        else:
            p = predict(test, centroids(train, ["split_name"], components), ["split_name"], components)
        part = p.select(F.lit(name).alias("model"), "split_name", "n_train", "y", "y_pred")
        out = part if out is None else out.unionByName(part)
    return scored(save(out, "predictions"), ["model", "split_name", "n_train"])


def honest(p: DataFrame, gold: Column, least: int = 5) -> DataFrame:
    """One model's predictions scored on all rows, on gold ones and on the others; a subset with fewer than ``least`` rows is left out."""
    subset = F.explode(F.array(F.lit("full"), F.when(gold, "gold").otherwise("nongold"))).alias("subset")
    return scored(p.select(subset, "y", "y_pred"), ["subset"]).where(F.col("n_test") >= least)


def subset_models(data: DataFrame, subset: str, test: Column, least: int = 20) -> DataFrame:
    """A model of its own for each subset of at least ``least`` rows, scored on the subset's test rows."""
    big = data.groupBy(subset).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(subset)
    rows = data.join(big, subset).withColumn("__test", test)
    return scored(predict(rows.where("__test"), centroids(rows.where("NOT __test"), [subset]), [subset]), [subset])


def out_of_fold(data: DataFrame, fold: str) -> DataFrame:
    """id, y, fold, y_pred, margin: each row judged by the centroids of the other folds' rows.

    Sums of each (fold, class, component) are made once; a fold's centroids are all sums less its own.
    ``margin``: by how much the nearest centroid is nearer than the next.
    """
    parts = data.select(F.col(fold).alias("fold"), "y", F.posexplode("x").alias("pos", "v")).groupBy("fold", "y", "pos").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    folds = parts.select("fold").distinct()
    others = folds.withColumnRenamed("fold", "held").join(parts, F.col("held") != F.col("fold")).groupBy("held", "y", "pos").agg((F.sum("s") / F.sum("n")).alias("m"))
    centres = others.groupBy("held", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    pairs = data.withColumnRenamed(fold, "held").join(centres.withColumnRenamed("y", "__y"), "held")
    near = F.array_sort(F.collect_list(F.struct(F.sqrt(squared_distance(F.col("x"), F.col("c"))).alias("d"), "__y")))
    best = pairs.groupBy("id").agg(F.first("y").alias("y"), F.first("held").alias("fold"), near.alias("m"))
    margin = F.coalesce(F.get("m", F.lit(1))["d"] - F.get("m", F.lit(0))["d"], F.lit(0.0))
    return best.select("id", "y", "fold", F.get("m", F.lit(0))["__y"].alias("y_pred"), margin.alias("margin"))


def hash_place(seed: Column, key: Column) -> Column:
    """A place in a random order of the keys: 60 bits of a digest, so that other engines can follow."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), key.cast("string"))), 1, 15), 16, 10).cast("long")


def even_places(rank: int, n: int) -> tuple[int, int]:
    """Where the place of a rank lies among n even ones, give or take six standard deviations."""
    p = rank / n
    off = 6 * (p * (1 - p) / n) ** 0.5 + 6 / n
    return int(max(0.0, p - off) * 2**60), int(min(1.0, p + off) * 2**60)


def shuffled_labels(data: DataFrame, key: str, label: str, seeds: list[int]) -> DataFrame:
    """Rows of ``data`` for each seed with ``null_label``: the labels dealt anew in the random order of the keys.

    The label that sorts first goes to as many first places as it has rows, and so on: only the places at
    the cuts are looked up (exact order statistics), no row is moved. Few labels.
    """
    counts = sorted((r[label], r["count"]) for r in data.where(F.col(label).isNotNull()).groupBy(label).count().collect())
    cuts, n = [], 0
    for _, c in counts[:-1]:
        n += c
        cuts.append(n)
    places = save(data.where(F.col(label).isNotNull()).select("*", *[hash_place(F.lit(s), F.col(key)).alias(f"__p{s}") for s in seeds]), "places")
    at = order_statistics(places, [(f"__p{s}", lambda _, c=c: c) for s in seeds for c in cuts], even_places)
    out = []
    for i, s in enumerate(seeds):
        dealt = F.lit(counts[-1][0])
        for (name, _), cut in reversed(list(zip(counts[:-1], at[i * len(cuts) : (i + 1) * len(cuts)], strict=True))):
            dealt = F.when(F.col(f"__p{s}") < F.lit(cut), F.lit(name)).otherwise(dealt)
        out.append(F.struct(F.lit(s).alias("seed"), dealt.alias("null_label")))
    return places.select(*data.columns, F.explode(F.array(*out)).alias("__s")).select(*data.columns, "__s.*")


def spread_ratio(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """by, pos, importance: of each component the share of its variance that lies between the labels (eta squared)."""
    parts = rows.select(*by, F.col(label).alias("__l"), F.posexplode("x").alias("pos", "v"))
    cells = parts.groupBy(*by, "pos", "__l").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    n, s = F.sum("n"), F.sum("s")
    between, whole = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n, F.sum("q") - s * s / n
    return cells.groupBy(*by, "pos").agg(F.when(whole > 0, between / whole).otherwise(F.lit(0.0)).alias("importance"))


def null_importance(data: DataFrame, seeds: list[int], noise: float = 0.25) -> DataFrame:
    """pos, importance, p_value and the 75th percentile of the null runs; ``noise`` where chance does as well too often."""
    real = spread_ratio(data, [], "y")
    null = spread_ratio(shuffled_labels(data, "id", "y", seeds), ["seed"], "null_label")
    p = M.empirical_p(real, null, "pos", "importance")
    return real.join(p, "pos").withColumn("noise", F.col("p_value") > noise)


def _another(test: DataFrame, seed: int) -> DataFrame:
    """__at, __x: the vectors in the hashed order of the ids."""
    return ranked(test.select("id", hash_place(F.lit(seed), F.col("id")).alias("__p"), F.col("x").alias("__x")), ["__p", "id"], "__at").select("__at", "__x")


def _swapped(components: list[int]) -> Column:
    return F.transform("x", lambda v, i: F.when(i.isin(components), F.get("__x", i)).otherwise(v))


def permuted(test: DataFrame, seed: int, components: list[int]) -> DataFrame:
    """``test`` with the given components taken from another row: the one at the same place in the hashed order.

    Both orders are distributed ranks joined by place.
    """
    return ranked(test, ["id"], "__at").join(_another(test, seed), "__at").withColumn("x", _swapped(components)).drop("__at", "__x")


def permuted_groups(test: DataFrame, seed: int, groups: dict[str, list[int]], own: DataFrame) -> DataFrame:
    """group, id, y, x: ``permuted`` for each group of components by one join; ``own``: ``test`` ranked by id as __at."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("group"), _swapped(c).alias("x")) for name, c in groups.items()]))
    return own.join(_another(test, seed), "__at").select("id", "y", each.alias("__g")).select("__g.group", "id", "y", "__g.x")


def permutation_importance(test: DataFrame, centres: DataFrame, groups: dict[str, list[int]], seeds: list[int], gold: Column) -> DataFrame:
    """group, full_drop, gold_drop: by how much balanced accuracy falls, on the mean over seeds, when a group of components is permuted."""
    own = ranked(test.select("id", "y", "x"), ["id"], "__at")
    rows = test.select(F.lit("").alias("group"), F.lit(-1).alias("seed"), "id", "y", "x")
    for s in seeds:
        rows = rows.unionByName(permuted_groups(test, s, groups, own).withColumn("seed", F.lit(s)))
    judged = predict(rows, centres).select("group", "seed", gold.alias("gold"), F.col("y").alias("y_true"), "y_pred")
    runs = save(judged, "permuted")
    full = M.balanced_accuracy(runs, ["group", "seed"]).withColumnRenamed("bal_acc", "full")
    part = M.balanced_accuracy(runs.where("gold"), ["group", "seed"]).withColumnRenamed("bal_acc", "part")
    means = full.join(part, ["group", "seed"]).groupBy("group").agg(F.avg("full").alias("full"), F.avg("part").alias("part"))
    base = means.where("group = ''").select(F.col("full").alias("b_full"), F.col("part").alias("b_part"))
    out = means.where("group <> ''").crossJoin(F.broadcast(base))  # base is one row
    return out.select("group", (F.col("b_full") - F.col("full")).alias("full_drop"), (F.col("b_part") - F.col("part")).alias("gold_drop"))


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, list[int]], width: int, gold: Column, gate: float = -0.005) -> DataFrame:
    """Each group of components left out in turn: its gold balanced accuracy, the change, and whether the change passes the gate."""
    runs = None
    for name, out in {"": [], **groups}.items():
        kept = [i for i in range(width) if i not in set(out)]
        part = predict(test.where(gold), centroids(train, [], kept), [], kept).select(F.lit(name).alias("group"), F.col("y").alias("y_true"), "y_pred")
        runs = part if runs is None else runs.unionByName(part)
    acc = M.balanced_accuracy(runs, ["group"])
    base = acc.where("group = ''").select(F.col("bal_acc").alias("base_gold"))
    delta = F.col("bal_acc") - F.col("base_gold")
    return acc.where("group <> ''").crossJoin(F.broadcast(base)).select("group", "base_gold", F.col("bal_acc").alias("ablated_gold"), delta.alias("gold_delta"), (delta >= gate).alias("passes"))


def _towards(s: float):
    return lambda c, o: c * (1 - s) + o * s


def searched(train: DataFrame, val: DataFrame, test: DataFrame, shrinkages: list[float]) -> DataFrame:
    """The shrinkage of centroids towards the mean of all, chosen on val (ties to the smaller), and its score on test, which has no say in it."""
    centre = train.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"))
    centre = centre.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("o"))
    cells = centroids(train).crossJoin(F.broadcast(centre))  # one row
    runs = None
    for role, rows in (("val", val), ("test", test)):
        for s in shrinkages:
            shrunk = cells.select("y", F.zip_with("c", "o", _towards(s)).alias("c")) if s else cells.select("y", "c")
            part = predict(rows, shrunk).select(F.lit(role).alias("role"), F.lit(float(s)).alias("shrinkage"), F.col("y").alias("y_true"), "y_pred")
            runs = part if runs is None else runs.unionByName(part)
    acc = M.balanced_accuracy(runs, ["role", "shrinkage"]).groupBy("shrinkage").pivot("role", ["val", "test"]).agg(F.first("bal_acc"))
    best = acc.agg(F.min(F.struct((-F.col("val")).alias("k"), F.col("shrinkage"))).alias("m")).select(F.col("m.shrinkage").alias("best"))
    return acc.crossJoin(F.broadcast(best)).select("shrinkage", "val", "test", (F.col("shrinkage") == F.col("best")).alias("chosen"))
