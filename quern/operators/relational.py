"""Relational operators: lookups, dedup, group ids, contradictions, splits, assembly, imputation."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import parse
from quern.operators.order import order_statistics, quantiles, ranked
from quern.operators.protocol import even_places, hash_place
from quern.sources.scratch import save


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """``value`` of the dimension by ``key``, ``default`` where it has none. Spark broadcasts the dimension if it is small enough."""
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def cascade(df: DataFrame, steps: list[tuple[DataFrame, str]], value: str, default: Column, known: str) -> DataFrame:
    """First value that one of several (dimension, key) lookups finds, else ``default``; ``known`` is 1 only for the first."""
    found = []
    for i, (dim, key) in enumerate(steps):
        name = f"__v{i}"
        df = df.join(dim.select(key, F.col(value).alias(name)), key, "left")
        found.append(name)
    return df.withColumn(value, F.coalesce(*found, default)).withColumn(known, F.col(found[0]).isNotNull().cast("int")).drop(*found)


def fuzzy_lookup(df: DataFrame, name: str, entries: list[tuple[str, float]], aliases: dict[str, str], value: str, default: float) -> DataFrame:
    """``value`` by an ordered, fixed list: the entry of the normalised name's alias, else the first entry that contains the name or is contained in it.

    Decided once for each distinct name, which is joined back.
    """
    s = F.col("__s")
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in entries for x in kv]), s)
    near = F.lit(None).cast("double")
    for key, v in reversed(entries):
        near = F.when(s.contains(key) | F.lit(key).contains(s), F.lit(v)).otherwise(near)
    names = df.select(name).distinct().withColumn("__s", parse.normalised(F.col(name), aliases))
    found = names.select(F.col(name).alias("__name"), F.coalesce(exact, near, F.lit(default)).alias(value))
    return df.join(found, F.col(name).eqNullSafe(F.col("__name")), "left").drop("__name")


def attach(df: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """``df`` with the metadata of its key; a key without metadata, or with several rows of it, is an error."""
    meta = metadata.groupBy(key).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in metadata.columns if c != key])
    wrong = F.raise_error(F.concat(F.lit(f"no single metadata row for {key} "), F.col(key).cast("string")))
    return df.join(meta, key, "left").where(F.when(F.col("__n") == 1, True).otherwise(wrong.cast("boolean"))).drop("__n")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the smallest ``order``, ties by the rest: a partial aggregate, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__m"))
    return best.select(*keys, "__m.*").select(*df.columns)


def group_ids(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys with ids 0, 1, ... in their order."""
    return ranked(df.select(key).distinct(), [key], "group_id")


def contradictions(df: DataFrame, key: str, condition: str, label: str) -> DataFrame:
    """Distinct (key, condition) → type: A if labels differ under one condition, B if they differ over the key only, else none.

    min <> max stands for "more than one label": it aggregates partially, unlike a collected set.
    """
    cells = df.groupBy(key, condition).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    keys = cells.groupBy(key).agg(F.min("lo").alias("key_lo"), F.max("hi").alias("key_hi"))
    kind = F.when(F.col("lo") != F.col("hi"), "A").when(F.col("key_lo") != F.col("key_hi"), "B").otherwise("none")
    return cells.join(keys, key).select(key, condition, kind.alias("kind"))


def temporal_split(df: DataFrame, row_id: str, year: Column, cutoffs: list[tuple[int, int, int]]) -> DataFrame:
    """Expanding windows: years up to the 1st cutoff train, from there to the 2nd val, from the 3rd on test.

    Each cutoff is (last train year, last val year, first test year). A fold with an empty part is dropped.
    Cutoffs are a literal array: no join.
    """
    folds = F.array(*[F.struct(F.lit(f"tscv_fold{i}").alias("split_name"), *[F.lit(x).alias(n) for n, x in zip("abc", c, strict=True)]) for i, c in enumerate(cutoffs, 1)])
    y = df.select(F.col(row_id).alias("row_id"), year.alias("__y"), F.explode(folds).alias("f"))
    role = F.when(F.col("__y") <= F.col("f.a"), "train").when(F.col("__y") <= F.col("f.b"), "val").when(F.col("__y") >= F.col("f.c"), "test")
    out = y.select(F.col("f.split_name").alias("split_name"), "row_id", role.alias("role")).where("role IS NOT NULL")
    full = out.groupBy("split_name").agg(F.count_distinct("role").alias("n")).where("n = 3").select("split_name")
    return out.join(full, "split_name", "left_semi")


def group_split(df: DataFrame, row_id: str, group: str, seeds: list[int], test: float = 0.2, val: float = 0.125, name: str = "grouped_seed") -> DataFrame:
    """Of each seed whole groups to test, val (a share of the rest) or train by the hash of (seed, group).

    No sort, no shuffle, one scan for all seeds, the same for every run. A scaffold split is the same over
    scaffolds, with a val of 0.15 / 0.8.
    """
    seed = F.col("__seed")
    place = F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), F.coalesce(F.col("group").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    role = F.when(place < test, "test").when(place < test + (1 - test) * val, "val").otherwise("train")
    rows = df.select(F.col(row_id).alias("row_id"), F.col(group).alias("group"), F.explode(F.array(*map(F.lit, seeds))).alias("__seed"))
    return rows.select(F.concat(F.lit(name), seed).alias("split_name"), "row_id", "group", role.alias("role"))


def exact_group_split(df: DataFrame, row_id: str, group: str, seeds: list[int], test: str = "1/5", val: str = "1/8", name: str = "exact_seed") -> DataFrame:
    """As ``group_split``, with exact shares of groups: of each seed's hashed order of the groups the first ceil(test n) test, the next ceil(val m) of the m others val.

    Where the order is cut is looked up for all seeds in the same passes over the groups (exact order statistics),
    none of them is sorted; a row's role follows from its own group's place: the rows take part in one scan and no
    join. Null groups are one group, the empty one. Groups at the same place (60 bits) would share a role.
    """
    key = F.coalesce(F.col(group).cast("string"), F.lit(""))
    groups = save(df.select(key.alias("__g")).distinct().select(*[hash_place(F.lit(s), F.col("__g")).alias(f"p{s}") for s in seeds]), "groups")
    first = lambda n: math.ceil(n * Fraction(test))
    second = lambda n: first(n) + math.ceil((n - first(n)) * Fraction(val))
    cuts = order_statistics(groups, [(f"p{s}", up) for s in seeds for up in (first, second)], even_places)
    above = [F.lit(2**60 if c is None else c) for c in cuts]  # None: no group lies beyond
    splits = [F.struct(F.lit(f"{name}{s}").alias("split_name"), hash_place(F.lit(s), key).alias("p"), above[2 * i].alias("a"), above[2 * i + 1].alias("b")) for i, s in enumerate(seeds)]
    rows = df.select(F.col(row_id).alias("row_id"), F.col(group).alias("group"), F.explode(F.array(*splits)).alias("s"))
    role = F.when(F.col("s.p") < F.col("s.a"), "test").when(F.col("s.p") < F.col("s.b"), "val").otherwise("train")
    return rows.select(F.col("s.split_name").alias("split_name"), "row_id", "group", role.alias("role"))


def split_report(splits: DataFrame) -> DataFrame:
    """Of each split: rows, rows in more than one role, groups in both train and test."""
    rows = splits.groupBy("split_name", "row_id").agg(F.count_distinct("role").alias("roles")).groupBy("split_name").agg(F.count("*").alias("n_rows"), F.sum((F.col("roles") > 1).cast("long")).alias("overlapping"))
    groups = splits.groupBy("split_name", "group").agg(F.max((F.col("role") == "train").cast("int")).alias("a"), F.max((F.col("role") == "test").cast("int")).alias("b"))
    return rows.join(groups.groupBy("split_name").agg(F.sum(F.col("a") * F.col("b")).cast("long").alias("shared_groups")), "split_name")


def verify_split(splits: DataFrame, check_groups: bool = True) -> None:
    """Raises where roles overlap, or groups are shared between train and test."""
    for r in split_report(splits).collect():
        if r["overlapping"] or check_groups and r["shared_groups"]:
            raise ValueError(f"{r['split_name']}: {r['overlapping']} rows overlap, {r['shared_groups']} groups are shared")


def sequential_folds(df: DataFrame, row_id: str, k: int) -> DataFrame:
    """Row-order folds: row ids cut into k + 1 equal parts (by exact quantiles), part i tests fold i, earlier parts train it."""
    cuts = [x for x in quantiles(df, [(row_id, i / (k + 1)) for i in range(1, k + 1)]) if x is not None]
    part = sum(((F.col(row_id) > x).cast("int") for x in cuts), F.lit(0))
    parts = df.select(F.col(row_id).alias("row_id"), part.alias("part"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold")).where(F.col("part") <= F.col("fold"))
    return parts.select(F.concat(F.lit("fold"), "fold").alias("split_name"), "row_id", F.when(F.col("part") == F.col("fold"), "test").otherwise("train").alias("role"))


def validation_tail(df: DataFrame, row_id: str, share: int = 10) -> DataFrame:
    """row_id, role: the last 1 / ``share`` of the (unique) row ids, one at least, validate; the rest train."""
    (cut,) = order_statistics(df, [(row_id, lambda n: n - max(1, n // share))])
    return df.select(F.col(row_id).alias("row_id"), F.when(F.col(row_id) >= F.lit(cut), "val").otherwise("train").alias("role"))


def assemble(blocks: list[DataFrame], row_id: str) -> DataFrame:
    """Feature blocks side by side, joined by row id.

    A column name in two blocks is an error at once. A row that a block lacks or has twice is an error when
    the result is computed: rows are joined in full, so none gets lost.
    """
    names = [c for b in blocks for c in b.columns if c != row_id]
    if len(names) != len(set(names)):
        raise ValueError(f"columns in more than one block: {sorted({c for c in names if names.count(c) > 1})}")
    marks = [f"__in{i}" for i in range(len(blocks))]
    out = reduce(lambda a, b: a.join(b, row_id, "full"), [b.withColumn(m, F.lit(1)) for b, m in zip(blocks, marks, strict=True)])
    out = out.withColumn("__rows", F.count("*").over(W.partitionBy(row_id)))
    sound = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in marks]) & (F.col("__rows") == 1)
    wrong = F.raise_error(F.concat(F.lit(f"not one row in every block for {row_id} "), F.coalesce(F.col(row_id).cast("string"), F.lit("null"))))
    return out.where(F.when(sound, True).otherwise(wrong.cast("boolean"))).select(row_id, *names)


def select_prefixes(df: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), always: tuple[str, ...] = ()) -> DataFrame:
    """Columns by prefix; nothing selected is an error."""
    cols = [c for c in df.columns if (not include or c.startswith(include)) and not (exclude and c.startswith(exclude)) and c not in always]
    if not cols:
        raise ValueError("no column has such a prefix")
    return df.select(*always, *cols)


def supported(df: DataFrame, by: list[str], label: str, rows: int = 20, classes: int = 2) -> DataFrame:
    """Groups with at least so many rows and labels: what is worth fitting or scoring."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(label).alias("classes")).where((F.col("n") >= rows) & (F.col("classes") >= classes))


def masked(splits: DataFrame, rows: DataFrame, masks: list[str], row_id: str = "row_id") -> DataFrame:
    """Split rows whose row passes every mask (a boolean column of ``rows``); null is false."""
    keep = reduce(lambda a, b: a & b, [F.coalesce(F.col(m), F.lit(False)) for m in masks])
    return splits.join(rows.where(keep).select(row_id), row_id, "left_semi")


def flags(c: Column, sets: dict[str, tuple[str, ...]]) -> list[Column]:
    """A 0/1 column for each named set: whether the value is in it; null is in none."""
    return [F.coalesce(c.isin(*members).cast("int"), F.lit(0)).alias(name) for name, members in sets.items()]


def prefixed(df: DataFrame, prefix: str, but: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in but})


def best_of(df: DataFrame, group: list[str], tiers: list[Column], then: list[Column]) -> DataFrame:
    """The row of each group that meets the first of the ``tiers`` met by any, among those the least of ``then``.

    Rows that meet no tier come last. An aggregate over (tier, then, row): a hot group costs one row a task.
    """
    tier = F.lit(len(tiers))
    for i, t in reversed(list(enumerate(tiers))):
        tier = F.when(F.coalesce(t, F.lit(False)), F.lit(i)).otherwise(tier)
    rest = [c for c in df.columns if c not in group]
    order = F.struct(tier.alias("tier"), *[c.alias(f"t{i}") for i, c in enumerate(then)], F.struct(*rest).alias("row"))
    best = df.groupBy(*group).agg(F.min(order).alias("m"))
    return best.select(*group, "m.row.*", F.col("m.tier").alias("tier"))


def softmax(df: DataFrame, group: list[str], score: str, temperature: float = 1.0) -> DataFrame:
    """Adds ``share``: exp(score / t) normed to 1 in each group, shifted by the group's largest."""
    w = W.partitionBy(*group)
    scaled = F.col(score) / max(temperature, 0.1)
    e = df.withColumn("__e", F.exp(scaled - F.max(scaled).over(w)))
    return e.withColumn("share", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def one_hot(c: Column, values: list[str], prefix: str) -> list[Column]:
    return [F.coalesce((c == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values]


def median_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls become their column's exact median, 0 where all are null."""
    medians = dict(zip(cols, quantiles(df, [(c, 0.5) for c in cols]), strict=True))
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c] or 0.0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def row_nulls(df: DataFrame, row_id: str, cols: list[str]) -> DataFrame:
    """row_id, n_null: how many of the columns are null in each row."""
    return df.select(row_id, sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)).alias("n_null"))


def null_counts(df: DataFrame) -> DataFrame:
    """column, n_null: one pass."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in df.columns])).alias("s")).select("s.*")


def group_importance(df: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Of each prefix group: columns, sum and mean of absolute values."""
    out = []
    for g, prefixes in groups.items():
        cols = [c for c in df.columns if c.startswith(prefixes)]
        out.append(F.struct(F.lit(g).alias("group"), F.lit(len(cols)).cast("long").alias("n_columns"), reduce(lambda a, b: a + b, [F.sum(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))) for c in cols]).alias("total"), F.count("*").alias("n")))
    s = df.agg(F.array(*out).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return s.select("group", "n_columns", "total", (F.col("total") / (F.col("n") * F.col("n_columns"))).alias("mean"))
