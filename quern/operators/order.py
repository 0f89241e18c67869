"""Exact order statistics, quantiles and ranks without a sort into one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import save

#: Values of a bracket that come to the driver; accuracy of the sketch that narrows a bracket.
FEW, ACCURACY = 50_000, 10_000


def order_statistics(df: DataFrame, wanted: list[tuple[str, Callable[[int], int]]], guess: Callable[[int, int], tuple] | None = None) -> list:
    """Of each (column, n → rank) the value at that rank (from 0) of the column's n non-null values; None for a rank outside.

    ``guess``: (rank, n) → a first bracket, for columns whose distribution is known; a wrong one costs a pass.

    A quantile sketch brackets each value, counts check the bracket, and so on until a bracket holds at most
    ``FEW`` rows or one value: each round is one pass for all that is wanted, and narrows a bracket some
    thousandfold. Only the last bracket's value counts come to the driver.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted))
    sizes = dict(zip(columns, df.agg(*[F.count(c) for c in columns]).first(), strict=True))
    state = [{"column": c, "rank": rank(sizes[c]), "lo": None, "hi": None, "below": 0, "inside": sizes[c], "spread": 2.0 / ACCURACY} for c, rank in wanted]
    out = [None] * len(wanted)
    open_ = [i for i, s in enumerate(state) if 0 <= s["rank"] < s["inside"]]

    def within(s: dict):
        c = F.col(s["column"])
        return c.isNotNull() if s["lo"] is None else c.between(F.lit(s["lo"]), F.lit(s["hi"]))

    def narrow(asked: list[int], brackets: list[tuple]) -> None:
        """Counts the brackets and takes over those that hold their rank; the others widen."""
        counts = []
        for i, (lo, hi) in zip(asked, brackets, strict=True):
            c = F.col(state[i]["column"])
            counts += [F.count_if(c < F.lit(lo)).alias(f"l{i}"), F.count_if(c.between(F.lit(lo), F.lit(hi))).alias(f"n{i}")]
        got = df.agg(*counts).first()
        for j, (i, (lo, hi)) in enumerate(zip(asked, brackets, strict=True)):
            s, below, inside = state[i], got[2 * j], got[2 * j + 1]
            if below <= s["rank"] < below + inside:
                s.update(lo=lo, hi=hi, below=below, inside=inside)
            else:
                s["spread"] *= 4

    def wide() -> list[int]:
        return [i for i in open_ if state[i]["inside"] > FEW and not (state[i]["lo"] is not None and state[i]["lo"] == state[i]["hi"])]

    if guess is not None and (asked := wide()):
        narrow(asked, [guess(state[i]["rank"], state[i]["inside"]) for i in asked])
    while asked := wide():
        sketches = []
        for i in asked:
            s = state[i]
            at = (s["rank"] - s["below"] + 0.5) / s["inside"]
            ends = [max(0.0, at - s["spread"]), min(1.0, at + s["spread"])]
            sketches.append(F.percentile_approx(F.when(within(s), F.col(s["column"])), ends, ACCURACY).alias(f"b{i}"))
        narrow(asked, list(df.agg(*sketches).first()))
    last: dict[str, list[int]] = {}
    for i in open_:
        if state[i]["lo"] is not None and state[i]["lo"] == state[i]["hi"]:
            out[i] = state[i]["lo"]
        else:
            last.setdefault(df.schema[state[i]["column"]].dataType.simpleString(), []).append(i)
    for asks in last.values():
        # one pass for all brackets of a type
        each = F.array(*[F.when(within(state[i]), F.struct(F.lit(i).alias("i"), F.col(state[i]["column"]).alias("value"))) for i in asks])
        counts = df.select(F.explode(each).alias("s")).where("s IS NOT NULL").groupBy("s.i", "s.value").count()
        at = {i: state[i]["below"] for i in asks}
        for i, value, n in sorted(tuple(r) for r in counts.collect()):
            if at[i] <= state[i]["rank"] < at[i] + n:
                out[i] = value
            at[i] += n
    return out


def quantiles(df: DataFrame, asks: list[tuple[str, float]]) -> list[float | None]:
    """Exact quantiles of columns, between two values by linear interpolation; None for a column without values."""
    sizes: dict[tuple[str, float], int] = {}

    def rank(c: str, q: float, up: int) -> Callable[[int], int]:
        def of(n: int) -> int:
            sizes[c, q] = n
            return min(int((n - 1) * q) + up, n - 1)

        return of

    got = order_statistics(df, [(c, rank(c, q, up)) for c, q in asks for up in (0, 1)])
    out = []
    for (c, q), lo, hi in zip(asks, got[::2], got[1::2], strict=True):
        part = (sizes[c, q] - 1) * q % 1
        out.append(None if lo is None else float(lo) + (float(hi) - float(lo)) * part)
    return out


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place 0, 1, ... in the order of ``by``, ties as they come.

    Rows are range-partitioned and sorted, each partition's rows counted, and the counts before it added:
    the only window runs over one row a partition. Written out first, so that places and counts agree.
    """
    place = F.monotonically_increasing_id()
    rows = save(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()).withColumn("__place", place.bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    counts = sorted(tuple(r) for r in rows.groupBy("__part").count().collect())  # one row a partition
    offsets, before = {}, 0
    for part, n in counts:
        offsets[part] = before
        before += n
    if not offsets:
        return rows.withColumn(name, F.col("__place")).drop("__part", "__place")
    table = df.sparkSession.createDataFrame(list(offsets.items()), "__part int, __before long")
    return rows.join(F.broadcast(table), "__part").withColumn(name, F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")
