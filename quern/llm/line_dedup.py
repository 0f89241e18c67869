"""Line dedup by overlapping three-line windows, in DataFrame functions.

Every three consecutive lines of a document form a window. Windows are hashed (128 bits stand for the
three lines) and counted over the whole corpus; of a repeated window, the occurrence with the smallest
(doc_id, line) is kept. Lines that later occurrences cover are merged and removed, except lines that also
belong to the kept occurrence of some repeated window: so every repeated window stays whole once.

Defined results: null text gives null text and 0 lines; a document of fewer than three lines has no
window and stays as it is; documents that lose all lines keep an empty text; rows with equal doc_id
and text are one document to this operator (each gets the same result); an empty table gives no rows.
Extra columns pass through; ``__n_lines`` and ``__n_removed`` are added under names that are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.work import free, save

WINDOW = 3


def removed_lines(df: DataFrame) -> DataFrame:
    """__id, __text_hash → ``__drop``: the sorted line positions to remove; only rows that lose some."""
    lines = df.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text_hash"), F.split("text", "\n").alias("__l"))
    lines = lines.where(F.size("__l") >= WINDOW)
    window = lambda i: F.slice("__l", i + 1, WINDOW)
    hashes = F.transform(F.sequence(F.lit(0), F.size("__l") - WINDOW), lambda i: F.struct(F.xxhash64(window(i)).alias("h"), F.xxhash64(F.lit(1), window(i)).alias("g")))
    windows = lines.select("__id", "__text_hash", F.posexplode(hashes).alias("pos", "w")).select("__id", "__text_hash", "pos", "w.h", "w.g")
    windows = save(windows, "windows").distinct()
    first = F.struct(F.coalesce(F.col("__id"), F.lit(2**63 - 1)).alias("d"), F.col("__text_hash").alias("t"), F.col("pos").alias("p"))
    repeated = windows.groupBy("h", "g").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first")
    seen = windows.join(repeated, ["h", "g"]).withColumn("kept", first == F.col("first"))
    places = seen.groupBy("__id", "__text_hash").agg(F.collect_list(F.when(~F.col("kept"), F.col("pos"))).alias("later"), F.collect_list(F.when(F.col("kept"), F.col("pos"))).alias("firsts"))
    drop = F.array_sort(F.array_except(_covered("later"), _covered("firsts")))
    return places.select("__id", "__text_hash", drop.alias("__drop")).where(F.size("__drop") > 0)


def _covered(positions: str) -> Column:
    """All lines that windows at these positions cover."""
    return F.array_distinct(F.flatten(F.transform(F.col(positions), lambda p: F.sequence(p, p + (WINDOW - 1)))))


def without(lines: Column, drop: Column) -> Column:
    """``lines`` without the positions in ``drop`` (sorted): the runs between them, one slice each."""
    bounds = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    runs = F.arrays_zip(F.slice(bounds, F.lit(1), F.size(bounds) - 1).alias("a"), F.slice(bounds, F.lit(2), F.size(bounds) - 1).alias("b"))
    return F.flatten(F.transform(runs, lambda r: F.slice(lines, r["a"] + 2, r["b"] - r["a"] - 1)))


def dedup_lines(df: DataFrame) -> DataFrame:
    """``df`` with repeated lines gone from ``text``, plus __n_lines and __n_removed."""
    drop, own = removed_lines(df), free(df, "__th")
    d = df.withColumn(own, F.xxhash64("text"))
    names = {x: free(d, x) for x in ("__id", "__text_hash", "__drop", "__l")}
    drop = drop.withColumnsRenamed(names)
    out = d.join(drop, d["doc_id"].eqNullSafe(drop[names["__id"]]) & (d[own] == drop[names["__text_hash"]]), "left")
    # the lines are a column of their own, so that they are split once a row and not once a run
    out = out.withColumn(names["__l"], F.split("text", "\n"))
    gone, lines = F.col(names["__drop"]), F.col(names["__l"])
    return out.select(
        *[F.col(f"`{c}`") if c != "text" else F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(without(lines, gone), "\n")).alias("text") for c in df.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(free(df, "__n_lines")),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(free(df, "__n_removed")),
    )


def new_length(df: DataFrame, removed: str = "__n_removed") -> Column:
    """n_chars in code points where lines were removed, as it was elsewhere."""
    return F.when(F.col(removed) > 0, F.length("text").cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))


#: DuckDB SQL for the columns of the query.
LINES_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM d),
w AS (SELECT doc_id, text, p, ls[p + 1 : p + 3] AS w FROM l, unnest(range(0, greatest(len(ls) - 2, 0))) AS u(p)),
r AS (SELECT w, min({'d': doc_id, 'p': p}) AS f FROM w GROUP BY w HAVING count(*) > 1),
o AS (SELECT w.doc_id, w.text, w.p, ({'d': w.doc_id, 'p': w.p} = r.f) AS kept FROM w JOIN r ON w.w = r.w),
c AS (SELECT doc_id, text, p + j AS line, bool_or(kept) AS safe FROM o, unnest([0, 1, 2]) AS v(j) GROUP BY ALL),
x AS (SELECT doc_id, text, list(line) AS gone FROM c WHERE NOT safe GROUP BY doc_id, text)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN 0 ELSE len(string_split(t.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(len(x.gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN x.gone IS NULL THEN coalesce(t.text, '') ELSE
         array_to_string([y FOR y, i IN string_split(t.text, chr(10)) IF NOT list_contains(x.gone, i - 1)], chr(10)) END) AS clean_sha256
FROM documents t LEFT JOIN x ON t.doc_id IS NOT DISTINCT FROM x.doc_id AND t.text = x.text
"""
