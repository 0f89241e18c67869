"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the k smallest distinct 64-bit hashes (as signed longs, ascending) of a text's five-word
shingles. Sketches of parts merge into the sketch of the whole; two of them estimate resemblance and
containment, one alone the number of distinct shingles. Sketches of fewer than k shingles are exact.

Defined results: null text counts as empty; the empty text has the empty sketch, which resembles
another empty one with 1 and any other with 0; a text of fewer than five words has one shingle, all of
its words; equal texts have equal sketches, whatever their other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.work import SPACE_CHARS, SPACES

K, SHINGLE = 128, 5
#: Rows of a range of neighbours, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1024, 4096


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Adds array<long> ``name``: the sketch of column ``text``."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE_CHARS))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("__w")
    many = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.col("__w")[i + j] for j in range(shingle)]))
    df = df.withColumn("__h", F.when(n >= shingle, many).when(n > 0, F.array(F.xxhash64("__w"))).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct("__h")), 1, k)).drop("__w", "__h")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _both(a: Column, b: Column, union: Column) -> Column:
    return F.size(F.array_intersect(F.array_intersect(union, a), b))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    u = merge(a, b, k)
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(_both(a, b, u) / F.size(u))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) / the k-th hash's place in the hash range."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has as well, 0 to 1: resemblance times union over a."""
    u = merge(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(u, k) / distinct_count(a, k)))


def to_text(a: Column) -> Column:
    """Base64 of the big-endian hashes."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))), "\r\n", "")


def fingerprints(df: DataFrame, k: int = K) -> DataFrame:
    """Each row's sketch, that of its edited text, and its likeness to the next row, in descending doc_id.

    The edited text swaps the last third for the start of the next row's text. Rows are dealt to
    ranges of doc_id; the first row of a range goes to the range before it as well, and the first of
    all goes to the last range, so each range finds its rows' successors alone and the text moves once.
    Equal doc_ids are ordered by their text's hash; null doc_ids come last. Rows of one doc_id lie in one range.
    """
    n, *_ = df.agg(F.count("*")).first()
    ranges = int(min(MOST_RANGES, max(8, n // RANGE_ROWS)))
    last = F.lit(-(2**63))
    idv = F.coalesce(F.col("doc_id"), last)
    cuts, top = df.agg(F.percentile_approx(idv, [i / ranges for i in range(1, ranges)], 100_000), F.max(idv)).first()
    cuts = sorted(set(cuts or []) - {top})
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    # range r holds cuts[r - 1] < id <= cuts[r]
    place = F.size(F.filter(bounds, lambda c: c < idv))
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_sketch(rows, "text", "fp", k)
    rows = rows.withColumn("__r", place).withColumn(
        "__to",
        F.concat(
            F.array(F.struct(F.col("__r").alias("r"), F.lit(0).alias("ghost"))),
            F.when(F.array_contains(bounds, idv), F.array(F.struct((F.col("__r") + 1).alias("r"), F.lit(1).alias("ghost")))).otherwise(F.array().cast("array<struct<r:int,ghost:int>>")),
            F.when(idv == F.lit(top), F.array(F.struct(F.lit(0).alias("r"), F.lit(2).alias("ghost")))).otherwise(F.array().cast("array<struct<r:int,ghost:int>>")),
        ),
    )
    rows = rows.withColumn("__at", F.explode("__to")).select("doc_id", "text", "fp", F.col("__at.r").alias("r"), F.col("__at.ghost").alias("ghost"))
    w = W.partitionBy("r").orderBy(F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("ghost = 0")
    n_chars = F.length("text")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("n_chars", n_chars)
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = with_sketch(rows.select("doc_id", "n_chars", "fp", "next_fp", "edited"), "edited", "edited_fp", k)
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        to_text(F.col("fp")).alias("fingerprint"),
        to_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"),
        containment(F.col("fp"), F.col("edited_fp"), k).alias("contained_in_edited"),
        distinct_count(F.col("fp"), k).alias("distinct_shingles"),
    )
