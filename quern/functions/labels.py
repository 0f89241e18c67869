"""Labels of two axes and their sources, as Column expressions; null where a part is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joint(a: Column, b: Column) -> Column:
    """2 a + b: four classes of two axes."""
    return (2 * a + b).cast("int")


def same(a: Column, b: Column) -> Column:
    """1 if the axes agree, else 0."""
    return (a == b).cast("int")


def other_axis(a: Column, agree: Column) -> Column:
    """The second axis from the first and whether they agree."""
    return F.when(agree == 1, a).otherwise(1 - a)


def reconciled(a: Column, b: Column, syn: Column) -> Column:
    """Struct a, b, confidence, source: axes checked by an independent ``syn`` (true where they agree).

    Agreement is high and disagreement drops the axes; the axes alone are medium, ``syn`` alone is low.
    """
    axes, agree = a.isNotNull() & b.isNotNull(), (a == b) == syn
    by = F.when(axes & syn.isNotNull(), F.when(agree, 0).otherwise(1)).when(axes, 2).when(syn.isNotNull(), 3).otherwise(4)
    name = lambda *names: F.element_at(F.array(*map(F.lit, names)), by + 1)
    kept = lambda c: F.when(by.isin(0, 2), c)
    return F.struct(
        kept(a).alias("a"),
        kept(b).alias("b"),
        name("high", "conflict", "medium", "low_optical_only", "none").alias("confidence"),
        name("cip+optical", "conflict", "cip_only", "optical_only", "none").alias("source"),
    )


def located(first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """Struct a, b, confidence of a pair that two methods locate, the first preferred: high if both agree, low if not, medium of one, else failed."""
    one, two = first[0].isNotNull(), second[0].isNotNull()
    both = F.when(first[0].eqNullSafe(second[0]) & first[1].eqNullSafe(second[1]), "high").otherwise("low")
    confidence = F.when(one & two, both).when(one | two, "medium").otherwise("failed")
    return F.struct(F.coalesce(first[0], second[0]).alias("a"), F.coalesce(first[1], second[1]).alias("b"), confidence.alias("confidence"))
