"""String parsing: messy text fields into numbers, lists, categories. All are Column expressions, evaluated in the JVM.

``strict`` keeps known quirks of the formats; without it, fields are read as meant.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of the text fields.
WHITE = " \t\n\r\x0b\x0c"
RANGE = r"^(-?\d+\.?\d*)\s*[-–]\s*(-?\d+\.?\d*)"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CIRCA = r"^[Cc]a\.?\s*"
EE = r"(\d+\.?\d*)\s*(?:%|percent)?\s*ee"
DE = r"(\d+\.?\d*)\s*(?:%|percent)?\s*de"
RATIO = r"(\d+\.?\d*)\s*:\s*(\d+\.?\d*)"
NAMED_RATIO = r"(?:dr|d\.?r\.?)\s*[=:]?\s*>?" + RATIO
YEAR_IN_BRACKETS = r"\((\d{4})\)"
YEAR_IN_LIST = r";\s*(\d{4})\s*;"
DEFAULT_YEAR = 2010


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends and tabs included."""
    return F.btrim(c, F.lit(WHITE))


def clean_list(c: Column, sep: str) -> Column:
    """Split at ``sep``, trim, drop empty parts; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), strip), lambda x: x != "")


def semicolon_list(c: Column) -> Column:
    return clean_list(c, ";")


def reaction_sides(c: Column) -> Column:
    """``A.B>>C`` → struct of reactants and products; anything but one ``>>`` gives empty lists."""
    sides = F.split(F.coalesce(c, F.lit("")), ">>")
    none = F.array().cast("array<string>")
    side = lambda i: F.when(F.size(sides) == 2, clean_list(F.get(sides, F.lit(i)), r"\.")).otherwise(none)
    return F.struct(side(0).alias("reactants"), side(1).alias("products"))


def _numbers(s: Column, pattern: str) -> list[Column]:
    return [F.regexp_extract(s, pattern, i).try_cast("double") for i in (1, 2)]


def numeric_field(c: Column, strict: bool = True) -> Column:
    """The number in a field: text before the first ``;``; ``lo - hi`` gives the midpoint; a leading ``Ca.`` is ignored.

    Text after a range is ignored, text after a number makes it null. A range after ``Ca.`` is null, as the
    range is looked for first; not ``strict``, it is read.
    """
    t = strip(F.substring_index(c, ";", 1))
    bare = strip(F.regexp_replace(t, CIRCA, ""))
    ranged = t if strict else bare
    lo, hi = _numbers(ranged, RANGE)
    return F.when(ranged.rlike(RANGE), (lo + hi) / 2).when(bare.rlike(NUMBER), bare.try_cast("double"))


def optical_yield(c: Column, strict: bool = True) -> Column:
    """Struct ee, dr, kind, syn (null if neither is named) of a free-text optical yield.

    ``strict``: a de replaces an ee, "non-evans syn" reads as evans_syn, and any "anti" counts, that of
    "enantiomeric" too. The ratio after ``dr`` goes before any other; named terms go before plain ones.
    """
    s = F.lower(F.coalesce(c, F.lit("")))
    ee, de = (F.regexp_extract(s, p, 1).try_cast("double") for p in (EE, DE))
    share = lambda a, b: F.when(a + b > 0, a / (a + b))
    dr = F.when(s.rlike(NAMED_RATIO), share(*_numbers(s, NAMED_RATIO))).when(s.rlike(RATIO), share(*_numbers(s, RATIO)))
    non_evans = s.contains("non-evans") | s.contains("non evans")
    evans = s.contains("evans syn") if strict else s.contains("evans syn") & ~non_evans
    anti = s.contains("anti") if strict else s.rlike(r"\banti\b")
    kind = F.when(evans, "evans_syn").when(non_evans, "non_evans").when(anti, "anti").when(s.contains("syn"), "syn")
    return F.struct((F.coalesce(de, ee) if strict else F.coalesce(ee, de)).alias("ee"), dr.alias("dr"), kind.alias("kind"), kind.endswith("syn").alias("syn"))


def citation_year(c: Column) -> Column:
    """Latest ``(YYYY)``, else latest ``; YYYY ;``, else 2010."""
    s = F.coalesce(c, F.lit(""))
    latest = lambda p: F.array_max(F.transform(F.regexp_extract_all(s, F.lit(p), F.lit(1)), lambda y: y.cast("int")))
    return F.coalesce(latest(YEAR_IN_BRACKETS), latest(YEAR_IN_LIST), F.lit(DEFAULT_YEAR))


def flip_chirality(c: Column) -> Column:
    """Swap ``@`` and ``@@`` in one pass."""
    return F.replace(F.replace(F.replace(c, F.lit("@@"), F.lit("\x01")), F.lit("@"), F.lit("@@")), F.lit("\x01"), F.lit("@"))


def composite_key(*cols: Column) -> Column:
    """Parts in their order, joined by ``||``; null counts as empty."""
    return F.concat_ws("||", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def row_digest(*cols: Column) -> Column:
    """MD5 of ``|``-joined values; null is told apart from the empty text."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols]))


def contains_any(c: Column, words: list[str]) -> Column:
    """Raw substrings of the lower-cased text, as one regular expression."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(re.escape(w) for w in words))


def category_of(c: Column, ordered: list[tuple[str, tuple[str, ...]]], default: str | None = "none", blank: str | None = None) -> Column:
    """First category with a keyword contained in the lower-cased text, by the order of ``ordered``.

    ``default`` where no keyword is, ``blank`` (if given) where there is no text either. A CASE chain: no join.
    """
    s = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(strip(s) == "", blank) if blank is not None else None
    for name, words in ordered:
        hit = contains_any(c, [w.lower() for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def normalised(c: Column, aliases: dict[str, str]) -> Column:
    """Lower-cased and trimmed, by its alias if it has one; null gives the empty text."""
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), s), s) if aliases else s


def literal_list(c: Column) -> Column:
    """The strings of a list written as ``['a', "b"]``; anything else gives an empty list."""
    quoted = F.when(c.contains('"'), c).otherwise(F.translate(c, "'", '"'))
    return F.coalesce(F.from_json(quoted, "array<string>"), F.array().cast("array<string>"))


def inferred(key: Column, listed: Column, by_key: dict[str, str], rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The value that ``by_key`` has for a key, else that of the first rule with a keyword among the listed strings, else null."""
    given = F.try_element_at(F.create_map(*[F.lit(x) for kv in by_key.items() for x in kv]), strip(F.coalesce(key, F.lit(""))))
    return F.coalesce(given, category_of(F.array_join(literal_list(listed), " "), rules, None))


def signature(c: Column) -> Column:
    """Sorted members joined by ``|``; ``none`` for an empty list, ``na`` for null."""
    return F.when(c.isNull(), "na").when(F.size(c) == 0, "none").otherwise(F.array_join(F.array_sort(c), "|"))


def percent(part: Column, whole: Column) -> Column:
    """``12.3%``; ``0.0%`` of nothing."""
    return F.format_string("%.1f%%", F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole))
