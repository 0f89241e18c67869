"""Parsing and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import parse
from quern.operators import relational as R
from quern.plans.common import Registry, case_input, cases_sql, table

REGISTRY = Registry()
query = REGISTRY.add


#: Field text and the number in it.
NUMBERS = [
    ("-78", -78.0), ("-78 - 20", -29.0), ("10; 20", 10.0), ("Ca. 5", 5.0), ("Ca 5", 5.0), ("ca.5", 5.0), ("ca. 10 - 20", None), ("10 - 20 approx", 15.0), ("10 – 20", 15.0), ("-20 - -10", -15.0),
    ("5d", None), ("", None), (None, None), ("  7.5 \t", 7.5), ("1e2", 100.0), (".5", 0.5), ("+3", 3.0), ("20 ; x", 20.0), ("x; 20", None), ("10-20; 30-40", 15.0), ("about 5", None), ("0", 0.0), ("12.", 12.0),
]


@query(cases_sql(NUMBERS, "part", "p_partkey", {"number": "DOUBLE"}))
def kv_numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", parse.numeric_field(case_input(NUMBERS, "p_partkey")).alias("number"))


#: The same read as meant: a range after Ca. counts.
MEANT_NUMBERS = [("ca. 10 - 20", 15.0), ("Ca 10–30; 5", 20.0), ("10 - 20", 15.0), ("Ca. x", None), ("7", 7.0)]


@query(cases_sql(MEANT_NUMBERS, "part", "p_partkey", {"number": "DOUBLE"}))
def numeric_as_meant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", parse.numeric_field(case_input(MEANT_NUMBERS, "p_partkey"), strict=False).alias("number"))


@query("""WITH s AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ' ; '), ';'), lambda x: trim(x)), lambda x: x <> '') AS w FROM part)
SELECT p_partkey, CAST(len(w) AS INT) AS n, array_to_string(w, '|') AS items FROM s""")
def list_split_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", parse.semicolon_list(F.replace("p_name", F.lit(" "), F.lit(" ; "))).alias("w"))
    return p.select("p_partkey", F.size("w").alias("n"), F.array_join("w", "|").alias("items"))


@query("""WITH s AS (SELECT p_partkey, p_brand || '.' || p_type || CASE p_partkey % 3 WHEN 0 THEN '>>' WHEN 1 THEN '>>x>>' ELSE '' END || p_name AS r FROM part),
t AS (SELECT p_partkey, string_split(r, '>>') AS x FROM s)
SELECT p_partkey, CAST(CASE WHEN len(x) = 2 THEN len(list_filter(string_split(x[1], '.'), lambda y: trim(y) <> '')) ELSE 0 END AS INT) AS n_reactants,
  CAST(CASE WHEN len(x) = 2 THEN len(list_filter(string_split(x[2], '.'), lambda y: trim(y) <> '')) ELSE 0 END AS INT) AS n_products FROM t""")
def reaction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 3
    r = F.concat("p_brand", F.lit("."), "p_type", F.when(n == 0, ">>").when(n == 1, ">>x>>").otherwise(""), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", parse.reaction_sides(r).alias("s")).select("p_partkey", F.size("s.reactants").alias("n_reactants"), F.size("s.products").alias("n_products"))


#: Optical yield and its ee, dr, kind, syn.
OPTICAL = [
    ("99 percent ee", 99.0, None, None, None), ("95 ee", 95.0, None, None, None), ("90% ee, 80% de", 80.0, None, None, None), ("80% de, 90% ee", 80.0, None, None, None), ("97.5 %ee", 97.5, None, None, None),
    ("dr >20:1", None, 20 / 21, None, None), ("d.r. = 3:1", None, 0.75, None, None), ("1:1; dr 9:1", None, 0.9, None, None), ("ratio 4:1", None, 0.8, None, None), ("dr 0:0, 3:1", None, None, None, None),
    ("non-evans syn", None, None, "evans_syn", True), ("non-evans", None, None, "non_evans", False), ("Non Evans anti", None, None, "non_evans", False), ("anti, evans syn", None, None, "evans_syn", True),
    ("anti and syn", None, None, "anti", False), ("SYN 98:2", None, 0.98, "syn", True), ("evans-syn", None, None, "syn", True), ("enantiomeric, 92% ee", 92.0, None, "anti", False), ("", None, None, None, None), (None, None, None, None, None),
]
OPTICAL_TYPES = {"ee": "DOUBLE", "dr": "DOUBLE", "kind": "VARCHAR", "syn": "BOOLEAN"}


@query(cases_sql(OPTICAL, "part", "p_partkey", OPTICAL_TYPES))
def optical_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", parse.optical_yield(case_input(OPTICAL, "p_partkey")).alias("o")).select("p_partkey", "o.*")


#: The same read as meant.
MEANT_OPTICAL = [
    ("90% ee, 80% de", 90.0, None, None, None), ("80% de", 80.0, None, None, None), ("non-evans syn", None, None, "non_evans", False), ("evans syn", None, None, "evans_syn", True),
    ("enantiomeric, 92% ee", 92.0, None, None, None), ("anti 3:1", None, 0.75, "anti", False), ("enantiomeric syn", None, None, "syn", True),
]


@query(cases_sql(MEANT_OPTICAL, "part", "p_partkey", OPTICAL_TYPES))
def optical_as_meant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", parse.optical_yield(case_input(MEANT_OPTICAL, "p_partkey"), strict=False).alias("o")).select("p_partkey", "o.*")


#: Citation and its year.
YEARS = [
    ("X (1999); Y (2004)", 2004), ("no year", 2010), (None, 2010), ("A; B; 1987; p. 12", 1987), ("A; 1987; 1999; p. 12", 1987), ("(1950); 2001;", 1950), ("J. (12345)", 2010), ("(0099)", 99), ("A;2003 ; B; 1990;", 2003), ("(2001) (1998)", 2001),
]


@query(cases_sql(YEARS, "orders", "o_orderkey", {"year": "INT"}))
def citation_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", parse.citation_year(case_input(YEARS, "o_orderkey")).alias("year"))


@query(r"""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'J. X (' || year(o_orderdate) || '); Y (1997)' WHEN 1 THEN 'A; B; ' || year(o_orderdate) || '; p. 12' ELSE 'no year' END AS s FROM orders),
f AS (SELECT o_orderkey, list_max(list_transform(regexp_extract_all(s, '\((\d{4})\)', 1), lambda x: x::INT)) AS a, list_max(list_transform(regexp_extract_all(s, ';\s*(\d{4})\s*;', 1), lambda x: x::INT)) AS b FROM s)
SELECT o_orderkey, coalesce(a, b, 2010)::INT AS year FROM f""")
def year_extract_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, y = F.col("o_orderkey") % 3, F.year("o_orderdate").cast("string")
    c = F.when(n == 0, F.concat(F.lit("J. X ("), y, F.lit("); Y (1997)"))).when(n == 1, F.concat(F.lit("A; B; "), y, F.lit("; p. 12"))).otherwise("no year")
    return table(spark, sf_dir, "orders").select("o_orderkey", parse.citation_year(c).alias("year"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '[C@H]' || p_name || '[C@@H]' ELSE '[C@@H]' || p_name || '[C@H]' END AS flipped FROM part")
def chiral_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("[C@@H]"), "p_name", F.lit("[C@H]"))).otherwise(F.concat(F.lit("[C@H]"), "p_name", F.lit("[C@@H]")))
    return table(spark, sf_dir, "part").select("p_partkey", parse.flip_chirality(s).alias("flipped"))


@query("SELECT l_orderkey, l_linenumber, md5(CAST(l_partkey AS VARCHAR) || '|' || coalesce(CAST(nullif(l_suppkey % 10, 3) AS VARCHAR), '\\N') || '|' || l_returnflag) AS digest FROM lineitem".replace("\\\\", "\\"))
def row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parse.row_digest(F.col("l_partkey"), F.nullif(F.col("l_suppkey") % 10, F.lit(3)), F.col("l_returnflag")).alias("digest"))


PRIORITY = [("B", ("brushed",)), ("Ti", ("tin",)), ("Sn", ("steel",)), ("Li", ("economy", "small")), ("Mg", ("large",)), ("Cu", ("copper",))]


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE lower(coalesce(p_type, '') || ' ' || coalesce(p_name, '')) END AS t FROM part),
w(category, keyword, prio) AS (VALUES """ + ", ".join(f"('{c}', '{w}', {i})" for i, (c, ws) in enumerate(PRIORITY) for w in ws) + """)
SELECT p_partkey, CASE WHEN trim(any_value(t)) = '' THEN 'unknown' ELSE coalesce(min_by(category, prio), 'none') END AS category FROM t LEFT JOIN w ON contains(t, keyword) GROUP BY p_partkey""")
def priority_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.concat_ws(" ", "p_type", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", parse.category_of(text, PRIORITY, "none", "unknown").alias("category"))


@query("""WITH n AS (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) * 1.5 AS v FROM nation WHERE n_nationkey % 3 <> 0), r AS (SELECT r_regionkey, CAST(r_regionkey AS DOUBLE) + 100 AS v FROM region WHERE r_regionkey <> 2)
SELECT c_custkey, coalesce(n.v, r.v, (SELECT avg(v) FROM n)) AS v, CAST(n.v IS NOT NULL AS INT) AS known
FROM customer JOIN nation ON c_nationkey = nation.n_nationkey LEFT JOIN n ON c_nationkey = n.n_nationkey LEFT JOIN r ON n_regionkey = r_regionkey""")
def cascade_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's own nation's value, else its region's, else the mean over nations."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n = nation.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("nat"), (F.col("n_nationkey").cast("double") * 1.5).alias("v"))
    r = region.where("r_regionkey <> 2").select(F.col("r_regionkey").alias("reg"), (F.col("r_regionkey").cast("double") + 100).alias("v"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_nationkey").alias("nat"), F.col("n_regionkey").alias("reg"))
    mean = n.agg(F.avg("v").alias("mean"))
    return R.cascade(c.crossJoin(F.broadcast(mean)), [(n, "nat"), (r, "reg")], "v", F.col("mean"), "known").select("c_custkey", "v", "known")


#: An ordered list of names with a value each, and aliases of them.
SOLVENTS = [("tetrahydrofuran", 0.55), ("dichloromethane", 0.1), ("toluene", 0.11), ("ether", 0.47), ("methanol", 0.66), ("water", 0.47)]
ALIASES = {"thf": "tetrahydrofuran", "dcm": "dichloromethane", "meoh": "methanol", "ch2cl2": "dichloromethane"}
#: Raw name, normalised name, value: alias, exact, name within an entry, entry within a name (the first of the list), unknown, blank (within every entry).
NAMES = [
    (" THF ", "tetrahydrofuran", 0.55), ("DCM", "dichloromethane", 0.1), ("Toluene", "toluene", 0.11), ("hydrofuran", "hydrofuran", 0.55), ("diethyl ether", "diethyl ether", 0.47), ("methanol/water", "methanol/water", 0.66),
    ("benzene", "benzene", 0.0), ("CH2Cl2\t", "dichloromethane", 0.1), ("water and toluene", "water and toluene", 0.11), ("", "", 0.55), (None, "", 0.55), ("ethane", "ethane", 0.1),
]


@query(cases_sql([(x, y) for x, y, _ in NAMES], "part", "p_partkey", {"name": "VARCHAR"}))
def alias_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", parse.normalised(case_input(NAMES, "p_partkey"), ALIASES).alias("name"))


@query(cases_sql([(x, v) for x, _, v in NAMES], "part", "p_partkey", {"value": "DOUBLE"}))
def fuzzy_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", case_input(NAMES, "p_partkey").alias("name"))
    return R.fuzzy_lookup(named, "name", SOLVENTS, ALIASES, "value", 0.0).select("p_partkey", "value")


BY_METAL = {"B": "dichloromethane", "Li": "tetrahydrofuran", "Ti": "dichloromethane"}
SOLVENT_RULES = [("dichloromethane", ("butylboryl", "bbn", "boron", "boryl", "ticl", "titanium")), ("tetrahydrofuran", ("lda", "lithium diisopropylamide", "lhmds", "lihmds"))]
#: Metal and reagents (parted by |) and the inferred solvent.
REAGENTS = [
    ("Li|['water']", "tetrahydrofuran"), ("none|['TiCl4', 'x']", "dichloromethane"), ('|["9-BBN triflate"]', "dichloromethane"), ("Zn|['LDA']", "tetrahydrofuran"), ("Zn|['LDA', 'boron']", "dichloromethane"), ("|['water']", None),
    ("|LDA", None), ("|", None), (" B |", "dichloromethane"), ("0|[]", None),
]


@query(cases_sql(REAGENTS, "part", "p_partkey", {"solvent": "VARCHAR"}))
def solvent_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(case_input(REAGENTS, "p_partkey"), r"\|")
    return table(spark, sf_dir, "part").select("p_partkey", parse.inferred(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), BY_METAL, SOLVENT_RULES).alias("solvent"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN [] ELSE list_transform(range(0, p_partkey % 4 + 1), lambda i: CASE WHEN (p_partkey + i) % 3 = 0 THEN 'S' ELSE 'R' END) END AS s FROM part)
SELECT p_partkey, CASE WHEN s IS NULL THEN 'na' WHEN len(s) = 0 THEN 'none' ELSE array_to_string(list_sort(s), '|') END AS signature FROM s""")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    marks = F.transform(F.sequence(F.lit(0).cast("long"), n % 4), lambda i: F.when((n + i) % 3 == 0, "S").otherwise("R"))
    s = F.when(n % 5 == 0, F.lit(None).cast("array<string>")).when(n % 5 == 1, F.array().cast("array<string>")).otherwise(marks)
    return table(spark, sf_dir, "part").select("p_partkey", parse.signature(s).alias("signature"))


@query("""WITH c AS (SELECT o_orderpriority, sum(o_totalprice) AS n, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY ALL)
SELECT o_orderpriority, printf('%.1f%%', 100.0 * f / n) AS share FROM c""")
def formatted_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("f"))
    return c.select("o_orderpriority", parse.percent(F.col("f"), F.col("n")).alias("share"))


@query("""SELECT c_custkey, CASE WHEN lower(c_mktsegment) LIKE '%build%' THEN 'construction' WHEN lower(c_mktsegment) LIKE '%auto%' OR lower(c_mktsegment) LIKE '%mach%' THEN 'metal' ELSE 'none' END AS category FROM customer""")
def category_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", parse.category_of(F.col("c_mktsegment"), [("construction", ("build",)), ("metal", ("auto", "mach"))]).alias("category"))
