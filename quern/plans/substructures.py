"""Substructure queries over the molecule graphs: fingerprint differences, scaffolds and the split by them, template matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import relational as R
from quern.operators import substructure as S
from quern.plans.common import Registry
from quern.plans.molecules import ATOMS, BONDS_SQL, MOLECULES_SQL, bonds, molecules, nodes

REGISTRY = Registry()
query = REGISTRY.add

SEEDS = [42, 43, 44]
#: Templates by atomic number, tried in this order: a ring of six with a further atom, a chain that bends at a ring bond, nitrogen beside oxygen.
TEMPLATES = [
    ([6, 8, 7, 1, 16, 6, 8], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (5, 6)]),
    ([8, 6, 6, 8], [(0, 1), (1, 2), (2, 3)]),
    ([7, 8], [(0, 1)]),
]

#: Per molecule the codes of its atoms (atomic number and, every third atom, the sign of x, or its mirror image) and lists of neighbours.
PACKED_SQL = (
    MOLECULES_SQL
    + BONDS_SQL
    + f""", near AS (SELECT g, s, list_sort(list(d)) AS ds FROM b GROUP BY g, s),
p AS (SELECT vec_id AS g, list(number::VARCHAR ORDER BY i) AS kind, list(md5(number || CASE WHEN i % 3 <> 1 THEN '' WHEN x > 0 THEN '+' ELSE '-' END) ORDER BY i) AS own,
  list(md5(number || CASE WHEN i % 3 <> 1 THEN '' WHEN x > 0 THEN '-' ELSE '+' END) ORDER BY i) AS mirror, list(coalesce(ds, []) ORDER BY i) AS near FROM a LEFT JOIN near ON near.g = vec_id AND near.s = i GROUP BY vec_id) """
)


def _round_sql(code: str, near: str) -> str:
    return f"list_transform(range(0, {ATOMS}), lambda i: md5({code}[i + 1] || CASE WHEN len({near}[i + 1]) > 0 THEN ',' || array_to_string(list_sort(list_transform({near}[i + 1], lambda j: {code}[j + 1])), ',') ELSE '' END))"


def _bits_sql(side: str) -> str:
    rounds = f"r{side} AS (SELECT g, near, {side} AS c0 FROM p), "
    for r in range(3):
        last = f"r{side}{r}" if r else f"r{side}"
        kept = ", ".join(f"c{i}" for i in range(r + 1))
        rounds += f"r{side}{r + 1} AS (SELECT g, near, {kept}, {_round_sql(f'c{r}', 'near')} AS c{r + 1} FROM {last}), "
    every = "list_concat(list_concat(c0, c1), list_concat(c2, c3))"
    return rounds + f"f{side} AS (SELECT DISTINCT g, CAST(('0x' || substr(c, 1, 8))::BIGINT % 512 AS INT) AS bit FROM (SELECT g, unnest({every}) AS c FROM r{side}3)) "


def _packed(spark: SparkSession, sf_dir: str, signs: tuple[str, str] | None) -> DataFrame:
    """Molecules packed, atoms coded by their number and, every third one, by the sign of x."""
    m = molecules(spark, sf_dir).select(F.col("vec_id").alias("graph_id"), "coords", F.posexplode("z").alias("node", "z"))
    x = F.get("coords", 3 * F.col("node"))
    sign = F.lit("") if signs is None else F.when(F.col("node") % 3 != 1, "").when(x > 0, signs[0]).otherwise(signs[1])
    return S.pack(m.select("graph_id", "node", F.concat(F.col("z").cast("string"), sign).alias("code")), bonds(spark, sf_dir))


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, mirror = (S.fingerprint(_packed(spark, sf_dir, s)).select("graph_id", F.col("fp").alias(n)) for s, n in ((("+", "-"), "own"), (("-", "+"), "mirror")))
    return own.join(mirror, "graph_id").select("graph_id", S.difference(F.col("own"), F.col("mirror")).alias("delta"))


@query(PACKED_SQL + ", " + _bits_sql("own") + ", " + _bits_sql("mirror") + """, d AS (SELECT coalesce(o.g, m.g) AS g, coalesce(o.bit, m.bit) AS bit, CAST(o.bit IS NOT NULL AS INT) - CAST(m.bit IS NOT NULL AS INT) AS v FROM fown o FULL JOIN fmirror m ON o.g = m.g AND o.bit = m.bit)
SELECT g AS graph_id, coalesce(string_agg(CASE WHEN v > 0 THEN '+' ELSE '-' END || bit, ',' ORDER BY bit) FILTER (v <> 0), '') AS delta FROM d GROUP BY g""")
def mirror_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that only a molecule's fingerprint has (+) and that only its mirror image's has (-)."""
    signed = F.filter(F.transform("delta", lambda v, i: F.when(v != 0, F.concat(F.when(v > 0, "+").otherwise("-"), i.cast("string")))), lambda x: x.isNotNull())
    return _differences(spark, sf_dir).select("graph_id", F.array_join(signed, ",").alias("delta"))


@query()
def mirror_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same differences as 16 principal components."""
    return S.compressed(_differences(spark, sf_dir), "graph_id", "delta", 512)


SCAFFOLD_SQL = (
    PACKED_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", w(g, k, near, alive) AS (SELECT g, 0, near, list_transform(range(0, {ATOMS}), lambda i: true) FROM p
  UNION ALL SELECT g, k + 1, near, list_transform(range(0, {ATOMS}), lambda i: alive[i + 1] AND len(list_filter(near[i + 1], lambda j: alive[j + 1])) > 1) FROM w WHERE k < {ATOMS}),
s AS (SELECT w.g, alive, list_transform(w.near, lambda n: list_filter(n, lambda j: alive[j + 1])) AS near, len(list_filter(alive, lambda a: a)) AS n, list_transform(kind, lambda c: md5(c)) AS code FROM w JOIN p ON p.g = w.g WHERE k = {ATOMS}),
c(g, k, n, alive, near, code) AS (SELECT g, 0, n, alive, near, code FROM s UNION ALL SELECT g, k + 1, n, alive, near, {_round_sql("code", "near")} FROM c WHERE k < n),
keys AS (SELECT g AS graph_id, n AS n_scaffold, CASE WHEN n = 0 THEN '{S.ACYCLIC}' ELSE md5(array_to_string(list_sort(list_filter(code, lambda x, i: alive[i])), ',')) END AS key FROM c WHERE k = n) """
)


@query(SCAFFOLD_SQL + "SELECT graph_id, CAST(n_scaffold AS INT) AS n_scaffold, key FROM keys")
def scaffold_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each molecule's scaffold by peeling: its size and key."""
    return S.scaffold(_packed(spark, sf_dir, None)).select("graph_id", F.size("scaffold").alias("n_scaffold"), "key")


@query(SCAFFOLD_SQL + f""", o AS (SELECT key, seed, row_number() OVER (PARTITION BY seed ORDER BY substr(md5(CAST(seed AS VARCHAR) || '|' || key), 1, 15)) AS i, count(*) OVER (PARTITION BY seed) AS n FROM (SELECT DISTINCT key FROM keys), (SELECT unnest({SEEDS}) AS seed)),
t AS (SELECT *, (n + 4) // 5 AS t FROM o)
SELECT 'scaffold' || seed AS split_name, graph_id AS row_id, CASE WHEN i <= t THEN 'test' WHEN i <= t + ((n - t) * 3 + 15) // 16 THEN 'val' ELSE 'train' END AS role FROM keys JOIN t USING (key)""")
def true_scaffold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules of one scaffold stay together: exact shares of scaffolds, 20 % to test and 15 % of all (3/16 of the rest) to val."""
    keys = S.scaffold(_packed(spark, sf_dir, None)).select("graph_id", "key")
    return R.exact_group_split(keys, "graph_id", "key", SEEDS, val="3/16", name="scaffold").select("split_name", "row_id", "role")


def _template_sql(number: int) -> str:
    labels, edges = TEMPLATES[number]
    atoms = ", ".join(f"a a{i}" for i in range(len(labels)))
    where = [f"a{i}.vec_id = a0.vec_id" for i in range(1, len(labels))] + [f"a{i}.number = {z}" for i, z in enumerate(labels)]
    where += [f"a{i}.i <> a{j}.i" for i in range(len(labels)) for j in range(i)]
    where += [f"EXISTS (SELECT 1 FROM b WHERE b.g = a0.vec_id AND b.s = a{x}.i AND b.d = a{y}.i)" for x, y in edges]
    places = ", ".join(f"a{i}.i" for i in range(len(labels)))
    return f"SELECT a0.vec_id AS g, {number} AS template, [{places}] AS m FROM {atoms} WHERE {' AND '.join(where)}"


@query(MOLECULES_SQL + BONDS_SQL + ", t AS (" + " UNION ALL ".join(_template_sql(i) for i in range(len(TEMPLATES))) + """), f AS (SELECT g, min({'t': template, 'm': m}) AS x FROM t GROUP BY g)
SELECT g AS graph_id, CAST(x.t AS INT) AS template, array_to_string(x.m, ',') AS match FROM f""")
def template_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first template that a molecule holds and the atoms it matches."""
    n = nodes(spark, sf_dir).select("graph_id", "node", F.col("z").alias("label"))
    return S.first_match(n, bonds(spark, sf_dir), TEMPLATES).select("graph_id", "template", F.array_join("match", ",").alias("match"))
