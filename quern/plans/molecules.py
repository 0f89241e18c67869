"""Geometry and graph queries over molecules made of the embeddings: 21 atoms from 63 components, the 64th as energy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.functions.geometry import RADII
from quern.operators import geometry as O
from quern.operators import graphs as G
from quern.plans.common import Registry, table

REGISTRY = Registry()
query = REGISTRY.add

ATOMS, NUMBERS = 21, [6, 8, 7, 1, 16]
MOLECULES_SQL = f"""WITH a AS (SELECT vec_id, label, i, 10 * embedding[3 * i + 1]::DOUBLE AS x, 10 * embedding[3 * i + 2]::DOUBLE AS y, 10 * embedding[3 * i + 3]::DOUBLE AS z,
  {[float(RADII[n]) for n in NUMBERS]}[i % {len(NUMBERS)} + 1]::DOUBLE AS r, {NUMBERS}[i % {len(NUMBERS)} + 1] AS number, abs(embedding[64]::DOUBLE) AS energy FROM embeddings, unnest(range(0, {ATOMS})) AS u(i)) """


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, coords, z, energy."""
    numbers = F.array(*[F.lit(NUMBERS[i % len(NUMBERS)]) for i in range(ATOMS)])
    coords = F.transform(F.slice("embedding", 1, 3 * ATOMS), lambda x: x.cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", coords.alias("coords"), numbers.alias("z"), F.abs(F.get("embedding", F.lit(63)).cast("double")).alias("energy"))


def atom(i: int):
    return F.slice("coords", 3 * i + 1, 3)


#: Unit normal of the plane of the first three atoms.
NORMAL_SQL = """, p AS (SELECT vec_id, max(x) FILTER (i = 0) AS x0, max(y) FILTER (i = 0) AS y0, max(z) FILTER (i = 0) AS z0, max(x) FILTER (i = 1) AS x1, max(y) FILTER (i = 1) AS y1, max(z) FILTER (i = 1) AS z1,
  max(x) FILTER (i = 2) AS x2, max(y) FILTER (i = 2) AS y2, max(z) FILTER (i = 2) AS z2 FROM a GROUP BY vec_id),
q AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS a1, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS a2, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS a3 FROM p),
n AS (SELECT *, a1 / sqrt(a1 * a1 + a2 * a2 + a3 * a3) AS n1, a2 / sqrt(a1 * a1 + a2 * a2 + a3 * a3) AS n2, a3 / sqrt(a1 * a1 + a2 * a2 + a3 * a3) AS n3 FROM q) """


@query(MOLECULES_SQL + NORMAL_SQL + "SELECT vec_id, round(n1, 6) AS n1, round(n2, 6) AS n2, round(n3, 6) AS n3 FROM n")
def plane_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.plane_normal(atom(0), atom(1), atom(2))
    return molecules(spark, sf_dir).select("vec_id", n.alias("n")).select("vec_id", *[F.round(F.get("n", F.lit(i)), 6).alias(f"n{i + 1}") for i in range(3)])


@query(MOLECULES_SQL + """, v AS (SELECT vec_id, b.i AS k, (b.x - a0.x) * ((c.y - a0.y) * (d.z - a0.z) - (c.z - a0.z) * (d.y - a0.y)) + (b.y - a0.y) * ((c.z - a0.z) * (d.x - a0.x) - (c.x - a0.x) * (d.z - a0.z))
  + (b.z - a0.z) * ((c.x - a0.x) * (d.y - a0.y) - (c.y - a0.y) * (d.x - a0.x)) AS v FROM a a0 JOIN a b USING (vec_id) JOIN a c USING (vec_id) JOIN a d USING (vec_id) WHERE a0.i % 4 = 0 AND b.i = a0.i + 1 AND c.i = a0.i + 2 AND d.i = a0.i + 3)
SELECT vec_id, round(avg(v), 5) AS mean, round(arg_max(v, abs(v)), 5) AS largest, round(sum(abs(v)), 5) AS abs_sum FROM v GROUP BY vec_id""")
def signed_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed volumes of the atoms' runs of four: mean, largest by absolute value, sum of absolute values."""
    corner = lambda i: V.signed_volume(*[V.minus(atom(4 * i + j), atom(4 * i)) for j in (1, 2, 3)])
    m = molecules(spark, sf_dir).select("vec_id", V.determinant_stats(F.array(*[corner(i) for i in range(5)])).alias("s"))
    return m.select("vec_id", *[F.round(f"s.{c}", 5).alias(c) for c in ("mean", "largest", "abs_sum")])


@query(MOLECULES_SQL + """, b AS (SELECT a.vec_id, a.i, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z FROM a JOIN a b ON a.vec_id = b.vec_id AND b.i = a.i + 1 WHERE a.i < 3),
c AS (SELECT p.vec_id, p.i, p.y * q.z - p.z * q.y AS x, p.z * q.x - p.x * q.z AS y, p.x * q.y - p.y * q.x AS z FROM b p JOIN b q ON p.vec_id = q.vec_id AND q.i = p.i + 1),
t AS (SELECT b.vec_id, atan2(sqrt(m.x ** 2 + m.y ** 2 + m.z ** 2) * (b.x * d.x + b.y * d.y + b.z * d.z), c.x * d.x + c.y * d.y + c.z * d.z) AS t FROM b JOIN b m ON b.vec_id = m.vec_id AND m.i = 1 JOIN c ON b.vec_id = c.vec_id AND c.i = 0 JOIN c d ON b.vec_id = d.vec_id AND d.i = 1 WHERE b.i = 0)
SELECT vec_id, round(sin(t), 6) AS sin_tau, round(cos(t), 6) AS cos_tau FROM t""")
def dihedral_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sin and cos of the dihedral of the first four atoms, as expressions."""
    t = V.dihedral(*[atom(i) for i in range(4)])
    return molecules(spark, sf_dir).select("vec_id", t.alias("t")).select("vec_id", F.round(F.sin("t"), 6).alias("sin_tau"), F.round(F.cos("t"), 6).alias("cos_tau"))


SPACING = 0.5


@query(MOLECULES_SQL + NORMAL_SQL + f""", l AS (SELECT -3.5 + {SPACING} * k AS t FROM unnest(range(0, {int(7 / SPACING) + 1})) AS u(k)), g AS (SELECT p.t::DOUBLE AS gx, q.t::DOUBLE AS gy, r.t::DOUBLE AS gz FROM l p, l q, l r WHERE p.t ** 2 + q.t ** 2 + r.t ** 2 <= 12.25),
o AS (SELECT n.vec_id, gx, gy, gz, gx * n1 + gy * n2 + gz * n3 > 0 AS up, bool_or((gx - (x - x0)) ** 2 + (gy - (y - y0)) ** 2 + (gz - (z - z0)) ** 2 <= r * r) AS hit FROM n JOIN a ON n.vec_id = a.vec_id AND i > 0, g GROUP BY ALL),
s AS (SELECT vec_id, 100.0::DOUBLE * count(*) FILTER (hit AND up) / count(*) FILTER (up) AS si, 100.0::DOUBLE * count(*) FILTER (hit AND NOT up) / count(*) FILTER (NOT up) AS re, 100.0::DOUBLE * count(*) FILTER (hit) / count(*) AS t FROM o GROUP BY vec_id)
SELECT vec_id, round(si, 5) AS vbur_si, round(re, 5) AS vbur_re, round(si - re, 5) AS vbur_diff, round(t, 5) AS vbur_total FROM s""")
def buried_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a grid of half an angstrom (the operator's own is a quarter)."""
    v = O.buried_volumes(molecules(spark, sf_dir), "vec_id", spacing=SPACING)
    return v.select("vec_id", *[F.round(c, 5).alias(c) for c in v.columns[1:]])


GROUP = [3, 4, 5, 6, 7, 8]


@query(MOLECULES_SQL + f""", g AS (SELECT a.vec_id, a.i, a.r, a.x - o.x AS x, a.y - o.y AS y, a.z - o.z AS z FROM a JOIN a o ON a.vec_id = o.vec_id AND o.i = 0 WHERE a.i IN ({", ".join(map(str, GROUP))})),
m AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM g GROUP BY vec_id), u AS (SELECT vec_id, mx / sqrt(mx * mx + my * my + mz * mz) AS ux, my / sqrt(mx * mx + my * my + mz * mz) AS uy, mz / sqrt(mx * mx + my * my + mz * mz) AS uz FROM m),
p AS (SELECT g.*, ux, uy, uz, x * ux + y * uy + z * uz AS t FROM g JOIN u USING (vec_id)), w AS (SELECT *, sqrt((x - t * ux) ** 2 + (y - t * uy) ** 2 + (z - t * uz) ** 2) + r AS b FROM p)
SELECT vec_id, round(arg_max(t + r, t), 5) AS l, round(min(b), 5) AS b1, round(max(b), 5) AS b5 FROM w GROUP BY vec_id""")
def sterimols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = O.sterimols(molecules(spark, sf_dir), "vec_id", 0, GROUP)
    return s.select("vec_id", *[F.round(c, 5).alias(c) for c in ("l", "b1", "b5")])


@query(MOLECULES_SQL + """, g AS (SELECT t * 20 + p AS k, 10 * sin(pi() * t / 9) * cos(2 * pi() * p / 20) AS gx, 10 * sin(pi() * t / 9) * sin(2 * pi() * p / 20) AS gy, 10 * cos(pi() * t / 9) AS gz FROM unnest(range(0, 10)) AS a(t), unnest(range(0, 20)) AS b(p)),
m AS (SELECT a.vec_id, any_value(a.label) AS label, any_value(a.energy) AS energy, k, min(sqrt((gx + o.x - a.x) ** 2 + (gy + o.y - a.y) ** 2 + (gz + o.z - a.z) ** 2) - a.r) AS d FROM a JOIN a o ON a.vec_id = o.vec_id AND o.i = 0 AND a.i > 0, g GROUP BY a.vec_id, k),
w AS (SELECT label, k, d, exp(-energy / 0.5922) AS w FROM m)
SELECT label, k AS cell, round(sum(w * d) / sum(w), 5) AS distance FROM w GROUP BY ALL""")
def spherical_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spherical maps of all molecules of a label, averaged with Boltzmann weights cell by cell."""
    m = molecules(spark, sf_dir).withColumn("w", F.exp(-F.col("energy") / 0.5922))
    cells = O.mean_maps(m, "label", "w")
    return cells.select("label", F.col("cell").cast("long").alias("cell"), F.round("distance", 5).alias("distance"))


FACE_SQL = MOLECULES_SQL + NORMAL_SQL + """, u0 AS (SELECT vec_id, x0, y0, z0, n1, n2, n3, CASE WHEN abs(n3) < 0.9 THEN n2 ELSE 0 END AS b1, CASE WHEN abs(n3) < 0.9 THEN -n1 ELSE n3 END AS b2, CASE WHEN abs(n3) < 0.9 THEN 0 ELSE -n2 END AS b3 FROM n),
u1 AS (SELECT *, b1 / sqrt(b1 * b1 + b2 * b2 + b3 * b3) AS u1, b2 / sqrt(b1 * b1 + b2 * b2 + b3 * b3) AS u2, b3 / sqrt(b1 * b1 + b2 * b2 + b3 * b3) AS u3 FROM u0),
f AS (SELECT *, s * (n2 * u3 - n3 * u2) AS v1, s * (n3 * u1 - n1 * u3) AS v2, s * (n1 * u2 - n2 * u1) AS v3 FROM u1, (SELECT unnest([1, -1]) AS s)),
t AS (SELECT k, -5 + 10.0::DOUBLE * k / 9 AS t FROM unnest(range(0, 10)) AS a(k)),
d AS (SELECT f.vec_id, f.s, p.k AS i, q.k AS j, min(sqrt((x0 + p.t * u1 + q.t * v1 + 5 * f.s * n1 - a.x) ** 2 + (y0 + p.t * u2 + q.t * v2 + 5 * f.s * n2 - a.y) ** 2 + (z0 + p.t * u3 + q.t * v3 + 5 * f.s * n3 - a.z) ** 2) - a.r) AS d
  FROM f JOIN a ON f.vec_id = a.vec_id, t p, t q GROUP BY ALL),
g AS (SELECT vec_id, s, avg(d) AS mean, stddev_pop(d) AS std, min(d) AS min, max(d) AS max, quantile_cont(d, 0.25) AS q25, quantile_cont(d, 0.75) AS q75, avg(d) FILTER (i < 5 AND j < 5) AS tl, avg(d) FILTER (i < 5 AND j >= 5) AS tr, avg(d) FILTER (i >= 5 AND j < 5) AS bl, avg(d) FILTER (i >= 5 AND j >= 5) AS br FROM d GROUP BY ALL) """
PROFILE = ["mean", "std", "min", "max", "q25", "q75", "tl", "tr", "bl", "br"]


@query(FACE_SQL + "SELECT p.vec_id, " + ", ".join(f"round({t}.{c}, 4) AS {side}_{c}" for t, side in (("p", "si"), ("q", "re")) for c in PROFILE)
    + ", round(p.mean - q.mean, 4) AS diff_mean, round(p.min - q.min, 4) AS diff_min, round(p.mean / (q.mean + 1e-8), 4) AS ratio, round(abs(p.mean - q.mean), 4) AS asymmetry FROM g p JOIN g q ON p.vec_id = q.vec_id AND p.s = 1 AND q.s = -1")
def face_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 features of the grids above and below the first three atoms' plane."""
    f = O.face_features(molecules(spark, sf_dir), "vec_id")
    return f.select("vec_id", *[F.round(c, 4).alias(c) for c in f.columns[1:]])


@query(MOLECULES_SQL + """, c AS (SELECT vec_id, any_value(label) AS label, any_value(energy) AS energy, avg(sqrt(x * x + y * y + z * z)) AS reach, max(r + sqrt(x * x + y * y + z * z)) AS extent FROM a GROUP BY vec_id),
l AS (SELECT label, min(energy) AS low FROM c GROUP BY label), w AS (SELECT c.*, exp(-(energy - low) / 0.5922) AS w FROM c JOIN l USING (label)), m AS (SELECT label, sum(w * reach) / sum(w) AS r, sum(w * extent) / sum(w) AS e FROM w GROUP BY label)
SELECT label, round(any_value(m.r), 5) AS reach_mean, round(sqrt(sum(w * (reach - m.r) ** 2) / sum(w)), 5) AS reach_std, round(any_value(m.e), 5) AS extent_mean, round(sqrt(sum(w * (extent - m.e) ** 2) / sum(w)), 5) AS extent_std FROM w JOIN m USING (label) GROUP BY label""")
def ensemble_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of each conformer, then their weighted mean and std over a label's ensemble."""
    m = molecules(spark, sf_dir)
    d = O.per_molecule(m, "vec_id", _reach, ["reach", "extent"]).join(m.select("vec_id", "label", "energy"), "vec_id")
    out = O.ensemble(d, "label", "energy", ["reach", "extent"])
    return out.select("label", *[F.round(c, 5).alias(c) for c in out.columns[1:]])


def _reach(x, z) -> list[float]:
    import numpy as np

    from quern.functions.geometry import radii

    d = np.sqrt((x * x).sum(1))
    return [d.mean(), (d + radii(z)).max()]


@query(MOLECULES_SQL + """, d AS (SELECT a.vec_id, a.x - o.x AS x, a.y - o.y AS y, a.z - o.z AS z, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - o.x) ** 2 + (a.y - o.y) ** 2 + (a.z - o.z) ** 2, a.i) AS rn FROM a JOIN a o ON a.vec_id = o.vec_id AND o.i = 0 WHERE a.i > 0),
s AS (SELECT p.vec_id, sqrt(p.x ** 2 + p.y ** 2 + p.z ** 2) AS z1, p.x * q.x + p.y * q.y + p.z * q.z AS pq, q.x ** 2 + q.y ** 2 + q.z ** 2 AS qq FROM d p JOIN d q ON p.vec_id = q.vec_id AND p.rn = 1 AND q.rn = 2)
SELECT vec_id, round(z1, 5) AS first_z, round(sqrt(qq - (pq / z1) ** 2), 5) AS second_y, round(pq / z1, 5) AS second_z FROM s""")
def standard_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the two atoms nearest to the first one lie once it is turned to the standard orientation."""
    o = O.orientations(molecules(spark, sf_dir), "vec_id", 0)
    return o.select("vec_id", *[F.round(c, 5).alias(c) for c in ("first_z", "second_y", "second_z")])


@query()
def face_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the atoms outside the first six, taken as a ring, block the two faces at its fourth."""
    return O.blocking(molecules(spark, sf_dir), "vec_id", list(range(6)), 3)


@query()
def conformer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conformers (the ids of a label and hundred) clustered by distance, one representative each, with weights."""
    m = molecules(spark, sf_dir).withColumn("ensemble", F.concat_ws("/", "label", F.floor(F.col("vec_id") / 100)))
    return O.representatives(m, "ensemble", "vec_id", "energy", cut=3.0)


# ---- graphs: a chain of the atoms with gaps, and some rings

BONDS_SQL = """, e AS (SELECT vec_id AS g, i AS s, i + 1 AS d FROM embeddings, unnest(range(0, 20)) AS u(i) WHERE (vec_id + i) % 9 <> 0 UNION ALL SELECT vec_id, i, i + 5 FROM embeddings, unnest([0, 5, 10, 15]) AS u(i) WHERE (vec_id + i) % 4 <> 0),
b AS (SELECT g, s, d FROM e UNION ALL SELECT g, d, s FROM e) """
WALK_SQL = MOLECULES_SQL.replace("WITH a AS", "WITH RECURSIVE a AS") + BONDS_SQL


def bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, src, dst."""
    n = F.col("vec_id")
    chain = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.when((n + i) % 9 != 0, F.struct(i.alias("src"), (i + 1).alias("dst"))))
    rings = F.transform(F.array(*map(F.lit, (0, 5, 10, 15))), lambda i: F.when((n + i) % 4 != 0, F.struct(i.alias("src"), (i + 5).alias("dst"))))
    return table(spark, sf_dir, "embeddings").select(n.alias("graph_id"), F.explode(F.concat(chain, rings)).alias("e")).where("e IS NOT NULL").select("graph_id", "e.*")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, node, z, ring, x: the first six nodes are the ring; x is the atom's distance from the origin."""
    m = molecules(spark, sf_dir).select(F.col("vec_id").alias("graph_id"), "coords", F.posexplode("z").alias("node", "z"))
    at = F.slice("coords", 3 * F.col("node") + 1, F.lit(3))
    return m.select("graph_id", "node", "z", (F.col("node") < 6).cast("int").alias("ring"), F.sqrt(V.dot(at, at)).alias("x"))


@query(WALK_SQL + """, w(g, node, dist) AS (SELECT vec_id, 0, 0 FROM embeddings UNION SELECT w.g, b.d, dist + 1 FROM w JOIN b ON w.g = b.g AND w.node = b.s WHERE dist < 20), t AS (SELECT g, node, min(dist) AS dist FROM w GROUP BY ALL),
c AS (SELECT t.*, CASE WHEN a.x > 0 THEN 1 ELSE -1 END AS sign FROM t JOIN a ON a.vec_id = g AND a.i = node WHERE node % 3 = 1 AND dist > 0), f AS (SELECT g, max(dist) AS ecc FROM t GROUP BY g)
SELECT f.g AS graph_id, count(*) FILTER (dist <= 3) AS n3, count(*) FILTER (dist <= 4) AS n4, count(*) FILTER (dist <= 5) AS n5, round(coalesce(sum(sign / dist), 0), 6)::DOUBLE + 0 AS gradient, coalesce(min(dist), 99)::INT AS nearest, coalesce(arg_min(sign, {'d': dist, 'n': node}), 0)::INT AS nearest_sign,
  coalesce(product(sign) FILTER (dist <= 3), 0)::DOUBLE AS product, any_value(ecc)::INT AS eccentricity FROM f LEFT JOIN c ON f.g = c.g GROUP BY f.g""")
def centre_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed centres (every third atom) by their distance in bonds from atom 0, and the longest chain from it."""
    starts = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("graph_id"), F.lit(0).alias("start"), F.lit(None).cast("array<bigint>").alias("blocked"))
    d = G.distances(bonds(spark, sf_dir), starts)
    x = F.get("coords", 3 * F.col("node"))
    centres = molecules(spark, sf_dir).select(F.col("vec_id").alias("graph_id"), "coords", F.explode(F.sequence(F.lit(0), F.lit(ATOMS - 1))).alias("node")).where("node % 3 = 1")
    centres = centres.select("graph_id", F.col("node").cast("long").alias("node"), F.when(x > 0, 1).otherwise(-1).alias("sign"))
    out = G.layers(d, centres).join(G.eccentricity(d).select("graph_id", "eccentricity"), "graph_id")
    return out.withColumn("gradient", F.round("gradient", 6) + F.lit(0.0))  # no negative zero


@query(WALK_SQL + """, s AS (SELECT vec_id AS g, unnest([10, 0]) AS start FROM embeddings), w(g, start, node, dist) AS (SELECT g, start, start, 0 FROM s UNION SELECT w.g, start, b.d, dist + 1 FROM w JOIN b ON w.g = b.g AND w.node = b.s WHERE dist < 4 AND b.d <> 5),
t AS (SELECT DISTINCT g, start, node FROM w), q AS (SELECT t.g, start, list_sort(list(number), 'DESC') AS seq FROM t JOIN a ON a.vec_id = t.g AND a.i = node GROUP BY ALL)
SELECT p.g AS graph_id, array_to_string(p.seq, ',') AS seq, CAST(CASE WHEN p.seq = q.seq THEN 0 WHEN p.seq > q.seq THEN 1 ELSE -1 END AS INT) AS outranks FROM q p JOIN q ON p.g = q.g AND p.start = 10 AND q.start = 0""")
def branch_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch from atom 10 against that from atom 0, both cut at atom 5: atomic numbers within four bonds, compared largest first."""
    starts = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("graph_id"), F.explode(F.array(F.lit(10), F.lit(0))).alias("start"), F.array(F.lit(5).cast("long")).alias("blocked"))
    d = G.distances(bonds(spark, sf_dir), starts, 4)
    seq = G.branch_sequence(d, nodes(spark, sf_dir).select("graph_id", F.col("node").cast("long").alias("node"), "z"))
    a, b = (seq.where(F.col("start") == i).select("graph_id", F.col("seq").alias(n)) for i, n in ((10, "a"), (0, "b")))
    return a.join(b, "graph_id").select("graph_id", F.array_join("a", ",").alias("seq"), G.outranks(F.col("a"), F.col("b")).alias("outranks"))


RING = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0)]
VARIANTS = ["Z_re", "Z_si", "E_re", "E_si"]


@query(MOLECULES_SQL + BONDS_SQL + f""", v AS (SELECT unnest({VARIANTS}) AS variant), r AS (SELECT k AS s, (k + 1) % 6 AS d FROM unnest(range(0, 6)) AS u(k)), x AS (SELECT s, d FROM r UNION ALL SELECT d, s FROM r)
SELECT vec_id AS graph_id, variant, s AS src, d AS dst, 'ring' AS kind FROM embeddings, v, x UNION ALL SELECT g, variant, s, d, 'substituent' FROM b, v""")
def template_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four variants of each graph: the ring template and the graph's own bonds, in both directions."""
    graphs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("graph_id"))
    return G.from_template(graphs, RING, VARIANTS, bonds(spark, sf_dir))


@query(f"""WITH v AS (SELECT unnest({VARIANTS}) AS variant), f AS (SELECT vec_id, variant, vec_id * 2 AS score FROM embeddings, v WHERE (vec_id + length(variant) + CAST(variant LIKE 'E%' AS INT)) % 5 <> 0)
SELECT e.vec_id AS graph_id, v.variant, coalesce(score, -1) AS score, CAST(score IS NULL AS INT) AS dummy FROM embeddings e CROSS JOIN v LEFT JOIN f ON f.vec_id = e.vec_id AND f.variant = v.variant""")
def completed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dummies for variants that are missing, so that every graph has all four."""
    wanted = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("graph_id"))
    found = wanted.select("graph_id", F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant")).where((F.col("graph_id") + F.length("variant") + F.col("variant").startswith("E").cast("int")) % 5 != 0)
    return G.complete(found.withColumn("score", F.col("graph_id") * 2), wanted, VARIANTS, {"score": -1})


@query(MOLECULES_SQL + BONDS_SQL + """, n AS (SELECT vec_id AS g, count(*) AS n, avg(number) AS z, avg(sqrt(x * x + y * y + z * z)) AS x, avg(number) FILTER (i < 6) AS zr, avg(sqrt(x * x + y * y + z * z)) FILTER (i < 6) AS xr FROM a GROUP BY vec_id), c AS (SELECT g, count(*) AS m FROM b GROUP BY g)
SELECT n.g AS graph_id, n AS n_nodes, coalesce(m, 0) AS n_edges, round(z, 5) AS z_mean, round(x, 5) AS x_mean, round(zr, 5) AS z_ring, round(xr, 5) AS x_ring, round(coalesce(m, 0) / (n * (n - 1)), 6)::DOUBLE AS density FROM n LEFT JOIN c ON n.g = c.g""")
def graph_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the node features over all nodes and over the ring, and the density."""
    n = nodes(spark, sf_dir).withColumn("z", F.col("z").cast("double"))
    out = G.graph_summary(n, G.both_ways(bonds(spark, sf_dir)), ["z", "x"])
    return out.select("graph_id", "n_nodes", "n_edges", *[F.round(c, 5).alias(c) for c in ("z_mean", "x_mean", "z_ring", "x_ring")], F.round("density", 6).alias("density"))


@query(MOLECULES_SQL + BONDS_SQL + ", k AS (SELECT g, s AS node, count(*) AS degree FROM b GROUP BY ALL) SELECT a.vec_id AS graph_id, CAST(a.i AS INT) AS node, CAST(number AS INT) AS z, coalesce(degree, 0) AS degree FROM a LEFT JOIN k ON k.g = a.vec_id AND k.node = a.i")
def exploded_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules as arrays of atoms and bonds → node and edge tables, joined again for the nodes' degrees."""
    packed = bonds(spark, sf_dir).groupBy("graph_id").agg(F.collect_list(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("kind"))).alias("bonds"))
    graphs = molecules(spark, sf_dir).select(F.col("vec_id").alias("graph_id"), "z").join(packed, "graph_id", "left")
    n, e = G.explode_graphs(graphs)
    degree = e.groupBy("graph_id", F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return n.join(degree, ["graph_id", "node"], "left").select("graph_id", "node", "z", F.coalesce("degree", F.lit(0)).alias("degree"))


SIDES_SQL = """WITH f AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_linenumber) AS w FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
o AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_linenumber) AS w FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), c AS (SELECT coalesce(f.a, o.a) AS a, coalesce(f.b, o.b) AS b FROM f FULL JOIN o ON f.a = o.a AND f.b = o.b WHERE coalesce(f.w, 0) <> coalesce(o.w, 0)) """


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("w"), "l_linestatus")
    return tuple(l.where(F.col("l_linestatus") == s).drop("l_linestatus") for s in "FO")


@query(SIDES_SQL + "SELECT DISTINCT node FROM (SELECT a AS node FROM c UNION ALL SELECT b FROM c)")
def reaction_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reaction_centre(G.edge_changes(*_sides(spark, sf_dir)))


@query("SELECT CASE l_linestatus WHEN 'F' THEN 'reactant' ELSE 'product' END AS side, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS w FROM lineitem GROUP BY ALL")
def two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.two_views(*_sides(spark, sf_dir)).groupBy("side").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
