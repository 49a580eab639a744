"""Near-duplicate vectors by lattice hashing: projections decoded to E8 points, neighbouring cells probed.

Vectors of one tight group (each within half the angle of a leader, so all linked with one another) form a ball;
links inside a ball are known without looking at pairs. The cells give pairs of balls; bounds on angles settle
most of them whole, and only members between the bounds are compared. So a group that holds a third of all rows
costs its size, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import components, written

TABLES, PROBES, SCALE, SEED = 10, 4, 1.0, 20


@cache
def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    return np.array(out + [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of the nearest in D8 and in D8 shifted by a half."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1) % 2 != 0)
        k = np.argmax(np.abs(y - r)[odd], axis=1)
        gap = y[odd, k] - r[odd, k]
        r[odd, k] += np.where(gap >= 0, 1.0, -1.0)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _key(points: np.ndarray) -> np.ndarray:
    """A lattice point as an integer: its doubled coordinates, a byte each."""
    return np.ascontiguousarray(np.rint(points * 2).astype(np.int8)).view(np.int64).reshape(points.shape[:-1])


def lattice_keys(v: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(n, tables) home cells and (n, tables * probes) neighbouring cells, nearest first, of unit rows v."""
    d = v.shape[1]
    planes = np.random.default_rng([SEED, d]).standard_normal((tables, d, 8)) / scale
    roots, home, near = _roots(), [], []
    for t in range(tables):
        y = v @ planes[t]
        c = nearest_e8(y)
        s = (y - c) @ roots.T
        best = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes else np.empty((len(v), 0), int)
        home.append(_key(c))
        near.append(_key(c[:, None, :] + roots[best]))
    return np.stack(home, 1), np.concatenate(near, 1)


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _coded(vectors: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf"))) & F.exists("embedding", lambda e: e != 0)
    fine = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    own = vectors.select("vec_id", "label", F.when(fine, x).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            v, home, near = [None] * len(rows), [None] * len(rows), [None] * len(rows)
            for d in {len(r) for r in rows if r}:
                at = [k for k, r in enumerate(rows) if r and len(r) == d]
                m = np.array([rows[k] for k in at])
                m /= np.abs(m).max(1, keepdims=True)
                m /= np.sqrt((m**2).sum(1, keepdims=True))
                for k, a, b, c in zip(at, m, *lattice_keys(m, tables, probes, scale), strict=True):
                    v[k], home[k], near[k] = a, b, c
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v, pa.list_(pa.float64())), pa.array(home, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))], ["vec_id", "label", "v", "home", "near"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return own.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<double>, home array<bigint>, near array<bigint>").withColumn("rid", F.monotonically_increasing_id())


def link_vectors(vectors: DataFrame, least: float = 0.93, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Links join vectors of equal label and length with cosine >= least, of those the cells bring together. A null
    id, label or vector, a zero vector and one with null or non-finite parts link with nothing: no links, the
    component is the own id, kept. Copies, repeated ids too, are vectors that link with one another; other columns
    are ignored; no vectors give no rows.
    """
    theta = math.acos(least)
    coded = written(_coded(vectors, tables, probes, scale), "coded")
    good = coded.where("v is not null").withColumn("d", F.size("v"))
    cell = ["label", "d", "cell"]
    first = good.withColumn("cell", F.col("home")[0])
    leaders = first.groupBy(*cell).agg(F.min(F.struct("vec_id", "rid", "v")).alias("leader"))
    near = first.join(leaders, cell).withColumn("c", F.when(F.col("rid") == F.col("leader.rid"), 1.0).otherwise(_dot("v", "leader.v")))
    inside = F.col("c") >= math.cos(theta / 2) + 1e-12
    members = written(near.select("rid", "vec_id", "label", "d", "v", "home", "near", F.when(inside, F.col("leader.rid")).otherwise(F.col("rid")).alias("ball"), F.when(inside, _angle(F.col("c"))).otherwise(0.0).alias("turn")), "members")
    sizes = members.groupBy("ball").agg(F.count("*").alias("n"), (F.max("turn") + 1e-7).alias("rho"))
    # a ball of one has no radius, so its bounds settle every pair but those at the threshold itself
    balls = written(members.where("rid = ball").select("ball", "v").join(sizes, "ball").withColumn("rho", F.when(F.col("n") == 1, 0.0).otherwise(F.col("rho"))), "balls")

    cells = lambda c, per: members.select("label", "d", "ball", F.posexplode(c).alias("t", "key")).withColumn("t", F.floor(F.col("t") / per)).distinct()
    home, probe = cells("home", 1), cells("near", max(1, probes))
    place = ["label", "d", "t", "key"]
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    same = home.withColumnRenamed("ball", "a").join(home.withColumnRenamed("ball", "b"), place).where("a < b").select("a", "b")
    beside = probe.withColumnRenamed("ball", "a").join(home.withColumnRenamed("ball", "b"), place).where("a <> b").select(low, high)
    pairs = same.unionByName(beside).distinct()

    side = lambda x: balls.select(F.col("ball").alias(x), F.col("v").alias(f"v{x}"), F.col("n").alias(f"n{x}"), F.col("rho").alias(f"rho{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("dot", _dot("va", "vb"))
    ones = (F.col("na") == 1) & (F.col("nb") == 1)
    angle = _angle(F.col("dot"))
    whole = F.when(ones, F.col("dot") >= least).otherwise(angle + F.col("rhoa") + F.col("rhob") <= theta - 1e-9)
    part = ~ones & ~whole & (angle - F.col("rhoa") - F.col("rhob") <= theta + 1e-9)
    seen = written(met.select("a", "b", "na", "nb", whole.alias("whole"), part.alias("part")).where("whole or part"), "ball-pairs")
    all_of = seen.where("whole")
    by_ball = all_of.select(F.col("a").alias("ball"), F.col("nb").alias("k")).unionByName(all_of.select(F.col("b").alias("ball"), F.col("na").alias("k"))).groupBy("ball").agg(F.sum("k").alias("more"))

    some = seen.where("part").select("a", "b")
    ways = some.unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = members.select(F.col("ball").alias("a"), F.col("rid").alias("x"), F.col("v").alias("vx")).join(ways, "a").join(side("b"), "b").withColumn("turn", _angle(_dot("vx", "vb")))
    settled = one.where(F.col("turn") + F.col("rhob") <= theta - 1e-9).select("x", "a", "b", F.col("nb").alias("k"))
    open_ = one.where((F.col("turn") + F.col("rhob") > theta - 1e-9) & (F.col("turn") - F.col("rhob") <= theta + 1e-9))
    compared = open_.select("x", "a", "b", "vx").join(members.select(F.col("ball").alias("b"), F.col("v").alias("vy")), "b").where(_dot("vx", "vy") >= least).groupBy("x", "a", "b").agg(F.count("*").alias("k"))
    found = written(settled.unionByName(compared.select("x", "a", "b", "k")), "links")
    by_row = found.groupBy("x").agg(F.sum("k").alias("own"))

    edges = all_of.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(found.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    of = components(edges).select(F.col("node").alias("ball"), F.col("component"))
    ids = members.select("rid", "vec_id", "ball").join(of, "ball", "left").withColumn("group", F.coalesce("component", "ball"))
    roots = ids.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counted = ids.join(roots, "group").join(sizes.select("ball", "n"), "ball").join(by_ball, "ball", "left").join(by_row, F.col("rid") == F.col("x"), "left")
    linked = counted.select("vec_id", (F.col("n") - 1 + zero("more") + zero("own")).alias("n_links"), "component_id")
    alone = coded.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
