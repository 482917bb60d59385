"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Vectors of one label meet in routing cells: the signs of a few seeded projections, as many as keep a cell near ``CELL``
vectors. A vector is indexed in its own cell and queries every cell within the window of its projections. In a cell the
index side is sorted along each of many projections; a query-centred window [p - w, p + w] on each is a run of the sorted
order, and a pair collides once per window it shares. Only pairs that reach the collision count are verified by cosine in
double precision. w, the count and the number of routing tables follow from the target recall at the threshold: the
difference of two unit vectors at cosine c has length d = sqrt(2 - 2c), and its projection on a random direction is close
to a normal variable of deviation d / sqrt(dim), whatever the data.

Equal vectors are one point with a multiplicity. Crowded cells are split into blocks of index and query rows, so no task
holds a whole group, and a task sends link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Forest, connected_components, stored

COSINE = 0.93
CELL = 1500
BLOCK = 4096
PROJECTIONS = 24
TABLES = 3
WINDOW = 2.0  # half width in deviations of a pair at the threshold
RECALL = 0.9999
SEED = 20240501
MAX_BITS = 24


@dataclass(frozen=True)
class Plan:
    """Projections and calibrated parameters for one dimension."""

    window: float
    count: int
    routing: np.ndarray  # tables x bits x dim
    counting: np.ndarray  # projections x dim


@functools.lru_cache(maxsize=8)
def plan_for(dim: int, cosine: float = COSINE) -> Plan:
    """Window and the largest collision count that a pair at the threshold reaches with probability ``RECALL``."""
    deviation = math.sqrt(2 - 2 * cosine) / math.sqrt(dim)
    hit = math.erf(WINDOW / math.sqrt(2))
    tail, count = 0.0, 0
    for k in range(PROJECTIONS + 1):
        tail += math.comb(PROJECTIONS, k) * hit**k * (1 - hit) ** (PROJECTIONS - k)
        if tail > 1 - RECALL:
            count = k
            break
    rng = np.random.default_rng([SEED, dim])
    directions = rng.standard_normal((TABLES * MAX_BITS + PROJECTIONS, dim))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    return Plan(WINDOW * deviation, count, directions[: TABLES * MAX_BITS].reshape(TABLES, MAX_BITS, dim), directions[TABLES * MAX_BITS :])


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, key (null where the vector links with nothing), v (its components as doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, keys, raw = [], [], []
            for values, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                usable = values and label is not None and None not in values
                v = np.array(values if usable else [], np.float64) + 0.0
                if usable and np.isfinite(v).all() and v.any():
                    bits = v.tobytes()
                    dims.append(len(v))
                    keys.append(hashlib.blake2b(f"{label}|".encode() + bits, digest_size=16).digest())
                    raw.append(bits)
                else:
                    dims.append(None), keys.append(None), raw.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())],
                names=["vec_id", "label", "dim", "key", "v"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("vec_id", "embedding", "label").mapInArrow(
        run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, key binary, v binary"
    )


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _routed(points: DataFrame, payload: bool) -> DataFrame:
    """Rows of each point in its own cell (indexed) and in the cells of its window, for every routing table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = table.filter(pa.array(dims == dim))
                plan = plan_for(int(dim))
                unit, bits = _unit(part.column("v").to_pylist()), part.column("bits").to_numpy()
                powers = 1 << np.arange(MAX_BITS)
                used = np.arange(MAX_BITS) < bits[:, None]
                codes, masks = [], []
                for t in range(TABLES):
                    p = unit @ plan.routing[t].T
                    codes.append(((p > 0) & used) @ powers)
                    masks.append(((np.abs(p) <= plan.window) & used) @ powers)
                codes, masks = np.array(codes, np.int32), np.array(masks, np.int32)
                rows: list[tuple[int, int, int, bool]] = []
                for t in range(TABLES):
                    for r, (own, mask) in enumerate(zip(codes[t].tolist(), masks[t].tolist(), strict=True)):
                        flip = mask
                        while True:  # all subsets of the bits near a border
                            rows.append((r, t, own ^ flip, flip == 0))
                            if flip == 0:
                                break
                            flip = (flip - 1) & mask
                for lo in range(0, len(rows), 4096):
                    at, t, cell, indexed = zip(*rows[lo : lo + 4096], strict=True)
                    pick = part.take(pa.array(at))
                    columns = {
                        "t": pa.array(t, pa.int32()), "label": pick.column("label"), "dim": pick.column("dim"),
                        "cell": pa.array(cell, pa.int32()), "indexed": pa.array(indexed),
                    }
                    if payload:
                        columns |= {
                            "key": pick.column("key"), "mult": pick.column("mult"), "v": pick.column("v"),
                            "codes": pa.array([np.r_[codes[:, i], masks[:, i]].astype("<i4").tobytes() for i in at], pa.binary()),
                        }
                    yield from pa.table(columns).combine_chunks().to_batches()

    kind = points.schema["label"].dataType.simpleString()
    schema = f"t int, label {kind}, dim int, cell int, indexed boolean"
    return points.mapInArrow(run, schema + (", key binary, mult long, v binary, codes binary" if payload else ""))


def _linked(unit: pd.DataFrame, cosine: float = COSINE) -> pd.DataFrame:
    """Links of one block: per point with links, their number and a point it is connected with."""
    dim, t = int(unit["dim"].iloc[0]), int(unit["t"].iloc[0])
    plan = plan_for(dim, cosine)
    keys = np.array([bytes(k) for k in unit["key"]], dtype="V16")
    x = _unit([bytes(v) for v in unit["v"]])
    codes = np.frombuffer(b"".join(bytes(c) for c in unit["codes"]), "<i4").reshape(len(unit), 2, TABLES)
    own, mask = codes[:, 0], codes[:, 1]
    mult = unit["mult"].to_numpy()
    index, query = np.flatnonzero(unit["as_index"].to_numpy()), np.flatnonzero(unit["as_query"].to_numpy())
    links, forest = np.zeros(len(unit), np.int64), Forest(len(unit))
    name, ident = np.unique(keys, return_inverse=True)  # orders keys; a point stands in a block once
    p_index, p_query = x[index] @ plan.counting.T, x[query] @ plan.counting.T
    orders = np.argsort(p_index, axis=0, kind="stable")
    ranks = np.empty(orders.shape, np.int32)
    for j in range(PROJECTIONS):
        ranks[orders[:, j], j] = np.arange(len(index))
    step = max(16, 1_000_000 // max(1, len(index)))
    for lo in range(0, len(query), step):
        rows = query[lo : lo + step]
        count = np.zeros((len(rows), len(index)), np.int8)
        for j in range(PROJECTIONS):
            line = p_index[orders[:, j], j]
            start = np.searchsorted(line, p_query[lo : lo + step, j] - plan.window, "left")[:, None]
            end = np.searchsorted(line, p_query[lo : lo + step, j] + plan.window, "right")[:, None]
            count += (ranks[:, j] >= start) & (ranks[:, j] < end)
        q, i = np.nonzero(count >= plan.count)
        for at in range(0, len(q), 50_000):
            u, v = rows[q[at : at + 50_000]], index[i[at : at + 50_000]]
            close = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
            u, v = u[close & (ident[u] != ident[v])], v[close & (ident[u] != ident[v])]
            forth = ((own[u] ^ own[v]) & ~mask[u]) == 0  # would u find v, by table
            back = ((own[u] ^ own[v]) & ~mask[v]) == 0
            again = (forth | back)[:, :t].any(axis=1) | (back[:, t] & (ident[v] < ident[u]))
            u, v = u[~again], v[~again]
            np.add.at(links, u, mult[v])
            np.add.at(links, v, mult[u])
            forest.add(u, v)
    some = np.flatnonzero(links)
    return pd.DataFrame({
        "key": [keys[k].tobytes() for k in some], "n": links[some], "mate": [keys[forest.root[k]].tobytes() for k in some],
    })


def near_duplicates(vectors: DataFrame, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of one label (and dimension) are compared. A null label, a null or empty vector, a zero vector and one
    with null or non-finite components link with nothing: n_links 0, component_id their own vec_id, kept. Equal vectors
    link with each other; repeated rows are vectors of their own. A null vec_id takes part and is never the smallest. An
    empty table gives no rows. Other columns are not read. ``cell`` and ``block`` bound what a task compares at once and
    do not change the result.
    """
    keyed = stored(_keyed(vectors), "vectors")
    points = keyed.where("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("v").alias("v"), F.count(F.lit(1)).alias("mult")
    )
    points = stored(points, "points")
    sizes = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / cell)), F.lit(0)), F.lit(MAX_BITS)).cast("int")
    points = points.join(sizes.select("label", "dim", bits.alias("bits")), ["label", "dim"])
    where = ["t", "label", "dim", "cell"]
    crowd = _routed(points, payload=False).groupBy(where).agg(F.sum(F.col("indexed").cast("long")).alias("ni"), F.count(F.lit(1)).alias("nq"))
    crowd = crowd.where("ni > 0").select(
        *where, F.ceil(F.col("ni") / block).cast("int").alias("na"), F.ceil(F.col("nq") / (4 * block)).cast("int").alias("nb")
    )
    rows = _routed(points, payload=True).join(crowd, where)
    spot = F.xxhash64("key")
    rows = rows.withColumn("a0", F.pmod(spot, "na").cast("int")).withColumn("b0", F.pmod(F.shiftrightunsigned(spot, 20), "nb").cast("int"))
    queried = F.transform(
        F.sequence(F.lit(0), F.col("na") - 1),
        lambda a: F.struct(a.alias("a"), F.col("b0").alias("b"), F.lit(True).alias("as_query"), (F.col("indexed") & (a == F.col("a0"))).alias("as_index")),
    )
    stood = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: F.col("indexed") & (b != F.col("b0"))),
        lambda b: F.struct(F.col("a0").alias("a"), b.alias("b"), F.lit(False).alias("as_query"), F.lit(True).alias("as_index")),
    )
    rows = rows.select(*where, "key", "mult", "v", "codes", F.explode(F.concat(queried, stood)).alias("s")).select(
        *where, "key", "mult", "v", "codes", "s.*"
    )
    found = stored(rows.groupBy(*where, "a", "b").applyInPandas(lambda unit: _linked(unit), "key binary, n long, mate binary"), "links")
    roots = connected_components(found.select("key", "mate"), "key", "mate").withColumnRenamed("vertex", "key")
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    copies = stored(points.select("key", "mult"), "copies").join(links, "key", "left").join(roots, "key", "left")
    total = copies.select("key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    placed = keyed.where("key is not null").select("vec_id", "key").join(total, "key")
    lowest = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = placed.join(lowest, "root").select("vec_id", "n_links", "component_id")
    alone = keyed.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v) AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.rid AS a, y.rid AS b FROM ok x JOIN ok y ON x.label = y.label AND x.rid <> y.rid AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= {COSINE}
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach AS (SELECT a AS u, b AS v FROM l UNION SELECT u, b FROM reach JOIN l ON v = a),
low AS (SELECT u, min(vec_id) AS m FROM reach JOIN e ON e.rid = reach.v GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM e LEFT JOIN n ON n.a = rid LEFT JOIN low ON low.u = rid
"""
