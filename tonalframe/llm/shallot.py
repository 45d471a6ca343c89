"""Exact k-means over integer vectors by Shallot search.

Each vector remembers its nearest and its second-nearest centroid, an upper bound of the distance to the first and a lower bound of that to
every other. When centroids have moved, bounds move with them. Only where they no longer part the two, the vector looks again: it measures
both remembered centroids, starts from the closer one, and goes through that centroid's neighbours in the order of their distance from
it. A neighbour farther from the start than the vector's distance to the start plus that to the second-nearest one so far cannot come in,
nor can those behind it; the ball shrinks whenever a closer second is found. Survivors are compared by squared distances in integers, so
bounds, in floating point and widened by rounding, decide nothing that is close.

A round is one pass over blocks of vectors: each writes its bounds and the sums of its clusters, which Spark adds up, k * (dim + 1) numbers.
The passes shuffle no vector. A round's table replaces the one before, which is deleted.

Defined results: vectors that are null, of another length, or with a null or non-finite component take no part and have no row; ties go to
the centroid with the smaller number; null identifiers hash as empty text; rows that repeat an identifier are separate, equal hashes go by the
components; with fewer vectors than k, each is a centroid of its own start; an empty table gives no rows; other columns are ignored. A component
beyond 2^27 after scaling raises ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalframe.llm.vectors import BLOCK, NONE, complete, in_blocks, integers, of_block
from tonalframe.sources.scratch import discard, new_path

WIDER = 1 + 1e-12
STATE = BLOCK + ", near binary, second binary, upper binary, lower binary, sums array<long>"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in integers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Centres:
    """Centroids (integers), the distances between them and each one's neighbours by distance; how far each came since the last round."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, self.k = at, len(at)
        self.apart = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2).astype(float))
        others = self.apart + np.diag(np.full(self.k, np.inf))
        self.order = np.argsort(others, axis=1, kind="stable")[:, : self.k - 1]
        self.moved = np.zeros(self.k) if before is None else np.sqrt(squared(at, before).astype(float)) * WIDER

    def start(self, n: int) -> tuple:
        """Bounds that part nothing."""
        return np.zeros(n, np.int32), np.full(n, min(1, self.k - 1), np.int32), np.full(n, np.inf), np.zeros(n)

    def search(self, x: np.ndarray, near, second, upper, lower) -> tuple:
        """The exact nearest centroid of each row, and the bounds around it."""
        if self.k < 2:
            return near, second, upper, lower
        near, second = near.copy(), second.copy()
        far = np.argsort(-self.moved, kind="stable")
        upper = (upper + self.moved[near]) * WIDER
        lower = (lower - np.where(near == far[0], self.moved[far[1]], self.moved[far[0]])) / WIDER
        lower[lower < 0] = 0
        at = np.flatnonzero(upper >= lower)
        d1 = squared(x[at], self.at[near[at]])
        upper[at] = np.sqrt(d1) * WIDER
        still = upper[at] >= lower[at]
        at, d1 = at[still], d1[still]
        a, b, rows = near[at], second[at], x[at]
        d2 = squared(rows, self.at[b])
        swap = (d2 < d1) | (d2 == d1) & (b < a)
        a, b, d1, d2 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, d2, d1), np.where(swap, d1, d2)
        root, reach, known = a.copy(), np.sqrt(d1) * WIDER, b.copy()
        live = np.arange(len(at))
        for j in range(self.k - 1):
            one = self.order[root[live], j]
            inside = self.apart[root[live], one] <= (reach[live] + np.sqrt(d2[live]) * WIDER) * WIDER
            live, one = live[inside], one[inside]
            new = one != known[live]
            on, one = live[new], one[new]
            d = squared(rows[on], self.at[one])
            first = (d < d1[on]) | (d == d1[on]) & (one < a[on])
            next_ = ~first & (d < d2[on])
            to = on[first]
            b[to], d2[to], a[to], d1[to] = a[to], d1[to], one[first], d[first]
            to = on[next_]
            b[to], d2[to] = one[next_], d[next_]
        near[at], second[at] = a, b
        upper[at], lower[at] = np.sqrt(d1) * WIDER, np.sqrt(d2) / WIDER
        return near, second, upper, lower

    def sums(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of each centroid, its vectors' componentwise sum and their number, end to end."""
        out = np.zeros((self.k, x.shape[1] + 1), np.int64)
        for c in range(self.k):
            mine = x[near == c]
            out[c, :-1], out[c, -1] = mine.sum(0), len(mine)
        return out.ravel()

    def replaced(self, total: np.ndarray) -> np.ndarray:
        """floor(sum / count) for the non-empty ones."""
        total = total.reshape(self.k, -1)
        n = total[:, -1:]
        return np.where(n > 0, total[:, :-1] // np.maximum(n, 1), self.at)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.at.tolist()]


def _round(blocks: DataFrame, centres: Centres) -> DataFrame:
    """Blocks with every vector's nearest centroid, its bounds and the clusters' sums."""
    known = "near" in blocks.columns

    def rows(batches):
        for p in batches:
            for r in p.to_dict("records"):
                x = of_block(r["n"], r["kind"], r["x"])
                held = [np.frombuffer(r[c], t) for c, t in (("near", np.int32), ("second", np.int32), ("upper", float), ("lower", float))] if known else centres.start(r["n"])
                state = centres.search(x, *held)
                made = {c: [v.tobytes()] for c, v in zip(("near", "second", "upper", "lower"), state, strict=True)}
                yield pd.DataFrame({k: [r[k]] for k in ("block", "n", "ids", "labels", "kind", "x")} | made | {"sums": [centres.sums(x, state[0])]})

    return blocks.mapInPandas(rows, STATE)


def _totals(state: DataFrame, size: int) -> np.ndarray:
    found = state.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(size, np.int64)
    for r in found:
        out[r["at"]] = r["s"]
    return out


def shallot_clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 for each vector that takes part."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    given = given.where((F.size("v") == dim) & complete(F.col("v")))
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = given.select(sha.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centres = Centres(integers([r["v"] for r in first], scale))

    def kept(df: DataFrame) -> tuple[str, DataFrame]:
        path = new_path(spark, "centroids")
        df.write.option("compression", "zstd").parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    path, state = kept(in_blocks(given, scale))
    for n in range(rounds + 1 if first else 0):
        last, (path, state) = path, kept(_round(state, centres))
        discard(spark, last)
        after = centres.replaced(_totals(state, centres.k * (dim + 1))) if n < rounds else centres.at
        if (after == centres.at).all():  # so will all later rounds be
            break
        centres = Centres(after, centres.at)

    def rows(batches):
        for p in batches:
            for r in p.to_dict("records"):
                near = np.frombuffer(r["near"], np.int32)
                d = squared(of_block(r["n"], r["kind"], r["x"]), centres.at[near])
                ids = np.frombuffer(r["ids"], np.int64)
                yield pd.DataFrame({"id": pd.arrays.IntegerArray(ids.copy(), ids == NONE), "cluster": near, "distance": d})

    if not first:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = state.select("n", "ids", "kind", "x", "near").mapInPandas(rows, "id long, cluster int, distance long")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, inertia[c], sum(inertia.values()), digest) for c, digest in enumerate(centres.digests()) if c in inertia]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
