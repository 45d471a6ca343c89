"""Operators on vectors against brute force in Python integers: nulls, ties, repeats, other lengths, clashing columns, empty tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonalframe.llm import residues, shallot
from tonalframe.llm.vectors import in_blocks, integers

NAN, INF = float("nan"), float("inf")


def clustered(n, dim, seed, centres=5, spread=0.3):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 1, (centres, dim))
    return np.round(at[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, dim)), 3).tolist()


def awkward(dim):
    return [(901, None, 1), (902, [], 1), (903, [0.5] * (dim - 1), 2), (904, [0.5] * (dim + 1), 2), (905, [NAN] + [0.0] * (dim - 1), 3), (906, [INF] * dim, 3), (907, [None] + [0.1] * (dim - 1), 4), (908, [-INF] * dim, None)]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.select("*", *[F.lit(7).alias(c) for c in ("id", "v", "n", "x", "block", "near", "rank", "anchor", "stripe", "cluster", "distance", "h")]).repartition(parts)


def plain_kmeans(rows, k, rounds, scale, seed):
    """rows: (id, vector). Ids, and for each row cluster and distance; centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [c for _, c in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], centres


@pytest.mark.parametrize(("k", "rounds", "n", "scale"), [(8, 10, 300, 1024), (5, 3, 40, 8), (8, 10, 5, 64), (1, 2, 9, 16), (2, 4, 60, 4)])
def test_shallot_against_plain_kmeans(spark, k, rounds, n, scale):
    dim = 6
    rows = list(enumerate(clustered(n, dim, k + n)))
    rows += [(n + i, rows[i % n][1]) for i in range(n // 3)] + [(3, rows[0][1]), (None, rows[1][1])]  # copies, a repeated identifier, none
    df = frame(spark, [(i, v, 0) for i, v in rows] + awkward(dim))
    got = shallot.shallot_clusters(df, k=k, rounds=rounds, dim=dim, scale=scale).collect()
    want, centres = plain_kmeans(rows, k, rounds, scale, "3")
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    sums = Counter()
    for _, c, d in want:
        sums[c] += d
    assert all(r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values()) for r in got)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest() for r in got)


def test_shallot_search_is_exact_over_rounds():
    """The bounds of one round after the other never hide a nearer centroid, ties included, and spare most distances."""
    rng = np.random.default_rng(2)
    x = np.array(integers(clustered(2000, 8, 4, spread=0.2), 40))
    at = x[rng.choice(len(x), 12, replace=False)]
    at[5] = at[2]  # two centroids in one place
    centres, state, looked = shallot.Centres(at), None, []
    squared = shallot.squared
    for _ in range(6):
        state = centres.start(len(x)) if state is None else state
        measured = [0]

        def counting(a, b, measured=measured):
            measured[0] += len(a)
            return squared(a, b)

        shallot.squared = counting
        state = centres.search(x, *state)
        shallot.squared = squared
        looked.append(measured[0])
        plain = ((x[:, None] - centres.at[None]) ** 2).sum(2)
        assert (state[0] == plain.argmin(1)).all()
        centres = shallot.Centres(centres.replaced(centres.sums(x, state[0])), centres.at)
    assert looked[-1] < 0.5 * 12 * len(x)


def test_empty_vectors(spark):
    for rows in ([], awkward(6)):
        df = frame(spark, rows)
        assert shallot.shallot_clusters(df, dim=6).count() == 0
    assert residues.hard_negatives(frame(spark, [])).count() == 0
    assert residues.hard_negatives(frame(spark, [(100, [1.0, 2.0], 3)])).count() == 0


def test_too_large_components(spark):
    with pytest.raises(ValueError):
        integers([[1e300]], 2)
    with pytest.raises(ValueError):
        residues.products(residues.Side(np.full((1, 4), 1 << 26)), residues.Side(np.full((1, 4), 1 << 26)))


@pytest.mark.parametrize("dim", [1, 2, 64, 200, 300])
@pytest.mark.parametrize("most", [0, 1, 9, 148, 5000, 1 << 20])
def test_products(dim, most):
    rng = np.random.default_rng(dim + most)
    a, b = rng.integers(-most, most + 1, (7, dim)), rng.integers(-most, most + 1, (50, dim))
    a[0], b[0], b[1] = most, most, -most  # the largest score of either sign
    if dim * most**2 < 1 << 49:
        want = a.astype(object) @ b.T.astype(object)
        assert (residues.products(residues.Side(a), residues.Side(b)) == want).all()


def test_remaindering_in_mixed_radix():
    primes = residues.primes_for(64, 1 << 58)
    values = np.array([0, 1, -1, (1 << 58) - 7, -(1 << 58), 123_456_789_012_345])
    assert residues.remaindered([np.array([int(v) % p for v in values], np.float32) for p in primes], primes).tolist() == values.tolist()
    assert all(64 * (p // 2) ** 2 <= 1 << 24 for p in primes)


def plain_negatives(rows, scale=256, every=100, flip=7):
    kept = [(i, (lab + 1) % 10 if i % flip == 0 else lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows]
    out = []
    for i, lab, v in kept:
        if i % every:
            continue
        others = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, m, w in kept if j != i]
        for ps, p in sorted((s, j) for s, j, m in others if m == lab)[:5]:
            fit = sorted((s, j) for s, j, m in others if m != lab and 80 * -ps <= 100 * -s <= 100 * -ps)[:5]
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(fit)]
    return out


@pytest.mark.parametrize(("every", "chunk", "stripe_rows"), [(10, 16, 40), (3, 4096, 0)])
def test_hard_negatives_against_brute_force(spark, every, chunk, stripe_rows):
    random.seed(3)
    vectors = clustered(240, 5, 8)
    rows = [(i, v, random.choice([1, 1, 1, 2, 3, 9])) for i, v in enumerate(vectors)]
    rows += [(240 + i, vectors[0], i % 4) for i in range(60)]  # a third of all, as large copies go, in ties
    rows += [(400, [0.25], 1), (401, [], 1), (402, [0.5] * 8, 2), (30, vectors[5], 2), (404, [0.0] * 5, 1), (410, [0.0] * 5, 1)]  # other lengths, a repeated anchor, scores of 0
    bad = [(903, None, 2), (905, [NAN] * 5, 3), (906, [INF] * 5, 3), (907, [None, 0.1], 4), (908, [0.1] * 5, None), (None, vectors[0], 1)]
    got = residues.hard_negatives(frame(spark, rows + bad, 7), every=every, chunk=chunk, stripe_rows=stripe_rows).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(plain_negatives(rows, every=every))


def test_blocks_hold_every_row(spark):
    df = frame(spark, [(i, v, i % 3) for i, v in enumerate(clustered(100, 3, 1))], 3).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    rows = in_blocks(df, 10, size=8).collect()
    ids = np.concatenate([np.frombuffer(r.ids, np.int64) for r in rows])
    assert sorted(ids.tolist()) == list(range(100)) and max(r.n for r in rows) == 8 and len({r.block for r in rows}) == len(rows)
