"""Hard negatives by exact scores: matrix products modulo small primes, Chinese remaindering, then selection in a window.

Components are integers. Their balanced residues modulo a prime are so small that a float32 matrix product over them is exact; a few primes,
whose product exceeds twice the largest possible score, give the signed score by Chinese remaindering. How many are needed follows
from the components at hand.

Anchors are the stated query set, met with all rows in blocks: rows are dealt into stripes, a task holds one stripe at a time and lets the
blocks of anchors pass. Stripes grow with the square root of the rows, so tasks, their memory and what they hand on (a few rows for each anchor and
stripe, the same number whatever the scores) stay in balance. The first pass finds the positives among rows of the anchor's label only,
the second one the best negatives within each positive's window. Work is the number of anchors times that of rows, as the exact question demands.

Defined results: rows with a null label, identifier or vector or a null or non-finite component take no part; other rows are those with another
identifier; rows that repeat an identifier are separate, and each repeated anchor has its own results; shorter vectors count as filled up
with zeros; an anchor without positives, or a positive without negatives in its window, has no row; an empty table gives no rows; other
columns are ignored. Components beyond 2^27 after scaling, or such that a score could reach 2^49, raise ValueError.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonalframe.llm.vectors import complete, in_blocks, of_block
from tonalframe.sources.scratch import written

LEAST = -(1 << 62)


def primes_under(limit: int):
    """Primes below `limit`, the largest first."""
    for p in range(limit - 1, 2, -1):
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            yield p


def primes_for(dim: int, most: int) -> list[int]:
    """Primes whose float32 products over `dim` components are exact, enough for scores up to `most` in size."""
    half = math.isqrt((1 << 24) // max(dim, 1))  # the largest balanced residue
    found, product = [], 1
    for p in primes_under(2 * half + 2):
        if product > 2 * most:
            break
        found.append(p)
        product *= p
    if product <= 2 * most:
        raise ValueError(f"too few small primes for scores up to {most}")
    return found


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo p in -(p-1)/2 to (p-1)/2, as float32."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def remaindered(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers whose residues (exact in float32, any representatives) are given, of least size."""
    if not primes:
        return np.zeros(parts[0].shape, np.int64)
    m = math.prod(primes)
    if m < 1 << 40:  # residues times weights stay exact in float64
        total = np.zeros(parts[0].shape)
        for s, p in zip(parts, primes, strict=True):
            w = m // p * pow(m // p, -1, p) % m
            s = s - np.float32(p) * np.rint(s / np.float32(p))
            total += s.astype(np.float64) * (w if w <= m // 2 else w - m)
        return np.rint(total - m * np.rint(total / m)).astype(np.int64)
    value, step = np.zeros(parts[0].shape, np.int64), 1  # mixed radix; digits are balanced, so the value is
    for s, p in zip(parts, primes, strict=True):
        digit = (s.astype(np.int64) - value) % p * pow(step, -1, p) % p
        value += np.where(digit > p // 2, digit - p, digit) * step
        step *= p
    return value


class Side:
    """A matrix of integers and its residues, made when first asked for."""

    def __init__(self, x: np.ndarray):
        self.x, self.most, self.held = x, int(np.abs(x).max()) if x.size else 0, {}

    def residues(self, p: int) -> np.ndarray:
        if p not in self.held:
            self.held[p] = balanced(self.x, p)
        return self.held[p]


def products(a: Side, b: Side) -> np.ndarray:
    """Inner products of all rows of `a` with all of `b`, exact."""
    dim = min(a.x.shape[1], b.x.shape[1])  # beyond, the shorter one is zero
    if dim * a.most * b.most >= 1 << 49:
        raise ValueError("scores of 2^49 or more")
    primes = primes_for(dim, dim * a.most * b.most)
    if not primes:
        return np.zeros((len(a.x), len(b.x)), np.int64)
    return remaindered([a.residues(p)[:, :dim] @ b.residues(p)[:, :dim].T for p in primes], primes)


class Best:
    """For each of n queries the `top` best (score, id) seen, the highest score first, then the smallest identifier."""

    def __init__(self, n: int, top: int):
        self.score, self.id, self.top = np.full((n, top), LEAST, np.int64), np.zeros((n, top), np.int64), top

    def take(self, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Rows of `score` are queries, columns candidates with ascending `ids`, all of them larger than those of earlier calls with that score or equal."""
        fits = fits & (score > self.score[:, -1:])
        q = np.flatnonzero(fits.any(axis=1))
        if not len(q):
            return
        width = score.shape[1]
        key = np.where(fits[q], score[q] * width + np.arange(width - 1, -1, -1), LEAST * 2)  # no two alike among those that fit
        if width > self.top:
            part = np.argpartition(key, width - self.top, axis=1)[:, -self.top :]
            key = np.take_along_axis(key, part, 1)
        else:
            part = np.broadcast_to(np.arange(width), key.shape)
        s = np.where(key > LEAST * 2, np.take_along_axis(score[q], part, 1), LEAST)
        s, i = np.concatenate([self.score[q], s], 1), np.concatenate([self.id[q], ids[part]], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.top]
        self.score[q], self.id[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, identifier and score of all found."""
        q, at = np.nonzero(self.score > LEAST)
        return q, self.id[q, at], self.score[q, at]


def positives(anchors: Side, ids, labels, rows: list[tuple], top: int):
    """`rows`: sides of one label each, in the order of labels and identifiers."""
    best = Best(len(ids), top)
    for side, row_ids, row_labels in rows:
        mine = np.flatnonzero(labels == row_labels[0])
        if len(mine):
            score = products(Side(anchors.x[mine]), side)
            some = Best(len(mine), top)
            some.score, some.id = best.score[mine], best.id[mine]
            some.take(score, row_ids, row_ids[None] != ids[mine, None])
            best.score[mine], best.id[mine] = some.score, some.id
    q, i, s = best.rows()
    return q, np.zeros_like(q), i, s


def negatives(anchors: Side, ids, labels, floor: np.ndarray, ceiling: np.ndarray, rows: list[tuple], top: int):
    """`floor` and `ceiling`: for each anchor the bounds of its windows; floor above ceiling where there is none. `rows`: sides in the order of identifiers."""
    windows = floor.shape[1]
    best = [Best(len(ids), top) for _ in range(windows)]
    for side, row_ids, row_labels in rows:
        score = products(anchors, side)
        other = (row_labels[None] != labels[:, None]) & (row_ids[None] != ids[:, None])
        for w in range(windows):
            best[w].take(score, row_ids, other & (score >= floor[:, w, None]) & (score <= ceiling[:, w, None]))
    found = [(q, np.full_like(q, w), i, s) for w, b in enumerate(best) for q, i, s in [b.rows()]]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


FOUND = "anchor long, slot int, other long, score long"


def _meet(stripes: DataFrame, anchors: DataFrame, n: int, top: int, window: tuple | None, chunk: int) -> DataFrame:
    """What each stripe holds for each anchor (by its row number): its best rows of the same label, or of other labels in its windows."""
    each = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("stripe"), F.lit(1).alias("turn"), "*")
    dealt = each.unionByName(stripes.withColumn("turn", F.lit(0)), allowMissingColumns=True).repartition(4 * n, "stripe").sortWithinPartitions("stripe", "turn", "block")

    def read(r):
        return of_block(r["n"], r["kind"], r["x"]), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)

    def held(blocks: list) -> list[tuple]:
        """Sides of at most `chunk` rows, in the order of identifiers, each of one label where those matter."""
        width = max(x.shape[1] for x, _, _ in blocks)
        x = np.concatenate([np.pad(x.astype(np.int32), ((0, 0), (0, width - x.shape[1]))) for x, _, _ in blocks])
        ids, labels = (np.concatenate([b[k] for b in blocks]) for k in (1, 2))
        order = np.lexsort((ids, labels)) if window is None else np.argsort(ids, kind="stable")
        labels_in_order = labels[order]
        cuts = np.flatnonzero(np.diff(labels_in_order)) + 1 if window is None else []
        sides = []
        for part in np.split(order, cuts):
            sides += [(x[some], ids[some], labels[some]) for some in np.array_split(part, -(-len(part) // chunk))]
        return sides

    def run(batches):
        stripe, blocks, sides = None, [], None
        for p in batches:
            for r in p.to_dict("records"):
                if r["stripe"] != stripe:
                    stripe, blocks, sides = r["stripe"], [], None
                if r["turn"] == 0:
                    blocks.append(read(r))
                    continue
                if sides is None:
                    sides, blocks = held(blocks) if blocks else [], []
                if not sides:
                    continue
                x, ids, labels = read(r)
                rows = ((Side(s.astype(np.int64)), i, lab) for s, i, lab in sides)
                if window is None:
                    found = positives(Side(x), ids, labels, rows, top)
                else:
                    floor, ceiling = (np.frombuffer(r[c], np.int64).reshape(len(ids), -1) for c in ("floor", "ceiling"))
                    found = negatives(Side(x), ids, labels, floor, ceiling, rows, top)
                q, slot, other, score = found
                yield pd.DataFrame({"anchor": np.frombuffer(r["rows"], np.int64)[q], "slot": slot, "other": other, "score": score})

    return dealt.mapInPandas(run, FOUND)


def _first(found: DataFrame, top: int) -> DataFrame:
    """The `top` best of each anchor and slot over all stripes, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def hard_negatives(
    vectors: DataFrame, every: int = 100, flip: int = 7, labels: int = 10, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    chunk: int = 4096, stripe_rows: int = 0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. Identifiers divisible by `flip` first get the next of `labels` labels.

    A negative's score is from low % of its positive's to high % of it. `stripe_rows` is the number of rows that a task holds, by default 32 times the root of all."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    given = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & complete(F.col("v")))
    label = F.when(F.col("id") % flip == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")) if flip else F.col("label")
    given = given.withColumn("label", label)
    blocks = written(in_blocks(given, scale), "vectors")
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stripes = max(1, -(-total // (stripe_rows or 32 * math.isqrt(total) + 1)))
    turn = F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))  # its task and its place there
    blocks = blocks.withColumn("stripe", F.pmod(turn, F.lit(stripes)).cast("int"))

    def numbered(batches):
        for p in batches:
            for r in p.to_dict("records"):
                ids = np.frombuffer(r["ids"], np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    x, lab = of_block(r["n"], r["kind"], r["x"])[at], np.frombuffer(r["labels"], np.int64)[at]
                    rows = (r["block"] << 13) + at
                    yield pd.DataFrame({"anchor": rows, "id": ids[at], "label": lab, "x": [v.astype("<i4").tobytes() for v in x]})

    anchors = written(blocks.select("block", "n", "ids", "labels", "kind", "x").mapInPandas(numbered, "anchor long, id long, label long, x binary"), "anchors")

    def packed(batches):
        for p in batches:
            for at in range(0, len(p), 512):
                s = p.iloc[at : at + 512]
                wide = max(map(len, s["x"]))
                row = {"block": [int(s["anchor"].iloc[0])], "n": [len(s)], "kind": ["<i4"], "x": [b"".join(x.ljust(wide, b"\0") for x in s["x"])]}
                row |= {"ids": [s["id"].to_numpy(np.int64).tobytes()], "labels": [s["label"].to_numpy(np.int64).tobytes()], "rows": [s["anchor"].to_numpy(np.int64).tobytes()]}
                if "scores" in s:
                    score = np.array([np.pad(np.asarray(v, np.int64), (0, n_positives - len(v)), constant_values=LEAST) for v in s["scores"]])
                    floor = np.where(score > LEAST, -((-low * np.maximum(score, LEAST // 1000)) // 100), 1)
                    ceiling = np.where(score > LEAST, (high * np.maximum(score, LEAST // 1000)) // 100, 0)
                    row |= {"floor": [floor.tobytes()], "ceiling": [ceiling.tobytes()]}
                yield pd.DataFrame(row)

    schema = "block long, n int, kind string, x binary, ids binary, labels binary, rows binary"
    near = _first(_meet(blocks, anchors.mapInPandas(packed, schema), stripes, n_positives, None, chunk), n_positives)
    near = written(near, "positives")
    ordered = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    second = anchors.join(ordered, "anchor").mapInPandas(packed, schema + ", floor binary, ceiling binary")
    far = _first(_meet(blocks, second, stripes, n_negatives, (low, high), chunk), n_negatives)
    far = far.select("anchor", (F.col("slot") + 1).alias("of"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("anchor", F.col("rank").alias("of"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return far.join(near, ["anchor", "of"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
