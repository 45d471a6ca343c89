"""Near-duplicates by 64-bit SimHash fingerprints, compared exactly in tiles.

Fingerprints are made by DataFrame functions: words, shingles, XXH64, and a sum for each bit (two bits share a long).
Distinct fingerprints, ordered by the population counts of their four quarters, are cut into tiles.
A pair of tiles is compared only if their ranges of population counts, of the whole and of the quarters together, come within
the radius of each other: of random fingerprints one pair in twenty. Only then do the tiles' bytes meet; inside, blocks are skipped in the same way, and
numpy's exclusive-or and bit counts decide the rest. A pair of tiles hands on a spanning forest of its links, not all of them.
Components then join over the forests, with fingerprints as nodes.

Defined results: null text counts as empty; a text without words has fingerprint zero, linked like any other; fewer words
than a shingle form one shingle; a row without identifier gets its fingerprint and the component of equal
fingerprints, null if there is none; rows that repeat an identifier are separate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalframe.llm.common import ascii_lower, free_name
from tonalframe.llm.components import connected_components
from tonalframe.sources.scratch import written

LANES = 0x0000000100000001


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, fp (long) and text_hash for each row."""
    text = F.btrim(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), text_hash(text_col).alias("text_hash"), F.split(text, "[ \\t-\\r]+").alias("w"))
    start = F.sequence(F.lit(1), F.greatest(F.size("w") - (shingle - 1), F.lit(1)))
    hashes = F.transform(start, lambda i: F.xxhash64(F.array_join(F.slice("w", i, shingle), " ")))
    hashes = F.when(F.col("w")[0] == "", F.array(F.lit(0).cast("long"))).otherwise(hashes)
    each = words.select("row", "doc", "text_hash", F.explode(hashes).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES))).alias(f"s{i}") for i in range(32)]
    by_doc = each.groupBy("row", "doc", "text_hash").agg(F.count(F.lit(1)).alias("n"), *sums)
    fp = F.lit(0).cast("long")
    for i in range(32):
        for bit, count in ((i, F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(f"s{i}", 32))):
            one = 1 << bit if bit < 63 else -(1 << 63)
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    return by_doc.select("doc", fp.alias("fp"), "text_hash")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def quarters(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of edges (a[i], b[i]) that join two parts."""
    up: dict[int, int] = {}
    keep = []

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def linked(x: np.ndarray, y: np.ndarray, radius: int, same: bool, side: int = 256):
    """Index pairs (i, j) of fingerprints at most `radius` bits apart, in parts; of one tile with itself, i < j."""

    def ranges(v):
        q, cuts = quarters(v), np.arange(0, len(v), side)
        return np.minimum.reduceat(q, cuts), np.maximum.reduceat(q, cuts)

    (low_x, high_x), (low_y, high_y) = ranges(x), ranges(y)
    gap = np.maximum(0, np.maximum(low_y[None] - high_x[:, None], low_x[:, None] - high_y[None])).sum(2)
    for r, c in np.argwhere(gap <= radius).tolist():
        if same and c < r:
            continue
        part, other = x[r * side : r * side + side], y[c * side : c * side + side]
        bits = np.bitwise_count(part[:, None] ^ other)
        if int(bits.min()) > radius:
            continue
        i, j = np.nonzero(bits <= radius)
        i, j = i + r * side, j + c * side
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def counts_of(fp: Column) -> list[Column]:
    """Population counts of the four quarters."""
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(4)]


def links(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """Edges (a, b) between fingerprints, a forest for each pair of tiles, of `distinct` (fp)."""

    def cut(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        fps = np.concatenate([b["fp"].to_numpy(np.int64) for b in parts])
        q = quarters(fps)
        for k, at in enumerate(range(0, len(fps), 2 * tile)):
            some, own = fps[at : at + 2 * tile], q[at : at + 2 * tile]
            ones = own.sum(1)
            yield pd.DataFrame({
                "tile": [(TaskContext.get().partitionId() << 24) + k], "fps": [some.tobytes()], "near": [np.unique(own[:, 0] * 17 + own[:, 1])],
                "low": [[*own.min(0), ones.min()]], "high": [[*own.max(0), ones.max()]],
            })

    def compare(batches):
        for b in batches:
            for t, u, f, g in zip(b["t"], b["u"], b["f"], b["g"], strict=True):
                x, y = np.frombuffer(f, np.int64), np.frombuffer(g, np.int64)
                found = [np.empty((0, 2), np.int64)]
                for i, j in linked(x.view(np.uint64), y.view(np.uint64), radius, t == u):
                    found.append(np.column_stack([x[i], y[j]])[forest(x[i], y[j])])
                    if len(found) > 64:
                        found = [(e := np.concatenate(found))[forest(e[:, 0], e[:, 1])]]
                e = np.concatenate(found)
                e = e[forest(e[:, 0], e[:, 1])]
                if len(e):
                    yield pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})

    n = max(1, -(-distinct.count() // tile))
    order = [*counts_of(F.col("fp")), F.col("fp")]
    tiles = distinct.select("fp").repartitionByRange(n, *order).sortWithinPartitions(*order)
    tiles = written(tiles.mapInPandas(cut, "tile long, fps binary, near array<int>, low array<int>, high array<int>"), "tiles", "uncompressed")
    # Tiles meet by the counts of their first two quarters, then all their ranges decide; a few bytes for each tile.
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(abs(i) - radius, radius - abs(i) + 1)]
    reach = F.array_distinct(F.flatten(F.transform("near", lambda x: F.array(*[x + 17 * i + j for i, j in steps]))))
    left = tiles.select(F.col("tile").alias("t"), F.col("low").alias("t_low"), F.col("high").alias("t_high"), F.explode(reach).alias("at"))
    right = tiles.select(F.col("tile").alias("u"), F.col("low").alias("u_low"), F.col("high").alias("u_high"), F.explode("near").alias("at"))
    gap = lambda k: F.greatest(F.col("u_low")[k] - F.col("t_high")[k], F.col("t_low")[k] - F.col("u_high")[k], F.lit(0))
    close = (gap(0) + gap(1) + gap(2) + gap(3) <= radius) & (gap(4) <= radius) & (F.col("t") <= F.col("u"))
    pairs = left.join(right, "at").where(close).select("t", "u").distinct()
    first = tiles.select(F.col("tile").alias("t"), F.col("fps").alias("f"))
    other = tiles.select(F.col("tile").alias("u"), F.col("fps").alias("g"))
    return pairs.join(first, "t").join(other, "u").mapInPandas(compare, "a long, b long")


def _grouped(docs: DataFrame, radius: int, shingle: int, tile: int, id_col: str, text_col: str) -> DataFrame:
    """doc, text_hash, fp and component_id for each row."""
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(fps.where("doc is not null").groupBy("fp").agg(F.min("doc").alias("rep")), "distinct-fingerprints")
    roots = connected_components(links(distinct, radius, tile))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp", "left").select("doc", "text_hash", "fp", "component_id")


def simhash_groups(
    docs: DataFrame, radius: int = 3, shingle: int = 3, tile: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, fingerprint (hex) and component_id for each row of `docs`."""
    found = _grouped(docs, radius, shingle, tile, id_col, text_col)
    return found.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 3, shingle: int = 3, tile: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose component has a smaller identifier; rows go by identifier and text, so that another text under
    a repeated identifier is judged by itself. Rows without an identifier stay, and so do all that repeat both of the one that stays."""
    found = _grouped(docs, radius, shingle, tile, id_col, text_col)
    id_name, hash_name = free_name(docs, "_gone_id"), free_name(docs, "_gone_hash")
    gone = found.where(F.col("doc") > F.col("component_id")).select(F.col("doc").alias(id_name), F.col("text_hash").alias(hash_name)).distinct()
    return docs.join(gone, (F.col(id_col).cast("long") == F.col(id_name)) & (text_hash(text_col) == F.col(hash_name)), "left_anti")
