"""Vectors as rows of integers: which take part, and blocks of them in which tasks compute."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components lie within this, so that squared distances and products of up to 256 components fit a long.
LARGEST = 1 << 27
NONE = -(1 << 63)
BLOCK = "block long, n int, ids binary, labels binary, kind string, x binary"


def complete(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(vectors, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; shorter vectors are filled up with zeros."""
    vectors = list(vectors)
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        out = np.array(vectors, np.float64).reshape(len(vectors), width)
    else:
        out = np.zeros((len(vectors), width))
        for row, v in zip(out, vectors, strict=True):
            row[: len(v)] = v
    out = np.floor(scale * out)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component times {scale} exceeds {LARGEST}")
    return out.astype(np.int64)


def to_block(x: np.ndarray) -> tuple[str, bytes]:
    """The narrowest type that holds `x`, and its bytes."""
    kind = "<i2" if not x.size or np.abs(x).max() < 1 << 15 else "<i4"
    return kind, x.astype(kind).tobytes()


def of_block(n: int, kind: str, x: bytes) -> np.ndarray:
    return np.frombuffer(x, kind).reshape(n, -1).astype(np.int64) if n else np.zeros((0, 0), np.int64)


def in_blocks(rows: DataFrame, scale: int, size: int = 4096) -> DataFrame:
    """Blocks of at most `size` rows of `rows` (id, label: long, v: array<double>), made by each task of its own rows.
    A null identifier or label is held as the least long, NONE."""

    def pack(batches):
        k, held, count = TaskContext.get().partitionId() << 32, [], 0

        def one(some):
            nonlocal k
            kind, x = to_block(integers(some["v"], scale))
            k += 1
            ids, labels = (some[c].fillna(NONE).to_numpy(np.int64).tobytes() for c in ("id", "label"))
            return pd.DataFrame({"block": [k], "n": [len(some)], "ids": [ids], "labels": [labels], "kind": [kind], "x": [x]})

        for b in batches:
            held.append(b.astype({"id": "Int64", "label": "Int64"}))
            count += len(b)
            if count >= size:
                all_ = pd.concat(held)
                for at in range(0, count - size + 1, size):
                    yield one(all_.iloc[at : at + size])
                held = [all_.iloc[count - count % size :]]
                count %= size
        if count:
            yield one(pd.concat(held))

    return rows.select("id", "label", "v").mapInPandas(pack, BLOCK)
