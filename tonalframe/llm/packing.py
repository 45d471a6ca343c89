"""Sum-of-squares online packing of token ids into sequences of fixed length.

Each task packs the documents of its partition as they come, so nothing is shuffled. A document is its ids and
then an end id. What is longer than a sequence is cut into full sequences and a rest. A rest goes to the fill level
(an open window's, or a new one) that keeps the sum over levels of (number of open windows at that level)^2 least;
an array over levels holds these numbers. When the partition ends, the fullest open windows are filled with pieces
cut from the emptiest, which leaves one padded sequence for each partition at most.

Defined results: null text counts as empty (one piece, the end id); null or repeated identifiers are packed like
others, a row for each piece; an empty table gives no rows; other columns are ignored. Sequence ids hold the partition
and a count within it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalframe.llm.tokens import encoder, text_slices, tokenizer_file

COLUMNS = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class SumOfSquares:
    """Windows of `size` ids. A piece is [doc, start, ids, doc_tokens]; closed windows are handed to `close`."""

    def __init__(self, size: int, close):
        self.size, self.close = size, close
        self.count = np.zeros(size + 1, np.int64)  # the level array: open windows by fill
        self.open = [[] for _ in range(size)]

    def level(self, n: int) -> int:
        """The fill level, 0 for a new window, at which a piece of n ids raises the sum of squares least."""
        count, size = self.count, self.size
        rise = np.empty(size - n + 1, np.int64)
        rise[0] = 2 * count[n] + 1
        rise[1:] = 2 * (count[n + 1 :] - count[1 : size - n + 1]) + 2
        rise[size - n] = 1 - 2 * count[size - n]  # a window that gets full leaves the levels
        ok = count[: size - n + 1] > 0
        ok[0] = True
        best = np.flatnonzero(ok)
        return int(best[::-1][np.argmin(rise[best[::-1]])])  # the fullest of equals

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self.close([[doc, start, ids[start : start + self.size], total]])
            start += self.size
        if start == total:
            return
        rest = [doc, start, ids[start:].copy(), total]
        n = total - start
        at = self.level(n)
        window = self.open[at].pop() if at else []
        self.count[at] -= at > 0
        window.append(rest)
        if at + n == self.size:
            self.close(window)
        else:
            self.count[at + n] += 1
            self.open[at + n].append(window)

    def finish(self) -> None:
        windows = [w for level in self.open for w in level]  # by fill, ascending
        fill = lambda w: sum(len(p[2]) for p in w)
        low, high = 0, len(windows) - 1
        while low < high:
            full = windows[high]
            space = self.size - fill(full)
            while space and low < high:
                doc, start, ids, total = windows[low].pop()
                if len(ids) > space:
                    windows[low].append([doc, start, ids[:-space], total])
                    start, ids = start + len(ids) - space, ids[-space:]
                full.append([doc, start, ids, total])
                space -= len(ids)
                if not windows[low]:
                    low += 1
            if not space:
                self.close(full)
                high -= 1
        if low == high and windows[low]:
            self.close(windows[low])


def pack(
    docs: DataFrame, size: int = 2048, end_id: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, held: int = 1_000_000
) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids themselves."""
    path = path or tokenizer_file()

    def rows(batches):
        coder, out, made = encoder(path, held), [], [TaskContext.get().partitionId() << 32]

        def close(window):
            at = 0
            for doc, start, ids, total in window:
                raw = ids.tobytes()
                out.append((doc, start, len(ids), zlib.crc32(raw), total, made[0], at, raw))
                at += len(ids)
            made[0] += 1

        def taken():
            done = pd.DataFrame(out, columns=[*COLUMNS, "ids"])
            done["doc"] = done["doc"].astype("Int64")
            out.clear()
            return done if with_ids else done[COLUMNS]

        packer = SumOfSquares(size, close)
        for b in batches:
            docs, texts = b["doc"], b["text"].tolist()
            docs = [None if pd.isna(x) else int(x) for x in docs]
            for i, j in text_slices(texts, 8 * held):  # `held` pieces are cached, so it bounds a task's memory
                for doc, ids in zip(docs[i:j], coder.encode(texts[i:j]), strict=True):
                    packer.add(doc, np.append(np.frombuffer(ids, coder.dtype).astype("<u4"), np.uint32(end_id)))
                if out:
                    yield taken()
        packer.finish()
        if out:
            yield taken()

    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return given.mapInPandas(rows, schema).withColumnRenamed("doc", id_col)
