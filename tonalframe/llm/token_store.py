"""Token ids on disk: frequency-ranked values in byte-aligned variable-length code, control bytes apart from data bytes.

Writing: texts become ids once (a compressed scratch table), all ids are counted and ranked by frequency, the
documents are range-partitioned by identifier, and each partition writes blocks. A value takes one to four bytes;
two bits in a control stream say how many, four values to a control byte. Blocks are rows of a Parquet table (Spark
commits it as a whole and any store holds it), beside a table `ranks` with one row for each id that occurs, at most
the tokenizer's vocabulary. Reading: numpy looks up each control byte's four lengths in a table of 256 rows.

Defined results: null text counts as empty (the end id alone); null identifiers come first; rows that repeat an identifier
are separate documents, in the order of their ids; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.llm.tokens import encoder, text_slices, tokenizer_file
from tonalframe.sources.scratch import new_path, written

BLOCK_IDS = 1 << 18
BLOCK_SCHEMA = "shard long, first long, docs array<long>, sizes array<long>, control binary, data binary"


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    raw = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    more = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = raw[np.arange(4) <= more[:, None]]
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = more
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values behind encode_values."""
    lengths_of = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
    length = lengths_of[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length) - length
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    values = np.zeros(n, np.uint32)
    for k in range(4):
        has = length > k
        values[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def token_table(docs: DataFrame, end_id: int, path: str, id_col: str, text_col: str) -> DataFrame:
    """doc and its ids, little-endian, in two bytes each where the vocabulary allows."""

    def rows(batches):
        coder = encoder(path)
        wide = "<u4" if end_id >= 1 << 16 else coder.dtype
        end = np.array([end_id], wide).tobytes()
        for b in batches:
            texts = b["text"].tolist()
            for i, j in text_slices(texts):
                ids = [(x if wide == coder.dtype else np.frombuffer(x, coder.dtype).astype(wide).tobytes()) + end for x in coder.encode(texts[i:j])]
                yield pd.DataFrame({"doc": b["doc"].iloc[i:j].astype("Int64"), "width": int(wide[2]), "ids": ids})

    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInPandas(rows, "doc long, width int, ids binary")


def count_ids(tokens: DataFrame) -> DataFrame:
    """How often each id occurs, over all rows."""

    def rows(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            for width, some in b.groupby("width")["ids"]:
                n = np.bincount(np.frombuffer(b"".join(some), f"<u{width}"))
                if len(n) > len(total):
                    total = np.pad(total, (0, len(n) - len(total)))
                total[: len(n)] += n
        has = np.flatnonzero(total)
        yield pd.DataFrame({"id": has, "n": total[has]})

    return tokens.select("width", "ids").mapInPandas(rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, where: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts under `where`, in ascending order of identifiers."""
    spark = docs.sparkSession
    tokens = written(token_table(docs, end_id, path or tokenizer_file(), id_col, text_col), "tokens")
    # At most the vocabulary, some 50,000 rows, whatever the number of documents.
    ids = np.array([r["id"] for r in count_ids(tokens).orderBy(F.desc("n"), "id").collect()], np.int64)
    ranks = pd.DataFrame({"rank": np.arange(len(ids)), "id": ids})
    spark.createDataFrame(ranks, "rank long, id long").coalesce(1).write.parquet(f"{where}/ranks")
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))

    def blocks(batches):
        shard, first, held, docs, sizes, values = TaskContext.get().partitionId(), 0, 0, [], [], []

        def one_block():
            control, data = encode_values(rank_of[np.frombuffer(b"".join(values), f"<u{width}")])
            return pd.DataFrame({"shard": [shard], "first": [first], "docs": [docs], "sizes": [sizes], "control": [control], "data": [data]})

        for b in batches:
            for doc, width, ids in zip(b["doc"], b["width"], b["ids"], strict=True):  # one width in all rows
                docs.append(None if pd.isna(doc) else int(doc))
                sizes.append(len(ids) // width)
                values.append(ids)
                held += len(ids) // width
                if held >= BLOCK_IDS:
                    yield one_block()
                    first, docs, sizes, values, held = first + held, [], [], [], 0
        if docs:
            yield one_block()

    ordered = tokens.repartitionByRange("doc", F.xxhash64("ids")).sortWithinPartitions("doc", "ids")
    ordered.mapInPandas(blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{where}/blocks")


def read_tokens(spark: SparkSession, where: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row for each document in the files: id, start, n_tokens, ids_crc32; with_ids adds the ids, little-endian in four bytes."""
    ranks = spark.read.parquet(f"{where}/ranks").orderBy("rank").collect()  # the vocabulary at most
    id_of = np.array([r["id"] for r in ranks], np.uint32)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{where}/blocks")
    index = blocks.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # One row for each file: how many ids come before it.
    starts, before = {}, 0
    for r in index.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():
        starts[r["shard"]], before = before, before + r["n"]

    def rows(batches):
        for b in batches:
            for shard, first, docs, sizes, control, data in zip(b["shard"], b["first"], b["docs"], b["sizes"], b["control"], b["data"], strict=True):
                ends = np.cumsum(sizes)
                ids = id_of[decode_values(control, data, int(ends[-1]))].astype("<u4")
                raw = [ids[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
                out = {
                    "doc": pd.array([None if pd.isna(x) else int(x) for x in docs], "Int64"),
                    "start": starts[shard] + first + ends - sizes,
                    "n_tokens": sizes,
                    "ids_crc32": [zlib.crc32(x) for x in raw],
                }
                yield pd.DataFrame(out | {"ids": raw} if with_ids else out)

    schema = "doc long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return blocks.mapInPandas(rows, schema).withColumnRenamed("doc", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    where = new_path(docs.sparkSession, "token-files")
    write_tokens(docs, where, end_id, path, id_col, text_col)
    return read_tokens(docs.sparkSession, where, id_col)
