"""Language identification by nearest centroids.

A text becomes a vector of hashed byte bigrams and trigrams (lower-cased, anything but letters as space), weighted by
sqrt(count) and inverse document frequency and scaled to length one. Each language has several centroids, found by
spherical k-means. The nearest centroid by cosine names the language; a text whose cosine falls below the language's
limit is rejected.

Document frequencies come from all training rows. Only k-means sees a bounded sample: about `sample` rows in all,
spread over the languages, picked by a hash of the row, at a rate set by the number of different texts. Its vectors are all that reaches the driver.

Defined results: a text that is null or without letters is `und` with score 0 and rejected; so is every text if there is nothing
to learn from; null identifiers train; repeated rows are rated alike; an empty table gives no rows; other columns are ignored.
Ties go to the first language by name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonalframe.llm.common import free_name
from tonalframe.llm.tokens import text_slices

DIM = 4096

_letter = np.full(256, 32, np.uint8)
_letter[97:123] = np.arange(97, 123)
_letter[65:91] = np.arange(97, 123)
_letter[128:] = np.arange(128, 256)


def counts(texts: list[str]) -> np.ndarray:
    """Gram counts, a row of DIM for each text."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, text in enumerate(texts):
        raw = np.frombuffer(f" {text} ".lower().encode(), np.uint8)
        b = _letter[raw].astype(np.uint32)
        b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]  # one space for several
        two = b[:-1] * 257 + b[1:]
        three = two[:-1] * 263 + b[2:] + 1
        codes = np.concatenate([two, three])
        codes ^= codes >> np.uint32(12)
        out[row] = np.bincount(codes & np.uint32(DIM - 1), minlength=DIM)
    return out


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids at most; each starts at the row farthest from those before."""
    starts = [int(np.argmax(x @ x.mean(0)))]
    while len(starts) < min(k, len(x)):
        near = (x @ x[starts].T).max(1)
        if near.min() > 1 - 1e-6:
            break
        starts.append(int(np.argmin(near)))
    c = x[starts]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


class Model:
    """langs (sorted), idf, and for each centroid its language and the least cosine that is accepted."""

    def __init__(self, langs: list[str], idf: np.ndarray, points: np.ndarray, of: np.ndarray, least: np.ndarray):
        self.langs, self.idf, self.points, self.of, self.least = langs, idf, points, of, least

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        cos = weigh(counts(texts), self.idf) @ self.points.T
        best = np.argmax(cos, axis=1)
        score = np.clip(cos[np.arange(len(best)), best].astype(float), 0, 1)
        return [self.langs[i] for i in self.of[best]], score, score < self.least[best]


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 1200, per_lang: int = 3, lenient: float = 0.5, most: float = 0.12) -> Model | None:
    """Learns from all rows of `train` with a language and letters. The least cosine accepted is `lenient` times the
    least in the sample and `most` at most: short texts are far from any centroid and still clean."""
    rows = train.where(F.col(lang_col).isNotNull() & has_letter(text_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Copies of a text are picked together, so rates go by the number of different texts.
    different = rows.groupBy("lang", F.xxhash64("text", "lang").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: (r["n"], r["texts"]) for r in different.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).collect()}
    if not sizes:
        return None
    each = max(4 * per_lang, sample // len(sizes))

    def frequencies(batches):
        df = np.zeros(DIM, np.int64)
        for b in batches:
            texts = b["text"].tolist()
            for i, j in text_slices(texts, 1_000_000):
                for k in range(i, j, 512):
                    df += (counts(texts[k : min(k + 512, j)]) > 0).sum(0)
        yield pd.DataFrame({"gram": np.arange(DIM), "n": df})

    df = np.zeros(DIM)
    for r in rows.select("text").mapInPandas(frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        df[r["gram"]] = r["n"]
    idf = np.log((1 + sum(n for n, _ in sizes.values())) / (1 + df)).astype(np.float32) + 1

    def vectors(batches):
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                yield pd.DataFrame({"lang": [lang], "v": [np.sqrt(counts([text])[0]).astype(np.float16).tobytes()]})

    part = F.create_map(*[x for k, (_, n) in sizes.items() for x in (F.lit(k), F.lit(math.ceil(each / n * (1 << 20))))])
    picked = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < part[F.col("lang")]).distinct()
    found = picked.mapInPandas(vectors, "lang string, v binary").groupBy("v", "lang").agg(F.count(F.lit(1)).alias("n"))
    by_lang: dict[str, list] = {}
    for r in found.orderBy(F.xxhash64("v")).limit(4 * each * len(sizes)).collect():
        by_lang.setdefault(r["lang"], []).append(np.frombuffer(r["v"], np.float16))
    langs = sorted(by_lang)
    if not langs:
        return None
    points, of, least = [], [], []
    for k, lang in enumerate(langs):
        x = weigh(np.stack(by_lang[lang]).astype(np.float32) ** 2, idf)
        c = centroids(x, per_lang)
        points.append(c)
        of += [k] * len(c)
        least += [min(most, lenient * float((x @ c.T).max(1).min()))] * len(c)
    return Model(langs, idf, np.concatenate(points), np.array(of), np.array(least))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple = ("lang_pred", "score", "rejected")) -> DataFrame:
    """`docs` with three more columns: the language, the cosine to its nearest centroid, and whether that is too low."""
    ok_name = free_name(docs, "_has_letter")

    def rows(batches):
        for b in batches:
            texts, ok = b.column(text_col).to_pylist(), b.column(ok_name).to_pylist()
            lang, score, out = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
            at = np.flatnonzero(ok) if model else []
            for k in range(0, len(at), 512):
                some = at[k : k + 512]
                lang[some], score[some], out[some] = model.predict([texts[i] for i in some])
            b = b.drop_columns([ok_name])
            more = [pa.array(lang, pa.string()), pa.array(score), pa.array(out)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)])
    return docs.withColumn(ok_name, has_letter(text_col)).mapInArrow(rows, schema)


def drop_rejected(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose language is not known."""
    names = tuple(free_name(docs, x) for x in ("_lang", "_cosine", "_rejected"))
    return identify(docs, model, text_col, names).where(~F.col(names[2])).drop(*names)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the identifier as text, modulo n; a missing identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, **options) -> DataFrame:
    """id, held_out, lang_pred, score, rejected; what is held out is not learned from."""
    model = fit(docs.where(fold(id_col, folds) != held), text_col, lang_col, **options)
    given = docs.select(F.col(id_col), (fold(id_col, folds) == held).alias("held_out"), F.col(text_col).alias("_text"))
    return identify(given, model, "_text").drop("_text")
