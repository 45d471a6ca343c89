"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5, with marks at both ends), hashed into a table of embeddings; a window of neighbouring words
is the average of its words' bags; a softmax over two classes reads that average. A text is as toxic as its most toxic window, so
one insult in a long text counts as much as in a short one. Embeddings and softmax are trained jointly in numpy by gradients through the
window that decides each text. In training, n-grams of toxic windows are left out at random, so that parts of a word come to suffice: a misspelling
never seen shares some n-grams with the word it is made of.

Labels: a document is toxic if any of its labels says so. The classifier is fitted on at most `sample` labelled documents outside the held-out fold,
up to half of each class, picked by a hash of identifier and text; their whole texts are what reaches the driver. Scoring covers every whole text, in
tasks, and looks each different word of a batch up once.

Defined results: a text without words (null, empty, white space) has no window; its score is the share of toxic documents among all that are labelled and not held out; null labels teach nothing, nor do rows with a
null identifier; texts with equal words get equal scores; repeated rows count once in training; with labels of one class only, or none, every score is that class's share (0
without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalframe.llm.language_id import fold
from tonalframe.llm.tokens import text_slices

SIZES = (3, 4, 5)
MARKS = string.punctuation + "…“”„«»‘’¡¿"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Bags:
    """The n-grams of different words: of word i, `grams[start[i] : start[i + 1]]`, places in a table of `buckets`."""

    def __init__(self, words: list[str], buckets: int, part: int = 8192):
        grams, sizes = [], [np.zeros(1, np.int64)]
        for i in range(0, len(words), part):
            g, n = self.of(words[i : i + part], buckets)
            grams.append(g)
            sizes.append(n)
        self.grams, self.start = np.concatenate(grams) if grams else np.zeros(0, np.int32), np.cumsum(np.concatenate(sizes))

    @staticmethod
    def of(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        bare = [f"<{w.strip(MARKS) or w}>" for w in words]
        size = np.fromiter(map(len, bare), np.int64, len(bare))
        # Each character is one number; surrogates cannot be encoded otherwise.
        flat = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word, left = np.repeat(np.arange(len(bare)), size), np.repeat(np.cumsum(size), size) - np.arange(size.sum())
        of, codes = [], []
        h = np.zeros(len(flat), np.uint64)
        for n in range(1, max(SIZES) + 1):
            # h: a hash of the n characters from each place; left: characters of the word from there on
            h = h[: len(flat) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1 :] + np.uint64(n)
            if n in SIZES:
                inside = left[: len(h)] >= n
                mixed = h[inside] ^ (h[inside] >> np.uint64(29))
                codes.append(((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32))
                of.append(word[: len(h)][inside])
        of = np.concatenate(of)
        return np.concatenate(codes)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(bare))

    def mean(self, values: np.ndarray, part: int = 16_384) -> np.ndarray:
        """The mean of `values` (a number for each place in the table) over the n-grams of each word; every word has some, as its ends are marked."""
        values, out = values.astype(np.float32), np.zeros(len(self.start) - 1, np.float32)
        for i in range(0, len(out), part):
            ends = self.start[i : i + part + 1]
            got = values[self.grams[ends[0] : ends[-1]]]
            out[i : i + part] = np.add.reduceat(got, ends[:-1] - ends[0]) / np.diff(ends)
        return out


class Texts:
    """Texts as numbers of their different words, one after the other, and the windows over them."""

    def __init__(self, texts: Iterable[str], window: int, step: int):
        number: dict[str, int] = {}
        codes = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
        self.words, size = list(number), np.array([len(c) for c in codes], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.int32), *codes])
        n = np.maximum(1, -(-(size - window) // step) + 1)  # the last window ends with the text
        self.first = np.concatenate([[0], np.cumsum(n)])
        own = np.repeat(np.arange(len(size), dtype=np.int32), n)
        k = np.arange(self.first[-1]) - self.first[own]
        offset = (np.cumsum(size) - size)[own]
        self.begin = (offset + np.maximum(0, np.minimum(k * step, size[own] - window))).astype(np.int32)
        self.end = np.minimum(self.begin + window, offset + size[own]).astype(np.int32)

    def windows(self, score: np.ndarray) -> np.ndarray:
        """The average of the words' scores in each window."""
        sums = np.concatenate([[0], np.cumsum(score[self.flat], dtype=np.float64)])
        return (sums[self.end] - sums[self.begin]) / np.maximum(self.end - self.begin, 1)

    def strongest(self, value: np.ndarray) -> np.ndarray:
        """Of each text, the first of its highest windows."""
        at = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, self.first[:-1]), np.diff(self.first)))
        own = np.searchsorted(self.first, at, "right") - 1
        return at[np.unique(own, return_index=True)[1]]

    def words_in(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows, one after the other: each word's window (as its place in `windows`) and its number."""
        n = self.end[windows] - self.begin[windows]
        return np.repeat(np.arange(len(windows)), n), self.flat[ranges(self.begin[windows], n)]


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, end to end."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Model:
    """Embeddings of n-grams and a softmax over two classes."""

    def __init__(self, buckets: int = 1 << 16, dim: int = 8, window: int = 2, step: int = 1, seed: int = 0):
        self.random = np.random.default_rng(seed)
        self.buckets, self.window, self.step = buckets, window, step
        self.e = self.random.normal(0, 0.1, (buckets, dim))
        self.w = self.random.normal(0, 0.5, (2, dim))
        self.b = np.zeros(2)
        self.share = 0.0  # the score of a text without words

    def chance(self, texts: list[str]) -> np.ndarray:
        """The softmax's second class in each text's strongest window. Averages and softmax are linear up to the last step, so every n-gram counts as one number."""
        if not texts:
            return np.zeros(0)
        t = Texts(texts, self.window, self.step)
        value = t.windows(Bags(t.words, self.buckets).mean(self.e @ (self.w[1] - self.w[0]))) if t.words else np.zeros(t.first[-1])
        found = 1 / (1 + np.exp(-(np.maximum.reduceat(value, t.first[:-1]) + self.b[1] - self.b[0])))
        return np.where(t.end[t.first[:-1]] > t.begin[t.first[:-1]], found, self.share)

    def fit(self, texts: Iterable[str], y: np.ndarray, epochs: int = 15, batch: int = 256, rate: float = 0.3, keep: float = 0.3, decay: float = 1e-4) -> Model:
        """In each epoch, every text is learnt from by its strongest window and by one at random if it is not toxic. Classes weigh alike.
        Of the n-grams in windows of toxic texts only a share `keep` is there, and counts no more than before, so that a part of a word comes to suffice."""
        t = Texts(texts, self.window, self.step)
        bags = Bags(t.words, self.buckets) if t.words else None
        if bags is None:
            return self
        weight = np.where(y == 1, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (1 - y).sum(), 1))
        squares = [np.full_like(p, 1e-6) for p in (self.e, self.w, self.b)]
        clean = np.flatnonzero(y == 0)
        for epoch in range(epochs):
            at = t.strongest(t.windows(bags.mean(self.e @ (self.w[1] - self.w[0]))))
            chance = self.random.random(len(clean)) * np.diff(t.first)[clean]
            windows, own = np.concatenate([at, t.first[clean] + chance.astype(np.int64)]), np.concatenate([np.arange(len(y)), clean])
            order = self.random.permutation(len(windows))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                self.turn(t, bags, windows[some], y[own[some]], weight[own[some]] / len(some), squares, rate * (1 - epoch / epochs), keep, decay)
        return self

    def turn(self, t: Texts, bags: Bags, windows, y, weight, squares, rate, keep, decay) -> None:
        own, word = t.words_in(windows)
        n = bags.start[word + 1] - bags.start[word]
        # What each n-gram adds to the average of its window.
        part = np.repeat(1 / (t.end[windows] - t.begin[windows])[own] / np.maximum(n, 1), n)
        window, gram = np.repeat(own, n), bags.grams[ranges(bags.start[word], n)]
        part *= (y[window] == 0) | (self.random.random(len(gram)) < keep)
        average = np.column_stack([np.bincount(window, self.e[gram, d] * part, len(windows)) for d in range(self.e.shape[1])])
        logits = average @ self.w.T + self.b
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = (p - np.eye(2)[y]) * weight[:, None]
        back = slope @ self.w
        rows, inverse = np.unique(gram, return_inverse=True)
        g_e = np.column_stack([np.bincount(inverse, back[window, d] * part, len(rows)) for d in range(self.e.shape[1])])
        steps = ((rows, g_e + decay * self.e[rows]), (..., slope.T @ average + decay * self.w), (..., slope.sum(0)))
        for value, square, (where, g) in zip((self.e, self.w, self.b), squares, steps, strict=True):
            square[where] += g**2
            value[where] -= rate * g / np.sqrt(square[where])


def labelled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> tuple[list, float]:
    """At most `sample` rows (toxic, text), up to half of each class, and the share of toxic documents among all labelled ones."""
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = given.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = []
    for c in (1, 0):  # bounded, so broadcast to the texts
        ids = F.broadcast(known.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(sample))
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        rows = texts.join(ids, "id").groupBy("id", "text").agg(F.max("toxic").alias("toxic"))
        classes.append(rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text").limit(sample // 2).select("toxic", "text").collect())
    return [r for rows in classes for r in rows], n.get(1, 0) / max(sum(n.values()), 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model | float:
    """The model, or the share of toxic documents where there is one class only."""
    rows, share = labelled(docs, labels, sample, id_col, text_col, label_col)
    y = np.array([r["toxic"] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return float(y.max(initial=0))
    model = Model().fit((r["text"] for r in rows), y, **options)
    model.share = share
    return model


def toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, slice_chars: int = 500_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options
) -> DataFrame:
    """id, held_out, score and predicted for each row of `docs`."""
    known = labels.where(fold(id_col, folds) != held)
    model = fit(docs, known, id_col=id_col, text_col=text_col, label_col=label_col, **options)

    def rows(batches):
        for b in batches:
            texts, score = b["text"].tolist(), np.zeros(len(b))
            for i, j in text_slices(texts, slice_chars):
                score[i:j] = model.chance(texts[i:j]) if isinstance(model, Model) else model
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "held_out": b["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    given = docs.select(F.col(id_col).cast("long").alias("id"), (fold(id_col, folds) == held).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInPandas(rows, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
