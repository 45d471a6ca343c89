"""Benchmark decontamination by winnowing.

A fingerprint is the least hash of k consecutive words in each sliding window of w of them, so any shared run of
k + w - 1 = `span` words or more shares a fingerprint at the same place in both texts. Fingerprints of documents are
joined with those of benchmark items, each hit is extended over equal words to both sides, and an extension of `span`
words or more is a match. Items shorter than `span` are fingerprinted by the hash of all their words, and
documents at every place with as many words.

The benchmark goes to the tasks as a broadcast only after its size was measured (`broadcast_words`); beyond that,
fingerprints of different texts are joined, and each pair of a text and an item is compared once. Both ways give the same rows.

Defined results: null text has no words; items without words or without identifier match nothing; items that repeat an
identifier count once; documents that repeat an identifier are separate rows, of which `drop_contaminated` judges each by its text; empty tables give no rows or
no hits; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalframe.llm.common import free_name
from tonalframe.llm.tokens import text_slices
from tonalframe.sources.scratch import written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: digits, letters a-z, all beyond ASCII
K = 5

_is_word = np.zeros(256, bool)
_is_word[48:58] = _is_word[65:91] = _is_word[97:123] = _is_word[128:] = True
_value = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)
_value[65:91] = _value[97:123]  # A-Z as a-z
_BASE, _STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word in UTF-8 bytes; equal words have equal hashes."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _is_word[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64), first
    # Polynomial in the place within the word, modulo 2^64: byte values times powers, summed by word.
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw)))) if first[0] == 0 else None
    if place is None:
        place = np.arange(len(raw))
        place[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(raw))))
    longest = int((end - first).max())
    power = np.cumprod(np.full(longest + 1, _BASE, np.uint64))
    value = np.where(inside[1:-1], _value[raw] * power[np.minimum(place, longest)], np.uint64(0))
    return mixed(np.add.reduceat(value, first)), first


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = words[:n].copy()
    for i in range(1, k):
        total = total * _STEP + words[i : i + n]
    return mixed(total)


def selected(grams: np.ndarray, w: int) -> np.ndarray:
    """Places that winnowing keeps: the last least hash of each window of w."""
    n = len(grams) - w + 1
    if n < 1:
        return np.empty(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for i in range(1, w):
        other = grams[i : i + n]
        less = other <= best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + i
    return np.unique(at)


def extend(doc: list[bytes], item: list[bytes], p: int, q: int, k: int) -> tuple[int, int]:
    """Start and end, in `doc`, of the longest run of equal words around doc[p:p+k] and item[q:q+k]; empty if these differ."""
    if doc[p : p + k] != item[q : q + k]:
        return p, p
    a, b = p, p + k
    while a and a - p + q and doc[a - 1] == item[a - 1 - p + q]:
        a -= 1
    while b < len(doc) and b - p + q < len(item) and doc[b] == item[b - p + q]:
        b += 1
    return a, b


class Index:
    """Fingerprints of items. items: (id, words); short: lengths under `span` that occur."""

    def __init__(self, items: list[tuple[int, list[bytes]]], span: int):
        self.span, self.items, self.places = span, items, {}
        for n, (_, words) in enumerate(items):
            for length, place, h in fingerprints(hashed(words), span, {len(words)} if len(words) < span else set()):
                self.places.setdefault((length, h), []).append((n, place))
        self.short = {len(w) for _, w in items if 0 < len(w) < span}
        self.keys = {k: np.sort(np.array([h for n, h in self.places if n == k], np.uint64)) for k in {n for n, _ in self.places}}

    def matches(self, doc: list[bytes], hits: list[tuple[int, int, int]]) -> tuple[int, set[int]]:
        """Words hit and items matched, from hits (length, place, hash) of one document."""
        hit, found, done = np.zeros(len(doc) + 1, np.int32), set(), {}
        for length, p, h in hits:
            for n, q in self.places[length, h]:
                if p < done.get((n, p - q), 0):  # inside a run that was extended already
                    continue
                item = self.items[n][1]
                a, b = extend(doc, item, p, q, length)
                done[n, p - q] = b
                if b - a >= min(self.span, len(item)):
                    hit[a] += 1
                    hit[b] -= 1
                    found.add(self.items[n][0])
        return int((np.cumsum(hit) > 0).sum()), found


def hashed(words: list[bytes]) -> np.ndarray:
    return word_hashes(np.frombuffer(b" ".join(words), np.uint8))[0]


def fingerprints(words: np.ndarray, span: int, short: set[int]):
    """(length, place, hash): winnowed k-grams, and for each length in `short` the grams of that length."""
    k = min(K, span)
    grams = gram_hashes(words, k)
    for p in selected(grams, span - k + 1).tolist():
        yield k, p, int(grams[p])
    for n in sorted(short):
        for p, h in enumerate(gram_hashes(words, n).tolist()):
            yield n, p, h


def batch_hits(texts: list[str], index: Index) -> tuple[np.ndarray, dict[int, list]]:
    """Number of words of each text, and of the texts with fingerprints of the index these as (length, place, hash)."""
    parts = [x.encode() for x in texts]
    starts = np.cumsum([0] + [len(x) + 1 for x in parts])
    hashes, first = word_hashes(np.frombuffer(b" ".join(parts), np.uint8))
    border = np.searchsorted(first, starts)  # of each text, its first word
    k, hits = min(K, index.span), {}
    for n in {*index.keys}:
        keys = index.keys[n]
        grams = gram_hashes(hashes, n)
        # Places whose hash is in the index; for winnowed ones it suffices to look at these and then at their windows.
        at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)] == grams)
        doc = np.searchsorted(border, at, "right") - 1
        inside = at + n <= border[np.minimum(doc + 1, len(border) - 1)]
        at, doc = at[inside], doc[inside]
        if n == k and n not in index.short:
            own = {d: set(selected(grams[border[d] : border[d + 1] - n + 1], index.span - n + 1).tolist()) for d in set(doc.tolist())}
            keep = [p - border[d] in own[d] for p, d in zip(at.tolist(), doc.tolist(), strict=True)]
            at, doc = at[keep], doc[keep]
        for p, d in zip(at.tolist(), doc.tolist(), strict=True):
            hits.setdefault(d, []).append((n, p - int(border[d]), int(grams[p])))
    return np.diff(border), hits


RESULT = "doc long, n_words long, n_hit long, items array<string>"


def _by_broadcast(given: DataFrame, index: Index) -> DataFrame:
    def rows(batches):
        for b in batches:
            texts = b["text"].tolist()
            for i, j in _slices(texts):
                some = texts[i:j]
                n_words, hits = batch_hits(some, index)
                n_hit, found = np.zeros(j - i, np.int64), [[] for _ in some]
                for d, h in hits.items():
                    n_hit[d], ids = index.matches(words_of(some[d]), h)
                    found[d] = sorted(ids)
                yield pd.DataFrame({"doc": b["doc"].iloc[i:j].astype("Int64"), "n_words": n_words, "n_hit": n_hit, "items": found})

    return given.mapInPandas(rows, RESULT)


def _slices(texts: list[str], most: int = 1_000_000):
    return text_slices(texts, most)


def shared_runs(doc: list[bytes], item: list[bytes], span: int) -> list[tuple[int, int]]:
    """Start and end in `doc` of what windows of the item cover: `span` words, or the whole of a shorter item. Linear in both."""
    n = min(span, len(item))
    windows = {b" ".join(item[q : q + n]) for q in range(len(item) - n + 1)}
    out: list[tuple[int, int]] = []
    for p in range(len(doc) - n + 1):
        if b" ".join(doc[p : p + n]) in windows:
            if out and p <= out[-1][1]:
                out[-1] = (out[-1][0], p + n)
            else:
                out.append((p, p + n))
    return out


def _runs(given: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """For a benchmark of any size: key (see `_text_key`), items and what these cover of the text, for each different text that has a hit.

    Fingerprints meet in a join, one row for each text, item and hash, however often the hash occurs in either; a hash of many texts and items is a
    skewed key, which adaptive execution splits. Each pair of a text and an item is then looked at once, in time linear in both."""
    lengths = items.select(F.least(F.col("n"), F.lit(span)).alias("n")).where(f"n > 0 and n < {span}").distinct()
    short = {r["n"] for r in lengths.collect()}  # under `span` numbers

    def prints(own: bool):
        def rows(batches):
            for b in batches:
                for key, text in zip(b["key"], b["text"], strict=True):
                    words = words_of(text)
                    sizes = short if not own else {len(words)} & short
                    got = {(length, h) for length, _, h in fingerprints(hashed(words), span, sizes)}
                    if got:
                        length, h = zip(*got, strict=True)
                        yield pd.DataFrame({"key": key, "length": length, "hash": np.array(h, np.uint64).view(np.int64)})

        return rows

    texts = given.select(_text_key("text").alias("key"), "text")
    schema = "key string, length int, hash long"
    theirs = items.select(F.col("item").cast("string").alias("key"), "text").mapInPandas(prints(True), schema).withColumnRenamed("key", "item")
    mine = texts.mapInPandas(prints(False), schema).distinct()  # a text that many documents have meets once
    pairs = mine.join(theirs, ["length", "hash"]).select("key", "item").distinct()
    met = written(pairs, "fingerprint-pairs")
    once = texts.join(met.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))

    def runs(batches):
        for b in batches:
            for key, item_id, text, item_text in zip(b["key"], b["item"], b["text"], b["item_text"], strict=True):
                if out := shared_runs(words_of(text), words_of(item_text), span):
                    yield pd.DataFrame({"key": [key], "item": [item_id], "a": [[x for x, _ in out]], "z": [[x for _, x in out]]})

    joined = met.join(once, "key").join(items.select("item", F.col("text").alias("item_text")), "item")
    found = joined.mapInPandas(runs, "key string, item string, a array<long>, z array<long>")
    return found.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("z")).alias("z"))


def _text_key(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _by_shuffle(given: DataFrame, items: DataFrame, span: int) -> DataFrame:
    def summed(batches):
        for b in batches:
            n_words, n_hit = [], []
            for text, a, z in zip(b["text"], b["a"], b["z"], strict=True):
                n_words.append(len(words_of(text)))
                hit = np.zeros(n_words[-1] + 1, np.int32)
                if a is not None:
                    np.add.at(hit, np.asarray(a, np.int64), 1)
                    np.add.at(hit, np.asarray(z, np.int64), -1)
                n_hit.append(int((np.cumsum(hit) > 0).sum()))
            yield pd.DataFrame({"doc": b["doc"].astype("Int64"), "n_words": n_words, "n_hit": n_hit, "items": [[] if x is None else list(x) for x in b["items"]]})

    keyed = given.withColumn("key", _text_key("text"))
    return keyed.join(_runs(given, items, span), "key", "left").mapInPandas(summed, RESULT)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    """Items (item, text, n) with words, and how many words they have together."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    words = F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    items = items.withColumn("n", F.size(F.filter(words, lambda x: x != ""))).where("n > 0")
    return items, items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _index(items: DataFrame, span: int) -> Index:
    return Index([(r["item"], words_of(r["text"])) for r in items.orderBy("item").collect()], span)


def contamination(
    docs: DataFrame, benchmark: DataFrame, span: int = 10, broadcast_words: int = 2_000_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """id, n_words, n_hit, n_items, items (sorted as strings), items_sha256, contaminated for each row of `docs`."""
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items, total = _items(benchmark, item_col, item_text_col)
    found = _by_broadcast(given, _index(items, span)) if total <= broadcast_words else _by_shuffle(given, items, span)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        F.col("doc").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, span: int = 10, broadcast_words: int = 2_000_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """`docs` without the rows whose text shares a run of words with a benchmark item, whatever their identifiers; nothing is shuffled for a benchmark that can be broadcast."""
    items, total = _items(benchmark, item_col, item_text_col)
    if total > broadcast_words:
        gone = _runs(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), items, span).select(F.col("key").alias(name := free_name(docs, "_text_key")))
        return docs.join(gone, _text_key(text_col) == F.col(name), "left_anti")
    index = _index(items, span)

    def rows(batches):
        for b in batches:
            texts = [x or "" for x in b.column(text_col).to_pylist()]
            clean = np.ones(len(texts), bool)
            for i, j in _slices(texts):
                for d, h in batch_hits(texts[i:j], index)[1].items():
                    clean[i + d] = not index.matches(words_of(texts[i + d]), h)[0]
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(rows, docs.schema)
