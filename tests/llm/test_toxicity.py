"""Toxicity: held-out accuracy with misspellings never seen, the linear shortcut against the model as it is written down, awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonalframe.llm import toxicity as tox

BAD = ["horrible", "nasty", "vile", "wretched"]
PLAIN = "the of and river stone green walk morning table house window letter quiet road water light paper garden early small".split()


def text(rng, bad, n=None):
    words = [rng.choice(PLAIN) for _ in range(n or rng.randint(3, 120))]
    for w in bad:
        words.insert(rng.randint(0, len(words)), w)
    return " ".join(words)


def misspelt(rng, w):
    i = rng.randrange(1, len(w) - 1)
    return rng.choice([w[:i] + w[i] + w[i:], w[:i] + w[i + 1 :], w[:i] + "*" + w[i + 1 :]])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(i, text(rng, [rng.choice(BAD) for _ in range(2)] if i % 6 == 0 else []), int(i % 6 == 0)) for i in range(900)]


@pytest.fixture(scope="module")
def model(corpus):
    return tox.Model().fit([t for _, t, _ in corpus], np.array([y for _, _, y in corpus]))


def test_chance_is_the_softmax_of_the_strongest_average(model):
    rng = random.Random(1)
    texts = [text(rng, ["vile"] * (i % 3), n=1 + i) for i in range(12)] + ["x", "ünïcödé 𝒳 !!!"]

    def average(words):
        grams = [tox.Bags([w], model.buckets).grams for w in words]
        return np.mean([model.e[g].mean(0) for g in grams], 0) if words else np.zeros(model.e.shape[1])

    for t, got in zip(texts, model.chance(texts), strict=True):
        words = tox.words_of(t)
        windows = [words[i : i + model.window] for i in range(max(1, len(words) - model.window + 1))]
        logits = [model.w @ average(w) + model.b for w in windows]
        assert got == pytest.approx(max(np.exp(x[1]) / np.exp(x).sum() for x in logits), abs=1e-5)


def test_grams_are_those_of_the_word(model):
    """Equal n-grams of different words share their places, others hardly any."""
    alone = {w: set(tox.Bags([w], 1 << 16).grams.tolist()) for w in ("horrible", "horribel", "garden")}
    bags = tox.Bags(list(alone), 1 << 16)
    for k, w in enumerate(alone):
        got = bags.grams[bags.start[k] : bags.start[k + 1]].tolist()
        marked = f"<{w}>"
        assert len(got) == sum(len(marked) - n + 1 for n in tox.SIZES) and set(got) == alone[w]
    assert len(alone["horrible"] & alone["horribel"]) >= 9 and not alone["horrible"] & alone["garden"]


def test_misspellings_never_seen(model):
    rng = random.Random(9)
    clean = [text(rng, []) for _ in range(300)]
    bad = [text(rng, [rng.choice(BAD)]) for _ in range(300)]
    odd = [text(rng, [misspelt(rng, rng.choice(BAD)) for _ in range(2)]) for _ in range(300)]
    long = [text(rng, [rng.choice(BAD)], n=20_000) for _ in range(3)]
    assert (model.chance(clean) < 0.5).mean() >= 0.99
    assert (model.chance(bad) >= 0.5).mean() >= 0.97 and (model.chance(odd) >= 0.5).mean() >= 0.8 and (model.chance(long) >= 0.5).all()


def test_query_over_awkward_rows(spark, corpus):
    extra = [(2000, None), (2001, ""), (2002, " \n\t"), (None, corpus[0][1]), (6, corpus[1][1]), (2003, "vile " * 50_000), (2004, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus] + extra, "doc_id long, text string")
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "toxic", "held_out", "score", "predicted", "quality")]).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus] + [(0, 0), (None, 1), (7, None), (5000, 1)], "doc_id long, toxic int").withColumn("text", F.lit("no text"))
    rows = tox.toxicity(docs, labels, slice_chars=10_000).collect()
    assert len(rows) == len(corpus) + len(extra)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    truth = {i: y for i, _, y in corpus if i != 6}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.98
    by_id = {r.doc_id: r.score for r in rows if r.doc_id != 6}
    assert by_id[2000] == by_id[2001] == by_id[2002] == pytest.approx(sum(truth.values()) / len(truth), abs=0.02) and by_id[2003] > 0.5
    assert by_id[None] == pytest.approx(by_id[0])


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (2, None)], 0.0)])
def test_without_two_classes(spark, labels, score):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert [r.score for r in tox.toxicity(docs, known, folds=1, held=1).collect()] == [score] * 4
    assert tox.toxicity(docs.where("false"), known).count() == 0


def test_sample_is_bounded(spark, corpus):
    docs = spark.createDataFrame([(i % 30, f"{t} {i}") for i, t, _ in corpus], "doc_id long, text string")  # many texts under one identifier
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    rows, share = tox.labelled(docs, labels, 40, "doc_id", "text", "toxic")
    assert share == 0.5 and len(rows) == 40 and sum(r.toxic for r in rows) == 20
