"""The pipeline's stages against brute force over the whole table."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tonalframe.llm import language_id
from test_llm_operators import brute_fingerprint, lower  # noqa: F401


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    best = {}
    for i, t in rows.items():
        best[lower(t)] = max(i, best.get(lower(t), -1))
    ids = sorted(best.values())
    fps = np.array([brute_fingerprint(rows[i]) for i in ids], np.uint64)
    comp = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            least = min(comp[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3))
            changed |= least < comp[i]
            comp[i] = least
    ids = [i for k, i in enumerate(ids) if comp[k] == k]
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in bench:
        w = word.findall(lower(t))
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    clean = []
    for i in ids:
        w = word.findall(lower(rows[i]))
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
            clean.append(i)
    got = corpus_pipeline.run(spark, data)
    assert sorted({r.doc_id for r in got.select("doc_id").distinct().collect()}) == clean
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5


def table_of(spark, folder, rows, bench=()):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumns({c: F.lit(1) for c in ("_lang", "_copy_key", "doc", "ids", "fp", "key")}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


WORDS = {
    "en": "the house and water of people from which time with great hope there was only another morning before they would leave together".split(),
    "de": "das haus und wasser der leute aus welcher zeit mit großer hoffnung gab nur einen anderen morgen bevor sie zusammen gehen würden".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_the_language_stage_rejects_what_is_far_from_all_centroids(spark, tmp_path):
    """Stage 1 against plain cosines, one document after the other, on a table with documents that must go."""
    rng = random.Random(2)
    rows = [(i, prose(rng, "en" if i % 2 else "de", 30), "en" if i % 2 else "de", "a", 1) for i in range(300)]
    rows += [(1000 + i, "これは日本語の文章です。今日は天気がいいですね。" * (1 + i % 3), None, "b", 1) for i in range(20)]
    rows += [(2000 + i, "Это совсем другой язык и другие буквы " * 3, None, "b", 1) for i in range(20)] + [(3000, None, "en", "c", 1), (3001, "", "de", "c", 1), (3002, "12 34 !!", "de", "c", 1)]
    sf_dir = table_of(spark, tmp_path / "t", rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, sf_dir).collect()}
    model = language_id.fit(docs.where(language_id.fold("doc_id", 3) != 1))
    want = set()
    for i, text, *_ in rows:
        if text and any(c.isalpha() for c in text):
            x = language_id.weigh(language_id.counts([text]).astype(np.float32), model.idf)[0]
            cosine = [float(sum(a * b for a, b in zip(x, c, strict=True))) for c in model.points.tolist()]
            k = int(np.argmax(cosine))
            if cosine[k] >= model.least[k]:
                want.add(i)
    assert kept == want == set(range(300))


def test_the_whole_chain_on_edge_rows(spark, tmp_path):
    """Null, empty, very long, tied and repeated rows, clashing columns; and an empty table, which gives no rows."""
    rng = random.Random(4)
    rows = [(i, prose(rng, "en" if i % 2 else "de", 40), "en" if i % 2 else "de", "a", 1) for i in range(120)]
    long, leak = prose(rng, "en", 20_000), prose(rng, "de", 14)
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (502, long, "en", "a", 1), (503, long, "en", "a", 1), (503, long, "en", "a", 1), (504, long + " end", None, "a", 1)]
    rows += [(505, prose(rng, "de", 30) + " " + leak, "de", "a", 1), (None, prose(rng, "en", 50), "en", "a", 1)]
    sf_dir = table_of(spark, tmp_path / "t", rows, [("i", leak), ("j", None), ("k", "")])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {500, 501, 502, 504, 505} and 503 in ids and None in ids
    assert sum(r.length for r in got if r.doc_id == 503) == {r.doc_tokens for r in got if r.doc_id == 503}.pop() > 20_000
    empty = table_of(spark, tmp_path / "e", [])
    assert corpus_pipeline.run(spark, empty).count() == 0
