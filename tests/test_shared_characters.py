"""Shared characters of all documents, against brute force."""

from collections import Counter

from tonalframe.plans import registry


def test_all_shared_characters(spark, data):
    known = set("".join(r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()))
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = Counter((r.doc_id, c) for r in docs for c in set(r.text) & known)
    got = {(r.doc_id, r.text_a): r.shared for r in registry.queries()["all_shared_characters"](spark, data).collect()}
    assert got == want and any(r.n_chars >= 200 for r in docs)
