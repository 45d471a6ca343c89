"""Stages and states that judge rows by their content: repeated and missing identifiers, repeated deliveries, spans of any length."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from tonalframe.llm import exact_dedup, lm_scoring, personal_data, simhash, token_store, winnowing

A = "one two three four five six seven eight nine ten eleven twelve"
OTHER = "a wholly different text that shares nothing with the first one at all and goes on for some words more"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("broadcast_words", [2_000_000, 0])
def test_contaminated_rows_go_by_text(spark, broadcast_words):
    bench = spark.createDataFrame([(1, A), (2, "short item"), (None, OTHER), (3, None)], "item_id long, text string")
    rows = [(1, "clean"), (1, f"x {A} y"), (None, f"x {A} y"), (2, f"x {A} y"), (None, "fine"), (3, None), (4, "a SHORT item!"), (5, OTHER)]
    got = winnowing.drop_contaminated(docs_of(spark, rows), bench, broadcast_words=broadcast_words).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, "clean"), (None, "fine"), (3, None), (5, OTHER)])


def test_benchmark_of_any_size_gives_the_same_rows(spark):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(25)] + [(3, "w1 w2 w3"), (90, "same " * 40)]
    rows = [(i % 50, " ".join([rng.choice(pool) for _ in range(rng.randint(0, 60))] + items[rng.randrange(25)][1].split()[: rng.randint(0, 25)])) for i in range(80)] + [(99, "same " * 3000), (None, None)]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    by_size = [Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in winnowing.contamination(docs, bench, broadcast_words=w).collect()) for w in (10**9, 0)]
    assert by_size[0] == by_size[1] and sum(n for k, n in by_size[0].items() if k[2]) > 20


def test_repeated_words_are_linear():
    began = time.time()
    assert winnowing.shared_runs([b"a"] * 40_000, [b"a"] * 20_000, 10) == [(0, 40_000)]
    assert time.time() - began < 3


def test_near_copies_go_by_row(spark):
    rows = [(1, A), (5, A.upper()), (5, OTHER), (None, A), (7, A), (7, None), (8, "")]
    got = simhash.drop_near_copies(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, A), (5, OTHER), (None, A), (7, None)])


def test_known_words_fill_the_step_that_no_longer_fits(spark):
    counts = spark.createDataFrame([(f"w{i:03}".encode(), 5) for i in range(160)] + [(b"z", 900), (b"x" * 65, 999)], "word binary, c long")
    got = sorted(bytes(r.word) for r in lm_scoring._known(counts, 100).collect())
    assert got == [*(f"w{i:03}".encode() for i in range(99)), b"z"]
    assert lm_scoring._known(counts, 1000).count() == 161 and lm_scoring._known(counts.where("false"), 5).count() == 0


def test_a_batch_sent_again_counts_once(spark, tmp_path):
    df, where = docs_of(spark, [(1, "a"), (2, "A"), (3, "b")]), f"file://{tmp_path}"
    for _ in range(2):
        got = exact_dedup.exact_dedup(df, state_dir=where, batch="day-1").collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]
    got = exact_dedup.exact_dedup(docs_of(spark, [(9, "a")]), state_dir=where, batch="day-2").collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in got] == [(9, 9, 3)]


def test_locator_is_asked_of_the_schema(spark, tmp_path):
    docs_of(spark, [(1, "a")]).write.parquet(f"{tmp_path}/t")
    held = spark.read.parquet(f"{tmp_path}/t")
    assert held.select(exact_dedup.located(held).alias("x")).first().x.endswith("#0")
    made = docs_of(spark, [(1, "a")])
    assert made.select(exact_dedup.located(made).alias("x")).first().x == ""


def test_separators_do_not_hide_a_number():
    card = ".".join("4242424242424242")
    assert (personal_data.CARD, 3, 3 + len(card)) in personal_data.candidates(f"is {card} ok")
    wide = " - ".join(["4242", "4242", "4242", "4242"])
    assert (personal_data.CARD, 0, len(wide)) in personal_data.candidates(wide)


def test_many_spans_are_chosen_in_time():
    rng = np.random.default_rng(1)
    n = 60_000
    start = rng.integers(0, 10 * n, n)
    found = np.column_stack([rng.integers(0, 4, n), start, start + rng.integers(1, 30, n)])
    chance, base = np.round(rng.random(n), 2), np.array([[0, 5, 60], [1, 40, 50], [3, 55, 90]])
    began = time.time()
    got = personal_data.choose(found, chance, base, np.full(n, 0.5))
    assert time.time() - began < 5
    some = 400
    got = personal_data.choose(found[:some], chance[:some], base, np.full(some, 0.5))
    taken, want = [(s, e) for _, s, e in base.tolist()], []
    for i in sorted(range(some), key=lambda i: (-chance[i], found[i, 1], i)):
        k, s, e = found[i].tolist()
        if chance[i] >= 0.5 and all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            want.append((k, s, e))
    assert got == want


def test_tokens_of_equal_identifiers_keep_their_places(spark):
    rows = [(None, f"text {i % 3}") for i in range(40)] + [(5, "x"), (5, "a longer text"), (1, "")]
    got = token_store.round_trip(docs_of(spark, rows).repartition(4)).orderBy("start").collect()
    assert len(got) == 43 and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
