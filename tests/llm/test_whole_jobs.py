"""Cases in which operators once left out a part of their job."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonalframe.llm import exact_dedup, language_id, line_dedup, lm_scoring, personal_data, simhash, tokens


def test_runs_meet_the_first_document_that_has_them(spark):
    one, two = "a b c d e f", "g h i j k l"
    long = [f"{x} has ten words or more of its own to be a block" for x in "AB"]
    rows = [(1, one), (2, two), (3, f"{one}\n{two}"), (4, f"{one}\n{two}"), (11, "\n".join(long[::-1])), (12, "\n".join(long)), (13, "\n".join(long))]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4].text == "" and list(got[4].partners) == [3] and got[3].n_deleted == 0
    assert got[13].text == "" and 12 in got[13].partners and got[12].n_deleted == 1


def test_every_line_of_a_long_shared_run_is_met():
    rng = np.random.default_rng(0)
    for _ in range(300):
        words = dict(enumerate(rng.integers(1, 12, rng.integers(1, 9)).tolist()))
        met = {x + i for x, n in [*line_dedup.runs(words, 10), *[(x, 1) for x in words]] if sum(words[x + i] for i in range(n)) >= 10 for i in range(n)}
        assert met == (set(words) if sum(words.values()) >= 10 else set())


def test_gaps_and_repeated_lines_are_aligned():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)).tolist() for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = line_dedup.common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        kinds = sorted({*a} & {*b})
        pairs = [([i for i, x in enumerate(a) if x == k], [j for j, y in enumerate(b) if y == k]) for k in kinds]
        got = line_dedup.patience(pairs)
        assert got == line_dedup.patience(pairs[::-1]) and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    # every line repeats: the two copies are aligned whole
    assert line_dedup.patience([([0, 2], [0, 2]), ([1, 3], [1, 3])]) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_the_language_model_learns_from_every_training_document(spark, monkeypatch):
    seen, trained = [], lm_scoring._trained
    monkeypatch.setattr(lm_scoring, "_trained", lambda rows, *a: (seen.append(rows.count()), trained(rows, *a))[1])
    df = spark.createDataFrame([(i, f"text number {i} of many") for i in range(60)], "doc_id long, text string")
    held = [r.held_out for r in lm_scoring.lm_scores(df, in_model=20, known=60).collect()]
    assert len(seen) == len(lm_scoring.TURNS) and sum(seen) == held.count(False) < 60


def test_a_language_of_many_copies_stays_in_the_model(spark):
    copies = spark.range(200_000).select(F.lit("hier steht immer wieder der gleiche Satz").alias("text"), F.lit("de").alias("lang"))
    few = spark.createDataFrame([(f"der Satz Nummer {i} ist nicht wie die anderen", "de") for i in range(50)] + [(f"this is sentence {i} of the others", "en") for i in range(50)], "text string, lang string")
    assert language_id.fit(copies.union(few)).langs == ["de", "en"]
    assert language_id.fit(copies).langs == ["de"]


def test_spelled_addresses_are_proposed_in_any_form():
    for form in ("jane (AT) host.com", "jane [AT] host.com", "jane ( at ) host.com", "jane at host (dot) com", "jane at host[dot]com", "jane at host.com", "jane [at] host [DOT] com"):
        assert (personal_data.EMAIL, 5, 5 + len(form)) in personal_data.candidates(f"mail {form}"), form
    assert not personal_data.wrong(personal_data.EMAIL, "jane (AT) host DOT com")


def test_spelled_addresses_are_those_of_the_whole_pattern():
    whole = re.compile(r"[A-Za-z0-9._%+-]+" + personal_data._rest, re.I)
    rng = np.random.default_rng(2)
    bits = np.array(["a", "b.c", " at ", " At ", "(at)", "[ at ]", " ", ".", " dot ", "[dot]", "x" * 70, "-", "é"])
    for _ in range(5000):
        t = "".join(rng.choice(bits, rng.integers(0, 16)))
        assert personal_data.spelled(t) == [m.span() for m in whole.finditer(t)], t


def test_the_encoder_agrees_with_the_library():
    """The tokenizer's own call on whole texts, special tokens spelled in a text included."""
    from tokenizers import Tokenizer

    library, coder, rng = Tokenizer.from_file(tokens.tokenizer_file()), tokens.Encoder(tokens.tokenizer_file(), held=50, longest=5), random.Random(3)
    some = ["a", "b", " ", "  ", "\n", "\t", " the", "'s", "'", "’", " ", "é", "ж", "1", "22", ".", ",", "\x85", "ª", "<|endoftext|>", "<|", "日本", "‍", "Word", " Word", "\r\n"]
    for _ in range(40):
        texts = ["a <|endoftext|> b", "", *("".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(100))]
        want = [np.array(library.encode(x, add_special_tokens=False).ids, coder.dtype).tobytes() for x in texts]
        assert coder.encode(texts) == want


def test_tiles_link_all_near_fingerprints(spark):
    """Many tiles of random fingerprints with planted near ones, against all pairs."""
    rng = np.random.default_rng(11)
    x = rng.integers(-(2**63), 2**63, 1500, dtype=np.int64)
    flips = np.array([[1 << int(b) for b in rng.integers(0, 63, 3)] for _ in range(500)], np.int64)
    x = np.unique(np.concatenate([x, x[:500] ^ flips[:, 0], x[:250] ^ flips[:250, 0] ^ flips[:250, 1] ^ flips[:250, 2], [0, -1, 1, 7, 15]]))
    a, b = np.nonzero(np.bitwise_count(x.view(np.uint64)[:, None] ^ x.view(np.uint64)[None]) <= 3)
    df = spark.createDataFrame([(int(v),) for v in x], "fp long")
    for tile in (20, 5000):
        found = [(r.a, r.b) for r in simhash.links(df, 3, tile).collect()]
        assert all((i ^ j).bit_count() <= 3 for i, j in ((i & (2**64 - 1), j & (2**64 - 1)) for i, j in found))
        assert parts(found) == parts(zip(x[a].tolist(), x[b].tolist(), strict=True))


def parts(edges):
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for i, j in edges:
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)
    sets = {}
    for v in up:
        sets.setdefault(top(v), set()).add(v)
    return sorted(sorted(s) for s in sets.values() if len(s) > 1)


def test_a_repeated_identifier_keeps_its_fingerprints_apart(spark):
    one, two = "one text of some words here", "quite another story about nothing at all"
    df = spark.createDataFrame([(1, one), (1, two), (2, one), (3, two)], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(df).collect()}
    assert len(got) == 4 and set(got.values()) == {1}
    df = spark.createDataFrame([(5, one), (5, two), (2, one)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect()) == [(2, 2), (5, 2), (5, 5)]


def crc(text):
    return F.crc32(F.substring(text.cast("binary"), 1, 3)).cast("string").cast("binary")  # collides on purpose


@pytest.mark.parametrize("digest", [exact_dedup.sha256, crc])
def test_the_state_holds_from_batch_to_batch_and_over_a_restart(spark, tmp_path, digest):
    texts = ["abc one", "ABC one", "abc two", "", None, "x", "X", "abc one", "abc", "y"]
    batches, seen = [list(enumerate(texts[:5])), [], [(i + 5, t) for i, t in enumerate(texts[5:])], [(20, "abc two"), (21, "new")]], []
    for n, batch in enumerate(batches):
        seen += batch
        session = spark.newSession() if n == 2 else spark  # nothing but the folder is carried over
        df = session.createDataFrame(batch, "doc_id long, text string")
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, digest=digest, state_dir=f"file://{tmp_path}/state").collect()}
        equal = lambda i, t, seen=seen: [j for j, x in seen if (x or "").lower() == (t or "").lower()]
        assert got == {i: (max(equal(i, t)), len(equal(i, t)), i == max(equal(i, t))) for i, t in batch}


def test_locators_name_file_and_row(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i % 3}") for i in range(9)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    rows = docs.select("doc_id", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("at")).collect()
    at = {r.doc_id: r["at"] for r in rows}
    assert all(r.locator == at[r.keep_id] for r in exact_dedup.exact_dedup(docs).collect())


def test_added_spans_on_planted_forms(spark):
    """Recall and precision of what the model adds to the patterns, on forms planted in other texts than those it learnt from."""
    rng, rows, planted = random.Random(8), [], {}
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(3, 20)))
    for i in range(600):
        name, host = word(), f"{word()}.{rng.choice(['com', 'org', 'net'])}"
        phone = f"+{rng.randint(1, 99)} {rng.randint(200, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}"
        if i % 3 == 0:  # what the patterns find, to learn from
            rows.append((i, f"{prose()} write to {name}@{host} or call {phone} {prose()} version {rng.randint(1, 9)}.{rng.randint(0, 99)}.{rng.randint(300, 999)}.{rng.randint(0, 9)}"))
        elif i % 3 == 1:
            form = rng.choice([f"{name} (at) {host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} at {host.replace('.', ' dot ')}"])
            head = f"{prose()} contact "
            rows.append((i, f"{head}{form} , {prose()}"))
            planted[i] = f"email:{len(head)}:{len(head) + len(form)}"
        else:  # nothing personal
            rows.append((i, f"{prose()} look at {word()} . {prose()} in 1998-2004 , {rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(300, 999)} {prose()} {word()}@"))
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(planted[i] in got[i] for i in planted)
    wrong = sum(len(got[i] - {planted.get(i)}) for i in range(600) if i % 3)
    assert hit >= 0.9 * len(planted) and wrong <= 0.05 * hit, (hit, wrong)


def test_numbers_in_long_runs_are_proposed():
    run = " ".join(str(1000 + i) for i in range(500))
    found = personal_data.candidates(f"{run} 4111.1111.1111.1111 {run}")
    at = len(run) + 1
    assert (personal_data.CARD, at, at + 19) in found and len(found) < 30_000
    assert (personal_data.EMAIL, 0, 405) in personal_data.candidates("a" * 100 + "@" + "b" * 300 + ".com x")


def test_line_dedup_against_all_pairs(spark):
    """Every later document aligned with every earlier one that shares a line: what is deleted, and how much of it is found."""
    rng = random.Random(17)
    pool = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) + str(rng.randrange(40)) for _ in range(rng.randint(2, 14))) for _ in range(30)]
    docs = []
    for i in range(60):
        lines, at = [], 0
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.6 and docs:  # a run of another document
                other = docs[rng.randrange(len(docs))]
                at = rng.randrange(len(other))
                lines += other[at : at + rng.randint(1, 5)]
            else:
                lines += [rng.choice(pool) if rng.random() < 0.4 else f"own line {i} {rng.random()}" for _ in range(rng.randint(1, 3))]
        docs.append(lines)
    rows = [(i, "\n".join(x)) for i, x in enumerate(docs)]
    got = {r.doc_id: set(r.deleted) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {}
    for i, lines in enumerate(docs):
        want[i] = set()
        for other in docs[:i]:
            shared = [([x for x, y in enumerate(lines) if y == line], [x for x, y in enumerate(other) if y == line]) for line in dict.fromkeys(lines) if line in other]
            for block in line_dedup.blocks(line_dedup.patience(shared)):
                if sum(len(lines[x].split()) for x in block) >= 10:
                    want[i].update(block)
    found, due = sum(len(got[i] & want[i]) for i in want), sum(map(len, want.values()))
    extra = sum(len(got[i] - want[i]) for i in want)
    assert due > 100 and found >= 0.97 * due and extra <= 0.01 * due, (found, due, extra)
