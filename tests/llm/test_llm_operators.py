"""Each operator against a brute-force version or a round trip, over awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tonalframe.llm import common, exact_dedup, gru, html_text, language_id, line_dedup, lm_scoring, packing, personal_data, simhash, token_store, tokens, winnowing

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
EN = "The quick brown fox jumps over the lazy dog while the other foxes watch from the hill and wait for the night to come."
DE = "Der schnelle braune Fuchs springt über den faulen Hund und die anderen Füchse schauen vom Hügel aus zu und warten auf die Nacht."
ROWS = [
    (1, EN, "en"), (2, EN.upper(), "en"), (3, DE, "de"), (4, None, "en"), (5, "", None), (6, "   \n\t ", "de"), (7, LONG, "en"), (8, EN + " extra words at the end", "en"), (9, "1234 5678 !!", None),
    (10, "Ärger ÄRGER ärger", "de"), (11, "ÄRGER Ärger äRGER", "de"), (12, DE, "de"), (13, "line one is here with many words in it for all to see\nsecond\n" + EN, "en"),
    (14, "other\nline one is here with many words in it for all to see\nsecond\nlast", "en"), (15, "mail ann.lee@host.example.com or +1 (212) 555-0199, card 4242 4242 4242 4242, ip 10.0.0.255 and 10.0.0.256", "en"),
    (None, "no id here", "en"), (16, "a b　c <|endoftext|> it's", "en"), (17, "x", "en"), (3, DE, "de"),
]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns whose names operators use themselves."""
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, lang string, row long")
    return df.select("doc_id", "text", "lang", "row", *[F.lit(1).alias(c) for c in ("id", "doc", "key", "digest", "score", "held", "start", "ids", "url", "_has_letter", "_copy_key", "h", "n", "word")]).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def lower(t):
    return (t or "").translate(LOWER)


def test_ascii_lower(spark, docs):
    assert all(r.x == (r.text and lower(r.text)) for r in docs.select("text", common.ascii_lower(F.col("text")).alias("x")).collect())


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 0), lambda c: F.length(c).cast("string").cast("binary")])
def test_exact_dedup(docs, none, digest):
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(lower(t), []).append(i)
    want = Counter((i, max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, _ in ROWS)
    rows = exact_dedup.exact_dedup(docs, digest=digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_drop_copies(docs, none):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({lower(t) for _, t, _ in ROWS})
    assert exact_dedup.drop_copies(none).count() == 0


def test_line_dedup(docs, none):
    got = {(r.doc_id, r.row): r for r in line_dedup.line_dedup(docs.withColumnRenamed("row", "r")).withColumn("row", F.lit(0)).collect()}
    assert got[14, 0].text == "other\nlast" and list(got[14, 0].partners) == [13] and got[14, 0].n_deleted == 2
    assert got[13, 0].text.startswith("line one") and EN not in got[13, 0].text and list(got[13, 0].partners) == [1]
    assert got[1, 0].text == EN and got[12, 0].text == "" and got[3, 0].text == DE and got[4, 0].text == "" and got[6, 0].text == ROWS[5][1]
    assert line_dedup.line_dedup(docs).count() == len(ROWS) and line_dedup.line_dedup(none).count() == 0


def test_patience():
    # a b c d against b a c d: c d stay aligned with one of the crossed lines
    pairs = [([0], [1]), ([1], [0]), ([2], [2]), ([3], [3])]
    assert [a for a, _ in line_dedup.patience(pairs)][-2:] == [2, 3]
    assert line_dedup.blocks([(0, 5), (1, 6), (3, 7), (4, 8)]) == [[0, 1], [3, 4]]
    assert line_dedup.patience([]) == []


def test_lm_scores(docs, none):
    rows = lm_scoring.lm_scores(docs, in_model=20, known=60).collect()
    tokens_of = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in ROWS if not held(i) for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(tokens_of(t)), sum(w in counts for w in tokens_of(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens_of(t)), 4)) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm_scoring.lm_scores(none).count() == 0


def test_lm_adds_up_to_one():
    counts, groups = np.array([50.0, 20, 10, 5, 5, 1]), np.array([7.0, 0.0, 3.0])
    v = gru.Vocabulary(counts, groups, 3)
    m = gru.Gru(v, 8)
    m.train([np.array([0, 1, 7, 2, 0]), np.array([3, 4, 5, 6, 8, 0])], 0)
    s = np.append(np.random.default_rng(0).normal(0, 1, (1, 8)), [[1.0]], axis=1).astype(np.float32)
    total = sum(math.exp(m.log_probs(s, np.array([t]))[0][0]) for t in range(9))
    assert abs(total - 1) < 1e-4


def test_gradient():
    v = gru.Vocabulary(np.array([9.0, 5, 4, 2]), np.array([3.0, 1.0]), 2)
    m = gru.Gru(v, 5, seed=3)
    m.p = {k: x.astype(np.float64) for k, x in m.p.items()}
    docs, grads, back = [np.array([1, 2, 5, 0, 3, 0])], {}, m.back
    m.back = lambda block, d, kept, g: (back(block, d, kept, g), grads.update({k: x.copy() for k, x in g.items()}))
    before = {k: x.copy() for k, x in m.p.items()}
    m.train(docs, 0, window=10, lanes=1, rate=0.0)
    m.p = before
    for key, at in [("U", (1, 7)), ("U", (2, 3)), ("X", (1, 3)), ("Wc", (2, 1)), ("Wk", (0, 1)), ("Wc", (5, 1)), ("X", (5, 8))]:
        x = m.p[key][at]
        m.p[key][at] = x + 1e-3
        up = m.score(docs, 0, lanes=1)[0]
        m.p[key][at] = x - 1e-3
        down = m.score(docs, 0, lanes=1)[0]
        m.p[key][at] = x
        assert abs((up - down) / 2e-3 - grads[key][at]) < 1e-3 + 0.02 * abs(grads[key][at]), key


@pytest.mark.parametrize("fan", [2, 64])
def test_models_are_averaged_in_bounded_groups(spark, fan):
    rng, rows, parts = np.random.default_rng(0), [], {}
    for shard in (0, 3, 5, 9, 20, 21):
        w = float(rng.integers(1, 9))
        for chunk in range(3):
            v = rng.normal(size=5).astype(np.float32)
            rows.append((shard, chunk, w, bytearray(v.tobytes())))
            parts.setdefault(chunk, []).append((w, v))
    got = {r["chunk"]: np.frombuffer(r["values"], np.float32) for r in lm_scoring._averaged(spark.createDataFrame(rows, lm_scoring.PARTS), fan)}
    assert len(got) == 3 and all(np.allclose(got[c], sum(w * v for w, v in x) / sum(w for w, _ in x), atol=1e-5) for c, x in parts.items())


def test_state_runs_through_whole_documents():
    v = gru.Vocabulary(np.array([9.0, 5, 4, 2]), np.array([3.0]), 2)
    m = gru.Gru(v, 5)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5, n) for n in (300, 1, 7, 64, 65, 128)]
    whole = m.score(docs, 0, window=1000, lanes=2)
    assert np.allclose(whole, m.score(docs, 0, window=3, lanes=4), rtol=1e-4)
    assert np.allclose(whole, [m.score([d], 0)[0] for d in docs], rtol=1e-4)
    assert np.allclose(whole, [plain_score(m, d, 0) for d in docs], rtol=1e-4)


def plain_score(m, doc, start):
    """One token after the other, without lanes, blocks or classes sorted."""
    n, p, v, h, total, x = m.hidden, m.p, m.v, np.zeros(m.hidden), 0.0, start
    for t in doc:
        g = h @ p["U"]
        f = 1 / (1 + np.exp(-(p["X"][x, :n] + g[:n])))
        h = h + f * (np.tanh(p["X"][x, n:] + f * g[n:]) - h)
        s = np.append(h, 1)
        c = int(v.class_of[t])
        e = s @ p["Wc"]
        total += e[c] - np.log(np.exp(e).sum())
        if t < v.words:
            e = s @ p["Wk"][:, v.low[c] : v.high[c]]
            total += e[t - v.low[c]] - np.log(np.exp(e).sum())
        x = t
    return total


def test_scores_end_to_end(docs, monkeypatch):
    """The whole score, from a model and counts found anew, one token after the other."""
    made, loaded = [], lm_scoring._loaded
    monkeypatch.setattr(lm_scoring, "_loaded", lambda *a: (made.append(loaded(*a)), made[-1])[1])
    rows = lm_scoring.lm_scores(docs, in_model=20, known=60, groups=4).collect()
    model = made[-1]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens_of = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for i, t, _ in ROWS if not held(i) for w in tokens_of(t))
    top = sorted((w for w in counts if len(w) <= 64), key=lambda w: (-counts[w], w))[:20]
    order = sorted([(b"", sum(not held(i) for i, _, _ in ROWS)), *((w, counts[w]) for w in top)], key=lambda x: (-x[1], x[0]))
    place = {w: k for k, (w, _) in enumerate(order)}
    group = lambda w: zlib.crc32(w[-2:]) % 4
    sums = [sum(c + 1 for w, c in counts.items() if w not in place and group(w) == g) for g in range(4)]
    want = []
    for i, t, _ in ROWS:
        w = tokens_of(t)
        inner = sum(math.log10((counts[x] + 1) / (sums[group(x)] + 1)) for x in w if x not in place)
        doc = [place.get(x, len(order) + group(x)) for x in w] + [place[b""]]
        want.append((i is None, i or 0, plain_score(model, doc, place[b""]) / math.log(10) + inner))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in rows)
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], rtol=1e-3)


def test_a_very_long_text_takes_no_room_for_others():
    """One text of 500,000 words among 600 short ones is laid out block by block."""
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 5, 500_000).astype(np.uint16), *(rng.integers(0, 5, 50).astype(np.uint16) for _ in range(600))]
    plan = gru.Lanes(docs, 0, 512)
    tracemalloc.start()
    seen = sum(int(b.real.sum()) for b in plan.blocks(32))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == sum(map(len, docs)) and most < 10e6


ITEMS = [(1, EN), (2, "brown fox"), (3, ""), (4, None), (5, "line one is here with many words in it for all"), (6, "zzz"), (7, EN.lower() + " tail"), (None, "x"), (5, "x")]


def brute_contamination(i, t):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    doc, hit, items = word.findall(lower(t)), set(), set()
    for item, text in ITEMS:
        w = word.findall(lower(text)) if item is not None else []
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == w[k : k + n]:
                    hit |= set(range(p, p + n))
                    items.add(item)
    names = ",".join(sorted(map(str, items)))
    return i, len(doc), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("words", [10**6, 0])
def test_contamination(spark, docs, none, words):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = winnowing.contamination(docs, bench, broadcast_words=words)
    rows = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect())
    assert rows == Counter(brute_contamination(i, t) for i, t, _ in ROWS)
    assert winnowing.contamination(none, bench, broadcast_words=words).count() == 0
    assert not winnowing.contamination(docs, bench.where("false"), broadcast_words=words).where("contaminated").count()
    clean = winnowing.drop_contaminated(docs.where("doc_id is not null"), bench, broadcast_words=words)
    assert clean.columns[:1] == ["doc_id"] and clean.count() == sum(not brute_contamination(i, t)[5] for i, t, _ in ROWS if i is not None)


def test_winnowing_keeps_every_long_shared_run():
    rng = np.random.default_rng(4)
    for _ in range(200):
        shared = rng.integers(0, 2**63, 10, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64), shared, rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)]) for _ in range(2))
        places = [{int(winnowing.gram_hashes(x, 5)[p]) for p in winnowing.selected(winnowing.gram_hashes(x, 5), 6)} for x in (a, b)]
        assert places[0] & places[1]


def all_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_file())
    return [t.encode(x or "", add_special_tokens=False).ids for _, x, _ in ROWS]


def test_packing(docs, none):
    rows = packing.pack(docs, size=64, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(ids) == r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, list(map(int, ids))))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = Counter(x for ids in all_ids() for x in [*ids, 1])
    assert Counter(x for v in pieces.values() for _, p in v for x in p) == want
    for (doc, _), v in pieces.items():
        if doc not in (None, 3):
            ids = [x for i, e in zip([r[0] for r in ROWS], all_ids(), strict=True) if i == doc for x in [*e, 1]]
            assert [x for _, p in sorted(v) for x in p] == ids
    assert sum(sum(n for _, n in p) < 64 for p in sequences.values()) <= docs.rdd.getNumPartitions()
    assert packing.pack(none).count() == 0


def test_sum_of_squares_takes_the_best_level():
    closed = []
    p = packing.SumOfSquares(10, closed.append)
    rng = np.random.default_rng(5)
    for i in range(300):
        n = int(rng.integers(1, 10))
        count = p.count.copy()

        def cost(at, n=n, count=count):
            c = count.copy()
            c[at] -= at > 0
            c[at + n] += at + n < 10
            return int((c[1:10] ** 2).sum())

        options = [0, *[h for h in range(1, 11 - n) if count[h]]]
        assert cost(p.level(n)) == min(map(cost, options))
        p.add(i, np.arange(n, dtype=np.uint32))
    p.finish()
    sizes = [sum(len(x[2]) for x in w) for w in closed]
    assert sum(s < 10 for s in sizes) <= 1 and max(sizes) <= 10


def brute_fingerprint(t):
    w = lower(t).encode().split()
    if not w:
        return 0
    h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))], np.uint64)
    bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
    return sum(1 << i for i in range(64) if int(bits[i]) * 2 > len(h))


@pytest.mark.parametrize("tile", [2, 2048])
def test_simhash(docs, none, tile):
    fps = {i: brute_fingerprint(t) for i, t, _ in ROWS if i is not None}
    comp = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    comp[a] = min(comp[a], comp[b])
    rows = simhash.simhash_groups(docs, tile=tile).collect()
    assert len(rows) == len(ROWS)
    assert all((r.fingerprint, r.component_id) == (format(fps[r.doc_id], "016x"), comp[r.doc_id]) for r in rows if r.doc_id is not None)
    assert simhash.simhash_groups(none).count() == 0


def test_tiles_miss_no_link():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    near = x[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    y = np.concatenate([x[:50], near])
    got = {(int(i), int(j)) for a, b in simhash.linked(x, y, 3, False, side=7) for i, j in zip(a, b, strict=True)}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ y[None]) <= 3), strict=True)}
    assert got == want and want


def test_components_of_long_chains(spark):
    from tonalframe.llm.components import connected_components

    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (101, 103)] + [(7, 200 + i) for i in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and all(got[i] == 0 for i in [*range(61), *range(200, 240)]) and got[102] == 100


PAGES = [
    (1, "http://h.com/a/1", "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Head &amp; line</h1><p>Some   <b>bo</b>ld text.<p>More<br>here</article><div class='comments'><p>nice!</p></div><footer>f</footer></body></html>", "Head & line Some bold text. More here"),
    (2, "http://h.com/b/1", "<body><div>Site motto</div><p>Story one goes on here</p><form>search</form><div>Imprint</div></body>", "Story one goes on here"),
    (3, "http://h.com/b/2", "<body><div>Site motto</div><p>Story two is another thing</p><div>Imprint</div></body>", "Story two is another thing"),
    (4, "http://h.com/b/3", "<body><div>Site motto</div><p>Story three ends it all now</p><div>Imprint</div></body>", "Story three ends it all now"),
    (5, None, None, ""), (6, "http://x.org/", "", ""), (7, "http://x.org/p", "<article>cut &lt;b&gt; off <p", "cut <b> off"), (8, "nonsense", "<script>var a='</p>'</script><main>Main <aside>side</aside>text &#8364;</main>out", "Main text €"),
    (2, "http://h.com/b/1", "<body><div>Site motto</div><p>Story one goes on here</p><form>search</form><div>Imprint</div></body>", "Story one goes on here"),
    (9, "http://y.org/", "<article><header>By me</header><p>a</p><div class='ad'>buy</div><div id='cookie-notice'>ok?</div><style>p{}</style><p>b</p></article>", "a b"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, u, h, 1, 2) for i, u, h, _ in PAGES], "page_id long, url string, html string, key int, text int").repartition(3)
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.main_text(df).collect())
    assert got == Counter((i, t, len(t)) for i, _, _, t in PAGES)
    assert html_text.main_text(df.where("false")).count() == 0


def test_longest_common_subsequence():
    assert html_text.common([1, 2, 3, 4], [2, 4, 3]) in ([1, 2], [1, 3]) and html_text.common([], [1]) == [] and html_text.common([1, 1], [1]) in ([0], [1])


def test_token_store(docs, none):
    rows = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.round_trip(docs).collect()))
    ids = all_ids()
    want = Counter((i, len(e) + 1, zlib.crc32(np.array([*e, 2], "<u4").tobytes())) for (i, _, _), e in zip(ROWS, ids, strict=True))
    assert Counter(r[1:] for r in rows) == want
    at = 0
    for start, _, n, _ in rows:
        assert start == at
        at += n
    assert [r[1] for r in rows if r[1] is not None] == sorted(i for i, _, _ in ROWS if i is not None)
    assert token_store.round_trip(none).count() == 0


def test_value_coding():
    v = np.concatenate([np.random.default_rng(7).integers(0, 1 << b, 33, dtype=np.uint64) for b in (1, 8, 9, 16, 17, 24, 25, 32)]).astype(np.uint32)
    for n in (0, 1, 3, 4, 5, len(v)):
        assert (token_store.decode_values(*token_store.encode_values(v[:n]), n) == v[:n]).all()


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = k == 0 or k == 1 and all(int(x) < 256 for x in m.group().split(".")) or k == 2 and 13 <= len(d) <= 19 and personal_data.luhn(d) or k == 3 and 9 <= len(d) <= 15
            if ok:
                out.append((k, *m.span()))
    return out


def test_personal_data(docs, none):
    rows = personal_data.personal_data(docs).collect()
    told = lambda a: ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for k, s, e in a)
    assert Counter((r.doc_id, r.base) for r in rows) == Counter((i, told(brute_spans(t))) for i, t, _ in ROWS)
    r = next(r for r in rows if r.doc_id == 15)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and set(r.base.split(",")) <= set(r.spans.split(","))
    assert personal_data.personal_data(none).count() == 0


def test_pattern_spans_on_random_texts():
    rng = np.random.default_rng(8)
    letters = np.array(list("ab.@+-12345 ()%é"))
    for _ in range(3000):
        t = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert personal_data.pattern_spans(t) == brute_spans(t), t
    assert personal_data.pattern_spans("7" * 50_000 + "a" * 50_000 + "@") == []


def test_boosted_candidates_find_rewritten_addresses(spark):
    texts = [f"please mail to user{i}@host{i % 7}.example.com or call +1 (212) 555-{1000 + i} now; order 12345678{i:04}" for i in range(200)]
    texts.append("please mail to jane.roe (at) host3.example.com now")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.personal_data(df).collect()}
    assert got[200].base == "" and got[200].spans.startswith("email:")


def test_language(spark, docs, none):
    rows = language_id.language_of(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert [by[i].lang_pred for i in (4, 5, 6, 9)] == ["und"] * 4 and by[1].lang_pred == "en" and by[12].lang_pred == "de"
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in by if i is not None)
    assert language_id.language_of(none).count() == 0 and {r.lang_pred for r in language_id.language_of(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.drop_rejected(docs, language_id.fit(docs))
    assert kept.columns == docs.columns


def test_language_accuracy_on_held_out(spark, data):
    rows = language_id.language_of(spark.read.parquet(f"{data}/documents.parquet")).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97
