"""Pages: neighbours and shared lines against brute force over whole hosts; markup of any size."""

import random
import time

from tonalframe.llm import html_text


def longest(a, b):
    """Places in a of a longest common subsequence with b, by the full table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def brute(pages, reach=2):
    out = {}
    hosts = {}
    for i, url, lines in pages:
        host, path = url.split("://")[1].split("/", 1)
        hosts.setdefault(host, []).append((path, i, lines))
    for pages_of in hosts.values():
        first = {}  # equal pages act as one, at their least path
        for path, i, lines in sorted(pages_of):
            first.setdefault(tuple(lines), [path, lines, []])[2].append(i)
        some = sorted((path, ids, lines) for path, lines, ids in first.values())
        for k, (_, ids, lines) in enumerate(some):
            size, met = sum(map(len, lines)), []
            for other in some[max(0, k - reach) : k] + some[k + 1 : k + 1 + reach]:
                hits = longest(lines, other[2])
                met.append((2 * sum(len(lines[x]) for x in hits) >= size, hits))
            gone = {x for x in range(len(lines)) if any(x in h for c, h in met if not c) or sum(x in h for _, h in met) >= 3}
            out |= dict.fromkeys(ids, " ".join(x for n, x in enumerate(lines) if n not in gone))
    return out


def test_differencing_of_whole_hosts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))
    pages = []
    for h in range(4):
        top, bottom, now = [line(4) for _ in range(3)], [line(6) for _ in range(2)], [line(30)]
        for p in rng.sample(range(1000), 40):
            own = list(dict.fromkeys(line(40) for _ in range(rng.randint(0, 5))))
            if rng.random() < 0.2:  # a copy of the last article with a line changed
                own = [*now[:-1], line(40)]
            now = own or now
            pages.append((len(pages), f"http://h{h}.org/x/{p:04d}", [*(top if rng.random() < 0.9 else top[1:]), *own, *bottom]))
    rows = [(i, u, "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>", "x", [1], True) for i, u, lines in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, blocks string, open array<int>, lines boolean").repartition(5)
    want = brute(pages)
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == want
    assert sum(len(want[i]) < len(" ".join(lines)) for i, _, lines in pages) > 100


def text_of(page):
    return " ".join(html_text.sorted_out(page)[0])


def test_markup_of_any_size():
    long = "x" * 25_000
    assert text_of(f'<article><p>a</p><img src="data:{long}"><p>b</p></article>') == "a b"
    assert text_of("<article><p " + "".join(f'a{i}="{i}" ' for i in range(2000)) + ">b</p></article>") == "b"
    assert text_of(f"<article><{long} y='>'>b</{long}></article>") == "b" and text_of(f"<!doctype {long}><article>b</article>") == "b"
    assert text_of("<article>1 < 2 & 3 > 2, a<b</article>") == "1 < 2 & 3 > 2, a"
    assert text_of("<article>a<!-- <p>x</p> -->b<!-- c") == "ab"
    assert text_of('<article><p title="it\'s > fine">b</p><p title="open>c</p></article>') == "b c"


def test_nested_articles_stay_with_the_page():
    body = "the article of this page with many words in it"
    assert text_of(f"<main><h1>Title</h1><p>{body}</p><article class='card'><p>teaser</p></article></main>") == f"Title {body} teaser"
    assert text_of(f"<article><p>{body}</p><article class='comment'><p>I like it</p></article></article>") == body
    # a small marked element does not stand for the page
    assert html_text.sorted_out(f"<div><p>{body}</p></div><article class='card'>teaser</article>") == ([body, "teaser"], [True, True])


def test_long_pages_take_linear_time():
    began = time.time()
    assert text_of("<article>" + "<a '" * 200_000) == ""
    assert len(text_of("<article>" + "<p>word</p>" * 100_000 + "</article>")) == 500_000 - 1
    text_of("<" * 500_000 + '<p a="' * 100_000)
    assert time.time() - began < 20


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.main_text(df).orderBy("page_id").collect()]


def test_marked_articles_meet_their_neighbours(spark):
    own = [f"Story {i} begins with words of its own and goes on for a while about number {i * i}" for i in range(12)]
    quote = "A quotation that five neighbouring articles repeat"
    pages = [
        (
            f"http://n.org/a/{i:02d}",
            f"<nav>Home {i}</nav><div class='ad'>Buy {i}</div><article><h1>Title {i}</h1><div class='k7'>Read our paper every day for less</div><p>{x}</p>"
            f"{f'<p>{quote}</p>' if i < 5 else ''}<p>Last words {i}</p><p>All this may be printed anew</p></article><footer>House {i}</footer>",
        )
        for i, x in enumerate(own)
    ]
    want = [f"Title {i} {x}{f' {quote}' if i < 5 else ''} Last words {i}" for i, x in enumerate(own)]
    assert texts_of(spark, pages) == want


def test_copies_of_marked_articles_stay(spark):
    body = [f"<p>Paragraph {k} of an article that stands at many addresses of its host</p>" for k in range(6)]
    pages = [(f"http://c.org/{i}", f"<article>{''.join(body)}<p>seen {i}</p></article>") for i in range(8)]
    assert [t.count("Paragraph") for t in texts_of(spark, pages)] == [6] * 8


def test_a_word_among_others_is_no_verdict(spark):
    body = "This page tells a long story in words that no other page of the host has, number"
    section = lambda i: f"<section id='related-work'>Others wrote about {i} before</section>"
    slot = lambda i: f"<div class='ad-q7x'>Offer {i}</div>"
    pages = [(f"http://w.org/{i}", f"<main><p>{body} {i}</p>{section(i)}{slot(i)}<div class='related-q9x'>More from us</div></main>") for i in range(3)]
    pages += [("http://lone.org/", f"<main><p>{body}</p>{section(9)}{slot(9)}<div class='related-posts'>one two</div></main>")]
    assert texts_of(spark, pages) == [*(f"{body} {i} Others wrote about {i} before" for i in range(3)), f"{body} Others wrote about 9 before"]


def test_pages_on_both_sides_of_a_border(spark):
    key, rng = "spark.sql.adaptive.coalescePartitions.enabled", random.Random(8)
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # else so few pages come to one partition
    try:
        for count in (1, 2, 5, 7, 60):
            pages = []
            for i in range(count):
                lines = [f"{c} of {i // rng.randint(1, 4)}" for c in "abcdefgh" if rng.random() < 0.8] or ["none"]
                pages.append((i, f"http://b.org/{i:03d}", lines))
            got = texts_of(spark, [(u, "".join(f"<div>{x}</div>" for x in lines)) for _, u, lines in pages])
            want = brute(pages)
            assert got == [want[i] for i in range(count)]
    finally:
        spark.conf.set(key, before)


def test_subsequences_of_many_matches():
    rng = random.Random(3)
    for bound in (0, 4, 1 << 18):
        for _ in range(200):
            a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 30))] for _ in range(2))
            got = html_text.matched(a, b, bound)
            assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
            assert len(got) == len(longest(a, b))
    began = time.time()
    a, b = ([rng.randint(0, 3) for _ in range(20_000)] for _ in range(2))
    assert len(html_text.matched(a, b)) > 10_000 and time.time() - began < 60


def test_long_pages_that_share_half_their_blocks(spark):
    shared = [f"shared {k}" for k in range(60_000)]
    own = [[f"page {i} says {k}" for k in range(60_000)] for i in range(2)]
    pages = [(f"http://l.org/{i}", "".join(f"<div>{x}<div>{y}</div></div>" for x, y in zip(shared, own[i], strict=True))) for i in range(2)]
    began = time.time()
    assert texts_of(spark, pages) == [" ".join(x) for x in own]
    assert time.time() - began < 60
