r"""Line dedup by pairwise alignment of overlapping documents.

Every line that several documents share pairs each later document (larger identifier) with the first document that has it,
however common the line, and so does every run of shared lines that `runs` names, as the first document with a run need not be the
first one of its lines. So candidates grow with the number of lines, and every run of `min_words` words or more that an earlier
document has meets one that has it. A pair's shared lines are aligned by patience diff: lines that occur once in both are
anchors, the longest increasing chain of them stays, runs grow from there over equal lines on both sides, and the gaps between are
aligned in turn. Blank lines are no lines here. Blocks of `min_words` words or more are deleted from the later document.

Lines end at \n; white space around a line does not count for equality. Defined results: null text counts as empty; blank lines stay; rows that repeat identifier and text are one document and get the same result each, rows that repeat the
identifier alone are ordered by a hash of their texts; null identifiers come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalframe.sources.scratch import written


BLANK = " \t\r\x0b\f"


def increasing(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of sorted points that rises in both."""
    ends, tails, back = [], [], []
    for n, (_, b) in enumerate(points):
        k = bisect_left(ends, b)
        back.append(tails[k - 1] if k else -1)
        if k == len(ends):
            ends.append(b)
            tails.append(n)
        else:
            ends[k], tails[k] = b, n
    chain, n = [], tails[-1] if tails else -1
    while n >= 0:
        chain.append(points[n])
        n = back[n]
    return chain[::-1]


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(place in a, place in b) of a longest common subsequence, by one bit for each place in b."""
    full, masks = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    v, rows = full, []
    for x in a:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> j - 1 & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def patience(pairs: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """Aligned (place, other place) by place, of lines with all their places in both documents. Gaps between runs are
    aligned in turn, where a line may be the only one of its kind; a gap without such lines by a longest common subsequence."""
    line = {x: n for n, (a, _) in enumerate(pairs) for x in a}
    other = {x: n for n, (_, b) in enumerate(pairs) for x in b}
    aligned, gaps = [], [(sorted(line), sorted(other))]
    while gaps:
        xs, ys = gaps.pop()
        here, there = {}, {}
        for places, of, at in ((xs, line, here), (ys, other, there)):
            for x in places:
                at.setdefault(of[x], []).append(x)
        once = sorted((a[0], there[n][0]) for n, a in here.items() if len(a) == 1 and len(there.get(n, ())) == 1)
        if not once:
            aligned += [(xs[i], ys[j]) for i, j in common([line[x] for x in xs], [other[y] for y in ys])]
            continue
        chain = increasing(once)
        low_a, low_b = xs[0] - 1, ys[0] - 1
        for n, (a, b) in enumerate(chain):
            high_a, high_b = chain[n + 1] if n + 1 < len(chain) else (xs[-1] + 1, ys[-1] + 1)
            if a <= low_a or b <= low_b:
                continue
            run, x, y = [], a, b
            while x > low_a and y > low_b and line.get(x, -1) == other.get(y, -2):
                run.append((x, y))
                x, y = x - 1, y - 1
            gaps.append((xs[bisect_right(xs, low_a) : bisect_right(xs, x)], ys[bisect_right(ys, low_b) : bisect_right(ys, y)]))
            run.reverse()
            x, y = a + 1, b + 1
            while x < high_a and y < high_b and line.get(x, -1) == other.get(y, -2):
                run.append((x, y))
                x, y = x + 1, y + 1
            aligned += run
            low_a, low_b = run[-1]
        gaps.append((xs[bisect_right(xs, low_a) :], ys[bisect_right(ys, low_b) :]))
    return sorted(aligned)


def runs(words: dict[int, int], min_words: int) -> list[tuple[int, int]]:
    """(first place, lines) of the runs of neighbouring shared lines by which documents meet: from each line the shortest run of
    `min_words` words onwards and the shortest back, which together touch every line of any longer one, and runs of 2, 4, 8, ... lines."""
    found, places = set(), sorted(words)
    at = 0
    while at < len(places):
        end = at + 1
        while end < len(places) and places[end] == places[end - 1] + 1:
            end += 1
        total = [0]
        for x in places[at:end]:
            total.append(total[-1] + words[x])
        for i in range(end - at):
            j = bisect_left(total, total[i] + min_words)
            if j <= end - at:
                found.add((places[at + i], j - i))
            j = bisect_right(total, total[i + 1] - min_words) - 1
            if j >= 0:
                found.add((places[at + j], i + 1 - j))
        n = 2
        while n <= end - at:
            found.update((x, n) for x in places[at : end - n + 1])
            n *= 2
        at = end
    return [x for x in found if x[1] > 1]


def blocks(aligned: list[tuple[int, int]]) -> list[list[int]]:
    """Places of aligned lines, cut where either document has another line between."""
    out: list[list[int]] = []
    last = None
    for a, b in aligned:
        if last == (a - 1, b - 1):
            out[-1].append(a)
        else:
            out.append([a])
        last = a, b
    return out


def line_dedup(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (what is left), n_lines (not blank), n_deleted, deleted (their places among those), partners (identifiers of earlier documents) for each row of `docs`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    given = given.withColumn("doc", F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("t")))
    # Places are counted over lines that are not blank.
    full = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")
    each = given.select("doc", F.posexplode(full).alias("place", "line"))
    lines = each.select("doc", "place", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(7)).alias("g"), F.size(F.split("line", "[ \\t]+")).alias("words"))
    held = lines.groupBy("doc", "h", "g").agg(F.array_sort(F.collect_set("place")).alias("places"), F.max("words").alias("words"))
    held = written(held, "lines")
    shared = held.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "places")).alias("first")).where("n > 1")
    first = written(shared.select("h", "g", F.col("first.doc").alias("owner"), F.col("first.places").alias("theirs")), "first-lines")
    line = F.struct("h", "g", "owner", "places", "theirs", "words")
    by_doc = written(held.join(first, ["h", "g"]).groupBy("doc").agg(F.collect_list(line).alias("pairs")), "shared-lines")

    def of_doc(batches):
        for b in batches:
            out = []
            for doc, pairs in zip(b["doc"], b["pairs"], strict=True):
                own = {x: p for p in pairs for x in p["places"]}
                mark = {x: p["h"].to_bytes(8, "little", signed=True) + p["g"].to_bytes(8, "little", signed=True) for x, p in own.items()}
                places: dict = {}
                for x, n in sorted(runs({x: p["words"] for x, p in own.items()}, min_words)):
                    places.setdefault((blake2b(b"".join([mark[y] for y in range(x, x + n)]), digest_size=16).digest(), n), []).append(x)
                out += [(doc["id"], doc["t"], k, n, x) for (k, n), x in places.items()]
            if out:
                yield pd.DataFrame(out, columns=["id", "t", "k", "lines", "places"])

    # Each run too meets the first document that has it, which the first ones of its lines need not have.
    held_runs = written(by_doc.mapInPandas(of_doc, "id long, t long, k binary, lines int, places array<int>").select(F.struct("id", "t").alias("doc"), "k", "lines", "places"), "runs")
    many = held_runs.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "places")).alias("first")).where("n > 1")
    many = many.select("k", F.col("first.doc").alias("owner"), F.col("first.places").alias("theirs"))
    met = held_runs.join(many, "k").where("owner < doc").groupBy("doc").agg(F.collect_list(F.struct("owner", "places", "theirs", "lines")).alias("runs"))
    by_doc = by_doc.select("doc", F.filter("pairs", lambda p: p["owner"] < F.col("doc")).alias("pairs")).where(F.size("pairs") > 0).join(met, "doc", "left")

    def aligned(batches):
        for b in batches:
            out = []
            for doc, pairs, longer in zip(b["doc"], b["pairs"], b["runs"], strict=True):
                words = {x: p["words"] for p in pairs for x in p["places"]}
                which = {x: n for n, p in enumerate(pairs) for x in p["places"]}
                owners: dict = {}  # of each: the lines met, and their places there
                for n, p in enumerate(pairs):
                    owners.setdefault((p["owner"]["id"], p["owner"]["t"]), {}).setdefault(n, set()).update(p["theirs"])
                for r in longer if longer is not None else ():
                    met = owners.setdefault((r["owner"]["id"], r["owner"]["t"]), {})
                    for i in range(r["lines"]):
                        met.setdefault(which[r["places"][0] + i], set()).update([y + i for y in r["theirs"]])
                gone, partners = set(), set()
                for owner, some in sorted(owners.items()):
                    match = patience([(list(pairs[n]["places"]), sorted(some[n])) for n in sorted(some)])
                    for block in blocks(match):
                        if sum(words[x] for x in block) >= min_words:
                            gone.update(block)
                            partners.add(owner[0])
                if gone:
                    out.append((doc["id"], doc["t"], sorted(gone), sorted(partners)))
            if out:
                yield pd.DataFrame(out, columns=["a", "t", "gone", "partners"])

    gone = by_doc.mapInPandas(aligned, "a long, t long, gone array<int>, partners array<long>")
    keyed = given.select("id", "text", F.col("doc.id").alias("a"), F.col("doc.t").alias("t"))

    def rest(batches):
        for b in batches:
            left, n = [], []
            for text, cut in zip(b["text"], b["gone"], strict=True):
                parts = text.split("\n")
                full = [i for i, x in enumerate(parts) if x.strip(BLANK)]
                n.append(len(full))
                if cut is not None:
                    cut = {full[i] for i in cut}
                    parts = [x for i, x in enumerate(parts) if i not in cut]
                left.append("\n".join(parts))
            cuts = [[] if x is None else list(x) for x in b["gone"]]
            yield pd.DataFrame({
                "id": b["id"].astype("Int64"), "text": left, "n_lines": n, "n_deleted": list(map(len, cuts)), "deleted": cuts,
                "partners": [[] if x is None else list(x) for x in b["partners"]],
            })

    schema = "id long, text string, n_lines long, n_deleted long, deleted array<int>, partners array<long>"
    return keyed.join(gone, ["a", "t"], "left").mapInPandas(rest, schema).withColumnRenamed("id", id_col)
