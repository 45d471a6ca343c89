"""Global alignment of many pairs of short sequences at once, and what is drawn from it: votes over aligned sources, second passes, placed lyrics.

A batch holds whole pairs, which are padded to one shape. A row of all its tables is one array operation: with a gap cost g for each step, the best way into
cell j from the left is a running maximum of (value - j * g). Going back takes one array step for all pairs, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonalframe.operators.folds import dealt, key_edges, whole_keys
from tonalframe.sources.scratch import written

GAP = -0.4
NEAR = 1e-6


def best_values(scores: np.ndarray, gap: float) -> np.ndarray:
    """Values of the best alignments of all beginnings, (pairs, n + 1, m + 1), for pair scores (pairs, n, m)."""
    pairs, n, m = scores.shape
    steps = gap * np.arange(m + 1)
    best = np.empty((pairs, n + 1, m + 1))
    best[:, 0] = steps
    for i in range(n):
        into = np.concatenate([np.full((pairs, 1), gap * (i + 1)), np.maximum(best[:, i, :-1] + scores[:, i], best[:, i, 1:] + gap)], axis=1)
        best[:, i + 1] = np.maximum.accumulate(into - steps, axis=1) + steps
    return best


def best_pairs(scores: np.ndarray, n: np.ndarray, m: np.ndarray, gap: float, first: str = "up") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best global alignments of sequences of n[k] and m[k] steps: totals, and for all steps, pair by pair and in order, the pair, i and j (-1 for a gap).

    Going back, a pair of steps is taken where it explains the value, then the gap on the side named `first` (up: a step of the first sequence alone).
    """
    best, k = best_values(scores, gap), np.arange(len(n))
    at = np.pad(scores, ((0, 0), (1, 0), (1, 0)))  # of a cell, the score of the pair before it
    i, j, found = n.astype(np.int64), m.astype(np.int64), []
    total = best[k, i, j]
    while len(k):
        here = best[k, i, j]
        both = (i > 0) & (j > 0)
        met = both & (np.abs(here - best[k, i - 1, j - 1] - at[k, i, j]) < NEAR)
        up = ~met & (i > 0) & (np.abs(here - best[k, i - 1, j] - gap) < NEAR)
        left = ~met & (j > 0) & (np.abs(here - best[k, i, j - 1] - gap) < NEAR)
        up &= ~left if first == "left" else True
        a, b = met | up, met | ~up
        i, j = i - a, j - b
        found.append((k, np.where(a, i, -1), np.where(b, j, -1)))
        more = (i > 0) | (j > 0)
        k, i, j = k[more], i[more], j[more]
    if not found:
        return total, *(np.zeros(0, np.int64),) * 3
    k, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-np.repeat(np.arange(len(found)), [len(x) for x, _, _ in found]), k))
    return total, k[order], i[order], j[order]


def chord_scores(a: dict, b: dict) -> np.ndarray:
    """Pair scores of chords (C6): 1 equal, .7 same root, .3 substitutes, -.6 else. Columns root, bass and quality of shape (pairs, n) and (pairs, m)."""
    left, right = (lambda c: a[c][:, :, None]), (lambda c: b[c][:, None, :])
    d = (left("root") - right("root")) % 12
    out = np.where(np.isin(d, (3, 4, 8, 9)) | (d == 6) & (left("seventh") | right("seventh")), 0.3, -0.6)
    return np.where(d == 0, np.where(left("bass") == right("bass"), 1.0, 0.7), out)


def bar_scores(a: dict, b: dict) -> np.ndarray:
    """Scores of bars by their first chords (C7): a tenth more for equal qualities, half for two rests, half less for one."""
    left, right = (lambda c: a[c][:, :, None]), (lambda c: b[c][:, None, :])
    base = chord_scores(a, b)
    base = base + 0.1 * ((left("quality") == right("quality")) & (base > 0))
    return np.where(left("rest") & right("rest"), 0.5, np.where(left("rest") | right("rest"), -0.5, base))


def heard_scores(a: dict, b: dict) -> np.ndarray:
    """Scores of a recording's bars against a search's: .2 where neither has a chord, -.5 where one has none."""
    left, right = (lambda c: a[c][:, :, None]), (lambda c: b[c][:, None, :])
    return np.where(left("rest") & right("rest"), 0.2, np.where(left("rest") | right("rest"), -0.5, chord_scores(a, b)))


def _padded(b: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray) -> dict:
    """Columns of the sequences that begin at `starts`, side by side."""
    width = int(sizes.max(initial=0))
    at = starts[:, None] + np.minimum(np.arange(width), np.maximum(sizes[:, None] - 1, 0))
    at = np.minimum(at, len(b) - 1)
    return {c: b[c].to_numpy()[at] for c in ("root", "bass", "quality", "seventh", "rest")}


def aligned(rows: DataFrame, key: str, side: str, order: str, score: Callable = chord_scores, first: str = "up", empty: bool = False, gap: float = GAP, cells: int = 2_000_000) -> DataFrame:
    """The two sequences (side 0 and 1, in `order`) of chords (root, bass, quality; root null: a rest) of each key aligned: key, i, j (places from 0,
    -1 for a gap), the pair's score (`gap` for a gap) and the alignment's total. With an empty side there are no pairs unless `empty`, which makes all gaps.
    A key is one pair of sequences; a task holds some keys and `cells` cells of their tables, or one longer pair."""

    def some(b: pd.DataFrame, starts: np.ndarray, n: np.ndarray, m: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
        x, y = _padded(b, starts, n), _padded(b, starts + n, m)
        s = score(x, y) if n.max(initial=0) and m.max(initial=0) else np.zeros((len(n), n.max(initial=0), m.max(initial=0)))
        total, k, i, j = best_pairs(s, n, m, gap, first)
        pair = (i >= 0) & (j >= 0)
        got = np.full(len(k), gap)
        got[pair] = s[k[pair], i[pair], j[pair]]
        return pd.DataFrame({key: keys[k], "i": i.astype(np.int32), "j": j.astype(np.int32), "score": got, "total": total[k]})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_keys(batches, key):
            edges = np.array(key_edges(b, key))
            b["rest"] = b["root"].isna()
            b["root"], b["bass"] = b["root"].fillna(0).astype(np.int64), b["bass"].fillna(0).astype(np.int64)
            quality = b["quality"].fillna("")
            b["seventh"], b["quality"] = quality.str.contains("7"), pd.factorize(quality)[0]
            sides, keys = b[side].to_numpy(), b[key].to_numpy()[edges[:-1]]
            n = np.add.reduceat((sides == 0).astype(np.int64), edges[:-1])
            m = np.diff(edges) - n
            use = np.flatnonzero((n > 0) & (m > 0) | empty)
            use = use[np.lexsort((m[use], n[use]))]  # like shapes together
            held, high, wide = [], 0, 0
            for k in use.tolist():
                new = max(high, n[k] + 1), max(wide, m[k] + 1)
                if held and (len(held) + 1) * new[0] * new[1] > cells:
                    yield some(b, edges[held], n[held], m[held], keys[held])
                    held, new = [], (n[k] + 1, m[k] + 1)
                held.append(k)
                high, wide = new
            if held:
                yield some(b, edges[held], n[held], m[held], keys[held])

    given = rows.select(key, side, order, F.col("root").cast("long").alias("root"), F.col("bass").cast("long").alias("bass"), "quality")
    return dealt(given, key, [side, order]).mapInPandas(stream, f"{key} {dict(rows.dtypes)[key]}, i int, j int, score double, total double")


def evidence(sheet: DataFrame, sources: DataFrame, song: str, source: str, order: str, run: int = 3, like: float = 0.7, share: float = 0.5) -> DataFrame:
    """Steps of each song's sheet matched by each source: song, source, i, j, score. `sheet` has (song, order), `sources` (song, source, order), both root, bass, quality.

    First a global alignment; then each run of `run` or more steps without a match is aligned anew with the whole source, as songs repeat, and counts
    if at least `share` of it meets chords that score `like` or more."""
    columns = ["root", "bass", "quality"]
    place = lambda rows, by: rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    own, theirs = place(sheet.select(song, order, *columns), [song]), place(sources.select(song, source, order, *columns), [song, source])
    both = theirs.select(song, source).distinct()
    mine = both.join(own, song).select(source, F.lit(0).alias("_side"), "_at", *columns)
    other = theirs.select(source, F.lit(1).alias("_side"), "_at", *columns)
    met = written(aligned(mine.unionByName(other), source, "_side", "_at").where("i >= 0"), "aligned")
    matched = met.where("j >= 0 and score > 0").select(source, "i", "j", "score")

    steps = met.select(source, "i", F.coalesce((F.col("j") >= 0) & (F.col("score") > 0), F.lit(False)).alias("_hit"))
    island = F.col("i") - F.row_number().over(Window.partitionBy(source, "_hit").orderBy("i"))
    left = steps.withColumn("_island", island).where("not _hit")
    long = left.groupBy(source, "_island").agg(F.min("i").alias("_from"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= run)
    block = long.select(source, "_from", "_n", F.concat_ws(":", F.col(source).cast("string"), F.col("_from").cast("string")).alias("_block"))
    again = block.join(mine, source).where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + F.col("_n")))
    again = again.select("_block", "_side", "_at", *columns).unionByName(block.join(other, source).select("_block", "_side", "_at", *columns))
    second = written(aligned(again, "_block", "_side", "_at").where("i >= 0 and j >= 0").join(block, "_block"), "aligned-anew")
    enough = second.groupBy("_block").agg(F.count_if(F.col("score") >= like).alias("_good"), F.first("_n").alias("_of")).where(F.col("_good") >= share * F.col("_of"))
    second = second.join(enough.select("_block"), "_block", "left_semi").where("score > 0").select(source, (F.col("i") + F.col("_from")).cast("int").alias("i"), "j", "score")
    return matched.unionByName(second).join(both, source).select(song, source, "i", "j", "score")


def star_votes(bars: DataFrame, chosen: DataFrame, song: str, source: str, bar: str, least: float = -0.5) -> DataFrame:
    """What each source reads in each bar of its song's reference source: song, ref_bar, source, bar (the source's own). `bars` has (song, source, bar, root, bass,
    quality), one row a bar, of its first chord; `chosen` (song, source) the reference. Sources are aligned to it one by one (C7); a pair of
    bars counts above `least`."""
    columns = ["root", "bass", "quality"]
    ref = bars.join(chosen.select(song, source), [song, source], "left_semi")
    ref = ref.withColumn("_at", F.row_number().over(Window.partitionBy(song).orderBy(bar)) - 1)
    other = bars.join(chosen.select(song, source), [song, source], "left_anti")
    other = other.withColumn("_at", F.row_number().over(Window.partitionBy(song, source).orderBy(bar)) - 1)
    mine = other.select(song, source).distinct().join(ref.drop(source), song).select(source, F.lit(0).alias("_side"), "_at", *columns)
    pairs = aligned(mine.unionByName(other.select(source, F.lit(1).alias("_side"), "_at", *columns)), source, "_side", "_at", bar_scores)
    pairs = pairs.where((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("score") > least))
    voted = pairs.join(other.select(song, source, F.col("_at").alias("j"), bar), [source, "j"])
    voted = voted.join(ref.select(song, F.col("_at").alias("i"), F.col(bar).alias("ref_bar")), [song, "i"]).select(song, "ref_bar", source, bar)
    return voted.unionByName(ref.select(song, F.col(bar).alias("ref_bar"), source, bar))


def rounded(x: np.ndarray) -> np.ndarray:
    """Two decimals, each value as by round(x, 2); only what lies near the middle of two is rounded one by one."""
    x = np.asarray(x, float)
    hundredths = x * 100
    out = np.rint(hundredths) / 100
    for k in np.flatnonzero(np.abs(hundredths - np.floor(hundredths) - 0.5) < 1e-6 + 1e-15 * np.abs(hundredths)).tolist():
        out[k] = round(float(x[k]), 2)
    return out


def letters_met(letters: np.ndarray, n_letters: np.ndarray, heard: np.ndarray, n_heard: np.ndarray, cells: int = 16_000_000) -> np.ndarray:
    """For each letter, the place in `heard` of the letter that it meets, or -1. Lines lie end to end in both (n_letters and n_heard of each); each is aligned globally: match 2,
    mismatch and gap -1, going back: pair, then a letter alone. Lines of like sizes are worked on together, a diagonal of all their tables in one array operation; `cells` bounds the
    tables held at once."""
    out = np.full(len(letters), -1)
    from_letters, from_heard = np.cumsum(n_letters) - n_letters, np.cumsum(n_heard) - n_heard
    use = np.flatnonzero((n_letters > 0) & (n_heard > 0))
    use = use[np.lexsort((n_heard[use], n_letters[use]))]
    meet = lambda held: _meet(out, letters, heard, *(x[held] for x in (n_letters, n_heard, from_letters, from_heard)), cells)
    held, high, wide = [], 0, 0
    for k in use.tolist():
        n, m = max(high, n_heard[k]), max(wide, n_letters[k])
        if held and (len(held) + 1) * (n + m + 1) * (n + 1) > cells:
            meet(held)
            held, n, m = [], n_heard[k], n_letters[k]
        held.append(k)
        high, wide = n, m
    if held:
        meet(held)
    return out


def _meet(out: np.ndarray, letters: np.ndarray, heard: np.ndarray, n_letters: np.ndarray, n_heard: np.ndarray, from_letters: np.ndarray, from_heard: np.ndarray, cells: int) -> None:
    """Aligns some lines. A cell (i, j) of a table stands in row i + j at i, twice its value and i + j more: a gap then takes 1 from the row before, a pair adds 6 or 0 to the second before.
    Of tables beyond `cells`, some rows are held at a time; the two before each such block are kept, and going back fills the block again."""
    lines, n, m = len(n_letters), int(n_heard.max()), int(n_letters.max())
    x = heard[from_heard + np.minimum(np.arange(n)[:, None], n_heard - 1)]
    y = letters[from_letters + np.minimum(np.arange(m)[:, None], n_letters - 1)][::-1]
    if max(x.max(), y.max()) < 1 << 16:
        x, y = x.astype(np.uint16), y.astype(np.uint16)
    x, y = np.ascontiguousarray(x), np.ascontiguousarray(y)
    size = min(n + m + 1, max(cells // ((n + 1) * lines), isqrt(n + m) + 2))
    best = np.empty((size + 2, n + 1, lines), np.int16 if 6 * (n + m) < 32_000 else np.int32)
    blocks = range(0, n + m + 1, size)

    def fill(block: int) -> None:
        for d in range(block, min(block + size, n + m + 1)):
            at = d - block + 2
            if d <= m:
                best[at, 0] = -d
            if d <= n:
                best[at, d] = -d
            a, b = max(1, d - m), min(n, d - 1)
            if a <= b:
                pair = (x[a - 1 : b] == y[m - d + a : m - d + b + 1]).astype(best.dtype)
                pair *= 6
                pair += best[at - 2, a - 1 : b]
                row = best[at, a : b + 1]
                np.maximum(best[at - 1, a - 1 : b], best[at - 1, a : b + 1], out=row)
                row -= 1
                np.maximum(row, pair, out=row)

    kept = {}
    for block in blocks:
        if block:
            kept[block] = best[-2:].copy()
            best[:2] = kept[block]
        fill(block)
    flat, xs, ys, step = best.reshape(-1), x.reshape(-1), y.reshape(-1), (n + 1) * lines
    all_i, all_j = n_heard.astype(np.int64), n_letters.astype(np.int64)
    for block in reversed(blocks):
        if block != blocks[-1]:
            best[:2] = kept.get(block, 0)
            fill(block)
        here_now = lambda i, j, block=block: (i > 0) & (j > 0) & (i + j >= block)
        k = np.flatnonzero(here_now(all_i, all_j))
        i, j = all_i[k], all_j[k]
        while len(k):
            at = (i + j - block + 2) * step + i * lines + k
            here = flat[at]
            met = here == flat[at - 2 * step - lines] + 6 * (xs[(i - 1) * lines + k] == ys[(m - j) * lines + k])
            alone = ~met & (here == flat[at - step] - 1)
            out[from_letters[k[met]] + j[met] - 1] = from_heard[k[met]] + i[met] - 1
            i, j = i - ~alone, j - (met | alone)
            more = here_now(i, j)
            if not more.all():
                all_i[k], all_j[k] = i, j
                k, i, j = k[more], i[more], j[more]


def _first(values: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
    """searchsorted of each x in its own stretch low..high of `values`."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        v = values[np.minimum(middle, len(values) - 1)]
        after = open_ & (v < x if side == "left" else v <= x)
        low, high = np.where(after, middle + 1, low), np.where(open_ & ~after, middle, high)
    return low


def placed_lines(letters: np.ndarray, n_letters: np.ndarray, heard: np.ndarray, n_heard: np.ndarray, heard_start: np.ndarray, heard_end: np.ndarray, start: np.ndarray, end: np.ndarray, onsets: np.ndarray, n_onsets: np.ndarray, cells: int = 16_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each letter of corrected lines (code points, line after line). Letters that meet one of the draft (heard, with times), equal or not, take its time; the others share
    the time between their neighbours, by onsets (in order) where there are enough. Without a draft, a line's letters share the line."""
    line = np.repeat(np.arange(len(n_letters)), n_letters)
    first, last = np.cumsum(n_letters) - n_letters, np.cumsum(n_letters)
    met = letters_met(letters, n_letters, heard, n_heard, cells)
    free, met = met < 0, np.maximum(met, 0)
    onsets = np.append(onsets, 0.0)  # a place to read where a line has none
    s, e = (x[met] if len(x) else np.zeros(len(letters)) for x in (heard_start, heard_end))
    place = np.arange(len(letters))
    a = np.flatnonzero(free & ((place == first[line]) | ~np.roll(free, 1)))
    b = np.flatnonzero(free & ((place == last[line] - 1) | ~np.roll(free, -1))) + 1
    if len(a):
        own, anchored = line[a], (n_heard > 0)[line[a]]
        before, behind = np.maximum(a - 1, 0), np.minimum(b, len(letters) - 1)
        has_before, has_behind = a > first[own], b < last[own]
        left, right = np.where(has_before, e[before], start[own]), np.where(has_behind, s[behind], end[own])
        tight = right <= left  # no room: the neighbours give some of theirs
        g = np.flatnonzero(tight & has_behind)
        new = s[behind[g]] + 0.4 * np.maximum(0.05, e[behind[g]] - s[behind[g]])
        right[g], s[behind[g]] = new, rounded(new)
        g = np.flatnonzero(tight & has_before)
        new = s[before[g]] + 0.6 * np.maximum(0.05, e[before[g]] - s[before[g]])
        left[g], e[before[g]] = new, rounded(new)

        reach, size = np.where(anchored, 0.05, 0.1), b - a
        low, high = np.cumsum(n_onsets)[own] - n_onsets[own], np.cumsum(n_onsets)[own]
        near = _first(onsets, low, high, left - reach, "left")
        enough = _first(onsets, low, high, right + reach, "right") - near >= size
        g = np.repeat(np.arange(len(a)), size)
        i = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
        s[a[g] + i], e[a[g] + i] = _shared(i, size[g], left[g], right[g], enough[g], anchored[g], onsets, near[g])

    e, out = np.where(e > s, e, rounded(s + 0.05)), rounded(s)
    late = np.flatnonzero((place > first[line]) & (out < np.roll(out, 1)))
    for k in np.unique(line[late]).tolist():  # a start before the one before it
        out[first[k] : last[k]] = np.maximum.accumulate(out[first[k] : last[k]])
    moved = s < np.where(place > first[line], np.roll(out, 1), -np.inf)
    return out, rounded(np.where(moved, np.maximum(e, rounded(out + 0.05)), e))


def _shared(i: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, enough: np.ndarray, anchored: np.ndarray, onsets: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times of the i-th of n letters between left and right, by the onsets from place `near` on or even; without a draft (not anchored) onsets count as they are."""
    place = np.where(enough, near + i, 0)
    t, after = onsets[place], np.where(i + 1 < n, onsets[np.where(enough & (i + 1 < n), place + 1, 0)], right)
    s = np.where(anchored, np.maximum(left, t), t)
    each = np.maximum(0.05, (right - left) / n)
    e = np.where(after > s, after, s + np.where(anchored, (right - s) / (n - i), each))
    e = np.where(anchored, np.maximum(s + 0.04, e), e)
    step = np.maximum(0.05 * n, right - left) / n
    even = np.where(anchored, step, each)
    until = np.where(anchored, left + (i + 1) * step, np.minimum(right, left + i * each + each))
    return rounded(np.where(enough, s, left + i * even)), rounded(np.where(enough, e, until))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def placed(draft: list[tuple[float, float, str]], text: str, start: float, end: float, onsets: list[float]) -> list[tuple[float, float, str]]:
    """The letters of one corrected line with times: (start, end, letter); see placed_lines."""
    starts, ends, heard = zip(*draft, strict=True) if draft else ((), (), ())
    one = lambda x: np.array([x], float)
    size = lambda x: np.array([len(x)])
    s, e = placed_lines(code_points(text), size(text), code_points("".join(heard)), size(heard), np.array(starts, float), np.array(ends, float), one(start), one(end), np.array(sorted(onsets), float), size(onsets))
    return list(zip(s.tolist(), e.tolist(), text, strict=True))
