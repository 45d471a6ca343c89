"""Operators whose every step depends on the one before: small folds over the rows of one song or series, one group at a time.

Groups are meant to be songs, pages or recordings; a group is held whole by one task, sorted, so a key whose rows grow with the corpus wants another operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, groupby, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def apart(values: list[float], least: float) -> list[bool]:
    """Which of the ascending values lie `least` or more after the last one kept."""
    last, keep = None, []
    for v in values:
        keep.append(last is None or v - last >= least)
        last = v if keep[-1] else last
    return keep


def from_first(values: list[float], most: float) -> list[int]:
    """Cluster numbers (from 1): a value farther than `most` from the first one of its cluster starts the next."""
    first, n, out = None, 0, []
    for v in values:
        if first is None or v - first > most:
            first, n = v, n + 1
        out.append(n)
    return out


def settled(labels: list) -> list:
    """Each label, or the one settled before it where the one after it is the same as that."""
    return list(accumulate(zip(labels, [*labels[1:], None], strict=True), lambda held, x: held if held == x[1] else x[0], initial=labels[0]))[1:] if labels else []


def smoothed(labels: list[str], trust: list[float]) -> list[str]:
    """Labels without single-step glitches: a label between two equal ones joins them, then what is still a run of one step joins the
    neighbour trusted more (the one before, of equals; the only one there is, at an end), then what that left between equals joins them."""
    if len(labels) < 3:
        return list(labels)
    once, out = settled(labels), []
    ends = list(accumulate(len(list(run)) for _, run in groupby(once)))
    for start, end in zip([0, *ends], ends, strict=False):
        sides = [(trust[start - 1], 1, out[-1])] if out else []
        if end < len(once):
            sides.append((trust[end], 0, once[end]))
        out += [max(sides)[2] if end - start == 1 else once[start]] * (end - start)
    return settled(out)


def absorbed(labels: list[str], least: int, voiced: tuple[str, ...]) -> list[str]:
    """Runs of a voiced label shorter than `least` take the label before if it is voiced, else the one after if it is; again until nothing changes."""
    out = list(labels)
    while True:
        before, at = list(out), 0
        for label, run in groupby(before):
            end = at + len(list(run))
            near = [x for x in (*out[max(0, at - 1) : at], *before[end : end + 1]) if x in voiced]
            if label in voiced and end - at < least and near:
                out[at:end] = near[:1] * (end - at)
            at = end
        if out == before:
            return out


def increasing(beats: list[float], beats_in_bar: float, step: float = 0.5) -> list[float]:
    """Strictly increasing beats of a bar: forward, what does not rise goes a step on, to the bar's last beat at most; backward, what does not
    fall goes a step back, to the first beat at most; what still does not rise shares the rest of the bar."""
    forward = list(accumulate(beats, lambda a, b: b if b > a else min(beats_in_bar, a + step)))
    back = list(accumulate(reversed(forward), lambda b, a: a if a < b else max(1.0, b - step)))[::-1]
    n = len(back)
    rest = lambda a, i: round(a + max(0.1, (beats_in_bar - a) / (n - i + 1)), 2)
    return [b for _, b in accumulate(enumerate(back), lambda x, y: y if y[1] > x[1] else (y[0], rest(x[1], y[0])))]


def not_near(labels: list[str], beats: list[float], reach: float = 0.25) -> list[bool]:
    """Which rows have no kept row of the same label within reach."""
    kept: dict[str, list[float]] = {}
    out = []
    for x, b in zip(labels, beats, strict=True):
        out.append(all(abs(b - k) > reach for k in kept.get(x, ())))
        if out[-1]:
            kept.setdefault(x, []).append(b)
    return out


def tiled_sections(spans: list[tuple[int, int, str]], total: int, short: int = 4) -> list[tuple[int, int, str]]:
    """Sections (first, last, role) that cover bars 0 to total - 1 once: overlaps are cut from the later one, short gaps join the one
    before (at the start the one after), long gaps become sections of their own. Ends beyond the bars are drawn in."""
    out: list[list] = []
    for first, last, role in sorted((min(max(0, a), total - 1), min(max(0, b), total - 1), r) for a, b, r in spans):
        end = out[-1][1] if out else -1
        first = max(first, end + 1)
        if first > last:
            continue
        gap = first - end - 1
        if gap > short:
            out.append([end + 1, first - 1, "interlude" if out else "intro"])
        elif gap and out:
            out[-1][1] = first - 1
        elif gap:
            first = 0
        out.append([first, last, role])
    if out and (gap := total - 1 - out[-1][1]) > short:
        out.append([out[-1][1] + 1, total - 1, "outro"])
    elif out:
        out[-1][1] = total - 1
    return [tuple(x) for x in out]


Columns = dict[str, np.ndarray]


def whole_keys(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The batches of a partition sorted by `key`, cut anew so that each holds whole keys. A key that spans many batches is joined once."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[key].to_numpy()
        if held and held[-1][key].iloc[-1] != k[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        edges = np.flatnonzero(k[1:] != k[:-1])
        if len(edges):
            yield pd.concat([*held, b.iloc[: edges[-1] + 1]], ignore_index=True)
            held = []
        held.append(b.iloc[edges[-1] + 1 :] if len(edges) else b)
    if held:
        yield pd.concat(held, ignore_index=True)


def key_edges(b: pd.DataFrame, key: str) -> list[int]:
    """Where each key of a batch begins, and the batch's end."""
    k = b[key].to_numpy()
    return [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(b)]


def dealt(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Whole keys in a partition, sorted; as many partitions as the session shuffles into, as tasks are long for their bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, *order)


def by_song(rows: DataFrame, key: str, order: list[str], use: Callable[[Columns], dict[str, list]], schema: str) -> DataFrame:
    """use(the columns of one key's rows, in order), key by key. Partitions hold whole keys, sorted, and stream through Arrow
    batches; a task holds one batch and one key at a time, and many short keys cost little more than their rows."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_keys(batches, key):
            columns, out = {c: b[c].to_numpy() for c in b.columns}, {}
            for i, j in pairwise(key_edges(b, key)):
                for name, values in use({c: v[i:j] for c, v in columns.items()}).items():
                    out.setdefault(name, []).extend(values)
            yield pd.DataFrame(out)

    return dealt(rows, key, order).mapInPandas(stream, schema)


def fold(rows: DataFrame, key: str, order: list[str], values: list[str], use, name: str, kind: str) -> DataFrame:
    """`rows` with a column `name`: use(*values of the key's rows, in order) gives one entry a row."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return by_song(rows, key, order, lambda c: c | {name: use(*(c[v].tolist() for v in values))}, f"{fields}, `{name}` {kind}")
