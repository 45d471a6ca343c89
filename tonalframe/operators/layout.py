"""Layout of rows: bar lines that make measures too narrow, how regular a row is, and measures broken into rows."""

from __future__ import annotations

import numpy as np


def pruned(bars: list[float], least: float, least_at_end: float | None = None) -> list[float]:
    """Bar lines of a row without those that make measures narrower than `least` (the last: than `least_at_end`, if given). Of the narrowest measure that line goes whose loss leaves widths
    more even, the left of equals. Sums of widths and of their squares are kept, so a step costs no more than finding the narrowest measure."""
    at = list(bars)
    widths = [b - a for a, b in zip(at, at[1:], strict=False)]
    squares = float(sum(w * w for w in widths))
    while len(at) > 2:
        last = len(widths) - 1
        narrow = [(w, i) for i, w in enumerate(widths) if w < (least_at_end if i == last and least_at_end is not None else least)]
        if not narrow:
            break
        w, i = min(narrow)
        choices = []
        for line in (i, i + 1):  # without that line
            if 0 < line < len(at) - 1:
                a, b = widths[line - 1], widths[line]
                s, q = at[-1] - at[0], squares + 2 * a * b
            else:
                gone = widths[0] if line == 0 else widths[-1]
                s, q = at[-1] - at[0] - gone, squares - gone * gone
            n = len(widths) - 1
            choices.append((round(max(0.0, q / n - (s / n) ** 2), 9), line, q))
        _, line, squares = min(choices)
        del at[line]
        widths = [b - a for a, b in zip(at, at[1:], strict=False)]
    return at


def regularity(bars: list[float], strokes: int, near: float = 15.0, dense: int = 8, dense_width: float = 90.0) -> tuple[int, float, int]:
    """What ranks a cluster of strokes as a row's bar lines: valid (0 or 1), score, strokes. Lines within `near` of the one kept before count once; too many narrow measures, or after pruning not two to
    eight lines, are not valid. The score is the span, less the spread of widths (0.8 of it at most); two lines count half, three over a wide span less."""
    kept: list[float] = []
    for x in sorted(bars):
        if not kept or x - kept[-1] > near:
            kept.append(x)
    span = kept[-1] - kept[0] if len(kept) > 1 else 0.0
    if span <= 0 or len(kept) >= dense and span / (len(kept) - 1) < dense_width:
        return 0, 0.0, 0
    lines = pruned(kept, 0.12 * span)
    if not 2 <= len(lines) <= 8:
        return 0, 0.0, 0
    widths = np.diff(lines)
    score = span * (1.0 - min(0.8, float(np.std(widths) / np.mean(widths))))
    return 1, score * (0.5 if len(lines) == 2 else 0.8 if len(lines) == 3 and span > 400 else 1.0), strokes


def rows_of(needs: list[float], section_starts: list[bool], width: float, most: int = 4) -> list[int]:
    """The row (from 0) of each measure: a row holds `most` measures at most, two or more only within 0.96 of the width, three or more within 0.90, and a section does not begin behind three."""
    out, held, used = [], 0, 0.0
    for need, new in zip(needs, section_starts, strict=True):
        full = held >= most or held >= 3 and (new or used + need > 0.90 * width) or held >= 2 and used + need > 0.96 * width
        if out and full:
            held, used = 0, 0.0
        out.append(out[-1] + (held == 0) if out else 0)
        held, used = held + 1, used + need
    return out
