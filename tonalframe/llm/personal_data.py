r"""Personal data: fixed patterns, and spans that boosted trees choose from a generous set of candidates.

Patterns (kept always; leftmost, not overlapping within a kind; a match that fails its test is dropped without another try):
  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
  ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
  card   [0-9]([\x20-]?[0-9])+, 13 to 19 digits passing Luhn
  phone  \+[0-9][\x20().0-9-]+[0-9], 9 to 15 digits
Generators propose overlapping spans: anything around an at sign, spelled-out addresses, and runs of digits with
separators, once for each numeric kind they might be. Features describe format and context. Trees learn from the corpus
itself: pattern matches and rewritten forms of them are positive, other candidates whose form is known to be wrong are
negative. A held-out fifth calibrates the chances of each kind and sets its threshold, the least chance from which on `precise` of the
kind's held-out candidates are right; only candidates that reach it become spans. Runs of digits and separators longer than any number
are proposed by windows of their groups, so no candidate is lost to the length of what stands around it.

All texts are scanned; fitting sees `sample` candidates at most, those with the least hashes.
Defined results: null text has no spans; without candidates of both classes nothing is learned and the patterns stand alone; null or
repeated identifiers are separate rows; an empty table gives no rows; other columns are ignored. Offsets count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalframe.llm.boosting import Trees, calibrated, isotonic
from tonalframe.sources.scratch import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# A match can only begin where its run begins, so each search is linear in the text.
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local_end = re.compile(r"[A-Za-z0-9._%+-]")
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digits = re.compile(r"[^0-9]+")
# What follows a spelled address's local part; with that part in front, searched for at each place.
_rest = r" ?(?:[\[(] ?at ?[\])]| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?dot ?[\])]| dot ) ?[A-Za-z0-9-]+)+"
_spelled_at = re.compile(r"(?<=[A-Za-z0-9._%+-])" + _rest, re.I)
_spelled_local = re.compile(r"[A-Za-z0-9._%+-]", re.I)
_numeric = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ ().\-/]*+[0-9]++)*+")
_group = re.compile(r"[0-9]+")
MOST = 19  # digits of the longest kind of number; separators count for nothing
_hints = (r"mail|contact|write|address", r"\bip\b|host|server|addr|from", r"card|credit|visa|pay|account", r"phone|tel|call|fax|mobile|whatsapp")
_hints = [re.compile(x, re.I) for x in _hints]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _local_end.match(text, start - 1):
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return found


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start."""
    found = [(EMAIL, *x) for x in emails(text)] if "@" in text else []
    cards = []
    for m in _card.finditer(text):
        digits = _digits.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            cards.append((CARD, m.start(), m.end()))
    found += [(IP, m.start(), m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    found += cards
    if "+" in text:
        found += [(PHONE, m.start(), m.end()) for m in _phone.finditer(text) if 9 <= len(_digits.sub("", m.group())) <= 15]
    return found


def spelled(text: str) -> list[tuple[int, int]]:
    """Spelled-out addresses: the leftmost first."""
    found, last = [], 0
    for m in _spelled_at.finditer(text):
        start = m.start()
        while start > last and _spelled_local.match(text, start - 1):
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Proposed (kind, start, end), overlapping."""
    found, at = [], text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a and not text[a - 1].isspace() and text[a - 1] != "@":
            a -= 1
        while b < len(text) and not text[b].isspace() and text[b] != "@":
            b += 1
        while b > at and text[b - 1] in ".,;:!?)>]\"'":
            b -= 1
        if a < at < b - 1:
            found.append((EMAIL, a, b))
        at = text.find("@", at + 1)
    found += [(EMAIL, a, b) for a, b in spelled(text)]
    for m in _numeric.finditer(text):
        if len(_digits.sub("", m.group())) > MOST:
            found += [(k, a, b) for a, b in windows(text, m.start(), m.end()) for k in (IP, CARD, PHONE)]
        elif m.end() - m.start() >= 7:
            found += [(k, m.start(), m.end()) for k in (IP, CARD, PHONE)]
    return found


def windows(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Runs of neighbouring digit groups with MOST digits at most and 7 characters at least: MOST for each group, however long the whole is."""
    groups, found = [m.span() for m in _group.finditer(text, start, end)], []
    for i, (a, _) in enumerate(groups):
        digits = 0
        for c, b in groups[i : i + MOST]:
            digits += b - c
            if digits > MOST:
                break
            if b - a >= 7:
                found.append((a, b))
    return found


def features(kind: int, span: str, before: str, after: str) -> list[float]:
    digits = _digits.sub("", span)
    groups = [x for x in re.split(r"[^0-9]+", span) if x]
    parts = span.split(".")
    name, _, host = re.sub(r" ?[\[(]? ?\bat\b ?[\])]? ?", "@", span, flags=re.I).partition("@")
    host = re.sub(r" ?[\[(]? ?\bdot\b ?[\])]? ?", ".", host, flags=re.I)
    labels = host.split(".") if host else []
    hint = [bool(h.search(before)) for h in _hints]
    return [
        *(float(kind == k) for k in range(4)), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.startswith("+"), "(" in span, span.count("."), span.count("-"), span.count(" "), bool(digits) and luhn(digits),
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts),
        "@" in span, len(name), len(labels), bool(re.fullmatch(r"[A-Za-z]{2,10}", labels[-1])) if labels else 0.0,
        bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", f"{name}@{host}")), before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in ".-/=:", hint[kind], sum(hint) - hint[kind],
    ]


def rewritten(kind: int, span: str) -> list[str]:
    """Other ways to write a match of a pattern."""
    if kind == EMAIL:
        name, host = span.split("@")
        return [f"{name} (at) {host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} at {host.replace('.', ' dot ')}"]
    if kind == CARD:
        d = _digits.sub("", span)
        return [f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}", f"{d[:4]}/{d[4:8]}/{d[8:12]}/{d[12:]}"]
    if kind == PHONE:
        bare = span[1:]
        return [bare, f"00{bare}", bare.replace(" ", "-"), bare.replace(" ", ".")] if len(_digits.sub("", span)) >= 10 else []
    return []


def wrong(kind: int, span: str) -> bool:
    """Whether a candidate's form rules its kind out."""
    digits = _digits.sub("", span)
    if kind == EMAIL:
        return not re.search(r"[A-Za-z0-9]\W*(?:@|at)", span, re.I) or not re.search(r"(?:\.|dot\W*)[A-Za-z]{2,}", span, re.I)
    if kind == IP:
        return span.count(".") != 3 or any(p and int(p) > 255 for p in re.split(r"[^0-9]+", span))
    if kind == CARD:
        return not (13 <= len(digits) <= 19 and luhn(digits))
    return not 9 <= len(digits) <= 15 or len(digits) == len(span)


WIDTH = len(features(IP, "1", "", ""))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc; spans of patterns and candidates as packed (kind, start, end); candidates' features; examples to learn from, features and label."""

    def rows(batches):
        for b in batches:
            out = []
            for text in b["text"]:
                base = pattern_spans(text)
                own = set(base)
                found, learn = [c for c in candidates(text) if c not in own], []
                feats = []
                for k, s, e in found:
                    feats.append(features(k, text[s:e], text[max(0, s - 40) : s], text[e : e + 8]))
                    if wrong(k, text[s:e]):
                        learn.append([*feats[-1], 0.0])
                for k, s, e in base:
                    before, after = text[max(0, s - 40) : s], text[e : e + 8]
                    learn += [[*features(k, x, before, after), 1.0] for x in (text[s:e], *rewritten(k, text[s:e]))]
                out.append((
                    np.array(base, np.int64).tobytes(), np.array(found, np.int64).tobytes(), np.array(feats, np.float32).tobytes(), np.array(learn, np.float32).tobytes(),
                ))
            base, found, feats, learn = zip(*out, strict=True) if out else ([], [], [], [])
            yield pd.DataFrame({"doc": b["doc"].astype("Int64"), "base": base, "found": found, "feats": feats, "learn": learn})

    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInPandas(rows, "doc long, base binary, found binary, feats binary, learn binary")


def learn(scanned: DataFrame, sample: int, precise: float, most: int = 20) -> tuple | None:
    """Trees and calibration from at most `sample` different examples."""

    def rows(batches):
        for b in batches:
            for x in b["learn"]:
                a = np.frombuffer(x, np.float32).reshape(-1, WIDTH + 1)
                yield pd.DataFrame({"x": [r.tobytes() for r in a]})

    # Equal examples count together, up to `most` times; a crowded one fills neither the sample nor the classes.
    examples = scanned.where(F.length("learn") > 0).select("learn").mapInPandas(rows, "x binary").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = examples.orderBy(F.xxhash64("x"), "x").limit(sample).collect()
    if not got:
        return None
    n = np.minimum([r["n"] for r in got], most)
    a = np.repeat(np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(float), n, axis=0)
    x, y, held = a[:, :-1], a[:, -1], np.repeat(np.arange(len(got)) % 5 == 0, n)
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 5:
        return None
    trees = Trees().fit(x[~held], y[~held])
    score, y, of = trees.score(x[held]), y[held], x[held][:, : len(KINDS)].argmax(1)
    steps, least = [], []
    for k in range(len(KINDS)):
        own = of == k if min(y[of == k].sum(), (1 - y[of == k]).sum()) >= 20 else np.ones(len(y), bool)  # too few: those of all kinds
        steps.append(isotonic(score[own], y[own]))
        chance = calibrated(steps[-1], score[own])
        cuts = np.unique(chance)
        right = [y[own][chance >= c].mean() for c in cuts]
        least.append(min((c for c, r in zip(cuts, right, strict=True) if r >= precise), default=2.0))
    return trees, steps, least


def chances(model: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated chance and threshold of each candidate, by its kind."""
    trees, steps, least = model
    score, of = trees.score(x), x[:, : len(KINDS)].argmax(1)
    out = np.zeros(len(x))
    for k in range(len(KINDS)):
        if (of == k).any():
            out[of == k] = calibrated(steps[k], score[of == k])
    return out, np.array(least)[of]


def choose(found: np.ndarray, chance: np.ndarray, base: np.ndarray, least: np.ndarray) -> list[tuple[int, int, int]]:
    """Candidates with enough chance, the likeliest first, apart from the patterns' spans and from each other."""
    starts, ends, out = [], [], []  # what is taken, in order and without overlap, so the two neighbours decide
    for _, s, e in sorted(base.tolist(), key=lambda x: x[1:]):
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    enough = np.flatnonzero(chance >= least)
    for i in enough[np.lexsort((found[enough, 1], -chance[enough]))]:
        k, s, e = found[i].tolist()
        at = bisect_right(starts, s)
        if (at == 0 or ends[at - 1] <= s) and (at == len(starts) or e <= starts[at]):
            starts.insert(at, s)
            ends.insert(at, e)
            out.append((k, s, e))
    return out


def personal_data(docs: DataFrame, sample: int = 20_000, precise: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (of the patterns), base (their spans) and spans (all), each as kind:start:end, comma-joined."""
    scanned = written(scan(docs, id_col, text_col), "personal-data")
    model = learn(scanned, sample, precise)

    def rows(batches):
        def told(a):
            return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in a)

        for b in batches:
            out, at = [], 0
            x = np.frombuffer(b"".join(b["feats"]), np.float32).reshape(-1, WIDTH).astype(float)
            chance, least = chances(model, x) if model and len(x) else (np.zeros(len(x)), np.ones(len(x)))
            for base, found in zip(b["base"], b["found"], strict=True):
                base, found = np.frombuffer(base, np.int64).reshape(-1, 3), np.frombuffer(found, np.int64).reshape(-1, 3)
                own = slice(at, at := at + len(found))
                more = choose(found, chance[own], base, least[own]) if model and len(found) else []
                out.append((*np.bincount(base[:, 0], minlength=4).tolist(), told(base.tolist()), told(sorted([*map(tuple, base.tolist()), *more]))))
            columns = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
            yield pd.DataFrame(out, columns=columns).assign(doc=b["doc"].astype("Int64").to_numpy())

    schema = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, doc long"
    found = scanned.select("doc", "base", "found", "feats").mapInPandas(rows, schema)
    return found.select(F.col("doc").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base", "spans")
