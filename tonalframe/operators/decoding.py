"""Chords of beats by the best path through 49 states, and the keys that follow from chords.

Scores are whole numbers (logs times 2^24), so sums do not depend on their order and a long series can be cut anywhere: a task turns a chunk of beats into the
matrix of best values from each state before it to each state at its end (a max-plus product), chunks' matrices are chained, then every chunk finds the way back through
its own beats. Results are those of one pass over the whole series, the lowest state of equals included, whatever the length of chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalframe.operators.folds import by_song
from tonalframe.operators.statistics import MAJOR, best_key
from tonalframe.sources.scratch import written

ONE = 1 << 24
# Families of a root's 14 qualities (min, maj, dim, aug, min6, maj6, min7, minmaj7, maj7, 7, dim7, hdim7, sus2, sus4) in the order of states, the last state being no chord.
FAMILIES = {"maj": (1, 5, 3, 9, 8), "min": (0, 7, 6, 4), "dim": (2, 10, 11), "sus4": (12, 13)}
NONE = 48
#: Cost of a change on a bar's first beat, its middle and elsewhere; what a move to another chord of the same root gets back; least share of a seventh.
CHANGE, SAME_ROOT, SEVENTH, MINOR_SEVENTH, IN_KEY = (0.5, 2.0, 2.5), 0.8, 0.32, 0.30, 0.15
#: Chords of a major key: semitones above the tonic and family.
DIATONIC = ((0, 0), (2, 1), (4, 1), (5, 0), (7, 0), (9, 1), (11, 2))


def whole(x) -> np.ndarray:
    return np.rint(np.asarray(x) * ONE).astype(np.int64)


def observed(posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log scores of the 49 states for posteriors (beats, 170), and the seventh of each root that its major and minor readings have: (beats, 12, 2), 0 none, 1 seventh, 2 major seventh."""
    by_root = posterior[:, :168].reshape(-1, 12, 14)
    sums = np.stack([by_root[:, :, list(q)].sum(2) for q in FAMILIES.values()], 2)
    scores = np.concatenate([sums.reshape(len(posterior), 48), posterior[:, 168:170].sum(1, keepdims=True)], 1)
    major, minor = np.maximum(1e-6, sums[:, :, 0]), np.maximum(1e-6, sums[:, :, 1])
    seven, maj7, min7 = by_root[:, :, 9] / major, by_root[:, :, 8] / major, by_root[:, :, [6, 4]].sum(2) / minor
    of_major = np.where((maj7 >= SEVENTH) & (maj7 > seven), 2, np.where(seven >= SEVENTH, 1, 0))
    return whole(np.log(np.maximum(1e-7, scores))), np.stack([of_major, (min7 >= MINOR_SEVENTH).astype(int)], 2)


def moves() -> np.ndarray:
    """Scores of moves for a bar's first beat, its middle and the others: (3, 49, 49)."""
    root = np.append(np.repeat(np.arange(12), 4), -1)
    gain = SAME_ROOT * ((root[:, None] == root) & (root[:, None] >= 0))
    out = np.stack([gain - c for c in CHANGE])
    out[:, np.arange(49), np.arange(49)] = 0.0
    return whole(out)


def phases(beats: np.ndarray, first: int, downbeats: np.ndarray | None = None) -> np.ndarray:
    """0 for a bar's first beat, 1 for its middle, 2 elsewhere: by the place between downbeats, or outside them by the beat's number (from `first`), four to a bar."""
    number = (first + np.arange(len(beats))) % 4
    plain = np.where(number == 0, 0, np.where(number == 2, 1, 2))
    if downbeats is None or len(downbeats) < 2:
        return plain
    k = np.searchsorted(downbeats, beats, "right") - 1
    inside = (k >= 0) & (k < len(downbeats) - 1)
    a = downbeats[np.clip(k, 0, len(downbeats) - 2)]
    part = (beats - a) / np.maximum(0.1, downbeats[np.clip(k, 0, len(downbeats) - 2) + 1] - a)
    between = np.where((part < 0.15) | (part >= 0.85), 0, np.where((part >= 0.35) & (part < 0.65), 1, 2))
    return np.where(inside, between, plain)


def key_gain(tonic: int) -> np.ndarray:
    """What the states of a key's own chords get on every beat."""
    out = np.zeros(49, np.int64)
    for step, family in DIATONIC:
        out[4 * ((tonic + step) % 12) + family] = whole(IN_KEY)
    return out


def product(obs: np.ndarray, phase: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best values from each state before a chunk to each state on its last beat."""
    best = trans[phase[0]] + obs[0]
    for o, p in zip(obs[1:], phase[1:], strict=True):
        best = (best[:, :, None] + trans[p]).max(1) + o
    return best


def way_back(before: np.ndarray | None, obs: np.ndarray, phase: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each beat and state the state before it, for values `before` the chunk (None: the series begins); and the values at its end."""
    back = np.zeros((len(obs), 49), np.int8)
    value = obs[0] if before is None else None
    for k in range(0 if before is not None else 1, len(obs)):
        total = (before if value is None else value)[:, None] + trans[phase[k]]
        back[k] = total.argmax(0)
        value = total.max(0) + obs[k]
    return back, value


def traced(back: np.ndarray, last: int) -> tuple[np.ndarray, int]:
    """States of a chunk that ends in `last`, and the state before it."""
    path = np.zeros(len(back), np.int8)
    for k in range(len(back) - 1, -1, -1):
        path[k] = last
        last = int(back[k, last])
    return path, last


def decoded(beats: DataFrame, chunk: int = 256) -> DataFrame:
    """series, beat, state of the best path. `beats` has series, beat (from 0), obs (49 whole numbers, little-endian) and phase."""
    trans = moves()
    cut = beats.withColumn("part", F.floor(F.col("beat") / chunk)).withColumn("chunk", F.concat_ws(":", F.col("series").cast("string"), F.col("part").cast("string")))

    def packed(c: dict) -> dict:
        obs, phase = np.stack([np.frombuffer(x, np.int64) for x in c["obs"]]), c["phase"].astype(np.int8)
        matrix = product(obs, phase, trans) if c["part"][0] else np.zeros(0, np.int64)
        return {"series": c["series"][:1], "part": c["part"][:1], "first": c["beat"][:1], "obs": [obs.tobytes()], "phase": [phase.tobytes()], "matrix": [matrix.tobytes()]}

    chunks = written(by_song(cut, "chunk", ["beat"], packed, "series long, part long, first long, obs binary, phase binary, matrix binary"), "chunks")

    def chained(c: dict) -> dict:
        """Values before each chunk of a series, from the chunks' matrices and the first one's beats; a chunk's matrix is some beats' worth of bytes."""
        value, out = None, []
        for k in range(len(c["part"])):
            out.append(b"" if value is None else value.tobytes())
            if value is None:
                value = way_back(None, np.frombuffer(c["obs"][k], np.int64).reshape(-1, 49), np.frombuffer(c["phase"][k], np.int8), trans)[1]
            else:
                value = (value[:, None] + np.frombuffer(c["matrix"][k], np.int64).reshape(49, 49)).max(0)
        return {"series": c["series"], "part": c["part"], "before": out}

    slim = chunks.select("series", "part", F.when(F.col("part") == 0, F.col("obs")).alias("obs"), F.when(F.col("part") == 0, F.col("phase")).alias("phase"), "matrix")
    before = by_song(slim, "series", ["part"], chained, "series long, part long, before binary")

    def backs(batches):
        for b in batches:
            for r in b.to_dict("records"):
                obs, phase = np.frombuffer(r["obs"], np.int64).reshape(-1, 49), np.frombuffer(r["phase"], np.int8)
                back, value = way_back(np.frombuffer(r["before"], np.int64) if r["before"] else None, obs, phase, trans)
                ends = np.array([traced(back, s)[1] for s in range(49)], np.int8)
                yield pd.DataFrame({"series": [r["series"]], "part": [r["part"]], "first": [r["first"]], "back": [back.tobytes()], "into": [ends.tobytes()], "best": [int(value.argmax())]})

    found = written(chunks.join(before, ["series", "part"]).mapInPandas(backs, "series long, part long, first long, back binary, into binary, best int"), "ways-back")

    def ended(c: dict) -> dict:
        """The state at the end of each chunk, from the last one back."""
        at, out = int(c["best"][-1]), []
        for into in c["into"][::-1]:
            out.append(at)
            at = into[at]  # a byte a state
        return {"series": c["series"], "part": c["part"], "last": out[::-1]}

    ends = by_song(found.select("series", "part", "into", "best"), "series", ["part"], ended, "series long, part long, last int")

    def paths(batches):
        for b in batches:
            for r in b.to_dict("records"):
                path, _ = traced(np.frombuffer(r["back"], np.int8).reshape(-1, 49), r["last"])
                yield pd.DataFrame({"series": r["series"], "beat": r["first"] + np.arange(len(path)), "state": path.astype(np.int32)})

    return found.join(ends, ["series", "part"]).mapInPandas(paths, "series long, beat long, state int")


def tones(quality: Column) -> Column:
    """Chord tones that tell a key: semitones above the root and weight. `quality` as in labels (maj, min7, ...) or chord symbols (m7, M7, ...)."""
    minor, dim = is_minor(quality), quality.contains("dim")
    third = F.when(minor | dim, 3).otherwise(4)
    fifth = F.when(dim, 6).when(quality.contains("aug"), 8).otherwise(7)
    seventh = F.when(quality.contains("maj7"), 11).otherwise(10)
    entry = lambda step, weight: F.struct(step.cast("int").alias("step"), F.lit(weight).alias("weight"))
    plain = F.array(entry(F.lit(0), 1.5), entry(third, 1.0), entry(fifth, 1.0))
    return F.when(quality.contains("7"), F.concat(plain, F.array(entry(seventh, 0.5)))).otherwise(plain)


def is_minor(quality: Column) -> Column:
    return quality.startswith("min") | (quality.startswith("m") & ~quality.startswith("maj"))


def chord_histogram(chords: DataFrame, notes: DataFrame | None = None, note_weight: float = 1.0) -> DataFrame:
    """series, pc, weight: seconds of chord tones (chords: series, seconds, root, quality), weighted, and of notes (series, seconds, midi)."""
    rows = chords.groupBy("series", "root", "quality").agg(F.sum("seconds").alias("seconds"))
    rows = rows.select("series", "root", "seconds", F.explode(tones(F.col("quality"))).alias("t"))
    rows = rows.select("series", F.pmod(F.col("root") + F.col("t.step"), F.lit(12)).cast("int").alias("pc"), (F.col("seconds") * F.col("t.weight")).alias("weight"))
    if notes is not None:
        rows = rows.unionByName(notes.select("series", F.pmod(F.rint("midi").cast("int"), F.lit(12)).alias("pc"), (F.col("seconds") * note_weight).alias("weight")))
    return rows.groupBy("series", "pc").agg(F.sum("weight").alias("weight"))


def home(histogram: DataFrame) -> DataFrame:
    """series, tonic of the best of 24 keys, a minor one's relative major; 0 if there is next to nothing."""
    enough = histogram.groupBy("series").agg((F.sum("weight") >= 1e-4).alias("_some"))
    tonic = F.pmod(F.col("tonic") + 3 * F.col("minor"), F.lit(12)).cast("int")
    return best_key(histogram).join(enough, "series").select("series", F.when(F.col("_some"), tonic).otherwise(0).alias("tonic"))


def full_key(chords: DataFrame, notes: DataFrame | None = None, stable: float = 0.8) -> DataFrame:
    """series, tonic, score: of 12 major keys the one that pitch, home chord, first and last chord speak for and foreign chords do not. `chords` has series, start, seconds, root, quality.

    Pitch counts by correlation with the key's profile, 0 if flat; the home chord by 0.40 of its share of time; the first and the last chord of `stable` seconds with 0.15 and 0.20 if it
    is the home chord; foreign time by 1.25 of its share, a root outside the key half as much again, a wrong third half, but on the seventh degree."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    bins = chord_histogram(chords, notes, 2.0).groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("pc", "weight"))).alias("m")).select("series", vector.alias("v"))
    long = F.col("seconds") >= stable
    edge = lambda pick: pick(F.when(long, F.struct("root", is_minor(F.col("quality")).alias("minor"))), F.when(long, F.col("start")))
    ends = chords.groupBy("series").agg(F.sum("seconds").alias("total"), edge(F.min_by).alias("head"), edge(F.max_by).alias("tail"))
    kinds = chords.groupBy("series", F.pmod("root", F.lit(12)).cast("int").alias("root"), is_minor(F.col("quality")).alias("minor")).agg(F.sum("seconds").alias("d"))
    kinds = kinds.groupBy("series").agg(F.collect_list(F.struct("root", "minor", "d")).alias("kinds"))
    rows = bins.join(ends, "series", "left").join(kinds, "series", "left")
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / 12
    rows = rows.withColumn("_c", F.transform("v", lambda x: x - mean))
    rows = rows.withColumn("_spread", F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x)))
    middle = sum(MAJOR) / 12
    profile, spread = [x - middle for x in MAJOR], sum((x - middle) ** 2 for x in MAJOR) ** 0.5
    share = lambda x: x / F.greatest(F.lit(1e-3), F.coalesce("total", F.lit(0.0)))

    def score(tonic: int) -> Column:
        fit = F.coalesce(F.try_divide(sum((F.col("_c")[i] * profile[(i - tonic) % 12] for i in range(1, 12)), F.col("_c")[0] * profile[-tonic % 12]), F.col("_spread") * spread), F.lit(0.0))
        timed = lambda use: F.aggregate(F.coalesce("kinds", F.array().cast("array<struct<root:int,minor:boolean,d:double>>")), F.lit(0.0), lambda a, x: a + use(F.pmod(x["root"] - tonic, F.lit(12)), x["minor"]) * x["d"])
        at_home = timed(lambda degree, minor: F.when((degree == 0) & ~minor, 1.0).otherwise(0.0))
        wrong = lambda degree, minor: F.when(~degree.isin(0, 2, 4, 5, 7, 9, 11), 1.5).when((degree != 11) & (minor != degree.isin(2, 4, 9)), 0.5).otherwise(0.0)
        end = lambda c, gain: F.when((F.pmod(F.col(c)["root"], F.lit(12)) == tonic) & ~F.col(c)["minor"], gain).otherwise(0.0)
        return fit + 0.40 * share(at_home) + end("head", 0.15) + end("tail", 0.20) - 1.25 * share(timed(wrong))

    keys = F.array(*[F.struct(F.bround(score(t), 9).alias("score"), F.lit(-t).alias("o"), F.lit(t).alias("tonic"), score(t).alias("raw")) for t in range(12)])
    best = F.array_max(keys)
    some = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) >= 1e-4
    return rows.select("series", F.when(some, best["tonic"]).otherwise(0).alias("tonic"), F.when(some, best["raw"]).alias("score"))


def labelled(path: DataFrame, sevenths: DataFrame) -> DataFrame:
    """series, beat, root, family, seventh of decoded beats; `sevenths` has series, beat and sevenths (24 numbers: of each root, its major and its minor reading)."""
    root, family = F.floor(F.col("state") / 4).cast("int"), F.pmod("state", F.lit(4)).cast("int")
    rows = path.join(sevenths, ["series", "beat"]).select("series", "beat", "state", root.alias("root"), family.alias("family"), "sevenths")
    own = F.when((F.col("state") < NONE) & (F.col("family") < 2), F.element_at("sevenths", F.col("root") * 2 + F.col("family") + 1)).otherwise(0)
    names = F.array(*map(F.lit, FAMILIES))
    name = F.element_at(names, F.col("family") + 1)
    full = F.when(own == 2, "maj7").when((own == 1) & (F.col("family") == 0), "7").when(own == 1, "min7").otherwise(name)
    return rows.select("series", "beat", F.when(F.col("state") < NONE, F.col("root")).alias("root"), F.when(F.col("state") < NONE, full).alias("quality"))


def segments(labels: DataFrame) -> DataFrame:
    """series, first, last (beat), root, quality of runs of equal labels; beats without a chord have none."""
    change = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(w))
    w = Window.partitionBy("series").orderBy("beat")
    rows = labels.withColumn("_n", F.sum((change("root") | change("quality")).cast("int")).over(w))
    return rows.where("root is not null").groupBy("series", "_n", "root", "quality").agg(F.min("beat").alias("first"), F.max("beat").alias("last")).drop("_n")


def chords_of(beats: DataFrame, chunk: int = 256) -> DataFrame:
    """Chord segments of series of beats (series, beat, posterior: array of 170 numbers) of equal length, four to a bar: decoded once, then again in favour of the key
    that the first result is in. series, first, last, root, quality, tonic."""

    def look(batches):
        for b in batches:
            obs, seven = observed(np.stack(b["posterior"]).astype(float))
            phase = np.array([0, 2, 1, 2])[b["beat"] % 4]
            yield pd.DataFrame({"series": b["series"], "beat": b["beat"], "obs": [x.tobytes() for x in obs], "phase": phase, "sevenths": seven.reshape(len(b), 24).tolist()})

    seen = written(beats.select("series", "beat", "posterior").mapInPandas(look, "series long, beat long, obs binary, phase int, sevenths array<int>"), "beats")
    sevenths = seen.select("series", "beat", "sevenths")
    once = segments(labelled(decoded(seen.drop("sevenths"), chunk), sevenths))
    keys = home(chord_histogram(once.select("series", "root", "quality", (F.col("last") - F.col("first") + 1).cast("double").alias("seconds"))))
    keys = written(keys, "keys")  # a row a series

    def favoured(batches):
        for b in batches:
            gain = {t: key_gain(t) for t in b["tonic"].dropna().unique().tolist()}
            b["obs"] = [x if pd.isna(t) else (np.frombuffer(x, np.int64) + gain[t]).tobytes() for x, t in zip(b["obs"], b["tonic"], strict=True)]
            yield b[["series", "beat", "obs", "phase"]]

    again = seen.drop("sevenths").join(keys, "series", "left").mapInPandas(favoured, "series long, beat long, obs binary, phase int")
    return segments(labelled(decoded(again, chunk), sevenths)).join(keys, "series", "left")
