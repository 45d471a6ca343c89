"""The nine shares of a reading against a plain count, song by song."""

import random

import pytest

from tonalframe.operators.evaluation import song_scores


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    return best[-1]


def plain(truth, read, changes, read_changes):
    """truth, read: {row: {measure: [(raw, beat)]}}."""
    n_truth = n_read = met = near = same = strict = sequence = like = measures = 0
    for row, bars in truth.items():
        other = read.get(row, {})
        like += len(bars) == len(other)
        for m, chords in bars.items():
            measures += 1
            known, left = [c for c in chords if c[0] != "?"], list(other.get(m, []))
            strict += m in other and [c[0] for c in known] == [c[0] for c in left]
            n_truth += len(known)
            for raw, beat in known:
                hit = next((i for i, c in enumerate(left) if c[0] == raw), None)
                if hit is not None:
                    met += 1
                    off = abs(left.pop(hit)[1] - beat)
                    near, same = near + (off <= 0.5), same + (off < 1e-4)
        flat = lambda x: [c[0] for m in sorted(x) for c in x[m] if c[0] != "?"]
        sequence += lcs(flat(bars), flat(other))
    n_read = sum(len(c) for bars in read.values() for c in bars.values())
    left, hits = sorted(read_changes), 0
    for measure, step in sorted(changes):
        hit = next((c for c in left if c[1] == step and abs(c[0] - measure) <= 2), None)
        if hit:
            hits += 1
            left.remove(hit)
    keys = 1.0 if not changes and not read_changes else 0.0 if not changes or not read_changes else hits / max(len(changes), len(read_changes))
    share = lambda a, n, none=1.0: a / n if n else none
    rows = min(len(truth), len(read)) / max(len(truth), len(read), 1)
    return rows, share(like, len(truth)), share(strict, measures), share(met, n_truth), share(met, n_read, 0.0 if n_truth else 1.0), share(sequence, n_truth), share(near, met), share(same, met), keys


def test_song_scores(spark):
    rng = random.Random(8)
    songs = {}
    for song in range(40):
        chord = lambda: (rng.choice(["1", "4", "5", "6m", "?"]), rng.choice([1.0, 2.0, 2.5, 3.0]))
        truth = {r: {m: [chord() for _ in range(rng.choice([0, 1, 1, 2, 3]))] for m in range(rng.randint(1, 4))} for r in range(rng.randint(1, 4))}
        read = {r: {m: [(c[0] if c[0] != "?" and rng.random() < 0.8 else "2m", c[1] + rng.choice([0, 0, 0.5, 1.0])) for c in x if rng.random() < 0.9] for m, x in bars.items() if rng.random() < 0.95} for r, bars in truth.items()}
        read = {} if song == 7 else {r: b for r, b in read.items() if b and rng.random() < 0.9}
        change = lambda n: sorted({(rng.randrange(12), rng.choice([1, 2])) for _ in range(n)})
        songs[song] = truth, read, change(rng.randint(0, 3)), change(rng.randint(0, 3))
    place = lambda i: [(s, r, m) for s, x in songs.items() for r, bars in x[i].items() for m in bars]
    listed = lambda i: [(s, r, m, k, *c) for s, x in songs.items() for r, bars in x[i].items() for m, chords in bars.items() for k, c in enumerate(chords)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    spot, chord, change = "song long, row long, measure long", "song long, row long, measure long, k int, raw string, beat double", "song long, measure long, semitones int"
    changes = lambda i: [(s, *c) for s, x in songs.items() for c in x[i]]
    found = song_scores(make(place(0), spot), make(place(1), spot), make(listed(0), chord), make(listed(1), chord), make(changes(2), change), make(changes(3), change))
    got = {r.song: tuple(r)[1:] for r in found.collect()}
    assert set(got) == set(songs)
    for song, x in songs.items():
        assert got[song] == pytest.approx(plain(*x), abs=6e-4), song


def test_song_scores_shuffles_once_by_row_and_once_by_song(spark, data):
    """Each shuffle is a stage whose plan and code the driver holds: measures and chords by rows of songs, songs, their key changes."""
    from tonalframe.plans import registry

    plan = registry.queries()["song_scores"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert 2 <= plan.count("Exchange hashpartitioning") <= 4
