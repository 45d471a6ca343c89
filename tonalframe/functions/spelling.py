"""Names of notes in a key, made by rule: letters follow each other, signs make up what is missing in semitones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonalframe.functions.theory import DEFAULT_KEYS, DEGREE_SEMITONES

LETTERS, NATURAL = "CDEFGAB", [0, 2, 4, 5, 7, 9, 11]
#: Keys written with flats. Of the steps between a key's own notes, these are written from the degree above, all in flat keys and three of five in others.
FLAT_KEYS = ("F", "Bb", "Eb", "Ab", "Db", "Gb")
FROM_ABOVE = {True: {1: 2, 3: 3, 6: 5, 8: 6, 10: 7}, False: {3: 3, 8: 6, 10: 7}}
FROM_BELOW = {1: 1, 6: 4}


def pc_of(name: str) -> int:
    return (NATURAL[LETTERS.index(name[0])] + name.count("#") - name.count("b")) % 12


def degree_name(key: str, degree: int, sign: int = 0) -> str:
    """The note of a degree (1 to 7) of a major key, raised or lowered; two signs become the plain name of the same pitch, with the signs' own kind if it needs one."""
    at = (LETTERS.index(key[0]) + degree - 1) % 7
    pc = pc_of(key) + DEGREE_SEMITONES[degree - 1]
    signs = (pc - NATURAL[at] + 6) % 12 - 6 + sign
    if abs(signs) < 2:
        return LETTERS[at] + ("#" if signs > 0 else "b") * abs(signs)
    pc = (pc + sign) % 12
    return next(x for x in (*LETTERS, *(c + ("#" if signs > 0 else "b") for c in LETTERS)) if pc_of(x) == pc)


def spelled(key: str, pc: int) -> str:
    """A pitch class named in a major key: its own notes as they are, others by the rule of its signs."""
    step = (pc - pc_of(key)) % 12
    if step in DEGREE_SEMITONES:
        return degree_name(key, DEGREE_SEMITONES.index(step) + 1)
    above = FROM_ABOVE[key in FLAT_KEYS]
    return degree_name(key, above[step], -1) if step in above else degree_name(key, FROM_BELOW[step], 1)


def note_name(pc: Column, tonic: Column) -> Column:
    """The name of a pitch class in the usual key of a tonic; a table of 144 names made from the rule."""
    names = F.array(*[F.lit(spelled(k, p)) for k in DEFAULT_KEYS for p in range(12)])
    return F.element_at(names, (F.pmod(tonic, F.lit(12)) * 12 + F.pmod(pc, F.lit(12)) + 1).cast("int"))
