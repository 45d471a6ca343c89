"""Scores of candidate readings against melody and context, and the decisions drawn from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def melody_fit(pcs: Column, notes: Column, beat: Column, length: Column) -> Column:
    """Weighted share of notes (array of struct onset, pc) that are chord tones. Notes on whole beats or at the chord's start count twice;
    without notes in the chord's span all notes of the bar count; 0.5 if there are none."""
    inside = F.filter(notes, lambda n: (n["onset"] >= beat - 0.01) & (n["onset"] < beat + length - 0.01))
    used = F.when(F.size(inside) > 0, inside).otherwise(notes)
    weight = lambda n: F.when((F.abs(n["onset"] - F.rint(n["onset"])) < 0.05) | (F.abs(n["onset"] - beat) < 0.05), 2.0).otherwise(1.0)
    hit = F.aggregate(used, F.lit(0.0), lambda a, n: a + F.when(F.array_contains(pcs, n["pc"]), weight(n)).otherwise(0.0))
    total = F.aggregate(used, F.lit(0.0), lambda a, n: a + weight(n))
    return F.when(F.coalesce(F.size(used), F.lit(0)) <= 0, 0.5).otherwise(hit / F.nullif(total, F.lit(0.0)))


def bass_hint_fit(bass_pc: Column, hint: Column) -> Column:
    """1 if the hint's first degree is the chord's bass, 0 if not, null without a hint."""
    sign, degree = F.regexp_extract(hint, "([b#.]?)([1-7])", 1), F.regexp_extract(hint, "([b#.]?)([1-7])", 2)
    step = F.element_at(F.array(*map(F.lit, [0, 2, 4, 5, 7, 9, 11])), F.try_to_number(F.nullif(degree, F.lit("")), F.lit("9")).cast("int"))
    pc = F.pmod(step + F.when(sign.isin("b", "."), -1).when(sign == "#", 1).otherwise(0), F.lit(12))
    return F.when(hint.rlike("[1-7]"), F.when(pc == bass_pc, 1.0).otherwise(0.0))


def combined(melody: Column, progression: Column, bass: Column) -> Column:
    """The prior of a candidate."""
    return F.when(bass.isNotNull(), 0.4 * melody + 0.35 * progression + 0.25 * bass).otherwise(0.55 * melody + 0.45 * progression)


def final_decision(valid: Column, prior: Column, top: Column, other: Column, reread: Column) -> Column:
    """What becomes of a chord that no evidence settles: `other`, the best candidate differs from it; `reread`, a second reading does."""
    better = other & (~valid | (prior < 0.4) & (top >= 0.75))
    return F.when(better, "replace").when(reread, "ambiguous").when(~valid, "invalid").otherwise("accept")


def evidence_decision(confidence: Column, consistent: Column, contradicted: Column, web_root: Column, web_bass: Column) -> Column:
    """The rung of the evidence ladder on which a reading is accepted."""
    return (
        F.when((confidence >= 0.8) & consistent & ~contradicted, "accept_reader")
        .when((confidence >= 0.7) & web_root & web_bass, "accept_web").when((confidence >= 0.7) & web_root, "accept_web_root").otherwise("review")
    )
