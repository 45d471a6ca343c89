"""What several operators share."""

from __future__ import annotations

import string
import sys
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; pure ASCII texts take the faster built-in way."""
    by_letter = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(by_letter)


def worker_cache(name: str, make):
    """What `make()` returned first in this Python process; tasks of a reused worker share it."""
    held = sys.modules.setdefault("_tonalframe_held", types.ModuleType("_tonalframe_held"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def free_name(df: DataFrame, base: str) -> str:
    """`base`, or it with underscores, as a name that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
