"""Text, URL and JSON expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LYRIC_SIGNS = "[\\s\\p{Z}_,.?!，。？！、…—\"'“”‘’（）()]"
SECOND_LEVEL = ["com", "co", "org", "net", "gov", "edu"]
#: Section words in the order in which they are tried.
ROLES = [
    ("section", "(?i)^\\s*$|example|示例"), ("intro", "(?i)intro|前奏"), ("prechorus", "(?i)pre[- ]?chorus|預副歌|预副歌|導歌|导歌"), ("chorus", "(?i)chorus|副歌"),
    ("verse", "(?i)verse|主歌"), ("interlude", "(?i)interlude|間奏|间奏"), ("bridge", "(?i)bridge|橋段|桥段"), ("outro", "(?i)outro|ending|尾奏"),
]


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#:]+)", 1)


def registered_domain(name: Column) -> Column:
    """The last two labels of a host, three where the second last is a general one."""
    parts = F.split(name, "\\.")
    n = F.size(parts)
    last = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when(n <= 2, name).when(F.get(parts, n - 2).isin(SECOND_LEVEL), last(3)).otherwise(last(2))


def url_ok(url: Column, forbidden: list[str]) -> Column:
    name = host(url)
    bad = reduce(lambda a, b: a | b, [(name == x) | name.endswith(f".{x}") for x in forbidden], F.lit(False))
    return url.rlike("^https?://") & name.contains(".") & ~bad


def section_role(label: Column) -> Column:
    """Role of a section's label; the first word that fits decides. Single letters A to E are upper-cased, other labels stay."""
    found = F.when(F.lit(False), "")
    for role, pattern in ROLES:
        found = found.when(label.rlike(pattern), role)
    own = F.btrim(label)
    return found.when(own.rlike("(?i)^[a-e]$"), F.upper(own)).otherwise(own)


def repeated(text: Column) -> Column:
    """Whether a piece of up to eight characters stands three times in a row."""
    return text.rlike("(.{1,8})\\1{2,}")


def low_variety(text: Column, least: int = 6, share: float = 0.35) -> Column:
    letters = F.split(text, "")
    return (F.char_length(text) >= least) & (F.size(F.array_distinct(letters)) / F.greatest(F.char_length(text), F.lit(1)) < share)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text; 1 for two empty ones."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))


def clean_lyrics(text: Column) -> Column:
    """Text without white space, underscores and a list of signs; letters keep their case."""
    return F.regexp_replace(text, LYRIC_SIGNS, "")


def file_name(text: Column) -> Column:
    """Letters and digits of any script, underscores and hyphens stay; a run of other characters becomes one underscore."""
    return F.regexp_replace(F.regexp_replace(F.btrim(text), "[^\\p{L}\\p{N}_-]", "_"), "_+", "_")
