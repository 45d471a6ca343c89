"""Token ids of texts by a public byte-level tokenizer, with pieces of texts looked up in a bounded cache."""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tonalframe.llm.common import worker_cache

#: White space as the tokenizer's own splitting pattern sees it (Unicode's White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: ASCII punctuation but the apostrophe, which the splitting pattern may join to letters.
MARKS = "!-&(-/:-@\\[-`{-~"
#: The splitting pattern has a border wherever these pieces meet; the first kind is one of its own pieces.
WORD = f" ?[{LETTERS}]++(?![^{SPACE}{MARKS}])"
PIECE = f"{WORD}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next one from 256."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in itself} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*itself}))}


class Encoder:
    """Encodes whole texts as the tokenizer itself does. `held` bounds the pieces and units kept, `longest` the characters of one worth keeping.

    A space before anything but white space begins a piece, so texts are cut at single spaces into units, whose ids are looked up by their
    number among a call's different units. Texts that name a special token, or have white space elsewhere than ASCII's or in runs with
    a space, take the way of whole texts.
    """

    def __init__(self, path: str, held: int = 1_000_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merge = self.model.model.tokenize
        self.code = "H" if self.model.get_vocab_size() < 1 << 16 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        self.held, self.longest, self.ids, self.units = held, longest, {}, [({}, {}), ({}, {})]
        self.split, self.is_word, self.letters = re.compile(PIECE).findall, re.compile(f" ?[{LETTERS}]+").fullmatch, byte_letters()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.wide_space = re.compile("[" + SPACE.replace("\\t-\\r ", "") + "]").search

    def apart(self, text: str) -> bool:
        return any(x in text for x in self.special) or not text.isascii() and bool(self.wide_space(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids in the little-endian `dtype`."""
        out = self.by_units(texts)
        other = [i for i, x in enumerate(out) if x is None]
        whole = [i for i in other if self.apart(texts[i])]
        for i, e in zip(whole, self.model.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = array(self.code, e.ids).tobytes()
        rest = [i for i in other if out[i] is None]
        parts = [self.split(texts[i]) for i in rest]
        get = self.pieces(chain.from_iterable(parts)).__getitem__
        for i, p in zip(rest, parts, strict=True):
            out[i] = b"".join(map(get, p))
        return out

    def by_units(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text, or None where single spaces do not show the borders."""
        out: list[bytes | None] = [None] * len(texts)
        pa.default_memory_pool().release_unused()
        mine = [i for i, x in enumerate(texts) if x and not self.apart(x)]
        if not mine:
            return out
        lists = pc.split_pattern(pa.array([texts[i] for i in mine], pa.large_string()), " ")
        found = lists.flatten().dictionary_encode()
        at, names = found.indices.to_numpy().copy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        bounds = lists.offsets.to_numpy()
        first = bounds[:-1]
        # A first unit has no space before it, so it is another one than the same letters later on.
        starts = [names[k] for k in at[first].tolist()]
        new = {x: len(names) + n for n, x in enumerate(dict.fromkeys(starts))}
        bad = np.array([not x or x[0] in " \t\n\x0b\x0c\r" for x in names] + [False] * len(new))
        at[first] = [new[x] for x in starts]
        fits = ~np.logical_or.reduceat(bad[at], first)
        values = self.unit_ids(names, " ", 1) + self.unit_ids(list(new), "", 0)
        ids = np.frombuffer(b"".join(values), self.dtype)
        size = np.fromiter(map(len, values), np.int64, len(values)) // ids.itemsize
        shift = np.cumsum(size) - size
        n = size[at]
        ends = np.cumsum(n)
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        ids = ids[np.repeat((shift[at] - (ends - n)).astype(kind), n) + np.arange(ends[-1], dtype=kind)]
        stop = ends[bounds[1:] - 1].tolist()
        for i, ok, a, b in zip(mine, fits.tolist(), [0, *stop], stop, strict=False):
            if ok:
                out[i] = ids[a:b].tobytes()
        return out

    def unit_ids(self, units: list[str], before: str, which: int) -> list[bytes]:
        known, older = self.units[which]
        if len(known) > self.held // 2:  # units not met since the last time go
            known, older = {}, known
            self.units[which] = known, older
        out = list(map(known.get, units))
        new = [i for i, x in enumerate(out) if x is None]
        if older:
            again = list(map(older.get, [units[i] for i in new]))
            for i, x in zip(new, again, strict=True):
                if x is not None:
                    out[i] = known[units[i]] = x
            new = [i for i, x in zip(new, again, strict=True) if x is None]
        plain = [i for i in new if self.is_word(before + units[i])]
        for i in plain:
            out[i] = self.merged(before + units[i])
        new = [i for i in new if out[i] is None]
        parts = [self.split(before + units[i]) for i in new]
        get = self.pieces(chain.from_iterable(parts)).__getitem__
        for i, p in zip(new, parts, strict=True):
            out[i] = b"".join(map(get, p))
        known.update((units[i], out[i]) for i in chain(plain, new) if len(units[i]) <= self.longest)
        return out

    def merged(self, word: str) -> bytes:
        # Byte letters: ASCII letters stand for themselves.
        shown = word.replace(" ", self.letters[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.merge(shown)]).tobytes()

    def pieces(self, parts) -> dict[str, bytes]:
        """Ids of pieces: a dictionary that has all of them."""
        known = self.ids
        if len(known) > self.held // 2:
            known.clear()
        new = {x for x in parts if x not in known}
        words = [x for x in new if self.is_word(x)]
        found = {x: self.merged(x) for x in words}
        other = list(new.difference(words))
        for i in range(0, len(other), 20_000):
            some = other[i : i + 20_000]
            for x, e in zip(some, self.model.encode_batch_fast(some, add_special_tokens=False), strict=True):
                found[x] = array(self.code, e.ids).tobytes()
        known.update((x, v) for x, v in found.items() if len(x) <= self.longest)
        once = {x: v for x, v in found.items() if len(x) > self.longest}
        return known | once if once else known


def encoder(path: str, held: int = 1_000_000) -> Encoder:
    return worker_cache(f"encoder_{path}_{held}", lambda: Encoder(path, held))


def text_slices(texts: list[str], most_chars: int = 8_000_000):
    """(start, end) of runs of texts with about `most_chars` characters at most; a longer text stands alone."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)
