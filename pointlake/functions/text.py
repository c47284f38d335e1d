"""Tokens, character n-grams and chunks."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = r"[\s\u0085\p{Z}]+"
_EDGE = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"
_PY_EDGE = regex.compile(r"^[^\p{Alphabetic}\p{N}]+|[^\p{Alphabetic}\p{N}]+$")
_PY_BLANK = regex.compile(r"\p{White_Space}+")


def _trimmed(words: Column) -> Column:
    return F.filter(F.transform(words, lambda x: F.regexp_replace(x, _EDGE, "")), lambda x: x != "")


def words_any(text: Column) -> Column:
    """Words in lower case without marks at their edges."""
    return _trimmed(F.split(F.lower(text), _BLANK))


def words_long(text: Column) -> Column:
    """As :func:`words_any`, of words that have more than two bytes with their marks."""
    return _trimmed(F.filter(F.split(F.lower(text), _BLANK), lambda x: F.octet_length(x) > 2))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """N-grams of characters in lower case; a shorter text is one gram."""
    low = F.lower(text)
    chars = F.split(low, "")
    size = F.char_length(low)
    grams = chars  # zipped with its own tails: a place in a text is never sought from the start
    for j in range(1, n):
        grams = F.zip_with(grams, F.slice(chars, F.lit(j + 1), F.greatest(size - j, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(size < n, F.array(low)).otherwise(F.filter(grams, lambda g: g.isNotNull()))


def _gram_counts(low: str, n: int) -> tuple[int, int]:
    a = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(a) < n:
        return 1, 1
    if n > 3:
        return len(a) - n + 1, len({low[i : i + n] for i in range(len(a) - n + 1)})
    size = len(a) - n + 1
    key = a[:size].copy()
    for j in range(1, n):  # a character has 21 bits
        key = key << 21 | a[j : j + size]
    key.sort()
    return size, 1 + int(np.count_nonzero(key[1:] != key[:-1]))


def gram_counts(text: Column, n: int = 3) -> Column:
    """Struct (n, n_distinct) of the sizes of :func:`char_ngrams`, without making the grams; null for a null text."""

    @F.pandas_udf("n bigint, n_distinct bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([_gram_counts(t or "", n) for t in s], columns=["n", "n_distinct"])

    return F.when(text.isNotNull(), count(F.lower(text)))


def _split(text: str) -> list[str]:
    low = text.lower()
    # str.split() takes these four for white space, which they aren't
    return _PY_BLANK.split(low) if any(x in low for x in "\x1c\x1d\x1e\x1f") else low.split()


def _trim(x: str) -> str:
    x = x.strip(string.punctuation)
    return x if not x or x[0].isalnum() and x[-1].isalnum() else _PY_EDGE.sub("", x)


def py_words_any(text: str) -> list[str]:
    return [w for x in _split(text) if (w := x if x.isalnum() else _trim(x))]


def py_words_long(text: str) -> list[str]:
    return [w for x in _split(text) if (len(x) > 2 or len(x.encode()) > 2) and (w := x if x.isalnum() else _trim(x))]


def py_char_ngrams(text: str, n: int = 3) -> list[str]:
    low = text.lower()
    return [low] if len(low) < n else [low[i : i + n] for i in range(len(low) - n + 1)]


_SPACE = regex.compile(rb"(?:[\x09-\x0d\x20]|\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)")
_WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_LEAD = regex.compile(rb"(?:" + _SPACE.pattern + rb")*")
_STOP = regex.compile(rb"(?:" + _SPACE.pattern + rb"|[.!?])")


def chunks(text: str, max_chars: int = 2048, overlap: int = 128) -> list[tuple[str, int, int]]:
    """(text, first byte, end byte) of windows of at most ``max_chars`` bytes that end after
    white space or a full stop where there is one, cut at characters and trimmed."""
    data, size = text.encode(), max(1, max_chars)
    inside = lambda k: k < len(data) and data[k] & 0xC0 == 0x80
    back, out, lo = min(overlap, size - 1), [], 0
    while lo < len(data):
        hi = min(lo + size, len(data))
        if hi < len(data):
            while hi > lo and inside(hi):
                hi -= 1
            stop = None
            for stop in _STOP.finditer(data, lo, hi):
                pass
            if stop:  # one byte after where the mark begins, then back to a character
                hi = stop.start() + 1
                while hi > lo and inside(hi):
                    hi -= 1
        part = data[lo:hi]
        first = _LEAD.match(part).end()
        body = part[first:].decode().rstrip(_WHITE)
        if body:
            out.append((body, lo + first, lo + first + len(body.encode())))
        nxt = hi - back if hi >= back else hi
        if nxt <= lo:
            nxt = hi
        while inside(nxt):
            nxt += 1
        if nxt <= lo:
            break
        lo = nxt
    return out


_CHUNK = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def chunk_column(text: Column, max_chars: int = 2048, overlap: int = 128) -> Column:
    """Array of (text, start, end), in Arrow batches; null for a null text."""

    @F.pandas_udf(_CHUNK)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else [{"text": a, "start": b, "end": e} for a, b, e in chunks(t, max_chars, overlap)])

    return cut(text)
