"""Hashed n-grams of Arrow string batches, computed with numpy inside tasks."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into n-grams at once.
SLICE_BYTES = 4 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and row offsets of a string array without nulls."""
    texts = texts.cast(pa.large_utf8())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of a string array without nulls."""
    data, _ = _bytes(texts)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum(lengths)))


#: First and last code points of scripts written without spaces, whose characters are words by themselves.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 outside words, 1 in a run that is a word, 2 a word by itself."""
    kinds = np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(sys.maxunicode + 1)), dtype=np.int8, count=sys.maxunicode + 1)
    for first, last in _UNSPACED:
        kinds[first : last + 1] *= 2
    return kinds


def _word_ngrams(texts: pa.Array, n: int, unicode: bool) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = _points(texts) if unicode else _bytes(texts)
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    kinds = _kinds()[data] if unicode else _WORD[data].astype(np.int8)
    inside, alone = kinds > 0, kinds == 2
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    goes_on = np.concatenate(([False], inside[:-1] & ~alone[:-1])) & ~alone
    starts = np.flatnonzero(inside & (edge[:-1] | ~goes_on))
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    begun = np.zeros(len(data), dtype=np.int64)
    begun[starts] = starts
    place = np.arange(len(data), dtype=np.int64) - np.maximum.accumulate(begun)
    place[~inside] = 0
    power = np.cumprod(np.full(int(place.max()) + 1, _BASE, dtype=np.uint64))
    letters = (data.astype(np.uint64) + np.uint64(1)) * power[place]
    letters[~inside] = 0
    words = mix(np.add.reduceat(letters, starts))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    if len(words) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    last = len(words) - n + 1
    grams = words[:last].copy()
    for k in range(1, n):
        grams = mix(grams * _BASE + words[k : last + k])
    whole = rows[:last] == rows[n - 1 :]
    return rows[:last][whole], grams[whole]


def _char_ngrams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of code points."""
    data, offsets = _points(texts)
    last = len(data) - n + 1
    if last <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    grams = np.zeros(last, dtype=np.uint64)
    for k in range(n):
        grams = mix(grams * _BASE + data[k : last + k].astype(np.uint64) + np.uint64(1))
    whole = rows[:last] == rows[n - 1 :]
    return rows[:last][whole], grams[whole]


def gram_sets(texts: pa.Array, kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashed n-grams, sorted by both, each n-gram of a row once.

    The kinds: ``word`` takes runs of a-z and 0-9, ``text`` runs of letters, marks and digits of
    any script (single characters in scripts without spaces), ``char`` code points.
    """
    rows, grams = _char_ngrams(texts, n) if kind == "char" else _word_ngrams(texts, n, kind == "text")
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    if len(rows):
        new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])))
        rows, grams = rows[new], grams[new]
    return rows, grams


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each; a longer text comes alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)
