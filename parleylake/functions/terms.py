"""Counting the terms of Arrow batches of texts: words and their pairs, character n-grams, as numbers into a list of terms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that share one list of terms, and n-grams that are counted at once.
PIECE, GRAMS = 2_000_000, 1_000_000
LOW, HIGH = 3, 5
#: What parts tokens, as ``\\s`` does in Spark's regular expressions.
BLANKS = [9, 10, 11, 12, 13, 32]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "folded", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts have ``most`` bytes; a text is never cut. Small batches are put together."""
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = sizes[lo - 1] if lo else 0
            hi = max(int(np.searchsorted(sizes, before + most - size, "right")), lo + (not held))
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                size += int(sizes[hi - 1] - before)
            if hi < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            lo = hi
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@lru_cache
def in_words() -> np.ndarray:
    """Which code points are letters, numbers or the low line."""
    return np.array([chr(i) == "_" or unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)])


@lru_cache
def in_tokens() -> np.ndarray:
    """Which code points aren't blank."""
    out = np.ones(0x110000, bool)
    out[BLANKS] = False
    return out


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, bytes, bytes at which a character begins and the end, code points) of large strings."""
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.uint32)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data, np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)), np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)


def _texts(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))


def runs(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row, text) of the longest runs of code points that are ``inside``, in order."""
    offsets, data, starts, points = _buffers(texts.cast(pa.large_string()))
    ok, first = inside[points], np.searchsorted(starts, offsets)  # a text's first character
    opens = ok.copy()
    opens[1:] &= ~ok[:-1]
    heads = first[:-1][first[:-1] < first[1:]]
    opens[heads] = ok[heads]
    begin = np.flatnonzero(opens)
    widths = np.diff(starts)
    kept = np.append(0, np.cumsum(np.where(ok, widths, 0)))  # bytes kept before each character
    return np.searchsorted(first, begin, "right") - 1, _texts(np.diff(np.append(kept[begin], kept[-1])), data[np.repeat(ok, widths)])


def _flat(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the run, the distinct runs)."""
    row, found = runs(texts, inside)
    coded = found.dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each stands there."""
    values = np.sort(values)
    begin = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    return values[begin], np.diff(begin, append=len(values))


def _ranked(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, a place of each, each value's number) of values from 0 to below ``most``; value and place are sorted as one number where they fit."""
    bits = len(values).bit_length()
    if most << bits >= 2**62:
        return np.unique(values, return_index=True, return_inverse=True)
    packed = np.sort(values << bits | np.arange(len(values)))
    values, place = packed >> bits, packed & (1 << bits) - 1
    begins = np.diff(values, prepend=-1) != 0
    number = np.empty(len(values), np.int64)
    number[place] = np.cumsum(begins) - 1
    return values[begins], place[begins], number


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, t, n) of words and pairs of neighbouring words, by row, of folded texts."""
    row, code, known = _flat(texts, in_words())
    beside = row[1:] == row[:-1]
    pairs, _, place = _ranked(code[:-1][beside] * max(len(known), 1) + code[1:][beside], max(len(known), 1) ** 2)
    left, right = (known.take(pa.array(x)) for x in (pairs // max(len(known), 1), pairs % max(len(known), 1)))
    terms = pa.concat_arrays([known, pc.binary_join_element_wise(left, right, pa.scalar(" ", pa.large_string()))])
    width = max(len(terms), 1)
    found, n = _counted(np.concatenate([row * width + code, row[1:][beside] * width + len(known) + place]))
    return terms, found // width, found % width, n


def grams_of(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, begins, grams): the n-grams of token i, padded by blanks, are ``grams[begins[i] : begins[i + 1]]``, repeats included. A padded token has three characters at least."""
    none, blank = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    padded = pc.binary_join_element_wise(none, tokens.cast(pa.large_string()), none, blank)
    offsets, data, starts, points = _buffers(padded)
    token = np.repeat(np.arange(len(padded)), np.diff(np.searchsorted(starts, offsets)))
    here = np.zeros(0x110000, bool)
    here[points] = True
    size, code = max(int(here.sum()), 1), (np.cumsum(here) - 1)[points]
    terms, of, ids, known = [], [], [], 0
    window, most = code, size  # of the n characters from each place on
    for n in range(2, HIGH + 1):
        if most * size >= 2**40:
            distinct, _, window = _ranked(window, most)
            most = len(distinct)  # at most so many values as places, so the next product fits
        window, most = window[: max(len(code) - n + 1, 0)] * size + code[n - 1 :], most * size
        if n < LOW:
            continue
        at = np.flatnonzero(token[: len(window)] == token[n - 1 :])
        _, first, number = _ranked(window[at], most)
        of.append(token[at])
        ids.append(number + known)
        begin, end = starts[at[first]], starts[at[first] + n]
        length = end - begin
        ends = np.cumsum(length)
        values = data[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(begin, length)]
        terms.append(_texts(length, values))
        known += len(first)
    sizes = [np.bincount(x, minlength=len(tokens)) for x in of]
    begins = np.append(0, np.cumsum(sum(sizes)))
    grams, free = np.empty(begins[-1], np.int64), begins[:-1].copy()
    for own, number, count in zip(of, ids, sizes, strict=True):  # a token's n-grams lie together, the short ones first
        grams[(free - np.cumsum(count) + count)[own] + np.arange(len(own))] = number
        free += count
    return pa.concat_arrays(terms), begins, grams


def chars(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, t, n) of character n-grams, by row; taken from distinct tokens, as often as each stands in a text."""
    row, code, known = _flat(texts, in_tokens())
    width = max(len(known), 1)
    found, times = _counted(row * width + code)
    row, code = found // width, found % width
    terms, begins, grams = grams_of(known)
    sizes = (begins[1:] - begins[:-1])[code]
    bits, step = len(terms).bit_length(), np.cumsum(np.bincount(row, weights=sizes, minlength=len(texts))) // GRAMS
    ends, out = np.searchsorted(row, np.arange(len(texts) + 1)), []
    for lo, hi in zip(*(np.searchsorted(step, np.unique(step), side) for side in ("left", "right")), strict=True):  # texts of one step lie together
        own = slice(ends[lo], ends[hi])
        k = sizes[own]
        place = np.arange(k.sum()) + np.repeat(begins[code[own]] - np.cumsum(k) + k, k)
        cells = np.repeat((row[own] - lo) << bits, k) | grams[place]
        few = int(times[own].max(initial=0)).bit_length()
        if int(hi - lo).bit_length() + bits + few < 62:  # count and cell fit in one number, so a plain sort will do
            packed = np.sort(cells << few | np.repeat(times[own], k))
            cells, often = packed >> few, packed & (1 << few) - 1
        else:
            order, often = np.argsort(cells, kind="stable"), np.repeat(times[own], k)
            cells, often = cells[order], often[order]
        begin = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1))
        out.append(((cells[begin] >> bits) + lo, cells[begin] & (1 << bits) - 1, np.add.reduceat(often, begin) if len(begin) else often))
    parts = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
    return terms, *parts


def distinct_terms(texts: pa.Array) -> dict[str, pa.Array]:
    """The terms of both channels, uncounted."""
    return {"word": words(texts)[0], "char": grams_of(pc.unique(runs(texts, in_tokens())[1]))[0]}
