"""Vectorised hashes of words, shingles and byte n-grams over UTF-8 buffers.

A word's hash is a polynomial in its bytes, taken from prefix sums modulo 2**64 and then mixed, so a
whole buffer of documents costs a few numpy passes and no Python step per word."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; longer texts are cut between words.
SEGMENT = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SEGMENT, 1 << (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        _tables[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables[size]


def word_mask(is_word) -> np.ndarray:
    """A table of 256 booleans from a predicate on byte values."""
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words between ASCII white space, and words of ASCII letters, digits and all bytes beyond ASCII.
BLANK_SPLIT = word_mask(lambda b: not (b == 0x20 or 9 <= b <= 13))
ALNUM = word_mask(lambda b: b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122)


def _segment(buf: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = mask[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    power, inverse = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[buf] * power[: len(buf)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_of(texts: Sequence[str | None], mask: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of each text, A-Z lower-cased; null texts have none."""
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        joined = np.frombuffer(b" ".join(x for _, x in group), dtype=np.uint8)
        starts, _, hashes = _segment(joined, mask)
        cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for _, x in group]))
        at = 0
        for (i, _), cut in zip(group, cuts, strict=True):
            yield i, hashes[at:cut]
            at = cut

    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "replace").lower()
        if len(raw) > SEGMENT:
            yield i, _long(raw, mask)
            continue
        if held + len(raw) > SEGMENT and group:
            yield from flush()
            group, held = [], 0
        group.append((i, raw))
        held += len(raw) + 1
    if group:
        yield from flush()


def _long(raw: bytes, mask: np.ndarray) -> np.ndarray:
    """Word hashes of a long text, segment by segment, each cut after a byte that belongs to no word."""
    buf, parts, at = np.frombuffer(raw, dtype=np.uint8), [], 0
    while at < len(buf):
        end = min(len(buf), at + SEGMENT)
        while end < len(buf):
            gaps = np.flatnonzero(~mask[buf[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(buf), end + SEGMENT)  # one word fills the segment
        parts.append(_segment(buf[at:end], mask)[2])
        at = end
    return np.concatenate(parts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k consecutive words, sorted; a text of fewer words (but one) is one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.full(n, np.uint64(min(k, len(words))), dtype=np.uint64)
    for j in range(min(k, len(words))):
        out = mix(out ^ words[j : j + n]) * np.uint64(_BASE)
    return np.unique(out)
