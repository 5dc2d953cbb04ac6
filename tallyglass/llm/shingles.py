"""Word and shingle hashes of many texts at once, with numpy inside Spark tasks.

A word is a run of ASCII letters and digits or bytes of other characters, lower case. Its hash is
a polynomial in its bytes, read off prefix sums, so that no Python object is made for a word. Long
texts are cut into blocks between words; nothing but eight bytes a word is kept of a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), on unsigned arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, BLOCK + 1), _powers(_INV, BLOCK + 1)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of powers for a block of n bytes; longer than usual only for one enormous word."""
    return (_UP, _DOWN) if n < len(_UP) else (_powers(_P, n + 1), _powers(_INV, n + 1))


def word_hashes(data: np.ndarray, letters: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word in a byte array, which may be of any length."""
    out, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and letters[data[end - 1]] and letters[data[end]]:
            stop = np.flatnonzero(~letters[data[end:end + BLOCK]])
            end = end + (int(stop[0]) if len(stop) else min(BLOCK, len(data) - end))
        part = data[at:end]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = letters[part]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        up, down = _grown(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * up[:len(part)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
        out.append((hashes, starts + at, ends + at))
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def in_chunks(texts: list, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts with a line break after each, and where each text begins (one more at the end)."""
    raw = [((t.lower() if lower else t) if t else "").encode("utf-8", "replace") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), starts


def ngrams(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row that belong to one text, and the text of each."""
    if len(words) < n:
        return words[:0], owner[:0]
    h = words[:len(words) - n + 1].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(0x100000001B3) + words[k:len(words) - n + 1 + k])
    whole = owner[:len(words) - n + 1] == owner[n - 1:]
    return h[whole], owner[:len(words) - n + 1][whole]


def text_shingles(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, count; sorted by text, then hash.

    A text of fewer than n words but at least one has one shingle, all its words.
    """
    data, starts = joined(texts)
    words, at, _ = word_hashes(data)
    owner = np.searchsorted(starts, at, side="right") - 1
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    h, of = ngrams(words, owner, n)
    for doc in np.flatnonzero((counts > 0) & (counts < n)):
        mine = words[owner == doc] if len(texts) == 1 else words[np.searchsorted(owner, doc):np.searchsorted(owner, doc, side="right")]
        short = mine[:1].copy()
        for k in range(1, len(mine)):
            short = mix(short * np.uint64(0x100000001B3) + mine[k:k + 1])
        h, of = np.append(h, short), np.append(of, doc)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    where = np.flatnonzero(first)
    return of[where], h[where], np.diff(np.append(where, len(h)))
