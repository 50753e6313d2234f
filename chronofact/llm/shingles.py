"""Word shingles as 64-bit hashes, a whole Arrow batch at a time.

Words are maximal runs of bytes other than x20 and x09 to x0D of the lower-cased (A-Z only) UTF-8
text. Everything below works on the batch's concatenated bytes, so no Python object is made per word.

A word's hash is the scrambled sum of one pseudorandom number for each (place in the word, byte). Sums
don't mind where they are cut, so texts are read in windows: a long text costs its words, not a multiple
of its bytes, and a word longer than a window is put together from its parts.
"""

from __future__ import annotations

import numpy as np

from chronofact.llm.common import BLANKS, mix64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[ord(c) for c in BLANKS]] = True
_SEED = np.uint64(0xD6E8FEB86659FD93)
#: The numbers of the first places of a word are looked up, those of later ones computed.
_PLACES = 64
_TABLE = mix64(np.arange(_PLACES * 256, dtype=np.uint64) + _SEED)
#: Bytes of a window.
WINDOW = 1 << 20


def _numbers(place: np.ndarray, byte: np.ndarray, most: int) -> np.ndarray:
    """place: below most."""
    key = (place << 8) | byte
    return _TABLE[key] if most <= _PLACES else mix64(key.astype(np.uint64) + _SEED)


def _window(raw: np.ndarray, cuts: np.ndarray, blank_bytes: np.ndarray, begun: int, prefixes: tuple[int, ...]) -> tuple:
    """First bytes, lengths, sums and prefix sums of the (parts of) words of raw; cuts are places that no word spans.

    begun: bytes that the first word has in front of raw.
    """
    inside = ~blank_bytes[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[cuts] |= inside[cuts]
    first = np.flatnonzero(start)
    if not len(first):
        return first, first, np.zeros(0, np.uint64), [np.zeros(0, np.uint64) for _ in prefixes]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cuts[cuts > 0] - 1] |= inside[cuts[cuts > 0] - 1]
    length = np.flatnonzero(end) - first + 1
    ordinal = np.cumsum(length) - length
    ahead = np.zeros(len(first), np.int64)
    if first[0] == 0:
        ahead[0] = begun
    place = np.arange(int(ordinal[-1] + length[-1])) - np.repeat(ordinal - ahead, length)
    number = _numbers(place, _LOWER[raw[inside]], int((length + ahead).max()))
    starts = []
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(number, ordinal)
        for p in prefixes:
            near = np.flatnonzero((length >= p) & (ahead == 0))
            part = np.zeros(len(first), np.uint64)
            for k in range(p):
                part[near] += number[ordinal[near] + k]
            part[near] = mix64(part[near] + np.uint64(p))
            starts.append(part)
    return first, length, sums, starts


def words(raw: np.ndarray, at: np.ndarray, blank_bytes: np.ndarray = _IS_BLANK, prefixes: tuple[int, ...] = (), window: int = WINDOW) -> tuple:
    """64-bit hashes of all words of the texts raw[at[i]:at[i+1]], and each text's number of words.

    With prefixes (none longer than a window), also one array for each of them: the hashes of the words'
    first so many bytes (0 for shorter words).
    """
    n = len(at) - 1
    counts = np.zeros(n, np.int64)
    lengths, sums, starts = [], [], [[] for _ in prefixes]
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + window)
        if hi < len(raw):  # rather between two words or texts than inside a word
            seen = np.flatnonzero(blank_bytes[raw[lo:hi]])
            between = int(at[np.searchsorted(at, hi, side="right") - 1])
            between = max(between, lo + int(seen[-1]) + 1) if len(seen) else between
            hi = between if between > lo else hi
        edge = np.searchsorted(at, [lo, hi], side="left")
        cuts = at[edge[0] : edge[1]] - lo
        glued = lo > 0 and len(lengths) and not blank_bytes[raw[lo - 1]] and not blank_bytes[raw[lo]] and not (len(cuts) and cuts[0] == 0)
        first, length, part, begin = _window(raw[lo:hi], cuts, blank_bytes, int(lengths[-1][-1]) if glued else 0, prefixes)
        if len(first):
            new = first
            if glued:
                with np.errstate(over="ignore"):
                    sums[-1][-1] += part[0]
                lengths[-1][-1] += length[0]
                new, length, part, begin = first[1:], length[1:], part[1:], [b[1:] for b in begin]
            if len(new):
                owner = np.searchsorted(at, new + lo, side="right") - 1
                counts += np.bincount(owner, minlength=n)
                lengths.append(length)
                sums.append(part)
                for s, b in zip(starts, begin):
                    s.append(b)
        lo = hi
    none = [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        length = np.concatenate(lengths).astype(np.uint64) if lengths else none[0]
        whole = mix64(np.concatenate(sums or none) + length * _SEED)
    return (whole, counts, *(np.concatenate(s or none) for s in starts))


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted, end to end; and each text's number of them.

    A text with fewer than width words has one shingle, all its words; one without words has none.
    """
    h, counts = words(raw, at)
    n = len(counts)
    if not len(h):
        return h, np.zeros(n, np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    size = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(n), size)
    pos = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(doc))
    ends = (begin + counts)[doc]
    with np.errstate(over="ignore"):
        value = np.zeros(len(doc), np.uint64)
        for i in range(width):
            inside = pos + i < ends
            value = mix64(value * np.uint64(0x2545F4914F6CDD1D) + np.where(inside, h[np.minimum(pos + i, len(h) - 1)], np.uint64(i + 1)))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], np.bincount(doc[keep], minlength=n).astype(np.int64)
