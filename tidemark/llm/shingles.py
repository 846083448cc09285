"""Vectorised 64-bit hashes of words and word shingles for many texts at once.

A word's hash adds up a random value for each pair of place and byte (tabulation), so that two words whose bytes differ
anywhere have the same one with a chance of 2^-64; the table is random but fixed, so that runs agree. Words of more than
``SPAN`` bytes are hashed whole by XXH3. A shingle's hash combines its words'.
"""

from __future__ import annotations

import numpy as np
import xxhash

_rng = np.random.default_rng(20240229)
#: Bytes of a word that have random values of their own by place.
SPAN = 64
_TABLE = _rng.integers(0, 2**64 - 1, (SPAN, 256), dtype=np.uint64, endpoint=True)
_TABLE[:, ord("A") : ord("Z") + 1] = _TABLE[:, ord("a") : ord("z") + 1]  # lower-cases A-Z
_TABLE = _TABLE.ravel()
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters and digits and what isn't ASCII.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes whose words are hashed at once.
PIECE = 1_000_000


def word_spans(texts: list[bytes], blanks: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, first and end places of their words in them, hashes of the lower-cased words, offsets of the texts among the words).

    ``blanks`` tells for each byte whether it separates words; a line feed must.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    parts = [_spans_of(data[a:b], a, blanks) for a, b in _pieces(data, blanks)]
    begins, ends, hashes = map(np.concatenate, zip(*parts, strict=True))
    place = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    return data, begins, ends, hashes, np.concatenate([[0], np.searchsorted(begins, place, side="left")])


def _pieces(data: np.ndarray, blanks: np.ndarray) -> list[tuple[int, int]]:
    """Spans of about PIECE bytes that end after a blank, so that a long text needs no more memory at once than a short one."""
    cuts = [0]
    while cuts[-1] < len(data):
        end = cuts[-1] + PIECE
        while end < len(data) and not blanks[data[end - 1]]:
            end += 1
        cuts.append(min(end, len(data)))
    return list(zip(cuts[:-1], cuts[1:], strict=True)) or [(0, 0)]


def _spans_of(data: np.ndarray, at: int, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first and end places, hashes) of the words of a piece that begins at ``at``."""
    blank = blanks[data]
    inner = ~blank
    begins = np.flatnonzero(inner & np.concatenate([[True], blank[:-1]])[: len(data)])
    ends = np.flatnonzero(blank & np.concatenate([[False], inner[:-1]])[: len(data)])
    if not len(begins):
        return begins, ends, np.zeros(0, np.uint64)
    lengths = ends - begins
    starts = np.cumsum(lengths) - lengths
    chars = data[inner]
    place = np.arange(len(chars)) - np.repeat(starts, lengths)
    cell = np.minimum(place, SPAN - 1, out=place)
    cell <<= 8
    cell += chars
    with np.errstate(over="ignore"):
        hashes = mixed(np.add.reduceat(_TABLE[cell], starts) + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > SPAN).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[begins[i] : ends[i]].tobytes().lower())
    return begins + at, ends + at, hashes


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-cased words of all texts in turn, offsets of the texts among them)."""
    return word_spans(texts)[3:]


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in turn, offsets). A text of fewer words is one shingle; of none, none."""
    words, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    with np.errstate(over="ignore"):
        code = np.zeros(len(first), np.uint64)
        left = np.repeat(offsets[1:], n) - first
        padded = np.concatenate([words, np.zeros(size, np.uint64)])
        for k in range(size):
            code += np.where(left > k, padded[first + k] * _MULT[k], np.uint64(0))
        code = mixed(code + np.minimum(left, size).astype(np.uint64))
    order = np.lexsort((code, owner)) if len(texts) > 1 else np.argsort(code)
    code, owner = code[order], owner[order]
    keep = np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])])[: len(code)]
    return code[keep], np.searchsorted(owner[keep], np.arange(len(texts) + 1))
