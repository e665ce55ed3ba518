"""Word shingles of many documents at once, as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from placescore.llm.words import _powers, chunks, prime_hash

#: A-Z lowered; other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The bytes between words, x20 and x09-x0D.
BREAK = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Sets:
    """Distinct shingle hashes of each document, ascending: those of document i are values[at[i]:at[i + 1]]."""

    values: np.ndarray
    at: np.ndarray


def shingle_sets(texts: list[str], k: int) -> Sets:
    """Words are what stands between white space after lowering A-Z. With fewer than ``k`` words the sequence is one shingle."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer((b" ".join(raw) + b" ").translate(LOWER), np.uint8)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=first[1:])
    solid = ~BREAK[buf]
    edge = np.diff(solid.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = mix(prime_hash(buf, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.searchsorted(starts, first)
    n = np.diff(at)
    factor = np.array([0x9E3779B97F4A7C15, *_powers(k + 2)[0][2 : k + 1].tolist()], np.uint64)
    whole = np.concatenate([np.zeros(0, np.uint64), word])
    h = np.zeros(len(word), np.uint64)
    for j in range(k):
        h[: len(word) - j] += whole[j:] * factor[j]
    doc = np.repeat(np.arange(len(texts)), n)
    inside = np.arange(len(word)) - at[doc]
    keep = inside <= n[doc] - k
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        own = word[at[i] : at[i + 1]]
        h[at[i]] = np.uint64((int((own * factor[: len(own)]).sum(dtype=np.uint64)) + len(own) * 0xA0761D6478BD642F) % (1 << 64))
        keep[at[i]] = True
    h, doc = mix(h[keep]), doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return Sets(h, np.searchsorted(doc, np.arange(len(texts) + 1)))


def fingerprints(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set; equal sets agree, others do not but with a chance of 2**-128."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
        sums = np.zeros(len(sets.values) + 1, np.uint64)
        np.cumsum(mix(sets.values * np.uint64(salt) + np.uint64(salt)), out=sums[1:])
        out.append(sums[sets.at[1:]] - sums[sets.at[:-1]])
    return out[0], out[1]


def in_chunks(texts: list[str | None], k: int) -> Iterator[tuple[int, int, Sets]]:
    """(first, last + 1, sets) of runs of documents."""
    for first, part in chunks([t or "" for t in texts]):
        yield first, first + len(part), shingle_sets(part, k)


def ordered_int(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as signed ones in the same order."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)
