"""Batch-wise splitting of text into the words of a byte-level tokenizer, and a bounded dictionary of encoded words.

The split pattern is fixed by the vocabulary files (contractions; an optional space before a run of letters, numbers or
other marks; white space). All work is on arrays of code points of many documents at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Code points worked on at once; one longer document is taken whole.
BATCH_CHARS = 1_000_000
BASE = 0x9E3779B97F4A7C15 | 1
_state: dict = {}


def char_classes() -> np.ndarray:
    """Class of every code point, by the Unicode properties that the pattern names."""
    if "classes" not in _state:
        import regex

        kind = np.zeros(0x110000, np.uint8)
        for first in range(0, 0x110000, 0x800):  # few at once: a list of all takes 200 MB of every worker
            if first == 0xD800:
                continue
            some = "".join(map(chr, range(first, first + 0x800)))
            for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
                for m in regex.finditer(pattern, some):
                    kind[first + m.start() : first + m.end()] = value
        kind[0xD800:0xE000] = OTHER
        _state["classes"] = kind
    return _state["classes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_state.get("powers", ((),))[0]) < n:
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _state["powers"] = tuple(out)
    return _state["powers"]


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined text, word starts, word ends, 64-bit word hashes, first word of each text and the total)."""
    joined = "".join(texts)
    cp = code_points(joined)
    n = len(cp)
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=firsts[1:])
    if not n:
        none = np.zeros(0, np.int64)
        return joined, none, none, none.astype(np.uint64), np.zeros(len(texts) + 1, np.int64)
    kind = char_classes()[cp]
    head = np.zeros(n + 2, bool)
    head[firsts[:-1]] = True
    head[n:] = True
    mark = head[: n + 1].copy()
    mark[1:n] |= kind[1:] != kind[:-1]
    # a white-space run before something else gives up its last character: a plain space joins what follows
    after = np.flatnonzero(mark[1:n] & ~head[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    mark[after - 1] = True
    mark[after] = cp[after - 1] != 32
    # contractions: an apostrophe that starts a word, and the letters it takes
    ticks = np.flatnonzero((cp == 39) & mark[:n] & ~head[1 : n + 1])
    if len(ticks):
        a = cp[ticks + 1]
        b = np.where(head[ticks + 2], 0, cp[np.minimum(ticks + 2, n - 1)])
        one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for hit, width in ((ticks[one], 1), (ticks[two & ~one], 2)):
            mark[hit + 1] = False
            mark[hit + 1 + width] = True
    bounds = np.flatnonzero(mark)
    starts, ends = bounds[:-1], bounds[1:]
    return joined, starts, ends, _hash(cp, starts, ends), np.searchsorted(starts, firsts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(found: list[str]) -> np.ndarray:
    """The hash that ``split`` gives to each of these words."""
    ends = np.cumsum([len(w) for w in found], dtype=np.int64)
    return _hash(code_points("".join(found)), np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(found)], ends)


def _hash(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(cp)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


#: A prime below 2**31, so products of two residues fit 64 bits, and two bases of no special form.
PRIME = (1 << 31) - 1
PRIME_BASES = (1_103_527_591, 741_103_597)


def _residues(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo PRIME, at least n of each."""
    known = _state.setdefault("residues", {})
    if len(known.get(base, ((),))[0]) < n:
        out = []
        for b in (base, pow(base, -1, PRIME)):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), PRIME)) % np.uint64(PRIME)])
            out.append(p)
        known[base] = tuple(out)
    return known[base]


def prime_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62 bits for each stretch of ``values``: two polynomials modulo a prime, so no text has the structure to make two agree."""
    parts = []
    for base in PRIME_BASES:
        power, inverse = _residues(len(values) + 1, base)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)] % np.uint64(PRIME), out=sums[1:])
        parts.append((sums[ends] - sums[starts]) % np.uint64(PRIME) * inverse[starts] % np.uint64(PRIME))
    return parts[0] << np.uint64(31) | parts[1]


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) with about BATCH_CHARS in each."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


class Dictionary:
    """Words seen and their ids; forgets all but the kept ones when it holds more than ``limit`` words or ``weight`` code
    points and ids, so memory is bounded.

    Words are found by a 64-bit hash and every hit is compared by its code points; a word whose hash another one holds
    gets an entry without a key.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 600_000, weight: int = 24_000_000, dtype=np.uint32):
        self.encode, self.limit, self.weight = encode, limit, weight
        none = np.zeros(0, np.int64)
        self.keys, self.slot, self.count, self.first, self.flat = none.astype(np.uint64), none, none, none, none.astype(dtype)
        self.begin, self.chars = np.zeros(1, np.int64), none.astype(np.uint32)
        self.keep()

    def keep(self) -> None:
        """What is held now is never forgotten."""
        self.kept = self.keys, self.slot, self.count, self.first, self.flat, self.begin, self.chars

    def clear(self) -> None:
        self.keys, self.slot, self.count, self.first, self.flat, self.begin, self.chars = self.kept

    def add(self, keys: np.ndarray, at: np.ndarray, found: list[str], ids: list | tuple[np.ndarray, np.ndarray]) -> None:
        """``keys`` ascending and new, ``at`` where they belong; words without a key come last. Ids are lists, or (counts, all ids)."""
        if isinstance(ids, tuple):
            count, flat = ids
        else:
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), self.flat.dtype, int(count.sum()))
        base = len(self.count)
        self.keys = np.insert(self.keys, at, keys)
        self.slot = np.insert(self.slot, at, np.arange(base, base + len(keys)))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(w) for w in found], dtype=np.int64)])
        self.chars = np.concatenate([self.chars, code_points("".join(found))])

    def slots(self, joined: str, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Entry of every word; new words are encoded once."""
        if len(self.keys) > self.limit or len(self.flat) + len(self.chars) > self.weight:
            self.clear()
        unique, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == unique[known]
        if not known.all():
            new = sample[~known]
            found = [joined[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            self.add(unique[~known], at[~known], found, self.encode(found))
            at = np.searchsorted(self.keys, unique)
        slot = self.slot[at][inverse]
        wrong = self.differing(code_points(joined), starts, ends, slot)
        if len(wrong):
            own = [joined[s:e] for s, e in zip(starts[wrong].tolist(), ends[wrong].tolist(), strict=True)]
            found = sorted(set(own))
            base = len(self.count)
            self.add(unique[:0], at[:0], found, self.encode(found))
            where = {w: base + i for i, w in enumerate(found)}
            slot[wrong] = [where[w] for w in own]
        return slot

    def differing(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Positions of the words that are not the word of their entry."""
        n = ends - starts
        wrong = n != self.begin[slot + 1] - self.begin[slot]
        n = np.where(wrong, 0, n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        off = self.chars[np.repeat(self.begin[slot], n) + inside] != cp[np.repeat(starts, n) + inside]
        if off.any():
            wrong[np.repeat(np.arange(len(slot)), n)[off]] = True
        return np.flatnonzero(wrong)

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, end of each word in them)."""
        count = self.count[slots]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.first[slots] - (ends - count), count) + np.arange(total)
        return self.flat[where], ends
