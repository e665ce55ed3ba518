"""Hard negatives, shortest-pack-first packing and token alignment against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from placescore.llm import alignment, hard_negatives, shortest_first, words
from tests.llm.helpers import awkward, docs_of

JSON, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# ---- words ----


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate({97: 98, 98: 97})


def test_words_with_one_hash_stay_apart():
    a, b = thue_morse(1024)
    assert len(set(words.hashes([a, b]).tolist())) == 1  # the case at hand
    seen = words.Dictionary(lambda batch: [[ord(w[0])] for w in batch])
    for _ in range(2):
        joined, starts, ends, h, _ = words.split([a, b, "word", b])
        assert seen.gather(seen.slots(joined, starts, ends, h))[0].tolist() == [97, 98, 119, 98]


def test_shingles_and_encoders_keep_such_words_apart(spark):
    import base64

    from placescore.llm import bpe, packing, shingles

    a, b = thue_morse(1024)
    sets = shingles.shingle_sets([a, b, f"{a} x y", f"{b} x y"], 3)
    assert len(set(sets.values.tolist())) == 4
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    docs = docs_of(spark, [(1, a), (2, b), (3, a)])
    decoded = {r.doc_id: r.decoded_sha256 for r in bpe.encode_documents(docs, ranks, P.PATTERN).collect()}
    assert decoded == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in ((1, a), (2, b), (3, a))}
    crc = {r.doc_id: r.ids_crc32 for r in packing.pack(docs, JSON).collect() if r.piece == 0}
    assert crc[1] == crc[3] != crc[2]


# ---- hard negatives ----


def plain_negatives(rows, k=5, positives=5, every=100):
    ok = [(i, lab, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and v and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {(i, lab, tuple(v)) for i, lab, v in ok if i % every == 0}
    out = []
    for i, lab, v in anchors:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in ok if j != i and len(w) == len(v)]
        near = sorted((s, j) for s, j, other in scored if other == lab)[:positives]
        for s, j in near:
            found = sorted((t, n) for t, n, other in scored if other != lab and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(found)]
    return sorted(out)


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, label int, embedding array<float>, score string, slot string").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_the_plain_version(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "FILE_ROWS", 40)
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [rng.choice([0.0, 0.125, 0.25, 0.5, -0.25]) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, 1, [0.5, 0.25, 0.125, 0.0]) for i in range(150)]  # one vector held by a quarter of the rows
    rows += [(None, 1, [1.0] * 4), (2000, None, [1.0] * 4), (2100, 1, None), (2200, 1, []), (2300, 1, [1.0, None, 0.0, 0.0]), (2400, 1, [float("nan")] * 4), (2500, 2, [0.5, 0.5]), (2501, 1, [0.5, 0.25]), (2502, 2, [0.5, 0.5])]
    rows += [rows[100], rows[100], (100, 2, [0.25] * 4), (2600, 0, [-1.0] * 4), (2601, 0, [1.0] * 4)]
    got = sorted(map(tuple, hard_negatives.mine(vector_table(spark, rows)).collect()))
    assert got == plain_negatives(rows)
    assert len(got) > 50


def test_hard_negatives_of_no_rows_and_of_huge_ones(spark):
    assert hard_negatives.mine(vector_table(spark, [])).collect() == []
    rows = [(100, 1, [3e38, 0.0]), (1, 1, [3e38, 1.0]), (2, 2, [2.9e38, 0.0])]
    (row,) = hard_negatives.mine(vector_table(spark, rows)).collect()
    assert (row.positive_score, row.negative_score, row.negative_id) == (2**63 - 1, 2**63 - 1, 2)


def test_slots_are_cut_by_the_limits():
    best = hard_negatives.Best(1, 2, 2)
    best.add(np.zeros(5, np.int64), np.array([0, 0, 0, 1, 1]), np.array([9, 9, 8, 3, 4]), np.array([7, 5, 1, 1, 2]))
    best.add(np.zeros(1, np.int64), np.array([0]), np.array([9]), np.array([6]))
    assert list(zip(best.slot.tolist(), best.score.tolist(), best.id.tolist(), strict=True)) == [(0, 9, 5), (0, 9, 6), (1, 4, 2), (1, 3, 1)]


# ---- shortest pack first ----


@pytest.mark.parametrize("seed", range(40))
def test_patterns_equal_placing_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 16, 32])
    counts = Counter(rng.randint(1, capacity) if seed % 2 else min(capacity, 1 + int(rng.expovariate(0.3))) for _ in range(rng.randint(1, 200)))
    packs = []
    for length in sorted(counts.elements(), reverse=True):
        shortest = min(packs, key=sum, default=None)
        if shortest is not None and sum(shortest) + length <= capacity:
            shortest.append(length)
        else:
            packs.append([length])
    found = shortest_first.shortest_pack_first(counts, capacity)
    pieces = Counter()
    for pattern, times in found.items():
        for length, k in pattern:
            pieces[length] += k * times
    assert pieces == counts
    assert sorted(map(sum, packs)) == sorted(s for p, n in found.items() for s in [shortest_first.size_of(p)] * n)


def test_patterns_follow_counts_not_pieces():
    counts = {length: 1_000_000 + length for length in range(1, 1025)}
    assert len(shortest_first.shortest_pack_first(counts, 1024)) < 8 * 1024


def packed_rows(spark, rows, capacity):
    return shortest_first.pack(docs_of(spark, rows), JSON, capacity=capacity).collect()


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_holds_every_id_once_without_padding(spark, capacity):
    from tokenizers import Tokenizer

    a, b = thue_morse(1024)
    rng = random.Random(3)
    rows = [(d, t) for d, t in awkward() if d not in (6, 7)] + [(20, "x " * 3000), (21, "one <|endoftext|> two"), (22, a), (23, b)]
    rows += [(100 + i, "w " * rng.randint(0, 30)) for i in range(60)]
    got = packed_rows(spark, rows, capacity)
    encode = Tokenizer.from_file(JSON).encode
    want = Counter()
    for d, t in rows:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    single = [d for d, n in Counter(d for d, _ in rows).items() if n == 1]
    encoded = {d: np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in rows}
    for d in single:
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(encoded[d])
            assert r.ids_crc32 == zlib.crc32(encoded[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(encoded[d])
    assert sum(r.length for r in got) == sum(n * k for (_, n, _), k in want.items())
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0
    assert packed_rows(spark, [], capacity) == []


# ---- alignment ----


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    found, held = [], Counter()
    for d, t in rows:
        raw = (" " + (t or "")).encode()
        a, b = a_model.encode(" " + (t or ""), add_special_tokens=False).ids, b_model.encode(t or "")
        a_bytes = [bytes(back[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        links, groups, i, j, gi, gj = Counter(), [], 0, 0, 0, 0
        if t and b"".join(a_bytes) == raw == b"".join(b_bytes):
            ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
            while i < len(a):
                links[a[i], b[j]] += 1
                if ends_a[i] == ends_b[j]:
                    groups.append(",".join(map(str, a[gi : i + 1])) + "|" + ",".join(map(str, b[gj : j + 1])))
                    i, j = i + 1, j + 1
                    gi, gj = i, j
                elif ends_a[i] < ends_b[j]:
                    i += 1
                else:
                    j += 1
        held.update(links.keys())
        found.append((d, i, j, groups, links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return sorted(
        (str(d), i, j, len(g), sum(k.values()), sum(m for p, m in k.items() if held[p] == top[p[0]]), sum(m * held[p] for p, m in k.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, i, j, g, k in found
    )


def aligned(spark, rows, **more):
    return sorted((str(r[0]), *r[1:]) for r in alignment.align(docs_of(spark, rows), JSON, PIECES, **more).collect())


def test_alignment_equals_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(alignment, "RUN_RECORDS", 60)
    a, b = thue_morse(1024)
    rows = awkward() + [
        (20, " two  spaces\n\n  and lines \r\n\t x "),
        (21, "a mark ▁ that the pieces show as a space"),
        (22, "<|endoftext|> and <s> and <0x41> are plain text"),
        (23, "日本語のテキスト と　全角  nbsp  em é é 👩‍👩‍👧"),
        (24, a),
        (25, b),
        (26, "\x00nul\x01 don't we'll they've"),
        (27, "x" * 3000),
        (28, " "),
        (29, "a" + " " * 50 + "b"),
    ]
    rng = random.Random(5)
    rows += [(100 + i, " ".join(rng.choice(["the", "of,", "uncharacteristically", "Zürich", "x1y2", "10.5%", "don't\n"]) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    assert aligned(spark, rows, fan_in=3) == plain_alignment(rows)


def test_alignment_of_an_empty_table(spark):
    assert aligned(spark, []) == []


def test_heap_merge_sums_equal_pairs():
    frames = [alignment.frame_of(np.array(p, np.int64), np.array(n, np.int64)) for p, n in (([1, 5, 9], [1, 2, 3]), ([5], [4]), ([], []), ([1, 9], [1, 1]))]
    pair, n = alignment.heap_merged(frames)
    assert (pair.tolist(), n.tolist()) == ([1, 5, 9], [2, 6, 4])
