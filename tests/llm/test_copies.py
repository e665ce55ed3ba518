"""Exact copies, near copies and repeated byte strings against plain versions."""

import hashlib
import random
from collections import Counter

import pytest

from placescore.llm import exact_dedup, jaccard, substrings
from tests.llm.helpers import LOWER, awkward, components, docs_of


def mixed_rows(n, seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "ß", "A", "B"]
    base = [[random.choice(vocabulary) for _ in range(random.choice([1, 2, 3, 5, 20, 60, 120]))] for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        rows.append((i, random.choice([" ", "\n", "\t "]).join(w)))
    return rows


def test_exact_groups(spark):
    rows = mixed_rows(300, 1) + [(1000 + i, t.upper()) for i, t in mixed_rows(100, 1)] + awkward()
    norm = [(t or "").translate(LOWER) for _, t in rows]
    top = {}
    for (d, _), t in zip(rows, norm, strict=True):
        top[t] = max((x for x in (top.get(t), d) if x is not None), default=None)
    size = Counter(norm)
    want = sorted(str((d, top[t], size[t], d == top[t], hashlib.sha256(t.encode()).hexdigest())) for (d, _), t in zip(rows, norm, strict=True))
    got = exact_dedup.exact_groups(docs_of(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_directory_doubles_overfull_buckets():
    rows = exact_dedup.directory({0: 50, 1: 50, 9: 3, 15: 90}, capacity=60, max_bits=4)
    bucket = {prefix: (b, depth) for prefix, b, depth in rows}
    assert len(bucket) == 16 and bucket[0][1] == 4 and bucket[0] != bucket[1] and bucket[15][0] != bucket[9][0]
    assert bucket[8] == bucket[9] == bucket[11]


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("bigint") + F.lit(0))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda *c: F.lit("same"))
    got = exact_dedup.exact_groups(docs_of(spark, [(1, "ab"), (2, "AB"), (3, "cd"), (4, "xyz")])).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_similar(spark, k, percent, monkeypatch):
    rows = mixed_rows(400, 3) + awkward()
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in jaccard.similar(docs_of(spark, rows), k, percent).collect())
    assert got == components(rows, k, percent)


def test_one_large_group_of_near_copies(spark):
    random.seed(4)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(600):
        w = list(base)
        w[random.randrange(200)] = f"x{i}"
        w[random.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(w)))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in jaccard.similar(docs_of(spark, rows), 3, 90).collect())
    assert got == components(rows, 3, 90)


def plain_repeats(rows, width):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            if raw[s : s + width] in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(raw[s : s + width])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[d] = (len(raw), sum(gone), sum(1 for j in range(len(raw)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block", [20, 2048])
def test_repeated_strings(spark, block, monkeypatch):
    random.seed(5)
    monkeypatch.setattr(substrings, "BLOCK", block)
    text = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    passages = [text(random.choice([90, 99, 100, 101, 130, 180, 300])) for _ in range(20)]
    rows = []
    for i in range(250):
        parts = [random.choice(passages)[random.choice([0, 0, 7, 40]) :] if random.random() < 0.7 else text(random.randint(0, 150)) for _ in range(random.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "a" * 3000), (1003, "ab" * 800), (1004, text(5000) * 3), (None, rows[3][1] + "xyz")]
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == plain_repeats(rows, 100)


def test_repeated_rows_are_one_document(spark):
    t = hashlib.sha512(b"a").hexdigest() + hashlib.sha256(b"b").hexdigest()[:32]
    got = substrings.remove_repeats(docs_of(spark, [(1, t), (1, t), (2, t + "q"), (3, "short")])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == [(1, 160, 0), (1, 160, 0), (2, 161, 160), (3, 5, 0)]


def test_other_texts_under_one_id(spark):
    t = hashlib.sha512(b"a").hexdigest() + hashlib.sha256(b"b").hexdigest()[:32]
    got = substrings.remove_repeats(docs_of(spark, [(1, t), (1, t + "z"), (None, t)])).collect()
    assert sorted(r.n_removed for r in got) in ([0, 160, 160], [0, 160, 161]) and len(got) == 3


def test_column_wise_order():
    random.seed(6)
    strings = [bytes(random.choice(b"ab\xff\x00") for _ in range(random.randint(1, 9))) for _ in range(60)]
    owner, start, _ = substrings.collection_order(strings)
    suffixes = [strings[i][j:] for i, j in zip(owner, start, strict=True)]
    assert suffixes == sorted(suffixes) and len(suffixes) == sum(map(len, strings))
