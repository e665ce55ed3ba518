"""op2: columns of several symbols."""

import random

import numpy as np

from placescore.llm import substrings


def test_columns_hold_what_sixteen_bits_tell_apart():
    """Equal suffixes stand in the order of their strings, whatever the columns' width; a round for every symbol took 2.7 times as long."""
    random.seed(7)
    few = [bytes(random.choice(b"ab\x00") for _ in range(random.randint(1, 40))) for _ in range(80)]
    many = [bytes(random.randrange(256) for _ in range(random.randint(90, 170))) for _ in range(1200)]
    widths = []
    plain = substrings.columns_of
    substrings.columns_of = lambda *x: widths.append(plain(*x)[0]) or plain(*x)
    try:
        for strings in (few, few + few, many, [b"x"], [b"", b"a" * 300, b"a" * 299]):
            owner, start, _ = substrings.collection_order(strings)
            got = list(zip(owner.tolist(), start.tolist(), strict=True))
            assert got == sorted(((i, j) for i, s in enumerate(strings) for j in range(len(s))), key=lambda x: (strings[x[0]][x[1] :], x[0]))
    finally:
        substrings.columns_of = plain
    assert widths[0] == 8 and widths[2] == 2 and len(np.unique(widths)) > 1


def test_language_reads_few_documents_at_once(monkeypatch):
    """Pipeline: a whole Arrow batch of texts, and two million letters with a dozen arrays each, took language_id over an executor's memory."""
    import pyarrow as pa

    from placescore.llm import common, language

    assert language.CHARS_AT_ONCE <= 250_000 and language.few_rows is common.few_rows
    texts = ["Ein Satz über Äpfel. " * n for n in (0, 1, 40, 3, 900)]
    whole = [n.tolist() for _, n in language.trigrams(texts)]
    monkeypatch.setattr(language, "CHARS_AT_ONCE", 50)
    assert [n.tolist() for _, n in language.trigrams(texts)] == whole
    assert [b.num_rows for b in common.few_rows(iter([pa.record_batch({"x": list(range(1001))})]))] == [1000, 1]
