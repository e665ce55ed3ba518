"""Small tables with every awkward case, and plain versions of the operators."""

import re
from collections import defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
CLASH = ["_id", "_text", "_key", "_row", "_doc", "_h", "key", "h", "node", "token", "n", "fp1", "label", "host", "fit", "p", "bucket", "length", "rank", "kept", "span"]


def docs_of(spark, rows, parts=3):
    """(doc_id, text) rows with columns whose names operators use themselves."""
    full = [(i, t, "en", "src0", len(t or ""), *["x"] * len(CLASH)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(parts)


def awkward():
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog, and the dog sleeps on. " * 3),
        (2, "THE quick brown fox jumps over the lazy dog, and the dog sleeps on. " * 3),
        (2, "THE quick brown fox jumps over the lazy dog, and the dog sleeps on. " * 3),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (6, long),
        (7, long + " end"),
        (None, "a row without an id"),
        (None, None),
        (8, "one two"),
        (9, "One Two"),
        (10, "ß Ä é 你好 😀 mail a.b@c.example and 10.0.0.1"),
    ]


def shingle_set(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def components(rows, k, percent):
    """(id, shingles, component, links) per row, all pairs that share a shingle."""
    sets, parent, links, holders = [shingle_set(t, k) for _, t in rows], list(range(len(rows))), [0] * len(rows), defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links[i], links[j], parent[root(i)] = links[i] + 1, links[j] + 1, root(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[root(i)] = min(lowest.get(root(i), d), d)
    return sorted((str(d), len(sets[i]), str(lowest.get(root(i))), links[i]) for i, (d, _) in enumerate(rows))
