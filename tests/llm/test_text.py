"""Tokens, packing, personal data and language against plain versions, round trips and held-out rows."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placescore.llm import bpe, language, packing, pii, words
from tests.llm.helpers import awkward, docs_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed):
    random.seed(seed)
    parts = "ab'stremvld 1٣ \n\t  .,-éß你'''   😀"
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(n)]


def test_split_equals_the_pattern():
    texts, pattern = odd_texts(5000, 1), regex.compile(public_tokenizers.PATTERN)
    joined, starts, ends, h, first = words.split(texts)
    found = [joined[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert [found[first[i] : first[i + 1]] for i in range(len(texts))] == [pattern.findall(t) for t in texts]
    assert len(set(zip(found, h.tolist(), strict=True))) == len(set(found)) == len(set(h.tolist()))


def test_classes_equal_the_tokenizers(plain):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "".join(every[i : i + 200]) for i in range(0, len(every), 200)]
    encoder = words.Dictionary(lambda batch: [plain._encode_single_piece(w) for w in batch])
    for at, part in words.chunks(texts):
        joined, starts, ends, h, first = words.split(part)
        ids, end = encoder.gather(encoder.slots(joined, starts, ends, h))
        end = np.concatenate([[0], end])[first]
        assert all(ids[end[i] : end[i + 1]].tolist() == plain.encode_ordinary(t) for i, t in enumerate(part)), at


def test_fold_merges(spark, ranks, plain):
    found = sorted({w for t in odd_texts(200, 2) for w in regex.findall(public_tokenizers.PATTERN, t)} | {" internationalization", "straightforwardness", "aaaaaaaaaaaaaaaa", " "})
    df = spark.createDataFrame([(w,) for w in found], "word string")
    got = df.select("word", bpe.fold_merges(F.col("word"), bpe.rank_map(ranks)).alias("ids")).collect()
    assert {r.word: r.ids for r in got} == {w: plain._encode_single_piece(w) for w in found}


def expected_encoding(plain, text):
    ids = plain.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_documents(spark, ranks, plain):
    rows = [*enumerate(odd_texts(300, 3), 100), *awkward()]
    got = bpe.encode_documents(docs_of(spark, rows), ranks, public_tokenizers.PATTERN).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((d, *expected_encoding(plain, t))) for d, t in rows)


def test_encoder_forgets_and_goes_on(ranks, plain, monkeypatch):
    texts = odd_texts(800, 4)
    known = sorted({w for t in texts[:50] for w in regex.findall(public_tokenizers.PATTERN, t)})
    h = words.hashes(known)
    order = np.argsort(h)
    ids = [plain._encode_single_piece(known[i]) for i in order]
    encoder = bpe.TextEncoder(ranks, public_tokenizers.PATTERN, ([known[i] for i in order], np.array([len(x) for x in ids]), np.array([y for x in ids for y in x], np.uint32)))
    encoder.dictionary.limit = len(known) + 100
    monkeypatch.setattr(words, "BATCH_CHARS", 500)
    for t, (n, shown, decoded) in zip(texts, encoder.encode(texts), strict=True):
        assert (n, shown.decode(), decoded) == (len(x := plain.encode_ordinary(t)), " ".join(map(str, x)), t.encode())


def test_pack(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(5000, None), (5001, ""), (5002, "x <|endoftext|> y"), (5003, "word " * 1023), (5004, "word " * 1024)]
    got = packing.pack(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    held, by_doc = defaultdict(list), defaultdict(dict)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want = {i: (a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
        assert by_doc[d] == want, d
    assert len(held) <= 1.02 * sum(r.length for r in got) / 1024 + 1


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(1)
    for counts in (Counter(rng.integers(1, 1025, 20_000).tolist()), Counter(rng.integers(340, 520, 5_000).tolist()), Counter([1024] * 7), Counter([600, 424, 424, 600, 3])):
        chosen, got = packing.plan(dict(counts), 1024), Counter()
        for filling, times in chosen.items():
            assert sum(length * k for length, k in filling) <= 1024
            for length, k in filling:
                got[length] += k * times
        assert got == counts
        assert sum(chosen.values()) <= sum(packing.best_fit(dict(counts), 1024).values())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        worth = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(worth) % 10 == 0
    return True


def base_spans(text):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if passes(k, m.group())] for k, p in PATTERNS.items()]


def test_base_spans(spark):
    random.seed(2)
    parts = ["@", ".", "a", "b", "1", "4", "+", "-", " ", "(", ")", "%", "é", "😀", "9", "255", "@b.c", "4111 1111 1111 1111", "+1 (372) 555-77", "1.2.3.4", "\n"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(1500)]
    rows = [*enumerate([*texts, "1" * 20_000, "a" * 20_000 + "@b." + "c." * 9000 + "d", "1 " * 9000, "+1" + "(" * 9000], 100), *awkward()]
    want = sorted(str((d, *map(len, s), hashlib.sha256(",".join(sum(s, [])).encode()).hexdigest())) for d, t in rows for s in [base_spans(t)])
    got = pii.find(docs_of(spark, rows)).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == want


def test_trees_add_what_labels_support(spark):
    random.seed(3)

    def card(separator, good):
        while True:
            d = "".join(random.choice("0123456789") for _ in range(16))
            if passes("card", d) == good:
                return separator.join(d[i : i + 4] for i in range(0, 16, 4))

    rows = [(i, f"paid by card {card(' ', i % 3 > 0)} today") for i in range(600)]
    dotted = [(1000 + i, f"paid by card {card('.', True)} today") for i in range(10)] + [(2000 + i, f"serial {card('.', False)} of it") for i in range(10)]
    got = {r.doc_id: r.spans for r in pii.find(docs_of(spark, rows + dotted)).collect()}
    assert all(got[d] == f"card:{t.index('card') + 5}:{t.index('card') + 24}" for d, t in dotted if d < 2000)
    assert not any(got[d] for d, _ in dotted if d >= 2000)


def test_planted_wide_spans(spark):
    """Precision and recall on planted spans of formats that the strict patterns miss, with and without a corpus around them."""
    random.seed(8)
    name = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    four = lambda: "".join(random.choice("123456789") for _ in range(4))
    planted = [(f"write to {a} [at] {b} [dot] com now", f"email:9:{9 + len(a) + len(b) + 16}") for a, b in ((name(), name()) for _ in range(20))]
    planted += [(f"call (0{a}) {b}-{c} please", f"phone:5:{5 + len(f'(0{a}) {b}-{c}')}") for a, b, c in ((random.randint(20, 99), four(), four()) for _ in range(20))]
    planted += [(f"from 2001:db8::{a}:ff00:{b} only", f"ip:5:{5 + len(f'2001:db8::{a}:ff00:{b}')}") for a, b in ((four(), four()) for _ in range(20))]
    clean = [f"we met at noon dot then left {i}" for i in range(20)] + [f"took 12:30:45:{i} at most" for i in range(10, 30)] + [f"part {a}-{b}-{c} in stock" for a, b, c in ((four()[:3], four()[:3], four()) for _ in range(20))]
    for corpus in ([], [f"card 4111 1111 1111 111{i % 10} or 10.0.{i % 300}.1, a{i}@b.example" for i in range(2000)]):
        rows = [(i, t) for i, (t, _) in enumerate(planted)] + [(1000 + i, t) for i, t in enumerate(clean)] + [(10_000 + i, t) for i, t in enumerate(corpus)]
        got = {r.doc_id: r.spans for r in pii.find(docs_of(spark, rows)).collect()}
        assert sum(got[i] == want for i, (_, want) in enumerate(planted)) >= 0.95 * len(planted)
        assert sum(bool(got[1000 + i]) for i in range(len(clean))) <= 0.05 * len(clean)


def test_many_numbers_in_one_text(spark):
    text = " ".join(str(i * 7919 % 100_000) for i in range(30_000)) + " mail a@b.example"
    (row,) = pii.find(docs_of(spark, [(1, text)])).collect()
    (clean,) = pii.redact(docs_of(spark, [(1, text)])).collect()
    assert row.n_email == 1 and clean.text.endswith(" mail [EMAIL]")


def test_overlapping_spans_become_one(spark):
    rows = [(1, "x +4111 1111 1111 1111 y"), (2, "a@b.c+4915112345678 and 4111-1111-1111-1111")]
    got = {r.doc_id: r.text for r in pii.redact(docs_of(spark, rows)).collect()}
    assert got[1] in ("x [PHONE] y", "x +[CARD] y") and "4111" not in got[2] and "a@b" not in got[2]


def test_redact(spark):
    rows = [(1, "mail a.b@c.example now, or 10.0.0.1!"), (2, "nothing"), (3, None), (None, "call +1 (372) 555-7739 x"), (4, "4111 1111 1111 1111")]
    df = docs_of(spark, rows)
    got = pii.redact(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "mail [EMAIL] now, or [IP]!", 2: "nothing", 3: None, None: "call [PHONE] x", 4: "[CARD]"}
    assert {r["_text"] for r in got.collect()} == {"x"}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    got = language.identify(hidden, host_col=None).join(hidden.select("doc_id", "truth", "lang"), "doc_id").where("lang IS NULL")
    right = got.where("language = truth AND accepted").count()
    assert right >= 0.97 * got.count()


def test_language_evidence(spark):
    words_of = {"aa": "lor bim sut tam kel vor", "bb": "xoq zux wiq yuz qex jax"}
    random.seed(7)
    text = lambda lang, n: " ".join(random.choice(words_of[lang].split()) for _ in range(n))
    rows = [(i, text(lang, 40), lang, f"{lang}.site{i % 3}.{lang}") for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, None, "new.site1.aa"), (901, "", "bb", None), (902, "漢字" * 300, None, None), (903, text("bb", 40), "aa", None), (None, text("aa", 5), None, None), (904, None, None, "deep.aa.site0.aa")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].language == lang and got[i].accepted for i, lang in enumerate(["aa", "bb"] * 60))
    assert got[900].language == "aa" and got[901].language == "bb" and got[903].language == "bb" and got[None].language == "aa" and got[904].language == "aa"
    assert got[902].language == language.UNKNOWN and not got[902].accepted


def test_awkward_and_empty_tables(spark, ranks):
    for rows in (awkward(), []):
        df = docs_of(spark, rows)
        assert language.identify(df).count() == len(rows)
        assert pii.find(df).count() == len(rows) and pii.redact(df).count() == len(rows)
        assert bpe.encode_documents(df, ranks, public_tokenizers.PATTERN).count() == len(rows)
        pieces = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"))
        assert pieces.where("piece = 0").count() == len(rows)


@pytest.mark.parametrize("copies", [1, 40])
def test_thin_languages_are_kept(spark, copies):
    """A language of a few documents is told by its declaration and host, however large the rest of the corpus is."""
    random.seed(11)
    vocabulary = {"aa": "lor bim sut tam kel vor", "bb": "xoq zux wiq yuz qex jax", "cc": "ĉeŝ ŭnĝ ĵaĥ"}
    text = lambda lang, n: " ".join(random.choice(vocabulary[lang].split()) for _ in range(n))
    rows = [(i, text(lang, 60), lang, "src0") for i, lang in enumerate(["aa", "bb"] * 60 * copies)]
    rows += [(900_000, text("cc", 6), "cc", "src0"), (900_001, text("cc", 6), None, "src0"), (900_002, "漢字" * 300, None, "src0")]
    rows += [(910_000 + i, text("cc", 6), "cc", "site.cc") for i in range(12)] + [(920_000, text("cc", 6), None, "site.cc"), (920_001, text("aa", 40), None, "site.cc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(df).where("doc_id >= 900000").collect()}
    assert all(got[i].language == "cc" and got[i].accepted for i in [900_000, 920_000, *range(910_000, 910_012)])
    assert got[900_002].language == language.UNKNOWN and got[920_001].language == "aa"


def test_more_languages_than_a_model_of_two_hundred(spark):
    random.seed(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(230):
        own = ["".join(random.choice(letters) for _ in range(5)) for _ in range(6)]
        rows += [(10 * k + j, " ".join(random.choice(own) for _ in range(260)), f"l{k:03}" if j else None, None) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert all(got[d].language == f"l{d // 10:03}" and got[d].accepted for d, *_ in rows)


def test_shown_text_equals_the_pattern_and_stays_linear():
    import time

    pattern = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[a-z/!?][^>]*>", re.I | re.S)
    random.seed(14)
    parts = ["<", ">", "<!--", "-->", "<script", "<style>", "</script >", "</STYLE>", "</", "a", " ", "\n", "<p>", "<!", "/", "x", "<scripts", "--"]
    for _ in range(4000):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert language.shown_text(t) == pattern.sub(" ", t), t
    begin = time.perf_counter()
    for piece in ("<!--", "<script ", "<style>", "<a ", "<", "</"):
        language.shown_text(piece * 200_000)
    assert time.perf_counter() - begin < 20


def test_language_of_pages_uses_address_and_markup(spark):
    """Pages without text or declaration are told by host, parent domain and suffix; the registered query judges every page."""
    random.seed(13)
    words_of = {"aa": "lor bim sut tam kel vor", "bb": "xoq zux wiq yuz qex jax"}
    page = lambda lang, n: f"<html lang='{lang}-XY'><script>{'zux ' * 90}</script><p>" + " ".join(random.choice(words_of[lang].split()) for _ in range(n)) + "</p></html>"
    rows = [(i, f"https://www.{lang}{i % 3}.{lang}/x", page(lang, 60)) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(900, "http://deep.aa1.aa:80/", "<p></p>"), (901, "http://new.example.bb/", None), (902, "http://10.0.0.1/", page("bb", 40)), (903, None, "<HTML LANG=bb><p>&lt;</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    flat = {r.doc_id: r for r in language.of_pages(df).collect()}
    assert flat[0].lang == "aa" and "zux" not in flat[0].text and (flat[900].host, flat[900].suffix) == ("deep.aa1.aa", "aa") and flat[902].suffix is None and flat[903].text.strip() == "<"
    got = {r.doc_id: r for r in language.identify(language.of_pages(df), host_col="host", suffix_col="suffix").collect()}
    assert len(got) == len(rows) and all(got[i].language == lang for i, lang in enumerate(["aa", "bb"] * 60))
    assert got[900].language == "aa" and got[901].language == "bb" and got[902].language == "bb" and got[903].language == "bb"
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    judged = language.op4(spark, SF)
    assert sorted(r.doc_id for r in judged.collect()) == sorted(r.page_id for r in pages.collect())
    assert judged.where("accepted").count() >= 0.95 * pages.count()
