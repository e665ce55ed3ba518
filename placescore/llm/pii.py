"""Personal data by boosted trees over overlapping candidates. DataFrame operations only.

Strict patterns give the base spans; wide patterns propose further ones (spelled-out addresses, national numbers, longer
internet addresses, cards with other separators). A strict match is labelled by its checksum, range or digit count, and
these are no features of its kind: trees see only format and context. All labelled candidates of the corpus are counted per
combination of binary features, so training sees a table whose size the number of features bounds. A stated prior, a
short list of labelled examples, stands beside the corpus, which weighs n / (n + PRIOR_ROWS), so every kind has trees and
a threshold at every size. Boosted trees of depth two are fitted per kind; a threshold, set on prior and held-out documents
where scores cease to be right often enough, selects what is added to the base.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescore.llm.common import query, table, written

KINDS = ["email", "ip", "card", "phone"]
# What the base patterns of the contract match, written so that no input makes them backtrack far.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:[(\[{]\s?(?:at|AT)\s?[)\]}]|\s(?:at|AT)\s)\s?[A-Za-z0-9-]{1,63}+\s?(?:[(\[{]\s?(?:dot|DOT)\s?[)\]}]|\s(?:dot|DOT)\s)\s?[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}[\x20._/-]{1,3}[0-9]{4}[\x20._/-]{1,3}[0-9]{4}[\x20._/-]{1,3}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.,-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9A-Za-z]|[.,-][0-9])",
}
WORDS_BEFORE = {
    "email": r"(?i)(mail|contact|write|reach)[^0-9A-Za-z]{0,3}(?:me|us|to|at|is)?[^0-9A-Za-z]{0,3}$",
    "ip": r"(?i)(\bip|host|server|address|addr|from)[^0-9A-Za-z]{0,3}$",
    "card": r"(?i)(card|visa|credit|debit|payment|pan|number|no)[^0-9A-Za-z]{0,3}$",
    "phone": r"(?i)(tel|phone|call|fax|mobile|cell|sms|number|no)[^0-9A-Za-z]{0,3}$",
}
BYTE = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Labelled corpus candidates that weigh as much as the prior.
PRIOR_ROWS = 200
FEATURES = ["bracket", "one_separator", "dotted", "word_before", "glued_before", "glued_after", "same_digits", "known_ending", "double_colon", "hex_letter", "zero_first"]
#: What a kind is known to look like before any corpus is seen: (features, right, wrong), in parts of one.
PRIOR = {
    "email": [
        (["bracket", "word_before", "known_ending"], 6, 0),
        (["bracket", "known_ending"], 8, 0),
        (["bracket"], 4, 1),
        (["word_before", "known_ending"], 4, 0),
        (["known_ending"], 2, 2),
        (["word_before"], 1, 3),
        ([], 1, 9),
        (["glued_before"], 0, 2),
        (["glued_after"], 0, 2),
    ],
    "ip": [
        (["double_colon", "hex_letter", "one_separator"], 6, 0),
        (["double_colon", "hex_letter", "one_separator", "word_before"], 6, 0),
        (["hex_letter", "one_separator", "word_before"], 6, 0),
        (["hex_letter", "one_separator"], 4, 0),
        (["double_colon", "one_separator", "word_before"], 4, 0),
        (["double_colon", "one_separator"], 2, 2),
        (["one_separator", "word_before"], 1, 2),
        (["one_separator"], 0, 8),
        (["one_separator", "zero_first"], 0, 4),
        (["one_separator", "same_digits"], 0, 2),
    ],
    "card": [
        (["dotted", "one_separator", "word_before"], 8, 0),
        (["one_separator", "word_before"], 8, 0),
        (["word_before"], 4, 0),
        (["dotted", "word_before"], 3, 0),
        (["dotted", "one_separator"], 4, 2),
        (["one_separator"], 4, 2),
        ([], 1, 3),
        (["dotted"], 1, 3),
        (["same_digits", "one_separator"], 0, 3),
        (["glued_before", "one_separator"], 0, 3),
        (["glued_after", "one_separator"], 0, 3),
    ],
    "phone": [
        (["bracket", "word_before"], 6, 0),
        (["word_before", "one_separator"], 8, 0),
        (["word_before", "dotted", "one_separator"], 6, 0),
        (["word_before", "zero_first", "one_separator"], 6, 0),
        (["bracket"], 4, 1),
        (["zero_first", "one_separator"], 3, 1),
        (["one_separator"], 1, 4),
        (["dotted", "one_separator"], 0, 5),
        (["dotted"], 0, 4),
        (["same_digits", "one_separator"], 0, 2),
    ],
}


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Checksum of 13 to 19 digits."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return luhn(digits_of(text))
    return F.length(digits_of(text)).between(9, 15)


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scan(values: Column, op) -> Column:
    """Running ``op`` over an array by doubling steps: each step combines every element with the one 1, 2, 4, … places before."""

    def step(acc: Column, j: Column) -> Column:
        far = F.pow(F.lit(2), j).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= far, op(x, F.get(acc, i - far))).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int")), values, step)


SPANS = "array<struct<kind:int,base:boolean,text:string,start:int,end:int,before:string,after:string>>"


def matches(text: Column, kind: str, base: bool, worth_it: Column) -> Column:
    """Array of (kind, base, text, start, end, before, after) of the leftmost non-overlapping matches, in code points.

    A match starts where the pieces and matches before it end; its surroundings are the pieces beside it.
    """
    pattern = (BASE if base else WIDE)[kind]
    none = F.array().cast(SPANS)

    def placed(hits: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda m, g: F.length(m) + F.length(g))

            def shown(ends: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    return F.struct(
                        F.lit(KINDS.index(kind)).alias("kind"),
                        F.lit(base).alias("base"),
                        m.alias("text"),
                        (F.get(ends, i) - F.length(m)).alias("start"),
                        F.get(ends, i).alias("end"),
                        F.substring(F.get(gaps, i), -24, 24).alias("before"),
                        F.substring(F.get(gaps, i + 1), 1, 2).alias("after"),
                    )

                return F.transform(hits, one)

            return let(scan(steps, lambda x, y: x + y), shown)

        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), with_gaps)).otherwise(none)

    return F.when(worth_it, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def of_kind(spans: str, kind: int) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def labelled(x: Column) -> Column:
    """Whether a strict match passes the check of its kind."""
    of = lambda kind: x["kind"] == KINDS.index(kind)
    return F.when(of("ip"), valid("ip", x["text"])).when(of("card"), valid("card", x["text"])).when(of("phone"), valid("phone", x["text"])).otherwise(F.lit(True))


def proposable(x: Column) -> Column:
    """Whether a wide match can be what it looks like: what its kind must satisfy, kept out of the features."""
    of = lambda kind: x["kind"] == KINDS.index(kind)
    return F.when(of("card"), luhn(digits_of(x["text"]))).when(of("phone"), F.length(digits_of(x["text"])).between(9, 15)).otherwise(F.lit(True))


def feature_bits(x: Column) -> Column:
    """Format and context features of a candidate as bits of an integer."""
    m, before, after = x["text"], x["before"], x["after"]
    word = F.lit(False)
    for i, kind in enumerate(KINDS):
        word = F.when(x["kind"] == i, before.rlike(WORDS_BEFORE[kind])).otherwise(word)
    flags = {
        "bracket": m.rlike(r"[(\[{]"),
        "one_separator": F.size(F.array_distinct(F.split(F.regexp_replace(m, "[^ ._/:-]", ""), ""))) <= 1,
        "dotted": m.rlike("[0-9][._/]+[0-9]"),
        "word_before": word,
        "glued_before": before.rlike(r"[\p{L}\p{N}]$"),
        "glued_after": after.rlike(r"^[\p{L}\p{N}]"),
        "same_digits": m.rlike(r"([0-9])\1{3}"),
        "known_ending": m.rlike(r"(?i)(?:com|org|net|edu|gov|info|io|[^a-z](?:[a-z]{2}|example))$"),
        "double_colon": m.contains("::"),
        "hex_letter": m.rlike("(?i)[0-9:][a-f]|[a-f][0-9:]"),
        "zero_first": m.rlike(r"^\(?0"),
    }
    bits = F.lit(0)
    for name, flag in flags.items():
        bits = bits + F.when(flag, 1 << FEATURES.index(name)).otherwise(0)
    return bits


def uncovered(wide: Column, confirmed: Column) -> Column:
    """The wide spans that overlap no confirmed strict one: a sweep over both in the order of their starts."""

    def sweep(both: Column) -> Column:
        # of the confirmed spans that start no later: the farthest end; of those that start later: the nearest start
        farthest = scan(F.transform(both, lambda y: F.when(y["sure"], y["end"]).otherwise(F.lit(-1))), lambda a, b: F.greatest(a, b))
        nearest = F.reverse(scan(F.reverse(F.transform(both, lambda y: F.when(y["sure"], y["start"]).otherwise(F.lit(2**31 - 1)))), lambda a, b: F.least(a, b)))
        free = F.zip_with(F.zip_with(both, farthest, lambda y, e: F.struct(y.alias("y"), e.alias("e"))), nearest, lambda z, s: F.when(~z["y"]["sure"] & (z["e"] <= z["y"]["start"]) & (s >= z["y"]["end"]), z["y"]["nth"]))
        return F.transform(F.filter(free, lambda i: i.isNotNull()), lambda i: F.get(wide, i))

    sure = F.transform(confirmed, lambda b: F.struct(b["start"].alias("start"), F.lit(True).alias("sure"), b["end"].alias("end"), F.lit(-1).alias("nth")))
    open_ = F.transform(wide, lambda x, i: F.struct(x["start"].alias("start"), F.lit(False).alias("sure"), x["end"].alias("end"), i.alias("nth")))
    return F.when(F.size(wide) == 0, wide).when(F.size(confirmed) == 0, wide).otherwise(let(F.array_sort(F.concat(sure, open_)), sweep))


def with_candidates(df: DataFrame, text: str = "_text") -> DataFrame:
    """Add ``_cand``: array of (kind, start, end, base, label, bits) over all kinds.

    A strict match is labelled by its check. A wide match that its kind cannot be, or that lies over a confirmed strict one, is
    dropped; the others have no label.
    """
    t = F.col(text)
    has_digit = t.rlike("[0-9]")
    may = {
        (True, "email"): t.contains("@"),
        (True, "ip"): has_digit,
        (True, "card"): has_digit,
        (True, "phone"): t.contains("+"),
        (False, "email"): t.contains("dot") | t.contains("DOT"),
        (False, "ip"): has_digit & t.contains(":"),
        (False, "card"): has_digit,
        (False, "phone"): has_digit,
    }
    found = {tag: F.concat(*[matches(t, kind, base, worth) for (base, kind), worth in may.items() if base == tag]) for tag in (True, False)}

    def described(x: Column, label: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), label.alias("label"), feature_bits(x).alias("bits"))

    def candidates(base: Column) -> Column:
        wide = let(F.filter(found[False], proposable), lambda w: uncovered(w, F.filter(base, lambda b: b["label"])))
        return F.concat(base, F.transform(wide, lambda x: described(x, F.lit(None).cast("boolean"))))

    return df.withColumn("_cand", let(F.transform(found[True], lambda x: described(x, labelled(x))), candidates))


# ---- boosting on counted feature combinations ----------------------------------------------------


@dataclass
class Model:
    """For each kind a sum of trees and a threshold; a tree asks two features and has a value for each of the four answers."""

    start: dict[int, float] = field(default_factory=dict)
    trees: dict[int, list[tuple[int, int, list[float]]]] = field(default_factory=dict)
    threshold: dict[int, float] = field(default_factory=dict)

    def score(self, kind: int, bits: np.ndarray) -> np.ndarray:
        out = np.full(len(bits), self.start[kind])
        for a, b, values in self.trees[kind]:
            out += np.array(values)[2 * ((bits >> a) & 1) + ((bits >> b) & 1)]
        return out

    def chosen(self, x: Column) -> Column:
        """Whether a candidate's score reaches the threshold of its kind."""
        out = F.lit(False)
        for kind, trees in self.trees.items():
            score = F.lit(self.start[kind])
            for a, b, values in trees:
                answer = F.shiftright(x["bits"], a).bitwiseAND(F.lit(1)) * 2 + F.shiftright(x["bits"], b).bitwiseAND(F.lit(1))
                score = score + F.get(F.array(*[F.lit(float(v)) for v in values]), answer)
            out = F.when(x["kind"] == kind, score >= self.threshold[kind]).otherwise(out)
        return out


def prior_of(kind: str) -> dict[tuple[int, bool], float]:
    """(bits, label) -> weight of the stated examples; they sum to one."""
    total = sum(right + wrong for _, right, wrong in PRIOR[kind])
    out: dict[tuple[int, bool], float] = {}
    for names, right, wrong in PRIOR[kind]:
        bits = sum(1 << FEATURES.index(n) for n in names)
        for label, n in ((True, right), (False, wrong)):
            out[bits, label] = out.get((bits, label), 0) + n / total
    return out


def boost(rows: list[tuple[int, int, bool, bool, int]], trees: int = 16, rate: float = 0.4, ridge: float = 0.01, precision: float = 0.75) -> Model:
    """Fit to (kind, bits, label, held out, count) rows and the prior; thresholds per kind from the held-out ones and the prior.

    The corpus weighs n / (n + PRIOR_ROWS) beside the prior's one, smoothly in n, so no size has rules of its own.
    """
    model = Model()
    for kind, name in enumerate(KINDS):
        prior = prior_of(name)
        asked = [i for i, feature in enumerate(FEATURES) if any(feature in names for names, _, _ in PRIOR[name])]  # what matters to the kind
        seen = np.array(sorted({b for b, _ in prior} | {r[1] for r in rows if r[0] == kind}), np.int64)
        place = {int(b): i for i, b in enumerate(seen)}
        stated, counted = np.zeros((2, len(seen))), np.zeros((2, 2, len(seen)))  # label; held out, label
        for (bits, label), weight in prior.items():
            stated[int(label), place[bits]] += weight
        for k, bits, label, held, count in rows:
            if k == kind:
                counted[int(held), int(label), place[bits]] += count
        # learning and held-out weights: the prior's sum to one, the corpus's to less, however many rows it has
        learn, held_out = (stated + part / (part.sum() + PRIOR_ROWS) for part in counted)
        start = math.log((learn[1].sum() + ridge) / (learn[0].sum() + ridge))
        f = np.full(len(seen), start)
        total = learn.sum(axis=0)
        answers = {(a, b): 2 * ((seen >> a) & 1) + ((seen >> b) & 1) for a, b in combinations(asked, 2)}
        grown = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            gradient, curvature = learn[1] - total * p, total * p * (1 - p)
            best = None
            for pair, leaf in answers.items():
                g, h = np.bincount(leaf, gradient, 4), np.bincount(leaf, curvature, 4)
                gain = float((g * g / (h + ridge)).sum())
                if best is None or gain > best[0] + 1e-12:
                    best = gain, pair, rate * g / (h + ridge)
            (a, b), values = best[1], best[2]
            grown.append((a, b, [float(v) for v in values]))
            f += values[answers[a, b]]
        # from the highest score down, as long as what a score stands for is right often enough; rare ones lean on the score
        scores = np.unique(f)[::-1]
        right, wrong = (np.array([part[f == x].sum() for x in scores]) for part in (held_out[1], held_out[0]))
        own = (right + ridge / (1 + np.exp(-scores))) / (right + wrong + ridge)
        low = np.flatnonzero(own < precision)
        good = scores[: low[0]] if len(low) else scores
        model.start[kind], model.trees[kind] = start, grown
        model.threshold[kind] = float(good[-1]) - 1e-9 if len(good) else float("inf")
    return model


def train(df: DataFrame) -> Model:
    """``df`` has ``_cand`` and ``_id``; at most kinds * 2**features * 4 counted rows reach the driver."""
    held = F.pmod(F.xxhash64("_id"), F.lit(5)) == 0
    counted = df.select(held.alias("held"), F.explode(F.filter("_cand", lambda x: x["label"].isNotNull())).alias("c"))
    counted = counted.groupBy("c.kind", "c.bits", "c.label", "held").agg(F.count("*").alias("n"))
    return boost([(r["kind"], r["bits"], r["label"], r["held"], r["n"]) for r in counted.collect()])


def with_spans(df: DataFrame, model: Model) -> DataFrame:
    """Replace ``_cand`` by ``_base`` and ``_all``: arrays of (kind, start, end), sorted."""
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    df = df.withColumn("_base", F.array_sort(F.transform(F.filter("_cand", lambda x: x["base"] & x["label"]), place)))
    chosen = F.filter("_cand", lambda x: ~x["base"] & model.chosen(x))
    return df.withColumn("_all", F.array_sort(F.concat("_base", F.transform(chosen, place)))).drop("_cand")


def shown(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, base matches per kind, digest of the base spans, and all spans.

    Null text is empty. Null ids and repeated rows are searched like any other, very long texts whole. Candidates are
    written once; without labelled ones the prior alone decides. An empty table gives an empty result. Other columns are not read.
    """
    rows = with_candidates(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))).drop("_text")
    rows = written(rows, "pii-candidates")
    found = with_spans(rows, train(rows))
    counts = [F.size(of_kind("_base", i)).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("_id").alias(id_col), *counts, F.sha2(shown("_base"), 256).alias("base_sha256"), shown("_all").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    All other columns and their order stay; a text without spans (null included) stays as it is.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), text.alias("_text"))
    rows = written(with_candidates(rows).drop("_text"), "pii-candidates").withColumn("_text", F.coalesce(F.col("_doc")[text_col].cast("string"), F.lit("")))
    found = with_spans(rows, train(rows))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(spans: Column) -> Column:
        # spans by start; one that starts before the farthest end so far belongs to the run before it
        def runs(upto: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(upto, i - 1)).otherwise(F.lit(0))
            part = lambda x, i: F.when(x["start"] >= before(i), F.concat(F.substring("_text", before(i) + 1, x["start"] - before(i)), F.get(names, x["kind"]))).otherwise(F.lit(""))
            tail = F.substring(F.col("_text"), F.get(upto, F.size(upto) - 1) + 1, F.length("_text"))
            return F.concat(F.array_join(F.transform(spans, part), ""), tail)

        return let(scan(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), runs)

    cleaned = let(F.array_sort(F.transform("_all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))), cut)
    old = F.col("_doc")
    return found.select(*[(F.when(F.size("_all") > 0, cleaned).otherwise(old[c]) if c == text_col else old[c]).alias(c) for c in docs.columns])


@query("op1_pii")
def op1(spark, sf):
    return find(table(spark, sf, "documents"))
