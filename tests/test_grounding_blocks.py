"""claims and values meet as blocks, and no pair of them is written."""

import random

from placescore.plans import evals


def _plain(token, pool):
    v, p = float(token), [float(x) for x in pool]
    near = lambda o: abs(v - o) <= max(0.005, 0.0005 * max(abs(v), abs(o)))
    if token in pool:
        return "literal"
    if any(abs(v - x) <= 0.5 for x in p):
        return "rounded"
    return "derived" if any(near(a - b) or near(a + b) or b != 0 and near(a / b * 100) for a in p for b in p) else "unsupported"


def test_blocks_of_claims_and_values(spark, monkeypatch):
    """Blocks of a few numbers, spread over many meetings, label like the plain rule; a number past all doubles ends nothing."""
    monkeypatch.setattr(evals, "VALUES_PER_PART", 5)
    monkeypatch.setattr(evals, "CLAIMS_PER_PART", 4)
    monkeypatch.setattr(evals, "LOOKUPS", 10)
    rng = random.Random(4)
    number = lambda top: rng.choice([str(rng.randint(10, top)), f"{rng.uniform(0, top):.3f}", f"{rng.uniform(0, 0.05):.5f}", str(rng.randint(10**9, 10**12))])
    groups = [(k, [number(10**4) for _ in range(60)], [number(10**5) for _ in range(k * 7)]) for k in range(5)]
    rows = spark.createDataFrame([*groups, (9, ["7" * 400, "55"], ["20"]), (10, ["55.5"], ["8" * 400])], "k int, c array<string>, s array<string>")
    got = {(r.k, r.token): r.label for r in evals.classify_numbers(rows, "k", "c", "s").collect()}
    want = {(k, t): _plain(t, set(s)) for k, c, s in groups for t in c}
    want |= {(9, "7" * 400): "derived", (9, "55"): "unsupported", (10, "55.5"): "derived"}
    assert {k: (got.get(k), w) for k, w in want.items() if got.get(k) != w} == {} and len(got) == len(want)
    assert set(want.values()) >= {"rounded", "derived", "unsupported"}


def test_a_claim_that_few_values_derive_does_not_meet_the_rest(monkeypatch):
    """Before, each open claim and each value were a row per operation and bucket."""
    import numpy as np

    met = []
    plain = evals._some_between
    monkeypatch.setattr(evals, "_some_between", lambda b, low, *rest: met.append(len(low)) or plain(b, low, *rest))
    values = np.arange(10.0, 20_010.0)
    assert evals._is_derived(np.array([20_500.0, 1234.5, 9e9]), values, values).tolist() == [True, True, False]
    assert sum(met) < 3 * 20_000 + 3 * 3 * 4 * 20
