"""Problems 6 and 7: invariants, and optimality on small inputs."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import mixing, packing


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=60))
def test_plan(capacity, sizes):
    h = Counter(s for s in sizes if s <= capacity)
    load, count = Counter(), Counter()
    large = defaultdict(int)
    ranks = defaultdict(list)
    for s, first, c, n in packing.plan(dict(h), capacity):
        ranks[s] += range(first, first + n)
        for i in range(n):
            load[c + i] += s
            large[c + i] += s > capacity / 3
        count[s] += n
    assert count == h and max(load.values(), default=0) <= capacity
    assert max(large.values(), default=0) <= 2 and set(load) == set(range(len(load)))
    assert all(sorted(r) == list(range(h[s])) for s, r in ranks.items())
    if load:
        assert len(load) <= 1.7 * -(-sum(load.values()) // capacity) + 1


def test_packed(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([3, 30, 64, 65, 130, 200, 0])) for i in range(300)] + [(7, 12), (None, 5), (400, None)]
    df = spark.createDataFrame([(i, n, "x") for i, n in rows], "doc_id long, tokens int, bin string")
    got = packing.packed_all(df, [("a", 64), ("b", 100)]).collect()
    for name, capacity in (("a", 64), ("b", 100)):
        load, docs, pieces = Counter(), Counter(), defaultdict(list)
        for r in got:
            if r.container == name:
                load[r.bin] += r.tokens
                docs[r.id] += r.tokens
                pieces[r.id].append(r.tokens)
        assert max(load.values()) <= capacity
        want = Counter()
        for i, n in rows:
            want[i] += n or 0
        assert docs == want
        for i, n in rows:
            if i not in (7, None):
                assert len(pieces[i]) == max(1, -(-(n or 0) // capacity))
        assert sum(load.values()) / (len(load) * capacity) > 0.85


def test_nothing_to_pack(spark):
    assert packing.packed_all(spark.createDataFrame([], "doc_id long, tokens int"), [("a", 10)]).count() == 0
    with pytest.raises(ValueError):
        packing.packed_all(spark.createDataFrame([(1, 1)], "doc_id long, tokens int"), [("a", None)])


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "나무가 많다."), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in packing.token_counts(df, "text").collect()}
    assert got[1] > 3 and got[2] == got[3] == 0


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(25):
        patterns = {p: rng.randrange(1, 5) for p in rng.sample(range(1, 4), rng.randrange(1, 4))}
        repeats, quota = [rng.randrange(1, 3), rng.randrange(1, 3)], [rng.randrange(6), rng.randrange(6)]
        total = sum(quota) or 1
        got, flow = mixing.routed(patterns, [(q + 1e-9) / total for q in quota], repeats, total)
        best = None
        cells = [(p, s, r) for p in patterns for r in range(2) for s in range(2) if p >> s & 1 and r < repeats[s]]
        for amounts in itertools.product(*[range(patterns[c[0]] + 1) for c in cells]):
            use, into = Counter(), Counter()
            for (p, s, r), a in zip(cells, amounts):
                use[p, r] += a
                into[s] += a
            if all(v <= patterns[p] for (p, _), v in use.items()) and all(into[s] <= quota[s] for s in range(2)):
                key = (-sum(amounts), sum(a * r for (_, _, r), a in zip(cells, amounts)))
                best = key if best is None or key < best else best
        assert (-got, sum(a * r for (_, _, r), a in flow.items())) == best
        if len(cells) > 6:
            break


def rows():
    rng = random.Random(3)
    out = [(i, ["a", "b", "c", "other", None][i % 5], f"h{i}", rng.randrange(50, 150)) for i in range(1000)]
    out += [(2000 + i, "b", f"h{5 * i}", 0) for i in range(20)]  # a's texts, in b, too
    return [(d, s, h, n or next(x[3] for x in out if x[2] == h)) for d, s, h, n in out] + [(3000, "a", None, 10), (3001, "a", "h0", 0)]


def test_shares(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, source string, text_hash string, tokens int, uses int")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.2, 2), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    draw = mixing.drawn(df, targets)
    got = draw.collect()
    uses = Counter()
    text = {r[0]: r[2] for r in rows()}
    for r in got:
        assert r.uses <= {"a": 1, "b": 3, "c": 2}[r.source]
        uses[text[r.doc_id]] += r.uses
    assert max(uses.values()) <= 3
    share = {r.source: r.actual_share for r in mixing.share_report(draw, targets).collect()}
    assert share["none"] == 0
    for s, t in (("a", 0.2), ("b", 0.5), ("c", 0.2)):
        assert abs(share[s] - t / 0.9) < 0.01
    assert {tuple(r) for r in got} == {tuple(r) for r in mixing.drawn(df, targets).collect()}


def test_scarce_source_falls_short(spark):
    df = spark.createDataFrame(rows(), "doc_id long, source string, text_hash string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    draw = mixing.drawn(df, targets, total_tokens=60_000)
    share = {r.source: r for r in mixing.share_report(draw, targets).collect()}
    assert share["a"].actual_share < 0.45 and share["b"].most_uses == 2


def test_whole_documents_and_many_sources(spark):
    """More sources than bits in a number; each within one document of its quota."""
    rng = random.Random(6)
    docs = [(i, f"s{i % 80:02d}", f"h{i}", rng.randrange(20, 400)) for i in range(1600)]
    targets = spark.createDataFrame([(f"s{k:02d}", 1 / 80, 1 + k % 3) for k in range(80)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, source string, text_hash string, tokens int")
    report = mixing.share_report(mixing.drawn(df, targets), targets).collect()
    whole = sum(r.tokens for r in report)
    assert all(r.n_docs and abs(r.tokens - whole / 80) <= 200 for r in report) and len(report) == 80
    full = mixing.share_report(mixing.drawn(df, targets, total_tokens="all"), targets).collect()
    assert max(r.most_uses for r in full) > 1


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    empty = spark.createDataFrame([], "doc_id long, source string, text_hash string, tokens int")
    assert mixing.drawn(empty, targets).count() == 0 and mixing.drawn(empty, targets.limit(0)).count() == 0
