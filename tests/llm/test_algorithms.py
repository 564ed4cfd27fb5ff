import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessaria.llm import distinctive, leakage, mixing, percentiles


def test_percentiles_are_within_the_bound_and_merge(spark):
    rng = random.Random(2)
    data = [(rng.choice(["SP", "SP", "SP", "RJ", None]), w, x) for w in ("a", "b", "c") for _ in range(400) for x in [rng.choice([rng.lognormvariate(2, 1), -1.5, 7.0, float("nan"), None])]]
    df = spark.createDataFrame(data, "g string, week string, v double")
    ps, width = (0.01, 0.5, 0.95, 1.0), 0.01
    weekly = percentiles.cell_state(df, ["g", "week"], "v", width)
    for keys in (["g"], ["g", "week"], []):
        out = percentiles.percentiles(percentiles.merge(weekly, keys), keys, ps, width, fanout=3).collect()
        groups = {}
        for g, w, x in data:
            if x is not None and not math.isnan(x):
                groups.setdefault(tuple({"g": g, "week": w}[k] for k in keys), []).append(x)
        assert len(out) == len(groups) * len(ps)
        for r in out:
            xs = sorted(groups[tuple(r[k] for k in keys)])
            true = xs[max(1, math.ceil(r.p * len(xs))) - 1]
            assert r.n == len(xs) and r.low <= true + 1e-12 and true < r.high + 1e-12


def test_percentiles_of_coarse_states_and_rows_are_the_true_ones(spark):
    """The stated bound holds against the values themselves, for states joined over weeks and two files."""
    rng = random.Random(7)
    data = [(g, w, rng.lognormvariate(2, 1.2) - 3) for g in ("SP", "SP", "SP", None, "RJ") for w in "abc" for _ in range(300)] + [("RJ", "a", 5.0)] * 50
    width, step, ps = 0.001, 8192, (0.01, 0.5, 0.9, 1.0)
    files = [spark.createDataFrame(data[i::2], "g string, week string, v double").withColumn("cell", percentiles.cell_of(F.col("v"), width)) for i in (0, 1)]
    state = percentiles.coarse(files[0], ["g", "week"], step).unionByName(percentiles.coarse(files[1], ["g", "week"], step))
    assert state.count() < 600 < len(data) / 4
    rows = files[0].unionByName(files[1])
    for keys in (["g"], ["g", "week"]):
        out = percentiles.percentiles(percentiles.merge(state, keys), keys, ps, width, fanout=8, rows=rows, step=step).collect()
        for r in out:
            xs = sorted(v for g, w, v in data if all({"g": g, "week": w}[k] == r[k] for k in keys))
            true = xs[max(1, math.ceil(r.p * len(xs))) - 1]
            assert abs((r.low + r.high) / 2 - true) <= width / 2 + 1e-9 and r.n == len(xs)


def test_percentiles_without_values(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", float("inf"))], "g string, v double")
    s = percentiles.cell_state(df, ["g"], "v", 0.1)
    assert s.count() == 0 and percentiles.percentiles(s, ["g"], [0.5], 0.1).count() == 0


def test_term_scores_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["preço", "loja", "caixa", "verde", "abc", "ação!", "Casa", "produto", "ｌoja"]
    data = [(f"o{i}", " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 9)))) for i in range(200)]
    data += data[:20] + [("o1", "outro texto texto texto"), (None, "loja"), ("n", None), ("e", ""), ("z", "​")]
    df = spark.createDataFrame([(r, t, 1) for r, t in data], "id string, text string, tf int")
    tf = {}
    for r, t in set(data):
        if r and t:
            for w, n in Counter(distinctive.terms(t)).items():
                tf[r, w] = max(n, tf.get((r, w), 0))
    n = len({r for r, t in data if r and t})
    dfs, cfs = Counter(w for _, w in tf), Counter()
    for (_, w), k in tf.items():
        cfs[w] += k
    got = {(r.record, r.term): (r.tf, r.df, r.cf, r.score) for r in distinctive.scores(df, "id", "text").collect()}
    assert got.keys() == tf.keys()
    for (r, w), (k, d, c, s) in got.items():
        assert (k, d, c) == (tf[r, w], dfs[w], cfs[w])
        assert s == pytest.approx(k * (-math.log2(d / n) + math.log2(1 - math.exp(-c / n))))
    some = {(r.record, r.term) for r in distinctive.scores(df, "id", "text", min_tf=2, min_df=2, max_df=60).collect()}
    assert some == {(r, w) for (r, w), k in tf.items() if k >= 2 and 2 <= dfs[w] <= 60}
    assert distinctive.scores(df.limit(0), "id", "text").count() == 0


WORDS = st.lists(st.sampled_from("abcd"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_tiles_match_and_do_not_overlap(doc, item):
    least = 3
    seeds = [(d, i) for d in range(len(doc) - least + 1) for i in range(len(item) - least + 1) if doc[d : d + least] == item[i : i + least]]
    tiles = leakage.tile(doc, item, seeds, least)
    assert bool(tiles) == bool(seeds)
    seen_d, seen_i = set(), set()
    for d, i, n in tiles:
        assert n >= least and doc[d : d + n] == item[i : i + n]
        assert not seen_d & set(range(d, d + n)) and not seen_i & set(range(i, i + n))
        seen_d |= set(range(d, d + n))
        seen_i |= set(range(i, i + n))
    if seeds:  # the first tile is a longest common run
        best = max(n for d in range(len(doc)) for i in range(len(item)) for n in range(1, min(len(doc) - d, len(item) - i) + 1) if doc[d : d + n] == item[i : i + n])
        assert tiles[0][2] == best


def test_leaks(spark):
    rng = random.Random(1)
    make = lambda n: " ".join(rng.choice("aço mel sol rio paz fim cor dor voz luz mar pão".split()) + str(rng.randrange(99)) for _ in range(n))
    a, b = make(40), make(12)
    docs = [
        (1, a), (2, "x " + " ".join(a.split()[5:17]) + " y"), (3, " ".join(a.split()[5:16])), (4, "“" + b.upper().replace("AÇO", "aço").replace(" ", ",\n") + "”"), (5, None), (6, ""), (7, make(3000)),
        (8, " ".join(a.split()[20:40] + a.split()[:20])), (8, " ".join(a.split()[20:40] + a.split()[:20])), (None, a), (9, (a + " ") * 300),
    ]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(10, a), (11, b), (12, "too short"), (13, None), (10, a)], "item_id long, text string")
    want = {(1, 10), (2, 10), (4, 11), (8, 10), (9, 10)}
    for block in (leakage.BLOCK_WORDS, 1):
        rows = leakage.leaks(d, e, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
        assert {r.doc_id: r.n_tiles for r in rows}[8] == 2 and {r.doc_id: r.coverage for r in rows}[8] == 1.0
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0


SHARES = st.lists(st.tuples(st.floats(0, 1), st.integers(0, 9), st.integers(0, 1000)), min_size=1, max_size=8)


@settings(max_examples=300, deadline=None)
@given(SHARES, st.integers(0, 20_000))
def test_filling(sources, total):
    shares = [mixing.Share(f"s{i}", w, m, t) for i, (w, m, t) in enumerate(sources)]
    out = mixing.fill(shares, total)
    assert len(out) == len(shares)
    assert all(0 <= s.allotted <= s.most + 1e-6 for s in out)
    can = sum(s.most for s in shares if s.target > 0)
    assert sum(s.allotted for s in out) == pytest.approx(min(total, can), abs=1e-6 * max(1, total))
    open_ = [s for s in out if not s.clamped and s.target > 0]
    for s in open_:  # unclamped sources keep their proportions
        assert s.allotted * open_[0].target == pytest.approx(open_[0].allotted * s.target, rel=1e-6, abs=1e-6)


def test_draw(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["Big", "big ", "BIG", "mid", "tiny", "none", None]), "palavra " * rng.randrange(1, 60)) for i in range(600)] + [(900, "big", None), (901, "big", ""), (None, "big", "x"), (0, "Big", "a")]
    d = spark.createDataFrame([(i, s, t, 7) for i, s, t in docs], "doc_id long, source string, text string, n_tokens int")
    targets = spark.createDataFrame([(" big", 0.2, 1), ("mid", 0.3, 2), ("tiny", 0.4, 3), ("void", 0.1, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(d)
    assert sizes.count() == len({i for i, s, t in docs if i is not None and s and t})
    shares = mixing.plan(sizes, targets, total=12_000)
    drawn = mixing.draw(sizes, shares)
    rows = {r.source: r for r in mixing.report(drawn, shares).collect()}
    longest = sizes.agg({"n_tokens": "max"}).first()[0]
    for s in shares:
        assert abs(rows[s.source].drawn_tokens - s.allotted) <= longest
        assert rows[s.source].most_repeats <= s.max_repeats
    assert rows["void"].actual_share == 0.0 and sum(r.actual_share for r in rows.values()) == pytest.approx(1)
    again = {(r.doc_id, r.repeats) for r in mixing.draw(sizes, shares).collect()}
    assert again == {(r.doc_id, r.repeats) for r in drawn.collect()} and len(again) == len({i for i, _ in again})
    assert mixing.draw(sizes.limit(0), mixing.plan(sizes.limit(0), targets)).count() == 0


def test_token_count_round_trip():
    t = mixing.tokenizer()
    for x in ("Preço ótimo 😀\n\n fim", "a" * 3000, " "):
        assert t.decode(t.encode_ordinary(x)) == x
