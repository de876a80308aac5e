"""Bootstrap operators against brute force with the same weights, and pooled verdicts on figures made by hand."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokentide.operators import evaluation, resampling, scorecard, trials


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        y = None if k % 50 == 7 else int(rng.random() < 0.3)
        a = None if k % 61 == 3 else round(rng.random() + 0.2 * (y or 0), 1)  # many ties
        b = round(rng.random() + 0.5 * (y or 0), 2)
        rows.append((k, y, a, b, rng.choice(["p", "q", None]), rng.choice([None, 1.0, 2.5]), k // 40))
    return spark.createDataFrame(rows, "k long, y int, a double, b double, s string, v double, block int").repartition(5)


def keyed(df, columns):
    rows = df.select(F.xxhash64("k").alias("h"), *columns).collect()
    return np.array([r["h"] for r in rows], np.int64), rows


def auc_brute(rows, w, score, stratum=None):
    wins = pairs = 0.0
    for p, wp in zip(rows, w, strict=True):
        for n, wn in zip(rows, w, strict=True):
            if p["y"] == 1 and n["y"] == 0 and None not in (p[score], n[score]) and (stratum is None or p[stratum] == n[stratum] is not None):
                pairs += wp * wn
                wins += wp * wn * ((p[score] > n[score]) + (p[score] == n[score]) / 2)
    return wins / pairs if pairs else None


def test_weights_are_poisson():
    w = resampling.weights(np.arange(4000, dtype=np.int64) * 7919, np.arange(-1, 50), 7)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.02 and abs(w[:, 1:].var() - 1) < 0.05
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.05 and (w == resampling.weights(np.arange(4000, dtype=np.int64) * 7919, np.arange(-1, 50), 7)).all()


@pytest.mark.parametrize("stratum", [None, "s"])
def test_auc_of_each_draw_equals_brute_force(scored, stratum, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 7)
    draws = [-1, 0, 5, 11]
    got = resampling.auc_draws(scored, "y", "a", "k", draws, stratum=stratum).first()["auc"]
    h, rows = keyed(scored, ["y", "a", "s"])
    w = resampling.weights(h, np.array(draws), 7)
    assert got == pytest.approx([auc_brute(rows, w[:, k], "a", stratum) for k in range(4)])


def test_auc_without_pairs_is_null(spark, scored):
    assert resampling.auc_draws(scored.where("y = 1"), "y", "a", "k", [-1, 0]).first()["auc"] == [None, None]
    assert resampling.paired_gain(scored.where("y = 1"), "y", ["a"], ["b"], "k", 5).first()["low"] is None


def test_paired_gain(scored):
    rows = scored.where("a is not null and y is not null")
    r = resampling.paired_gain(rows, "y", ["a"], ["b"], "k", 400).first()
    one, two = (evaluation.auc(rows, "y", c).first()["auc"] for c in ("a", "b"))
    assert r["gain"] == pytest.approx(two - one, abs=2e-6) and r["reps"] == 400 and r["repeat_least"] == r["repeat_most"] == pytest.approx(r["gain"])
    # the multinomial bootstrap of the same rows, within each class
    data, rng, gains = rows.collect(), np.random.default_rng(1), []
    y, a, b = (np.array([x[c] for x in data], float) for c in ("y", "a", "b"))
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for _ in range(400):
        i, j = rng.choice(pos, len(pos)), rng.choice(neg, len(neg))
        auc = lambda s: ((s[i][:, None] > s[j]) + (s[i][:, None] == s[j]) / 2).mean()  # noqa: B023, E731
        gains.append(auc(b) - auc(a))
    low, high = np.percentile(gains, [2.5, 97.5])
    assert r["low"] == pytest.approx(low, abs=0.25 * (high - low)) and r["high"] == pytest.approx(high, abs=0.25 * (high - low))


def test_repeats_are_drawn(scored):
    rows = scored.where("a is not null").withColumn("c", F.col("b") + F.col("a"))
    r = resampling.paired_gain(rows, "y", ["a", "a"], ["b", "c"], "k", 50).first()
    assert r["reps"] == 50 and r["repeat_least"] < r["repeat_mean"] < r["repeat_most"]


def test_weighted_sums(scored):
    h, rows = keyed(scored, ["v", "block"])
    w = resampling.weights(h, np.arange(-1, 6), 7).astype(int)
    got = {r["rep"]: (r["v"], r["block"]) for r in resampling.weighted_sums(scored, ["v", "block"], "k", 6).collect()}
    for k in range(7):
        assert got[k - 1] == pytest.approx((sum(x * (r["v"] or 0) for x, r in zip(w[:, k], rows, strict=True)), sum(x * r["block"] for x, r in zip(w[:, k], rows, strict=True))))


def test_drawn_blocks(spark):
    blocks = spark.createDataFrame([("g", 3, 1.0), ("g", 1, 10.0), ("g", 2, 100.0), (None, 9, 5.0)], "g string, week int, v double")
    got = {(r["g"], r["rep"]): r["v"] for r in resampling.drawn_blocks(blocks, ["g"], "week", ["v"], 20).collect()}
    place = lambda rep, k, m: int(hashlib.md5(f"7:{rep}:{k}".encode()).hexdigest()[:8], 16) % m
    assert got["g", -1] == 111 and got[None, -1] == 5
    for rep in range(20):
        assert got["g", rep] == sum([10.0, 100.0, 1.0][place(rep, k, 3)] for k in (1, 2, 3)) and got[None, rep] == 5


def test_pooled_gates_need_everything(spark):
    names = "g string, weeks long, lift double, lift_lo double, lift_hi double, sim_gain double, sim_gain_lo double, sim_gain_hi double, sim_top_mean double, collapses_caught_lo double, kept_minus_all_lo double"
    figures = spark.createDataFrame([("good", 3, 2.5, 1.2, 3.0, 9.0, 0.5, 20.0, 7.0, 0.31, 0.1), ("low", 3, 2.5, 1.0, 3.0, 9.0, 0.0, 20.0, 7.0, 0.30, None), ("short", 1, 2.5, None, None, 9.0, None, None, 7.0, None, None)], names)
    lifts = spark.createDataFrame([(g, s, 2.0 + s / 10) for g in ("good", "low", "short") for s in range(3)] + [("none", 0, 3.0), ("none", 1, None)], "g string, seed int, lift double")
    test = spark.createDataFrame([("good", 0.4), ("low", 0.39), ("short", 0.5), ("none", None)], "g string, collapse_removed double")
    got = {r["g"]: r for r in scorecard.pooled_gates(figures, lifts, test, ["g"], 3).collect()}
    assert got["good"]["passed"] and got["good"]["reasons"] == "" and got["good"]["median_lift"] == 2.1
    assert not got["low"]["passed"] and got["low"]["reasons"] == "pooled_lift_lower; sim_diff; collapse"
    assert got["short"]["reasons"] == "too few weeks; pooled_lift; pooled_lift_lower undefined; sim_diff undefined"
    assert got["none"]["weeks"] == 0 and got["none"]["seeds_defined"] == 1 and got["none"]["reasons"].startswith("too few weeks; pooled_lift undefined") and got["none"]["reasons"].endswith("collapse undefined")
    verdict = {r["g"]: r for r in scorecard.filter_verdict(figures, ["g"], F.col("g") != "short").collect()}
    assert verdict["good"]["validated"] and verdict["low"]["reasons"] == "collapses caught; kept minus all undefined" and verdict["short"]["reasons"].startswith("not a filter bucket; too few weeks")


def trial(spark, lift, flip=1):
    rng = random.Random(2)
    rows = []
    for k in range(600):
        y = int(k % 5 == 0)
        noise = {s: rng.random() for s in (1, 2, 3)}
        rows.append((k, y, k % 3 == 0, -40.0 if y else 12.0, float(flip * (y + rng.random())), 0.2, 0.2 + 0.1 * flip, k // 100, *[noise[s] + 0.2 * y for s in (1, 2, 3)], *[noise[s] + (0.2 + lift) * y for s in (1, 2, 3)]))
    names = "k long, y int, runner boolean, net_ret double, x double, pd_low double, pd_high double, block int, without_1 double, without_2 double, without_3 double, with_1 double, with_2 double, with_3 double"
    return spark.createDataFrame(rows, names)


def drift(spark, rise, share):
    return spark.createDataFrame([("with", 0.6 + rise, [("f", share), ("g", 0.3)]), ("without", 0.6, [])], "arm string, auc double, top array<struct<feature: string, share: double>>")


def test_trial_rules(spark):
    rules = lambda rows, d, **kw: {r["rule"]: r["status"] for r in trials.verdict(rows, "k", "block", [1, 2, 3], 2, d, "f", reps=200, **kw).collect()}
    good = rules(trial(spark, 0.5), drift(spark, 0.02, 0.39))
    assert good == dict.fromkeys(["R1", "R2", "R3", "R4", "R5", "result"], "PASS")
    assert rules(trial(spark, 0.5), drift(spark, 0.02, 0.39), weekly=False)["R3"] == "PASS"
    bad = rules(trial(spark, -0.1, -1), drift(spark, 0.03, 0.5))
    assert bad == dict.fromkeys(["R1", "R2", "R3", "R4", "R5", "result"], "FAIL")
    none = rules(trial(spark, 0.5).where("y = 1"), spark.createDataFrame([("with", None, [])], "arm string, auc double, top array<struct<feature: string, share: double>>"))
    assert none["R1"] == none["R2"] == none["R5"] == "n/a" and none["result"] in ("FAIL", "NOT JUDGED")


def test_forward_check_needs_both_classes(spark):
    rows = trial(spark, 0.3).withColumn("part", F.when(F.col("k") < 400, "train").otherwise("test"))
    few = trials.forward_check(rows.where("k < 410"), "y", ["without_1"], "x", "k", 20).first()
    assert few["na"] == "too few rows of a class" and few["gain"] is None and few["test_pos"] == 2
    r = trials.forward_check(rows, "y", ["without_1"], "x", "k", 100).first()
    assert r["na"] is None and r["gain"] > 0 and r["low"] <= r["gain"] <= r["high"] and r["train_pos"] == 80


def test_weights_by_table_are_those_of_the_cuts():
    """Most weights come from a number's first bits alone; numbers beside a cut are still held against it."""
    heads = resampling.BY_HEAD
    assert len(heads) == 1 << 16 and (heads < 0).sum() == len(resampling.CUTS)
    u = (np.arange(1 << 16) + 0.5) / 2.0**16
    plain = (u[:, None] > resampling.CUTS).sum(axis=1)
    assert (heads[heads >= 0] == plain[heads >= 0]).all()
    keys, draws = np.random.default_rng(5).integers(-(2**63), 2**63, 4000), np.arange(-1, 300)
    w = resampling.weights(keys, draws, 3)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs((w[:, 1:] == 0).mean() - resampling.CUTS[0]) < 0.01


def test_gates_score_the_calls_once(spark, monkeypatch):
    from tokentide.plans import trial_queries

    times, scored = [], trial_queries.scored
    monkeypatch.setattr(trial_queries, "scored", lambda *a: times.append(a) or scored(*a))
    trial_queries.pooled_gates(spark, "/root/testdata/sf0.001")
    assert len(times) == 1
