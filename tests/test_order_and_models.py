"""Positions, quantiles, ranks, alignment kernels, the interval join and models, against
plain computations."""

import random
import time
import tracemalloc
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import alignment, coherence, models, statistics, utterances


@pytest.fixture(scope="module")
def values(spark):
    """Groups of very different size, ties, nulls, a null group."""
    rng = random.Random(1)
    rows = [("big", float(rng.randrange(50)) if rng.random() < 0.8 else 7.0, int(rng.random() < 0.3)) for _ in range(900)]
    rows += [("small", float(k), k % 2) for k in range(7)] + [("one", 3.0, 1), (None, 1.0, 0), (None, 4.0, 1), ("big", None, 1), ("none", None, 0)]
    return rows, spark.createDataFrame(rows, "g string, v double, f int").repartition(7)


def by_group(rows):
    out = defaultdict(list)
    for g, v, f in rows:
        if v is not None:
            out[g].append((v, f))
    return out


def test_positions(values):
    rows, df = values
    got = {(r.g, r.v): (r.n, r.before, r.total) for r in statistics.positions(df, ["g"], "v").collect()}
    want = {}
    for g, xs in by_group(rows).items():
        for v in {x for x, _ in xs}:
            want[g, v] = (sum(x == v for x, _ in xs), sum(x < v for x, _ in xs), len(xs))
    assert got == want


def test_quantiles_and_trimming(values):
    rows, df = values
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in statistics.quantiles(df, ["g"], "v", probs).collect()}
    groups = by_group(rows)
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.quantile([x for x, _ in xs], probs).tolist())
    trimmed = {r.g: r.trimmed for r in statistics.trimmed_by_rank(df, "g", "v").collect()}
    for g, xs in groups.items():
        if g is not None:
            v, cut = sorted(x for x, _ in xs), int(0.1 * len(xs))
            assert trimmed[g] == pytest.approx(np.mean(v[cut : len(v) - cut]))


def test_rank_sum(values):
    rows, df = values
    got = {r.g: (r.u, r.n1, r.n0) for r in statistics.rank_sum(df, "g", "f", "v").collect()}
    for g, xs in by_group(rows).items():
        if g is not None:
            ones, zeros = [v for v, f in xs if f], [v for v, f in xs if not f]
            u = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
            assert got[g] == (u if ones else None, len(ones), len(zeros))


def test_no_window_holds_a_group(values):
    """No plan sorts a group in one task: windows are over partitions of positions only."""
    _, df = values
    for q in (statistics.rank_sum(df, "g", "f", "v"), statistics.trimmed_by_rank(df, "g", "v"), statistics.box_stats(df, ["g"], "v")):
        plan = q._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan
        assert all("_key" in line for line in plan.split("\n") if "Window [" in line)


def test_exact_p():
    def naive(n1, n0):
        table = {(0, j): [1] for j in range(n0 + 1)} | {(i, 0): [1] for i in range(n1 + 1)}
        for i in range(1, n1 + 1):
            for j in range(1, n0 + 1):
                out = [0] * (i * j + 1)
                for k, v in enumerate(table[i - 1, j]):
                    out[k + j] += v
                for k, v in enumerate(table[i, j - 1]):
                    out[k] += v
                table[i, j] = out
        return table[n1, n0]

    for n1 in range(1, 7):
        for n0 in range(1, 7):
            assert statistics.u_ways(n1, n0) == naive(n1, n0)
    began = time.process_time()
    assert statistics.mann_whitney_p(40_000, 8, 10_000) == pytest.approx(1.0)
    assert 0 < statistics.mann_whitney_p(79_990, 8, 10_000) < 1e-20
    assert time.process_time() - began < 4


def naive_ops(ref, hyp):
    n, m = len(ref), len(hyp)
    c = [[i + j for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            c[i][j] = min(c[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), c[i - 1][j] + 1, c[i][j - 1] + 1)
    i, j, out = n, m, []
    while i or j:
        if i and j and c[i][j] == c[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append(("hit" if ref[i] == hyp[j] else "sub", i, j))
        elif i and c[i][j] == c[i - 1][j] + 1:
            i -= 1
            out.append(("del", i, None))
        else:
            j -= 1
            out.append(("ins", None, j))
    return out[::-1]


def test_alignment_kernels():
    rng = random.Random(2)
    draw = lambda n: [rng.choice("abcd") for _ in range(rng.randrange(n))]
    pairs = [(draw(30), draw(30)) for _ in range(400)] + [([], []), ([], ["a"]), (["a"], [])]
    want = [naive_ops(r, h) for r, h in pairs]
    assert [alignment.align(r, h) for r, h in pairs] == want
    codes = lambda x: np.array([ord(c) for c in x], np.int64)
    got = alignment.error_counts([codes(r) for r, _ in pairs], [codes(h) for _, h in pairs])
    assert got.tolist() == [list(alignment.counts_of(w).values()) for w in want]


def test_long_alignment_in_little_memory():
    a = np.random.default_rng(1).integers(0, 500, 6000)
    b = np.delete(np.where(np.arange(6000) % 7 == 0, -5, a), np.arange(0, 6000, 11))
    tracemalloc.start()
    kinds, _, _ = alignment.align_codes(a, b)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 16 << 20
    assert np.bincount(kinds, minlength=4).tolist() == alignment.error_counts([a], [b])[0].tolist()


def test_alignment_columns(spark):
    df = spark.createDataFrame([(1, ["a", "b", ""], ["a", "x", "", "y"]), (2, [], ["q"]), (3, None, ["q"]), (4, ["same"], ["same"])], "id int, r array<string>, h array<string>").na.drop()
    got = {r.id: ([(o.op, o.ref_idx, o.hyp_idx) for o in r.o], tuple(r.c)) for r in df.select("id", alignment.alignment_ops("r", "h").alias("o"), alignment.alignment_counts("r", "h").alias("c")).collect()}
    assert got == {1: ([("hit", 0, 0), ("sub", 1, 1), ("hit", 2, 2), ("ins", None, 3)], (2, 1, 0, 1)), 2: ([("ins", None, 0)], (0, 0, 0, 1)), 4: ([("hit", 0, 0)], (1, 0, 0, 0))}


def test_many_distinct_tokens(spark):
    """Codes run past the surrogates."""
    n = 40_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i)).alias("v"))
    number = lambda x, shift: F.lit(alignment.FIRST_CODE) + x
    assert alignment.FIRST_CODE + n > alignment.SURROGATES
    few = df.select(F.concat(F.slice("v", 1, 5), F.slice("v", n - 3, 4)).alias("r"), F.concat(F.slice("v", 1, 4), F.slice("v", n - 2, 3)).alias("h"))
    assert few.select(alignment.encoded_distance(F.col("r"), F.col("h")).alias("d")).first().d == 2


def test_speaker_by_time(spark):
    """Overlaps, gaps, ties, instants, whole transcripts at one point in time, odd intervals."""
    rng = random.Random(4)
    at = lambda: rng.randrange(60) / 2
    refs = [(p, k, s, s + rng.choice([0.0, 0.5, 1.0, 9.0]), f"S{k % 3}") for p in ("a", "b", None) for k in range(25) for s in [at()]]
    refs += [("point", k, 5.0, 5.0, f"S{k}") for k in range(3)] + [("a", 90, None, 1.0, "X"), ("a", 91, 4.0, 3.0, "X")]
    asks = [(p, k, s, s + rng.choice([0.0, 0.5, 4.0])) for p in ("a", "b", None, "point", "empty") for k in range(30) for s in [at() - 5]]
    asks += [("a", 100, None, 2.0), ("a", 101, 3.0, 2.0), ("a", 0, 1.0, 1.5), ("far", 1, 0.0, 1.0)]
    got = utterances.speaker_by_time(spark.createDataFrame(asks, "p string, q int, s double, e double"), spark.createDataFrame(refs, "p string, pos int, s double, e double, speaker string"), ["p"])
    want = []
    for p, q, s, e in asks:
        best = None
        if s is not None and e is not None and e >= s:
            for rp, pos, rs, re_, who in refs:
                if rp == p and rs is not None and re_ >= rs:
                    o = max(0.0, min(e, re_) - max(s, rs))
                    rank = (-o, 0.0 if o else abs((s + e) / 2 - (rs + re_) / 2), pos, who)
                    best = rank if best is None or rank < best else best
        want.append((p, q, s, e, best and best[-1]))
    assert sorted(map(repr, (tuple(r) for r in got.select("p", "q", "s", "e", "speaker_true").collect()))) == sorted(map(repr, want))


def prepared(train, test):
    med = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0 for c in train.T])
    train, test = np.where(np.isnan(train), med, train), np.where(np.isnan(test), med, test)
    mean, sd = train.mean(axis=0), train.std(axis=0)
    sd = np.where(sd < 1e-12, 1, sd)
    return (train - mean) / sd, (test - mean) / sd


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_l1(x, y, classes, rounds=60_000):
    """Balanced L1 logistic regression by accelerated proximal gradient, to the end."""
    weight = len(y) / ((np.bincount(y) > 0).sum() * np.bincount(y)[y])
    a, hot = np.column_stack([np.ones(len(x)), x]), np.eye(classes)[y]
    step = (4 if classes == 1 else 2) / np.linalg.norm(a * np.sqrt(weight)[:, None], 2) ** 2
    w = z = np.zeros((a.shape[1], classes))
    t = 1.0
    for _ in range(rounds):
        new = z - step * a.T @ (weight[:, None] * (softmax(a @ z) - hot))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((z - new) * (new - w)).sum() > 0:
            t2 = 1.0
        z, done = new + (t - 1) / t2 * (new - w), np.abs(new - w).max() < 1e-12
        w, t = new, t2
        if done:
            break
    return w


@pytest.fixture(scope="module")
def table(spark):
    rng, n = np.random.default_rng(0), 300
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n), "key": np.arange(n), "fold": rng.integers(0, 3, n).astype("int32"), "x1": rng.normal(1000, 3, n), "x2": rng.integers(0, 5, n).astype(float), "x3": rng.normal(size=n) ** 3, "x4": 7.0})
    pdf["y"] = pdf.x1 * 0.5 + pdf.x2 - pdf.x3 + rng.normal(size=n)
    pdf["k"] = np.where(pdf.x3 > 0.4, "p", rng.choice(list("pqr"), n))
    pdf.loc[rng.random(n) < 0.2, "x2"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "x1"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(5)


COLUMNS = ["x1", "x2", "x3", "x4"]


def each_fold(pdf):
    for _, part in pdf.groupby("g"):
        for k in sorted(part.fold.unique()):
            train, test = part[part.fold != k], part[part.fold == k]
            yield train, test, *prepared(train[COLUMNS].to_numpy(float), test[COLUMNS].to_numpy(float))


def test_linear(table):
    pdf, df = table
    got = {r.key: r.oof_pred for r in models.out_of_fold(df, "g", "key", "y", COLUMNS, "linear").collect()}
    assert len(got) == len(pdf)
    for train, test, a, b in each_fold(pdf):
        w = np.linalg.lstsq(np.column_stack([np.ones(len(a)), a]), train.y, rcond=None)[0]
        assert np.allclose([got[k] for k in test.key], w[0] + b @ w[1:], atol=1e-8)


def test_logistic(table):
    pdf, df = table
    middle = float(pdf.y.median())
    got = {r.key: r for r in models.out_of_fold(df.withColumn("c", (F.col("y") > middle).cast("double")), "g", "key", "c", COLUMNS, "logistic").collect()}
    for train, test, a, b in each_fold(pdf):
        w = fit_l1_binary(a, (train.y > middle).to_numpy().astype(float))
        p = 1 / (1 + np.exp(-(w[0] + b @ w[1:])))
        assert np.allclose([got[k].oof_proba_pos for k in test.key], p, atol=1e-6)
        assert all(got[k].oof_pred == float(got[k].oof_proba_pos >= 0.5) for k in test.key)


def fit_l1_binary(x, y, rounds=60_000):
    n1 = y.sum()
    weight = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))
    a = np.column_stack([np.ones(len(x)), x])
    step = 4 / np.linalg.norm(a * np.sqrt(weight)[:, None], 2) ** 2
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = z - step * a.T @ (weight * (1 / (1 + np.exp(-a @ z)) - y))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step, 0)
        t2 = 1.0 if ((z - new) * (new - w)).sum() > 0 else (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, done = new + (t - 1) / t2 * (new - w), np.abs(new - w).max() < 1e-13
        w, t = new, t2
        if done:
            break
    return w


def test_classes(table):
    pdf, df = table
    got = {r.key: r for r in models.out_of_fold_classes(df, "g", "key", "k", COLUMNS, ["r", "p", "q"]).collect()}
    for train, test, a, b in each_fold(pdf):
        w = fit_l1(a, train.k.map({"p": 0, "q": 1, "r": 2}).to_numpy(), 3)
        p = softmax(np.column_stack([np.ones(len(b)), b]) @ w)
        assert np.allclose([got[k].oof_proba for k in test.key], p, atol=1e-5)
        assert all(got[k].oof_pred == "pqr"[int(np.argmax(got[k].oof_proba))] for k in test.key)


def test_model_choice(table):
    pdf, df = table
    got = {kind: {r.key: r.oof_pred for r in models.out_of_fold(df, "g", "key", "y", COLUMNS, kind, alpha=0.3).collect()} for kind in ("ridge", "lasso")}
    for train, test, a, b in each_fold(pdf):
        y = train.y.to_numpy()
        ridge = np.linalg.solve(a.T @ a + 0.3 * np.eye(4), a.T @ (y - y.mean()))
        assert np.allclose([got["ridge"][k] for k in test.key], y.mean() + b @ ridge, atol=1e-7)
        lasso = np.zeros(4)
        for _ in range(3000):
            for j in range(3):
                rest = y - y.mean() - a @ lasso + a[:, j] * lasso[j]
                rho = a[:, j] @ rest / len(a)
                lasso[j] = np.sign(rho) * max(abs(rho) - 0.3, 0) / (a[:, j] @ a[:, j] / len(a))
        assert np.allclose([got["lasso"][k] for k in test.key], y.mean() + b @ lasso, atol=1e-6)
    with pytest.raises(ValueError):
        models.out_of_fold(df, "g", "key", "y", COLUMNS, "forest")


def test_squared_penalty(table):
    pdf, df = table
    middle = float(pdf.y.median())
    got = {r.key: r.oof_proba_pos for r in models.out_of_fold(df.withColumn("c", (F.col("y") > middle).cast("double")), "g", "key", "c", COLUMNS, "logistic", penalty="l2").collect()}
    for train, test, a, b in each_fold(pdf):
        y = (train.y > middle).to_numpy().astype(float)
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        x, w = np.column_stack([np.ones(len(a)), a]), np.zeros(5)
        own = np.array([0, 1, 1, 1, 1.0])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(own), x.T @ (weight * (p - y)) + own * w)
        assert np.allclose([got[k] for k in test.key], 1 / (1 + np.exp(-(w[0] + b @ w[1:]))), atol=1e-6)


def test_models_that_cannot_be_trained(spark):
    """One fold only, one class only, a class that the training rows lack, unknown targets."""
    rows = [("one", 0, 0, 1.0, 2.0, "a"), ("one", 1, 0, 2.0, 3.0, "b"), ("same", 2, 0, 1.0, 1.0, "a"), ("same", 3, 1, 2.0, 1.0, "a"), ("same", 4, 1, 3.0, None, "a"), (None, 5, 0, 1.0, 5.0, "a"), (None, 6, 1, None, 7.0, "b"), (None, 7, 1, 3.0, 7.0, "a")]
    df = spark.createDataFrame(rows, "g string, id long, fold int, x double, y double, c string")
    linear = {r.id: r.oof_pred for r in models.out_of_fold(df, "g", "id", "y", ["x"], "linear").collect()}
    assert linear[0] is None and linear[1] is None and linear[2] == linear[3] == 1.0 and linear[5] == 7.0 and linear[6] == linear[7] == 5.0 and 4 not in linear
    binary = {r.id: r.oof_pred for r in models.out_of_fold(df.withColumn("b", (F.col("c") == "a").cast("double")), "g", "id", "b", ["x"], "logistic").collect()}
    assert binary[0] is None and binary[2] is None and binary[5] is not None
    classes = {r.id: r for r in models.out_of_fold_classes(df, "g", "id", "c", ["x"], ["a", "b"]).collect()}
    assert classes[0].oof_proba is None and classes[2].oof_proba == [1.0, 0.0] and classes[6].oof_proba == [1.0, 0.0] and classes[5].oof_pred in "ab"


def test_folds(spark):
    df = spark.createDataFrame([(k * 9_000_000_000_000, "xy"[k % 2]) for k in range(100)] + [(0, "x")], "id long, label string")
    got = models.stratified_folds(df.withColumn("plain", models.fold("id", 5)), "label", "id", 5).collect()
    assert len(got) == 101 and {r.plain for r in got} == set(range(5))
    for label in "xy":
        n = np.bincount([r.fold for r in set(got) if r.label == label], minlength=5)
        assert n.max() - n.min() <= 1


def test_numbered(spark):
    rows = [(g, v) for g in ("a", "b", None) for v in (3, 1, 2, 2)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = statistics.numbered(df, ["g"], ["v"], "i").collect()
    assert sorted(map(repr, ((r.g, r.v, r.i) for r in got))) == sorted(map(repr, ((g, v, i) for g in ("a", "b", None) for v, i in ((1, 1), (2, 2), (2, 3), (3, 4)))))
    whole = statistics.numbered(df, [], ["v"], "i").collect()
    assert sorted(r.i for r in whole) == list(range(1, 13)) and all((r.v == 1) == (r.i <= 3) for r in whole)


def naive_windows(vectors, factors, ids, how):
    out = []
    for end in range(1, len(ids) + 1):
        inside = [i for i in ids[max(0, end - how.window) : end] if i >= 0]
        weight = {i: {"logfreq": np.log10(inside.count(i) + 1.0), "freq": inside.count(i), "none": 1.0}[how.weighting] * factors[i] for i in set(inside)}
        if len(inside) >= how.least_tokens and sum(weight.values()):
            e = sum(w * vectors[i] for i, w in weight.items()) / sum(weight.values())
            if np.linalg.norm(e) > 0:
                out.append(e)
    return np.array(out).reshape(-1, vectors.shape[1])


def test_window_vectors(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(coherence, "CHUNK", 7)
    for k in range(60):
        u, n = rng.integers(1, 12), rng.integers(0, 50)
        v, f, ids = rng.normal(size=(u, 5)), rng.random(u) * (rng.random(u) > 0.2), rng.integers(-1, u, n)
        how = coherence.Coherence(window=int(rng.integers(1, 9)), least_tokens=int(rng.integers(1, 4)), weighting=("logfreq", "freq", "none")[k % 3])
        assert np.allclose(coherence.window_vectors(v, f, ids, how), naive_windows(v, f, ids, how))


def test_model_rows_go_in_blocks(spark):
    """A pass meets blocks, not rows, and they hold every row of their group."""
    n = models.BLOCK_ROWS + 500
    df = spark.range(n, numPartitions=1).selectExpr("id", "if(id % 10 = 0, 'b', null) AS g", "int(id % 5) AS fold", "double(id) AS u", "if(id % 7 = 0, null, double(id % 3)) AS v", "double(id % 2) AS y")
    f = models.Features(df, "g", ["u", "v"], [F.col("y")], ["id"])
    got = models.blocks(f).collect()
    assert len(got) < n / 100 and sum(r.n for r in got) == n
    own = {g: sorted(map(str, ((round(r.x0 + f.shift[0]), r.fold, r.t0) for r in rows))) for g, rows in ((g, f.rows.where(F.col("_g") == g).collect()) for g in {r["_g"] for r in got})}
    for g, want in own.items():
        have = []
        for r in (r for r in got if r["_g"] == g):
            x, k, hot = np.frombuffer(r.x, float).reshape(r.n, -1), np.frombuffer(r.fold, np.int32), np.frombuffer(r.hot, float)
            have += [(round(a + f.shift[0]), int(b), float(c)) for a, b, c in zip(x[:, 0], k, hot)]
        assert sorted(map(str, have)) == want
