"""Out-of-fold models over feature tables, from sums over rows.

No group of rows is ever gathered. A pass over the rows gives, for each group and fold, the
matrix of products of (1, features, which features are missing, targets); a fold's training
data are all folds less its own, so all models of a group come from one pass. Because the
missing ones are columns of their own, the matrix also holds the products after imputing
any value. Medians are exact order statistics of the training folds. Linear models are
solved from these products. Penalised logistic models take a few more passes, which add up
the loss, its gradient and its curvature for every fold's model at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import statistics
from tessera.session import stored


def key_hash(key: str) -> Column:
    """52 bits of a key of any type, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 13), 16, 10).cast("long")


def fold(key: str, k: int) -> Column:
    """A fold by the hash of a key."""
    return F.pmod(key_hash(key), F.lit(k)).cast("int")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, out: str = "fold") -> DataFrame:
    """``df`` with folds that deal every class out evenly: the rows of a class are numbered
    in the order of their hash. Rows of one key get the same fold."""
    place = F.struct(key_hash(key).alias("h"), F.col(key).cast("string").alias("k"))
    keyed = df.select(F.struct(label).alias("_label"), place.alias("_place")).distinct()
    number = statistics.positions(keyed, ["_label"], "_place").select("_label", "_place", F.pmod("before", F.lit(k)).cast("int").alias(out))
    return df.withColumns({"_label": F.struct(label), "_place": place}).join(number, ["_label", "_place"]).drop("_label", "_place")


def group_fold(group: str) -> Column:
    """Leave one group out: every group is a fold of its own. Groups are few (sources,
    sites), and only one row of each is ranked."""
    return (F.dense_rank().over(Window.orderBy(group)) - 1).cast("int")


def leave_groups_out(df: DataFrame, group: str) -> DataFrame:
    """``df`` with a ``fold`` per group; a null group has a fold of its own."""
    folds = df.select(group).distinct().withColumn("fold", group_fold(group))
    return df.join(folds.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def one_hot(df: DataFrame, label: str, classes: list) -> DataFrame:
    """A 0/1 column is_<class> for every class, in sorted order."""
    return df.select("*", *(F.col(label).eqNullSafe(F.lit(c)).cast("int").alias(f"is_{c}") for c in sorted(classes)))


#: Partial sums that a task holds before it hands them on.
HELD_BYTES = 32 << 20


def _summed(rows: DataFrame, partial, length: int) -> DataFrame:
    """(_g, fold, sums): ``partial`` gives, for the rows of one group, (fold, array) pairs;
    arrays of a length add up in the task, and then over tasks, element by element."""

    def work(frames):
        held: dict = {}
        for pdf in frames:
            # Groups are compared as text; the key goes along as it is.
            for g, part in pdf.groupby("_g", sort=False):
                for k, sums in partial(part):
                    held[g, k] = held[g, k] + sums if (g, k) in held else sums
            if len(held) * length * 8 > HELD_BYTES:
                yield _frame(held)
                held = {}
        yield _frame(held)

    def _frame(held):
        return pd.DataFrame({"_g": [g for g, _ in held], "fold": pd.array([k for _, k in held], "int32"), "sums": pd.Series([s.tolist() for s in held.values()], dtype=object)})

    parts = rows.mapInPandas(work, "_g string, fold int, sums array<double>")
    each = parts.select("_g", "fold", F.posexplode("sums").alias("i", "x")).groupBy("_g", "fold", "i").agg(F.sum("x").alias("x"))
    return each.groupBy("_g", "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("sums"))


def _training(per_fold: DataFrame) -> DataFrame:
    """(_g, fold, sums) of all other folds of the group: the group's sums less the fold's."""
    each = per_fold.select("_g", F.posexplode("sums").alias("i", "x")).groupBy("_g", "i").agg(F.sum("x").alias("x"))
    whole = each.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("all"))
    return per_fold.join(whole, "_g").select("_g", "fold", F.zip_with("all", "sums", lambda a, b: a - b).alias("sums"))


def training_medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(_g, fold, medians by column) of the known values of all other folds."""
    counted = statistics.long_form(rows.select("_g", "fold", *(F.col(c).cast("double").alias(c) for c in columns)), ["_g", "fold"], columns, "name", "v").where("v is not null").groupBy("_g", "fold", "name", "v").agg(F.count(F.lit(1)).alias("n"))
    held_out = rows.select("_g", F.col("fold").alias("out")).distinct()
    others = counted.join(held_out, "_g").where("fold <> out").groupBy("_g", F.col("out").alias("fold"), "name", "v").agg(F.sum("n").alias("n"))
    middle = statistics.quantiles_of(statistics.positions_of(others, ["_g", "fold", "name"], "v"), ["_g", "fold", "name"], "v", [0.5])
    return middle.groupBy("_g", "fold").agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("q")[0]))).alias("medians"))


class Scaled:
    """What a fold's model needs of its training rows: medians of the columns, and mean and
    deviation after imputing them, all less the columns' overall means (``shift``)."""

    def __init__(self, sums: np.ndarray, medians: np.ndarray, targets: int):
        p = len(medians)
        m = np.asarray(sums).reshape(2 * p + 1 + targets, -1)
        impute = np.zeros((1 + p + targets, len(m)))
        impute[0, 0] = 1
        impute[1 + np.arange(p), 1 + np.arange(p)] = 1
        impute[1 + np.arange(p), 1 + p + np.arange(p)] = medians
        impute[1 + p + np.arange(targets), 1 + 2 * p + np.arange(targets)] = 1
        m = impute @ m @ impute.T
        self.n, self.targets = m[0, 0], m[0, 1 + p :]
        self.mean = m[0, 1 : 1 + p] / self.n if self.n else np.zeros(p)
        cov = m[1:, 1:] / max(self.n, 1) - np.outer(m[0, 1:], m[0, 1:]) / max(self.n, 1) ** 2
        self.cov, self.with_targets = cov[:p, :p], cov[:p, p:]
        var = np.maximum(np.diag(self.cov), 0)
        # Deviations that are rounding errors of the sums are none.
        self.sd = np.where(var > 1e-14 * np.maximum(m[0, 0] and np.diag(m)[1 : 1 + p] / max(self.n, 1), 1e-300), np.sqrt(var), 0)
        self.sd = np.where(self.sd == 0, 1, self.sd)


def linear_weights(s: Scaled) -> np.ndarray:
    """Intercept and slopes on the shifted features; the least of equally good ones."""
    flat = np.diag(s.cov) <= 0
    r = np.where(flat[:, None] | flat[None, :], 0, s.cov / np.outer(s.sd, s.sd))
    b = np.linalg.pinv(r, rcond=1e-11, hermitian=True) @ (s.with_targets[:, 0] / s.sd) / s.sd
    return np.concatenate([[s.targets[0] / s.n - b @ s.mean], b])


def ridge_weights(s: Scaled, alpha: float) -> np.ndarray:
    """As above with ``alpha`` times the squared slopes on the standardised features."""
    r, xy = s.n * s.cov / np.outer(s.sd, s.sd), s.n * s.with_targets[:, 0] / s.sd
    b = np.linalg.solve(r + alpha * np.eye(len(xy)), xy) / s.sd
    return np.concatenate([[s.targets[0] / s.n - b @ s.mean], b])


def lasso_weights(s: Scaled, alpha: float) -> np.ndarray:
    """Half the mean squared error plus ``alpha`` times the absolute slopes."""
    r, xy = s.cov / np.outer(s.sd, s.sd), s.with_targets[:, 0] / s.sd
    b = newton_step(np.zeros(len(xy)), -xy / alpha, r / alpha, np.zeros(len(xy), bool)) / s.sd
    return np.concatenate([[s.targets[0] / s.n - b @ s.mean], b])


#: Regressions by name; more can be given to ``out_of_fold`` as functions of ``Scaled``.
REGRESSIONS = {"linear": lambda s, alpha: linear_weights(s), "ridge": ridge_weights, "lasso": lasso_weights}


class Features:
    """The rows as the passes read them: _g (the group as text), fold, the columns less their
    overall mean, targets."""

    def __init__(self, df: DataFrame, group: str, columns: list[str], targets: list[Column], extra: list[str]):
        known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        self.columns, self.n_targets = [f"x{i}" for i in range(len(columns))], len(targets)
        self.targets = [f"t{i}" for i in range(len(targets))]
        base = stored(df.select(
            group, *extra, F.to_json(F.struct(group)).alias("_g"), F.col("fold").cast("int").alias("fold"), *(known(c).alias(n) for c, n in zip(columns, self.columns)), *(t.cast("double").alias(n) for t, n in zip(targets, self.targets)),
        ), "model-rows")
        sums = base.agg(*(F.avg(c).alias(f"m{c}") for c in self.columns), *(F.count_if(F.col(c).isNull()).alias(f"n{c}") for c in self.columns)).first()
        self.shift = [sums[f"m{c}"] or 0.0 for c in self.columns]
        self.gaps = any(sums[f"n{c}"] for c in self.columns)
        self.rows = base.select(group, *extra, "_g", "fold", *((F.col(c) - F.lit(s)).alias(c) for c, s in zip(self.columns, self.shift)), *self.targets)

    def scaled(self) -> DataFrame:
        """Stored (_g, fold, sums, medians): what ``Scaled`` takes, for every held-out fold."""
        columns, targets = self.columns, self.targets

        def partial(part):
            x = part[columns].to_numpy(float)
            gone = np.isnan(x)
            u = np.column_stack([np.ones(len(x)), np.where(gone, 0, x), gone, part[targets].to_numpy(float)])
            for k in np.unique(part["fold"]):
                v = u[(part["fold"] == k).to_numpy()]
                yield k, (v.T @ v).ravel()

        size = (1 + 2 * len(columns) + len(targets)) ** 2
        sums = stored(_summed(self.rows.select("_g", "fold", *columns, *targets), partial, size), "model-sums")
        out = _training(sums)
        if self.gaps:
            middle = training_medians(self.rows, columns)
            out = out.join(middle, ["_g", "fold"], "left")
        else:
            out = out.withColumn("medians", F.lit(None).cast("map<string,double>"))
        medians = F.array(*(F.coalesce(F.try_element_at("medians", F.lit(c)), F.lit(-s)) for c, s in zip(columns, self.shift)))
        return stored(out.select("_g", "fold", "sums", medians.alias("medians")), "model-scales")


def _of(row_sums, medians, targets: int) -> Scaled:
    return Scaled(np.array(row_sums, float), np.array(medians, float), targets)


def out_of_fold(df: DataFrame, group: str, key: str, y: str, columns: list[str], kind="linear", clip: tuple[float, float] | None = None, alpha: float = 1.0, penalty: str = "l1") -> DataFrame:
    """(group, key, y_true, oof_pred, fold[, oof_proba_pos]) for rows with a ``fold`` column
    and a known y; one model per group (source) and fold, null where it cannot be trained.
    ``kind`` is a regression by name or a function of ``Scaled`` and ``alpha`` that gives intercept and
    slopes, or ``logistic`` with an absolute (``l1``) or squared (``l2``) penalty."""
    if kind == "logistic":
        return _out_of_fold_binary(df, group, key, y, columns, penalty)
    if isinstance(kind, str) and kind not in REGRESSIONS:
        raise ValueError(f"unknown model: {kind}")
    fit = REGRESSIONS[kind] if isinstance(kind, str) else kind
    f = Features(df.where(F.col(y).isNotNull()), group, columns, [F.col(y)], [key])

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series, medians: pd.Series) -> pd.Series:
        scales = [_of(s, m, 1) for s, m in zip(sums, medians)]
        return pd.Series([np.asarray(fit(s, alpha)).tolist() if s.n > 0.5 else None for s in scales], dtype=object)

    models = f.scaled().select("_g", "fold", "medians", solve("sums", "medians").alias("w"))
    met = f.rows.join(models, ["_g", "fold"], "left")
    value = F.col("w")[0]
    for i, c in enumerate(f.columns):
        value = value + F.col("w")[i + 1] * F.coalesce(F.col(c), F.col("medians")[i])
    if clip:
        value = F.when(value.isNotNull(), F.greatest(F.lit(float(clip[0])), F.least(F.lit(float(clip[1])), value)))
    return met.select(group, key, F.col("t0").alias("y_true"), value.alias("oof_pred"), "fold")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_terms(a: np.ndarray, hot: np.ndarray, weight: np.ndarray, w: np.ndarray, binary: bool) -> np.ndarray:
    """The weighted loss, its gradient and its curvature at ``w``, one after the other."""
    if binary:
        z = a @ w[:, 0]
        prob = 1 / (1 + np.exp(-z))
        loss = (weight * (np.logaddexp(0, z) - hot[:, -1] * z)).sum()
        grad = a.T @ (weight * (prob - hot[:, -1]))
        curve = (a * (weight * prob * (1 - prob))[:, None]).T @ a
        return np.concatenate([[loss], grad, curve.ravel()])
    z = a @ w
    seen = weight[None, :] > 0
    z = np.where(seen, z, -np.inf)
    prob, own = _softmax(z), (hot * weight[None, :]).sum(axis=1)
    loss = -(own * np.log((prob * hot).sum(axis=1))).sum()
    grad = a.T @ (own[:, None] * (prob - hot))
    classes, p = w.shape[1], w.shape[0]
    curve = np.empty((p, classes, p, classes))
    for i in range(classes):
        for j in range(classes):
            curve[:, i, :, j] = (a * (own * prob[:, i] * ((i == j) - prob[:, j]))[:, None]).T @ a
    return np.concatenate([[loss], grad.ravel(), curve.ravel()])


def newton_step(w: np.ndarray, grad: np.ndarray, curve: np.ndarray, free: np.ndarray, squared: bool = False) -> np.ndarray:
    """The change that minimises the quadratic model plus the absolute weights (but those
    that are ``free``), one coordinate after the other; with ``squared`` plus half their squares,
    by one solution."""
    if squared:
        own = (~free).astype(float)
        return np.linalg.solve(curve + np.diag(own + 1e-9 * max(1.0, np.diag(curve).max())), -(grad + own * w))
    d = np.zeros(len(w))
    curve = curve + np.diag(np.full(len(w), 1e-9 * max(1.0, np.diag(curve).max())))
    slope = grad.copy()
    for _ in range(2000):
        most = 0.0
        for j in range(len(w)):
            h, at = curve[j, j], w[j] + d[j]
            target = at - slope[j] / h
            if not free[j]:
                target = np.sign(target) * max(abs(target) - 1 / h, 0)
            if target != at:
                d[j] += target - at
                slope += curve[:, j] * (target - at)
                most = max(most, abs(target - at))
        if most < 1e-13:
            break
    return d


class Descent:
    """Where a model stands: weights, loss there, the step being tried and its length."""

    @staticmethod
    def start(size: int) -> list:
        return [0.0] * size + [0.0] * size + [1.0, float("inf"), 0.0]

    @staticmethod
    def at(state) -> np.ndarray:
        s = np.asarray(state, float)
        size = (len(s) - 3) // 2
        return s[:size] + s[-3] * s[size : 2 * size]

    @staticmethod
    def follow(state, sums, free: np.ndarray, squared: bool = False) -> list:
        """The next state: a step that lowered the objective is taken, others are halved."""
        s, size = np.asarray(state, float), (len(state) - 3) // 2
        w, d, length, best = s[:size], s[size : 2 * size], s[-3], s[-2]
        now = w + length * d
        value = sums[0] + (0.5 * (now[~free] ** 2).sum() if squared else np.abs(now[~free]).sum())
        if value > best + 1e-12 * abs(best) and length > 1e-6:
            return [*w.tolist(), *d.tolist(), length / 2, best, 0.0]
        step = newton_step(now, np.asarray(sums[1 : 1 + size]), np.asarray(sums[1 + size :]).reshape(size, size), free, squared)
        done = float(np.abs(step).max() < 1e-9 or length <= 1e-6)
        return [*now.tolist(), *(step * (1 - done)).tolist(), 1.0, value, done]


#: Rows of a group that go through the passes as one.
BLOCK_ROWS = 4096


def blocks(f: Features) -> DataFrame:
    """Stored (_g, n, x, fold, hot): up to ``BLOCK_ROWS`` rows of a group, written once, so that a
    pass joins a model to a block instead of to every row."""
    columns, targets = f.columns, f.targets

    def work(frames):
        held: dict = {}

        def packed(g):
            parts, held[g] = held[g], []
            x, k, hot = (np.concatenate([p[i] for p in parts]) for i in range(3))
            return {"_g": g, "n": len(k), "x": x.tobytes(), "fold": k.tobytes(), "hot": hot.tobytes()}

        def frame(rows):
            return pd.DataFrame(rows, columns=["_g", "n", "x", "fold", "hot"])

        for pdf in frames:
            out = []
            for g, part in pdf.groupby("_g", sort=False):
                for at in range(0, len(part), BLOCK_ROWS):
                    some = part.iloc[at : at + BLOCK_ROWS]
                    held.setdefault(g, []).append((some[columns].to_numpy(float), some["fold"].to_numpy(np.int32), some[targets].to_numpy(float)))
                    if sum(len(p[1]) for p in held[g]) >= BLOCK_ROWS:
                        out.append(packed(g))
            # Many small groups are not held until the end.
            if sum(len(p) for p in held.values()) > BLOCK_ROWS:
                out += [packed(g) for g in list(held) if held[g]]
                held.clear()
            if out:
                yield frame(out)
        rest = [packed(g) for g in list(held) if held[g]]
        if rest:
            yield frame(rest)

    # Blocks are large, so few go to Python at once.
    f.rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    return stored(f.rows.select("_g", "fold", *columns, *targets).mapInPandas(work, "_g string, n int, x binary, fold binary, hot binary"), "model-blocks")


def penalised(f: Features, binary: bool, c: float = 1.0, penalty: str = "l1", most_passes: int = 100) -> DataFrame:
    """Stored (_g, fold, medians, w): balanced logistic models with an ``l1`` or ``l2`` penalty of all groups and folds,
    null where training rows of a single class are left. The proximal Newton steps of all
    models go forward together, one pass over the rows each."""
    if penalty not in ("l1", "l2"):
        raise ValueError(f"unknown penalty: {penalty}")
    squared = penalty == "l2"
    p, classes, columns, targets = len(f.columns), f.n_targets, f.columns, f.targets
    width = 1 if binary else classes
    size = (p + 1) * width
    free = np.zeros((p + 1, width), bool)
    free[0] = True
    free = free.ravel()
    scales = f.scaled()
    packed = lambda state: scales.join(state, ["_g", "fold"]).groupBy("_g").agg(F.collect_list(F.struct(F.col("fold").alias("out"), "sums", "medians", "state")).alias("models"))

    def class_weights(s: Scaled) -> np.ndarray:
        seen = s.targets > 0.5
        return np.where(seen, c * s.n / (max(seen.sum(), 1) * np.where(seen, s.targets, 1)), 0)

    def partial(part):
        for k in range(len(part)):
            yield from of_block(part.iloc[k])

    def of_block(part):
        x = np.frombuffer(part["x"], float).reshape(part["n"], -1)
        fold_, hot = np.frombuffer(part["fold"], np.int32), np.frombuffer(part["hot"], float).reshape(part["n"], -1)
        gone = np.isnan(x)
        for m in part["models"]:
            if m["state"][-1]:
                continue
            s = _of(m["sums"], m["medians"], classes)
            use = fold_ != m["out"]
            if not use.any() or (s.targets > 0.5).sum() < 2:
                continue
            filled = np.where(gone[use], np.array(m["medians"], float), x[use])
            a = np.column_stack([np.ones(use.sum()), (filled - s.mean) / s.sd])
            weight = class_weights(s)
            w = Descent.at(m["state"]).reshape(p + 1, width)
            yield m["out"], loss_terms(a, hot[use], (hot[use] * weight).sum(axis=1) if binary else weight, w, binary)

    @F.pandas_udf("array<double>")
    def follow(state: pd.Series, sums: pd.Series) -> pd.Series:
        return pd.Series([s if z is None or s[-1] else Descent.follow(s, np.array(z, float), free, squared) for s, z in zip(state, sums)], dtype=object)

    packed_rows = blocks(f)
    state = scales.select("_g", "fold", F.array(*map(F.lit, Descent.start(size))).alias("state"))
    for _ in range(most_passes):
        rows = packed_rows.join(packed(state), "_g")
        sums = _summed(rows, partial, 1 + size + size * size).withColumnRenamed("sums", "terms")
        state = stored(state.join(sums, ["_g", "fold"], "left").select("_g", "fold", follow("state", "terms").alias("state"), F.col("terms").isNotNull().alias("moved")), "model-state")
        if state.where("moved and state[size(state) - 1] = 0").isEmpty():
            break
        state = state.drop("moved")

    @F.pandas_udf("array<double>")
    def final(state: pd.Series, sums: pd.Series, medians: pd.Series) -> pd.Series:
        """Weights on the shifted features themselves; those of classes that were not seen are null."""
        out = []
        for z, s, m in zip(state, sums, medians):
            scale = _of(s, m, classes)
            if (scale.targets > 0.5).sum() < 2 and (binary or scale.n < 0.5):
                out.append(None)
                continue
            w = np.array(z[:size], float).reshape(p + 1, width)
            w[1:] = w[1:] / scale.sd[:, None]
            w[0] -= scale.mean @ w[1:]
            w = w.T.ravel()
            if not binary:
                w = w.reshape(width, p + 1)
                w[scale.targets <= 0.5] = np.nan
                w = w.ravel()
            out.append(w.tolist())
        return pd.Series(out, dtype=object)

    done = scales.join(state.select("_g", "fold", "state"), ["_g", "fold"])
    return stored(done.select("_g", "fold", "medians", final("state", "sums", "medians").alias("w")), "model-weights")


def _logit(f: Features, first: int) -> Column:
    value = F.col("w")[first]
    for i, x in enumerate(f.columns):
        value = value + F.col("w")[first + i + 1] * F.coalesce(F.col(x), F.col("medians")[i])
    return value


def _out_of_fold_binary(df: DataFrame, group: str, key: str, y: str, columns: list[str], penalty: str) -> DataFrame:
    f = Features(df.where(F.col(y).isNotNull()), group, columns, [(F.col(y) == 0).cast("double"), (F.col(y) == 1).cast("double")], [key])
    met = f.rows.join(penalised(f, True, penalty=penalty), ["_g", "fold"], "left")
    out = met.withColumn("oof_proba_pos", 1 / (1 + F.exp(-_logit(f, 0))))
    return out.select(group, key, F.col("t1").alias("y_true"), (F.col("oof_proba_pos") >= 0.5).cast("double").alias("oof_pred"), "fold", "oof_proba_pos")


def out_of_fold_classes(df: DataFrame, group: str, key: str, label: str, columns: list[str], classes: list[str]) -> DataFrame:
    """(group, key, y_true, oof_pred, fold, oof_proba): as ``out_of_fold`` for any number of
    classes; the probabilities are in the sorted order of ``classes``, 0 for a class that
    the training folds lack, null without training rows."""
    names = sorted(classes)
    f = Features(df.where(F.col(label).isin(*names)), group, columns, [(F.col(label) == c).cast("double") for c in names], [key, label])
    met = f.rows.join(penalised(f, False), ["_g", "fold"], "left")
    logits = F.array(*(_logit(f, i * (len(columns) + 1)) for i in range(len(names))))
    # Classes that the training rows lack have no logit.
    e = F.transform("z", lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(F.exp(v - F.col("top"))))
    out = met.withColumn("z", F.when(F.col("w").isNotNull(), logits)).withColumn("top", F.array_max(F.filter("z", lambda v: ~F.isnan(v)))).withColumn("e", e)
    out = out.withColumn("total", F.aggregate("e", F.lit(0.0), lambda s, v: s + v)).withColumn("p", F.transform("e", lambda v: v / F.col("total")))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("p", F.array_max("p")).cast("int"))
    return out.select(group, key, F.col(label).alias("y_true"), F.when(F.col("p").isNotNull(), best).alias("oof_pred"), "fold", F.col("p").alias("oof_proba"))
