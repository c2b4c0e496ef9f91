"""Quality classifier: Bradley-Terry scores learnt from preference pairs, cut at a score quantile."""

from __future__ import annotations

import pickle
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, lean, remainder

#: Labelled rows that the driver holds, bytes of them that a task of a pass over all reads.
LABELLED, A_PASS = 20_000, 64 << 20
#: Width of a cell of scores, and nodes in it by which its documents act on others.
WIDTH, NODES = 2.0, 16
ANGLES = (2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)
#: The printable ASCII characters that are neither letters, digits nor white space.
MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])


def features(text: str | None) -> np.ndarray:
    """What a whole text shows of its form: no language, source or id. A null text is empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = text.split()
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    w, k = max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    upper, lower = seen[65:91].sum(), seen[97:123].sum()
    shape = [
        np.log1p(len(raw)), np.log1p(len(words)), upper, lower, seen[48:58].sum(), seen[128:].sum(), seen[MARKS].sum(),
        seen[32], seen[10], upper / (upper + lower + 1e-6), len(text) / w, len(counts) / w, np.log(len(counts) + 1) / np.log(w + 1),
        (counts.most_common(1)[0][1] if counts else 0) / w, len(set(lines)) / k, np.log1p(len(lines)), np.log1p(n / k), float(not words), max(0.0, 4 - np.log1p(w)),
    ]
    return np.concatenate([shape, np.log1p(300 * seen[MARKS]), np.minimum(1, 20 * seen[MARKS])])


def basis(u: np.ndarray) -> np.ndarray:
    """Values at u (-1 to 1) of the NODES polynomials that are 1 at one Chebyshev node and 0 at the others."""
    j = np.arange(NODES)
    return np.cos(np.outer(np.arccos(np.clip(u, -1, 1)), j)) @ (np.cos(np.outer(j, ANGLES)) * np.where(j, 2, 1)[:, None] / NODES)


def placed(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of scores and the values of the cells' polynomials there."""
    cell = np.floor(s / WIDTH).astype(np.int64)
    return cell, basis(2 * (s / WIDTH - cell) - 1)


def moments(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[int, np.ndarray]:
    """For each cell of scores, class and node: the sums of its polynomial and of it times z."""
    cell, at = placed(z @ w)
    out = {}
    for c in np.unique(cell).tolist():
        out[c] = np.zeros((2, NODES, 1 + z.shape[1]))
        for k in (0, 1):
            rows = np.flatnonzero((cell == c) & (y == k))
            out[c][k, :, 0], out[c][k, :, 1:] = at[rows].sum(0), at[rows].T @ z[rows]
    return out


def gram(z: np.ndarray, y: np.ndarray, w: np.ndarray, weights: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The sum of z z' over rows, each times what weights (a cell's classes and nodes) say at its score."""
    cell, at = placed(z @ w)
    v = np.empty(len(z))
    for c in np.unique(cell).tolist():
        rows = np.flatnonzero(cell == c)
        v[rows] = (at[rows] * weights[c][y[rows]]).sum(1)
    return {0: (z * v[:, None]).T @ z}


def added(parts) -> dict[int, np.ndarray]:
    """The sums of arrays under one key."""
    out: dict[int, np.ndarray] = {}
    for part in parts:
        for k, v in part.items():
            out[k] = out[k] + v if k in out else v
    return out


def some_pairs(d: np.ndarray, ridge: float):
    """(value, curvature) of the mean logistic loss over pairs whose features differ by d, for newton()."""

    def value(w):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        return np.logaddexp(0, -(d @ w)).mean() + ridge / 2 * w @ w, -(d.T @ p) / len(d) + ridge * w, p

    return value, lambda w, p: (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))


def every_pair(total, ridge: float):
    """(value, curvature) of the mean logistic loss over all pairs of a good and a bad document, for newton().

    total(f, *arguments) gives f(z, y, *arguments) summed over all rows. The loss of two scores is
    smooth in both, so a row acts on the other class through the polynomials of its cell of scores:
    nodes meet nodes, and the work is in proportion to the rows, not the pairs. What interpolation
    misses is about 1e-13.
    """

    def value(w):
        sums = total(moments, w)
        cells = sorted(sums)
        x = np.concatenate([WIDTH * (c + (1 + np.cos(ANGLES)) / 2) for c in cells])
        bad, good = (np.concatenate([sums[c][k] for c in cells]) for k in (0, 1))
        pairs = good[:, 0].sum() * bad[:, 0].sum()
        loss, grad, cross = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
        weights = np.zeros((2, len(x)))
        for i in range(0, len(x), NODES):
            here = slice(i, i + NODES)
            t = x[here, None] - x
            e = np.exp(-np.abs(t))
            p, q = np.where(t > 0, e, 1) / (1 + e), e / (1 + e) ** 2
            loss += good[here, 0] @ (np.logaddexp(0, -t) @ bad[:, 0])
            grad += (good[here, 0] @ p) @ bad[:, 1:] - (p @ bad[:, 0]) @ good[here, 1:]
            cross += good[here, 1:].T @ (q @ bad[:, 1:])
            weights[0] += good[here, 0] @ q
            weights[1, here] = q @ bad[:, 0]
        weights = {c: weights[:, i * NODES : (i + 1) * NODES] for i, c in enumerate(cells)}
        return loss / pairs + ridge / 2 * w @ w, grad / pairs + ridge * w, (pairs, cross, weights)

    def curvature(w, state):
        pairs, cross, weights = state
        return (total(gram, w, weights)[0] - cross - cross.T) / pairs + ridge * np.eye(len(w))

    return value, curvature


def newton(w: np.ndarray, value, curvature, ridge: float) -> np.ndarray:
    """Where a strictly convex loss with ridge / 2 w'w in it is least.

    value(w): loss, gradient and what curvature(w, that) needs. A step to where the ridge alone
    exceeds the loss is shortened without a look at the data.
    """
    at, grad, state = value(w)
    for _ in range(40):
        step = np.linalg.solve(curvature(w, state), grad)
        if np.abs(step).max() < 1e-7:  # what is left is that squared
            return w - step
        t = 1.0
        while t > 1e-6:
            near = w - t * step
            if ridge / 2 * near @ near <= at:
                now = value(near)
                if now[0] <= at + 1e-12:
                    break
            t /= 2
        else:
            return w
        w, (at, grad, state) = near, now
    return w


class BradleyTerry:
    """score(d) = w . x(d), from P(a is preferred to b) = sigmoid(score(a) - score(b)).

    Learnt from every pair of a good and a bad document; a number of pairs draws so many.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, *, cut: float = 0.3, pairs: int | None = None, ridge: float = 1e-3, seed: int = 7):
        self.cut, self.w = cut, None
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self.standard(x)
        if pairs is None:
            loss = every_pair(lambda f, *more: added(f(z[i : i + 4096], y[i : i + 4096], *more) for i in range(0, len(z), 4096)), ridge)
        else:
            rng = np.random.default_rng(seed)
            # every document of either class takes part equally often, give or take one
            a = np.concatenate([rng.permutation(good) for _ in range(-(-pairs // len(good)))])[:pairs]
            b = np.concatenate([rng.permutation(bad) for _ in range(-(-pairs // len(bad)))])[:pairs]
            loss = some_pairs(z[a] - z[b], ridge)
        self.w = newton(np.zeros(x.shape[1]), *loss, ridge)
        s = np.sort(z @ self.w)
        k = len(bad)  # as many documents fall below the cut as are labelled bad
        self.threshold = (s[k - 1] + s[min(k, len(s) - 1)]) / 2

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; `cut` at the quantile of the training scores that the share of bad labels gives."""
        if self.w is None:
            return np.full(len(x), 0.5)
        z = self.standard(x) @ self.w
        return 1 / (1 + np.exp(-np.clip(z - self.threshold + np.log(self.cut / (1 - self.cut)), -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, labelled: int = LABELLED, cut: float = 0.3) -> BradleyTerry:
    """Learn from every labelled document outside the held-out fold.

    The driver holds about `labelled` of them. Where there are more, what those give is only where
    the fit of all begins, which sums over the rows where they lie: the loss has one minimum,
    wherever a fit begins. Contradicting labels of one id count as its smallest, of several texts of
    one id the one with the least hash.
    """
    bounded(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("i"), "quality")
    known = known.where(remainder(F.col("i"), folds) != held).groupBy("i").agg(F.min("quality").cast("int").alias("y"))

    def measure(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                b = batch.slice(i, 2048)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([features(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["i", "h", "x"])

    # features are a tenth of their texts as they are shuffled, so all are measured before labels are met
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"), F.xxhash64("text").alias("h")).where("i is not null").where(remainder(F.col("i"), folds) != held)
    # of several texts of one id the one with the least hash counts, so that reruns agree
    least = F.min(F.struct("h", "x")).alias("m")
    rows = rows.mapInArrow(lean(measure), "i long, h long, x binary").groupBy("i").agg(least).join(known, "i").select("i", "y", "m.x")
    rows = scratch.table(rows, "rows", pack=None)
    parts = -(-rows.count() // labelled)
    if not parts:
        return BradleyTerry(np.zeros((0, 1)), np.zeros(0), cut=cut)
    got = rows.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == 0).toPandas().sort_values("i")
    first = BradleyTerry(unpacked(got["x"]), got["y"].to_numpy(), cut=cut)
    if parts == 1:
        return first
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-scratch.sizes["rows"] // A_PASS))
    return of_all(rows.select("y", "x").coalesce(tasks), first)


def unpacked(blobs) -> np.ndarray:
    """A row of features for each of their bytes."""
    return np.frombuffer(b"".join(blobs)).reshape(len(blobs), -1) if len(blobs) else np.zeros((0, 1))


def passed(rows: DataFrame, f, *more) -> list[dict[int, np.ndarray]]:
    """f(x, y, *more) summed over the rows of each task; A_PASS bounds their number."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                part = f(unpacked(batch.column(1).to_pylist()), batch.column(0).to_numpy(), *more)
                total = merged(total, part) if total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["b"])

    merged = spread_of if f is spread else lambda a, b: added((a, b))
    return [pickle.loads(r.b) for r in rows.mapInArrow(lean(run), "b binary").collect()]


def spread(x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
    """Numbers of bad and good rows (0), the mean (1) and the squares about it (2)."""
    mean = x.mean(0)
    return {0: np.bincount(y, minlength=2), 1: mean, 2: ((x - mean) ** 2).sum(0)}


def spread_of(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """spread() of the rows of both."""
    n, m, off = a[0].sum(), b[0].sum(), b[1] - a[1]
    return {0: a[0] + b[0], 1: a[1] + off * (m / (n + m)), 2: a[2] + b[2] + off**2 * (n * m / (n + m))}


def of_all(rows: DataFrame, first: BradleyTerry, ridge: float = 1e-3) -> BradleyTerry:
    """The model of all rows (y, x), begun at the model of some."""
    whole = reduce(spread_of, passed(rows, spread))
    bt = BradleyTerry(np.zeros((0, 1)), np.zeros(0), cut=first.cut)
    bad, good = whole[0].tolist()
    if not bad or not good:
        return bt
    bt.mean, bt.scale = whole[1], np.sqrt(whole[2] / (bad + good)) + 1e-9
    start = np.zeros(len(bt.mean)) if first.w is None else first.w * bt.scale / first.scale
    standard = bt.standard

    def total(f, *more):
        return added(passed(rows, lambda x, y: f(standard(x), y, *more)))

    if ridge / 2 * start @ start > 1:  # the loss at 0 is less
        start = np.zeros(len(start))
    bt.w = newton(start, *every_pair(total, ridge), ridge)
    bt.threshold = between(rows, bt, bad)
    return bt


def between(rows: DataFrame, bt: BradleyTerry, k: int) -> float:
    """The middle between the k-th and the next of the rows' scores, from the least."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(bt.standard(unpacked(batch.column(0).to_pylist())) @ bt.w)], ["s"])

    s = Scratch(rows.sparkSession, "scores").table(rows.select("x").mapInArrow(lean(run), "s double"), "s")
    n, error = s.count(), 1e-4
    low, high = s.approxQuantile("s", [max(0.0, k / n - 3 * error), min(1.0, (k + 1) / n + 3 * error)], error)  # ranks are off by n * error at most
    below = s.where(F.col("s") < low).count()
    near = s.where(F.col("s").between(low, high)).groupBy("s").count().toPandas().sort_values("s")
    ranks = below + near["count"].cumsum().to_numpy()
    values = near["s"].to_numpy()
    pick = lambda i: values[np.searchsorted(ranks, i)]
    return float(pick(k) + pick(min(k + 1, n))) / 2


def quality_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, labelled: int = LABELLED, cut: float = 0.3) -> DataFrame:
    """The columns of docs plus score (0 to 1) and predicted (1 if score >= cut, else 0).

    Every whole text is scored from its form alone. Null and empty texts are scored as empty;
    repeated rows score alike; without labels of both kinds each score is 0.5. Columns named
    score or predicted are replaced. No shuffle of the documents.
    """
    bt = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds=folds, held=held, labelled=labelled, cut=cut))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(bt.value.scores(np.array([features(t) for t in texts])))

    return docs.drop("predicted").withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
