"""Many class-balanced logistic regressions over one table, fitted together.

Every model has its own training rows (all folds but those it leaves out), and with them its own scaling, class weights
and kept columns. The rows are packed into blocks of the columns that any model keeps; each pass over the blocks adds up
what all models of a batch need. Narrow models take Newton steps, which are solved for where a model's sums meet, so that
the driver only holds steps; wide ones are fitted from gradients alone (L-BFGS), so what a model holds grows with its kept columns and not with their square. Batches are as large as the
driver's bounded state allows, whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.session import materialize

MERGE_TASKS = 8
#: Numbers that the models of a batch hold on the driver together.
MAX_STATE = 20_000_000
#: Kept columns up to which a model's curvature is summed, the part of the state that the sums of a task may fill, and the
#: models whose sums a task sends on at a time.
NEWTON_WIDTH, NEWTON_SHARE, SENT = 64, 0.1, 32
BLOCK_BYTES = 8 << 20
#: Earlier steps that L-BFGS remembers.
MEMORY = 10
BLOCK = "n int, x binary, y binary, fold binary"


def add_rows(parts: DataFrame, few: bool = False) -> np.ndarray:
    """Sum of equally long ``sums`` arrays, merged by a few tasks before the driver sees them unless they are few anyway."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for f in frames:
            for v in f["sums"]:
                acc = np.array(v, dtype=float) if acc is None else acc + np.asarray(v)
        if acc is not None:
            yield pd.DataFrame({"sums": [acc]})

    rows = (parts if few else parts.repartition(MERGE_TASKS).mapInPandas(add, "sums array<double>")).toPandas()
    return np.sum([np.asarray(v, dtype=float) for v in rows["sums"]], axis=0)


@dataclass(frozen=True)
class Spec:
    """One model: which label, which folds stay out of training, which it scores, and the penalty C."""

    name: str
    label: int
    exclude: tuple[str, ...]
    score: tuple[str, ...]
    c: float = 1.0


@dataclass
class Fitted:
    """A model over its kept ``columns``; the last coefficient is the intercept."""

    spec: Spec
    columns: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    weights: tuple[float, float] = field(default=(1.0, 1.0), repr=False)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, self.columns] - self.mean) / self.scale
        return sigmoid(z @ self.coef[:-1] + self.coef[-1])


def sigmoid(u: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(u, -500, 500)))


def arrays(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.stack([np.asarray(v, dtype=float) for v in f[c]]) for c in ("features", "labels"))


@dataclass
class Moments:
    """Per fold: row count, and by column the sum and the squares of what lies above ``shift``; positives of every label."""

    folds: list[str]
    shift: np.ndarray
    count: np.ndarray
    total: np.ndarray
    square: np.ndarray
    positives: np.ndarray

    def training(self, exclude: Sequence[str]) -> np.ndarray:
        """Numbers of the folds that a model learns from; the last one holds the rows without a fold."""
        return np.array([i for i, f in enumerate([*self.folds, None]) if f not in exclude], int)

    def both_classes(self, label: int, folds: np.ndarray) -> bool:
        return 0 < self.positives[folds, label].sum() < self.count[folds].sum()


def fold_numbers(fold: pd.Series, folds: Sequence[str]) -> np.ndarray:
    codes = pd.Categorical(fold, categories=list(folds)).codes.astype(np.int32)
    return np.where(codes < 0, len(folds), codes).astype(np.int32)


def moments_by_fold(rows: DataFrame) -> Moments:
    """One pass in which each task adds up whole rows."""
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect() if r["fold"] is not None)
    first = rows.select("features", "labels").first()
    if first is None:
        return Moments(folds, np.empty(0), np.zeros(1), np.zeros((1, 0)), np.zeros((1, 0)), np.zeros((1, 1)))
    shift, d, m = np.asarray(first["features"], float), len(first["features"]), len(first["labels"])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((len(folds) + 1, 1 + 2 * d + m))
        for f in frames:
            if len(f):
                x, y = arrays(f)
                x -= shift
                number = fold_numbers(f["fold"], folds)
                for i in np.unique(number):
                    some = x[number == i]
                    acc[i] += np.concatenate([[len(some)], some.sum(0), (some**2).sum(0), y[number == i].sum(0)])
        yield pd.DataFrame({"sums": [acc.ravel()]})

    acc = add_rows(rows.select("features", "labels", "fold").mapInPandas(add, "sums array<double>")).reshape(len(folds) + 1, -1)
    return Moments(folds, shift, acc[:, 0], acc[:, 1 : d + 1], acc[:, d + 1 : 2 * d + 1], acc[:, 2 * d + 1 :])


def prepared(moments: Moments, specs: Sequence[Spec], top_variance: int | None) -> list[Fitted]:
    """Models at zero, with the scaling, kept columns and class weights of their own training rows."""
    made: dict[tuple[str, ...], tuple] = {}
    out = []
    for s in specs:
        train = moments.training(s.exclude)
        if s.exclude not in made:
            n = max(moments.count[train].sum(), 1.0)
            above = moments.total[train].sum(0) / n
            spread = np.sqrt(np.maximum(moments.square[train].sum(0) / n - above**2, 0.0))
            columns = np.arange(len(spread))
            if top_variance is not None and top_variance < len(spread):
                columns = np.sort(np.lexsort((columns, -spread))[:top_variance])
            made[s.exclude] = n, columns, (moments.shift + above)[columns], np.where(spread > 1e-12, spread, 1.0)[columns]
        n, columns, mean, scale = made[s.exclude]
        pos = moments.positives[train, s.label].sum()
        weights = n / (2.0 * max(n - pos, 1.0)), n / (2.0 * max(pos, 1.0))
        out.append(Fitted(s, columns, mean, scale, np.zeros(len(columns) + 1), weights))
    return out


def packed(rows: DataFrame, columns: np.ndarray, folds: Sequence[str]) -> tuple[DataFrame, bool]:
    """Rows as blocks of doubles of the given columns, of bounded size; and whether they are so few that their sums need no merging."""
    step = max(1, BLOCK_BYTES // (8 * max(len(columns), 1)))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), step):
                some = f.iloc[i : i + step]
                x, y = arrays(some)
                fold = fold_numbers(some["fold"], folds)
                yield pd.DataFrame({"n": [len(some)], "x": [np.ascontiguousarray(x[:, columns]).tobytes()], "y": [y.tobytes()], "fold": [fold.tobytes()]})

    blocks = materialize(rows.mapInPandas(pack, BLOCK), "blocks")
    few = blocks.agg(F.sum("n")).first()[0] or 0
    return (blocks.coalesce(MERGE_TASKS), True) if few <= step * MERGE_TASKS else (blocks, False)


Sums = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def over_blocks(blocks: tuple[DataFrame, bool], width: int, sums: Sums) -> np.ndarray:
    """``sums(x, y, fold)`` added up over all blocks, one row a task."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for f in frames:
            for n, x, y, fold in zip(f["n"], f["x"], f["y"], f["fold"], strict=True):
                part = sums(np.frombuffer(x).reshape(n, width), np.frombuffer(y).reshape(n, -1), np.frombuffer(fold, np.int32))
                acc = part if acc is None else acc + part
        if acc is not None:
            yield pd.DataFrame({"sums": [acc]})

    rows, few = blocks
    return add_rows(rows.mapInPandas(add, "sums array<double>"), few)


class Batch:
    """Models that are fitted in the same passes: what the tasks need of them, and how the sums of a pass are read."""

    def __init__(self, models: Sequence[Fitted], moments: Moments, columns: np.ndarray):
        self.models = list(models)
        self.width = len(columns)
        found: dict[int, np.ndarray] = {}
        self.at = [found.setdefault(id(g.columns), np.searchsorted(columns, g.columns)) for g in models]
        self.use = np.zeros((len(moments.folds) + 1, len(models)))
        for j, g in enumerate(models):
            self.use[moments.training(g.spec.exclude), j] = 1.0
        self.labels = np.array([g.spec.label for g in models])
        self.losses = np.array([g.weights for g in models]) * np.array([[g.spec.c] for g in models])

    def of(self, numbers: Sequence[int]) -> Batch:
        """Some of the models."""
        out = object.__new__(Batch)
        out.models, out.width, out.at = [self.models[j] for j in numbers], self.width, [self.at[j] for j in numbers]
        out.use, out.labels, out.losses = self.use[:, numbers], self.labels[numbers], self.losses[numbers]
        return out

    def gradients(self, blocks: tuple[DataFrame, bool], coefs: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Objective and gradient of every model at its coefficients."""
        models, at, use, labels, losses, width = self.models, self.at, self.use, self.labels, self.losses, self.width
        dense, free = np.zeros((width, len(models))), np.zeros(len(models))
        for j, (g, w) in enumerate(zip(models, coefs, strict=True)):
            dense[at[j], j] = w[:-1] / g.scale
            free[j] = w[-1] - (w[:-1] * g.mean / g.scale).sum()
        # models that learn from the same rows keep the same columns
        kept = {id(a): a for a in at}
        owners = [(a, np.array([j for j in range(len(models)) if at[j] is a])) for a in kept.values()]

        def sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
            u = x @ dense + free
            t = y[:, labels]
            weight = np.where(t > 0.5, losses[:, 1], losses[:, 0]) * use[fold]
            loss = (weight * (np.logaddexp(0, u) - t * u)).sum(0)
            residual = weight * (sigmoid(u) - t)
            slopes = [(x[:, a].T @ residual[:, own]).T.ravel() for a, own in owners]
            return np.concatenate([loss, residual.sum(0), *slopes])

        flat = over_blocks(blocks, width, sums)
        loss, level, rest = flat[: len(models)], flat[len(models) : 2 * len(models)], flat[2 * len(models) :]
        out: list = [None] * len(models)
        place = 0
        for a, own in owners:
            for j, slope in zip(own, rest[place : place + len(a) * len(own)].reshape(len(own), len(a)), strict=True):
                g, w = models[j], coefs[j]
                inner = (slope - g.mean * level[j]) / g.scale + w[:-1]
                out[j] = loss[j] + 0.5 * (w[:-1] ** 2).sum(), np.append(inner, level[j])
            place += len(a) * len(own)
        return out

    def steps(self, blocks: tuple[DataFrame, bool]) -> list[tuple[float, np.ndarray]]:
        """Objective and Newton step of every model.

        The tasks' sums meet by model and the step is solved for there, so the driver sees a step and no curvature.
        """
        models, at, use, labels, losses, width = self.models, self.at, self.use, self.labels, self.losses, self.width
        coefs = [g.coef for g in models]

        def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}
            for f in frames:
                for n, xs, ys, folds in zip(f["n"], f["x"], f["y"], f["fold"], strict=True):
                    x, y, fold = np.frombuffer(xs).reshape(n, width), np.frombuffer(ys).reshape(n, -1), np.frombuffer(folds, np.int32)
                    for j, g in enumerate(models):
                        some = use[fold, j] > 0
                        if not some.any():
                            continue
                        z = np.column_stack([(x[some][:, at[j]] - g.mean) / g.scale, np.ones(some.sum())])
                        t = y[some, labels[j]]
                        w, u = np.where(t > 0.5, losses[j, 1], losses[j, 0]), z @ coefs[j]
                        p = sigmoid(u)
                        h = (z * (w * p * (1 - p))[:, None]).T @ z
                        part = np.concatenate([[(w * (np.logaddexp(0, u) - t * u)).sum()], z.T @ (w * (p - t)), h.ravel()])
                        held[j] = held[j] + part if j in held else part
            numbers = list(held)  # none in a task that has no rows to learn from, which sends nothing
            for i in range(0, len(numbers), SENT):
                some = numbers[i : i + SENT]
                yield pd.DataFrame({"j": np.array(some, np.int32), "sums": [held[j] for j in some]})

        def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            w = coefs[key[0]]
            s, k = np.sum(np.stack(frame["sums"]), axis=0), len(w)
            ridge = np.append(np.ones(k - 1), 0.0)
            step = np.linalg.solve(s[k + 1 :].reshape(k, k) + np.diag(ridge + 1e-10), s[1 : k + 1] + ridge * w)
            return pd.DataFrame({"j": [key[0]], "loss": [s[0] + 0.5 * (ridge * w**2).sum()], "step": [step]})

        parts = blocks[0].mapInPandas(add, "j int, sums array<double>")
        found = {r["j"]: (r["loss"], np.asarray(r["step"])) for r in parts.groupBy("j").applyInPandas(solve, "j int, loss double, step array<double>").collect()}
        # a model without training rows has nothing but its penalty
        return [found.get(j) or (0.5 * (w[:-1] ** 2).sum(), np.append(w[:-1], 0.0)) for j, w in enumerate(coefs)]


def newton(batch: Batch, blocks: tuple[DataFrame, bool], steps: int, tolerance: float) -> None:
    """Newton's method for all models at once; those that have arrived leave the passes."""
    last: list[tuple[float, np.ndarray, np.ndarray] | None] = [None] * len(batch.models)  # objective, coefficients, step
    open_ = list(range(len(batch.models)))
    for _ in range(steps):
        for i, (loss, step) in zip(open_, batch.of(open_).steps(blocks), strict=True):
            g, before = batch.models[i], last[i]
            if before is not None and loss > before[0] + 1e-9 * (1 + abs(before[0])):
                last[i] = (before[0], before[1], before[2] / 2)  # the step was too long: go half as far
                g.coef = before[1] - last[i][2]
            else:
                last[i] = (loss, g.coef.copy(), step)
                g.coef = g.coef - last[i][2]
        open_ = [i for i in open_ if np.abs(last[i][2]).max() >= tolerance]
        if not open_:
            break


class Descent:
    """One model's way down: its last accepted point, its memory of steps, and the point that is tried next."""

    def __init__(self, start: np.ndarray):
        self.trial, self.point = start, None
        self.loss, self.grad = np.inf, None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.direction, self.length = None, 1.0
        self.done = False

    def told(self, loss: float, grad: np.ndarray, tolerance: float) -> None:
        """Take the objective and gradient at the point that was tried."""
        if self.point is not None:
            fall = self.length * float(self.grad @ self.direction)
            if loss > self.loss + 1e-4 * fall + 1e-13 * abs(self.loss):
                # the parabola through both ends tells how far to go back
                bend = loss - self.loss - fall
                self.length *= min(max(-fall / (2.0 * bend), 0.1), 0.5) if np.isfinite(bend) and bend > 0 else 0.1
                self.done = self.length < 1e-12
                self.trial = self.point + self.length * self.direction
                return
            s, y = self.trial - self.point, grad - self.grad
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs[-MEMORY + 1 :], (s, y)]
        self.point, self.loss, self.grad = self.trial, loss, grad
        self.done = bool(np.abs(grad).max() <= tolerance * max(1.0, np.abs(self.point).max()))
        q, alphas = grad.copy(), []
        for s, y in reversed(self.pairs):
            alphas.append((s @ q) / (y @ s))
            q -= alphas[-1] * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), alpha in zip(self.pairs, reversed(alphas), strict=True):
            q += (alpha - (y @ q) / (y @ s)) * s
        self.direction, self.length = -q, 1.0 if self.pairs else min(1.0, 1.0 / max(np.linalg.norm(grad), 1e-300))
        self.trial = self.point + self.length * self.direction


def descend(batch: Batch, blocks: tuple[DataFrame, bool], steps: int, tolerance: float) -> None:
    """L-BFGS for all models at once; those that have arrived leave the passes."""
    ways = [Descent(g.coef) for g in batch.models]
    for _ in range(steps):
        open_ = [j for j, w in enumerate(ways) if not w.done]
        if not open_:
            break
        for j, (loss, grad) in zip(open_, batch.of(open_).gradients(blocks, [ways[j].trial for j in open_]), strict=True):
            ways[j].told(loss, grad, tolerance)
    for g, w in zip(batch.models, ways, strict=True):
        g.coef = w.point


def fit_many(
    rows: DataFrame, specs: Sequence[Spec], top_variance: int | None = None, steps: int = 500, tolerance: float = 1e-6, moments: Moments | None = None,
) -> list[Fitted]:
    """Class-balanced L2 logistic regressions, all fitted over the same passes.

    ``rows`` holds ``features`` and ``labels`` (double arrays) and ``fold``. The objective is
    0.5 |w|^2 + C * weighted log loss with a free intercept. ``top_variance`` keeps the columns of largest variance among a
    model's own training rows. Models and columns may be any number: what doesn't fit one batch is fitted in the next.
    """
    rows = rows.select("features", "labels", "fold")
    moments = moments or moments_by_fold(rows)
    fitted = prepared(moments, specs, top_variance)
    if not fitted or not len(moments.shift):
        return fitted
    columns = np.unique(np.concatenate([g.columns for g in fitted]))
    blocks = packed(rows, columns, moments.folds)
    narrow = len(fitted[0].columns) <= NEWTON_WIDTH
    state = (len(fitted[0].coef) + 1) ** 2 if narrow else len(columns) + (2 * MEMORY + 6) * len(fitted[0].coef)
    size = max(1, int(MAX_STATE * (NEWTON_SHARE if narrow else 1)) // state)
    for i in range(0, len(fitted), size):
        batch = Batch(fitted[i : i + size], moments, columns)
        if narrow:
            newton(batch, blocks, min(steps, 50), tolerance * 1e-2)
        else:
            descend(batch, blocks, steps, tolerance)
    return fitted
