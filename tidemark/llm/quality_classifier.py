"""Quality classifier: a sparse ensemble of rules.

Rules are paths of small trees. Gradient boosting over random parts of the labelled texts grows trees of at most ``DEPTH``
levels over statistics of the text (stats.py); each path from a root is a conjunction such as ``symbol_share > 0.05 and
log_words <= 4``. A logistic regression under an L1 penalty over all rules and some linear terms gives most of them weight
zero. What is left is compiled into one Spark column expression, so scoring is a projection inside the scan's stage.

Fitting works on a bounded sample: ``SAMPLE`` labelled texts at most, those with the smallest hash of their id. Labels of
held-out texts (crc32 of the id modulo 5 is 0) are never read, and the id, language and source are never statistics. Scoring
covers all texts, whole.

Cases: null texts count as empty, which have a score like any other; null labels, labels other than 0 and 1 and labels whose
document is missing are left out; repeated labels of an id count once (the larger); with no or one class of labels the score
is the smoothed share of label 1; a very long text is scored whole, in time linear in its words; rows that repeat are scored each;
other columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import remainder, table
from tidemark.llm.stats import SHAPE, with_shape

FOLDS = 5
SAMPLE = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, LEAST = 40, 3, 32, 20


@dataclass(frozen=True)
class Rule:
    """All of (statistic, '<=' or '>', bound) hold."""

    parts: tuple[tuple[str, str, float], ...]
    weight: float = 0.0


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    linear: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # statistic -> weight, low, high (clipped there)

    def score(self, prefix: str = "__s_") -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(self.bias)
        for r in self.rules:
            holds = F.lit(True)
            for name, sign, bound in r.parts:
                value = F.col(prefix + name)
                holds = holds & (value <= bound if sign == "<=" else value > bound)
            total = total + F.when(holds, r.weight).otherwise(0.0)
        for name, (weight, low, high) in self.linear.items():
            total = total + F.least(F.greatest(F.col(prefix + name), F.lit(low)), F.lit(high)) * weight
        return 1 / (1 + F.exp(-total))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> RuleModel:
        d = json.loads(text)
        rules = [Rule(tuple((n, s, b) for n, s, b in r["parts"]), r["weight"]) for r in d["rules"]]
        return RuleModel(d["bias"], rules, {k: tuple(v) for k, v in d["linear"].items()})


def _grow(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list[tuple]) -> list[tuple[np.ndarray, float]]:
    """Leaves (rows, value) of one tree; ``out`` gets each path as ((statistic, '<=' or '>', bin), ...)."""
    if path:
        out.append(path)
    g, h = grad[rows].sum(), hess[rows].sum()
    best, choice = 1e-6, None
    if depth and len(rows) >= 2 * LEAST:
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            gs, hs, ns = (np.bincount(b, x, BINS + 1).cumsum()[:-1] for x in (grad[rows], hess[rows], None))
            ok = (ns >= LEAST) & (len(rows) - ns >= LEAST)
            if ok.any():
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[~ok] = -1
                k = int(gain.argmax())
                if gain[k] > best:
                    best, choice = gain[k], (f, k)
    if choice is None:
        return [(rows, g / (h + 1))]
    f, k = choice
    left = binned[rows, f] <= k
    return _grow(binned, grad, hess, rows[left], depth - 1, (*path, (f, "<=", k)), out) + _grow(binned, grad, hess, rows[~left], depth - 1, (*path, (f, ">", k)), out)


def _simple(path: tuple) -> tuple:
    """The path with one condition at most for each statistic and side."""
    tight: dict = {}
    for f, sign, k in path:
        old = tight.get((f, sign))
        tight[f, sign] = k if old is None else (min if sign == "<=" else max)(old, k)
    return tuple(sorted((f, sign, k) for (f, sign), k in tight.items()))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, the bias free, by accelerated proximal gradient steps."""
    n, m = x.shape
    rate = y.mean()
    bias, w = float(np.log(rate / (1 - rate))), np.zeros(m)
    z, zb, t = w.copy(), bias, 1.0
    v = np.ones(m) / np.sqrt(m)
    for _ in range(20):  # largest eigenvalue, for the step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4 * n / (float(np.linalg.norm(x @ v) ** 2) + n)
    for _ in range(steps):
        d = 1 / (1 + np.exp(-np.clip(x @ z + zb, -30, 30))) - y
        new = z - step * (x.T @ d) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b, new_t = zb - step * d.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - bias)
        w, bias, t = new, new_b, new_t
    return bias, w


def fit_rules(values: np.ndarray, y: np.ndarray, names: tuple[str, ...] = SHAPE, seed: int = 11, penalty: float = 0.002) -> RuleModel:
    """Rules and weights from an array of statistics (rows, names) and labels 0 or 1."""
    n = len(y)
    if n < 2 * LEAST or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2)
        return RuleModel(float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    bounds = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(values.shape[1])]
    binned = np.stack([np.searchsorted(b, values[:, f], side="left") for f, b in enumerate(bounds)], axis=1)  # bin <= k: value <= bounds[k]
    margin, paths = np.full(n, np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.choice(n, max(2 * LEAST, n // 2), replace=False))
        found: list[tuple] = []
        _grow(binned, y - p, p * (1 - p), rows, int(rng.integers(1, DEPTH + 1)), (), found)
        paths += found
        for leaf, value in _grow(binned, y - p, p * (1 - p), np.arange(n), DEPTH, (), []):
            margin[leaf] += 0.1 * value
    conj = sorted({_simple(p) for p in paths})
    conj = [c for c in conj if all(k < len(bounds[f]) for f, _, k in c)]
    columns, kept, seen = [], [], set()
    for c in conj:
        hit = np.ones(n, bool)
        for f, sign, k in c:
            hit &= (binned[:, f] <= k) if sign == "<=" else (binned[:, f] > k)
        if hit.any() and not hit.all() and (key := hit.tobytes()) not in seen:
            seen.add(key)
            columns.append(hit.astype(float))
            kept.append(c)
    low, high = np.quantile(values, 0.025, axis=0), np.quantile(values, 0.975, axis=0)
    lines = [f for f in range(values.shape[1]) if high[f] > low[f]]
    x = np.stack(columns + [np.clip(values[:, f], low[f], high[f]) for f in lines], axis=1)
    spread = x.std(axis=0)
    spread[len(columns) :] /= 0.4  # linear terms on the scale of a typical rule
    spread[spread == 0] = 1
    middle = x.mean(axis=0)
    bias, w = _lasso((x - middle) / spread, y.astype(float), penalty)
    w = w / spread
    bias -= float(middle @ w)
    rules = [Rule(tuple((names[f], sign, float(bounds[f][k])) for f, sign, k in c), float(w[i])) for i, c in enumerate(kept) if w[i]]
    linear = {names[f]: (float(w[len(kept) + i]), float(low[f]), float(high[f])) for i, f in enumerate(lines) if w[len(kept) + i]}
    return RuleModel(bias, rules, linear)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> RuleModel:
    """A model from labelled rows outside of the held-out fold."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    known = known.where(remainder("__id", FOLDS) != 0).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(known), "__id")
    data = with_shape(rows, "__t").select("__id", "__y", *[f"__s_{s}" for s in SHAPE]).toPandas()
    data = data.sort_values(list(data.columns), kind="stable")
    return fit_rules(data[[f"__s_{s}" for s in SHAPE]].to_numpy(float), data["__y"].to_numpy(int))


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with ``score`` (probability of label 1) and ``predicted`` (1 from THRESHOLD on), or by other names; columns of docs
    that bear these names are replaced."""
    out = with_shape(docs, text_col)
    out = out.withColumn(names[0], model.score()).drop(*[f"__s_{s}" for s in SHAPE])
    return out.withColumn(names[1], (F.col(names[0]) >= THRESHOLD).cast("int"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
#: A fitted model is not for SQL: tests/llm measures held-out accuracy and compares compiled scores with numpy.
ORACLES: dict[str, str] = {}
