r"""Quality classifier: a sparse ensemble of rules, compiled into Spark columns.

1. Statistics of whole texts, as column expressions: lengths, shares of capitals, digits, symbols and bars, and words
   that repeat the word before them.
2. On the driver, over a bounded sample of labelled rows: boosted shallow trees; each path from a root to a node is a
   conjunction of comparisons, a rule.
3. A logistic model over the rules with a lasso penalty (accelerated proximal gradient) keeps few of them.
4. The kept rules and weights become one column expression. Scoring is a scan without a shuffle and without Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled rows to learn from, the first by a hash of their id.
MAX_LABELLED = 20_000
TREES, DEPTH, BINS, SHRINK, LEAST = 30, 3, 32, 0.3, 8
PENALTY, PASSES = 0.002, 600

Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """The statistics by name; of an empty text all are 0."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    chars, words = F.length(text).cast("double"), count(r"\S+")
    return {"chars": chars, "words": words, "capitals": count("[A-Z]"), "digits": count("[0-9]"), "symbols": count(r"[#$%&*@^~<>{}\[\]=+_\\]"), "bangs": count("!"), "bars": count(r"\|"), "repeats": count(r"(?<!\S)(\S++)\s++(?=\1(?!\S))"), "lines": count("\n")}


def features(s: dict[str, Column]) -> dict[str, Column]:
    per = lambda a, b: F.when(s[b] > 0, s[a] / s[b]).otherwise(F.lit(0.0))
    return {"words": s["words"], "word_length": per("chars", "words"), "capitals": per("capitals", "chars"), "digits": per("digits", "chars"), "symbols": per("symbols", "words"), "bangs": per("bangs", "words"), "bars": per("bars", "words"), "repeats": per("repeats", "words"), "lines": per("lines", "words")}


FEATURES = ["words", "word_length", "capitals", "digits", "symbols", "bangs", "bars", "repeats", "lines"]


def with_features(docs: DataFrame, text_col: str = "text", name: str = "__gs_f") -> DataFrame:
    """``docs`` with a struct of the features."""
    stats = statistics(F.coalesce(F.col(text_col), F.lit("")))
    held = docs.withColumn("__gs_s", F.struct(*[c.alias(k) for k, c in stats.items()]))
    own = features({k: F.col("__gs_s")[k] for k in stats})
    return held.withColumn(name, F.struct(*[own[k].alias(k) for k in FEATURES])).drop("__gs_s")


def grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, depth: int, rules: list[Rule], out: np.ndarray) -> None:
    """One regression tree by Newton gain; adds its paths to ``rules`` and its steps to ``out``."""
    g, h = slope[rows].sum(), curve[rows].sum()
    best = (1e-6, 0, 0.0)
    for j in range(x.shape[1]) if depth else ():
        order = np.searchsorted(cuts[j], x[rows, j], side="left")
        gs, hs, ns = (np.cumsum(np.bincount(order, w, len(cuts[j]) + 1))[:-1] for w in (slope[rows], curve[rows], None))
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = -1
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), j, float(cuts[j][int(gain.argmax())]))
    if best[0] <= 1e-6:
        out[rows] += -SHRINK * g / (h + 1)
        return
    _, j, cut = best
    for low in (True, False):
        step = (*path, (FEATURES[j], low, cut))
        rules.append(step)
        side = rows[(x[rows, j] <= cut) == low]
        grow(x, slope, curve, cuts, side, step, depth - 1, rules, out)


def simplest(rule: Rule) -> Rule:
    """The tightest bounds per feature, in a fixed order."""
    bound: dict[tuple[str, bool], float] = {}
    for f, low, cut in rule:
        bound[f, low] = (min if low else max)(bound.get((f, low), cut), cut)
    return tuple((f, low, cut) for (f, low), cut in sorted(bound.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in rule:
        out &= (x[:, FEATURES.index(f)] <= cut) == low
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, passes: int = PASSES) -> tuple[float, np.ndarray]:
    """Logistic weights of the columns of ``r`` under an L1 penalty; the intercept is free."""
    a = np.hstack([np.ones((len(r), 1)), r])
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    pace = 4.0 * len(y) / float(np.linalg.norm(a @ v) ** 2 + 1e-9)
    w = np.zeros(a.shape[1])
    look, t = w.copy(), 1.0
    for _ in range(passes):
        p = 1 / (1 + np.exp(-np.clip(a @ look, -30, 30)))
        new = look - pace * (a.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - pace * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules. Without rows the intercept is 0; with one class only it is that class's log odds."""
    if not len(y):
        return 0.0, []
    rate = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return start, []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    rules: list[Rule] = []
    f = np.full(len(y), start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        grow(x, p - y, p * (1 - p), cuts, np.arange(len(y)), (), DEPTH, rules, step)
        f += step
    seen: dict[bytes, Rule] = {}
    for rule in sorted({simplest(r) for r in rules}, key=lambda r: (len(r), r)):
        on = holds(rule, x)
        if on.any() and not on.all():
            seen.setdefault(on.tobytes(), rule)
    kept = list(seen.values())
    if not kept:
        return start, []
    base, w = lasso(np.array([holds(r, x) for r in kept], float).T, y)
    return base, [(float(k), r) for k, r in zip(w, kept, strict=True) if abs(k) > 1e-6]


def compiled(base: float, rules: list[tuple[float, Rule]], name: str = "__gs_f") -> Column:
    """The model as a column: the logistic function of the weights of the rules that hold."""
    total = F.lit(base)
    for weight, rule in rules:
        test = F.lit(True)
        for f, low, cut in rule:
            test = test & ((F.col(name)[f] <= cut) if low else (F.col(name)[f] > cut))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> tuple[float, list[tuple[float, Rule]]]:
    """Fits on at most ``max_labelled`` rows of ``labels``. Null ids and labels don't count; repeated ones count each."""
    chosen = labels.select("doc_id", F.col(label_col).alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "y").limit(max_labelled)
    sample = with_features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("y", "__gs_f.*")
    rows = sorted(tuple(r) for r in sample.collect())
    return fit(np.array([r[1:] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[0] for r in rows], float))


def report(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """The result that the query returns: ``doc_id, held_out, score, predicted``, a row per document.

    Learns from labels outside the held-out fold; a score depends on the text alone. Null texts score as empty ones.
    A null id is in no fold. Repeated rows and ties get equal scores; without labels all scores are one half.
    """
    base, rules = learn(docs, labels.where(_fold(folds) != held))
    scored = with_features(docs.select("doc_id", "text")).select("doc_id", F.coalesce(_fold(folds) == held, F.lit(False)).alias("held_out"), compiled(base, rules).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
