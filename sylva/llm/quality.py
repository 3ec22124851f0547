"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, hash_third, read

#: Labelled documents that are learned from at most (in expectation; drawn by a hash of the id).
SAMPLE = 8000
TREES = 40
DEPTH = 3
#: Thresholds tried for a statistic: quantiles of its values.
CUTS = 32
PENALTY = 2e-3
SEED = 11
#: Sampled label tables up to this many rows are broadcast.
BROADCAST_LABELS = 4 * SAMPLE
SPACE = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of whole texts, 0 where there is nothing to divide by. Made of columns `t`, `w` (words) and `l` (lines)."""
    n = F.length("t")
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    of = lambda kind: share(F.length(F.regexp_replace("t", f"[^{kind}]+", "")), n)
    words = F.size("w")
    return {
        "length": F.log1p(n.cast("double")),
        "upper": of(r"\p{Lu}"),
        "digits": of("0-9"),
        "symbols": of(r"#*%&$@^~=+<>{}\[\]_\\/"),
        "shouts": share(n - F.length(F.replace(F.col("t"), F.lit("!"), F.lit(""))), n),
        "bars": share(n - F.length(F.replace(F.col("t"), F.lit("|"), F.lit(""))), n),
        "stops": share(n - F.length(F.replace(F.col("t"), F.lit("."), F.lit(""))), words),
        "commas": share(n - F.length(F.replace(F.col("t"), F.lit(","), F.lit(""))), words),
        "word_length": share(n, words),
        "distinct_words": share(F.size(F.array_distinct("w")), words),
        "doubled_words": share(F.expr("size(filter(w, (x, i) -> x = get(w, i + 1)))"), words),
        "lines": share(F.size("l"), words),
        "distinct_lines": share(F.size(F.array_distinct("l")), F.size("l")),
    }


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` and `s`, the struct of statistics, of rows with `text`; null texts count as empty."""
    d = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.withColumns({"w": F.array_remove(F.split("t", SPACE), ""), "l": F.array_remove(F.split("t", "\n"), "")})
    stats = statistics(F.col("t"))
    return d.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.struct(*(c.alias(k) for k, c in stats.items())).alias("s"))


NAMES = list(("length", "upper", "digits", "symbols", "shouts", "bars", "stops", "commas", "word_length", "distinct_words", "doubled_words", "lines", "distinct_lines"))

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which hold


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], depth: int, rng: np.random.Generator, path: Rule = ()) -> list[Rule]:
    """The paths of a tree's nodes but the root: splits of least Gini impurity among a random half of the statistics."""
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return []
    best = None
    for f in rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False):
        above = x[:, f, None] > cuts[f][None, :]
        n1 = above.sum(0)
        p1, p = (above & (y[:, None] > 0)).sum(0), y.sum()
        n0, p0 = len(y) - n1, p - p1
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = np.where((n0 > 3) & (n1 > 3), p0 - p0**2 / n0 + p1 - p1**2 / n1, np.inf)
        if len(impurity) and (best is None or impurity.min() < best[0]):
            i = int(impurity.argmin())
            best = (float(impurity[i]), int(f), float(cuts[f][i]))
    if best is None or not np.isfinite(best[0]):
        return []
    _, f, at = best
    out: list[Rule] = []
    for side in (True, False):
        rows, rule = (x[:, f] > at) == side, (*path, (f, side, at))
        out += [rule, *grow(x[rows], y[rows], cuts, depth - 1, rng, rule)]
    return out


def rules_of(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Distinct rules of trees grown on bootstrap samples."""
    rng = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        rows = rng.integers(0, len(y), len(y))
        found |= dict.fromkeys(tuple(sorted(r)) for r in grow(x[rows], y[rows], cuts, DEPTH, rng))
    return [*found]


def holds(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, above, at in rule:
            out[:, j] *= (x[:, f] > at) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of logistic regression with an L1 penalty, by accelerated proximal gradients."""
    w, b = np.zeros(r.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, vb, t = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(np.c_[r, np.ones(len(r))], 2) ** 2 / len(r))
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(r @ v + vb))) - y
        nw = v - step * (r.T @ g) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * g.mean()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


@dataclass
class Model:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, s: str = "s") -> Column:
        """The probability of label 1 from the struct of statistics, as an expression."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for f, above, at in rule:
                c = F.col(f"{s}.{NAMES[f]}")
                test = test & ((c > at) if above else (c <= at))
            z = z + F.when(test, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels(doc_id, quality) learned from about `sample` labelled rows of documents(doc_id, text).

    Null labels and ids teach nothing; of rows of one id the one of the smallest text does; labels of one kind only, or none, give a model without rules. The statistics are
    computed where the documents lie; a row of numbers for each drawn document comes to the driver.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < min(1 << 30, int(sample / max(n, 1) * (1 << 30)) + 1))
    d = docs.select("doc_id", "text").join(broadcast_below(drawn.withColumnRenamed("doc_id", "l_id"), BROADCAST_LABELS), F.col("doc_id") == F.col("l_id"))
    if d.count() > drawn.count():
        d = d.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = with_statistics(d, ["doc_id", "quality"]).select("doc_id", "quality", "s.*").collect()
    data = np.array(sorted(tuple(float(v) for v in r) for r in rows)).reshape(-1, 2 + len(NAMES))
    x, y = data[:, 2:], (data[:, 1] > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return Model(4.0 * (2 * float(y.mean()) - 1) if len(y) else 0.0, [])
    rules = rules_of(x, y)
    b, w = lasso(holds(x, rules), y, PENALTY)
    return Model(float(b), [(r, float(v)) for r, v in zip(rules, w, strict=True) if v])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model learned from labels of documents that aren't held out."""
    return fit(docs, labels.filter(hash_third(F.col("doc_id")) != 1))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` of documents with `text`, and score: a probability, of null and empty texts too."""
    # exploded from an array of one, so that no filter on the score is moved below the statistics and repeats them
    return with_statistics(docs, keep).select(*keep, F.explode(F.array(model.score())).alias("score"))


def op6_quality(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    s = score(docs, learn(docs, read(spark, sf_dir, "labels")), ["doc_id"])
    return s.select("doc_id", (hash_third(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
