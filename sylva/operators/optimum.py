"""Choosing among repeat models: metrics, best inputs, spread, sensitivity, precision."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import safe_std

INPUTS = ["pd1", "pd2min", "pd2max"]
#: The parts of a model whose columns a combination adds up.
COMBINATIONS = {
    "all": ["all"],
    "trunk": ["trunk"],
    "branch": ["branch"],
    "1branch": ["branch1"],
    "2branch": ["branch2"],
    "trunk+branch": ["trunk", "branch"],
    "trunk+1branch": ["trunk", "branch1"],
    "trunk+1branch+2branch": ["trunk", "branch1", "branch2"],
    "1branch+2branch": ["branch1", "branch2"],
}
#: Attributes whose deviation is a metric; of several, the deviations are added.
DEVIATIONS = {
    "tot_vol_std": ["total_volume"],
    "trunk_vol_std": ["trunk_volume"],
    "branch_vol_std": ["branch_volume"],
    "trunk+branch_vol_std": ["trunk_volume", "branch_volume"],
    "tot_are_std": ["total_area"],
    "trunk_are_std": ["trunk_area"],
    "branch_are_std": ["branch_area"],
    "trunk+branch_are_std": ["trunk_area", "branch_area"],
    "trunk_len_std": ["trunk_length"],
    "trunk+branch_len_std": ["trunk_length", "branch_length"],
    "branch_len_std": ["branch_length"],
    "branch_num_std": ["number_branches"],
}


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def scalar_metrics() -> dict[str, Column]:
    """Name -> aggregate over the runs of equal inputs: distances, deviations and coverage; smaller is better."""
    mean = {c: _sum([F.avg(f"mean_{p}") for p in parts]) for c, parts in COMBINATIONS.items()}
    most = {c: _sum([F.avg(f"max_{p}") / 2 for p in parts]) for c, parts in COMBINATIONS.items()}
    out = {f"{c}_mean_dis": mean[c] for c in COMBINATIONS}
    out |= {f"{c}_max_dis": most[c] for c in COMBINATIONS}
    out |= {f"{c}_mean+max_dis": mean[c] + most[c] for c in COMBINATIONS}
    out |= {name: _sum([safe_std(F.col(a)) for a in parts]) for name, parts in DEVIATIONS.items()}
    out |= {f"{c}_mean_surf": _sum([1 - F.avg(f"surf_{p}") for p in parts]) for c, parts in COMBINATIONS.items()}
    out |= {f"{c}_min_surf": _sum([1 - F.avg(f"low_{p}") for p in parts]) for c, parts in COMBINATIONS.items()}
    return out


#: Class metrics: (family, measures, numbers of classes that are looked at).
CLASS_FAMILIES = (("order", ("vol", "are", "len", "num"), (3, 6)), ("dia", ("vol", "are", "len"), (10, 20)), ("zen", ("vol", "are", "len"), (18,)))


def class_names() -> list[tuple[str, str, str, int, str]]:
    """(name, family, measure, classes, mean or max) of the class metrics, in the order of their ids."""
    out = []
    for family, measures, sizes in CLASS_FAMILIES:
        for m, n, how in product(measures, sizes, ("mean", "max")):
            stem = {"order": f"branch_{m}_ord{n}", "dia": f"cyl_{m}_dia{n}", "zen": f"cyl_{m}_zen"}[family]
            out.append((f"{stem}_{how}", family, m, n, how))
    return out


def metric_names() -> list[str]:
    """All 91 names; a metric's id is its place, from 1."""
    s = [*scalar_names()]
    return [*s[:39], *(c[0] for c in class_names()), *s[39:]]


def scalar_names() -> list[str]:
    c = [*COMBINATIONS]
    return [*(f"{x}_mean_dis" for x in c), *(f"{x}_max_dis" for x in c), *(f"{x}_mean+max_dis" for x in c), *DEVIATIONS, *(f"{x}_mean_surf" for x in c), *(f"{x}_min_surf" for x in c)]


def scalar_table(runs: DataFrame) -> DataFrame:
    """(tree_id, inputs, metric, value) of the scalar metrics: one aggregation, then unpivoted."""
    m = scalar_metrics()
    ids = {name: f"m{i}" for i, name in enumerate(m)}
    wide = runs.groupBy("tree_id", *INPUTS).agg(*(c.alias(ids[n]) for n, c in m.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(i).alias("value")) for n, i in ids.items()))
    return wide.select("tree_id", *INPUTS, F.explode(pairs).alias("p")).select("tree_id", *INPUTS, "p.metric", "p.value")


def class_table(classes: DataFrame) -> DataFrame:
    """(tree_id, inputs, metric, value) of the class metrics, from (tree_id, inputs, model, family, measure, class, value).

    For each class the range over runs relative to their mean (the range itself where the mean isn't positive; a run
    without the class counts 0), then mean or largest over the first classes; classes in no run count 0.
    """
    by = ["tree_id", *INPUTS, "family", "measure"]
    runs = classes.groupBy("tree_id", *INPUTS).agg(F.count_distinct("model").alias("runs"))
    per = classes.groupBy(*by, "class").agg(F.max("value").alias("high"), F.min("value").alias("least"), F.sum("value").alias("total"), F.count("*").alias("n")).join(runs, ["tree_id", *INPUTS])
    low = F.when(F.col("n") < F.col("runs"), F.least(F.lit(0.0), F.col("least"))).otherwise(F.col("least"))
    high = F.when(F.col("n") < F.col("runs"), F.greatest(F.lit(0.0), F.col("high"))).otherwise(F.col("high"))
    mean = F.col("total") / F.col("runs")
    per = per.withColumn("spread", F.when(mean > 0, (high - low) / mean).otherwise(high - low))
    sizes = sorted({(f, n) for f, _, ns in CLASS_FAMILIES for n in ns})
    aggs = {n: (F.sum(F.when(F.col("class") <= n, F.col("spread")).otherwise(0.0)) / n, F.max(F.when(F.col("class") <= n, F.col("spread")).otherwise(0.0))) for _, n in sizes}
    wide = per.groupBy(*by).agg(*(c.alias(f"{how}{n}") for n, two in aggs.items() for how, c in zip(("mean", "max"), two, strict=True)))
    rows = F.array(*(F.struct(F.lit(name).alias("metric"), F.lit(f).alias("f"), F.lit(m).alias("m"), F.col(f"{how}{n}").alias("value")) for name, f, m, n, how in class_names()))
    out = wide.withColumn("p", F.explode(F.filter(rows, lambda r: (r.f == F.col("family")) & (r.m == F.col("measure")))))
    return out.select("tree_id", *INPUTS, "p.metric", "p.value")


def metric_table(runs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(tree_id, inputs, metric, value) of all metrics."""
    s = scalar_table(runs)
    return s if classes is None else s.unionByName(class_table(classes))


def metric(table: DataFrame, name: str) -> DataFrame:
    """(tree_id, inputs, value) of a metric; an unknown name means the mean distance of all."""
    return table.filter(F.col("metric") == (name if name in metric_names() else "all_mean_dis")).drop("metric")


def best_inputs(values: DataFrame, n: int = 3) -> DataFrame:
    """(tree_id, rank, inputs, value): the inputs of the n smallest values of each tree, ties by the inputs."""
    w = Window.partitionBy("tree_id").orderBy("value", *INPUTS)
    return values.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n).select("tree_id", "rank", *INPUTS, "value")


def best_runs(runs: DataFrame, best: DataFrame) -> DataFrame:
    """(tree_id, inputs, model, mean_all): of each tree's best inputs the run of least mean distance, ties to the first model."""
    first = best.filter("rank = 1").select("tree_id", *INPUTS)
    m = runs.join(first, ["tree_id", *INPUTS]).groupBy("tree_id", *INPUTS).agg(F.min(F.struct("mean_all", "model")).alias("m"))
    return m.select("tree_id", *INPUTS, "m.model", "m.mean_all")


ATTRIBUTES = ["total_volume", "trunk_volume", "branch_volume", "total_area", "trunk_area", "branch_area", "trunk_length", "branch_length", "number_branches"]


def attribute_statistics(runs: DataFrame, by: list[str], attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """(by, attribute, mean, std, cv) over the runs; cv in percent, null for a mean of 0."""
    wide = runs.groupBy(*by).agg(*(c for a in attributes for c in (F.avg(a).alias(f"{a}_mean"), safe_std(F.col(a)).alias(f"{a}_std"))))
    rows = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(f"{a}_mean").alias("mean"), F.col(f"{a}_std").alias("std")) for a in attributes))
    out = wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    return out.withColumn("cv", F.try_divide(F.col("std"), F.col("mean")) * 100)


def sensitivity(runs: DataFrame, best: DataFrame, attribute: str) -> DataFrame:
    """(tree_id, input, change): the change of the attribute's mean, in percent to 2 decimals, from the best inputs to the
    inputs whose value of one input is nearest and whose others are equal; null where there are none."""
    means = runs.groupBy("tree_id", *INPUTS).agg(F.avg(attribute).alias("mean"))
    at = best.filter("rank = 1").select("tree_id", *INPUTS).join(means, ["tree_id", *INPUTS])
    out = None
    for i in INPUTS:
        same = [c for c in INPUTS if c != i]
        other = means.select("tree_id", *same, F.col(i).alias("other"), F.col("mean").alias("other_mean"))
        near = at.join(other, ["tree_id", *same]).filter(F.abs(F.col("other") - F.col(i)) > 1e-4)
        near = near.groupBy("tree_id").agg(F.min_by(F.struct("mean", "other_mean"), F.struct(F.round(F.abs(F.col("other") - F.col(i)), 9).alias("d"), "other")).alias("m"))
        change = F.round(F.try_divide(F.abs(F.col("m.other_mean") - F.col("m.mean")), F.col("m.mean")) * 100, 2)
        rows = at.select("tree_id").join(near, "tree_id", "left").select("tree_id", F.lit(i).alias("input"), change.alias("change"))
        out = rows if out is None else out.unionByName(rows)
    return out


def display_sensitivity(values: DataFrame, statistics: DataFrame) -> DataFrame:
    """(tree_id, change, change_by_cv) of (tree_id, rank, value) of the three best inputs: the largest relative difference of
    the best one's attribute from the second's and third's, and the same in units of the coefficient of variation (tree_id, cv)."""
    v = values.groupBy("tree_id").agg(*(F.max(F.when(F.col("rank") == i, F.col("value"))).alias(f"v{i}") for i in (1, 2, 3)))
    change = F.greatest(*(F.abs(F.try_divide(F.col("v1") - F.col(f"v{i}"), F.col("v1"))) * 100 for i in (2, 3)))
    return v.withColumn("change", change).join(statistics, "tree_id", "left").select("tree_id", "change", F.try_divide(F.col("change"), F.col("cv")).alias("change_by_cv"))


def precision(optimal: DataFrame, new: DataFrame, attributes: list[str] = ATTRIBUTES) -> tuple[DataFrame, DataFrame]:
    """Statistics of each tree's optimal and new runs together, and its best run, that of least mean distance."""
    both = optimal.unionByName(new)
    stats = attribute_statistics(both, ["tree_id"], attributes)
    best = both.groupBy("tree_id").agg(F.min(F.struct("mean_all", *INPUTS, "model")).alias("m")).select("tree_id", "m.*")
    return stats, best


def collect_runs(cylinders: DataFrame) -> DataFrame:
    """The row of each run (tree_id, inputs, model) that the metrics are computed from: mean and largest distance, mean and
    least coverage of all, trunk, branch and first and second order cylinders, and attributes; 0 for parts without cylinders.

    cylinders: (tree_id, inputs, model, branch, branch_order, radius, length, surf_cov, mean_distance). Runs without
    cylinders have no row, so nothing has to be dropped later.
    """
    parts = {"all": F.lit(True), "trunk": F.col("branch_order") == 0, "branch": F.col("branch_order") > 0, "branch1": F.col("branch_order") == 1, "branch2": F.col("branch_order") == 2}
    pick = lambda test, c: F.when(test, c)
    aggs = []
    for name, f, column in (("mean", F.avg, "mean_distance"), ("max", F.max, "mean_distance"), ("surf", F.avg, "surf_cov"), ("low", F.min, "surf_cov")):
        aggs += [F.coalesce(f(pick(t, F.col(column))), F.lit(0.0)).alias(f"{name}_{p}") for p, t in parts.items()]
    l, r = F.col("length"), F.col("radius")
    kinds = {"volume": 1000 * F.pi() * l * r * r, "area": 2 * F.pi() * l * r, "length": l}
    for kind, v in kinds.items():
        aggs += [F.sum(v if p == "total" else F.when((F.col("branch") == 1) == (p == "trunk"), v).otherwise(0.0)).alias(f"{p}_{kind}") for p in ("total", "trunk", "branch")]
    aggs.append((F.count_distinct("branch") - 1).cast("double").alias("number_branches"))
    return cylinders.groupBy("tree_id", *INPUTS, "model").agg(*aggs)


def collect_classes(cylinders: DataFrame, orders: int = 6, diameters: int = 20) -> DataFrame:
    """(tree_id, inputs, model, family, measure, class, value): volumes, areas, lengths (and numbers of branches) by branch order
    1 to 6, by 1 cm diameter class to 20 and by 18 zenith classes."""
    l, r = F.col("length"), F.col("radius")
    measures = {"vol": 1000 * F.pi() * l * r * r, "are": 2 * F.pi() * l * r, "len": l}
    classes = {
        "order": F.col("branch_order"),
        "dia": F.floor(F.round(r / 0.005, 9)) + 1,
        "zen": F.floor(F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("axis_z"))))) / 10, 9)) + 1,
    }
    rows = [F.struct(F.lit(f).alias("family"), F.lit(m).alias("measure"), c.cast("long").alias("class"), v.alias("v")) for f, c in classes.items() for m, v in measures.items()]
    rows.append(F.struct(F.lit("order").alias("family"), F.lit("num").alias("measure"), F.col("branch_order").cast("long").alias("class"), F.when(F.col("position") == 1, 1.0).otherwise(0.0).alias("v")))
    last = F.when(F.col("c.family") == "order", orders).when(F.col("c.family") == "dia", diameters).otherwise(18)
    d = cylinders.select("tree_id", *INPUTS, "model", F.explode(F.array(*rows)).alias("c")).filter((F.col("c.class") >= 1) & (F.col("c.class") <= last))
    return d.groupBy("tree_id", *INPUTS, "model", "c.family", "c.measure", "c.class").agg(F.sum("c.v").alias("value"))
