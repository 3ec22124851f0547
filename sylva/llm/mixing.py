"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_below, cut

WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of a document's draw that place it in a bucket; 16 ** 3 buckets a source.
BUCKET_DIGITS = 3
#: Source tables up to this many rows are broadcast to the documents.
BROADCAST_SOURCES = 50_000
#: Documents that fill what is left of a source's target after those of least draw.
FILLS = 3


def words(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """32 hex digits that order the documents of a source at random, equal in every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit("-"))).cast("binary"))


def water_level(sources: DataFrame) -> float:
    """The level L at which targets min(cap, L * weight) add up to the budget, the sum of all sizes.

    A round clamps every source whose share is above its cap and gives the rest of the budget to the others by weight;
    the level only rises, so the clamped set is what lies above caps at the last level. A round is one aggregate of the
    source table, of which three numbers reach the driver.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.col("cap")
        r = sources.agg(
            F.sum("source_size").alias("budget"),
            F.sum(F.when(over, F.col("cap"))).alias("held"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if not r.budget or not r.open or r.n == clamped:
            return level
        level, clamped = (r.budget - (r.held or 0)) / r.open, r.n


def source_targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """(source, source_size, target) of (source, size) rows. Sources by code point, null last, take the weights in turn."""
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1  # over sources, not documents
    s = cut(
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * epochs)
    )
    level = F.lit(water_level(s))
    return s.withColumn("target", F.when(level * F.col("weight") > F.col("cap"), F.col("cap").cast("double")).otherwise(level * F.col("weight")))


def plan(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """(p_source, source_size, target, whole, last, plus): rows are taken `whole` times, those whose draw is at most `last` once
    more; so are, for each (draw, n) in `plus`, n of the rows of that draw.

    The words still missing after whole repetitions are gathered by draw, as long as rows fit; of rows that draw alike, being
    equal in id and text, as many as fit. Bucket sums find the bucket in which the first doesn't, and only its rows are put
    in order, one for each draw, so no source is ever sorted as a whole. Of the other documents the largest that still fits
    goes to `plus`, FILLS times.
    """
    t = source_targets(sizes, weights, epochs)
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = cut(t.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")).select("source", "source_size", "target", "whole", "extra"))
    small = broadcast_below(t, BROADCAST_SOURCES)
    bucket = sizes.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        bucket.groupBy("source", "bucket")
        .agg(F.sum("size").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .alias("b")
        .join(small.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .filter((F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("size")))
        .select(F.col("b.source").alias("e_source"), F.col("bucket").alias("e_bucket"), F.col("before").alias("e_before"), F.col("extra").alias("e_extra"))
    )
    edge = cut(edge)  # a row for each source at most
    by = ["e_source", "e_bucket", "e_before", "e_extra"]
    order = Window.partitionBy("e_source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("e_extra") - F.col("e_before") - F.col("run")  # for the rows of this draw
    n = F.when(F.col("size") > 0, F.least(F.col("rows"), F.floor(left / F.col("size")))).otherwise(F.col("rows"))
    last = (
        bucket.join(broadcast_below(edge, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("e_bucket")))
        .groupBy(*by, "draw")
        .agg(F.first("size").alias("size"), F.count("*").alias("rows"))
        .withColumn("run", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0)))
        .filter(left >= 0)
        .withColumn("n", n)
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("n") == F.col("rows"), F.col("draw"))).alias("last"),
            F.max(F.when((F.col("n") > 0) & (F.col("n") < F.col("rows")), F.struct("draw", "n"))).alias("part"),
            F.sum(F.col("n") * F.col("size")).alias("own"),
        )
        .select("e_source", F.coalesce("last", "e_bucket").alias("last"), (F.col("e_extra") - F.col("e_before") - F.col("own")).alias("rest"), F.array_compact(F.array("part")).alias("plus"))
    )
    last = cut(last)
    for _ in range(FILLS):
        room = sizes.join(broadcast_below(last, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("e_source")))
        room = room.filter((F.col("draw") > F.col("last")) & (F.col("size") > 0) & (F.col("size") <= F.col("rest")) & ~F.array_contains("plus.draw", F.col("draw")))
        best = room.groupBy(F.col("e_source").alias("f_source")).agg(F.max(F.struct("size", "draw")).alias("f"))
        more = F.array_append("plus", F.struct(F.col("f.draw").alias("draw"), F.lit(1).cast("long").alias("n")))
        last = last.join(best, F.col("e_source").eqNullSafe(F.col("f_source")), "left").select(
            "e_source", "last", (F.col("rest") - F.coalesce("f.size", F.lit(0))).alias("rest"), F.when(F.col("f").isNotNull(), more).otherwise(F.col("plus")).alias("plus")
        )
        last = cut(last)
    some = F.col("extra") > 0
    return t.join(last, F.col("source").eqNullSafe(F.col("e_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "target", "whole", F.when(some, F.coalesce("last", F.lit("g"))).alias("last"), F.when(some, F.coalesce("plus", F.array().cast("array<struct<draw:string,n:bigint>>"))).alias("plus")
    )


def with_copies(rows: DataFrame, sizes: DataFrame, p: DataFrame) -> DataFrame:
    """rows(d, source, size, draw) with plan()'s columns and `copies`, how often each is taken.

    A draw in `plus` of more rows than n has rows that are equal in id and text: of those, rows equal in all columns are counted
    and given out again in two lots, so none has to be told from another. This second pass is made only where there are any.
    """
    small = broadcast_below(p, BROADCAST_SOURCES)
    out = rows.join(small, F.col("source").eqNullSafe(F.col("p_source")))
    listed = F.array_contains("plus.draw", F.col("draw"))
    more = F.col("draw") <= F.col("last")
    asked = p.select("p_source", F.explode("plus").alias("x")).select("p_source", F.col("x.draw").alias("x_draw"), F.col("x.n").alias("x_n"))
    split = sizes.join(F.broadcast(asked) if small is not p else asked, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("draw") == F.col("x_draw")))
    split = split.groupBy("p_source", "x_draw", "x_n").count().filter("count > x_n").limit(1).count()
    plain = out.withColumn("copies", F.col("whole") + F.when(more | listed, 1).otherwise(0))
    if not split:
        return plain
    names = rows.columns
    n = F.aggregate(F.filter("plus", lambda x: x.draw == F.col("draw")), F.lit(0).cast("long"), lambda a, x: a + x.n)
    key = F.xxhash64("d")
    order = Window.partitionBy("source", "draw").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)  # over rows that differ in other columns only
    equal = out.filter(listed).groupBy(*(F.col(c) for c in names), "source_size", "target", "whole", n.alias("n")).count()
    equal = equal.withColumn("key", key).withColumn("before", F.coalesce(F.sum("count").over(order), F.lit(0)))
    once = F.greatest(F.lit(0), F.least(F.col("count"), F.col("n") - F.col("before"))).cast("long")
    lots = equal.withColumn("lot", F.explode(F.array(F.struct(once.alias("n"), F.lit(1).alias("more")), F.struct((F.col("count") - once).alias("n"), F.lit(0).alias("more")))))
    chunk = F.explode(F.expr("if(lot.n > 0, transform(sequence(0L, (lot.n - 1) div 4096), i -> least(4096L, lot.n - i * 4096)), array())"))
    again = lots.withColumn("chunk", chunk).withColumn("i", F.explode(F.expr("sequence(1L, chunk)"))).withColumn("copies", F.col("whole") + F.col("lot.more"))
    cols = [*names, "source_size", "target", "copies"]
    return plain.filter(F.coalesce(~listed, F.lit(True))).select(*cols).unionByName(again.select(*cols))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, source, text, source_size, target, size, copies) of documents(doc_id, source, text), as often as the mix takes each.

    Sources weigh `weights` in turn and share as many words as there are in all; a target is clamped at `epochs` times
    its source's words and the excess is shared by weight again. Copies are 0 to `epochs`. Null or empty texts have size
    0; a null source is a source of its own, the last; rows equal in id and text draw alike, and as many of them as fit are
    taken; an empty table gives an empty one; other columns are ignored.
    """
    return planned(docs.select("doc_id", "source", "text"), weights, epochs, seed).select("d.doc_id", "d.source", "d.text", "source_size", "target", "size", "copies")


def planned(docs: DataFrame, weights: tuple[int, ...], epochs: int, seed: int) -> DataFrame:
    """(d, source, size, draw, source_size, target, copies) of documents, d being the whole row."""
    rows = docs.select(F.struct(*docs.columns).alias("d"))
    rows = rows.withColumns({"source": F.col("d.source"), "size": words(F.col("d.text")), "draw": draw(F.col("d.doc_id"), F.col("d.text"), seed)})
    sizes = cut(rows.select("source", "size", "draw"))
    return with_copies(rows, sizes, cut(plan(sizes, weights, epochs)))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 7) -> DataFrame:
    """The rows of documents, with all their columns, each as often as mix() takes it."""
    out = planned(docs, weights, epochs, seed)
    return out.select("d", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("d.*")


def op1_mixing(spark, sf_dir) -> DataFrame:
    from .common import read

    m = mix(read(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies")


_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '-')) AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight, 3 * source_size AS cap FROM s),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lv
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(lv) AS lv FROM c),
t AS (SELECT source, source_size, CASE WHEN l.lv * weight > cap THEN cap::DOUBLE ELSE l.lv * weight END AS target FROM w, l),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
t3 AS (SELECT *, target - whole * source_size AS extra FROM t2),
r AS (SELECT d.*, source_size, target, whole, extra,
        extra > 0 AND sum(size) OVER (PARTITION BY d.source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= extra AS fits
      FROM d JOIN t3 ON d.source IS NOT DISTINCT FROM t3.source),
f0 AS (SELECT *, false AS used, extra - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0) AS rest FROM r),
FILLED
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (whole + CASE WHEN fits OR used THEN 1 ELSE 0 END))::BIGINT AS taken,
       (whole + CASE WHEN fits OR used THEN 1 ELSE 0 END)::BIGINT AS copies
FROM fLAST
"""
_FILL = """k{i} AS (SELECT *, NOT fits AND NOT used AND extra > 0 AND size > 0 AND size <= rest AS could FROM f{h}),
p{i} AS (SELECT *, could AND row_number() OVER (PARTITION BY source, could ORDER BY size DESC, draw DESC) = 1 AS pick FROM k{i}),
f{i} AS (SELECT * EXCLUDE (could, pick, used, rest), used OR pick AS used, rest - coalesce(sum(size) FILTER (pick) OVER (PARTITION BY source), 0) AS rest FROM p{i})"""
SQL = _SQL.replace("FILLED", ",\n".join(_FILL.format(i=i, h=i - 1) for i in range(1, FILLS + 1))).replace("fLAST", f"f{FILLS}")
