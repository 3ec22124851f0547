"""Document fingerprints: SimHash by DataFrame expressions, and permuted block tables that find near ones."""

from __future__ import annotations

from collections import Counter
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_below, cut, read

BITS = 64
SPACE = r"[\x20\x09-\x0D]+"
#: Terms whose votes are added in bytes of one long, so that none overflows.
CHUNK = 127
LANES = 0x0101010101010101
#: Ranges of ids per shuffle partition; each range is put in order on its own.
RANGES = 4
#: The query looks up the near fingerprints of rows whose id this divides.
ASKED = 100
BROADCAST_FOUND = 200_000
#: Parts of each bucket of a block table; a fingerprint that is looked up asks all of them.
SALTS = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE), "")


def terms(w: str) -> Column:
    """Hashes of each word of a column of words with the next one, the last alone: pairs tell texts apart that share their frequent words."""
    return F.expr(f"transform({w}, (x, i) -> xxhash64(x, get({w}, i + 1)))")


def simhash(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`keys` and fp of rows whose array `column` has a document's term hashes; fp is 0 where there are none.

    A term votes once for each occurrence, its weight: +1 on each bit that its hash sets, -1 on the others; a bit is 1 if
    its votes are positive. Votes for eight bits at a time are added in the bytes of one long over chunks of terms, then
    chunk by chunk.
    """
    votes = [F.sum(F.shiftrightunsigned("term", k).bitwiseAND(F.lit(LANES))).alias(f"v{k}") for k in range(8)]
    each = rows.select(*keys, F.posexplode_outer(column).alias("at", "term"))
    chunks = each.groupBy(*keys, F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.count("term").alias("n"), *votes)
    lane = lambda k, j: F.shiftrightunsigned(F.coalesce(f"v{k}", F.lit(0)), 8 * j).bitwiseAND(F.lit(255))
    sums = chunks.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(lane(k, j)).alias(f"s{8 * j + k}") for k in range(8) for j in range(8)))
    fp = F.lit(0).cast("long")
    for bit in range(BITS):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"s{bit}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """The keys of a fingerprint: a table for each choice of blocks - radius blocks, permuted to the front."""
    if not 0 <= radius < blocks:
        raise ValueError("more blocks than bits that may differ are needed")
    at = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for table, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        front = [F.shiftrightunsigned(fp, at[i]).bitwiseAND(F.lit((1 << min(63, at[i + 1] - at[i])) - 1)) for i in chosen]
        keys.append(F.xxhash64(F.lit(table), *front))
    return F.array(*keys)


def near(fps: DataFrame, radius: int = 3, blocks: int = 6, queries: DataFrame | None = None) -> DataFrame:
    """(a, b) of all distinct fps(fp) b at most `radius` bits from a, by permuted block tables: for a in queries(fp), b any other
    one; without queries all pairs with a < b.

    `radius` bits leave at least one choice of blocks untouched, so what shares no key need not be compared, and no pair is
    lost; a pair counts in the first table where it shares a key. Buckets are joined, never gathered, and for queries
    parted by SALTS; the keys asked grow with the table, so they are never broadcast; all-pairs search is for tables whose near groups are small.
    """
    own = F.posexplode(block_keys(F.col("fp"), radius, blocks)).alias("table", "key")
    keyed = fps.select("fp").distinct().select("fp", own)
    a, b = F.col("x.fp"), F.col("y.fp")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.table") == F.col("y.table"))
    if queries is None:
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        keyed = cut(keyed.join(shared, "key"))
        found = keyed.alias("x").join(keyed.alias("y"), same & (a < b))
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        asked = queries.select("fp").distinct().select("fp", own).select("*", parts)
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64("fp", "table"), F.lit(SALTS)).cast("int"))
        found = asked.alias("x").hint("merge").join(salted.alias("y"), same & (F.col("x.salt") == F.col("y.salt")) & (a != b))
    first = F.array_position(F.zip_with(block_keys(a, radius, blocks), block_keys(b, radius, blocks), lambda x, y: x == y), True)
    return found.filter(F.bit_count(a.bitwiseXOR(b)) <= radius).filter(first == F.col("x.table") + 1).select(a.alias("a"), b.alias("b"))


def ranges(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) by descending (id, h), null ids last, in ranges: with columns (id, h, part, ghost); h is the text's hash.

    Every range ends with the first rows of the next one (after the last: of the first), as ghosts, so that each row and
    its successor stand in one range. Ranges are bounded by quantiles of the ids; an id that fills several of them, null
    too, is parted by h as often. The driver learns a few bounds a shuffle partition and the first row of each range.
    """
    spark = docs.sparkSession
    n = max(1, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    identity = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    found = docs.select(identity.alias("id")).agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("q")).first().q or []
    times = Counter(found)
    bounds = sorted(times)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    big = lambda xs: F.expr("array(" + ", ".join(f"{x}L" if x > -(1 << 63) else f"({-(1 << 63) + 1}L - 1L)" for x in xs) + ")")
    below = lambda xs, c: F.size(F.filter(xs, lambda x: x <= c))
    part = F.lit(0)
    if bounds:
        coarse = below(big([g[0] for g in groups]), identity)  # first the group of bounds, then the bound in it
        at = F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(F.get(F.array(*(big(g) for g in groups)), coarse - 1), identity))
        lots = [times[x] for x in bounds]
        lot, first = F.get(big(lots), F.col("at") - 1), F.get(big([1 + x for x in accumulate([0, *lots[:-1]])]), F.col("at") - 1)
        within = F.least(lot - 1, F.floor((F.col("h") / float(1 << 64) + 0.5) * lot))
        inner = F.when(F.get(big(bounds), F.col("at") - 1) == F.col("id"), within).otherwise(lot - 1)
        part = F.when(F.col("at") == 0, 0).otherwise(first + inner)
    else:
        at = F.lit(0)
    dealt = docs.withColumns({"id": identity, "h": F.xxhash64("text"), "at": at.cast("int")}).withColumn("part", part.cast("int")).drop("at")
    key = F.xxhash64("id", "h")
    tops = sorted(((r.part, r.top.x) for r in dealt.groupBy("part").agg(F.max(F.struct("id", "h", key.alias("x"))).alias("top")).collect()), reverse=True)
    ends = {}  # the key of a range's first row, and the range before it, which it follows
    for (before, _), (_, top) in zip(tops, tops[1:] + tops[:1], strict=True):
        ends[top] = before
    where = F.lit(None).cast("int")
    if ends:
        pairs = sorted(ends.items())
        k = F.array_position(big([x for x, _ in pairs]), key).cast("int")
        where = F.when(k > 0, F.get(F.array(*(F.lit(p) for _, p in pairs)), k - 1))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
    copies = F.when(where.isNotNull(), F.array(own, F.struct(where.alias("part"), F.lit(True).alias("ghost")))).otherwise(F.array(own))
    return dealt.withColumn("copy", F.explode(copies)).withColumns({"part": F.col("copy.part"), "ghost": F.col("copy.ghost")}).drop("copy")


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp) of documents(doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the next document by
    descending doc_id. Rows of equal id follow by a hash of their texts; null ids come last; null texts are empty; a single row follows
    itself. Texts move once, to their range of ids; everything after that happens in the range.
    """
    d = ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("part").orderBy("ghost", F.desc("id"), F.desc("h"), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.withColumns({"rn": F.row_number().over(order), "next": F.lead("text").over(order)})
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next", F.lit(1), half))
    d = d.withColumns({"n_chars": F.length("text").cast("long"), "edited": F.when(~F.col("ghost"), edited)})
    d = d.withColumns({"edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "w0": words(F.col("text")), "w1": words(F.col("edited"))})
    d = d.withColumns({"t0": terms("w0"), "t1": terms("w1")})
    both = d.select("part", "rn", "ghost", "doc_id", "n_chars", "edited_sha256", F.posexplode(F.array("t0", "t1")).alias("kind", "ts"))
    keys = ["part", "rn", "ghost", "doc_id", "n_chars", "edited_sha256", "kind"]
    f = simhash(both, keys, "ts")
    row = ["part", "rn", "ghost", "doc_id", "n_chars", "edited_sha256"]
    f = f.groupBy(*row).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    f = f.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("part").orderBy("rn")))
    return f.filter(~F.col("ghost")).select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def hex16(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def op5_fingerprints(spark, sf_dir) -> DataFrame:
    f = cut(with_edits(read(spark, sf_dir, "documents")))
    asked = F.col("doc_id") % ASKED == 0
    queries = cut(f.filter(asked).select("fp").distinct())
    others = near(f.select("fp"), queries=queries).groupBy("a").agg(F.count("*").alias("n"))
    small = broadcast_below(queries.select(F.col("fp").alias("q")), BROADCAST_FOUND)
    rows = f.select("fp").join(small, F.col("fp") == F.col("q"), "left_semi").groupBy(F.col("fp").alias("own")).agg(F.count("*").alias("same"))
    found = rows.join(others, F.col("own") == F.col("a"), "left").select("own", "same", F.coalesce("n", F.lit(0)).alias("n"))
    # of every row whose id is divisible by ASKED: other fingerprints within 3 bits, other rows of the same one
    return f.join(broadcast_below(cut(found), BROADCAST_FOUND), asked & (F.col("fp") == F.col("own")), "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex16(F.col("fp")).alias("fingerprint"),
        hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.col("n").alias("n_near"),
        (F.col("same") - 1).alias("n_same"),
    )
