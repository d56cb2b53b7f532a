"""Mixing sources to target weights with hash-threshold histograms.

A document's hash has 36 bits.  Tokens are summed by source and the hash's first
12 bits; the bucket in which the running sum passes a source's budget is refined by
the next 12 bits, twice.  Documents below the threshold so found take one copy more
than all others of the source: no document is sorted.  Where the last bucket has
several rows, repeated ones or those whose hashes agree, it is refined further, by what
the rows are and then by where they stand, so that one row decides in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import plain, table, word_count, written

WEIGHTS = (3, 1, 2)
#: The mix's size, as a share of all sizes, and the most a source or document is repeated.
SHARE, MOST = 1.5, 2
BITS, LEVELS = 12, 3
#: Bits of a row's place (Spark's monotonically increasing id) that are left after each of its levels.
PLACES = (33, 22, 11, 0)
#: Sources up to which their thresholds are broadcast (about 150 bytes each).
BROADCAST_ROWS = 100_000


def _hash(doc_id: Column, text: Column) -> Column:
    return F.conv(F.substring(F.md5(_what(doc_id, text)), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row a source.

    Sources in the order of their code points, null last, get the weights in turn.
    A target is weight * level, or most * source_size where that is less; the level
    makes the targets' sum share * all sizes.
    """
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    all_rows = Window.partitionBy()
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    # sources reach their limits in the order of limit / weight
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    rows = rows.withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.col("before")) / F.col("left"))
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("before", "level"))).over(all_rows)["level"]
    target = F.when(open_level.isNull(), F.col("limit")).otherwise(F.least(F.col("limit").cast("double"), open_level * F.col("weight")))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _what(doc_id: Column, text: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _rows(docs: DataFrame, place: Column) -> DataFrame:
    """A row each of a table (doc_id, text, source): its size, its hash, what it is and where it stands, written once."""
    doc_id, text = F.col("doc_id"), F.col("text")
    return written(docs.select("doc_id", "source", word_count(text).alias("size"), _hash(doc_id, text).alias("hash"), _what(doc_id, text).alias("what"), place.alias("place")), "sizes")


def _near(df: DataFrame) -> DataFrame:
    """A written table of a row a source, broadcast if there are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def thresholds(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, bool]:
    """(of, source_size, target, whole, and where the copies beyond ``whole`` end), a row a source, and whether places decide."""
    per = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    per = per.withColumn("whole", whole.cast("long"))

    def passed(sums: DataFrame, level: str) -> DataFrame:
        """Of (source, bucket, tokens, n, gap): the bucket in which the running sum passes the gap, and what is still to be taken within it."""
        up_to = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("before", up_to - F.col("tokens")).withColumn("up_to", up_to)
        last = sums.where("up_to > gap").groupBy("source").agg(F.min(F.struct("bucket", "before", "tokens", "n", "gap")).alias("x"))
        return last.select(F.col("source").alias("of"), F.col("x.bucket").alias(level), (F.col("x.gap") - F.col("x.before")).alias("gap"), F.col("x.tokens").alias("tokens"), F.col("x.n").alias("n"))

    def refined(cut: DataFrame, within: Column, bucket: Column, level: str) -> DataFrame:
        """cut with one level more: of the rows ``within`` its buckets, the one that passes what is left."""
        before = [c for c in cut.columns if c not in ("gap", "tokens", "n")]
        here = rows.join(_near(cut.drop("tokens", "n")), F.col("source").eqNullSafe(F.col("of")) & within)
        sums = here.groupBy("source", bucket.alias("bucket"), "gap").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
        found = passed(sums, level).withColumnRenamed("of", "again")
        return written(cut.select(*before).join(found, F.col("of").eqNullSafe(F.col("again"))).drop("again"), level)

    start = per.select(F.col("source").alias("of"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("gap"))
    first = F.shiftright("hash", BITS * (LEVELS - 1))
    sums = rows.groupBy("source", first.alias("bucket")).agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
    cut = written(passed(sums.join(_near(start), F.col("source").eqNullSafe(F.col("of"))).drop("of"), "h1"), "h1")
    for level in range(2, LEVELS + 1):
        rest = BITS * (LEVELS - level)
        cut = refined(cut, F.shiftright("hash", rest + BITS) == F.col(f"h{level - 1}"), F.shiftright("hash", rest), f"h{level}")
    ends = F.col("hash") == F.col(f"h{LEVELS}")
    several = lambda: cut.where("n > 1").limit(1).count() > 0
    by_place = False
    if several():
        cut = refined(cut, ends, F.col("what"), "w")
        if several():
            by_place, within = True, ends & (F.col("what") == F.col("w"))
            for rest in PLACES:
                cut = refined(cut, within, F.shiftright("place", rest), f"p{rest}")
                within = ends & (F.col("what") == F.col("w")) & (F.shiftright("place", rest) == F.col(f"p{rest}"))
    # the last row is taken if that comes nearer; a source without one lies wholly below its budget
    null = lambda kind: F.lit(None).cast(kind)
    bound = cut.select(F.col("of").alias("at"), F.col(f"h{LEVELS}").alias("last_hash"), (F.col("w") if "w" in cut.columns else null("string")).alias("last_what"), (F.col(f"p{PLACES[-1]}") if by_place else null("long")).alias("last_place"), (F.col("tokens") < 2 * F.col("gap")).alias("with_last"))
    plan = per.withColumnRenamed("source", "of").join(bound, F.col("of").eqNullSafe(F.col("at")), "left").drop("at")
    return written(plan, "thresholds"), by_place


def _copies(most: int) -> Column:
    """How often a row is taken: by its source's threshold."""
    last = F.when(F.col("last_place").isNull() | (F.col("place") == F.col("last_place")), F.col("with_last")).otherwise(F.col("place") < F.col("last_place"))
    last = F.when(F.col("last_what").isNull(), F.col("with_last")).when(F.col("what") == F.col("last_what"), last).otherwise(F.col("what") < F.col("last_what"))
    more = F.when(F.col("last_hash").isNull(), F.lit(True)).when(F.col("hash") == F.col("last_hash"), last).otherwise(F.col("hash") < F.col("last_hash"))
    return F.least(F.col("whole") + more.cast("long"), F.lit(most))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for every row of ``docs``.

    size is the text's number of words; taken = size * copies, where copies is 0 to
    ``most``.  A source's taken words differ from its target by half of one
    document's size at most.  Of repeated rows as many are taken as come nearest; which
    of them does not matter, as they are equal.  A null source is a source, a null text
    has size 0, a source without words has target 0.  Rows without doc_id are told
    apart by their texts.  An empty table gives an empty result; other columns are
    left out.
    """
    docs = plain(docs, doc_id=docs[f"`{id_col}`"].cast("long"), text=docs[f"`{text_col}`"].cast("string"), source=docs[f"`{source_col}`"].cast("string"))
    rows = _rows(docs, F.monotonically_increasing_id())
    plan, _ = thresholds(rows, weights, share, most)
    out = rows.join(_near(plan), F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies(most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as ``mix`` takes it.

    Rows are filtered where they stand, by their sources' thresholds; no text is moved.
    """
    names, text = docs.columns, docs[f"`{text_col}`"].cast("string")
    # the row as one column, so that no name of its own can clash with ours
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), docs[f"`{id_col}`"].cast("long").alias("doc_id"), text.alias("text"), docs[f"`{source_col}`"].cast("string").alias("source"))
    plan, by_place = thresholds(_rows(held, F.monotonically_increasing_id()), weights, share, most)
    held = held.withColumn("place", F.lit(0).cast("long"))
    if by_place:  # the places must be the same ones when the rows are taken
        held = written(held.withColumn("place", F.monotonically_increasing_id()), "placed")
        plan, _ = thresholds(_rows(held, F.col("place")), weights, share, most)
    rows = held.select("row", "source", "place", _hash(F.col("doc_id"), F.col("text")).alias("hash"), _what(F.col("doc_id"), F.col("text")).alias("what"))
    taken = rows.join(_near(plan), F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies(most)).where("copies > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in names])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, '')) AS what,
    CAST('0x' || substr(md5(what), 1, 9) AS BIGINT) AS hash
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3, 1, 2][(row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 + 1] AS weight
  FROM rows_ GROUP BY source
), levels AS (
  SELECT *, 2 * source_size AS most, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - coalesce(sum(2 * source_size) OVER (
      ORDER BY 2 * source_size / weight, (source IS NULL), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, (source IS NULL), source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), targets AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), (SELECT max(level) FROM levels WHERE level * weight <= most) * weight) AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), running AS (
  SELECT r.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS gap,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.hash, r.what ROWS UNBOUNDED PRECEDING) AS up_to, r.size AS own
  FROM rows_ r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * least(2, whole + CASE WHEN up_to <= gap OR (up_to - own <= gap AND own < 2 * (gap - (up_to - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""
