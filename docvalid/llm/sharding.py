"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

At each level a document draws one number for every child, from a hash of its id
and the child's path, and goes to the child with the least -ln(u) / weight.  A
child's draw depends on nothing but its own path and weight, so where one weight
grows only documents that move into that child leave their place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import plain, quick_partitions, table, written

#: Rows in a bucket in which the places of a shard are counted, about; equal rows made at a time.
BUCKET, RUN = 500_000, 100_000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """``shards`` equal leaves, in whole regions of racks * per_rack; what is over them stands each in a region of its own.

    So a tree of n + 1 shards is that of n with one more region, unless n + 1
    completes a region; 16 and 17 make two whole regions and the latter one more.
    """
    whole = shards // (per_rack * racks) * per_rack * racks
    return [Leaf(f"region{s // (per_rack * racks)}", f"rack{s // per_rack}", s) if s < whole else Leaf(f"region-of-{s}", f"rack-of-{s}", s) for s in range(shards)]


def _draw(key: Column, path: str, weight: float) -> Column:
    hexed = F.substring(F.md5(F.concat(key, F.lit(f"/{path}"))), 1, 13)
    unit = (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(16**13)
    return -F.log(unit) / weight


def _descend(key: Column, leaves: list[Leaf], level: tuple[str, ...] = ("region", "rack", "shard"), path: str = "") -> Column:
    if not level:
        return F.lit(leaves[0].shard)
    children: dict[object, list[Leaf]] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            children.setdefault(getattr(leaf, level[0]), []).append(leaf)
    below = {c: _descend(key, own, level[1:], f"{path}/{c}") for c, own in children.items()}
    if len(children) == 1:
        return next(iter(below.values()))
    draws = {c: _draw(key, f"{path}/{c}", sum(x.weight for x in own)) for c, own in children.items()}
    chosen = F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(i).alias("child")) for i, d in enumerate(draws.values())]))["child"]
    if len(level) == 1:
        return F.element_at(F.array(*[F.lit(c) for c in children]), chosen + 1)
    out = None
    for i, expr in enumerate(below.values()):
        out = F.when(chosen == i, expr) if out is None else out.when(chosen == i, expr)
    return out


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard, as an int, of a key; a null key is the text "null"."""
    if not any(leaf.weight > 0 for leaf in leaves):
        raise ValueError("no shard has a weight above 0")
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), leaves).cast("int")


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    size is the text's UTF-8 bytes plus 1, text_crc32 their CRC-32 (null text: no
    bytes, so 1 and 0).  slot numbers a shard's rows from 0 without gaps, in the
    order of a hash of id, size and checksum, then of these; rows that agree in all are
    counted as one and get neighbouring numbers, so they never gather.  Rows of one
    doc_id go to one shard, whatever their texts, and rows without doc_id too.
    grown_shard is the place in ``grown``, or null without it.
    An empty table gives an empty result; other columns are left out.
    """
    docs = plain(docs, doc_id=docs[f"`{id_col}`"].cast("long"), text=docs[f"`{text_col}`"].cast("string"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = written(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "distinct")
    said = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), leaves), "grown_shard": shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int"), "hash": F.md5(said)})
    buckets = quick_partitions(docs.sparkSession, rows.count(), BUCKET, 16)
    first = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.shiftright(first * buckets, 32))  # in the order of the hashes
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("shard").alias("of"), F.col("bucket").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("hash", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(counts, (F.col("shard") == F.col("of")) & (F.col("bucket") == F.col("in")))
    # equal rows are made where they are few, in runs
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    each = runs.withColumn("k", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("n")) - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at") + F.col("k")).cast("long").alias("slot"), "grown_shard")


def _draw_sql(path: str, weight: float) -> str:
    return f"-ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/{path}'), 1, 13) AS BIGINT) + 0.5) / {16**13}.0) / {weight}"


def _descend_sql(leaves: list[Leaf], level: tuple[str, ...] = ("region", "rack", "shard"), path: str = "") -> str:
    if not level:
        return str(leaves[0].shard)
    children: dict[object, list[Leaf]] = {}
    for leaf in leaves:
        children.setdefault(getattr(leaf, level[0]), []).append(leaf)
    below = [_descend_sql(own, level[1:], f"{path}/{c}") for c, own in children.items()]
    if len(children) == 1:
        return below[0]
    draws = ", ".join(f"{{'draw': {_draw_sql(f'{path}/{c}', sum(x.weight for x in own))}, 'child': {i}}}" for i, (c, own) in enumerate(children.items()))
    return f"CASE list_min([{draws}]).child {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(below))} END"


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), topology(16), topology(17))


#: CRC-32 byte by byte, and the tree's draws as nested choices.
ORACLE_SQL = f"""
WITH table_ AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(x AS BIGINT) FOR x IN range(8)]),
    lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(b))
), bytes_ AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS b FROM documents
), rows_ AS (
  SELECT doc_id, size, CAST(xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]))) AS BIGINT) AS text_crc32 FROM bytes_, table_
), placed AS (
  SELECT *, {_descend_sql(topology(16))} AS shard, {_descend_sql(topology(17))} AS grown_shard FROM rows_
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard, CAST(row_number() OVER (PARTITION BY shard
  ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || size || '/' || text_crc32), doc_id, size, text_crc32) - 1 AS BIGINT) AS slot FROM placed
"""
