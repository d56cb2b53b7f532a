"""Reading documents: whole files, columns of tables, and the repeated elements of huge files; SQL views of the results."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators.shred import shred
from ..plans.validation import violations
from ..schema.tree import Malformed, parse


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, xml): one row a file of ``path``, doc_id being where it lies."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("xml"))


def column(df: DataFrame, xml_col: str, id_col: str) -> DataFrame:
    """(doc_id, xml) from a table's columns."""
    return df.select(df[f"`{id_col}`"].alias("doc_id"), df[f"`{xml_col}`"].cast("string").alias("xml"))


def elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(doc_id, xml): one row for each element ``tag`` of files of any size; doc_id is the file and the element's number there.

    Files are read in blocks of pieces that begin with a "<".  A block gives the
    elements it holds whole; only what its edges cut goes to the task that joins it.
    For elements that do not nest in themselves; one in a comment or CDATA section
    counts as well, and one that the file's end cuts off is left out.  An empty file
    gives no rows.
    """
    name = re.escape(tag)
    begins, ends = rf"^{name}(?=[\s/>])", rf"^/{name}\s*>"
    alone = rf"^{name}(?:\s+[^\s=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*/>"
    read = spark.read.option("lineSep", "<").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = read.groupBy("file", "block").agg(F.count_if(F.col("value").rlike(begins)).alias("n"))
    before = before.select("file", "block", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    parts = read.mapInArrow(_parts(begins, ends, alone), "file string, block long, k long, whole boolean, xml string").join(before, ["file", "block"])
    parts = parts.withColumn("number", F.col("before") + F.col("k"))
    whole = parts.where("whole AND k > 0").select("file", "number", "xml")
    cut = parts.where("NOT whole OR k = 0").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "k", "whole", "xml"))).alias("p"))
    last = F.array_position(F.transform("p", lambda x: x["whole"]), True).cast("int")
    cut = cut.where((F.get("p", F.lit(0))["k"] > 0) & (last > 0))
    cut = cut.select("file", "number", F.array_join(F.transform(F.slice("p", F.lit(1), last), lambda x: x["xml"]), "").alias("xml"))
    return whole.union(cut).select(F.concat("file", F.lit("#"), "number").alias("doc_id"), "xml")


def _parts(begins: str, ends: str, alone: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a block's pieces in order: its k-th element, or as much as it holds of it; 0 is what goes on from an earlier block."""
    first, last, both = (re.compile(p, re.S) for p in (begins, ends, alone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        k, open_, held = 0, False, []
        out: list[tuple] = []

        def give(whole: bool) -> None:
            nonlocal open_, held
            if at is not None and open_ and (k or at[1]):
                out.append((*at, k, whole, "".join(held)))
            open_, held = False, []

        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (file, block):
                    give(False)
                    at, k, open_ = (file, block), 0, True
                if first.match(value):
                    give(False)
                    k, open_ = k + 1, True
                    if m := both.match(value):
                        held = ["<", m[0]]
                        give(True)
                        continue
                if open_ and (m := last.match(value)):
                    held += ["<", m[0]]
                    give(True)
                elif open_:
                    held += ["<", value]
            yield _rows(out)
            out.clear()
        give(False)
        yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "block": pa.int64(), "k": pa.int64(), "whole": pa.bool_(), "xml": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.values())], list(kinds))


@udtf(returnType="node_id int, tag_name string, text_content string")
class ShredXml:
    """SELECT ... FROM documents, LATERAL shred_xml(xml): the elements of a document, none for a malformed one."""

    def eval(self, xml: str) -> Iterator[tuple]:
        try:
            root = parse(xml or "")
        except Malformed:
            return
        for n in (root, *root.below()):
            yield n.number, n.tag, n.content()


def register_sql(spark: SparkSession, df: DataFrame, xsd: str, xml_col: str = "xml", id_cols: list[str] | None = None) -> None:
    """Temporary views ``nodes`` and ``violations`` of df, and the table function shred_xml."""
    shred(df, xml_col, id_cols).createOrReplaceTempView("nodes")
    violations(df, xsd, xml_col, id_cols).createOrReplaceTempView("violations")
    spark.udtf.register("shred_xml", ShredXml)


#: Bytes of files for each of the cluster's cores up to which documents are dealt out anew.
SMALL = 16 << 20


def spread(docs: DataFrame, *paths: str) -> DataFrame:
    """docs, dealt out to all cores where the files they come from are so small that a few tasks would read them.

    Parsing takes far longer than the exchange of a little text.  Files of more than
    SMALL bytes a core give enough tasks by themselves, and then nothing is shuffled.
    """
    spark = docs.sparkSession
    conf, total = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        total += at.getFileSystem(conf).getContentSummary(at).getLength()
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if total <= SMALL * cores else docs
