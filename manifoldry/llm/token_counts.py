"""Token counts from flat token files without an index.

A file holds little-endian unsigned 16-bit ids, each document's followed by an end id, and nothing else. Spark's text
reader cuts files at any size into splits, at the end id's two bytes wherever they stand; where ids begin is not known
there. Blocks of a split are searched for the end id by themselves, all at once, for both ways that ids can lie; a
prefix scan over the blocks' summaries then says which it is, stitches the documents that cross block boundaries, and
numbers them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manifoldry.llm import tokens
from manifoldry.llm.common import materialise, new_path, read, task

END = 50256


def _separator(end: int) -> bytes:
    """The end id's bytes. They must differ: only then does no id equal to `end` lie across two blocks."""
    separator = int(end).to_bytes(2, "little")
    if separator[0] == separator[1]:
        raise ValueError("the end id's two bytes must differ")
    return separator


def flatten(batches, path: str, pattern: str, end: int):
    """The ids of each text as bytes, without the end id."""
    coder = tokens.Coder(path, pattern)
    for block in tokens.blocks(batches):
        ids, starts = coder.encode(block.column("text"), end)
        data = ids.astype("<u2").tobytes()
        offsets = starts.tolist()
        values = [data[2 * a : 2 * (b - 1)] for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])


def write_token_files(docs: DataFrame, out: str, path: str, pattern: str, end: int = END) -> None:
    """Flat token files in `out`, one a partition. The text writer puts its line separator, here the end id, after each row.

    A null text is an empty document; repeated rows are documents each; an empty table gives no file with documents. The
    documents of partition n are those of file part-n, in order (`document_ids`), so a limit of rows a file does not hold
    here. A document's ids are one line, of less than 2 GB.
    """
    rows = docs.select("text").mapInArrow(task(__name__, "flatten", tokens.vocabulary(docs.sparkSession, path), pattern, end), "value binary")
    options = {"encoding": "ISO-8859-1", "lineSep": _separator(end).decode("latin-1")}
    rows.select(F.col("value").cast("string")).write.options(**options).option("maxRecordsPerFile", 0).text(out)


def document_ids(docs: DataFrame) -> DataFrame:
    """part, doc_no, doc_id of what `write_token_files` writes for `docs`, a table whose partitions are the same each time it is read.

    `paired` finds out whether they were.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return docs.select(F.spark_partition_id().alias("part"), within.alias("doc_no"), F.col("doc_id").cast("long").alias("doc_id"))


def scan(batches, end: int):
    """For each block, which is what a batch has of a split: its bytes, and where end ids begin if ids lie at even bytes, or at odd ones."""
    separator, last, number = _separator(end), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, at = batch.column("file").to_pylist(), batch.column("at").to_numpy()
        code = batch.column("file").dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (at[1:] != at[:-1])) + 1).tolist(), batch.num_rows]
        rows = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            number = number + 1 if last == (file[s], int(at[s])) else 0
            last = (file[s], int(at[s]))
            data = separator.join(batch.column("value").slice(s, e - s).to_pylist()) + separator
            even, odd = (np.flatnonzero(np.frombuffer(data, "<u2", (len(data) - k) // 2, k) == end) * 2 + k for k in (0, 1))
            rows.append((*last, number, batch.column("size")[s].as_py(), len(data), even.tolist(), odd.tolist()))
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["file", "at", "number", "size", "n", "even", "odd"])


def count_tokens(spark: SparkSession, folder: str, end: int = END) -> DataFrame:
    """file, doc_no, start, n_tokens, ended: a row for each document of each token file in `folder`, of any size.

    An empty document counts 0 tokens. Ids after a file's last end id are a document with ended = false; a last odd byte
    is no id. Empty files have no documents.
    """
    options = {"encoding": "ISO-8859-1", "lineSep": _separator(end).decode("latin-1")}
    lines = spark.read.options(**options).text(folder)
    meta = [F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size")]
    raw = lines.select(F.col("value").cast("binary").alias("value"), *meta)
    found = raw.mapInArrow(task(__name__, "scan", end), "file string, at long, number int, size long, n long, even array<long>, odd array<long>")
    found = materialise(found, "ends")
    # Summaries alone, a row for each block, are in a file's order.
    order = Window.partitionBy("file").orderBy("at", "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    chosen = lambda f: F.when(F.col("begin") % 2 == 0, f(F.col("even"))).otherwise(f(F.col("odd")))
    told = found.select("file", "at", "number", "n", *[F.struct(F.size(c).cast("long").alias("n"), F.array_max(c).alias("last")).alias(c) for c in ("even", "odd")])
    told = told.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    told = told.select("file", "at", "number", "begin", F.lead("at").over(order).isNull().alias("final"), chosen(lambda c: c["n"]).alias("n_ends"), F.shiftright(F.col("begin") + chosen(lambda c: c["last"]), 1).alias("last"))
    told = told.select("file", "at", "number", "begin", "final", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("end_before"))
    stitched = found.join(told, ["file", "at", "number"]).withColumn("total", F.shiftright("size", 1))
    ends = F.transform(chosen(lambda c: c), lambda x: F.shiftright(F.col("begin") + x, 1))
    # Nothing need stand after the file's last document: an end id beyond the file is none.
    stitched = stitched.withColumn("ends", F.filter(ends, lambda x: x < F.col("total")))
    open_ended = F.col("final") & (F.col("total") > F.coalesce(F.array_max("ends"), F.col("end_before")) + 1)
    stitched = stitched.withColumn("ends", F.when(open_ended, F.concat("ends", F.array("total"))).otherwise(F.col("ends")))
    rows = stitched.select("file", "docs_before", "end_before", "total", "ends", F.posexplode("ends").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("end_before")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    return rows.select("file", (F.col("docs_before") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("stop") < F.col("total")).alias("ended"))


def paired(counted: DataFrame, ids: DataFrame) -> DataFrame:
    """Counts with document ids. Files that do not hold just as many documents as their partitions had rows are an error."""
    counted = materialise(counted.withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("int")), "counts")
    ids = materialise(ids, "document-ids")
    documents = F.count_if("ended").alias("docs"), F.countDistinct("file").alias("files"), F.count_if(~F.col("ended")).alias("open")
    told = counted.groupBy("part").agg(*documents).join(ids.groupBy("part").agg(F.count("*").alias("rows")), "part", "full")
    wrong = told.where(~(F.col("docs").eqNullSafe(F.col("rows")) & (F.col("files") == 1) & (F.col("open") == 0))).orderBy("part").head(1)
    if wrong:
        raise ValueError(f"token files and documents do not pair off: {wrong[0].asDict()}")
    return counted.drop("file").join(ids, ["part", "doc_no"]).select("doc_id", "part", "doc_no", "start", "n_tokens", "ended")


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, out = read(spark, sf_dir, "documents"), new_path(spark, "token-files")
    write_token_files(docs, out, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return paired(count_tokens(spark, out), document_ids(docs))
