"""Token counts of documents in flat, unindexed token files, by a vectorised separator scan.

A flat file is nothing but identifiers (little-endian unsigned 16-bit), every document followed by the end-of-document
identifier: no header, no index. Files are read in blocks of fixed size that ignore documents. Each block finds its separators with one
numpy comparison; a prefix scan over the blocks of a file (a running maximum of the last separator's place, a running sum of
separators) then tells every block where the document open at its start began and how many ended before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import text_buffer
from loomgraph.llm.tokens import WordTokenizer, default_tokenizer
from loomgraph.storage import materialize, new_path

#: Identifiers in a block.
BLOCK = 1 << 21
END_OF_TEXT = 49_407  # fixed value: <|endoftext|> of the default tokenizer


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _write_part(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"  # an attempt's own file: a lost attempt's is never read
        words = WordTokenizer.at(tokenizer, literal=True)  # so that only documents end with end_id
        if max(len(words.ends) - 1, end_id) > 65_535:
            raise ValueError("the tokenizer's identifiers need more than 16 bits")
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        tokens, place = 0, 0
        rows: list = []
        with fs.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                raw, offsets = text_buffer(batch.column(1))
                for lo, hi, ids, offs in words.encode(raw, offsets):
                    flat = np.full(len(ids) + hi - lo, end_id, "<u2")
                    at = np.arange(len(ids)) + np.repeat(np.arange(hi - lo), np.diff(offs))
                    flat[at] = ids
                    out.write(flat.tobytes())
                    tokens += len(flat)
                    rows.append((batch.column(0).slice(lo, hi - lo), np.arange(place, place + hi - lo)))
                    place += hi - lo
        for ids, ordinal in rows:
            yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(ids)), pa.array(ordinal, pa.int64()), pa.array(np.full(len(ids), tokens), pa.int64())], names=["doc_id", "file", "ordinal", "file_tokens"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_OF_TEXT) -> DataFrame:
    """Write each partition of docs (doc_id, text) as one flat file in `folder` (any URI pyarrow can open, shared by all
    executors). Returns the manifest: doc_id, file, ordinal (the document's place among the file's), file_tokens."""
    run = _write_part(folder, tokenizer or default_tokenizer(), end_id)
    return materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, file string, ordinal long, file_tokens long"), "manifest")


def _scan_blocks(folder: str, end_id: int, block: int):
    def run(batches):
        fs, path = _open(folder)
        for batch in batches:
            for file, k, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with fs.open_input_file(f"{path}/{file}") as f:
                    f.seek(2 * k * block)
                    ids = np.frombuffer(f.read(2 * min(block, size - k * block)), "<u2")
                at = np.flatnonzero(ids == end_id) + k * block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([int(at[-1]) if len(at) else None], pa.int64()), pa.array([at], pa.list_(pa.int64()))],
                    names=["file", "block", "tokens", "ends", "last_end", "places"],
                )

    return run


def scan_token_files(spark: SparkSession, files: DataFrame, folder: str, end_id: int = END_OF_TEXT, block: int = BLOCK) -> DataFrame:
    """Document lengths in flat files. files: file, file_tokens. Returns file, ordinal, n_tokens (without the separator), ended
    (false for what follows a file's last separator, returned only if there is anything)."""
    n = F.ceil(F.col("file_tokens") / block).cast("long")
    blocks = files.where("file_tokens > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"), "file_tokens")
    found = materialize(blocks.repartition("file", "block").mapInArrow(_scan_blocks(folder, end_id, block), "file string, block long, tokens long, ends long, last_end long, places array<long>"), "scan")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slim = found.select("file", "block", F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("open_at"), F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ended_before"))
    whole = found.join(slim, ["file", "block"])
    starts = F.concat(F.array("open_at"), F.slice("places", 1, F.greatest(F.size("places") - 1, F.lit(0))))
    lengths = F.zip_with("places", starts, lambda end, start: end - start - 1)
    done = whole.where("ends > 0").select("file", "ended_before", F.posexplode(lengths).alias("k", "n_tokens"))
    done = done.select("file", (F.col("ended_before") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = found.groupBy("file").agg(F.sum("tokens").alias("t"), F.sum("ends").alias("ordinal"), F.coalesce(F.max("last_end"), F.lit(-1)).alias("last"))
    rest = rest.where("t - 1 > last").select("file", "ordinal", (F.col("t") - 1 - F.col("last")).alias("n_tokens"), F.lit(False).alias("ended"))
    return done.unionByName(rest)


def token_counts(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_OF_TEXT, block: int = BLOCK, folder: str | None = None) -> DataFrame:
    """Write docs (doc_id, text) to flat token files, scan those, and return doc_id, file, ordinal, n_tokens.

    Null and empty texts are documents of no tokens. Rows repeating a doc_id are counted each. Strings of special tokens in a
    text are ordinary text. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    manifest = write_token_files(docs, folder, tokenizer, end_id)
    files = manifest.groupBy("file").agg(F.max("file_tokens").alias("file_tokens"))
    counts = scan_token_files(spark, files, folder, end_id, block).where("ended")
    return manifest.select("doc_id", "file", "ordinal").join(counts.drop("ended"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
