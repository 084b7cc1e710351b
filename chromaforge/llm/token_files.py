"""Token ids as Arrow files of equal-length sequences.

Documents are range-partitioned by id; each partition writes one shard: an Arrow file whose record batches hold
two fixed-size-list columns, ``ids`` (uint16 for vocabularies that it holds, else uint32) and ``mask`` (bits: whether
a token stands there, or filling at the shard's end), and a second Arrow file with each document's id, start and
length in the shard. A memory-mapped shard gives any sequence and its mask as views without a copy.

The number of shards follows the size of the texts, so a shard holds about as much on any table: what is shuffled is
texts, which are no larger than their ids, and each is encoded once, by the task that writes its shard. Shards lie in
the folder that driver and executors share. A task that is run again writes a new file under a new name; only files
named by the finished job count.

Defined cases: null is the empty text, whose only id is the end id; rows with one id follow each other in the order
of a hash of their text (so very many of them, or of rows without an id, are still several shards), null ids come
first; exact repeats of a row are rows like others; an empty table gives no documents; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ASCII_WORDS, shared_encoder, slices
from .common import map_arrow, materialize, shared_dir

BATCH = 256  # sequences in a record batch


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _ShardWriter:
    """Writes one shard batch by batch."""

    def __init__(self, uri: str, length: int, id_type: pa.DataType, token: np.dtype):
        self.fs, path = _filesystem(uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.length, self.total, self.token = length, 0, np.dtype(token)
        kind = [("ids", pa.list_(pa.from_numpy_dtype(self.token), length)), ("mask", pa.list_(pa.bool_(), length))]
        self.schema = pa.schema(kind)
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out, self.index_out = self.fs.open_output_stream(path), self.fs.open_output_stream(path + ".index")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.index = pa.ipc.new_file(self.index_out, self.index_schema)
        self.ids = np.empty(0, self.token)

    def _write(self, ids: np.ndarray, filling: int = 0) -> None:
        mask = np.ones(len(ids) + filling, bool)
        mask[len(ids) :] = False
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (np.pad(ids, (0, filling)), mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, end_id: int) -> None:
        """Append documents: flat ids with the number of each document's, without end ids."""
        ends = np.cumsum(counts + 1)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, self.token)
        last = np.zeros(len(flat), bool)
        last[ends - 1] = True
        flat[~last] = ids
        flat[last] = end_id
        starts = self.total + ends - (counts + 1)
        self.index.write_batch(
            pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(counts + 1)], schema=self.index_schema)
        )
        self.total += len(flat)
        self.ids = np.concatenate([self.ids, flat])
        step = BATCH * self.length
        whole = len(self.ids) // step * step
        for at in range(0, whole, step):
            self._write(self.ids[at : at + step])
        self.ids = self.ids[whole:]

    def close(self) -> None:
        if len(self.ids):
            self._write(self.ids, -len(self.ids) % self.length)
        for x in (self.file, self.index, self.out, self.index_out):
            x.close()


class Shard:
    """A shard read by memory map where the file is local, else through its file system."""

    def __init__(self, uri: str):
        files, path = _filesystem(uri)
        local = files.type_name == "local"
        self._source = pa.memory_map(path) if local else files.open_input_file(path)
        self._index = pa.memory_map(path + ".index") if local else files.open_input_file(path + ".index")
        self.file, self.index = pa.ipc.open_file(self._source), pa.ipc.open_file(self._index)
        self.length = self.file.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence i as views."""
        batch = self.file.get_batch(i // BATCH)
        at = i % BATCH * self.length
        ids, mask = (batch.column(c).values for c in (0, 1))
        return ids.to_numpy()[at : at + self.length], mask.slice(at, self.length)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop, which may span batches."""
        step = BATCH * self.length
        parts = [
            self.file.get_batch(b).column(0).values.to_numpy()[max(0, start - b * step) : stop - b * step]
            for b in range(start // step, -(-stop // step))
        ]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)


def write(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    length: int = 1024,
    shard_bytes: int = 256 << 20,
    least_bytes: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Write docs' ids; a row for each shard: shard, uri, n_docs, n_tokens and the start of its first token.

    A shard takes about shard_bytes of text; on small tables less, down to least_bytes, so that all cores have one.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(-(-size // shard_bytes), min(4 * spark.sparkContext.defaultParallelism, size // least_bytes), 1)
    ordered = d.repartitionByRange(n, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").drop("text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        encoder = shared_encoder(tokenizer, ASCII_WORDS)
        uri = f"{folder}/shard-{context.partitionId():06d}-{context.taskAttemptId()}.arrow"
        writer, n_docs = None, 0
        for whole in batches:
            for batch in slices(whole, 1):
                token = np.uint16 if encoder.size <= 1 << 16 else np.uint32
                writer = writer or _ShardWriter(uri, length, batch.schema.field(0).type, token)
                ids, counts = encoder.ids(batch.column(1).to_pylist())
                writer.add(batch.column(0), ids, counts, end_id)
                n_docs += batch.num_rows
        if writer:
            writer.close()
            row = [[context.partitionId()], [uri], [n_docs], [writer.total]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in row], ["shard", "uri", "n_docs", "n_tokens"]
            )

    done = map_arrow(ordered, run, "shard long, uri string, n_docs long, n_tokens long")
    done = materialize(done, "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return done.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read(shards: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Documents read back from their shards: doc_id, start (over all shards), n_tokens and the CRC of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["uri"])
                for docs in shard.documents():
                    starts, counts = (docs.column(c).to_numpy() for c in (1, 2))
                    first = int(starts[0]) if len(starts) else 0
                    stop = first + int(counts.sum())
                    ids = shard.tokens(first, stop).astype("<u4", copy=False)
                    crcs = [
                        zlib.crc32(ids[a : a + n])
                        for a, n in zip((starts - first).tolist(), counts.tolist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column(0), pa.array(starts + row["start"]), docs.column(2), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, shards.count())  # a number of tasks of its own: the rows are few, but the files behind them are not
    spread = shards.select("shard", "uri", "start").repartition(n, "shard")
    return map_arrow(spread, run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
