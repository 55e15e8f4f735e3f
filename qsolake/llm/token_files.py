"""Token-ID output: Arrow IPC files whose batches are fixed-size lists, read back without copying.

Documents are range-sorted by id, encoded once, and every task writes its own two files into the shared folder:
NAME.tokens.arrow has equal-length sequences (ids and a validity mask, both fixed_size_list) and
NAME.docs.arrow the place of each document in them. A task returns one manifest row, so files of a failed or
repeated attempt are never referred to. Ids are stored in the narrowest unsigned type that holds the vocabulary.

Defined cases: a null or empty text is its end id alone; rows with a null id come first; rows that repeat an id
are each written, ordered by the hash of their text; an id that is no integer is refused; an empty table gives no file and no row; other columns are ignored."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qsolake.llm.common import new_path, short_batches, tasks, tidied, written
from qsolake.llm.tokens import default_tokenizer, encoder

SEQUENCE = 2048
#: Sequences of one record batch.
BATCH = 128
MANIFEST = "part int, tokens_file string, docs_file string, n_docs long, n_tokens long"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def opened(uri: str) -> pa.ipc.RecordBatchFileReader:
    """The file, memory-mapped where it is local."""
    url = urlparse(uri)
    if url.scheme in ("", "file"):
        return pa.ipc.open_file(pa.memory_map(url.path))
    system, path = filesystem(uri)
    return pa.ipc.open_file(system.open_input_file(path))


def sequences(uri: str) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """For each record batch a view of its ids (sequences x length) and its masks."""
    reader = opened(uri)
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        ids = batch.column(0)
        yield ids.flatten().to_numpy(zero_copy_only=True).reshape(len(ids), -1), batch.column(1)


class _Writer:
    """Streams ids into fixed-size-list batches."""

    def __init__(self, uri: str, dtype: np.dtype, length: int):
        system, path = filesystem(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.length, self.dtype = length, dtype
        self.schema = pa.schema(
            [("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))]
        )
        self.sink = system.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.n_held, self.total = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // self.dtype.itemsize
        self.total += len(ids) // self.dtype.itemsize
        if self.n_held >= BATCH * self.length:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            full = len(flat) // (BATCH * self.length) * BATCH * self.length
            for at in range(0, full, BATCH * self.length):
                self._batch(flat[at : at + BATCH * self.length])
            self.held, self.n_held = [flat[full:].tobytes()], len(flat) - full

    def _batch(self, flat: np.ndarray) -> None:
        n = len(flat)
        rows = -(-n // self.length)
        padded = np.zeros(rows * self.length, self.dtype)
        padded[:n] = flat
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, np.arange(len(padded)) < n)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self._batch(np.frombuffer(b"".join(self.held), self.dtype))
        self.writer.close()
        self.sink.close()


def write_token_files(
    docs: DataFrame,
    folder: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    length: int = SEQUENCE,
) -> DataFrame:
    """Write all documents in ascending order of id and return the manifest (one row for each task's files)."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    tokenizer = tokenizer or default_tokenizer()
    id_type = docs.select(F.col(id_col).alias("id")).dtypes[0][1]
    if id_type not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} is {id_type}; token files need an integer id")
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(tokenizer), TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}"
        tokens = index = sink = None
        n_docs = 0
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            if tokens is None:
                tokens = _Writer(f"{name}.tokens.arrow", code.dtype, length)
                system, path = filesystem(f"{name}.docs.arrow")
                sink = system.open_output_stream(path)
                schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(sink, schema)
            end = np.array([end_id], code.dtype).tobytes()
            starts, counts = [], []
            for text in batch.column(1).to_pylist():
                ids = code.ids(text) + end
                starts.append(tokens.total)
                counts.append(len(ids) // code.dtype.itemsize)
                tokens.add(ids)
            index.write_batch(
                pa.record_batch([batch.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=schema)
            )
            n_docs += batch.num_rows
        if tokens is not None:
            tokens.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "tokens_file": [f"{name}.tokens.arrow"], "docs_file": [f"{name}.docs.arrow"], "n_docs": [n_docs], "n_tokens": [tokens.total]}
            )

    rows = short_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("hash"))
    ranges = rows.repartitionByRange(tasks(spark), "id", "hash").sortWithinPartitions("id", "hash", "text")
    return written(ranges.select("id", "text").mapInArrow(tidied(write), MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the files."""
    spark = manifest.sparkSession
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, began = np.zeros(0, np.uint32), 0, 0  # the part of the file that is at hand, from began on
                views = sequences(row["tokens_file"])
                index = opened(row["docs_file"])
                for i in range(index.num_record_batches):
                    docs = index.get_batch(i)
                    out = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                        parts = [ids[start - began :]]
                        while at < start + n:
                            flat = next(views)[0].reshape(-1)
                            at += len(flat)
                            parts.append(flat)
                        if len(parts) > 1:
                            ids, began = np.concatenate(parts), start
                        out.append(ids[start - began : start - began + n].astype("<u4").tobytes())
                    starts = pa.array(docs.column(1).to_numpy() + row["base"], pa.int64())
                    for k in range(0, len(out), 1000):
                        yield pa.RecordBatch.from_arrays(
                            [docs.column(0).slice(k, 1000).cast(pa.int64()), starts.slice(k, 1000), docs.column(2).slice(k, 1000), pa.array(out[k : k + 1000], pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    files = manifest.withColumn("base", base).repartition(tasks(spark), "part")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
