"""Token ids in Arrow IPC files of fixed-size-list batches.

A file holds one range of the document order: record batches with two columns,
`ids` and `mask`, both fixed-size lists of `length`. Ids run on from document to document;
only a file's last sequence is padded (mask false). Buffers are not compressed, so a
mapped file gives any sequence, its mask and any document without a copy: ids as a numpy
view, the mask as an Arrow array over the file's own bits. Beside it an
index file has (doc_id, start, n_tokens) of the file's documents. Writers use a name of
their own and rename at the end, so a repeated task replaces a file by an equal one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scale import materialize, new_path, parts
from .tokens import encoder, tokenizer_path

LENGTH = 2048
BATCH = 64
END_ID = 1
FILES = "first_id long, part int, path string, n_docs long, n_tokens long"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _schema(length: int, dtype: str) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(dtype)), length)), ("mask", pa.list_(pa.bool_(), length))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Collects ids and writes them as fixed-size-list batches of `batch` sequences."""

    def __init__(self, sink, length: int, dtype: str, batch: int):
        self.schema, self.length, self.dtype, self.step = _schema(length, dtype), length, np.dtype(dtype), batch * length
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held, self.n_held, self.n = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // self.dtype.itemsize
        self.n += len(ids) // self.dtype.itemsize
        if self.n_held >= self.step:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            whole = len(flat) // self.step * self.step
            for s in range(0, whole, self.step):
                self._batch(flat[s : s + self.step], self.step)
            self.held, self.n_held = [flat[whole:].tobytes()], len(flat) - whole

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:real] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            self._batch(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.writer.close()


class SequenceFile:
    """Random access to one file: by sequence, or to any run of ids."""

    def __init__(self, path: str):
        fs, at = _fs(path)
        #: a mapped file's whole content as one buffer (None in a remote store)
        self.source = pa.memory_map(at).read_buffer() if fs.type_name == "local" else None
        self.file = pa.ipc.open_file(fs.open_input_file(at) if self.source is None else self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.step = self.file.get_batch(0).num_rows * self.length if self.file.num_record_batches else 1
        self.last = (-1, None)

    def _flat(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            self.last = (k, self.file.get_batch(k).column(0).flatten().to_numpy())
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of the i-th sequence; both are views of the file's bytes."""
        k, j = divmod(i, self.step // self.length)
        row = self.file.get_batch(k).slice(j, 1)
        return row.column(0).flatten().to_numpy(), row.column(1).flatten()

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        while n:
            k, at = divmod(start, self.step)
            got = self._flat(k)[at : at + n]
            yield got
            start, n = start + len(got), n - len(got)


def write_tokens(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str | None = None,
    length: int = LENGTH,
    batch: int = BATCH,
    end_id: int = END_ID,
    dtype: str = "<u2",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every whole text in ascending doc_id order and write the files.

    Returns one row a file (see FILES) of a stored table. A null text is its end id alone; null
    doc_ids come first; rows that repeat a doc_id are written in the order of their texts.
    `dtype` must hold every id of the vocabulary (else encoding raises). Other columns
    are ignored. An empty table gives no files.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    folder = folder or new_path(spark, "tokens")
    end = np.array([end_id], dtype).tobytes()
    size = np.dtype(dtype).itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        enc, fs_at, index, out = encoder(path, dtype), None, [], None
        name = f"part-{ctx.partitionId():06d}"
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None:
                    fs, at = fs_at = _fs(folder)
                    fs.create_dir(at, recursive=True)
                    own = f"{at}/.{name}-{ctx.taskAttemptId()}"
                    sink = fs.open_output_stream(own)
                    out = SequenceWriter(sink, length, dtype, batch)
                ids = enc(text.as_py()) + end
                index.append((i, out.n, len(ids) // size))
                out.add(ids)
        if out is None:
            return
        out.close()
        sink.close()
        rows = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*index)], schema=_INDEX)
        with fs.open_output_stream(own + "-index") as sink, pa.ipc.new_file(sink, _INDEX) as w:
            w.write_batch(rows)
        fs.move(own, f"{at}/{name}.arrow")
        fs.move(own + "-index", f"{at}/{name}.index.arrow")
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((index[0][0], pa.int64()), (ctx.partitionId(), pa.int32()), (f"{folder}/{name}", pa.string()), (len(index), pa.int64()), (out.n, pa.int64()))],
            ["first_id", "part", "path", "n_docs", "n_tokens"],
        )

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = d.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, FILES), "files", release=True)


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    `files` is what `write_tokens` returns, one row a file; start counts the ids of all
    documents before, over all files.
    """
    spark = files.sparkSession
    rows, base, n = [], 0, 0
    for r in sorted(files.collect(), key=lambda r: (r["first_id"] is not None, r["first_id"] or 0, r["part"])):
        rows.append((r["path"], base))
        base, n = base + r["n_tokens"], n + 1
    todo = spark.createDataFrame(rows, "path string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = _fs(path + ".index.arrow")
                with fs.open_input_file(at) as source:
                    index = pa.ipc.open_file(source).read_all()
                data = SequenceFile(path + ".arrow")
                crcs = []
                for s, k in zip(index["start"].to_pylist(), index["n_tokens"].to_pylist()):
                    c = 0
                    for part in data.ids(s, k):
                        c = zlib.crc32(part.astype("<u4").tobytes(), c)
                    crcs.append(c)
                start = np.array(index["start"]) + base
                yield pa.RecordBatch.from_arrays(
                    [index["doc_id"].combine_chunks(), pa.array(start), index["n_tokens"].combine_chunks(), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return todo.repartition(max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
