"""Token-id files: Arrow files of equal-length sequences with masks, and an index of documents.

A file holds record batches with one row per sequence: ``ids``, a fixed-size list of
``length`` unsigned integers, and ``mask``, a fixed-size list of booleans. Documents
follow each other without gaps; only the last sequence of a file is padded, and the
mask is false there. A second file ends in ``.docs.arrow`` and holds ``doc_id``, the
document's first place in the stream of its file, and its number of ids. Buffers are
uncompressed and ids take 16 bits when the vocabulary allows it, so a mapped file gives
any sequence without copying.

Part files carry a name of their own for every attempt of a task. The manifest, which
lists the files of successful attempts with their place in the whole stream, is what
readers go by, so lost executors and repeated tasks leave nothing wrong behind.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.bytewords import text_bytes
from gaugeline.llm.support import batches_by_bytes, ship, shuffle_parts

BATCH_SEQUENCES = 1024


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def qualified(spark: SparkSession, folder: str) -> str:
    """A path without a scheme belongs to the session's file system, which tasks cannot ask for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return folder if whole.startswith("file:") else whole


def sequence_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])


class SequenceWriter:
    """Writes ids as they come into batches of whole sequences."""

    def __init__(self, sink, length: int, kind: pa.DataType):
        self.schema, self.length = sequence_schema(length, kind), length
        self.kind = kind.to_pandas_dtype()
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        whole = self.length * BATCH_SEQUENCES
        if self.size >= whole:
            flat = np.concatenate(self.held)
            for first in range(0, len(flat) - whole + 1, whole):
                self._write(flat[first : first + whole], whole)
            self.held = [flat[len(flat) - len(flat) % whole :]]
            self.size = len(self.held[0])

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = pa.array(np.arange(len(flat)) < used)
        lists = [pa.FixedSizeListArray.from_arrays(values, type=field.type) for values, field in zip((pa.array(flat), mask), self.schema)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of one file."""

    def __init__(self, path: str):
        system, name = _open(path)
        local = isinstance(system, fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(name) if local else system.open_input_file(name))
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = self.reader.num_record_batches

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids as a matrix that shares the file's memory, and the mask."""
        got = self.reader.get_batch(k)
        ids = got.column("ids").flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length)
        return ids, got.column("mask").flatten().to_numpy(zero_copy_only=False).reshape(-1, self.length)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(row // BATCH_SEQUENCES)
        return ids[row % BATCH_SEQUENCES], mask[row % BATCH_SEQUENCES]

    def stream(self) -> Iterator[np.ndarray]:
        """The real ids, batch by batch."""
        for k in range(self.batches):
            ids, mask = self.batch(k)
            yield ids.ravel()[: int(mask.sum())]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 2048, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every text, write the files in ascending ``doc_id`` order, return the manifest.

    One row per file: ``part``, ``path``, ``n_docs``, ``n_tokens`` and ``start``, the ids in
    all files before it. Documents are range-partitioned by ``doc_id`` and a hash of the text,
    so a part holds a share of them whatever the ids are; rows with equal ids follow each
    other by that hash, null ids come first. A folder without a scheme is one of the session's
    file system. A null text is empty and leaves its end id only. An empty
    table gives no files. Columns other than the two are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = qualified(spark, folder)
    system, name = _open(folder)
    system.create_dir(name, recursive=True)

    def write(batches):
        from gaugeline.llm.unit_tokens import file_encoder

        batches = iter(batches)
        encoder = file_encoder(tokenizer)
        top = max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        kind = pa.uint16() if top <= 1 << 16 else pa.uint32()
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        keys, sizes, writer, system = [], [], None, _open(folder)[0]
        for batch in batches_by_bytes(batches, "text"):
            if writer is None:
                sink = system.open_output_stream(_open(f"{path}.arrow")[1])
                writer = SequenceWriter(sink, length, kind)
            ids, at = encoder(*text_bytes(batch.column("text")))
            writer.add(np.insert(ids, at[1:], end_id))
            keys.append(batch.column("doc_id"))
            sizes.append(np.diff(at) + 1)
        if writer is None:
            return
        writer.close()
        sink.close()
        n = np.concatenate(sizes).astype(np.int64)
        index = pa.table({"doc_id": pa.chunked_array(keys), "first": np.cumsum(n) - n, "n": n})
        with system.open_output_stream(_open(f"{path}.docs.arrow")[1]) as out, pa.ipc.new_file(out, index.schema) as file:
            file.write_table(index)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(n)], "n_tokens": [int(n.sum())]})

    files = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shuffle_parts(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
        .mapInArrow(write, "part long, path string, n_docs long, n_tokens long")
        .collect()
    )
    rows, start = [], 0
    for f in sorted(files):
        rows.append((*f, start))
        start += f["n_tokens"]
    return spark.createDataFrame(rows, "part long, path string, n_docs long, n_tokens long, start long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: its place in the whole stream, ids and their checksum."""
    ship(manifest.sparkSession)

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                system, name = _open(f"{path}.docs.arrow")
                with system.open_input_file(name) as source:
                    index = pa.ipc.open_file(source).read_all()
                n, first = index["n"].to_numpy(), index["first"].to_numpy()
                stream, held, base, crcs = SequenceFile(f"{path}.arrow").stream(), np.zeros(0, np.uint16), 0, []
                for at, size in zip(first.tolist(), n.tolist()):
                    crc = 0
                    while size:
                        if at - base >= len(held):
                            base += len(held)
                            held = next(stream)
                        piece = held[at - base : at - base + size]
                        crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        at, size = at + len(piece), size - len(piece)
                    crcs.append(crc)
                yield from pa.table(
                    {"doc_id": index["doc_id"], "start": first + start, "n_tokens": n, "ids_crc32": pa.array(crcs, pa.int64())}
                ).to_batches()

    spread = manifest.select("path", "start").repartition(shuffle_parts(manifest.sparkSession))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

