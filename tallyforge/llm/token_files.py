"""Operator 13, token-ID output: Arrow files of equal-length sequences and masks, for random access without copies.

A part of the documents, in ascending doc_id order, becomes two Arrow IPC files. One has the token ids: record batches of
``per_batch`` sequences, each a fixed-size list of ``length`` ids (in the smallest unsigned type that holds the
vocabulary) and one of ``length`` mask bits (set for ids, clear for padding). Documents follow each other without gaps,
over the ends of sequences; only a file's last sequence is padded. As all sequences are equally long and all batches but
the last equally full, sequence i is row ``i % per_batch`` of batch ``i // per_batch``, a slice of a memory map or of one range
read. The other file lists the documents: id, first token in the file, number of tokens.

Files are named by task attempt, and a table written by Spark's own commit protocol names those that count, with the
tokens of each; so a task that runs again after a lost executor leaves at worst files that nobody reads. Where a part
begins among all ids is a sum over that table, one row a file. Paths may be of any store that ``pyarrow.fs`` opens by URI.

Edge cases: null and empty texts are a single end id; texts of any length are written whole; rows of one doc_id keep
the order in which the table is read, rows without one come first, and either may fill any number of parts; an
empty table gives no file and no row; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import map_batches, scratch_dir, text_parts
from tallyforge.llm.packing import word_encoder

END_ID = 1
MANIFEST = "part int, tokens string, documents string, n_documents long, n_sequences long, n_tokens long"
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
#: Bytes of ids that the reader hands on at once.
READ_BYTES = 4 << 20


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def sequence_schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(kind), nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


class SequenceWriter:
    """Writes a stream of ids as batches of sequences; ``close`` pads the last one."""

    def __init__(self, sink: pa.NativeFile, kind: np.dtype, length: int, per_batch: int):
        self.schema, self.length, self.step = sequence_schema(kind, length), length, length * per_batch
        self.kind, self.held, self.n_held, self.n_tokens = kind, [], 0, 0
        self.out = pa.ipc.new_file(sink, self.schema)

    def write(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= self.step:
            whole = np.concatenate(self.held)
            for at in range(0, len(whole) - self.step + 1, self.step):
                self._batch(whole[at : at + self.step], self.step)
            rest = whole[len(whole) // self.step * self.step :].copy()
            self.held, self.n_held = [rest], len(rest)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(v, type=f.type) for v, f in zip((pa.array(ids), mask), self.schema, strict=True)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> int:
        """The number of sequences."""
        if self.n_held:
            ids = np.zeros(-(-self.n_held // self.length) * self.length, self.kind)
            ids[: self.n_held] = np.concatenate(self.held)
            self._batch(ids, self.n_held)
        self.out.close()
        return -(-self.n_tokens // self.length)


class SequenceFile:
    """Random access to a file's sequences. Local files are memory-mapped: what is returned are views of the map."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        n = self.reader.num_record_batches
        self.per_batch = self.reader.get_batch(0).num_rows if n else 0
        self.n = (n - 1) * self.per_batch + self.reader.get_batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask of a sequence, not copied."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        batch, row = self.reader.get_batch(i // self.per_batch), i % self.per_batch
        ids, mask = (batch.column(c).values.slice(row * self.length, self.length) for c in (0, 1))
        return ids.to_numpy(), mask

    def batches(self) -> Iterator[tuple[np.ndarray, pa.BooleanArray]]:
        """The ids and masks of a batch's sequences, one after the other."""
        for i in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(i)
            yield batch.column(0).values.to_numpy(), batch.column(1).values

    def close(self) -> None:
        self.source.close()


def write_tokens(docs: DataFrame, tokenizer_path: str, root: str, length: int = 2048, per_batch: int = 256, part_bytes: int = 32 << 20, table_words: int = 500_000) -> DataFrame:
    """Write the documents' ids below ``root`` and return the table of files, in order, with ``base``, the ids before each.

    ``table_words`` trades a worker's memory (about 0.3 kB a word) for time, as in packing.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    kind = np.dtype("<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), END_ID + 1) <= 1 << 16 else "<u4")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx, encode, out = TaskContext.get(), word_encoder(tokenizer_path, table_words), None
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        name = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        n_docs = 0
        for batch in batches:
            for part, texts in text_parts(batch):
                if out is None:
                    sink, docs_sink = (fs.open_output_stream(f"{base}/{name}.{x}.arrow", compression=None) for x in ("tokens", "documents"))
                    out, docs_out = SequenceWriter(sink, kind, length, per_batch), pa.ipc.new_file(docs_sink, DOCUMENTS)
                coded = encode(texts)
                counts = np.fromiter(map(len, coded), np.int64, len(coded)) // 4 + 1
                starts = out.n_tokens + np.cumsum(counts) - counts
                out.write(np.frombuffer(end.join([*coded, b""]), "<u4"))
                names = batch.column(0).slice(part.start, part.stop - part.start)
                docs_out.write_batch(pa.RecordBatch.from_arrays([names, pa.array(starts), pa.array(counts)], schema=DOCUMENTS))
                n_docs += len(counts)
        if out is not None:
            n_sequences = out.close()
            docs_out.close()
            sink.close()
            docs_sink.close()
            row = [[ctx.partitionId()], [f"{root}/{name}.tokens.arrow"], [f"{root}/{name}.documents.arrow"], [n_docs], [n_sequences], [out.n_tokens]]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["part", "tokens", "documents", "n_documents", "n_sequences", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    dealt = rows.repartitionByRange(max(1, -(-int(total) // part_bytes)), "doc_id", "place").sortWithinPartitions("doc_id", "place")
    manifest = f"{scratch_dir(spark)}/token_files"
    map_batches(dealt, run, MANIFEST).write.parquet(manifest)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = spark.read.schema(MANIFEST).parquet(manifest)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _apart(files: DataFrame) -> DataFrame:
    """A partition for each file, about."""
    return files.repartition(max(1, files.count()), "tokens")


def read_documents(files: DataFrame) -> DataFrame:
    """Each document as the files have it: doc_id, start (ids of all documents before it), n_tokens, and its ids as
    little-endian unsigned 32-bit integers. A task reads a file batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, documents, base in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                yield from _documents_of(tokens, documents, base)

    return _apart(files).select("tokens", "documents", "base").transform(map_batches, run, "doc_id long, start long, n_tokens long, ids binary")


def _documents_of(tokens: str, documents: str, base: int) -> Iterator[pa.RecordBatch]:
    fs, path = _open(documents)
    sequences = SequenceFile(tokens)
    stream = (ids[: mask.true_count] for ids, mask in sequences.batches())  # padding comes last
    held, n_held = [], 0  # ids read but not handed on
    with fs.open_input_file(path) as f:
        listed = pa.ipc.open_file(f)
        for i in range(listed.num_record_batches):
            some = listed.get_batch(i)
            counts = some.column(2).to_numpy()
            # runs of documents of about READ_BYTES
            cut = np.flatnonzero(np.diff(np.cumsum(counts) * 4 // READ_BYTES)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(counts)], strict=True):
                need = int(counts[a:b].sum())
                while n_held < need:
                    held.append(next(stream))
                    n_held += len(held[-1])
                flat = np.concatenate(held)
                held, n_held = [flat[need:].copy()], n_held - need
                offsets = np.concatenate([[0], np.cumsum(counts[a:b])]) * 4
                raw = flat[:need].astype("<u4")
                ids = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0).slice(a, b - a), pa.array(some.column(1).to_numpy()[a:b] + base), some.column(2).slice(a, b - a), ids], ["doc_id", "start", "n_tokens", "ids"])
    sequences.close()


def read_sequences(files: DataFrame) -> DataFrame:
    """Each sequence as the files have it: part, sequence (its number in the part), ids and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sequences, at = SequenceFile(tokens), 0
                for ids, mask in sequences.batches():
                    n = len(ids) // sequences.length
                    offsets = pa.array(np.arange(n + 1) * sequences.length, pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array(ids.astype(np.int32)), mask)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *lists], ["part", "sequence", "ids", "mask"])
                    at += n
                sequences.close()

    return _apart(files).select("part", "tokens").transform(map_batches, run, "part int, sequence long, ids array<int>, mask array<boolean>")


def token_digest(documents: DataFrame) -> DataFrame:
    """The contract's columns: ids replaced by the unsigned crc32 of their bytes."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
