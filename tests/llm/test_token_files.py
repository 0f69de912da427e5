import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import token_files
from tallyforge.llm.catalog import op13_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def coded(text):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def write(docs, tmp_path, **options):
    return token_files.write_tokens(docs, PATH, str(tmp_path / "tokens"), **options).cache()


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 64, 200])
def test_sequences_are_equal_slices(tmp_path, kind, n):
    path, ids = str(tmp_path / "f.arrow"), np.arange(5, 5 + n).astype("<u4")
    with pa.OSFile(path, "wb") as sink:
        w = token_files.SequenceWriter(sink, np.dtype(kind), 16, 3)
        for at in range(0, n, 7):
            w.write(ids[at : at + 7])
        assert w.close() == -(-n // 16)
    f = token_files.SequenceFile(path)
    assert len(f) == -(-n // 16)
    for i in list(range(len(f)))[::-1]:  # in any order
        seq, mask = f[i]
        real = min(16, n - 16 * i)
        assert seq.dtype == kind and len(seq) == len(mask) == 16
        assert (seq[:real] == ids[16 * i : 16 * i + real]).all() and not seq[real:].any()
        assert mask.to_pylist() == [True] * real + [False] * (16 - real)
        assert not seq.flags.owndata and not seq.flags.writeable  # a view of the map
    with pytest.raises(IndexError):
        f[len(f)]
    f.close()


def test_reads_do_not_copy(tmp_path):
    path = str(tmp_path / "f.arrow")
    with pa.OSFile(path, "wb") as sink:
        w = token_files.SequenceWriter(sink, np.dtype("<u2"), 1024, 64)
        w.write(np.arange(1 << 18) % 50_000)
        w.close()
    f = token_files.SequenceFile(path)
    before = pa.total_allocated_bytes()
    held = [f[i] for i in range(len(f))]
    assert len(held) == 256 and pa.total_allocated_bytes() - before < 1 << 16
    del held
    f.close()


def test_documents_come_back(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    files = write(docs.repartition(5), tmp_path, length=64, per_batch=4, part_bytes=50_000)
    assert files.count() > 3
    start = 0
    got = {r.doc_id: r for r in token_files.read_documents(files).collect()}
    for doc_id, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        ids = coded(text)
        assert (got[doc_id].start, got[doc_id].n_tokens, bytes(got[doc_id].ids)) == (start, len(ids), ids.tobytes())
        start += len(ids)
    # sequences, in order and without padding, are all ids
    flat = [t for r in token_files.read_sequences(files).orderBy("part", "sequence").collect() for t, real in zip(r.ids, r.mask, strict=True) if real]
    assert len(flat) == start and zlib.crc32(np.array(flat, "<u4").tobytes()) == zlib.crc32(b"".join(bytes(r.ids) for r in sorted(got.values(), key=lambda r: r.start)))
    assert {len(r.ids) for r in token_files.read_sequences(files).collect()} == {64}


def test_query_digest(spark):
    sf = "/root/testdata/sf0.001"
    start = 0
    got = {r.doc_id: tuple(r)[1:] for r in op13_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = coded(r.text)
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_odd_rows(spark, odd, none, tmp_path):
    files = write(odd, tmp_path, part_bytes=1000)
    rows = sorted(token_files.read_documents(files).collect(), key=lambda r: r.start)
    want = [(r.doc_id, r.text) for r in odd.collect()]
    assert [r.doc_id for r in rows] == sorted((i for i, _ in want), key=lambda i: (i is not None, i or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0
    assert sorted(bytes(r.ids) for r in rows) == sorted(coded(t).tobytes() for _, t in want)
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert token_files.read_documents(write(none, tmp_path / "none")).count() == 0 and token_files.read_sequences(write(none, tmp_path / "no")).count() == 0


def test_a_hot_id_fills_many_parts(spark, tmp_path):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("some words of a text "), F.col("id").cast("string")).alias("text"))
    files = write(docs, tmp_path, part_bytes=8000)
    assert files.agg(F.max("n_documents")).first()[0] < 800
    rows = sorted(token_files.read_documents(files).collect(), key=lambda r: r.start)
    assert len(rows) == 3000 and [r.doc_id for r in rows[2000:]] == list(range(0, 3000, 3)) and all(r.doc_id is None for r in rows[:2000])
