"""Operator 1, packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Rows are dealt to partitions by a hash of their id and place, so that no id, null or repeated, falls to one task; a
partition is read in hash order and cut into groups of ``group_tokens``. Within a group, runs of ``capacity`` tokens of a long document fill sequences of their own, and the
remaining pieces are placed by first-fit decreasing: a winner tree over the open sequences' free space finds the first
that fits in O(log bins). Only a group is in memory at a time, whatever the partition holds.

Edge cases: null and empty texts are a single end token; a text of any length is cut into pieces; repeated rows and ids
are packed as often as they occur; an empty table gives no row; other input columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, spread, text_parts

CAPACITY = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each item: largest first, each to the lowest bin with room."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)  # tree[i] is the larger free space of the two below it
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node = 2 * node if tree[2 * node] >= size else 2 * node + 1
        bins[item], offsets[item] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


#: Marks that a word may end in and that are a token run of their own there; those of special tokens are not among them.
_TAIL = b".,;:!?*$%&#()\"[]{}/-_+=~@^"


#: New words that the tokenizer sees at once; it needs about a kilobyte for each.
AT_ONCE = 500


def word_encoder(path: str, limit: int) -> Callable[[list[bytes]], list[bytes]]:
    """Texts to little-endian 32-bit ids. The vocabulary drops white space and case and never merges over white space or
    from letters into marks, so a word's ids are those of its letters and of the marks at its end. Words are looked up;
    the tokenizer sees each new one once, ``AT_ONCE`` at a time. The table starts anew at ``limit`` words."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    last = np.zeros(tokenizer.get_vocab_size(), bool)  # tokens that end a word
    for token, i in tokenizer.get_vocab().items():
        last[i] = token.endswith("</w>")
    cores: dict[bytes, bytes] = {}
    fresh: list[bytes] = []

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            fresh.append(word)
            self[word] = n = len(self)
            return n

    numbers = Numbers()  # of words; their ids are flat[start[n] : start[n + 1]]
    flat, start = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def ids_of(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def parts(word: bytes) -> tuple[bytes, bytes]:
        core = word.rstrip(_TAIL)
        # some letters in lower case end in a combining mark, which is one run with the marks that follow
        if core and len(core) < len(word) and (core[-1:].isalnum() or core.decode("utf-8", "replace").lower()[-1].isalpha()):
            return core.lower(), word[len(core) :]
        return word, b""

    def learn() -> None:
        nonlocal flat, start
        split = [parts(w) for w in fresh]
        unknown = {p for s in split for p in s if p and p not in cores}
        alone = [(w, t) for w in unknown if (t := w.decode("utf-8", "replace")).lower().isalpha()]
        for at in range(0, len(alone), AT_ONCE):
            some = alone[at : at + AT_ONCE]
            got = ids_of(" ".join(t for _, t in some))
            ends = (np.flatnonzero(last[got]) + 1).tolist()
            if len(ends) == len(some):  # each is one run of letters, so one token run
                raw, starts = got.tobytes(), [0, *ends][:-1]
                cores.update((w, raw[4 * a : 4 * b]) for (w, _), a, b in zip(some, starts, ends, strict=True))
        cores.update((w, ids_of(w.decode("utf-8", "replace")).tobytes()) for w in unknown if w not in cores)
        found = [cores[a] + cores[b] if b else cores[a] for a, b in split]
        flat = np.concatenate([flat, np.frombuffer(b"".join(found), "<u4")])
        start = np.concatenate([start, start[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        fresh.clear()

    def encode(texts: list[bytes]) -> list[bytes]:
        nonlocal flat, start
        if len(numbers) > limit:
            numbers.clear()
            cores.clear()
            flat, start = flat[:0], start[:1]
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        learn()
        lengths = start[which + 1] - start[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        raw = flat[np.repeat(start[which] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        edges = (4 * ends[np.concatenate([[0], np.cumsum(counts)])]).tolist()
        return [raw[a:b] for a, b in pairwise(edges)]

    return encode


def _pack_group(group: list[tuple[int | None, bytes]], first: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    step, rows = 4 * capacity, []
    for doc_id, ids in group:
        n = len(ids) // 4
        rows += [(doc_id, at // 4, min(step, len(ids) - at) // 4, n, ids[at : at + step]) for at in range(0, len(ids), step)]
    bins, offsets = first_fit_decreasing(np.array([r[2] for r in rows]), capacity)
    order = np.lexsort((offsets, bins)).tolist()
    doc, start, length, total, ids = (list(c) for c in zip(*(rows[i] for i in order), strict=True))
    cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(bins[order] + first), pa.array(offsets[order]), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]), int(bins.max()) + 1


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_tokens: int = 2_000_000, seed: int = 17, part_bytes: int = 32 << 20, table_words: int = 500_000, run_bytes: int = 1 << 20) -> DataFrame:
    """One row a piece with its token ids as little-endian 32-bit integers (``ids``); sequences are (partition, number).

    ``table_words`` trades a worker's memory (about 0.3 kB a word) for time: words beyond it are tokenized anew. So does
    ``run_bytes``, the bytes of texts that are encoded at once (about 60 bytes a byte).
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_encoder(tokenizer_path, table_words)
        part, made, group, held = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for part_of, texts in text_parts(batch, run_bytes):
                for doc_id, ids in zip(doc_ids[part_of], encode(texts), strict=True):
                    group.append((doc_id, ids + end))
                    held += len(ids) // 4 + 1
                    if held >= group_tokens:
                        out, n = _pack_group(group, part + made, capacity)
                        made, group, held = made + n, [], 0
                        yield out
        if group:
            yield _pack_group(group, part + made, capacity)[0]

    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()).alias("rank"))
    return spread(rows, size, part_bytes, F.col("rank")).sortWithinPartitions("rank").transform(map_batches, run, PIECES)


def pack_digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: ids replaced by the unsigned crc32 of their bytes."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
