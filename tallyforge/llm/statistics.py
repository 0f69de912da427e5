"""Whole-text statistics of documents in one Arrow pass, shared by the quality operators. Null texts count as empty."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, text_parts

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Word, character and line counts; all are longs.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_marks", "n_stops", "n_wide")

_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_MARKS, _STOPS, _TAIL, _WIDE = b"!?;:\"'()[]{}=+/\\_~^@`-", b".,", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))


def _without(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


class WordNumbers(dict):
    """Word to a number; ``restart`` between texts keeps the table small."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def restart(self, limit: int = 200_000) -> None:
        if len(self) > limit:
            self.clear()


def repeats(numbers: np.ndarray) -> tuple[int, int]:
    """Words in 3-word windows that occur twice or more in the text, and distinct words. Window keys are exact."""
    n = len(numbers)
    distinct = len(np.unique(numbers))
    if n < 4:
        return 0, distinct
    if int(numbers.max()) < 1 << 21:
        keys = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    else:  # number the pairs first, so that two numbers fit
        pairs = np.unique((numbers[:-1] << 32) | numbers[1:], return_inverse=True)[1]
        keys = (pairs[:-1] << 32) | numbers[2:]
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0, distinct
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum()), distinct


def measure(text: bytes, numbers: np.ndarray) -> tuple[int, ...]:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeat, distinct = repeats(numbers)
    chars = len(text) - _without(text, _TAIL)
    return (
        len(numbers), chars - _without(text, SPACE), _without(text, SYMBOLS), len(lines), len(lines) - len(set(lines)), repeat, distinct,
        _without(text, _UPPER), _without(text, _LOWER), _without(text, _DIGIT), _without(text, _MARKS), _without(text, _STOPS), _without(text, _WIDE),
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordNumbers()
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for _, texts in text_parts(batch):
                words = [t.split() for t in texts]
                counts = [len(w) for w in words]
                table.restart()
                flat = np.fromiter(map(table.__getitem__, chain.from_iterable(words)), np.int64, sum(counts))
                rows += [measure(t, n) for t, n in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), strict=True)]
            cols = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.int64()) for c in cols)], ["doc_id", *MEASURES])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.transform(map_batches, run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))

