"""Operator 11, periodic run detection: every maximal stretch of words that repeats with a period.

A run of period q contains, at the dyadic scale B with 2B - 1 <= q <= 4B - 2, a whole block of B words (blocks lie at
multiples of B) that comes again q words on. So at each scale the blocks are convolved with the window of words in which
such a copy must lie: the sum of squared differences at every distance, by number-theoretic transforms of whole numbers
modulo as many primes as make the sums exact, is zero just where the block occurs. The distances seed extensions to both
sides, word by word, which give the run its ends. Periods below ``2 * LEAST_BLOCK - 1`` are compared at each distance
directly, as transforms of a few numbers would cost more.

Blocks that hold a word which does not come again in their window cannot occur there and are left out of the
convolution, as are windows that lie wholly in a run of short period found before: what they hold is that run again.
A text is worked on whole, in one task, in memory in proportion to its words; a batch holds texts of about 1 MB, or one
longer text.

Edge cases: null, empty and blank texts have no words, no runs and an empty collapsed text; texts of any length are read
whole; rows that repeat an id, or have none, are rows of their own; an empty table gives no row; other columns are not
carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import WORD_PATTERN, map_batches, text_parts

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Primes of the form c * 2**k + 1 with k >= 25, each with a primitive root.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
#: Words of the smallest block that is convolved by transforms.
LEAST_BLOCK = 8
#: Numbers that are transformed at once.
AT_ONCE = 1 << 18


@lru_cache(maxsize=256)
def _roots(n: int, prime: int, root: int) -> np.ndarray:
    """The first n / 2 powers of an n-th root of one."""
    step, out = pow(root, (prime - 1) // n, prime), np.ones(max(n // 2, 1), np.int64)
    done = 1
    while done < len(out):  # double the powers known
        more = min(done, len(out) - done)
        out[done : done + more] = out[:more] * pow(step, done, prime) % prime
        done += more
    return out


def transform(x: np.ndarray, prime: int, root: int) -> None:
    """Columns of ``x`` (a power of two long, values below ``prime``) to their transforms, in place, in bit-reversed order."""
    n, half = x.shape[0], x.shape[0] // 2
    while half:
        pairs = x.reshape(n // (2 * half), 2, half, -1)
        less = pairs[:, 0] - pairs[:, 1] + prime
        pairs[:, 0] += pairs[:, 1]
        np.subtract(pairs[:, 0], prime, out=pairs[:, 0], where=pairs[:, 0] >= prime)
        less *= _roots(2 * half, prime, root)[None, :, None]
        pairs[:, 1] = less % prime
        half //= 2


def restore(x: np.ndarray, prime: int, root: int) -> None:
    """The inverse of ``transform``, in place."""
    n, half = x.shape[0], 1
    while half < n:
        pairs = x.reshape(n // (2 * half), 2, half, -1)
        turned = pairs[:, 1] * _roots(2 * half, prime, pow(root, prime - 2, prime))[None, :, None] % prime
        pairs[:, 1] = pairs[:, 0] - turned
        pairs[:, 0] += turned
        np.subtract(pairs[:, 0], prime, out=pairs[:, 0], where=pairs[:, 0] >= prime)
        np.add(pairs[:, 1], prime, out=pairs[:, 1], where=pairs[:, 1] < 0)
        half *= 2
    x *= pow(n, prime - 2, prime)
    x %= prime


def squared_differences(blocks: np.ndarray, windows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Modulo ``prime``, the sum of squared differences of each column's block and its window, at each place in the window
    where the block fits."""
    size, wide = blocks.shape[0], windows.shape[0]
    n = 1 << (wide - 1).bit_length()
    x, y = np.zeros((n, blocks.shape[1]), np.int64), np.zeros((n, blocks.shape[1]), np.int64)
    x[-np.arange(size) % n], y[:wide] = blocks % prime, windows % prime
    places = wide - size + 1
    total = np.zeros((wide + 1, blocks.shape[1]), np.int64)
    np.cumsum(y[:wide] * y[:wide] % prime, axis=0, out=total[1:])
    squares = total[size:] - total[:places] + (x * x % prime).sum(axis=0)
    transform(x, prime, root)
    transform(y, prime, root)
    x *= y
    x %= prime
    restore(x, prime, root)
    return (squares - 2 * x[:places]) % prime


def occurrences(ids: np.ndarray, at: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of each exact copy of ``ids[at : at + size]`` that begins 2 * size - 1 to 4 * size - 2 words on and
    ends by ``ends``. Words of different texts have different ids."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    wide = 3 * size - 1
    step = max(1, AT_ONCE // (4 * size))
    for first in range(0, len(at), step):
        b, e = at[first : first + step], ends[first : first + step]
        blocks = ids[b + np.arange(size)[:, None]]
        where = b + (2 * size - 1) + np.arange(wide)[:, None]
        windows = ids[np.minimum(where, len(ids) - 1)]
        low = np.minimum(blocks.min(axis=0), windows.min(axis=0)) - 1
        blocks, windows = blocks - low, windows - low
        windows[where >= e] = 0  # like no word of the text
        most = size * int(max(blocks.max(), windows.max())) ** 2
        columns, modulus, hit = np.arange(len(b)), 1, None
        for prime, root in PRIMES:  # a sum below the product of the primes is zero if it is so modulo each
            zero = squared_differences(blocks[:, columns], windows[:, columns], prime, root) == 0
            hit = zero if hit is None else hit & zero
            kept = hit.any(axis=0)
            columns, hit, modulus = columns[kept], hit[:, kept], modulus * prime
            if modulus > most or not len(columns):
                break
        place, column = np.nonzero(hit)
        found.append((b[columns[column]], place + 2 * size - 1))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64),) * 2


def _stretch(ids: np.ndarray, at: int, distance: int, start: int, end: int) -> tuple[int, int]:
    """The longest stretch around ``at`` of places whose word comes again ``distance`` on, within a text."""
    last, step = at, 64
    while last < end - distance:
        n = min(step, end - distance - last)
        same = ids[last : last + n] == ids[last + distance : last + distance + n]
        if not same.all():
            last += int(same.argmin())
            break
        last, step = last + n, 2 * step
    first, step = at, 64
    while first > start:
        n = min(step, first - start)
        same = ids[first - n : first] == ids[first - n + distance : first + distance]
        if not same.all():
            first -= int(same[::-1].argmin())
            break
        first, step = first - n, 2 * step
    return first, last


def find_runs(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int = 12) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least ``min_length`` words and two periods, by start and period.

    Texts are the slices ``starts`` to ``ends`` of ``ids``, one after the other; each has word ids of its own.
    """
    total = len(ids)
    runs: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(2 * LEAST_BLOCK - 1, total)):
        same = np.flatnonzero(ids[:-q] == ids[q:])
        if len(same):
            cut = np.flatnonzero(np.diff(same) > 1)
            first, last = same[np.concatenate([[0], cut + 1])], same[np.concatenate([cut, [len(same) - 1]])] + 1
            long = last - first >= max(q, min_length - q)
            runs.append(np.stack([first[long], last[long] + q, np.full(long.sum(), q)], axis=1))
    longest = int((ends - starts).max(initial=0))
    if longest < 2 * (2 * LEAST_BLOCK - 1):
        return _smallest(np.concatenate(runs))
    count = np.bincount(ids)[ids]
    alone = np.concatenate([[0], np.cumsum(count == 1)])
    order = np.argsort(ids, kind="stable")
    placed = ids[order] * (total + 1) + order  # words, and their places in order
    known, size = _smallest(np.concatenate(runs)), LEAST_BLOCK
    while 2 * (2 * size - 1) <= longest:
        # blocks with room for a copy, of words that all occur again
        n_blocks = np.maximum(0, (ends - starts - 3 * size + 1) // size + 1)
        text = np.repeat(np.arange(len(starts)), n_blocks)
        at = starts[text] + size * (np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
        fresh = alone[at + size] == alone[at]
        text, at = text[fresh], at[fresh]
        reach, which = _reaching(known, total)
        if len(known) and len(at):
            run = which[at]
            inside = (run >= 0) & (reach[at] >= np.minimum(at + 5 * size - 2, ends[text])) & (known[run, 2] <= size)
            text, at = text[~inside], at[~inside]
        if len(at):
            # the rarest word has to come again in the window
            rare = np.concatenate([b + count[b[:, None] + np.arange(size)].argmin(axis=1) for b in np.array_split(at, -(-len(at) * size // AT_ONCE))])
            here = ids[rare] * (total + 1) + rare
            after = np.searchsorted(placed, here + 2 * size - 1)
            comes = np.append(placed, np.iinfo(np.int64).max)[after] <= here + 4 * size - 2
            text, at = text[comes], at[comes]
        if len(at):
            block, distance = occurrences(ids, at, ends[text], size)
            run = which[block]
            again = (run >= 0) & (reach[block] >= block + size + distance) & (distance % np.where(run >= 0, known[run, 2] if len(known) else 1, 1) == 0)
            block, distance = block[~again], distance[~again]
            done: dict[tuple[int, int], int] = {}
            found: list[tuple[int, int, int]] = []
            owner = np.searchsorted(starts, block, side="right") - 1
            for i in np.argsort(block, kind="stable").tolist():
                b, d, t = int(block[i]), int(distance[i]), int(owner[i])
                if b >= done.get((t, d), -1):
                    first, last = _stretch(ids, b, d, int(starts[t]), int(ends[t]))
                    done[t, d] = last
                    if last - first >= max(d, min_length - d):
                        found.append((first, last + d, d))
            if found:
                known = _smallest(np.concatenate([known, np.array(found, np.int64)]))
        size *= 2
    return known


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of the rows with one start and end, that with the smallest period: the others are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    other = np.ones(len(runs), bool)
    other[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[other]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _reaching(runs: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the greatest end of the runs that begin there or before, and which run has it (or -1)."""
    at = np.zeros(total + 1, np.int64)
    np.maximum.at(at, runs[:, 0], runs[:, 1] * (len(runs) + 1) + np.arange(len(runs)) + 1)
    np.maximum.accumulate(at, out=at)
    return at // (len(runs) + 1), at % (len(runs) + 1) - 1


class _Ids(dict):
    """Words to numbers that go on from one text to the next."""

    n = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.n
        self.n = number + 1
        return number


def _batch(texts: list[bytes], min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Number of words, number of runs, runs (start, length, period) and collapsed text of each text."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(counts)
    starts, ids, number = ends - counts, np.zeros(int(counts.sum()), np.int64), _Ids()
    for words, a, b in zip(split, starts.tolist(), ends.tolist(), strict=True):
        number.clear()
        ids[a:b] = np.fromiter(map(number.__getitem__, words), np.int64, b - a)
    runs = find_runs(ids, starts, ends, min_length)
    # a text without words has the start of the next one
    filled = np.flatnonzero(counts)
    owner = filled[np.searchsorted(starts[filled], runs[:, 0], side="right") - 1] if len(runs) else np.zeros(0, np.int64)
    dropped = np.zeros(len(ids) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    collapsed = [b" ".join(w) for w in split]
    for t in np.unique(owner).tolist():
        collapsed[t] = b" ".join(compress(split[t], kept[starts[t] : ends[t]].tolist()))
    per = np.bincount(owner, minlength=len(split))
    return counts, per, np.stack([runs[:, 0] - starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1), collapsed


def periodic_runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """Each document's runs, by start and then period, and its text without what only repeats: of every run, the first
    period's words stay. Words of the collapsed text are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for part, texts in text_parts(batch):
                counts, per, runs, collapsed = _batch(texts, min_length)
                rows = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), rows)
                ids = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_batches, run, RUNS)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that the registered query asks about: where h = crc32(doc_id as text) is divisible by ten, the
    words from a = (h / 10) % n on repeat with a period of 1 + (n - a) / (3 + (h / 10) % 8). A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # the words are bound once, as the argument of a function over an array of one element
    planted = F.expr(f"""
        transform(array(regexp_extract_all(text, r'{WORD_PATTERN}', 0)), w -> if(size(w) = 0, '',
          transform(array(named_struct('a', cast(g % size(w) as int), 'p', cast(1 + (size(w) - g % size(w)) div (3 + g % 8) as int))), s -> array_join(concat(
            slice(w, 1, s.a),
            slice(flatten(array_repeat(slice(w, s.a + 1, s.p), cast((size(w) - s.a + s.p - 1) div s.p as int))), 1, size(w) - s.a)), ' '))[0]))[0]""")
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.expr("h div 10"))
    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """The contract's columns: the longest run, and hashes of all runs and of the collapsed text."""
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as less, r.start as start, r.period as period, r.length as length)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
