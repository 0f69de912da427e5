"""Operator 7, benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact alignment.

The unit of an edit is a word (ASCII case and marks at its ends ignored); in scripts that put no spaces between words (Han,
kana, Thai, Lao, Tibetan, Burmese, Khmer) it is a character, and their marks part words. An item of n words may differ by
k = share * n edits.

A CGK walk embeds a window: at step j it emits the word under the cursor, and moves on or stays by a random bit of (j, word),
so that few edits leave few differing steps. Windows are as wide as the item, rounded down to 4, 5, 6 or 7 times a power of
two; documents have one at every eighth to sixteenth of a width (every word below 16 words), items have one at each of their
first words, so that a copy meets a document window wherever it begins. Each table's key is a few sampled steps of a walk,
within a run of ``SPAN`` steps: where walks are in step at one of them, they mostly are at all. Walks, tables and the windows
of an item repeat the trial; ``tests/llm`` holds the recall at each share of edits.

Candidates of a document and an item that lie near each other are looked at together: those whose surroundings lack more
distinct words of the item than edits are allowed can't be near enough, the others are aligned exactly: the least edit
distance of the item to any run of words around the candidates decides.

Items of fewer than four words, and those that allow no edit, are looked up as they stand (in k + 1 pieces, one of which
stands unchanged).

Items are read in blocks of ``block_items``, or of ``BLOCK_WORDS`` words if that comes first, which bounds what tasks are
sent; each block is met with all documents.

Edge cases: null and empty documents and items match nothing; an item of one word is met by each document that has the
word; texts of any length are read whole; repeated documents are reported each, repeated items too; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, text_parts

MOST_PIECE = 6
#: Steps of a walk among which a table's sampled ones lie.
SPAN = 12
BLOCK_WORDS = 400_000
#: Low bits of word hashes by which it is noted what words an item has.
_NOTED_BITS = 12
HITS = "doc_id long, item_id long, start long, end long, distance long, item_words long"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: UTF-8 of characters of scripts without spaces, their leading bytes, and the marks among them and in full width.
_DENSE = re.compile(rb"(?:\xe0[\xb8-\xbf]|\xe1[\x80-\x82\x9e\x9f]|\xe2[\xba-\xbf]|[\xe3-\xe9][\x80-\xbf]|\xef[\xa4-\xab]|\xf0[\xa0-\xb2][\x80-\xbf])[\x80-\xbf]")
_DENSE_LEAD = re.compile(rb"[\xe0-\xf0]")
_WIDE_MARKS = re.compile(rb"\xe3\x80[\x80-\x84\x88-\xa0]|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: 0 for bytes that part words, 1 for marks, 2 for others.
_KIND = np.array([0 if bytes([b]).isspace() else 1 if b in _MARKS else 2 for b in range(256)], np.uint8)
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)



def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


#: Powers of the factor and of its inverse modulo 2^64, for texts up to this length.
_POWERS, _INVERSES = _powers(int(_FACTOR), 1 << 15), _powers(pow(int(_FACTOR), -1, 1 << 64), 1 << 15)


def spaced(text: bytes) -> bytes:
    """The text in lower case, with spaces about characters where the script has none."""
    text = text.lower()
    if not text.isascii() and _DENSE_LEAD.search(text):
        text = _DENSE.sub(rb" \g<0> ", _WIDE_MARKS.sub(b" ", text))
    return text


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words without the marks around them; a word of marks only stays."""
    return [w.strip(_MARKS) or w for w in spaced(text).split()]


def pieces(n: int, allowed: int) -> list[tuple[int, int]]:
    """(start, end) of ``allowed + 1`` pieces of n words, as even as can be."""
    cuts = [n * j // (allowed + 1) for j in range(allowed + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def run_keys(flat: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Keys of all runs of 1, 2, ... ``longest`` words; ``flat`` has 32-bit word hashes."""
    acc = np.zeros(len(flat), np.uint64)
    for length in range(1, min(longest, len(flat)) + 1):
        acc = acc[: len(flat) - length + 1] * _FACTOR + flat[length - 1 :]
        key = acc * _FACTOR
        key ^= key >> np.uint64(32)
        key *= _FACTOR
        yield key


def step_of(width: int) -> int:
    """Words from one document window to the next."""
    return max(1, (1 << width.bit_length()) >> 4)


def width_of(n: int) -> int:
    """The widest windows for items of n (4 or more) words of which one begins at a word where a document window may."""
    return max(w for j in range(n.bit_length()) for w in (4 << j, 5 << j, 6 << j, 7 << j) if w + step_of(w) - 1 <= n)


@dataclass(frozen=True)
class Family:
    """The random choices: the same for items and documents."""

    walks: int = 3
    per_walk: int = 3
    sampled: int = 3
    seed: int = 3

    def steps(self, width: int, walk: int) -> list[list[int]]:
        """The sampled steps of each table; a walk passes 2 W steps over a window of W on average. Narrow windows have room
        for fewer steps between edits, so they get more tables of shorter keys."""
        rng = np.random.default_rng((self.seed, width, walk))
        narrow, most = width < 12, 3 * width // 2
        span, out = min(most, SPAN), []
        for _ in range(self.per_walk * (4 if narrow else 1)):
            low = int(rng.integers(0, most - span + 1))
            out.append(sorted((low + rng.choice(span, min(self.sampled - narrow, span), replace=False)).tolist()))
        return out

    def keys(self, flat: np.ndarray, starts: np.ndarray, widths: list[int], marked: bool = False, at_once: int = 16384) -> Iterator[tuple[int, list[list[np.ndarray]], list[list[np.ndarray]]]]:
        """(first window, keys, if ``marked`` whether no sampled step lies beyond the text) by width and table, in parts.
        ``flat`` has 32-bit word hashes and a 0, at which a walk stays, after each text. The widths share the walks."""
        plans = []
        for walk in range(self.walks):
            due: dict[int, list[tuple[int, int]]] = {}
            for c, width in enumerate(widths):
                chosen = self.steps(width, walk)
                for t, steps in enumerate(chosen):
                    for j in steps:
                        due.setdefault(j, []).append((c, walk * len(chosen) + t))
            plans.append([(xxhash.xxh32_intdigest(b"%d %d" % (walk, j), self.seed) | 1, due.get(j, [])) for j in range(max(due) + 1)])
        tables = [self.walks * len(self.steps(w, 0)) for w in widths]
        for low in range(0, len(starts), at_once):
            n = len(starts[low : low + at_once])
            out = [[np.zeros(n, np.uint64) for _ in range(t)] for t in tables]
            inside = [[np.ones(n, bool) for _ in range(t)] for t in tables if marked]
            bits = np.empty(n, np.uint32)
            for plan in plans:
                at = starts[low : low + at_once].copy()
                for odd, due in plan:
                    word = flat.take(at, mode="clip")
                    wide = word.astype(np.uint64) if due else word
                    for c, t in due:
                        out[c][t] *= _FACTOR
                        out[c][t] += wide
                        if marked:
                            inside[c][t] &= word != 0
                    np.multiply(word, np.uint32(odd), out=bits)
                    bits >>= np.uint32(31)
                    at += bits
            for key in chain.from_iterable(out):
                key *= _FACTOR
                key ^= key >> np.uint64(32)
                key *= _FACTOR
            yield low, out, inside


@dataclass(frozen=True)
class Table:
    """Sorted keys, the items they come from and the words of the item before them."""

    keys: np.ndarray
    owners: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, owners: np.ndarray, before: np.ndarray) -> Table:
        order = np.argsort(keys, kind="stable")
        return Table(keys[order], owners[order], before[order])

    def filter(self) -> tuple[np.uint64, np.ndarray]:
        """A shift, and by the rest of a shifted key whether a key of the table has it."""
        bits = max(16, len(self.keys).bit_length() + 6)
        seen = np.zeros(1 << bits, bool)
        seen[self.keys >> np.uint64(64 - bits)] = True
        return np.uint64(64 - bits), seen

    def meet(self, keys: np.ndarray, shift: np.uint64, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``keys``, item, words of the item before) of every equal pair."""
        near = np.flatnonzero(seen.take((keys >> shift).view(np.int64), mode="clip"))
        low = np.searchsorted(self.keys, keys[near], "left")
        equal = self.keys.take(low, mode="clip") == keys[near]
        near, low = near[equal], low[equal]
        if not len(near):
            return near, low, low  # no pair: all three are empty
        high = np.searchsorted(self.keys, keys[near], "right")
        counts = high - low
        entry = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.repeat(near, counts), self.owners[entry], self.before[entry]


@dataclass
class Items:
    """A block of items, indexed: tables of the items that are looked up as they stand by length, of the others by width."""

    ids: list[int | None]
    words: list[list[bytes]]
    share: float
    family: Family = Family()
    plain: dict[int, Table] = field(default_factory=dict)
    tables: dict[int, list[Table]] = field(default_factory=dict)
    distinct: list[frozenset[int]] = field(default_factory=list)

    def allowed(self, i: int) -> int:
        return int(self.share * len(self.words[i]))

    def index(self) -> Items:
        hashes = [word_hashes(b" ".join(w)) for w in self.words]
        self.distinct = [frozenset(h.tolist()) for h in hashes]
        plain: dict[int, list[tuple[int, int, int]]] = {}
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w) >= 4 and self.allowed(i):
                by_width.setdefault(width_of(len(w)), []).append(i)
            elif w:
                for a, b in pieces(len(w), self.allowed(i)):
                    length = min(b - a, MOST_PIECE)
                    *_, key = run_keys(hashes[i][a : a + length], length)
                    plain.setdefault(length, []).append((int(key[0]), i, a))
        for length, rows in plain.items():
            self.plain[length] = Table.of(np.array([r[0] for r in rows], np.uint64), *(np.array([r[c] for r in rows]) for c in (1, 2)))
        for width, members in by_width.items():
            flat, edges = hashed([hashes[i] for i in members])
            sizes = np.array([len(self.words[i]) for i in members])
            counts = np.maximum(sizes - width + 1, 3 * sizes // 5)
            owner = np.repeat(np.arange(len(members)), counts)
            before = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            parts: list[list[Table]] = []
            for low, (found,), (inside,) in self.family.keys(flat, edges[owner] + before, [width], marked=True):
                parts.append([Table(k[ok], np.array(members)[owner[low : low + len(k)]][ok], before[low : low + len(k)][ok]) for k, ok in zip(found, inside, strict=True)])
            self.tables[width] = [Table.of(*(np.concatenate([getattr(p, c) for p in table]) for c in ("keys", "owners", "before"))) for table in zip(*parts, strict=True)]
        return self

    def groups(self) -> list[list[int]]:
        """Widths whose windows begin at the same words."""
        out: dict[int, list[int]] = {}
        for width in sorted(self.tables):
            out.setdefault(step_of(width), []).append(width)
        return list(out.values())


class Filters:
    """The filters of a block's tables and items, made by the task that uses them."""

    def __init__(self, items: Items) -> None:
        self.plain = {length: table.filter() for length, table in items.plain.items()}
        self.tables = {width: [t.filter() for t in tables] for width, tables in items.tables.items()}
        self.has = np.zeros((len(items.words), 1 << _NOTED_BITS), bool)
        for i, words in enumerate(items.distinct):
            self.has[i, np.fromiter(words, np.int64, len(words)) & ((1 << _NOTED_BITS) - 1)] = True

    def likely(self, flat: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, at_once: int = 8192) -> np.ndarray:
        """Which runs ``low`` to ``high`` of ``flat`` may hold ``least`` words of their item; no run that does is missed."""
        out = np.zeros(len(item), bool)
        for start in range(0, len(item), at_once):
            part = slice(start, start + at_once)
            sizes = high[part] - low[part]
            firsts = np.cumsum(sizes) - sizes
            place = np.arange(sizes.sum()) + np.repeat(low[part] - firsts, sizes)
            noted = self.has[np.repeat(item[part], sizes), flat[place] & np.uint32((1 << _NOTED_BITS) - 1)]
            out[part] = np.add.reduceat(noted, firsts, dtype=np.int64) >= least[part]
        return out


def word_hashes(text: bytes) -> np.ndarray:
    """32 bits, never 0, of each word as ``tokens`` has them: its bytes, as 64 random bits each, times powers of a factor."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    edge = np.flatnonzero(np.diff((kind > 0).view(np.int8), prepend=0, append=0))
    first, end = edge[0::2].copy(), edge[1::2].copy()
    if not len(first):
        return np.zeros(0, np.uint32)
    # words that begin or end with marks, unless they have nothing else
    odd = np.flatnonzero((kind[first] == 1) | (kind[end - 1] == 1))
    if len(odd):
        inner = np.flatnonzero(kind == 2)
        low, high = np.searchsorted(inner, first[odd]), np.searchsorted(inner, end[odd])
        odd, low, high = (x[low < high] for x in (odd, low, high))
        first[odd], end[odd] = inner[low], inner[high - 1] + 1
    if len(raw) < len(_POWERS):
        # powers of a byte's place in the text, which the inverse power of the word's place takes back
        terms = np.zeros(len(raw) + 1, np.uint64)
        np.multiply(_BYTES[raw], _POWERS[: len(raw)], out=terms[:-1])
        sums = np.add.reduceat(terms, np.stack([first, end], axis=1).ravel())[::2] * _INVERSES[first]
        return ((sums * _FACTOR) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    sizes = end - first
    before = np.cumsum(sizes) - sizes
    within = np.arange(sizes.sum()) - np.repeat(before, sizes)
    powers = np.full(int(sizes.max()), _FACTOR)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    terms = _BYTES[raw[within + np.repeat(first, sizes)]] * powers[within]
    return ((np.add.reduceat(terms, before) * _FACTOR) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def hashed(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, a 0 after each, and where each text begins, with the end at last."""
    edges = np.concatenate([[0], np.cumsum([len(w) + 1 for w in texts])]).astype(np.int64)
    flat = np.zeros(edges[-1], np.uint32)
    for hashes, start in zip(texts, edges[:-1].tolist(), strict=True):
        flat[start : start + len(hashes)] = hashes
    return flat, edges


def align(item: list[bytes], text: list[bytes]) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a run of ``text``, and the run (start, end): first such end, then the longest run."""
    number: dict[bytes, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in item])
    b = np.array([number.setdefault(w, len(number)) for w in text])
    cost, start = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    for i, w in enumerate(a.tolist(), 1):
        # pack (distance, start) so that the least distance wins and, of equals, the first start
        diag = ((cost[:-1] + (b != w)) << 32) | start[:-1]
        down = ((cost[1:] + 1) << 32) | start[1:]
        best = np.concatenate([[i << 32], np.minimum(diag, down)])
        shift = np.arange(len(best), dtype=np.int64) << 32
        best = np.minimum.accumulate(best - shift) + shift  # words of the text that the item lacks
        cost, start = best >> 32, best & 0xFFFFFFFF
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def _candidates(flat: np.ndarray, edges: np.ndarray, items: Items, filters: Filters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, word of the text at which the item would begin) of every pair of equal keys, sorted."""
    found = []
    for length, keys in enumerate(run_keys(flat, max(items.plain, default=0)), 1):
        if length in items.plain:
            found.append(items.plain[length].meet(keys, *filters.plain[length]))
    for widths in items.groups():
        starts = np.arange(0, len(flat), step_of(widths[0]))
        for low, block, _ in items.family.keys(flat, starts, widths):
            for width, by_table in zip(widths, block, strict=True):
                for table, keys, sieve in zip(items.tables[width], by_table, filters.tables[width], strict=True):
                    place, item, before = table.meet(keys, *sieve)
                    if len(place):
                        found.append((starts[low + place], item, before))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    place, item, before = (np.concatenate(c) for c in zip(*found, strict=True))
    text = np.searchsorted(edges, place, "right") - 1
    at = place - edges[text] - before
    order = np.lexsort((at, item, text))
    return text[order], item[order], at[order]


def _search(texts: list[bytes], items: Items, filters: Filters) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, distance) of every text and item found within the allowed edits."""
    texts = [spaced(t) for t in texts]
    flat, edges = hashed([word_hashes(t) for t in texts])
    text, item, at = _candidates(flat, edges, items, filters)
    if not len(text):
        return []
    sizes, allowed_edits = np.array([len(w) for w in items.words]), np.array([items.allowed(i) for i in range(len(items.words))])
    # candidates nearer than half an item are looked at together
    new = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(at) > sizes[item[1:]] // 2)
    firsts = np.concatenate([[0], np.flatnonzero(new) + 1])
    text, item, low, high = text[firsts], item[firsts], at[firsts], at[np.append(firsts[1:], len(at)) - 1]
    reach = 2 * allowed_edits[item]
    low, high = edges[text] + np.maximum(0, low - reach), np.minimum(edges[text] + high + sizes[item] + reach, edges[text + 1])
    # each edit accounts for one word at most
    least = np.array([len(w) for w in items.distinct])[item] - allowed_edits[item]
    near = np.flatnonzero(filters.likely(flat, item, low, high, least))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    split: dict[int, list[bytes]] = {}
    for d, i, a, b in zip(*(c[near].tolist() for c in (text, item, low, high)), strict=True):
        if best.get((d, i), (1,))[0] == 0:
            continue
        allowed = items.allowed(i)
        if len(items.distinct[i].difference(flat[a:b].tolist())) > allowed:
            continue
        if d not in split:
            split = {d: texts[d].split()}  # rows come by document
        low_word = a - int(edges[d])
        around = [w.strip(_MARKS) or w for w in split[d][low_word : b - int(edges[d])]]
        distance, start, end = align(items.words[i], around)
        if distance <= allowed:
            one = (distance, low_word + start, low_word + end)
            best[d, i] = min(best.get((d, i), one), one)
    return [(d, i, a, b, e) for (d, i), (e, a, b) in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.25, block_items: int = 4000, family: Family = Family()) -> DataFrame:  # noqa: B008
    """HITS: the best alignment of every document and item found within ``share`` (0 to under 1) of the item's words."""
    if not 0 <= share < 1:
        raise ValueError("share must be 0 or more and under 1")

    def hits(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = Filters(items)
            for batch in batches:
                doc_ids, rows = batch.column(0).to_pylist(), []
                for part, texts in text_parts(batch):
                    rows += [(doc_ids[part.start + d], items.ids[i], a, b, e, len(items.words[i])) for d, i, a, b, e in _search(texts, items, filters)]
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "item_id", "start", "end", "distance", "item_words"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_batches, run, HITS)

    out, ids, words = docs.sparkSession.createDataFrame([], HITS), [], []
    n_words = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        ids.append(row["i"])
        words.append(tokens(row["t"].encode()))
        n_words += len(words[-1])
        if len(ids) == block_items or n_words >= BLOCK_WORDS:
            out, ids, words = out.union(hits(Items(ids, words, share, family).index())), [], []
            n_words = 0
    return out.union(hits(Items(ids, words, share, family).index())) if ids else out
