import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyforge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_first_fit_decreasing_is_the_plain_rule():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 200):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            at = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
            if at == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (at, 100 - free[at])
            free[at] -= sizes[i]


def test_ids_are_the_tokenizers():
    t = Tokenizer.from_file(PATH)
    texts = ["it's a DOG'S  <|endoftext|>. x<|endoftext|> «Oui». é! ΣΑΣ. ß²3,x 　z q 12,5% 'tis ...", "", "a\nb\tc", "Same same SAME, same."]
    encode = packing.word_encoder(PATH, limit=3)
    for _ in range(2):  # the second time after the table started anew
        for text, ids in zip(texts, encode([x.encode() for x in texts]), strict=True):
            assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_random_texts(rng=np.random.default_rng(4)):
    t = Tokenizer.from_file(PATH)
    letters = [*"aZéÉİıßẞΣςǅﬁÅÅ中あก٣7½²_'.,%!-()#", "\u0301", "\u0307", "\u0308", "\u200d", "\u00a0", "\u3000", "\ufe0f", "𝔸", "🙂", "'s", "'LL", " ", " ", "\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(6000)]
    encode = packing.word_encoder(PATH, limit=20_000)
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        for text, ids in zip(some, encode([x.encode() for x in some]), strict=True):
            assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text)


def check(rows, docs):
    """Every piece of every document (doc_id, text) exactly once, pieces gapless in their sequence, none too long."""
    t = Tokenizer.from_file(PATH)
    want, held = Counter(), {}
    for doc_id, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.update((doc_id, at, len(ids), ids[at : at + packing.CAPACITY].tobytes()) for at in range(0, len(ids), packing.CAPACITY))
    assert Counter((r.doc_id, r.start, r.doc_tokens, bytes(r.ids)) for r in rows) == want
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for spans in held.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    return held


def test_odd_rows(spark, odd, none):
    rows = packing.pack(odd, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()])
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.doc_tokens for r in by[2]] == [1] and [r.doc_tokens for r in by[4]] == [1]
    assert len(by[6]) == 2 and len(by[5]) > 100
    assert packing.pack(none, PATH).count() == 0


def test_documents_fill_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    held = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    used = sum(n for spans in held.values() for _, n in spans)
    assert used / (len(held) * packing.CAPACITY) > 0.98
    digest = packing.pack_digest(packing.pack(docs, PATH)).collect()
    assert len(digest) == len(rows)
    ids = {(r.doc_id, r.start): bytes(r.ids) for r in rows}
    assert all(zlib.crc32(ids[r.doc_id, r.start]) == r.ids_crc32 for r in digest)
