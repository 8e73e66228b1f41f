import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crestline.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def test_pieces_and_places(docs, rows, tokenizer):
    got = packing.pack(docs).collect()
    expected = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for number, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4")
            expected[doc_id, number, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(held) <= -(-total // 2048) + 3


def test_plan_comes_close_to_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6, 0.8, 20_000).astype(int), 1, 2048)
    histogram = np.bincount(lengths, minlength=2049)
    plan = packing.Plan(histogram)
    rank = np.concatenate([np.arange(n) for n in histogram[histogram > 0]])
    own = np.repeat(np.nonzero(histogram)[0], histogram[histogram > 0])
    sequence, offset = plan.place(own, rank)
    ends = {}
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), own.tolist())):
        assert ends.get(s, 0) == o
        ends[s] = o + n
    assert max(ends.values()) <= 2048
    assert len(ends) == plan.sequences <= 1.002 * -(-int(own.sum()) // 2048)


@pytest.mark.parametrize("histogram", [[], [(2048, 5), (1025, 7), (2047, 2), (1, 1)], [(700, 10), (648, 5)]])
def test_small_plans(histogram):
    counts = np.zeros(2049, int)
    for length, n in histogram:
        counts[length] = n
    plan = packing.Plan(counts)
    assert plan.sequences >= -(-int((counts * np.arange(2049)).sum()) // 2048)


def test_words_against_the_tokenizer(tokenizer):
    words = packing.tokens(packing.VOCABULARY)
    for text in ["it's we've 'S x²½", "İ ǅ ß ΑΣ", "a<|endoftext|>b", "\x01 a\x01b", "fléau!!! ***", "a b\u0085c"]:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert words([text]) == [ids]


def test_empty(empty):
    assert packing.pack(empty).collect() == []


def test_letters_whose_lower_case_lies_outside_latin(tokenizer):
    """Every character below U+0300, alone and inside words, has the vocabulary's own ids."""
    words = packing.tokens(packing.VOCABULARY)
    texts = [t for c in map(chr, range(0x21, 0x300)) for t in (c, f"a{c}b {c}{c} x{c}")] + ["ȺȾ Ⱥlpha beȾa"]
    for text, ids in zip(texts, words(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
