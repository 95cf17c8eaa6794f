from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing as p
from quarry.llm.queries import word_vocabulary


def test_pieces_against_the_tokenizer(make_docs, odd_texts):
    texts = odd_texts + ["it's I'LL 'Sx ½ ² ٣ e\u0301 \u0301x a\u00a0b\u2003c \x00 \u0130 Σας ＡＢ", "don't\nstop"]
    tokenizer = Tokenizer.from_file(word_vocabulary())
    docs = make_docs(texts)
    out = p.pack_documents(docs, word_vocabulary(), with_ids=True).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    for k, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]].tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(part), part)
            at += r["length"]
        assert at == len(ids)
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= p.WINDOW
    fill = [sum(r["length"] for r in pieces) for pieces in by_window.values()]
    assert sum(f < p.WINDOW for f in fill) <= docs.rdd.getNumPartitions()


def brute_place(counts, length, size):
    """The level that leaves the least sum of squares, by trying all."""
    best = None
    for level in range(size - length + 1):
        if level and not counts[level]:
            continue
        after = list(counts)
        if level:
            after[level] -= 1
        if level + length < size:
            after[level + length] += 1
        worth = sum(x * x for x in after)
        if best is None or worth < best[0]:
            best = (worth, level)
    return best[1]


@pytest.mark.parametrize("seed", range(5))
def test_rule_against_trying_all_levels(seed):
    rng, size = random.Random(seed), 24
    packer = p.SumOfSquares(size)
    for _ in range(400):
        length = rng.randrange(1, size + 1)
        counts = packer.count[:size].tolist()
        _, level = packer.place(length)
        assert level == (0 if length == size else brute_place(counts, length, size))


def test_lengths_fill_windows():
    rng = random.Random(9)
    lengths = [rng.choice([1, 5, 100, 300, 64, 65, 200]) for _ in range(500)]
    used, done = defaultdict(int), defaultdict(int)
    for place, _, length, window, offset in p.pack_lengths(iter(lengths), 64):
        used[window] += length
        done[place] += length
        assert offset + length <= 64
    assert [done[k] for k in range(500)] == lengths
    assert sum(v < 64 for v in used.values()) <= 1


def test_long_documents_alone_keep_few_windows_open():
    rng, held, most = random.Random(4), set(), 0
    lengths = [rng.randrange(1025, 2048) for _ in range(3000)]
    left, windows = list(lengths), defaultdict(int)

    def counted():
        nonlocal most
        for k, n in enumerate(lengths):
            held.add(k)
            most = max(most, len(held))
            yield n

    for place, _, length, window, _ in p.pack_lengths(counted()):
        left[place] -= length
        windows[window] += length
        if not left[place]:
            held.discard(place)
    assert not any(left) and sum(v < p.WINDOW for v in windows.values()) <= 1
    assert most <= 4 * p.MOST_OPEN


def test_forgotten_words_are_encoded_again():
    asked = []
    ids = p.WordIds(lambda ws: [asked.append(w) or np.array([len(w)], "<u4").tobytes() for w in ws], limit=3)
    assert ids.texts(["a bb a"])[0] == np.array([1, 2, 1], "<u4").tobytes()
    assert ids.texts(["ccc dddd a"])[0] == np.array([3, 4, 1], "<u4").tobytes()
    assert ids.texts(["e f g"])[0] == np.array([1, 1, 1], "<u4").tobytes()
    assert ids.texts(["bb a"])[0] == np.array([2, 1], "<u4").tobytes()
    assert sorted(asked) == sorted(["a", "bb", "ccc", "dddd", "e", "f", "g", "a", "bb"])


def test_merging_by_rank_equals_the_tokenizer():
    assert p.merges_by_rank(word_vocabulary())
    rng = random.Random(2)
    letters = "aaaabbbeeeinorstthlmzqAEIßÄöñÿÈ"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 24))) + rng.choice(["", "", ",", "...", "%$", "?!#"]) for _ in range(20_000)]
    words += ["", "x" * 5000, "'s", "a's", "don't", "e\u0301", "İ", "Σας", "<|endoftext|>", "a<|endoftext|>b", "ªº", "½", "×÷", "12,5", "µ"]
    assert p.word_encoder(word_vocabulary(), True)(words) == p.word_encoder(word_vocabulary())(words)


def test_other_vocabularies_are_not_merged_by_rank():
    import public_tokenizers

    assert not p.merges_by_rank(public_tokenizers.path("byte_bpe_50k.json"))


def test_empty_table(make_docs):
    assert p.pack_documents(make_docs(["a"]).limit(0), word_vocabulary()).count() == 0
