"""Packing tokenised documents into sequences by the sum-of-squares rule.

Each task packs its own documents as they come. A piece goes to the fill level for which the sum of squares of the counts
of partially filled windows, kept in an array by level, becomes least. Documents over a window's size first fill whole
windows. At most ``MOST_OPEN`` windows are open: where the rule asks for one more, the piece is cut instead, and its first
part fills the fullest open window. A task thus holds few documents, whatever their lengths. At its end the pieces of the
windows still open are cut freely and laid end to end into full windows, so that at most one window a task is padded.

Ids are those of the vocabulary's tokenizer. Words are remembered for all tasks of a Python worker. A new word of Latin
letters and trailing marks is merged by ranks directly if the vocabulary allows that (``merges_by_rank``); any other word
goes through the tokenizer.

Defined results: a null or empty text has the end id alone. Repeated rows are documents of their own. Ties go to the
lowest level. An empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

assert array("I").itemsize == 4 and sys.byteorder == "little"  # an array's bytes are then the ids' form

END_ID = 1
WINDOW = 2048
MOST_OPEN = 128  # windows that a task holds at once
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Ids of white-space separated words, as little-endian 32-bit bytes.

    The vocabulary's tokenizer never joins across white space, so a text's ids are its words' ids in order. Words are
    remembered in two generations of at most ``limit`` words (and one call's); words not used in a whole generation go.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 600_000) -> None:
        self.encode, self.limit = encode, limit
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        words = [t.replace("\n", " ").split(" ") for t in texts]
        missing = set().union(*words).difference(self.known)
        if len(self.known) + len(missing) > self.limit:
            self.older, self.known = self.known, {"": b""}
            missing = set().union(*words) - {""}
        older = self.older
        fresh = [w for w in missing if w not in older]
        self.known.update((w, older[w]) for w in missing if w in older)
        self.known.update(zip(fresh, self.encode(fresh), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


#: Words that the tokenizer's normalizer only lower-cases and its pattern splits into the letters and the marks after them.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$&*#]*)")
_WORD_END = "</w>"
#: How a vocabulary must treat text before merging, for words to be merged by ranks.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def merges_by_rank(path: str) -> bool:
    """Whether merging the neighbours whose joined bytes have the least id gives the tokenizer's ids for every word.

    That holds if each entry of the vocabulary, taken alone, merges into itself: what happens inside the span of an entry
    then doesn't depend on its surroundings, and no other two parts can ever meet there. All entries are tried.
    """
    from tokenizers import models

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before, split = file["model"], file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    steps = [n.get("type") for n in before.get("normalizers", [])]
    parts = split.get("pretokenizers", [{}])
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != _WORD_END or model.get("dropout") or steps != ["NFC", "Replace", "Lowercase"]:
        return False
    if parts[0].get("pattern") != {"Regex": _SPLIT} or [x.get("type") for x in parts] != ["Split", "ByteLevel"]:
        return False
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    inner, final = models.BPE(vocab=model["vocab"], merges=merges), models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=_WORD_END)
    special = {t["id"] for t in file.get("added_tokens", [])}
    alone = lambda t: final.tokenize(t.removesuffix(_WORD_END)) if t.endswith(_WORD_END) else inner.tokenize(t)
    return all(k in special or [x.id for x in alone(t)] == [k] for t, k in model["vocab"].items())


def rank_encoder(path: str) -> Callable[[bytes], list[int]]:
    """Ids of a piece's bytes that end in 0xFF, the word's end, which UTF-8 never has."""
    import tiktoken
    from tokenizers import pre_tokenizers

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    # Bytes that print stand for themselves in such vocabularies, the others, in order, for the characters from 256 on.
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
    assert set(byte) == set(pre_tokenizers.ByteLevel.alphabet())
    special = {t["id"] for t in file.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t.removesuffix(_WORD_END)) + b"\xff" * t.endswith(_WORD_END): k for t, k in file["model"]["vocab"].items() if k not in special}
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def word_encoder(path: str, by_rank: bool = False) -> Callable[[list[str]], list[bytes]]:
    """Each word's ids, as little-endian 32-bit bytes."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def whole(words: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []

    if not by_rank:
        return whole
    merge, plain = rank_encoder(path), _PLAIN.fullmatch

    def run(words: list[str]) -> list[bytes]:
        out, others = [], []
        for word in words:
            if (m := plain(word)) is None:
                others.append(len(out))
                out.append(b"")
            elif m[2]:
                out.append(array("I", merge(m[1].lower().encode() + b"\xff") + merge(m[2].encode() + b"\xff")).tobytes())
            else:
                out.append(array("I", merge(word.lower().encode() + b"\xff")).tobytes())
        for at, ids in zip(others, whole([words[at] for at in others]), strict=True):
            out[at] = ids
        return out

    return run


#: Remembered words by vocabulary; a worker process keeps them from task to task.
_WORDS: dict[tuple[str, bool], WordIds] = {}


def remembered_words(path: str, by_rank: bool) -> WordIds:
    if (path, by_rank) not in _WORDS:
        _WORDS[path, by_rank] = WordIds(word_encoder(path, by_rank))
    return _WORDS[path, by_rank]


class SumOfSquares:
    """Windows of ``size``; ``place`` returns the window and offset of a piece of at most that size."""

    def __init__(self, size: int = WINDOW) -> None:
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # of open windows by fill level
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.windows = 0

    def level(self, length: int) -> int:
        """The fill level that a piece shorter than a window goes to; 0 is a new window."""
        size, count = self.size, self.count
        # Moving a window from level h to h + length changes the sum by 2 (count[h + length] - count[h] + 1); a filled
        # window leaves the sum, and a new one starts at level 0, which isn't counted.
        change = 2 * (count[length : size + 1] - count[: size - length + 1]) + 2
        change[0] = 2 * count[length] + 1
        change[-1] = 1 - 2 * count[size - length]
        change[1:][count[1 : size - length + 1] == 0] = np.iinfo(np.int64).max
        return int(change.argmin())

    def put(self, level: int, length: int) -> int:
        """The window of ``level`` that takes a piece."""
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        else:
            window = self._new()
        if level + length < self.size:
            self.open[level + length].append(window)
            self.count[level + length] += 1
        return window

    def place(self, length: int) -> tuple[int, int]:
        level = 0 if length == self.size else self.level(length)
        return self.put(level, length), level

    def place_part(self, length: int, most_open: int) -> tuple[int, int, int]:
        """Window, offset and the length placed: less than ``length`` if the piece must be cut to fill the fullest window."""
        level = 0 if length == self.size else self.level(length)
        if length < self.size and not level and int(self.count.sum()) >= most_open:
            level = int(np.flatnonzero(self.count)[-1])
            length = min(length, self.size - level)
        return self.put(level, length), level, length

    def _new(self) -> int:
        self.windows += 1
        return self.windows - 1


def pack_lengths(lengths: Iterator[int], size: int = WINDOW, most_open: int = MOST_OPEN) -> Iterator[tuple[int, int, int, int, int]]:
    """(document's place, start, length, window, offset) of every piece; the last ones come when ``lengths`` ends."""
    packer = SumOfSquares(size)
    held: dict[int, list[tuple[int, int, int, int]]] = {}  # of windows not yet full
    for place, total in enumerate(lengths):
        start = 0
        while start < total:
            window, offset, length = packer.place_part(min(size, total - start), most_open)
            held.setdefault(window, []).append((place, start, length, offset))
            if offset + length == size:
                for p, s, n, o in held.pop(window):
                    yield p, s, n, window, o
            start += length
    windows = sorted(held)  # take their ids again, in order
    at = 0
    for window in windows:
        for place, start, length, _ in held[window]:
            while length:
                into, offset = divmod(at, size)
                part = min(length, size - offset)
                yield place, start, part, windows[into], offset
                at, start, length = at + part, start + part, length - part


def _packer(path: str, by_rank: bool, size: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = remembered_words(path, by_rank)
        first = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        docs: dict[int, tuple[int | None, bytes, list[int]]] = {}  # place -> id, ids, ids not yet emitted

        def lengths() -> Iterator[int]:
            place = 0
            for batch in batches:
                names, texts = batch.column(0).to_pylist(), batch.column(1)
                for at in range(0, len(names), 128):
                    some = [t or "" for t in texts.slice(at, 128).to_pylist()]
                    for name, ids in zip(names[at : at + 128], encode.texts(some), strict=True):
                        ids += end
                        docs[place] = (name, ids, [len(ids) // 4])
                        yield len(ids) // 4
                        place += 1

        rows: list[tuple] = []
        for place, start, length, window, offset in pack_lengths(lengths(), size):
            name, ids, left = docs[place]
            part = ids[4 * start : 4 * (start + length)]
            rows.append((name, start, length, zlib.crc32(part), len(ids) // 4, first + window, offset, *[part] * with_ids))
            left[0] -= length
            if not left[0]:
                del docs[place]
            if len(rows) >= 10_000:
                yield _batch(rows, with_ids)
                rows = []
        yield _batch(rows, with_ids)

    return run


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def pack_documents(documents: DataFrame, tokenizer: str, size: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece; ``with_ids`` adds the ids as little-endian 32-bit bytes. A sequence's id is task << 40 | window."""
    slim = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(_packer(tokenizer, merges_by_rank(tokenizer), size, end_id, with_ids), _DDL + (", ids binary" if with_ids else ""))
