"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The Golay code [23,12] is perfect: every 23-bit word
lies within 3 errors of exactly one codeword. The words within one error of a segment decode to at most six codewords,
and segments that differ in one or two bits share one of them. Of 4 differing bits, a segment has none and another at most
two, or two have one each and the third at most two. For the first case keys join a segment as it is with a codeword of
another; for the second, a codeword of one with a half of the other and a third of the last, which pigeonholes leave
equal. The keys of those two kinds therefore meet for all links, and have 29 to 34 bits, so that few others meet.

Links found in a shared key are verified on the whole fingerprints. All members of a key are first held against its least
one; after contraction, keys that still hold several components have their members joined in pairs, of which only those of
different components are kept.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other. Rows of equal fingerprint are
one class. Null ids are never the smallest; a component of null ids alone has a null id. Only ``doc_id`` and ``text``
are read, so other columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quarry.llm.common import maybe_in, settle
from quarry.llm.components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
BOTH, PROBE, HELD = 0, 1, 2
#: Differing bits up to which two fingerprints meet in a key for certain.
REACH = 4


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=">u8"))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the big-endian ``hashes``; zero without any."""
    bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
    whole = len(bits) // 255 * 255
    sums = np.add.reduce(bits[whole:], axis=0, dtype=np.uint8).astype(np.int64)
    if whole:
        sums += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > len(bits)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2)
        prints = np.fromiter((fingerprint(b.to_pybytes() if (b := texts[k].as_buffer()) is not None else None) for k in range(len(texts))), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "text_hash", "print"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` (to find the row again) and the 64-bit ``print``."""
    slim = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(_fingerprints, "doc_id long, text_hash long, print long")


def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low and the high half of a 23-bit word, and the error pattern of each remainder."""

    def remainder(x: int) -> int:
        while x.bit_length() > 11:
            x ^= GENERATOR << (x.bit_length() - 12)
        return x

    one = [remainder(1 << k) for k in range(23)]

    def table(first: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.int64)
        for k in range(bits):
            out[1 << k : 2 << k] = out[: 1 << k] ^ one[first + k]
        return out

    errors = np.zeros(1 << 11, np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                # a == b == c: one error; a == b < c: two errors; else three.
                pattern = (1 << a) | (1 << b) | (1 << c)
                found = one[a] ^ (one[b] if b != a else 0) ^ (one[c] if c != b else 0)
                errors[found] = pattern
    return table(0, 12), table(12, 11), errors


_TABLES = _code_tables()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three errors of each 23-bit word."""
    low, high, errors = _TABLES
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def near_indices(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words within one error of each segment, and a mask without repeats."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    found = np.sort(decode(segment[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    # At most six differ: move them to the front.
    order = np.argsort(~fresh, axis=1, kind="stable")[:, :7]
    return np.take_along_axis(found, order, 1), np.take_along_axis(fresh, order, 1)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place of its fingerprint, role) of every key of unsigned 64-bit ``prints``."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    near = [near_indices(p, bits) for p, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    own = [decode(p) for p in parts]
    keys, places, roles = [], [], []

    def put(tag: int, key: np.ndarray, mask: np.ndarray, role: int) -> None:
        at = np.nonzero(mask)
        keys.append(key[at] | (tag << 40))
        places.append(at[0])
        roles.append(np.full(len(at[0]), role, np.int32))

    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:  # no error in segment i, at most two in segment j
                put(tag, (parts[i] << 12)[:, None] | near[j][0], near[j][1], BOTH)
                tag += 1
    for i, j, k in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        # One error in i: one side's neighbours meet the other's own word. One error in j: one of its halves has none. At
        # most two in k: one of its thirds has none.
        found, mask = near[i]
        for half in _split(parts[j], SEGMENTS[j][1], 2):
            for third in _split(parts[k], SEGMENTS[k][1], 3):
                rest = half << 8 | third
                put(tag, found << 20 | rest[:, None], mask, PROBE)
                put(tag, (own[i] << 20 | rest)[:, None], np.ones((len(prints), 1), bool), HELD)
                tag += 1
    return np.concatenate(keys), np.concatenate(places), np.concatenate(roles)


def _split(segment: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    edges = [bits * k // n for k in range(n + 1)]
    return [(segment >> a) & ((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            keys, places, roles = golay_keys(part.astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[places]), pa.array(roles)], names=["key", "print", "role"])


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def same_kind(a: str, b: str) -> Column:
    return (F.col(a) == BOTH) == (F.col(b) == BOTH)


def meeting_keys(prints: DataFrame) -> DataFrame:
    """``key, print, role, least`` of the keys that can hold a link of the distinct fingerprints ``print``."""
    keys = prints.select("print").mapInArrow(_keys, "key long, print long, role int")
    every = Window.partitionBy("key")
    shared = keys.withColumns({"n": F.count("*").over(every), "least": F.min(F.when(F.col("role") != PROBE, F.col("print"))).over(every)})
    # A key that only probes, or only one fingerprint, holds links nothing.
    return settle(shared.where("n > 1 and least is not null").drop("n"), "golay-keys")


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """``node, root``: components of the distinct fingerprints ``print`` that have a link; a root is a fingerprint."""
    if not 0 <= distance <= REACH:
        raise ValueError("the keys find links of up to 4 differing bits")
    shared = meeting_keys(prints)
    first = shared.where((F.col("print") != F.col("least")) & (apart(F.col("print"), F.col("least")) <= distance)).select(F.col("print").alias("u"), F.col("least").alias("v")).distinct()
    near = components(first)
    tagged = shared.drop("least").join(near, F.col("print") == F.col("node"), "left").select("key", "print", "role", F.coalesce("root", "print").alias("root"))
    mixed = tagged.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    rest = settle(tagged.join(mixed, "key"), "golay-rest")
    one = rest.where(F.col("role") != HELD).select("key", F.col("print").alias("p"), F.col("root").alias("u"), F.col("role").alias("ra"))
    two = rest.where(F.col("role") != PROBE).select("key", F.col("print").alias("q"), F.col("root").alias("v"), F.col("role").alias("rb"))
    across = one.join(two, "key").where(same_kind("ra", "rb") & (F.col("u") != F.col("v")) & (apart(F.col("p"), F.col("q")) <= distance)).select("u", "v").distinct()
    over = components(across)
    merged = near.join(over.select(F.col("node").alias("at"), F.col("root").alias("over")), F.col("root") == F.col("at"), "left").select("node", F.coalesce("over", "root").alias("root"))
    # Roots of the second step that had no link in the first are nodes of their own.
    return settle(merged.union(over.join(near.select("node"), "node", "left_anti")), "links")


def near_duplicates(documents: DataFrame, distance: int = 4) -> DataFrame:
    """``doc_id, text_hash, print, component_id`` of each row, and ``root``, a fingerprint that names its component also
    where all ids are null."""
    slim = settle(fingerprints(documents), "prints")
    classes = settle(slim.groupBy("print").agg(F.min("doc_id").alias("least_id")), "classes")
    found = links(classes, distance)
    rooted = classes.join(found, F.col("print") == F.col("node"), "left").select("print", "least_id", F.coalesce("root", "print").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = settle(rooted.join(roots, "root").select("print", "component_id", "root"), "components")
    return slim.join(of_print, "print").select("doc_id", "text_hash", "print", "component_id", "root")


def component_rows(documents: DataFrame) -> DataFrame:
    found = near_duplicates(documents)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, distance: int = 4) -> DataFrame:
    """One row of ``documents``, with all its columns, of each component: that of the smallest id (a null id is last).

    Of repeated rows of that id, the one with the least text hash and then any of the equal rows stays.
    """
    return keep_rows(documents, near_duplicates(documents, distance))


def keep_rows(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that stay if ``found`` has ``doc_id``, ``text_hash`` and the component's ``root`` of each row.

    Only rows that go, and those that stand more than once, take part in a join; the others pass by it.
    """
    each = settle(found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "keep-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = each.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash"), order).alias("k"))
    is_kept = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_hash") == F.col("k.text_hash"))
    marked = each.join(kept, "root").select(F.xxhash64("doc_id", "text_hash").alias("_key"), is_kept.alias("_stays"), "n")
    touched = settle(marked.where("not _stays or n > 1").select("_key", "_stays"), "keep-touched")
    rows = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("_row"))
    rows = rows.withColumn("_key", F.xxhash64(F.col("_row.doc_id").cast("long"), F.xxhash64("_row.text")))
    known = maybe_in(rows, F.col("_key"), touched.select("_key"))
    met = known.where("_maybe").join(touched, "_key", "left").where("_stays is null or _stays")
    # Equal rows of a kept id are one document; tasks combine them before they are shuffled.
    one = met.where("_stays").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row")
    return known.where("not _maybe").select("_row").union(met.where("_stays is null").select("_row")).union(one).select("_row.*")
