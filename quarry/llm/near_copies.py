"""Near copies by the similarity of their shingles: the pipeline's near-duplicate stage.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; one document of each
component of links stays. Links are found exactly, in two steps.

SimHash comes first: each set has a 64-bit fingerprint (all its shingles weigh alike, as they do in the similarity), and the
Golay keys of ``simhash`` meet for every two of up to 4 differing bits. Those pairs are decided there, by their sets.

A similarity of 0.8 is some ten differing bits, and no number of bits is certain to hold for it. The second step finds the
links of more than 4 bits between texts that the first has left apart, and no others. Of two sets of such a similarity the
first ``n // 5 + k`` shingles of each (n: the set's size), in any order that all sets follow, share at least k; here k is
``1 + n // 20`` of the smaller set. Shingles that a sample shows to be frequent come last in that order, so that keys meet
seldom; the sample decides on nothing else.

Pairs of either step are held against an upper bound of their overlap, the sum over buckets of the lesser count of shingles,
and what passes against the whole sets.

Only the keys are written out, and of the sets those that take part in a pair. No key's members are all paired: they are
first held against the key's least member; after contraction, only members of different components are. Pairs of fitting
sizes are verified.

Defined results: words are those of ``fingerprint`` in ``simhash``; a text of up to five words is one shingle; null, empty
and blank texts have none and are copies of each other. Null ids are never the smallest. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import forget, maybe_in, settle
from quarry.llm.components import components
from quarry.llm.simhash import BOTH, HELD, PROBE, REACH, apart, keep_rows, majority, meeting_keys, same_kind

SHINGLE = 5
SAMPLE = 16
#: Frequent shingles that are sent to the tasks, at most (8 bytes each), and how often the sample has them, at least.
FREQUENT, OFTEN = 1 << 17, 4
#: Keys beyond a fifth of a set: one for every so many shingles, and one.
EXTRA = 20
#: Buckets of the counts that bound an overlap; a count of 255 stands for any larger one.
BUCKETS = 512


def shingle_set(text: bytes | None) -> np.ndarray:
    """The sorted hashes of a text's different shingles."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    k = min(n, SHINGLE)
    starts = [0, *ends[:-k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    hashes = np.fromiter((digest(joined[a:b]) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    return np.unique(hashes.view(np.int64))


def _hashed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))


def _of_batch(texts: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """The shingle sets of texts, and a hash of each set."""
    sets = [shingle_set(b.to_pybytes() if (b := texts[k].as_buffer()) is not None else None) for k in range(len(texts))]
    return sets, pa.array(np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, same = _of_batch(batch.column(2))
        yield pa.RecordBatch.from_arrays([same, _lists(sets)], names=["same", "shingles"])


def _frequent(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts has often, sorted, and their counts there."""
    some = _hashed(documents).where(F.pmod("text_hash", F.lit(SAMPLE)) == 0).mapInArrow(_sets, "same long, shingles array<long>")
    counts = some.select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN)
    rows = counts.orderBy(F.desc("c"), "key").limit(FREQUENT).collect()
    keys, counts = np.array([r["key"] for r in rows], np.int64), np.array([r["c"] for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``n // 5 + n // EXTRA + 1`` shingles, the least frequent first."""
    rank = np.zeros(len(shingles), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[at] == shingles, counts[at], 0)
    return shingles[np.argsort(rank, kind="stable")][: len(shingles) // 5 + len(shingles) // EXTRA + 1]


def sketch(shingles: np.ndarray) -> bytes:
    return np.minimum(np.bincount(shingles & (BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose overlap may reach 4/9 of their sizes, by their bucket counts."""
    for batch in batches:
        n = batch.num_rows
        one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, BUCKETS) for k in (4, 5))
        most = np.minimum(one, two).sum(axis=1, dtype=np.int64)
        sizes = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + batch.column(3).to_numpy(zero_copy_only=False)
        keep = (9 * most >= 4 * sizes) | ((one == 255) & (two == 255)).any(axis=1)
        yield batch.select(["u", "v"]).filter(pa.array(keep))


def _prefixes(frequent: np.ndarray, counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, same = _of_batch(batch.column(2))
            sizes = pa.array([len(s) for s in sets], pa.int32())
            keys = _lists([prefix(s, frequent, counts) for s in sets])
            sketches = pa.array([sketch(s) for s in sets], pa.binary())
            prints = pa.array(np.fromiter((majority(s.astype(">i8")) for s in sets), np.uint64, len(sets)).view(np.int64))
            columns = [batch.column(0), batch.column(1), same, sizes, prints, keys, sketches]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "same", "n", "print", "prefix", "sketch"])

    return run


def prefixes(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash`` (to find the row again), ``same`` (equal for equal sets), the set's size ``n``, its
    fingerprint ``print``, its ``prefix`` and its ``sketch``."""
    run = _prefixes(*_frequent(documents))
    return _hashed(documents).mapInArrow(run, "doc_id long, text_hash long, same long, n int, print long, prefix array<long>, sketch binary")


def _fit(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _enough(met: DataFrame) -> DataFrame:
    """The pairs (u, v; n: the smaller size) that share as many keys as similar sets must; a row is one key."""
    shared = met.groupBy("u", "v").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    return shared.where(F.col("c") >= 1 + F.floor(F.col("n") / EXTRA)).select("u", "v")


def _row_key(doc_id: str = "doc_id", text_hash: str = "text_hash") -> Column:
    return F.xxhash64(doc_id, text_hash)


def _verified(pairs: DataFrame, documents: DataFrame, keyed: DataFrame, far: bool = False) -> DataFrame:
    """The ``pairs`` (u, v) of a similarity of 0.8 or more; with ``far`` only those of more than ``REACH`` differing bits. The
    sets are taken from one document each."""
    asked = settle(pairs, "copy-asked", release=True)
    ends = lambda df: df.select(F.col("u").alias("same")).union(df.select(F.col("v").alias("same"))).distinct()
    # Rows of equal sets are combined before any of them is shuffled.
    some = maybe_in(keyed, F.col("same"), ends(asked)).where("_maybe")
    known = some.groupBy("same").agg(F.min(_row_key()).alias("row"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("sketch").alias("sketch"))
    known = settle(known.join(ends(asked), "same", "left_semi"), "copy-sketches")
    of = lambda end: known.select(F.col("same").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "print", "sketch")))
    met = asked.join(of("u"), "u").join(of("v"), "v")
    met = met.where(apart(F.col("print_u"), F.col("print_v")) > REACH) if far else met
    bounded = met.select("u", "v", "n_u", "n_v", "sketch_u", "sketch_v").mapInArrow(_possible, "u long, v long")
    pairs = settle(bounded, "copy-pairs", release=True)
    rows = known.select("same", "row").join(ends(pairs), "same", "left_semi")
    some = maybe_in(_hashed(documents), _row_key(), rows.select("row")).where("_maybe").drop("_maybe")
    some = some.join(rows.select("row"), _row_key() == F.col("row"), "left_semi")
    whole = some.mapInArrow(_sets, "same long, shingles array<long>").groupBy("same").agg(F.first("shingles").alias("s"))
    whole = settle(whole, "copy-sets")
    one, two = whole.select(F.col("same").alias("u"), F.col("s").alias("x")), whole.select(F.col("same").alias("v"), F.col("s").alias("y"))
    # |x and y| / |x or y| >= 4/5
    enough = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
    found = settle(pairs.join(one, "u").join(two, "v").where(enough).select("u", "v"), "copy-verified", release=True)
    forget(asked, known, pairs, whole)
    return found


def close_links(documents: DataFrame, keyed: DataFrame) -> DataFrame:
    """``node, root``: components of the sets' links of up to ``REACH`` differing bits, all of which meet in Golay keys."""
    sets = settle(keyed.groupBy("same").agg(F.first("n").alias("n"), F.first("print").alias("print")), "copy-prints")
    classes = sets.groupBy("print").agg(F.min_by(F.struct("same", "n"), "same").alias("least"), F.count("*").alias("c"))
    classes = settle(classes.select("print", F.col("least.same").alias("v"), F.col("least.n").alias("n_v"), "c"), "copy-classes")
    shared = meeting_keys(classes.select("print"))
    # Every set is held against the least set of its own fingerprint and of those that are the least of a key.
    met = shared.where((F.col("print") != F.col("least")) & (apart(F.col("print"), F.col("least")) <= REACH)).select("print", "least").distinct()
    met = met.union(classes.where("c > 1").select("print", F.col("print").alias("least")))
    held = sets.select(F.col("same").alias("u"), "n", "print").join(met, "print").join(classes.select(F.col("print").alias("least"), "v", "n_v"), "least")
    near = components(_verified(held.where((F.col("u") != F.col("v")) & _fit(F.col("n"), F.col("n_v"))).select("u", "v"), documents, keyed))
    # Then the members of keys that still hold several components. Sets of one fingerprint meet in it as they do in a key.
    rooted = settle(sets.join(near, F.col("same") == F.col("node"), "left").select("print", "same", "n", F.coalesce("root", "same").alias("root")), "copy-rooted")
    own = classes.where("c > 1").select(F.col("print").alias("key"), "print", F.lit(BOTH).alias("role"))
    tagged = settle(shared.select("key", "print", "role").union(own).join(rooted, "print"), "copy-tagged", release=True)
    mixed = tagged.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    rest = settle(tagged.join(mixed, "key"), "copy-mixed", release=True)
    forget(shared, tagged)
    one = rest.where(F.col("role") != HELD).select("key", F.col("same").alias("u"), F.col("print").alias("p1"), F.col("role").alias("a1"), F.col("n").alias("n1"), F.col("root").alias("r1"))
    two = rest.where(F.col("role") != PROBE).select("key", F.col("same").alias("v"), F.col("print").alias("p2"), F.col("role").alias("a2"), F.col("n").alias("n2"), F.col("root").alias("r2"))
    fits = same_kind("a1", "a2") & (F.col("r1") != F.col("r2")) & (apart(F.col("p1"), F.col("p2")) <= REACH) & _fit(F.col("n1"), F.col("n2"))
    across = one.join(two, "key").where(fits).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = _verified(across, documents, keyed).union(near.select(F.col("node").alias("u"), F.col("root").alias("v")))
    found = components(edges)
    forget(sets, classes, rooted, rest)
    return found


def _left_apart(pairs: DataFrame, close: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) that are not in one component of ``close``."""
    of = lambda end: close.select(F.col("node").alias(f"at_{end}"), F.col("root").alias(f"root_{end}"))
    rooted = pairs.join(of("u"), F.col("u") == F.col("at_u"), "left").join(of("v"), F.col("v") == F.col("at_v"), "left")
    return rooted.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def links(documents: DataFrame, keyed: DataFrame) -> DataFrame:
    """``node, root``: components of the different sets (by ``same``) that have a link; ``keyed``: settled ``prefixes``."""
    close = close_links(documents, keyed)
    keys = keyed.select("same", "n", F.explode("prefix").alias("key"))
    met = settle(keys.groupBy("key").agg(F.min("same").alias("least"), F.max("same").alias("most")).where("least < most").select("key", "least"), "copy-met", release=True)
    some = maybe_in(keys, F.col("key"), met.select("key")).where("_maybe").groupBy("key", "same").agg(F.min("n").alias("n"))
    shared = settle(some.join(met, "key"), "copy-shared", release=True)
    least = shared.where("same = least").select("key", F.col("n").alias("n0"))
    first = shared.where("same <> least").join(least, "key").where(_fit(F.col("n"), F.col("n0")))
    first = _enough(first.select(F.col("same").alias("u"), F.col("least").alias("v"), F.least("n", "n0").alias("n")))
    # A pair that doesn't share enough of the keys of which its second is the least waits for the next step.
    known = close.select(F.col("node").alias("u"), F.col("root").alias("v"))
    near = components(_verified(_left_apart(first, close), documents, keyed, far=True).union(known))
    tagged = shared.drop("least").join(near, F.col("same") == F.col("node"), "left").select("key", "same", "n", F.coalesce("root", "same").alias("root"))
    mixed = tagged.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    rest = settle(tagged.join(mixed, "key"), "copy-rest", release=True)
    one = rest.select("key", F.col("same").alias("u"), F.col("n").alias("n1"), F.col("root").alias("r1"))
    two = rest.select("key", F.col("same").alias("v"), F.col("n").alias("n2"), F.col("root").alias("r2"))
    across = one.join(two, "key").where((F.col("u") < F.col("v")) & (F.col("r1") != F.col("r2")) & _fit(F.col("n1"), F.col("n2")))
    across = _enough(across.select("u", "v", F.least("n1", "n2").alias("n")))
    edges = _verified(across, documents, keyed, far=True).union(near.select(F.col("node").alias("u"), F.col("root").alias("v")))
    found = components(edges)
    forget(met, shared, rest)
    return found


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of ``documents``, with all its columns, of each component: chosen as ``simhash.keep_one`` does."""
    keyed = settle(prefixes(documents), "copy-keys")
    found = links(documents, keyed)
    rooted = keyed.select("doc_id", "text_hash", "same").join(found, F.col("same") == F.col("node"), "left")
    return keep_rows(documents, rooted.select("doc_id", "text_hash", F.coalesce("root", "same").alias("root")))
