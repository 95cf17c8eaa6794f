"""Language-model scoring by online logistic context mixing, beside an add-one unigram score.

Texts are coded bit by bit. Several predictors, each keyed by a hashed context (the last two bytes, the last four, the
word so far), give a probability for every bit from counts over all training texts. Their logits are summed with weights
that a gate selects (bit position and place in the word); the weights start alike for every text and are refined as it is
read, by the gradient of the coding cost, after each block. Block k holds at most ``2 ** (k + 6)`` bytes.

Counts are gathered in Spark as rows per (context, byte), at most 2^24 for each predictor whatever the corpus, and so the
predictors' tables, one byte a bit node, are small enough to send to every task (three times 16 MB at most). Word counts
have no such bound: the most frequent words, at most ``HEAD``, are sent to every task, the others are joined with the counts.

Defined results: a null text is empty, and scores as its end alone; null ids hash as the empty string; repeated rows are
documents of their own. Without training texts all counts are 0. An empty table gives no rows. Only ``doc_id`` and
``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import settle

PREDICTORS = 3
HEAD = 1 << 17
WORDS_HELD = 300_000  # distinct words a task counts before it passes the counts on
ROWS = 500  # documents taken out of a batch at once
FOLDS, HELD_OUT = 7, 2
END = b"\n"  # stands for the end token: no word contains it
STEP = 16.0  # table entries to a unit of logit
RATE = 0.02
CHUNK = 1 << 20  # bytes counted at once
SCORED_CHUNK = 1 << 18  # bytes scored at once, which take about 400 bytes of arrays each
MAX_BLOCK = 4096
GATES = 3

_BYTES = np.arange(256)
#: For each byte, its eight bits and the eight nodes of the binary tree that lead to it.
BITS = ((_BYTES[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float32)
NODES = np.stack([(1 << k) | (_BYTES >> (8 - k)) for k in range(8)], axis=1).astype(np.intp)
SIGNS = 2 * BITS - 1


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def contexts(data: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For every byte, each predictor's 16-bit context, and the gate: 0 at a word's start, 1 early, 2 later in it.

    ``data`` holds texts with at least six zero bytes before each.
    """
    n = len(data)
    wide = data.astype(np.uint32)

    def back(k: int) -> np.ndarray:
        out = np.zeros(n, np.uint32)
        out[k:] = wide[: n - k]
        return out

    def hashed(x: np.ndarray) -> np.ndarray:
        return ((x * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)

    b1, b2, b3, b4 = (back(k) for k in (1, 2, 3, 4))
    two = ((b2 << np.uint32(8)) | b1).astype(np.int32)
    four = hashed((((b4 * np.uint32(271) + b3) * np.uint32(257) + b2) * np.uint32(263)) + b1)
    inside, word, gate = b1 > 32, np.where(b1 > 32, b1, 0).astype(np.uint32), np.zeros(n, np.int8)
    gate[inside] = 1
    for k in range(2, 7):
        b = back(k)
        inside &= b > 32
        if k == 3:
            gate[inside] = 2
        word = word * np.uint32(0x01000193) + np.where(inside, b + np.uint32(1), 0).astype(np.uint32)
    return [two, four, hashed(word ^ np.uint32(0x5BD1E995))], gate


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, each with an end byte 0 and zeros before, as one array; where each starts, and its length with the end."""
    gap = bytes(8)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = 8 + np.cumsum(lengths + 8) - (lengths + 8)
    return data, starts, lengths + 1


def _chunks(ids: list, texts: list[bytes], size: int) -> Iterator[tuple[list, list[bytes]]]:
    at = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= size or k == len(texts) - 1:
            yield ids[at : k + 1], texts[at : k + 1]
            at, total = k + 1, 0


def _lower(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and lower-cased texts, about ``size`` bytes at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield from _chunks(some.column(0).to_pylist(), [(t or b"").lower() for t in some.column(1).to_pylist()], size)


GATHERED = pa.schema([("word", pa.binary()), ("cell", pa.int32()), ("n", pa.int64())])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts over its training texts: of words, and of (predictor, context, byte) cells."""
    tables = [np.zeros(1 << 24, np.int32) for _ in range(PREDICTORS)]
    words: Counter[bytes] = Counter()

    def of_words() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int32()), pa.array(list(words.values()), pa.int64())], schema=GATHERED)
        words.clear()
        return out

    for ids, texts in _lower(batches, CHUNK):
        texts = [t for i, t in zip(ids, texts, strict=True) if not held_out(i)]
        if not texts:
            continue
        for t in texts:
            words.update(t.split())
        words[END] += len(texts)
        data, starts, lengths = _joined(texts)
        found, _ = contexts(data)
        mask = _scored(len(data), starts, lengths)
        for table, context in zip(tables, found, strict=True):
            cells = np.sort((context[mask] << 8) | data[mask])
            first = np.append(0, np.flatnonzero(cells[1:] != cells[:-1]) + 1)
            table[cells[first]] += np.diff(np.append(first, len(cells))).astype(np.int32)
        if len(words) > WORDS_HELD:
            yield of_words()
    if words:
        yield of_words()
    for k, table in enumerate(tables):
        cells = np.flatnonzero(table)
        for at in range(0, len(cells), 100_000):
            some = cells[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.binary()), pa.array((some + (k << 24)).astype(np.int32)), pa.array(table[some].astype(np.int64))], schema=GATHERED)


def _scored(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[starts + lengths] -= 1
    return np.cumsum(edge[:n], dtype=np.int8).astype(bool)


def node_logits(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The logits, in steps, of the 256 tree nodes of each of 256 contexts; ``cells``: context << 8 | byte."""
    tree = np.zeros((256, 512))
    tree[cells >> 8, 256 + (cells & 255)] = counts
    for node in range(255, 0, -1):
        tree[:, node] = tree[:, 2 * node] + tree[:, 2 * node + 1]
    ones, zeros = tree[:, 3::2] + 0.4, tree[:, 2::2] + 0.4
    out = np.zeros((256, 256), np.int8)
    out[:, 1:] = np.clip(np.rint(STEP * np.log(ones / zeros)), -127, 127)
    return out


def _block_table(pdf: pd.DataFrame) -> pd.DataFrame:
    block = pdf["block"].iloc[0]
    table = node_logits(pdf["cell"].to_numpy() & 0xFFFF, pdf["n"].to_numpy())
    return pd.DataFrame({"block": [block], "logits": [table.tobytes()]})


class Model:
    """The predictors' tables, as they are used, and the frequent words' counts."""

    def __init__(self, blocks: dict[int, bytes], head: dict[bytes, int]) -> None:
        self.head = head
        dense = [np.zeros((256, 1 << 16), np.int8) for _ in range(PREDICTORS)]
        for block, logits in blocks.items():
            dense[block >> 8][block & 255] = np.frombuffer(logits, np.int8)
        self.tables = [t.reshape(-1) for t in dense]


def _block_edges(longest: int) -> list[int]:
    edges, size = [0], 64
    while edges[-1] < longest:
        edges.append(edges[-1] + size)
        size = min(2 * size, MAX_BLOCK)
    return edges


def cost(tables: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """The natural logarithm of the model's probability of each text and its end."""
    data, starts, lengths = _joined(texts)
    found, gate = contexts(data)
    weights = np.full((PREDICTORS, len(texts) * GATES, 8), 0.45 / STEP, np.float32)
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    out = np.zeros(len(texts))
    small = np.uint16 if weights.shape[1] <= 1 << 16 else np.int64  # short keys sort in linear time
    edges = _block_edges(int(falling[0]))
    for low, high in zip(edges, edges[1:], strict=False):
        live = order[: int(np.searchsorted(-falling, -low, "left"))]
        sizes = np.minimum(lengths[live], high) - low
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1])) + np.repeat(starts[live] + low - (ends - sizes), sizes)
        key = (np.repeat(live, sizes) * GATES + gate.take(place)).astype(small)
        # Bytes by (text, gate): each set of weights gets the sums over its own.
        by = np.argsort(key, kind="stable")
        place, key = place.take(by), key.take(by)
        first = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        sets = key[first].astype(np.intp)
        many = np.diff(np.append(first, len(key)))
        lane = np.repeat(np.arange(len(sets)), many)
        symbol = data.take(place)
        nodes, signs = NODES.take(symbol, axis=0), SIGNS.take(symbol, axis=0)
        logits, x = [], np.zeros(signs.shape, np.float32)
        for k, (table, context) in enumerate(zip(tables, found, strict=True)):
            z = table.take((context.take(place).astype(np.intp) << 8)[:, None] + nodes)
            logits.append(z)
            x += weights[k].take(sets, axis=0).take(lane, axis=0) * z
        # For the bit that came: p = 1 / (1 + odds), and the gradient's error is the other bit's probability.
        odds = np.exp(-np.clip(signs * x, -60, 60))
        total = 1 + odds
        gain = np.add.reduceat(np.log(total), first, axis=0).sum(axis=1, dtype=np.float64)
        out -= np.bincount(sets // GATES, gain, len(texts))
        if high < falling[0]:
            error = signs * (odds / total)
            rate = (RATE / STEP / np.sqrt(many)).astype(np.float32)[:, None]
            for k, z in enumerate(logits):
                weights[k, sets] += rate * np.add.reduceat(error * z, first, axis=0) / np.float32(STEP)
    return out


class _Logs(dict):
    """log10(c + 1) of frequent words; others give 0 and are noted."""

    def __init__(self, head: dict[bytes, int]) -> None:
        super().__init__((w, math.log10(n + 1)) for w, n in head.items())
        self.others: list[bytes] = []

    def __missing__(self, word: bytes) -> float:
        self.others.append(word)
        return 0.0


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("head_sum", pa.float64()), ("others", pa.list_(pa.binary())), ("score", pa.float64())])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables, logs = model.tables, _Logs(model.head)
        for ids, texts in _lower(batches, SCORED_CHUNK):
            scores = cost(tables, texts) / math.log(10)
            rows = []
            for i, t, s in zip(ids, texts, scores.tolist(), strict=True):
                words = t.split()
                logs.others = []
                known = sum(map(logs.__getitem__, words))
                rows.append((i, held_out(i), len(t), len(words), known, logs.others, s))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCORED.types, strict=True)], schema=SCORED)

    return run


def train(documents: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts ``word, n`` of all training words (and of the end)."""
    gathered = _slim(documents).mapInArrow(_gather, "word binary, cell int, n long")
    counts = settle(gathered.groupBy("word", "cell").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.where("word is not null").select("word", "n")
    cells = counts.where("cell is not null").select(F.shiftright("cell", 16).alias("block"), "cell", "n")
    blocks = cells.groupBy("block").applyInPandas(_block_table, "block int, logits binary").toArrow().to_pydict()
    top = words.where(F.col("n") >= _head_count(words)).toArrow().to_pydict()
    return Model(dict(zip(blocks["block"], blocks["logits"], strict=True)), dict(zip(top["word"], top["n"], strict=True))), words


def _head_count(words: DataFrame) -> int:
    """The least count that at most ``HEAD`` words reach, on a scale of hundredths of a logarithm."""
    scale = words.groupBy(F.floor(100 * F.log("n")).cast("int").alias("at")).agg(F.min("n").alias("n"), F.count("*").alias("c")).collect()
    least, held = 1 << 62, 0
    for r in sorted(scale, key=lambda r: -r["at"]):
        held += r["c"]
        if held > HEAD:
            break
        least = r["n"]
    return least


def _slim(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))


def score_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row."""
    spark = documents.sparkSession
    model, words = train(documents)
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0)).alias("ends")).first()
    shared = spark.sparkContext.broadcast(model)
    scored = _slim(documents).mapInArrow(_scorer(shared), "doc_id long, held_out boolean, n_bytes long, n_words long, head_sum double, others array<binary>, score double")
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")  # the numbers stay as written
    rare = scored.select("row", F.explode("others").alias("word")).join(words, "word")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_sum"), F.count("*").alias("rare_known"))
    met = scored.withColumn("n_others", F.size("others").cast("long")).drop("others").join(rare, "row", "left")
    n_tokens = F.col("n_words") + 1
    known = F.col("n_words") - F.col("n_others") + F.coalesce("rare_known", F.lit(0)) + int(totals["ends"] > 0)
    logs = F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0)) + math.log10(totals["ends"] + 1)
    base = logs - n_tokens * math.log10(totals["n"] + totals["v"] + 1)
    bits = -F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))
    return met.select("doc_id", "held_out", n_tokens.alias("n_tokens"), known.alias("n_known"), F.lit(int(totals["n"])).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
