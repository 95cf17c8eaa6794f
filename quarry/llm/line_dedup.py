"""Line dedup across documents by a deletion-neighbourhood join.

A line that has a word goes if an earlier one (by document id, then line number) has the same words. A line of at least
``min_words`` words also goes if an earlier one is one word edit away: a word replaced, added or left out. What is dropped
doesn't depend on whether the earlier line itself stays.

Every line of that length emits the hash of each variant with one word left out, and of itself. Two lines are one
replacement apart if they share a variant with the word left out at the same place, and one addition apart if one's
variant is the other itself. A key thus needs only its earliest line: no pairs within a key are made. The found pairs
(line, earliest) are verified word by word. One edit cannot change both ends of a line, so only lines that share their
first or their last words (almost half of them) with another emit variants, and only at places outside of a shared end.

Texts are not shuffled, but for those of documents that lose a line and those that pass the bit filter by chance. Joins of
texts and lines are merge joins at every size: what they meet grows with the corpus and is never sent to all tasks.

Defined results: null texts stay null and have no lines; empty texts stay. Every row is a document of its own: rows that
share an id come one after another in a fixed order of their texts' hashes, and null ids come after all others. Lines
without a word stay. A text whose lines all go becomes empty; no document is dropped. An empty table gives an empty one.
All columns are kept, whatever their names; ``n_chars``, where there is one, follows the new text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quarry.llm.common import SPACES, bucketed_rank, forget, maybe_in, settle, split_words


@dataclass(frozen=True)
class Settings:
    min_words: int = 10
    max_words: int = 1 << 20  # ends get no longer than half of this

    def ends(self) -> list[int]:
        """Lengths of the compared ends: a line of n words uses the largest m with 2 m + 1 <= n."""
        out = [max(1, (self.min_words - 1) // 2)]
        while 2 * out[-1] < self.max_words:
            out.append(out[-1] * 3 // 2 + (out[-1] < 2))
        return out


#: Buckets in which the rows of one id are ranked.
BUCKETS = 64
#: No text has more lines: it would have more bytes than a value can.
MOST_LINES = 1 << 31


@dataclass(frozen=True)
class Places:
    """A document is (id - low) * ranks + its rank among the rows of that id, null ids after all others; a line's place is
    document * lines + line number. Both are of ``kind``: long, or decimal where ids are too far apart for that."""

    low: int
    top: int  # stands for a null id
    ranks: int
    lines: int

    @property
    def kind(self) -> str:
        return "long" if (self.top - self.low + 1) * self.ranks * self.lines < 1 << 62 else "decimal(38,0)"

    def number(self, id_: Column) -> Column:
        null = F.lit(str(self.top - self.low)).cast(self.kind)
        return F.coalesce((id_.cast(self.kind) - F.lit(str(self.low)).cast(self.kind)).cast(self.kind), null)

    def document(self, number: Column, rank: Column) -> Column:
        return (number * self.ranks + rank).cast(self.kind)

    def place(self, document: Column, line_no: Column) -> Column:
        return (document * self.lines + line_no).cast(self.kind)

    def split(self, place: str) -> tuple[Column, Column]:
        """The document and the line number of a place."""
        at = F.pmod(F.col(place), F.lit(self.lines).cast(self.kind)).cast("int")
        if self.kind == "long":
            return F.expr(f"{place} div {self.lines}L"), at
        return F.round((F.col(place) - at) / self.lines).cast(self.kind), at


def numbered(documents: DataFrame) -> tuple[DataFrame, Places]:
    """``_row`` (all columns) and ``_doc``, which no other row has and which orders the documents.

    Only rows that share their id are written out: equal ones can't be told apart otherwise.
    """
    ids = documents.select(F.col("doc_id").cast("long").alias("id"))
    shared = settle(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "line-shared-ids")
    seen = ids.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    low, top, most = seen["low"] or 0, (seen["high"] or 0) + 1, shared.agg(F.max("n").alias("n")).first()["n"] or 1
    lines = MOST_LINES
    if (top - low + 1) * most * lines >= 1 << 62:  # only then are the texts read for it
        lines = (documents.agg(F.max(F.octet_length("text")).alias("n")).first()["n"] or 0) + 2
    at = Places(low, top, most, lines)
    rows = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("_row"))
    rows = rows.withColumn("_id", at.number(F.col("_row.doc_id").cast("long")))
    doc = lambda rank: at.document(F.col("_id"), rank).alias("_doc")
    if most == 1:
        return rows.select("_row", doc(F.lit(0))), at
    shared = shared.select(at.number(F.col("id")).alias("_id"))
    hashed = rows.join(shared, "_id").withColumns({"_hash": F.xxhash64("_row.text"), "_tie": F.monotonically_increasing_id()})
    hashed = settle(hashed, "line-shared-rows")
    # One row of each text by the text's hash, then their copies, dealt out evenly: those lose the same lines in any order.
    copies = hashed.select("_id", "_hash", "_tie")
    ones = copies.groupBy("_id", "_hash").agg(F.min("_tie").alias("_one"))
    spread = F.when(F.col("_one").isNotNull(), F.pmod("_hash", F.lit(BUCKETS))).otherwise(F.pmod(F.xxhash64("_tie"), F.lit(BUCKETS)) + BUCKETS)
    dealt = settle(copies.join(ones.select("_one"), F.col("_tie") == F.col("_one"), "left").withColumn("_spread", spread), "line-copies")
    ranks = bucketed_rank(dealt, ["_id"], [F.col("_hash"), F.col("_tie")], F.col("_spread"), 2 * BUCKETS, "_rank")
    ranks = ranks.select(F.col("_tie").alias("_at"), "_rank")
    ranked = hashed.join(ranks, F.col("_tie") == F.col("_at")).select("_row", doc(F.col("_rank")))
    return settle(ranked, "line-ranked-rows").union(rows.join(shared, "_id", "left_anti").select("_row", doc(F.lit(0)))), at


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_table(rows: DataFrame, at_: Places, settings: Settings) -> DataFrame:
    """``place, h1, h2`` of every line that has a word, and the ends of those that are long enough for edits."""
    slim = rows.select("_doc", F.posexplode(_lines(F.col("_row.text"))).alias("line_no", "line"))
    # The words with one space between them; few lines need the regular expression.
    bare = slim.withColumn("bare", F.btrim(F.translate("line", SPACES, " " * len(SPACES)))).where("bare <> ''")
    norm = F.when(F.contains("bare", F.lit("  ")), F.regexp_replace("bare", " +", " ")).otherwise(F.col("bare"))
    spaces = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit("")))
    worded = bare.withColumn("norm", norm).withColumn("n", spaces + 1)
    place = at_.place(F.col("_doc"), F.col("line_no"))

    ends = settings.ends()
    at = F.when(F.col("n") >= settings.min_words, F.lit(ends[0]))
    before = F.lit(None).cast("int")  # a line at the lower edge of its length also has the ends of those one shorter
    for shorter, m in zip(ends, ends[1:], strict=False):
        at = F.when(F.col("n") >= max(2 * m + 1, settings.min_words), m).otherwise(at)
        before = F.when(F.col("n") == 2 * m + 1, shorter).otherwise(before)
    worded = worded.withColumns({"m": at, "m2": before})

    def end(m: str, side: int) -> Column:
        part = F.call_function("substring_index", F.col("norm"), F.lit(" "), F.col(m) * side)
        return F.when(F.col(m).isNotNull(), F.xxhash64(F.lit(side), F.col(m), part))

    keys = {"head": end("m", 1), "tail": end("m", -1), "head2": end("m2", 1), "tail2": end("m2", -1)}
    return worded.select(place.alias("place"), F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), F.col("norm")).alias("h2"), "m", "m2", *(v.alias(k) for k, v in keys.items()))


CARRIED = ("m", "m2", "head", "tail", "head2", "tail2")


def _candidates(distinct: DataFrame) -> DataFrame:
    """``first, head, tail`` of the distinct lines that share an end with another: the length of the shortest one shared
    at each side."""
    ends = F.array(*(F.struct(F.col(e).alias("end"), F.lit(side).alias("side"), F.col(m).alias("m")) for e, side, m in (("head", 1, "m"), ("tail", -1, "m"), ("head2", 1, "m2"), ("tail2", -1, "m2"))))
    keys = distinct.select("first", F.explode(F.filter(ends, lambda e: e["end"].isNotNull())).alias("e")).select("first", "e.*")
    shared = keys.groupBy("end").agg(F.count("*").alias("c")).where("c > 1").select("end")
    met = keys.join(shared.hint("merge"), "end", "left_semi")
    return met.groupBy("first").agg(F.min(F.when(F.col("side") == 1, F.col("m"))).alias("head"), F.min(F.when(F.col("side") == -1, F.col("m"))).alias("tail"))


def _words_of(rows: DataFrame, at: Places, candidates: DataFrame) -> DataFrame:
    """``first, head, tail, words`` of the candidates, taken from their earliest documents."""
    doc, line_no = at.split("first")
    split = candidates.select("first", "head", "tail", doc.alias("id"), line_no.alias("line_no"))
    wanted = settle(split.groupBy("id").agg(F.collect_list(F.struct("first", "head", "tail", "line_no")).alias("wanted")), "line-wanted")
    slim = rows.select(F.col("_doc").alias("id"), F.col("_row.text").alias("text"))
    some = maybe_in(slim, F.col("id"), wanted.select("id")).where("_maybe").drop("_maybe")
    each = some.join(wanted.hint("merge"), "id").select(_lines(F.col("text")).alias("lines"), F.explode("wanted").alias("w"))
    return each.select("w.first", "w.head", "w.tail", split_words(F.get("lines", F.col("w.line_no"))).alias("words"))


def near_lines(rows: DataFrame, at: Places, distinct: DataFrame) -> DataFrame:
    """``first``: the earliest place of every distinct line that has an earlier one at one word edit."""
    worded = _words_of(rows, at, settle(_candidates(distinct), "line-candidates")).where(F.size("words") > 0)
    worded = settle(worded, "line-words")
    each = worded.select("first", "head", "tail", F.size("words").alias("n"), F.posexplode("words").alias("i", "w"))
    # A sequence's hash is the exclusive or of its (place, word) hashes; leaving out word i moves the later ones down.
    each = each.select("first", "head", "tail", "n", "i", F.xxhash64("i", "w").alias("here"), F.xxhash64(F.col("i") - 1, "w").alias("down"))
    line = Window.partitionBy("first")
    running = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    upto = each.withColumns({"a": F.bit_xor("here").over(running), "b": F.bit_xor("down").over(running), "down_all": F.bit_xor("down").over(line)})
    rest = F.col("a").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("b")).bitwiseXOR(F.col("down_all"))
    # An edit that leaves a shared end as it is stands outside of it.
    open_ = F.coalesce(F.col("i") >= F.col("head"), F.lit(False)) | F.coalesce(F.col("i") < F.col("n") - F.col("tail"), F.lit(False))
    variants = upto.select("first", "n", "i", rest.alias("v"), "a", open_.alias("open"))
    entries = F.array(
        F.when(F.col("open"), F.struct(F.col("i").alias("at"), "n", F.lit(2).alias("role"), "v")),
        F.when(F.col("open"), F.struct(F.lit(-1).alias("at"), (F.col("n") - 1).alias("n"), F.lit(1).alias("role"), "v")),
        F.when(F.col("i") == F.col("n") - 1, F.struct(F.lit(-1).alias("at"), "n", F.lit(0).alias("role"), F.col("a").alias("v"))),
    )
    entry = variants.select("first", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("first", F.xxhash64("e.at", "e.n", "e.v").alias("key"), "e.role")
    entry = settle(entry, "line-variants")
    # The earliest that a role may meet: a line itself meets longer ones' variants, and they meet it.
    keyed = entry.groupBy("key").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.min(F.when(F.col("role") != 1, F.col("first"))).alias("for1"), F.min(F.when(F.col("role") != 0, F.col("first"))).alias("for0"))
    keyed = settle(keyed.where("least < most").drop("least", "most"), "line-keys")
    earliest = F.when(F.col("role") == 0, F.col("for0")).when(F.col("role") == 1, F.col("for1")).otherwise(F.col("for1"))
    found = entry.join(keyed.hint("merge"), "key").withColumn("earliest", earliest).where("earliest < first").select("first", "earliest").distinct()
    one, two = (worded.select(F.col("first").alias(k), F.col("words").alias(w)) for k, w in (("first", "x"), ("earliest", "y")))
    return found.join(one, "first").join(two, "earliest").where(within_one_edit(F.col("x"), F.col("y"))).select("first").distinct()


def within_one_edit(x: Column, y: Column) -> Column:
    """Whether two word arrays are at most one replaced, added or left-out word apart."""
    shorter = F.least(F.size(x), F.size(y))
    differ = F.filter(F.sequence(F.lit(0), F.greatest(shorter - 1, F.lit(0))), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))
    same = F.coalesce(F.get(differ, F.lit(0)), shorter)  # words that agree from the start
    rest = lambda a, skip: F.slice(a, same + 1 + skip, F.size(a))
    sizes = F.size(x) - F.size(y)
    return F.when(sizes == 0, rest(x, 1) == rest(y, 1)).when(sizes == 1, rest(x, 1) == rest(y, 0)).when(sizes == -1, rest(x, 0) == rest(y, 1)).otherwise(F.lit(False))


def dropped_lines(rows: DataFrame, at: Places, settings: Settings = Settings()) -> DataFrame:
    """``_doc, drops``: the numbers of the lines that go, of every document that has any."""
    lines = settle(line_table(rows, at, settings), "lines")
    distinct = lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("copies"), *(F.min(c).alias(c) for c in CARRIED))
    distinct = settle(distinct, "line-classes", release=True)
    near = settle(near_lines(rows, at, distinct), "line-near", release=True)
    marked = distinct.select("h1", "h2", "first", "copies").join(near.withColumn("near", F.lit(True)), "first", "left")
    gone = settle(marked.where("near or copies > 1").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-gone")
    met = lines.select("place", "h1", "h2").join(gone.hint("merge"), ["h1", "h2"]).where("near or place > first")
    doc, line_no = at.split("place")
    drops = settle(met.select(doc.alias("_doc"), line_no.alias("line_no")).groupBy("_doc").agg(F.array_sort(F.collect_set("line_no")).alias("drops")), "line-drops", release=True)
    forget(lines, distinct, near, gone)
    return drops


def _with_text(documents: DataFrame, settings: Settings) -> DataFrame:
    """``_row`` (all columns), ``_drops`` and the new ``_text``."""
    rows, at = numbered(documents)
    drops = dropped_lines(rows, at, settings)
    known = maybe_in(rows, F.col("_doc"), drops.select("_doc"))
    kept = F.filter(_lines(F.col("_row.text")), lambda x, i: ~F.array_contains(F.col("drops"), i))
    fresh = F.when(F.col("drops").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    met = known.where("_maybe").join(drops.hint("merge"), "_doc", "left").select("_row", F.col("drops").alias("_drops"), fresh.alias("_text"))
    return met.union(known.where("not _maybe").select("_row", F.lit(None).cast("array<int>").alias("_drops"), F.col("_row.text").alias("_text")))


def dedup_lines(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``documents`` without the repeated lines; every row stays, with all its columns."""
    fresh = _with_text(documents, settings)
    out = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return fresh.select(*(out[c].alias(c) if c in out else F.col("_row")[c].alias(c) for c in documents.columns))


def line_report(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_chars, kept_md5`` of every row."""
    fresh = _with_text(documents, settings)
    text = F.coalesce("_text", F.lit(""))
    return fresh.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.coalesce(F.size(_lines(F.col("_row.text"))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.length(text).cast("long").alias("kept_chars"),
        F.md5(text.cast("binary")).alias("kept_md5"),
    )
