"""Sharding by balanced label propagation over groups of equal texts.

Documents of equal text are linked. Every linked document starts with a shard as its label, drawn by a hash of its own; in
rounds of Spark joins, members then move to the shard that most of their neighbours have, as far as quotas allow. Documents
without links fill what is left, so the counts of any two shards differ by one at most (law ``rows``).

The members of a group that share a label are one row (group, shard, count), so a group of any size moves as a few rows.
Ranks and running sums are made per bucket, so no task holds a whole group, shard or table.

Defined results: a null text has no bytes and equals other nulls, not the empty text. Equal texts are those of equal MD5.
Ties between shards are broken by a hash. Repeated rows are documents of their own, which may differ in slot. Null ids are
dealt like others. An empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quarry.llm.common import bucketed_rank, settle

ROWS_PER_BUCKET, LEAST_BUCKETS = 50_000, 256
OVERHEAD = 16
ROUNDS = 6


def shard_quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def _of(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), shard + 1)


def _running(df: DataFrame, partition: list[str], value: str, name: str, buckets: int = LEAST_BUCKETS) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the partition before a row; rows of large values come first, by
    powers of two, then by the group's hash. No task holds a whole partition."""
    size_class = 63 - F.floor(F.log2(F.greatest(F.col(value), F.lit(1))))
    dealt = df.withColumn("_b", size_class * buckets + F.pmod(F.xxhash64("grp"), F.lit(buckets)))
    sums = dealt.groupBy(*partition, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*partition).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*partition, "_b").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, [*partition, "_b"])
    return met.withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_b", "_start", "_inside")


def first_labels(linked: DataFrame, shards: int) -> DataFrame:
    """``grp, shard, n``: the labels that the linked documents (``grp, spread``) start with."""
    label = F.pmod(F.xxhash64("spread", F.lit(3)), F.lit(shards)).cast("int")
    return linked.select("grp", label.alias("shard")).groupBy("grp", "shard").agg(F.count("*").alias("n"))


def _load(state: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(k, 0) for k in range(shards)]


def grants(wanted: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the ``wanted`` moves (from, to) may be made at once, so that no shard takes in more than it has free
    and gives away. Inflows are cut in proportion until all shards agree; they only fall, so this ends."""
    out = dict(wanted)
    while True:
        into, away = [0] * len(free), [0] * len(free)
        for (a, b), n in out.items():
            into[b], away[a] = into[b] + n, away[a] + n
        over = [k for k in range(len(free)) if into[k] > max(0, free[k] + away[k])]
        if not over:
            return out
        for k in over:
            may, keys = max(0, free[k] + away[k]), sorted((key for key in out if key[1] == k), key=lambda key: (-out[key], key))
            parts = {key: out[key] * may // into[k] for key in keys}
            rest = may - sum(parts.values())
            for key in keys:  # what rounding has left over
                more = min(rest, out[key] - parts[key], 1)
                out[key], rest = parts[key] + more, rest - more


def propagate(state: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``grp, shard, n`` after the rounds, from the labels that the linked documents start with; no shard is above its quota.

    During the rounds a shard may hold half as much again, as full shards could only swap; what exceeds quotas leaves at the end.
    """
    return settle(_within(label_rounds(state, [q + q // 2 for q in quotas], rounds, max(1, min(quotas))), quotas), "shard-state")


def label_rounds(state: DataFrame, quotas: list[int], rounds: int, fits: int, moved: list[int] | None = None) -> DataFrame:
    """The rounds: each group names the shard that most of its members have, or as many such shards as it needs (of ``fits``
    members each), and the members elsewhere ask to move there.

    The driver weighs the requests, shards x shards numbers, against the quotas; large parts go first. Whatever isn't
    granted stays and asks again, or names another shard with room, in the next round. ``moved`` gets how many documents
    each round moves.
    """
    shards = len(quotas)
    state = settle(state, "shard-state")
    for k in range(rounds):
        free = [q - n for q, n in zip(quotas, _load(state, shards), strict=True)]
        # A group names as many shards as it needs. In every other round those without room stand back: a group that fits a
        # shard names one with room, a larger one asks for those of the shards that could hold it which aren't full.
        of_group = Window.partitionBy("grp")  # a row a shard
        parts = state.withColumns({"size": F.sum("n").over(of_group), "free": _of(free, F.col("shard")), "h": F.xxhash64("grp", "shard")})
        parts = parts.withColumn("large", F.col("size") > fits)
        stand = F.when(F.col("large") | F.lit(k % 2 == 0), 0).otherwise((F.col("free") > 0).cast("int"))
        ranked = of_group.orderBy(F.desc("stand"), F.desc("n"), F.desc("h"), F.desc("shard"))
        before = F.coalesce(F.sum(F.col("n") + F.col("free")).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.withColumn("stand", stand).withColumns({"at": F.row_number().over(ranked) - 1, "before": before})
        by_room = F.col("large") & F.lit(k % 2 == 1)
        parts = parts.withColumn("home", F.when(by_room, F.col("before") < F.col("size")).otherwise(F.col("at") < F.ceil(F.col("size") / fits)))
        open_ = F.col("home") & (~by_room | (F.col("free") > 0))
        named = F.collect_list(F.when(open_, F.col("shard"))).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        asked = parts.withColumn("named", named).where("not home and size(named) > 0").withColumn("to", F.get("named", F.pmod(F.col("at"), F.size("named"))))
        moves = settle(asked.select("grp", "shard", "to", "n"), "shard-moves")
        wanted = {(r["shard"], r["to"]): r["n"] for r in moves.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        granted = {key: n for key, n in grants(wanted, free).items() if n}
        if moved is not None:
            moved.append(sum(granted.values()))
        if not granted:
            continue
        dim = F.broadcast(state.sparkSession.createDataFrame([(a, b, n) for (a, b), n in granted.items()], "shard int, to int, may long"))  # shards x shards rows
        asked = _running(moves, ["shard", "to"], "n", "before").join(dim, ["shard", "to"])
        go = asked.withColumn("moved", F.greatest(F.lit(0), F.least(F.col("n"), F.col("may") - F.col("before")))).where("moved > 0")
        changes = state.union(go.select("grp", "shard", -F.col("moved"))).union(go.select("grp", "to", "moved"))
        state = settle(changes.groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "shard-state")
    return state


def _within(state: DataFrame, quotas: list[int]) -> DataFrame:
    """Groups that exceed their shard's quota leave it, whole where that is possible, for the room that others have."""
    shards = len(quotas)
    if all(n <= q for n, q in zip(_load(state, shards), quotas, strict=True)):
        return state
    quota, before = _of(quotas, F.col("shard")), F.col("before")
    state = _running(state, ["shard"], "n", "before")
    fits = before + F.col("n") <= quota
    part = F.when(F.col("n") > quota / 2, F.greatest(F.lit(0), quota - before)).otherwise(0)
    kept = F.when(fits, F.col("n")).otherwise(part).cast("long")
    cut = settle(state.withColumn("kept", kept).withColumn("moved", F.col("n") - F.col("kept")).drop("before"), "shard-cut")
    stay, leave = cut.where("kept > 0").select("grp", "shard", F.col("kept").alias("n")), cut.where("moved > 0")
    load = _load(stay, shards)
    over = _load(leave.select("shard", F.col("moved").alias("n")), shards)
    # Those that leave, laid end to end by shard, meet the room, laid end to end by shard.
    leave = _running(leave.select("grp", "shard", "moved"), ["shard"], "moved", "earlier")
    low = _of([sum(over[:k]) for k in range(shards)], F.col("shard")) + F.col("earlier")
    gaps, at = [], 0
    for k in range(shards):
        if (room := quotas[k] - load[k]) > 0:
            gaps.append(F.struct(F.lit(k).alias("to"), F.lit(at).cast("long").alias("a"), F.lit(at + room).cast("long").alias("b")))
            at += room
    placed = leave.withColumn("low", low).withColumn("gap", F.explode(F.array(*gaps)))
    share = F.least(F.col("low") + F.col("moved"), F.col("gap.b")) - F.greatest(F.col("low"), F.col("gap.a"))
    placed = placed.withColumn("share", share).where("share > 0").select("grp", F.col("gap.to").alias("shard"), F.col("share").alias("n"))
    return stay.union(placed).groupBy("grp", "shard").agg(F.sum("n").alias("n"))


def shard_documents(documents: DataFrame, shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``documents``."""
    text = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    grp = F.coalesce(F.unhex(F.md5(text)), F.lit(b"null"))
    slim = documents.select(F.col("doc_id").cast("long"), size.alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), grp.alias("grp"))
    slim = settle(slim.withColumns({"spread": F.xxhash64("doc_id", "grp", F.lit(1)), "_tie": F.monotonically_increasing_id()}), "shard-docs")
    again = settle(slim.groupBy("spread").agg(F.count("*").alias("c")).where("c > 1").select("spread"), "shard-repeated")
    if not again.isEmpty():  # equal rows get hashes of their own, by any order among them
        equal = bucketed_rank(slim.join(again, "spread", "left_semi"), ["spread"], [F.col("_tie")], F.xxhash64("_tie"), LEAST_BUCKETS, "_rank")
        equal = equal.withColumn("spread", F.xxhash64("spread", "_rank")).select(*slim.columns)
        slim = settle(slim.join(again, "spread", "left_anti").select(*slim.columns).union(equal), "shard-docs")
    slim = slim.drop("_tie")
    total = slim.count()
    if not total:
        return _result(slim.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}))
    quotas = shard_quotas(total, shards)
    buckets = max(LEAST_BUCKETS, total // ROWS_PER_BUCKET)
    groups = settle(slim.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1"), "shard-groups")
    linked = slim.join(groups.select("grp"), "grp", "left_semi")
    state = propagate(first_labels(linked, shards), quotas, rounds)
    load = _load(state, shards)

    # Linked documents take their group's shares by their rank in the group.
    by_spread = [F.col("spread"), F.col("doc_id")]
    cells = F.sort_array(F.collect_list(F.struct("shard", "n")))
    shares = state.groupBy("grp").agg(cells.alias("shares"))  # one entry a shard at most
    dealt = slim.withColumn("bucket", F.pmod("spread", F.lit(buckets)).cast("int"))
    counts = dealt.join(groups.select("grp"), "grp", "left_semi").groupBy("grp", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(shares, "grp")
    starts = settle(starts, "shard-starts")
    inside = F.row_number().over(Window.partitionBy("grp", "bucket").orderBy(*by_spread)) - 1
    met = dealt.join(starts, ["grp", "bucket"], "left")
    linked = met.where("start is not null").withColumn("rank", inside + F.col("start"))
    passed = F.aggregate("shares", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("shard")), lambda a, x: F.when(a["shard"] >= 0, a).otherwise(F.struct((a["sum"] + x["n"]).alias("sum"), F.when(F.col("rank") < a["sum"] + x["n"], x["shard"]).otherwise(F.lit(-1)).alias("shard"))))
    linked = linked.withColumn("shard", passed["shard"]).select("doc_id", "size", "text_crc32", "spread", "shard")

    # The others fill the rest, by their rank among all of them.
    single = met.where("start is null").select("doc_id", "size", "text_crc32", "spread").withColumn("all", F.lit(0))
    single = bucketed_rank(single, ["all"], by_spread, F.col("spread"), buckets, "rank")
    ends, at = [], 0
    for k in range(shards):
        at += quotas[k] - load[k]
        ends.append(at)
    fill = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= F.col("rank"))).cast("int")
    single = single.withColumn("shard", fill).select("doc_id", "size", "text_crc32", "spread", "shard")
    placed = settle(linked.union(single), "shard-placed")
    return _result(bucketed_rank(placed, ["shard"], by_spread, F.xxhash64("spread", F.lit(2)), buckets, "slot"))


def _result(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
