"""Replaying event traces: batch forms by windows and interval joins, and streaming twins.

Events have ``thread, seq, kind, id, addr, size``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quarry.sources.logs import UNIVERSAL_ID, UNKNOWN

PAGE_BITS = 12


def visit_counts(events: DataFrame) -> DataFrame:
    """``bb, cnt``. On a stream this is a running aggregate."""
    return events.where("kind = 'visit'").groupBy(F.col("id").cast("int").alias("bb")).agg(F.count("*").alias("cnt"))


def indirect_targets(events: DataFrame, functions: DataFrame) -> DataFrame:
    """``call, fn``: functions (``addr, fn``; several may share an address) that a call site reached."""
    return events.where("kind = 'icall'").join(functions, "addr").select(F.col("id").alias("call"), "fn").distinct()


def last_writers(events: DataFrame) -> DataFrame:
    """``load, store``: for each load the store that last wrote its first byte; -1 if none did since it was freed.

    A store writes ``size`` bytes from ``addr`` (1 if null); a free resets as many.
    """
    wide = F.when(F.col("kind") == "load", F.lit(1)).otherwise(F.greatest(F.coalesce("size", F.lit(1)), F.lit(1)))
    each = events.where(F.col("kind").isin("load", "store", "free")).select("seq", "kind", "id", F.explode(F.sequence(F.col("addr"), F.col("addr") + wide - 1)).alias("byte"))
    before = Window.partitionBy("byte").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.when(F.col("kind") == "store", F.col("id")).when(F.col("kind") == "free", F.lit(UNKNOWN))
    last = F.coalesce(F.last(wrote, ignorenulls=True).over(before), F.lit(UNKNOWN))
    return each.withColumn("store", last).where("kind = 'load'").select(F.col("id").alias("load"), F.col("store").cast("long").alias("store")).distinct()


def live_ranges(events: DataFrame, forever: int = 2**62) -> DataFrame:
    """``obj, start, stop, born, died``: what malloc, alloca and global events make until the address is freed or reused."""
    own = events.where(F.col("kind").isin("malloc", "alloca", "global", "free"))
    nxt = F.lead("seq").over(Window.partitionBy("addr").orderBy("seq"))
    return own.withColumn("died", F.coalesce(nxt, F.lit(forever))).where("kind <> 'free'").select(F.col("id").alias("obj"), F.col("addr").alias("start"), (F.col("addr") + F.greatest("size", F.lit(1))).alias("stop"), F.col("seq").alias("born"), "died")


def objects_of(accesses: DataFrame, ranges: DataFrame) -> DataFrame:
    """``id, obj``: the object that holds an access' address when it happens; the universal one if none does.

    The interval join is an equal join on pages of 2^12 addresses, so it spreads and needs no cross product.
    """
    paged = ranges.withColumn("page", F.explode(F.sequence(F.shiftright("start", PAGE_BITS), F.shiftright(F.col("stop") - 1, PAGE_BITS))))
    asked = accesses.select("id", "addr", "seq", F.shiftright("addr", PAGE_BITS).alias("page"))
    hit = asked.join(paged, "page").where("addr >= start and addr < stop and seq >= born and seq < died").select("id", "addr", "seq", "obj")
    met = asked.drop("page").join(hit, ["id", "addr", "seq"], "left")
    return met.select("id", F.coalesce("obj", F.lit(UNIVERSAL_ID)).alias("obj")).distinct()


def split_ranges(ranges: DataFrame, fields: DataFrame) -> DataFrame:
    """Ranges cut at field accesses (``obj, offs``): the part from an offset on has the object's id plus the offset's rank."""
    cuts = fields.join(ranges, "obj").where("offs > 0 and start + offs < stop").select("obj", "offs").distinct()
    all_cuts = cuts.union(ranges.select("obj", F.lit(0).cast("long").alias("offs"))).distinct()
    w = Window.partitionBy("obj").orderBy("offs")
    parts = all_cuts.withColumn("k", F.row_number().over(w) - 1).withColumn("next", F.lead("offs").over(w))
    out = parts.join(ranges, "obj")
    return out.select((F.col("obj") + F.col("k")).alias("obj"), (F.col("start") + F.col("offs")).alias("start"), F.coalesce(F.col("start") + F.col("next"), F.col("stop")).alias("stop"))


def frame_ranges(events: DataFrame) -> DataFrame:
    """Live ranges of a thread's stack: an alloca lives until its frame's return.

    The frame is found from the running call depth; the first return below it ends it.
    """
    w = Window.partitionBy("thread").orderBy("seq")
    step = F.when(F.col("kind") == "call", 1).when(F.col("kind") == "ret", -1).otherwise(0)
    deep = events.where(F.col("kind").isin("call", "ret", "alloca")).withColumn("depth", F.sum(step).over(w))
    is_ret = F.col("kind") == "ret"
    frames = deep.where("kind <> 'call'").withColumn("frame", F.when(is_ret, F.col("depth") + 1).otherwise(F.col("depth")))
    later = Window.partitionBy("thread", "frame").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    died = F.first(F.when(is_ret, F.col("seq")), ignorenulls=True).over(later)
    least = frames.withColumn("died", died).where("kind = 'alloca'")
    return least.select(F.col("id").alias("obj"), F.col("addr").alias("start"), (F.col("addr") + F.col("size")).alias("stop"), F.col("seq").alias("born"), "died")


class StackRecorder:
    """One thread's call stack: recursion is collapsed, and a maximal stack is noted when it first shrinks."""

    def __init__(self, stack: list[int] | None = None, pushed: bool = False, jumps: dict[int, tuple[int, int]] | None = None) -> None:
        self.stack, self.pushed, self.jumps = list(stack or []), pushed, dict(jumps or {})

    def feed(self, kind: str, id_: int) -> list[int] | None:
        """The stack that an event completes, if it does."""
        done = None
        if kind == "call":
            if not self.stack or self.stack[-1] != id_:
                self.stack.append(id_)
                self.pushed = True
        elif kind == "ret":
            done = self._note()
            if self.stack and self.stack[-1] == id_:
                self.stack.pop()
        elif kind == "setjmp":
            self.jumps[id_] = (len(self.stack), self.stack[-1] if self.stack else UNKNOWN)
        elif kind == "longjmp" and id_ in self.jumps:
            done = self._note()
            depth, top = self.jumps[id_]
            if len(self.stack) == depth - 1:
                self.stack.append(top)
            else:
                del self.stack[depth:]
        return done

    def _note(self) -> list[int] | None:
        if not self.pushed:
            return None
        self.pushed = False
        return list(self.stack)


STACK_KINDS = ("call", "ret", "setjmp", "longjmp")


def recorded_stacks(events: DataFrame) -> DataFrame:
    """``stack``: the distinct maximal stacks of all threads, each thread replayed in order."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, recorder = pdf.sort_values("seq"), StackRecorder()
        found = {tuple(s) for k, i in zip(pdf["kind"], pdf["id"], strict=True) if (s := recorder.feed(k, int(i)))}
        return pd.DataFrame({"stack": [list(s) for s in sorted(found)]})

    own = events.where(F.col("kind").isin(*STACK_KINDS)).select("thread", "seq", "kind", "id")
    return own.groupBy("thread").applyInPandas(replay, "stack array<long>").distinct()


def stream_stacks(events: DataFrame) -> DataFrame:
    """``thread, stack`` as stacks complete, from a stream of events that come in order within a thread."""

    def replay(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recorder = StackRecorder()
        if state.exists:
            stack, pushed, slots, depths, tops = state.get
            recorder = StackRecorder(list(stack), bool(pushed), {int(s): (int(d), int(t)) for s, d, t in zip(slots, depths, tops, strict=True)})
        found = []
        for pdf in batches:
            ordered = pdf.sort_values("seq")
            found += [s for k, i in zip(ordered["kind"], ordered["id"], strict=True) if (s := recorder.feed(k, int(i)))]
        jumps = list(recorder.jumps.items())
        state.update((recorder.stack, recorder.pushed, [s for s, _ in jumps], [d for _, (d, _) in jumps], [t for _, (_, t) in jumps]))
        yield pd.DataFrame({"thread": [key[0]] * len(found), "stack": found})

    own = events.where(F.col("kind").isin(*STACK_KINDS)).select("thread", "seq", "kind", "id")
    kept = "stack array<long>, pushed boolean, slots array<long>, depths array<long>, tops array<long>"
    return own.groupBy("thread").applyInPandasWithState(replay, "thread long, stack array<long>", kept, "append", "NoTimeout")


def stack_checks(stacks: DataFrame, invalid: DataFrame) -> DataFrame:
    """Recorded stacks of which a prefix is invalid."""
    each = stacks.select("stack", F.explode(F.transform(F.sequence(F.lit(1), F.size("stack")), lambda n: F.slice("stack", 1, n))).alias("prefix"))
    return each.join(invalid.select(F.col("stack").alias("prefix")).distinct(), "prefix", "left_semi").select("stack").distinct()
