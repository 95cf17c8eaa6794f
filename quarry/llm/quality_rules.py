"""Quality rules: decision lists learned by sequential covering, applied as one Spark conditional expression.

Each document gets interpretable statistics. From the labelled ones a list of threshold conjunctions for the rejected
class is grown (by information gain on two thirds of the labelled rows that pass the base rule) and pruned (on the other
third). Every step of the learning is a histogram over all those rows, made in Spark; the driver sees features x bins
counts only.

Defined results: a null or empty text has zero statistics and fails the base rule; repeated rows each get their result;
without usable labels no rule is learned and the base rule alone decides. Labels that are null, or of a null id, are
ignored; of several labels of one id the kindest holds. Equal gains go to the first feature and lowest threshold.
Extra columns of the input are carried unchanged by ``filter_documents``, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import SPACE_RE, forget, maybe_in, settle, split_words

#: None of them follows a text's length, so that long clean texts look like short ones.
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "upper", "line_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Settings:
    bins: int = 32
    max_rules: int = 10
    max_conditions: int = 3
    min_precision: float = 0.95
    min_covered: int = 5
    base_min_words: int = 10
    base_repeat_percent: int = 20


def with_statistics(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the base counts and the features; ``df`` must not use their names (see ``packed``)."""
    out = df.withColumn("_t", F.coalesce(text, F.lit("")))
    out = out.withColumn("_w", split_words(F.col("_t")))
    out = out.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    five = lambda i: F.xxhash64(*(F.get(F.col("_w"), i + k) for k in range(5)))
    out = out.withColumn("_h", F.when(F.col("n_words") > 5, F.transform(F.sequence(F.lit(0), F.size("_w") - 5), five)))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.withColumn("_s", F.when(F.col("_h").isNotNull() & twice, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    near = lambda x, k: (x["h"] == F.get(F.col("_s"), k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(F.col("_s"), F.greatest(k - 1, F.lit(0)))["h"]))
    found = F.filter("_s", lambda x, k: F.coalesce(near(x, k), F.lit(False)))
    out = out.withColumn("_at", F.sort_array(F.transform(found, lambda x: x["i"])))
    steps = F.transform("_at", lambda p, k: F.least(F.lit(5), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(5))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0))

    def left(pattern: str) -> Column:
        return F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))

    out = out.select(
        *(c for c in df.columns),
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        left(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.length("_t").alias("_n_chars"),
        left(r"[A-Z]+").alias("_n_upper"),
    )
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "_n_lines", "_n_chars"))
    ratios = {
        "mean_word": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
        "upper": F.col("_n_upper") / chars,
        "line_words": F.col("n_words") / lines,
    }
    return out.withColumns(ratios).drop("_n_lines", "_n_chars", "_n_upper")


def base_failed(settings: Settings = Settings()) -> Column:
    return (F.col("n_words") < settings.base_min_words) | (100 * F.col("n_repeat_words") > settings.base_repeat_percent * F.col("n_words"))


def labelled_rows(labels: DataFrame) -> DataFrame:
    """One row a document: ``doc_id`` and ``bad``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))


def _covered(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _gain(p: int, n: int, before_p: int, before_n: int) -> float:
    if not p:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(before_p / (before_p + before_n)))


def learn_rules(statistics: DataFrame, settings: Settings = Settings()) -> list[list[Condition]]:
    """Rules for the rejected class from rows with ``doc_id``, ``bad`` and the statistics, over all that pass the base."""
    statistics = statistics.where(~base_failed(settings))
    at = [(i + 1) / settings.bins for i in range(settings.bins - 1)]
    cuts_row = statistics.agg(*(F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES)).first()
    # Below the lowest value of a feature that is mostly constant there is nothing to cut.
    cuts = {f: sorted({float(x) for x in cuts_row[f] or []}) for f in FEATURES}
    if not any(cuts.values()):
        return []

    def code(f: str) -> Column:
        known = F.array(*(F.lit(x) for x in cuts[f])) if cuts[f] else F.array().cast("array<double>")
        return F.size(F.filter(known, lambda t: F.col(f) > t)).cast("int").alias(f)

    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    codes = statistics.select("bad", held.alias("held"), *(code(f) for f in FEATURES))
    table = settle(codes.groupBy("bad", "held", *FEATURES).agg(F.count("*").alias("n")), "labelled")

    def on_codes(c: Condition) -> Column:
        k = cuts[c.feature].index(c.threshold)
        return F.col(c.feature) > k if c.above else F.col(c.feature) <= k

    def all_of(conditions: list[Condition]) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & on_codes(c)
        return out

    rules: list[list[Condition]] = []
    rest = table
    while len(rules) < settings.max_rules:
        rule: list[Condition] = []
        while len(rule) < settings.max_conditions:
            grown = rest.where(~F.col("held") & all_of(rule))
            pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES)))
            counts = grown.select("bad", "n", pairs.alias("x")).groupBy("x.f", "x.b").agg(
                F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0)).alias("m")
            ).collect()
            best = _best_condition(counts, cuts, settings)
            if best is None:
                break
            condition, bad_left = best
            rule.append(condition)
            if not bad_left:
                break
        if not rule:
            break
        rule, precise = _pruned(rest, rule, all_of, settings)
        if not precise:
            break
        rules.append(rule)
        rest = rest.where(~all_of(rule))
    return rules


def _best_condition(counts: list, cuts: dict[str, list[float]], settings: Settings) -> tuple[Condition, int] | None:
    """The condition of highest gain, and how many accepted documents it would still cover."""
    by = {(r["f"], r["b"]): (r["p"], r["m"]) for r in counts}
    first = FEATURES[0]
    total_p = sum(p for (f, _), (p, _) in by.items() if f == first)
    total_n = sum(n for (f, _), (_, n) in by.items() if f == first)
    if total_p < settings.min_covered or not total_n:
        return None
    best, best_gain, left = None, 1e-9, 0
    for f in FEATURES:
        p = n = 0
        for k, threshold in enumerate(cuts[f]):
            p, n = p + by.get((f, k), (0, 0))[0], n + by.get((f, k), (0, 0))[1]
            for above, pp, nn in ((False, p, n), (True, total_p - p, total_n - n)):
                if pp >= settings.min_covered and (gain := _gain(pp, nn, total_p, total_n)) > best_gain:
                    best, best_gain, left = Condition(f, above, threshold), gain, nn
    return best and (best, left)


def _pruned(rest: DataFrame, rule: list[Condition], all_of, settings: Settings) -> tuple[list[Condition], bool]:
    """The prefix of ``rule`` that does best on the held third, and whether it is precise enough on it and on the rest."""
    sums = []
    for k in range(1, len(rule) + 1):
        for name, kind in (("p", F.col("bad")), ("n", ~F.col("bad"))):
            for where, part in (("held", F.col("held")), ("all", F.lit(True))):
                sums.append(F.coalesce(F.sum(F.when(all_of(rule[:k]) & kind & part, F.col("n"))), F.lit(0)).alias(f"{name}{where}{k}"))
    got = rest.agg(*sums).first()
    worth = {k: (got[f"pheld{k}"] - got[f"nheld{k}"]) / max(1, got[f"pheld{k}"] + got[f"nheld{k}"]) for k in range(1, len(rule) + 1)}
    k = max(worth, key=lambda i: (worth[i], -i))
    p, n = got[f"pall{k}"], got[f"nall{k}"]
    held_p, held_n = got[f"pheld{k}"], got[f"nheld{k}"]
    proven = held_p > 0 and held_p >= settings.min_precision * (held_p + held_n)  # on rows it was not grown from
    precise = p / max(1, p + n) >= settings.min_precision and proven and p >= settings.min_covered
    return rule[:k], precise


def fired_rule(rules: list[list[Condition]]) -> Column:
    """The ordered conditional expression: the number, from 1, of the first rule that covers a row, else null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(_covered(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def judged(statistics: DataFrame, rules: list[list[Condition]], settings: Settings = Settings()) -> DataFrame:
    out = statistics.withColumn("base_failed", base_failed(settings)).withColumn("rule", fired_rule(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and the fired ``rule`` of each row of ``documents``.

    The texts are read once; their statistics are settled, and learning and judging use those.
    """
    slim = documents.select("doc_id", F.col("text").alias("_text"))
    stats = settle(with_statistics(slim, F.col("_text")).drop("_text"), "statistics")
    rules = learn_rules(stats.join(labelled_rows(labels), "doc_id"), settings)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(stats, rules, settings).select("doc_id", *base, "base_failed", "kept", "rule")


def filter_documents(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``documents`` that the learned list keeps, with all their columns.

    Rules come from the labelled documents alone; with them the full table is judged row by row, without a shuffle.
    """
    known = settle(labelled_rows(labels.withColumn("doc_id", F.col("doc_id").cast("long"))), "known-labels")
    # Texts are not shuffled: the filter takes out most documents without a label, and the statistics meet the labels.
    slim = documents.select(F.col("doc_id").cast("long"), F.col("text").alias("_text"))
    slim = maybe_in(slim, F.col("doc_id"), known.select("doc_id")).where("_maybe").drop("_maybe")
    stats = settle(with_statistics(slim, F.col("_text")).drop("_text"), "statistics")
    rules = learn_rules(stats.join(known, "doc_id"), settings)
    forget(stats, known)
    packed = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("_row"))
    # A plain filter would be pushed below the statistics, with all their steps inlined into one expression that splits a
    # text anew for each of its words; it does not pass a column that depends on the row's place.
    kept = judged(with_statistics(packed, F.col("_row.text")), rules, settings).withColumn("_place", F.monotonically_increasing_id())
    return kept.where("kept and _place >= 0").select("_row.*")


__all__ = ["Condition", "Settings", "filter_documents", "fired_rule", "judged", "learn_rules", "quality_rules", "with_statistics", "SPACE_RE"]
