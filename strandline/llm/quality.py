"""Quality rules: text statistics and a decision list learned from labels, both as Spark expressions.

Sequential covering: a rule grows one threshold condition at a time by FOIL gain on two thirds of the labelled rows, is
pruned back to the prefix that does best on the other third, and joins the list if it is precise enough there; then the
rows it covers leave and the next rule grows. The driver sees only counts by feature and threshold bin. The learned list
becomes one ordered ``CASE WHEN`` expression. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import WS_CLASS, staged, table

FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(hashes: Column, window: int) -> Column:
    """Words inside windows whose hash occurs twice or more, from the array of window hashes (a column of the frame)."""

    def positions(pairs: Column) -> Column:
        n = F.size(pairs)
        same = F.zip_with(F.slice(pairs, F.lit(1), n - 1), F.slice(pairs, F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    def covered(at: Column) -> Column:
        n = F.size(at)
        steps = F.zip_with(F.slice(at, F.lit(1), n - 1), F.slice(at, F.lit(2), n - 1), lambda a, b: F.least(F.lit(window), b - a))
        return F.aggregate(steps, F.lit(window), lambda total, x: total + x)

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(_let(pairs, positions), covered)).otherwise(F.lit(0))


def text_statistics(df: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 8, row: bool = False) -> DataFrame:
    """Key, counts and shares of each row's whole text. Null text counts as empty; shares of nothing are 0.

    row: instead of the key, the whole row as the struct ``key``.
    """
    body = F.col("body")
    rows = df.select((F.struct(*[F.col(f"`{c}`") for c in df.columns]) if row else F.col(key)).alias(key), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("words", F.array_remove(F.split(body, f"{WS_CLASS}+"), "")).withColumn("lines", F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    starts = F.size("words") - F.lit(window - 1)
    rows = rows.withColumn("hashes", F.when(starts > 1, F.transform(F.sequence(F.lit(1), starts), lambda i: F.xxhash64(F.slice("words", i, window)))).otherwise(F.array().cast("array<bigint>")))
    without = lambda pattern: F.length(F.regexp_replace(body, pattern, ""))
    counted = rows.select(
        key,
        F.size("words").cast("bigint").alias("n_words"),
        without(f"{WS_CLASS}+").cast("bigint").alias("word_chars"),
        without("[^#*$%&|<>]+").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("hashes"), window).cast("bigint").alias("n_repeat_words"),
        F.size("lines").alias("full_lines"),
        F.size(F.array_distinct("words")).alias("distinct_words"),
        without("[^A-Z]+").alias("upper"),
        without("[^0-9]+").alias("digits"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_dup_lines", "full_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("distinct_words", "n_words").alias("distinct_share"), share("upper", "word_chars").alias("upper_share"), share("digits", "word_chars").alias("digit_share"),
    )


def _bin(cuts: Sequence[float], value: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= value))


def learn_rules(labelled: DataFrame, features: Sequence[str], bad: str, key: str, *, quantiles: int = 24, max_rules: int = 8, max_conditions: int = 3, least_cover: int = 8, least_precision: float = 0.95, most_for_cuts: int = 200_000) -> list[Rule]:
    """Ordered rules for rows with ``bad`` true, from all labelled rows. No labels, or none bad: no rules.

    Thresholds are exact quantiles; of more than about ``most_for_cuts`` labelled rows, those of a sample of as many that a
    hash of the key picks. All rows count towards the rules themselves.

    A rule must cover ``least_cover`` bad rows of those it grew on and be right for ``least_precision`` of the rows it
    covers on the held-back third (where that third has any).
    """
    points = F.array(*[F.lit(i / quantiles) for i in range(quantiles + 1)])
    every = max(1, math.ceil(labelled.count() / most_for_cuts))
    sample = labelled.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("cuts")), F.lit(every)) == 0)
    found = sample.agg(*[F.percentile(F.when(F.col(bad) == F.lit(side), F.col(f).cast("double")), points).alias(f"{f}_{int(side)}") for f in features for side in (True, False)]).first()
    cuts = {f: sorted({*(found[f"{f}_1"] or []), *(found[f"{f}_0"] or [])}) for f in features}
    bins = [F.struct(F.lit(i).alias("feature"), _bin(cuts[f], F.col(f)).alias("bin")) for i, f in enumerate(features) if cuts[f]]
    if not bins:
        return []
    rows = staged(labelled.select(*features, bad, (F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(3)) < 2).alias("grows"), F.array(*bins).alias("bins")), "labelled")
    hits, misses = F.sum(F.col(bad).cast("int")).alias("p"), F.sum((~F.col(bad)).cast("int")).alias("n")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows
        for r in rules:
            left = left.where(~r.column())
        conditions: list[Condition] = []
        while len(conditions) < max_conditions:
            here = left.where("grows")
            for c in conditions:
                here = here.where(c.column())
            counts: dict[str, dict[int, tuple[int, int]]] = {}
            for x in here.select(bad, F.explode("bins").alias("b")).groupBy("b.feature", "b.bin").agg(hits, misses).collect():
                counts.setdefault(features[x["feature"]], {})[x["bin"]] = (x["p"], x["n"])
            best = _best_condition(counts, cuts, least_cover)
            if best is None:
                break
            conditions.append(best[0])
            if best[1] == 0:  # nothing wrong is left inside
                break
        if not conditions:
            break
        rule = _pruned(left, conditions, bad, least_cover, least_precision)
        if rule is None:
            break
        rules.append(rule)
    return rules


def _best_condition(counts: dict[str, dict[int, tuple[int, int]]], cuts: dict[str, list[float]], least_cover: int) -> tuple[Condition, int] | None:
    best: tuple[float, Condition, int] | None = None
    for feature, by_bin in sorted(counts.items()):
        p_all, n_all = (sum(v[k] for v in by_bin.values()) for k in (0, 1))
        if not p_all or not n_all:
            return None
        before, p_low, n_low = math.log2(p_all / (p_all + n_all)), 0, 0
        for i, cut in enumerate(cuts[feature]):
            # bin i holds values below cut i (and at or above cut i - 1)
            p_low, n_low = p_low + by_bin.get(i, (0, 0))[0], n_low + by_bin.get(i, (0, 0))[1]
            for at_least, p, n in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                if p >= least_cover and (gain := p * (math.log2(p / (p + n)) - before)) > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, Condition(feature, at_least, cut), n)
    return best and (best[1], best[2])


def _pruned(left: DataFrame, conditions: list[Condition], bad: str, least_cover: int, least_precision: float) -> Rule | None:
    """The shortest best prefix of the conditions by (right - wrong) / covered on the held-back rows; None if too imprecise."""
    sums, inside = [], F.lit(True)
    for i, c in enumerate(conditions):
        inside = inside & c.column()
        for grows in (True, False):
            for side in (True, False):
                hit = inside & (F.col("grows") == F.lit(grows)) & (F.col(bad) == F.lit(side))
                sums.append(F.coalesce(F.sum(hit.cast("int")), F.lit(0)).alias(f"c{i}_{int(grows)}{int(side)}"))
    got, best = left.agg(*sums).first(), None
    for i in range(len(conditions)):
        grown, held = ((got[f"c{i}_{g}1"], got[f"c{i}_{g}0"]) for g in (1, 0))
        right, wrong = held if sum(held) else grown
        if grown[0] >= least_cover and (best is None or (right - wrong) / (right + wrong) > best[0]):
            best = ((right - wrong) / (right + wrong), Rule(tuple(conditions[: i + 1]), right / (right + wrong), sum(grown) + sum(held)))
    return best[1] if best and best[1].precision >= least_precision else None


def verdict(rules: Sequence[Rule]) -> Column:
    """Index of the first rule that fires, as one ordered conditional expression; null if none does."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        out = F.when(rules[i].column(), F.lit(i)).otherwise(out)
    return out


def learn(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality") -> list[Rule]:
    """Rules from statistics and labels (0 for bad) that meet by key; a key labelled twice is bad if either row says so.

    Null labels, null keys and labels without a row don't count.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.min(label) == 0).alias("__bad"))
    return learn_rules(stats.join(marks, key), FEATURES, "__bad", key)


def with_verdict(stats: DataFrame, rules: Sequence[Rule], *, least_words: int = 20, most_repeat_percent: int = 30) -> DataFrame:
    """Adds base_failed, rule (index of the first that fires), kept and reason."""
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeat_percent)
    names = F.array(*[F.lit(" and ".join(map(str, r.conditions))) for r in rules]) if rules else F.array().cast("array<string>")
    return (
        stats.withColumn("base_failed", failed)
        .withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
        .withColumn("reason", F.when(F.col("rule").isNotNull(), F.get(names, F.col("rule"))))
    )


def judge(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Statistics, base check, fired rule and verdict for each row of ``df``.

    With no usable labels only the base check speaks. Rows with equal keys are judged each by its own text; a null key
    never meets a label. Null and empty texts have no words and fail the base check. An empty table gives no rows; other
    columns are not read.
    """
    stats = staged(text_statistics(df, key=key, text=text), "statistics")
    return with_verdict(stats, learn(stats, labels, key=key, label=label))


def keep_good(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``df`` that :func:`judge` keeps, with all their columns; judged in place, so no row needs its key.

    Rows and statistics are written once and filtered on reading: a filter over the expressions themselves would be pushed
    below them and repeat them for each rule.
    """
    stats = staged(text_statistics(df, key=key, text=text, row=True), "statistics")
    rules = learn(stats.withColumn(key, F.col(key)[key]), labels, key=key, label=label)
    return with_verdict(stats, rules).where("kept").select(*[F.col(key)[c].alias(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule", "reason")
