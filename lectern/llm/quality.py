"""Quality rules: a decision list learned from labelled statistics, applied as one conditional expression.

Statistics of a text are Spark expressions. Sequential covering learns rules that reject: each rule grows,
condition by condition, on two thirds of the labelled rows, is pruned on the rest, and is kept if it still
rejects hardly any good row there; the rows that it covers are then set aside. The ordered rules become
one ``CASE WHEN``, so that judging documents is a scan without shuffle and without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import pinned

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Labelled documents that rules are learned from, at most: those with the smallest hash of doc_id.
SAMPLE = 6000
#: Statistics that conditions may test: ratios and counts, alike for texts of any length.
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share", "line_words"]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and FEATURES.

    A null text counts as empty; every statistic of a text without words is 0. Existing columns of these
    names are replaced. Repeated five-word windows are found by sorting the windows' 64-bit hashes with
    their places, and only in texts where some hash is not unique.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = pinned(docs.drop(*own), __words=F.array_remove(F.split(text, SPACE), ""), __lines=lines)
    window = F.transform(F.sequence(F.lit(0), F.size("__words") - 5), lambda i: F.xxhash64(*(F.get(F.col("__words"), i + k) for k in range(5))))
    df = pinned(df, __hashes=F.when(F.size("__words") >= 5, window).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = pinned(df, __placed=F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), placed).otherwise(none))
    same = lambda x, i, k: F.coalesce(F.get(F.col("__placed"), i + k)["h"] == x["h"], F.lit(False))
    found = F.filter("__placed", lambda x, i: same(x, i, -1) | same(x, i, 1))
    df = pinned(df, __starts=F.sort_array(F.transform(found, lambda x: x["i"])))
    covers = F.transform("__starts", lambda x, i: F.coalesce(F.least(F.lit(5), F.get(F.col("__starts"), i + 1) - x), F.lit(5)))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    df = pinned(
        df,
        **{
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": left(SPACE).cast("bigint"),
            "n_symbols": (F.length(text) - left(SYMBOLS)).cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": F.aggregate(covers, F.lit(0).cast("bigint"), lambda a, x: a + x),
            "__upper": left(r"[^\p{Lu}]+"),
            "__marks": left(r"[^!?]+"),
            "__digits": left(r"[^0-9]+"),
            "__distinct": F.size(F.array_distinct("__words")),
            "__n_lines": F.size("__lines"),
        },
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "__n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("__upper", "word_chars"),
            "mark_share": share("__marks", "word_chars"),
            "digit_share": share("__digits", "word_chars"),
            "distinct_share": share("__distinct", "n_words"),
            "line_words": share("n_words", "__n_lines"),
        }
    ).drop("__words", "__lines", "__hashes", "__placed", "__starts", "__upper", "__marks", "__digits", "__distinct", "__n_lines")


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]
Labelled = list[tuple[dict[str, float], bool]]


def covers(rule: Rule, row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def _best(rows: Labelled) -> tuple[float, Condition | None]:
    """The condition with the largest FOIL gain on (statistics, is bad)."""
    bad = sum(b for _, b in rows)
    before = math.log2(bad / len(rows))
    best: tuple[float, Condition | None] = (0.0, None)
    for feature in FEATURES:
        line = sorted((row[feature], b) for row, b in rows)
        p = n = 0
        for (value, b), (after, _) in zip(line, line[1:], strict=False):
            p, n = p + b, n + (not b)
            if value == after:
                continue
            for above, x, y in ((False, p, n), (True, bad - p, len(rows) - bad - n)):
                if x and (gain := x * (math.log2(x / (x + y)) - before)) > best[0] + 1e-9:
                    best = gain, Condition(feature, above, (value + after) / 2)
    return best


def _worth(rule: Rule, rows: Labelled) -> tuple[float, int, int]:
    """(rejected bad less rejected good, over rejected; rejected bad; rejected good)."""
    p = sum(1 for row, b in rows if b and covers(rule, row))
    n = sum(1 for row, b in rows if not b and covers(rule, row))
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn(rows: Labelled, precision: float = 0.97, least: int = 3, most_conditions: int = 4) -> list[Rule]:
    """An ordered list of rules that reject, from (statistics, is bad) rows.

    A rule must reject ``least`` bad rows of those that pruning is done on, and be right for ``precision``
    of all that it rejects; else learning ends. Without bad or without good rows there are no rules.
    """
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while any(b for _, b in grow) and any(not b for _, b in grow):
        rule: Rule = ()
        left = grow
        while len(rule) < most_conditions and any(not b for _, b in left) and any(b for _, b in left):
            _, condition = _best(left)
            if condition is None:
                break
            rule = (*rule, condition)
            left = [r for r in left if condition.holds(r[0])]
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, prune)[0])
        _, p, n = _worth(rule, prune)
        _, q, m = _worth(rule, grow)
        if p < least or p < precision * (p + n) or q < precision * (q + m):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not covers(rule, r[0])] for part in (grow, prune))
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the labelled documents (quality 0: bad), ``sample`` at most.

    Labels without doc_id or quality are left out. Of several rows with one doc_id the one with the
    smallest statistics counts. Texts that fail the base rules are no examples: they're rejected anyway.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = with_statistics(texts).where(~base_failed()).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x"), F.min("quality").alias("quality"))
    found = [(row["x"].asDict(), row["quality"] == 0) for row in sorted(rows.collect(), key=lambda r: r["doc_id"])]
    return learn(found)


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does (the document is kept)."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column()
        out = F.when(test, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with statistics, base_failed, rule (string, null if none) and kept; other columns stay."""
    df = with_statistics(docs.drop("base_failed", "rule", "kept")).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
