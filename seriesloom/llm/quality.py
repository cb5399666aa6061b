"""Quality rules: an ordered decision list learned by sequential covering, applied as one conditional expression.

Everything over rows is DataFrame code. The driver sees only a histogram per step, with at most ``BINS`` entries for each
statistic, and picks from it the next threshold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns_of, free_names
from seriesloom.sources.artifacts import settle

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
MIN_WORDS = 50
REPEAT_PERCENT = 50
BINS = 64
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHAPES = ["word_length", "symbol_rate", "repeat_rate", "line_rate", "dup_line_rate", "upper_rate", "digit_rate", "shout_rate", "distinct_rate"]


def _left(text: Column, dropped: str) -> Column:
    """Code points left when all runs of a class are dropped."""
    return F.length(F.regexp_replace(text, dropped, "")).cast("bigint")


def text_statistics(text: Column, words: Column, lines: Column, repeats: Column) -> dict[str, Column]:
    n = F.size(words).cast("bigint")
    per_word = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    word_chars = F.length(text) - _left(text, f"{WORD}+")
    letters = lambda x: F.coalesce(F.try_divide(x, word_chars), F.lit(0.0))
    dup_lines = (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size(repeats)),
        F.lit(0).cast("bigint"),
        lambda seen, j: seen + F.least(F.lit(3), F.coalesce(F.get(repeats, j), F.lit(2**31 - 1)) - F.get(repeats, j - 1)),
    )
    repeat_words = F.when(F.size(repeats) > 0, covered).otherwise(F.lit(0)).cast("bigint")
    symbols = _left(text, "[^#*$%&|<>]+")
    return {
        "n_words": n,
        "word_chars": word_chars.cast("bigint"),
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "word_length": per_word(word_chars),
        "symbol_rate": per_word(symbols),
        "repeat_rate": per_word(repeat_words),
        "line_rate": per_word(F.size(lines)),
        "dup_line_rate": F.coalesce(F.try_divide(dup_lines, F.size(lines)), F.lit(0.0)),
        "upper_rate": letters(_left(text, r"[^\p{Lu}]+")),
        "digit_rate": letters(_left(text, "[^0-9]+")),
        "shout_rate": per_word(_left(text, "[^!?]+")),
        "distinct_rate": per_word(F.size(F.array_distinct(words))),
    }


def with_statistics(docs: DataFrame, text: str = "text", into: str = "_stats") -> DataFrame:
    """Add a struct of statistics per row, under a name that no column has. A null text counts as an empty one, whose statistics
    are all 0. Other columns pass as they are, whatever their names.

    The single-element explodes keep the optimiser from writing the split text into every lambda.
    """
    _body, _parts, _windows, _repeats = free_names(docs, "_body", "_parts", "_windows", "_repeats")
    one = lambda x: F.explode(F.array(x))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(F.col(_body), f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(F.col(_body), "\n"), lambda line: line.rlike(WORD))
    at = lambda i: F.get(F.col(f"{_parts}.words"), i)
    windows = F.when(
        F.size(f"{_parts}.words") >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(f"{_parts}.words") - 3),
                lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")),
            )
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    h = lambda j: F.get(F.col(_windows), j)["h"]
    repeated = F.sort_array(
        F.transform(F.filter(F.col(_windows), lambda w, j: (w["h"] == h(j - 1)) | (w["h"] == h(j + 1))), lambda w: w["i"])
    )
    kept = [F.col(f"`{c}`") for c in docs.columns]
    step = docs.select(*kept, body.alias(_body))
    step = step.select(*kept, _body, one(F.struct(words.alias("words"), lines.alias("lines"))).alias(_parts))
    step = step.select(*kept, _body, _parts, one(windows).alias(_windows))
    step = step.select(*kept, _body, _parts, one(repeated).alias(_repeats))
    made = text_statistics(F.col(_body), F.col(f"{_parts}.words"), F.col(f"{_parts}.lines"), F.col(_repeats))
    return step.select(*kept, F.struct(*[c.alias(k) for k, c in made.items()]).alias(into))


def base_failed(stats: str) -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > REPEAT_PERCENT * n)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self, stats: str) -> Column:
        value = F.col(f"{stats}.{self.statistic}")
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions hold."""

    conditions: tuple[Condition, ...]
    hits: int
    errors: int

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(stats)
        return out


@dataclass(frozen=True)
class CoveringSpec:
    statistics: tuple[str, ...] = tuple(SHAPES)
    bins: int = BINS
    max_rules: int = 12
    max_conditions: int = 4
    min_precision: float = 0.9
    """share of bad rows among those that a pruned rule covers on the rows held back for pruning"""
    min_support: int = 5
    max_rows: int = 1_000_000
    """bound on the labelled rows of the fit: a hash of the document id picks them where there are more"""


def _histogram(rows: DataFrame, names: Sequence[str]) -> dict[str, list[tuple[int, int, int]]]:
    """(bin, bad, good) for each statistic, summed before they are shuffled."""
    stacked = rows.select("bad", F.explode(F.array(*[F.struct(F.lit(n).alias("s"), F.col(f"b_{n}").alias("b")) for n in names])).alias("e"))
    counts = stacked.groupBy("e.s", "e.b").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    out: dict[str, list[tuple[int, int, int]]] = {n: [] for n in names}
    for r in counts:
        out[r["s"]].append((r["b"], r["bad"], r["n"] - r["bad"]))
    return {k: sorted(v) for k, v in out.items()}


def _best(histogram, edges, taken: set[tuple[str, bool]]) -> tuple[float, Condition, int, int] | None:
    """The threshold with the largest information gain on the bad rows."""
    best = None
    for name, bins in histogram.items():
        p0, n0 = sum(b[1] for b in bins), sum(b[2] for b in bins)
        if not p0:
            continue
        start = math.log2(p0 / (p0 + n0))
        p = n = 0
        for b, bad, good in bins[:-1]:
            p, n = p + bad, n + good
            for above, hit, miss in ((False, p, n), (True, p0 - p, n0 - n)):
                if hit and (name, above) not in taken and b < len(edges[name]):
                    gain = hit * (math.log2(hit / (hit + miss)) - start)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, Condition(name, above, edges[name][b]), hit, miss)
    return best


def _centred(rows: DataFrame, found: Condition, stats: str) -> Condition:
    """The threshold moved to the middle between the bad rows it covers and all rows it leaves, so that it keeps its distance."""
    value = F.col(f"{stats}.{found.statistic}")
    covered = F.when(found.column(stats) & (F.col("bad") == 1), value)
    left = F.when(~found.column(stats), value)
    near = (F.min(covered), F.max(left)) if found.above else (F.max(covered), F.min(left))
    a, b = rows.agg(near[0].alias("a"), near[1].alias("b")).first()
    return found if a is None or b is None else Condition(found.statistic, found.above, (a + b) / 2)


def learn_rules(labelled: DataFrame, spec: CoveringSpec = CoveringSpec(), stats: str = "_stats") -> list[Rule]:
    """Rules from rows ``doc_id, bad (0/1), _stats``.

    A rule grows on two thirds of the rows by the threshold with the best gain, is pruned from its end on the others, and takes
    the rows it covers away from the next. Learning stops at the first rule that is not precise enough. No labelled rows, or
    labels of one kind: no rules.
    """
    names = list(spec.statistics)
    counted = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    if not counted["bad"] or counted["bad"] == counted["n"]:
        return []
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    if counted["n"] > spec.max_rows:
        labelled = labelled.where(draw < int((1 << 30) * (spec.max_rows / counted["n"])))
    quantiles = [i / spec.bins for i in range(1, spec.bins)]
    found = labelled.agg(*[F.percentile_approx(f"{stats}.{n}", quantiles, 10_000).alias(n) for n in names]).first()
    edges = {n: sorted(set(found[n])) for n in names}

    def bin_of(name: str) -> Column:
        value = F.col(f"{stats}.{name}")
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[name]]), lambda e: e < value)).alias(f"b_{name}")

    bins = [bin_of(n) for n in names]
    rows, _ = settle(labelled.select("bad", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("held"), stats, *bins), "labelled")
    rules: list[Rule] = []
    while len(rules) < spec.max_rules:
        grow, prune = rows.where("not held"), rows.where("held")
        own: list[Condition] = []
        inside = grow
        while len(own) < spec.max_conditions:
            best = _best(_histogram(inside, names), edges, {(c.statistic, c.above) for c in own})
            if best is None or best[0] <= 0:
                break
            own.append(_centred(inside, best[1], stats))
            inside = inside.where(own[-1].column(stats))
            if not best[3]:
                break
        if not own:
            break
        heads, upto = [], F.lit(True)
        for k, c in enumerate(own):
            upto = upto & c.column(stats)
            heads += [F.sum(F.when(upto, F.col("bad")).otherwise(0)).alias(f"p{k}"), F.sum(F.when(upto, 1 - F.col("bad")).otherwise(0)).alias(f"n{k}")]
        seen = prune.agg(*heads).first()
        scored = [((seen[f"p{k}"] or 0), (seen[f"n{k}"] or 0), k) for k in range(len(own))]
        scored = [(p, n, k) for p, n, k in scored if p >= spec.min_support]
        if not scored:
            break
        p, n, k = max(scored, key=lambda x: ((x[0] - x[1]) / (x[0] + x[1]), x[0], -x[2]))
        if p < spec.min_precision * (p + n):
            break
        rules.append(Rule(tuple(own[: k + 1]), p, n))
        rows = rows.where(~rules[-1].column(stats))
    return rules


def verdict(rules: Sequence[Rule], stats: str = "_stats") -> Column:
    """The decision list as one ordered conditional expression: true keeps the row."""
    out = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(stats), F.lit(False))
    return out.otherwise(F.lit(True))


def labelled_statistics(scored: DataFrame, labels: DataFrame, stats: str = "_stats") -> DataFrame:
    """Rows that carry a label. Documents that fail the base rules teach nothing, they are gone anyway."""
    known = columns_of(labels, "doc_id", "quality").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    return (
        scored.where(~base_failed(stats)).select("doc_id", stats).join(known, "doc_id")
        .select("doc_id", (F.col("_quality") == 0).cast("int").alias("bad"), stats)
    )


def judge(docs: DataFrame, labels: DataFrame, spec: CoveringSpec = CoveringSpec()) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and ``kept`` for each row of ``docs``.

    Null or empty texts fail the base rules. Repeated rows are judged each by itself; other columns are ignored. Without
    usable labels the base rules alone decide. An empty table gives no rows. Of equally good thresholds the first statistic's
    lowest is taken.
    """
    scored, _ = settle(with_statistics(columns_of(docs, "doc_id", "text")).drop("text"), "statistics")
    rules = learn_rules(labelled_statistics(scored, labels), spec)
    return scored.select(
        "doc_id", *[f"_stats.{s}" for s in STATISTICS], base_failed("_stats").alias("base_failed"), verdict(rules).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, spec: CoveringSpec = CoveringSpec()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. The text is read and measured once."""
    (stats,) = free_names(docs, "_stats")
    scored, _ = settle(with_statistics(docs, into=stats), "statistics")
    rules = learn_rules(labelled_statistics(scored, labels, stats), spec, stats)
    return columns_of(scored.where(verdict(rules, stats)), *docs.columns)
