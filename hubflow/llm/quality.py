"""Quality rules: a decision list learned from labelled documents.

Sequential covering: one rule at a time, a rule grows as a conjunction of
threshold conditions on text statistics (the condition with the largest
information gain on the growing rows is added), is pruned on rows held back
from growing, and the rows it covers are set aside before the next rule.
Thresholds come from the junk and the good rows apart, so that a rare kind of
junk has its own, and are renewed on the rows left after each rule. If a rule
fails on the held-back rows, the next best first condition is tried; the list
ends when none is left. The list is emitted as one ordered Spark conditional expression.

Everything is DataFrame expressions: the statistics are computed inside the
JVM without a shuffle, and each growing step is one aggregation whose result
(counts per statistic, bin and label) has a size fixed by the parameters.

Defined cases: null text counts as empty, its statistics are 0 and ratios of
nothing are 0. No labels, or labels of one kind only, give an empty list, which
keeps everything. A document labelled twice counts twice. Null ids are judged
but never matched with labels. Other columns are ignored or passed on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged, words

#: Statistics that a rule may test.
TESTED = ["n_words", "mean_word", "symbol_share", "repeat_share", "dup_line_share", "upper_share", "digit_share", "shout_share"]
#: Quantiles per statistic and label, conditions in a rule, rules in a list.
THRESHOLDS = 48
MAX_CONDITIONS = 3
MAX_RULES = 10
#: A rule must cover this many held-back rows at this precision to be kept.
MIN_COVER = 3
MIN_PRECISION = 0.9


def _repeat_words(w: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in ``w``."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def covered(s):  # s: hash and place of the windows, sorted
        same = F.filter(
            s,
            lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
        )
        starts = F.sort_array(F.transform(same, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(x, a["end"])).alias("n"), (x + 3).alias("end")),
            lambda a: a["n"],
        )

    def counted(h):  # most texts repeat no window: those need no sort
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, covered))

    return F.when(F.size(w) >= 3, let(hashes, counted)).otherwise(F.lit(0))


def _count_of(text: Column, others: str) -> Column:
    """Characters of ``text`` that the class ``others`` leaves: it matches the
    long stretches between them, which is far cheaper than a look at each."""
    return F.length(F.regexp_replace(text, f"{others}+", "")).cast("long")


def statistics(text: Column) -> Column:
    """A struct of the base statistics of a text (null: those of an empty one)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        ),
    )
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return let(
        F.struct(by_words.alias("w"), by_lines.alias("l")),
        lambda s: F.struct(
            s["w"]["n_words"].alias("n_words"),
            s["w"]["word_chars"].alias("word_chars"),
            _count_of(t, r"[^#*$%&|<>]").alias("n_symbols"),
            s["l"]["dup"].cast("long").alias("n_dup_lines"),
            s["w"]["n_repeat_words"].alias("n_repeat_words"),
            s["l"]["n"].cast("long").alias("n_lines"),
            _count_of(t, r"\P{Lu}").alias("n_upper"),
            _count_of(t, r"[^0-9]").alias("n_digits"),
            _count_of(t, r"[^!?]").alias("n_shout"),
        ),
    )


def base_failed(s: Column) -> Column:
    """Fewer than 50 words, or over half of the words inside repeats."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def tested(s: Column) -> dict[str, Column]:
    """The statistics that rules test, as doubles, from the base statistics."""

    def share(a, b):
        return F.when(s[b] > 0, s[a].cast("double") / s[b]).otherwise(F.lit(0.0))

    return {
        "n_words": s["n_words"].cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "shout_share": share("n_shout", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self, s: Column) -> Column:
        value = tested(s)[self.statistic]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects, and the default keeps."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self, s: Column) -> Column:
        out = None
        for rule in self.rules:
            holds = _all([c.column(s) for c in rule])
            out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "keep"


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Midpoints between neighbouring quantiles of each statistic, those of junk
    and of good rows with their extremes, and the limits of the good rows."""
    at = [(i + 0.5) / THRESHOLDS for i in range(THRESHOLDS)]
    by_label = {
        r["junk"]: r
        for r in rows.groupBy("junk")
        .agg(*[F.struct(F.percentile_approx(c, at, 2000).alias("q"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in TESTED])
        .collect()
    }
    out = {}
    for c in TESTED:
        values = sorted({v for r in by_label.values() for v in (*r[c]["q"], r[c]["low"], r[c]["high"])})
        cuts = {(a + b) / 2 for a, b in zip(values, values[1:])}
        if 0 in by_label and len(values) > 1:
            good = by_label[0][c]
            cuts |= {good["high"], math.nextafter(good["low"], -math.inf)}
        out[c] = sorted(cuts)
    return out


def _bin(c: Column, cuts: list[float]) -> Column:
    """How many of the cuts the statistic exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: c > t)) if cuts else F.lit(0)


def learn(labelled: DataFrame, seed: int = 11) -> DecisionList:
    """A decision list from ``labelled``: columns ``s`` (statistics), ``junk``
    (boolean) and ``key`` (decides which third of the rows is held back)."""
    rows = labelled.where("junk is not null").select(
        F.col("junk").cast("int").alias("junk"),
        (F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(3)) == 0).alias("held"),
        *[v.alias(k) for k, v in tested(F.col("s")).items()],
    )

    def holds(rule) -> Column:  # on bins: bin k holds the values above k of the cuts
        return _all([F.col(f"{c}_bin") > k if above else F.col(f"{c}_bin") <= k for c, above, k in rule])

    def histogram(df: DataFrame) -> dict:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{c}_bin").alias("k")) for c in TESTED])).alias("x")
        out: dict = {}
        for r in df.select("junk", cells).groupBy("x.c", "x.k", "junk").count().collect():
            out.setdefault(r["c"], {}).setdefault(r["k"], [0, 0])[r["junk"]] = r["count"]
        return out

    def grow(df: DataFrame, cuts: dict, of_all: dict, failed: set) -> list:
        """A rule that starts with none of the ``failed`` (statistic, side)."""
        rule: list = []
        while len(rule) < MAX_CONDITIONS:
            hist = histogram(df.where(holds(rule))) if rule else of_all
            if not hist:
                break
            good, bad = (sum(v[i] for v in hist[TESTED[0]].values()) for i in (0, 1))
            if not bad or not good:
                break
            best = (1e-9, None)
            for c in TESTED:
                low = [0, 0]
                for k in range(len(cuts[c])):
                    low = [low[i] + hist[c].get(k, [0, 0])[i] for i in (0, 1)]
                    for above, (n, p) in ((False, low), (True, [good - low[0], bad - low[1]])):
                        if p and n + p < good + bad and (rule or (c, above) not in failed):
                            gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                            if gain > best[0]:
                                best = (gain, (c, above, k))
            if best[1] is None:
                break
            rule.append(best[1])
        return rule

    def prune(df: DataFrame, rule: list) -> tuple[list, float, int]:
        sums = []
        for i in range(1, len(rule) + 1):
            hit = holds(rule[:i])
            sums += [F.sum(F.when(hit, F.col("junk"))).alias(f"p{i}"), F.count(F.when(hit, 1)).alias(f"a{i}")]
        got = df.agg(*sums).first()
        worth = [((2 * (got[f"p{i}"] or 0) - got[f"a{i}"]) / max(got[f"a{i}"], 1), -i) for i in range(1, len(rule) + 1)]
        keep = -max(worth)[1]
        covered = got[f"a{keep}"]
        return rule[:keep], (got[f"p{keep}"] or 0) / max(covered, 1), covered

    found: list = []
    left = staged(rows)
    while len(found) < MAX_RULES:
        cuts = _thresholds(left)
        binned = staged(left.select("junk", "held", *TESTED, *[_bin(F.col(c), cuts[c]).alias(f"{c}_bin") for c in TESTED]))
        growing, held = binned.where(~F.col("held")), binned.where("held")
        of_all, failed = histogram(growing), set()
        while rule := grow(growing, cuts, of_all, failed):
            kept, precision, cover = prune(held, rule)
            if precision >= MIN_PRECISION and cover >= MIN_COVER:
                break
            failed.add(rule[0][:2])
        if not rule:
            break
        found.append(tuple(Condition(c, above, cuts[c][k]) for c, above, k in kept))
        left = binned.where(~holds(kept))
    return DecisionList(tuple(found))


def learn_from(stats: DataFrame, labels: DataFrame, seed: int = 11) -> DecisionList:
    """``stats``: doc_id and ``s``; ``labels``: doc_id and quality (0: junk)."""
    y = labels.select(F.col("doc_id").alias("key"), (F.col("quality") == 0).alias("junk"))
    rest = stats.where(~base_failed(F.col("s")))  # the others are rejected whatever the rules say
    return learn(rest.select(F.col("doc_id").alias("key"), "s").join(y, "key"), seed)


def drop_rejected(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and those learned from
    ``labels`` (doc_id, quality). The statistics, which cost far more than a
    copy of the rows, are computed once and written beside them; no text is
    shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = staged(docs.select(row, F.col(key).alias("doc_id"), statistics(F.col(text)).alias("s")))
    rules = learn_from(rows.select("doc_id", "s"), labels, seed)
    return rows.where(~base_failed(F.col("s")) & rules.kept(F.col("s"))).select("row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; rules learned from ``labels``."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    stats = staged(docs.select("doc_id", statistics(F.col("text")).alias("s")))
    rules = learn_from(stats, table(spark, sf_dir, "labels"))
    s = F.col("s")
    failed = base_failed(s)
    return stats.select(
        "doc_id",
        *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & rules.kept(s)).alias("kept"),
    )
