"""Quality rules: a decision list learned by sequential covering. DataFrame operations only.

Each rule is a conjunction of thresholds on statistics of a text. A rule grows literal by literal
on two thirds of the labelled rows (by FOIL's information gain), is pruned from its end on the
other third (by (p - n) / (p + n)), and covers what it matches before the next one grows. The list
becomes one ordered CASE expression, which Spark compiles with the rest of the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm._common import SEPARATOR_CHARS, let, words

SYMBOLS = "#*$%&|<>"
#: Bound of the labelled sample that the list is learned from, in rows.
SAMPLE_ROWS = 6000
#: Thresholds tried for each feature: as many quantiles of the sample (a parameter of the search, which
#: drops no row). Rules and literals have no bound but the gain.
BINS = 24

FEATURES = {
    "words": "n_words",
    "word_len": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(n_chars, 1)",
    "digit_ratio": "n_digits / greatest(n_chars, 1)",
    "mark_ratio": "n_marks / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeat_words(ws: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the array ws.

    Windows are sorted by hash with their positions; equal neighbours are repeats, and the gaps of
    the sorted repeat positions give the covered words. n log n in the longest text.
    """
    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(at, k - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def repeated(s: Column) -> Column:
        same = lambda x, k, by: F.coalesce(F.get(s, k + by)["h"] == x["h"], F.lit(False))
        hit = F.filter(s, lambda x, k: same(x, k, -1) | same(x, k, 1))
        return let(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(F.size(w) >= 4, let(F.sort_array(rows), repeated)).otherwise(F.lit(0))

    return let(ws, windows).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the extra counts.

    The statistics are one projection per step, so that the arrays of words and lines are built
    once for each text. Null text counts as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.length(t)
    counts = docs.select(
        "*", t.alias("_t"), size.alias("n_chars_"), words(t).alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    return counts.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        _without(F.col("_t"), SEPARATOR_CHARS).cast("long").alias("word_chars"),
        (F.col("n_chars_") - _without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.col("n_chars_").cast("long").alias("s_chars"),
        (F.col("n_chars_") - _without(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
        (F.col("n_chars_") - _without(F.col("_t"), "0123456789")).cast("long").alias("n_digits"),
        (F.col("n_chars_") - _without(F.col("_t"), "!?")).cast("long").alias("n_marks"),
    )


def base_failed() -> Column:
    """The base rules on the statistics: fewer than 50 words, or repeats over half of the words."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    return [F.expr(x.replace("n_chars", "s_chars")).cast("double").alias(f"f_{k}") for k, x in FEATURES.items()]


@dataclass(frozen=True)
class Rule:
    """Rows where every (feature, sign, threshold) holds get the verdict; sign is '<=' or '>'."""

    literals: tuple[tuple[str, str, float], ...]
    verdict: bool

    def condition(self) -> Column:
        out = F.lit(True)
        for f, sign, x in self.literals:
            out = out & (F.col(f"f_{f}") <= x if sign == "<=" else F.col(f"f_{f}") > x)
        return out

    def text(self) -> str:
        return " AND ".join(f"{f} {s} {x:.6g}" for f, s, x in self.literals) + f" -> {'keep' if self.verdict else 'drop'}"


def _holds(row, literal) -> bool:
    k, sign, x = literal
    return row[k] <= x if sign == "<=" else row[k] > x


def learn(rows: list[tuple], names: list[str], bad: list[bool]) -> list[Rule]:
    """Rules for the rows marked bad, which are the smaller class; a row is a tuple of features.

    Of literals of equal gain the first by feature, threshold and sign is taken; of prefixes of
    equal worth the longest. Every third row left is kept from growing, for pruning.
    """
    if not rows:
        return []
    cuts = []
    for k in range(len(names)):
        v = sorted(r[k] for r in rows)
        distinct = sorted(set(v))
        at = {x: (x + y) / 2 for x, y in zip(distinct, distinct[1:], strict=False)}  # halfway to the next value
        cuts.append(sorted({at[x] for j in range(1, BINS) if (x := v[(j * len(v)) // BINS]) in at}))
    every = [(k, sign, x) for k in range(len(names)) for x in cuts[k] for sign in ("<=", ">")]
    left = list(range(len(rows)))
    prior = sum(bad) / max(1, len(bad))
    rules: list[Rule] = []
    while True:
        grow, prune = [i for i in left if i % 3], [i for i in left if i % 3 == 0]
        pos, neg = [i for i in grow if bad[i]], [i for i in grow if not bad[i]]
        if not pos:
            break
        rule: list = []
        while neg:
            base = math.log2(len(pos) / (len(pos) + len(neg)))
            best, gain = None, 1e-9
            for k, sign, x in every:
                p = sum(1 for i in pos if (rows[i][k] <= x) == (sign == "<="))
                if p < 3:
                    continue
                n = sum(1 for i in neg if (rows[i][k] <= x) == (sign == "<="))
                g = p * (math.log2(p / (p + n)) - base)
                if g > gain:
                    best, gain = (k, sign, x), g
            if best is None:
                break
            rule.append(best)
            pos, neg = [i for i in pos if _holds(rows[i], best)], [i for i in neg if _holds(rows[i], best)]

        def worth(literals, among):
            p = [i for i in among if all(_holds(rows[i], x) for x in literals)]
            b = sum(bad[i] for i in p)
            return ((2 * b - len(p)) / len(p) if p else -1.0), b, len(p)

        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda x: worth(x, prune)[0])
        w, b, n = worth(rule, left)
        # a list that would drop clean texts stops: what is left gets the default
        if b < 3 or b < max(0.8, prior) * n:
            break
        rules.append(Rule(tuple((names[k], s, float(x)) for k, s, x in rule), False))
        left = [i for i in left if not all(_holds(rows[i], x) for x in rule)]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The decision list from labels (doc_id, quality); at most sample_rows labelled rows are used.

    The sample is the labels of least hash, so a rerun takes the same. Its size is bounded by the
    parameter, hence it may be broadcast, and only its texts get statistics here. One row stands for
    each label, the one of least statistics, so repeated rows don't grow the sample. Texts that the
    base rules drop anyway teach nothing, nor do null ids and labels.
    """
    pick = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")
    each = statistics(texts).select("doc_id", "quality", F.struct(base_failed().alias("failed"), *features()).alias("f"))
    got = each.groupBy("doc_id", "quality").agg(F.min("f").alias("f")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").select("quality", "f.*").collect()
    got = [r for r in got if not r["failed"]]  # here: as a filter it would move below the join, to all texts
    names = list(FEATURES)
    return learn([tuple(r[f"f_{k}"] for k in names) for r in got], names, [r["quality"] == 0 for r in got])


def verdict(rules: list[Rule], default: bool = True) -> Column:
    """Ordered CASE: the first rule that holds decides."""
    out = None
    for r in rules:
        out = F.when(r.condition(), F.lit(r.verdict)) if out is None else out.when(r.condition(), F.lit(r.verdict))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def matched(rules: list[Rule]) -> Column:
    """Text of the rule that decided; null for the default."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.condition(), F.lit(r.text())).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs' statistics with base_failed, kept and the deciding rule.

    base_failed: fewer than 50 words, or repeats over half of the words. Null and empty texts have
    no words, so they fail; very long ones are judged whole. Null ids and repeated rows are judged as
    all others, of rules that hold the first decides, an empty table stays empty, and columns of docs
    other than doc_id and text are not read.
    """
    s = statistics(docs.select("doc_id", "text")).drop("text").select("*", *features())
    failed = base_failed()
    return s.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & verdict(rules)).alias("kept"), matched(rules).alias("rule"))
