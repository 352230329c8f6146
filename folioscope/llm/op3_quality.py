"""Quality rules as a short-circuit cascade, in Spark expressions only.

``measure`` counts what the rules look at. A ``Rule`` rejects a document when its condition is true. ``order_rules`` runs
every rule on a sample, takes the share it rejects and the time it needs, and sorts by rejection per cost. ``cascade``
puts the rules into one CASE in that order, so a rule is not computed for documents that an earlier one rejected. The
order decides only how much is computed and which rule is named first; the verdict doesn't depend on it.

Null and empty text: no words, so all counts are 0 and the base rule rejects it. Repeated rows: each gets its own result.
Empty table: no rows, rules stay in their given order. Other columns pass through ``judge`` unless they have the name of
one of its results; then the result replaces them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def _covered(found: Column) -> Column:
    """Words that lie in three-word windows starting at the given sorted places."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        found, start,
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).cast("long").alias("n"), x.alias("last")),
        lambda a: a["n"],
    )


def _repeated(windows: Column) -> Column:
    """Words in windows that occur twice or more; ``windows``: the hash of each three-word window, by place."""

    def by_neighbour(s):
        same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
        hit = F.transform(s, lambda x, j: F.when(F.coalesce(same(x, j), F.lit(False)), x["i"]).otherwise(F.lit(-1)))
        return _covered(F.sort_array(F.filter(hit, lambda i: i >= 0)))

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0).cast("long")).otherwise(let(placed, by_neighbour))


def measure(text: Column) -> Column:
    """struct n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long) of one text.

    Windows are compared by 64-bit hashes within a text.
    """
    text = F.coalesce(text, F.lit(""))

    def counts(w):
        n = F.size(w)
        windows = F.when(n >= 3, F.transform(
            F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        ).otherwise(F.array().cast("array<bigint>"))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(windows, _repeated).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(words_of(text), counts).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects``: columns of the measured document -> true when it is rejected (null counts as false)."""

    name: str
    rejects: object


def _share(part, whole, percent: int):
    return 100 * part > percent * whole


#: What must hold beyond the base rule. Words much shorter or longer than those of any language written with spaces,
#: symbols instead of prose, text in capitals, lines or marks that repeat, and words without letters.
RULES = [
    Rule("short_words", lambda c: 10 * c("word_chars") < 20 * c("n_words")),
    Rule("long_words", lambda c: c("word_chars") > 15 * c("n_words")),
    Rule("symbols", lambda c: _share(c("n_symbols"), c("n_words"), 20)),
    Rule("repeated_lines", lambda c: (c("n_lines") > 3) & _share(c("n_dup_lines"), c("n_lines"), 30)),
    Rule("capitals", lambda c: _share(F.regexp_count(c("text"), F.lit(r"\p{Lu}")), F.regexp_count(c("text"), F.lit(r"\p{L}")), 60)),
    Rule("marks", lambda c: _share(F.regexp_count(c("text"), F.lit(r"[!?]{2,}")), c("n_words"), 20)),
    Rule("few_letters", lambda c: _share(F.regexp_count(c("text"), F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")), c("n_words"), 40)),
]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    new = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept", "_m"]
    rows = docs.drop(*[c for c in new if c in docs.columns]).withColumn("text", F.col("text").cast("string"))
    m = F.col("_m")
    out = rows.withColumn("_m", measure(F.col("text"))).select(
        *rows.columns, m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["l"]["n"].alias("n_lines"), m["l"]["dup"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"))
    return out.withColumn("base_failed", base_failed())


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, rows: int = 500, times: int = 40) -> list[tuple[Rule, float, float]]:
    """[(rule, share rejected, seconds per document)] by rejection per second.

    Estimated on at most ``rows`` documents, the first by a hash of their text, so that every part of the table has its
    share. Each rule runs ``times`` times over them within one job, twice; of both times the lower one counts, less what the
    same job takes without a rule, so that the cost of a job doesn't hide the cost of a rule.
    """
    drawn = docs.select("text").orderBy(F.xxhash64(F.col("text").cast("string"))).limit(rows)
    sample = measured(drawn).filter(~F.col("base_failed")).cache()
    n = max(1, sample.count())
    again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def run(hit):
        began = time.perf_counter()
        got = again.agg(F.count(F.when(hit, 1))).first()[0]
        return time.perf_counter() - began, got

    run(F.lit(True))
    empty = min(run(F.col("_again") > 0)[0] for _ in range(2))
    found = []
    for rule in rules:
        (first, hit), (second, _) = run(rule.rejects(F.col)), run(rule.rejects(F.col))
        found.append((rule, hit / (n * times), max(min(first, second) - empty, 1e-3) / (n * times)))
    sample.unpersist()
    return sorted(found, key=lambda x: -x[1] / x[2])


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects; null: kept."""
    out = F
    for rule in rules:
        out = out.when(F.coalesce(rule.rejects(F.col), F.lit(False)), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = 500) -> DataFrame:
    """``docs`` with its counts, base_failed, failed_rule (base before all) and kept."""
    ordered = [r for r, _, _ in order_rules(docs, rules, sample_rows)]
    out = measured(docs).withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered)))
    return out.withColumn("kept", F.col("failed_rule").isNull())
