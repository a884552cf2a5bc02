"""Quality rules as a short-circuit cascade.

Each rule rejects a document by a condition on its text.  ``fit_order`` measures on a sample what a rule costs and what share of
the documents it rejects that the rules before it leave, and puts the rules in order of rejection per cost; ``cascade`` evaluates them in that order and stops at
the first rejection.  The order changes the cost and the name of the rejecting rule, never the verdict.

Defined cases: null text is empty and has no words; a condition that is null rejects nothing; rules with equal merit keep
their listed order; an empty sample keeps the listed order; extra columns pass through, a clashing ``rejected_by`` is
replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, let, text_of, words_of
from tidewatch.session import materialize

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Rows of the sample on which cost and selectivity are measured: those whose hashed texts come first.
SAMPLE_ROWS = 1_000
#: A rule is evaluated until it has taken this long, or this often.
LEAST_SECONDS = 0.2
MOST_TURNS = 64


class Facts:
    """Counts of a text as expressions; those in ``known`` are taken from columns that are there already."""

    def __init__(self, text: Column, known: dict[str, Column] | None = None):
        self.text, self.known = text, known or {}

    def count(self, pattern: str) -> Column:
        return F.regexp_count(self.text, F.lit(pattern)).cast("bigint")

    @property
    def n_words(self) -> Column:
        return self.known.get("n_words", F.size(words_of(self.text)).cast("bigint"))

    @property
    def word_chars(self) -> Column:
        return self.known.get("word_chars", F.length(F.array_join(words_of(self.text), "")).cast("bigint"))

    @property
    def n_symbols(self) -> Column:
        return self.known.get("n_symbols", self.count(SYMBOLS))

    @property
    def lines(self) -> Column:
        """Lines that have a word."""
        return F.filter(F.split(self.text, "\n", -1), lambda line: F.regexp_like(line, F.lit(WORD)))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], Column]


def _repeats(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that stand in a window of ``width`` words found twice or more.

    Equal windows have equal hashes, so a text whose window hashes all differ has none; only the others compare the windows
    themselves.  Sorted (window, position) pairs put equal windows side by side.
    """
    def starts(n: Column) -> Column:
        return F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>"))

    def covered(positions: Column) -> Column:
        # Windows at p cover up to the next repeated window or width words.
        n = F.size(positions)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("bigint"),
                           lambda acc, i: acc + F.when(i == n, width).otherwise(F.least(F.lit(width), F.element_at(positions, i + 1) - F.element_at(positions, i))))

    def exact(w: Column) -> Column:
        pairs = F.sort_array(F.transform(starts(F.size(w)), lambda i: F.struct(F.slice(w, i, width).alias("window"), i.alias("at"))))

        def twice(p: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(p, i)["window"] == x["window"], F.lit(False))
            kept = F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return F.array_sort(F.transform(kept, lambda x: x["at"]))

        return let(let(pairs, twice), lambda at: F.when(F.size(at) > 0, covered(at)).otherwise(F.lit(0).cast("bigint")))

    def of(w: Column) -> Column:
        hashes = F.transform(starts(F.size(w)), lambda i: F.xxhash64(F.slice(w, i, width)))
        unique = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(unique, F.lit(0).cast("bigint")).otherwise(exact(w))

    return let(words, of)


def measures(text: Column) -> list[Column]:
    """The base measures of a text, all that come from its words in one go."""
    facts = Facts(text)
    counts = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    return [counts.alias("__w"), facts.n_symbols.alias("n_symbols"), let(facts.lines, _repeats).alias("n_dup_lines")]


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    w = docs.select(*kept, *measures(text_of(text)))
    w = w.select("*", *[F.col(f"__w.{c}").alias(c) for c in ("n_words", "word_chars", "n_repeat_words")]).drop("__w")
    return w.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _share(part: Column, whole: Column, most: float) -> Column:
    return part > F.lit(most) * whole


#: The rules of the verdict beside the base: text that is mostly markup, shouting, repeated lines or odd words.
RULES = (
    Rule("symbols", lambda f: _share(f.n_symbols, f.word_chars, 0.05)),
    Rule("shouting", lambda f: _share(f.count(r"\p{Lu}"), f.word_chars, 0.4)),
    Rule("exclamation", lambda f: _share(f.count("[!?]"), f.word_chars, 0.08)),
    Rule("same_lines", lambda f: let(f.lines, lambda x: _share(_repeats(x), F.size(x), 0.5))),
    Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 15 * f.n_words)),
    Rule("digits", lambda f: _share(f.count("[0-9]"), f.word_chars, 0.5)),
)


def fit_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS, least_seconds: float = LEAST_SECONDS) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds a row) in the order of the cascade, measured on a written sample of at most ``rows`` rows.

    A rule's cost is the time of evaluating it over and over within one task: the sample is repeated until the rule takes
    ``least_seconds`` longer than the same task without it, so that starting a job does not count.  The first rule is the one with the
    most rejection per cost; each next one is the best on the rows that the rules before it leave.
    """
    spark = docs.sparkSession
    hashed = docs.select(text_of(text).alias("__text")).withColumn("__h", F.xxhash64("__text"))
    sample = materialize(hashed.orderBy("__h").limit(rows).select("__text").coalesce(1), "rule-sample")
    n = sample.count()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    costs = {r.name: _seconds_a_row(spark, sample, r, n, least_seconds) for r in rules}
    # Which rules reject a row, as a set of bits: as many rows as there are sets.
    bits = [F.when(F.coalesce(r.rejects(Facts(F.col("__text"))), F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)]
    sets = {r["b"]: r["count"] for r in sample.select(sum(bits, F.lit(0)).alias("b")).groupBy("b").count().collect()}
    order, rest = [], list(enumerate(rules))
    while rest:
        left = sum(sets.values())
        hits = {k: sum(c for b, c in sets.items() if b >> k & 1) for k, _ in rest}
        k, rule = max(rest, key=lambda x: (hits[x[0]] / max(left, 1) / costs[x[1].name], -x[0]))
        order.append((rule, hits[k] / max(left, 1), costs[rule.name]))
        rest.remove((k, rule))
        sets = {b: c for b, c in sets.items() if not b >> k & 1}
    return order


def _seconds_a_row(spark, sample: DataFrame, rule: Rule, rows: int, least_seconds: float) -> float:
    """Time of one evaluation, by the difference of two tasks over the repeated sample, one of which evaluates the rule."""
    def timed(times: int, condition: Column) -> float:
        # The repetition number keeps the engine from evaluating an expression once for all repetitions.
        turns = sample.select("__text", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("__turn")).select(F.concat("__text", F.substring(F.col("__turn").cast("string"), 1, 0)).alias("__text"))
        began = time.perf_counter()
        turns.agg(F.count_if(condition)).collect()
        return time.perf_counter() - began

    wanted = F.coalesce(rule.rejects(Facts(F.col("__text"))), F.lit(False))
    times = 1
    while True:
        spent = timed(times, wanted) - timed(times, F.length("__text") < 0)
        if spent >= least_seconds or times >= MOST_TURNS:
            return max(spent, 1e-9) / (times * rows)
        times *= 4


def cascade(docs: DataFrame, order: list[Rule], text: str = "text", first: list[tuple[str, Column]] = (), known: tuple[str, ...] = ()) -> DataFrame:
    """All rows with ``rejected_by``: the first rule in ``order`` that rejects, else null.

    ``first`` holds (name, condition) pairs over columns already there; they cost nothing and come before any rule.  ``known`` names
    facts that are columns already, so that rules do not count them again.
    """
    facts = Facts(text_of(text), {c: F.col(c) for c in known})
    verdict = F.lit(None).cast("string")
    for r in reversed(order):
        verdict = F.when(r.rejects(facts), F.lit(r.name)).otherwise(verdict)
    for name, condition in reversed(list(first)):
        verdict = F.when(condition, F.lit(name)).otherwise(verdict)
    return docs.withColumn("rejected_by", verdict)
