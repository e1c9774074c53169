"""Quality rules with risk-controlled cutoffs.

Each rule compares one measure of a text with a cutoff; a text that breaks any
rule is rejected. All cutoffs together move along one path, fixed before any label
is seen: step i takes the i-th mildest cutoff of every rule's grid (its strictest
one when the grid has no more), so each step rejects all that the step before it
does. A step may be used in a stratum (a language) only if labelled documents
show, by an exact binomial test of the joint verdict, that it rejects at most
``RISK`` of the stratum's good documents: with k of n good documents rejected,
the chance of k or fewer under that rate must not exceed ``ERROR`` / number of
strata (Bonferroni). The steps are tested in order and the first failure ends the
path (fixed-sequence testing, which needs no further correction), so with
probability 1 - ``ERROR`` no stratum loses more than ``RISK`` of its good
documents to the rules. Of the steps that hold, the last counts. Nothing is
fitted before the tests, so every labelled document serves as holdout.

Only DataFrame functions: counting words, lines and repeated word windows is
done on arrays inside each row, without a shuffle; labels meet narrow rows only.

Defined results: null and empty texts have no words and fail the base rule; a
null language is a stratum of its own; strata without enough labels get no
cutoff, so only the base rule applies there (:func:`tests` says how many labels
the first step lacks); a document labelled more than once
counts as good only if every label says so; null labels and labels of unknown
documents are ignored; repeated rows are judged one by one; other columns pass.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecraft.llm.common import words, written

#: Largest share of a stratum's good documents that the rules may reject.
RISK = 0.01
#: Chance that any of these guarantees fails.
ERROR = 0.05
#: rule -> (numerator, denominator, +1: high is bad, -1: low is bad, cutoffs
#: from the strictest to the mildest)
RULES = {
    "symbols": ("n_symbols", "word_chars", 1, (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2)),
    "dup_lines": ("n_dup_lines", "n_lines", 1, (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)),
    "repeats": ("n_repeat_words", "n_words", 1, (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)),
    "long_words": ("word_chars", "n_words", 1, (5.5, 6.0, 6.5, 7.0, 8.0, 9.0, 10.0, 12.0)),
    "short_words": ("word_chars", "n_words", -1, (4.5, 4.25, 4.0, 3.5, 3.0, 2.5, 2.0)),
}
#: Steps of the path.
STEPS = max(len(spec[3]) for spec in RULES.values())
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Terms of the binomial sum that are added one by one; a geometric series
#: bounds the rest from above.
TERMS = 2000
#: Repeated windows of a text that are looked up one by one.
FEW = 16


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``MEASURES`` (long); existing columns of these
    names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumns({
        "_words": words(F.col("text")),
        "_lines": lines,
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
    })
    d = d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.expr(
            "CASE WHEN size(_words) >= 3 THEN transform(sequence(0, size(_words) - 3),"
            " i -> xxhash64(_words[i], _words[i + 1], _words[i + 2]))"
            " ELSE cast(array() AS array<bigint>) END"),
    }).drop("_words", "_lines")
    # Only texts with a repeated window go on: which hashes come twice, then
    # where they are. Few such hashes are looked up one by one; for many, the
    # windows are sorted with their places.
    d = d.withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(_windows) END"))
    d = d.withColumn("_twice", F.expr(
        "array_distinct(filter(_sorted, (x, j) -> j > 0 AND _sorted[greatest(j - 1, 0)] = x))")).drop("_sorted")
    d = d.withColumn("_placed", F.expr(
        f"CASE WHEN size(_twice) > {FEW} THEN"
        " sort_array(transform(_windows, (x, i) -> struct(x AS h, i AS i))) END"))
    d = d.withColumn("_at", F.expr(
        f"CASE WHEN size(_twice) <= {FEW} THEN"
        " filter(sequence(0, size(_windows) - 1), i -> array_contains(_twice, _windows[i]))"
        " WHEN _placed IS NOT NULL THEN"
        " sort_array(transform(filter(_placed, (x, j) ->"
        " (j > 0 AND _placed[greatest(j - 1, 0)].h = x.h) OR (j < size(_placed) - 1 AND"
        " _placed[least(j + 1, size(_placed) - 1)].h = x.h)), x -> x.i)) END")) \
        .drop("_windows", "_twice", "_placed")
    d = d.withColumn("n_repeat_words", F.expr(
        "coalesce(aggregate(_at, struct(0L AS n, -3 AS last),"
        " (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n), 0L)")).drop("_at")
    # A one-row generator: a later filter on a measure stays above it. Otherwise
    # it would be rewritten into nested copies of all of the above.
    own = [F.col(f"`{c}`") for c in d.columns if c not in MEASURES]
    return d.select(*own, F.inline(F.array(F.struct(*MEASURES))))


def base_failed():
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def _ratio(rule):
    top, bottom, _, _ = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))


def _breaks(rule, cutoff):
    high = RULES[rule][2] > 0
    return F.coalesce(_ratio(rule) > cutoff if high else _ratio(rule) < cutoff, F.lit(False))


def _log_factorial(x: str) -> str:
    return (f"CASE WHEN {x} <= 20 THEN ln(factorial(cast(least({x}, 20) AS int))) ELSE {x} * ln({x}) - {x}"
            f" + 0.5 * ln({2 * math.pi!r} * {x}) + 1 / (12D * {x}) - 1 / (360D * pow({x}, 3))"
            f" + 1 / (1260D * pow({x}, 5)) END")


def binomial_tail(k: str, n: str, rate: float) -> str:
    """SQL for P(Binomial(n, rate) <= k), never below the true value; 1 where
    k is not below the mean, which no test passes."""
    a = repr(rate)
    log_top = (f"({_log_factorial(n)}) - ({_log_factorial(k)}) - ({_log_factorial(f'({n} - {k})')})"
               f" + {k} * ln({a}D) + ({n} - {k}) * ln(1 - {a}D)")
    ratio = f"({k} - i + 1) * (1 - {a}D) / (({n} - {k} + i) * {a}D)"
    tail = (f"aggregate(sequence(0, cast(least({k}, {TERMS}) AS int)), struct(1D AS s, 1D AS t),"
            f" (x, i) -> CASE WHEN i = 0 THEN x ELSE struct(x.s + x.t * {ratio} AS s, x.t * {ratio} AS t) END,"
            f" x -> x.s + CASE WHEN {k} > {TERMS} THEN x.t * {k} * (1 - {a}D) / ({n} * {a}D - {k} * {a}D"
            f" - {k} * (1 - {a}D)) ELSE 0D END)")
    return f"CASE WHEN {k} >= {n} * {a}D THEN 1D ELSE least(1D, exp({log_top}) * {tail}) END"


def path(rule: str) -> list[float]:
    """The rule's cutoff at each step, mildest first."""
    grid = RULES[rule][3]
    return [float(grid[max(0, len(grid) - 1 - i)]) for i in range(STEPS)]


def _rejected(cut) -> Column:
    """Whether any rule is broken, for the cutoffs ``cut(rule)``."""
    return reduce(lambda a, b: a | b, [_breaks(r, cut(r)) for r in RULES])


def tests(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, step, n, k, p, most_p, missing): the test of every step's joint
    verdict on the labelled good documents that pass the base rule; it holds if
    ``p <= most_p``. ``missing``: good labels without which no step can hold."""
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id") \
        .agg(F.min("quality").alias("_good")).where("_good = 1").select("doc_id")
    held = rows.where(~base_failed()).join(good, "doc_id", "left_semi")
    paths = {r: path(r) for r in RULES}
    counts = written(held.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[F.count_if(_rejected(lambda r, i=i: paths[r][i])).alias(f"k{i}") for i in range(STEPS)]), "counts")
    most = error / max(1, counts.count())
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"k{i}").alias("k")) for i in range(STEPS)]))
    least = math.ceil(math.log(most) / math.log1p(-risk)) if 0 < risk < 1 else 1
    return counts.select("stratum", "n", each.alias("t")).select("stratum", "t.step", "n", "t.k") \
        .withColumn("p", F.expr(binomial_tail("k", "n", risk))).withColumn("most_p", F.lit(most)) \
        .withColumn("missing", F.greatest(F.lit(0).cast("long"), F.lit(least).cast("long") - F.col("n")))


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row a stratum that certifies a step, with a column ``cut_<rule>`` each."""
    failed = F.min(F.when(F.col("p") > F.col("most_p"), F.col("step")))
    last = tests(rows, labels, risk, error).groupBy("stratum").agg(
        (F.coalesce(failed, F.lit(STEPS)) - 1).alias("step")).where("step >= 0")
    return last.select("stratum", *[F.get(F.array(*[F.lit(c) for c in path(r)]), F.col("step")).alias(f"cut_{r}")
                                    for r in RULES])


#: Strata whose cutoffs may be sent to every executor.
MOST_STRATA = 10_000


def verdicts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to measured rows with a ``stratum``."""
    cuts = written(cuts, "cutoffs")
    if cuts.count() <= MOST_STRATA:
        cuts = F.broadcast(cuts)
    judged = rows.join(cuts.withColumnRenamed("stratum", "_stratum"), F.col("stratum") == F.col("_stratum"), "left")
    rejected = _rejected(lambda r: F.col(f"cut_{r}"))
    return judged.withColumn("base_failed", base_failed()) \
        .withColumn("kept", ~F.col("base_failed") & ~rejected) \
        .drop("_stratum", *[f"cut_{r}" for r in RULES])


def _stratum():
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("stratum")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row's measures, ``base_failed`` and ``kept``. The measures are
    written once (some 60 bytes a document); labels are joined to that table."""
    narrow = written(measured(docs.select("doc_id", "text", "lang")).select("doc_id", _stratum(), *MEASURES),
                     "measures")
    return verdicts(narrow, cutoffs(narrow, labels)).select("doc_id", *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns unchanged.

    Texts are measured twice, once narrow for the cutoffs and once in place,
    so that they are neither shuffled nor written.
    """
    names = docs.columns
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"))
    work = work.select("row_", F.col("row_.doc_id").alias("doc_id"), F.col("row_.text").alias("text"),
                       F.col("row_.lang").alias("lang"))
    narrow = written(measured(work.drop("row_")).select("doc_id", _stratum(), *MEASURES), "measures")
    cuts = cutoffs(narrow, labels)
    rows = measured(work).select("row_", _stratum(), *MEASURES)
    return verdicts(rows, cuts).where("kept").select("row_.*")
