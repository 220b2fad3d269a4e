"""Quality rules whose cutoffs are chosen under a bound on falsely rejected documents.

The measures of a text are built-in expressions over its whole text.  A rule rejects a document
when a measure exceeds a cutoff.  Whole vectors of cutoffs are tested per stratum, loose to strict
in an order fixed in advance: the exact binomial tail of the good labelled documents that a vector
loses, at the tolerated rate, must be below the allowed error divided by the number of strata.  The
sequence stops at its first failed test, so no further division by rules or cutoffs is needed.
With probability ``1 - ERROR`` no stratum then loses more than ``RATE`` of its good documents.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import SPACE, stored

#: Words of a window, and the base rules.
WINDOW, FEWEST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20
#: Tolerated share of good documents lost per stratum over all rules, and chance of exceeding it.
RATE, ERROR = 0.02, 0.05
#: Rules: measure per document and cutoffs tried, strictest first.
RULES = {
    "symbols": ("n_symbols / nullif(word_chars, 0)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.5)),
    "loud": ("n_loud / nullif(n_words, 0)", (0.2, 0.3, 0.5, 0.7, 0.9, 1.2)),
    "duplicate_lines": ("n_dup_lines / nullif(n_lines, 0)", (0.1, 0.15, 0.2, 0.3, 0.5, 0.7)),
    "repeated_words": ("n_repeat_words / nullif(n_words, 0)", (0.05, 0.08, 0.1, 0.12, 0.15, 0.18)),
}
#: Largest list of labelled ids that is broadcast to where the texts are read.
BROADCAST_ROWS = 1 << 19
_SUM_TERMS = 5000


def measures(docs: DataFrame, *keep: Column, text_col: str = "text") -> DataFrame:
    """``keep`` and the counts of every whole text; null text has no words.

    ``n_words, word_chars, n_symbols, n_loud, n_lines, n_dup_lines, n_repeat_words``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"))
    names = rows.columns[:-1]
    rows = rows.select(*names,
                       F.array_remove(F.split("_text", f"{SPACE}+"), "").alias("_words"),
                       F.filter(F.split("_text", "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]")).alias("_lines"),
                       (F.size(F.split("_text", r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
                       (F.size(F.split("_text", r"[!?]+")) - 1).cast("long").alias("n_loud"))
    rows = rows.select(*names, "n_symbols", "n_loud", F.size("_words").cast("long").alias("n_words"),
                       F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                       F.size("_lines").cast("long").alias("n_lines"),
                       (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                       F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"))
    done = [*names, "n_words", "word_chars", "n_symbols", "n_loud", "n_lines", "n_dup_lines"]
    at = [f"get(_codes, i + {k})" for k in range(WINDOW)]
    rows = rows.select(*done, F.expr(f"if(n_words < {WINDOW}, cast(array() as array<long>), transform("
                                     f"sequence(0, size(_codes) - {WINDOW}), i -> xxhash64({', '.join(at)})))").alias("_windows"))
    rows = rows.select(*done, F.expr("if(size(array_distinct(_windows)) < size(_windows), "
                                     "array_sort(transform(_windows, (x, i) -> struct(x, i))), null)").alias("_sorted"))
    equal = [f"coalesce(get(_sorted, k).x = get(_sorted, k {d}).x, false)" for d in ("- 1", "+ 1")]
    rows = rows.select(*done, F.expr(f"array_sort(transform(filter(sequence(0, size(_sorted) - 1), "
                                     f"k -> {' or '.join(equal)}), k -> get(_sorted, k).i))").alias("_at"))
    covered = (f"aggregate(_at, named_struct('n', 0L, 'last', -{WINDOW}), "
               f"(a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.last), 'last', p)).n")
    # the row number is never below 0: it only keeps a later filter on the result from being pushed down into
    # the steps above, where the array of one step would be built again for each element of the next
    return rows.select(*done, F.when(F.monotonically_increasing_id() >= 0, F.coalesce(F.expr(covered), F.lit(0)).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series, shifted by seven so that it is exact to about 1e-13 for x >= 1."""
    z = x + 7.0
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    shift = F.lit(0.0)
    for k in range(7):
        shift = shift + F.log(x + float(k))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: str, n: str, rate: str) -> Column:
    """P(X <= k) of n draws at ``rate``, for k below the mean; 1 from the mean on.

    Terms are summed from k downwards, where they shrink; what a very long sum leaves out is
    bounded by a geometric series and added, so the value is never too small.
    """
    kd, nd, q = F.col(k).cast("double"), F.col(n).cast("double"), F.col(rate)
    log_first = (_log_gamma(nd + 1.0) - _log_gamma(kd + 1.0) - _log_gamma(nd - kd + 1.0)
                 + kd * F.log(q) + (nd - kd) * F.log(1 - q))
    total = F.expr(f"""aggregate(if({k} > 0, sequence(0L, least({k}, {_SUM_TERMS}L) - 1), cast(array() as array<long>)),
        named_struct('s', 1D, 't', 1D),
        (a, j) -> named_struct('s', a.s + a.t * ({k} - j) * (1 - {rate}) / (({n} - {k} + j + 1) * {rate}),
                               't', a.t * ({k} - j) * (1 - {rate}) / (({n} - {k} + j + 1) * {rate})),
        a -> a.s + if({k} > {_SUM_TERMS}, a.t * ({k} / greatest({n} * {rate} - {k}, 1e-9)) / {rate}, 0D))""")
    return F.when(kd >= nd * q, 1.0).otherwise(F.least(F.lit(1.0), F.exp(log_first) * total))


def vectors(rules: dict = RULES) -> list[dict[str, float]]:
    """Cutoffs of all rules at once, loosest first; each step tightens one rule, in the order of ``rules``."""
    out = [{r: grid[-1] for r, (_, grid) in rules.items()}]
    for r, (_, grid) in rules.items():
        out += [{**out[-1], r: c} for c in reversed(grid[:-1])]
    return out


def vector_cutoffs(labelled: DataFrame, stratum: str, rules: dict = RULES, rate: float = RATE, error: float = ERROR) -> DataFrame:
    """``(stratum, rule, cutoff)`` from measured good documents: the last vector before the first failed test.

    A good document is lost by a vector if it passes the base rules and any rule of the vector
    rejects it.  The order is fixed, so each test has the whole error of its stratum.
    """
    steps = vectors(rules)
    lost = [reduce(lambda a, b: a | b, [F.coalesce(F.expr(e) > v[r], F.lit(False)) for r, (e, _) in rules.items()]) for v in steps]
    counts = labelled.groupBy(stratum).agg(F.count("*").alias("n"), *[
        F.count_if(~base_failed() & x).alias(f"k{i}") for i, x in enumerate(lost)])
    strata = counts.agg(F.count("*").alias("_strata"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"k{i}").alias("k")) for i in range(len(steps))]))
    tests = (counts.select(F.col(stratum), "n", each.alias("_t")).select(stratum, "n", "_t.*")
             .withColumn("_rate", F.lit(rate)).crossJoin(F.broadcast(strata)))
    passes = binomial_tail("k", "n", "_rate") <= F.lit(error) / F.col("_strata")
    first = tests.groupBy(stratum).agg(F.coalesce(F.min(F.when(~passes, F.col("step"))), F.lit(len(steps))).alias("_failed"))
    table = F.array(*[F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff")) for r, c in v.items()]) for v in steps])
    chosen = first.where("_failed > 0").select(stratum, F.explode(F.get(table, F.col("_failed") - 1)).alias("_c"))
    return chosen.select(stratum, "_c.*")


def judge(measured: DataFrame, chosen: DataFrame, stratum: str, rules: dict = RULES) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` (sorted names) and ``kept`` to measured documents."""
    wide = chosen.groupBy(F.col(stratum).alias("_of")).agg(*[
        F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in rules])
    rows = measured.join(wide, F.col(stratum).eqNullSafe(F.col("_of")), "left")
    failed = F.array_compact(F.array(*[F.when(F.expr(e) > F.col(f"_cut_{r}"), F.lit(r)) for r, (e, _) in sorted(rules.items())]))
    rows = rows.select(*measured.columns, base_failed().alias("base_failed"), failed.alias("failed_rules"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Measures and verdict of every document; ``labels`` has ``(doc_id, quality)``, 1 for good.

    Calibrated on all good labelled documents.  Empty and null texts fail the base rule, a null
    stratum is a stratum of its own, an empty label table leaves the base rules alone.
    """
    measured = stored(measures(docs, F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"),
                               text_col=text_col), "measures")
    good = labels.where("quality = 1").select(F.col(id_col).alias("doc_id")).distinct()
    chosen = vector_cutoffs(measured.join(good, "doc_id", "left_semi"), "stratum")
    return judge(measured, stored(chosen, "cutoffs"), "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected ones, all columns as they were.

    Only documents labelled good are measured for the cutoffs, then each row is judged where it is
    read: every other text is measured once.  A list of labels of more than ``BROADCAST_ROWS`` ids is not
    broadcast; then all documents are measured for the cutoffs too, so that only measures meet the
    labels and no text is shuffled at any size.  Rows that share an id are judged by their own texts.
    """
    stratum = F.col(stratum_col).cast("string").alias("stratum")
    good = labels.where("quality = 1").select(F.col(id_col).alias("doc_id")).distinct()
    good = stored(good, "good")
    if good.count() <= BROADCAST_ROWS:
        wanted = docs.join(F.broadcast(good.select(F.col("doc_id").alias("_good"))), F.col(id_col) == F.col("_good"), "left_semi")
        measured = measures(wanted, F.col(id_col).alias("doc_id"), stratum, text_col=text_col)
    else:
        every = stored(measures(docs, F.col(id_col).alias("doc_id"), stratum, text_col=text_col), "measures")
        measured = every.join(good, "doc_id", "left_semi")
    chosen = stored(vector_cutoffs(measured, "stratum"), "cutoffs")
    judged = judge(measures(docs, F.struct("*").alias("_row"), stratum, text_col=text_col), chosen, "stratum")
    return judged.where("kept").select("_row.*")
