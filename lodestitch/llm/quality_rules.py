"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Each text is reduced, in one pass and within its own row, to a few counts. From these come
rules of the form "reject when the metric exceeds a cutoff". A labelled holdout picks the
cutoffs: for every stratum and rule, cutoffs are tried from the loosest to the strictest, and
one qualifies while the exact binomial test rejects "more than ``alpha / rules`` of the good
documents would be lost" at level ``delta / (strata * rules)`` (fixed-sequence testing along the
cutoffs, Bonferroni over strata and rules). That is the same as an exact (Clopper-Pearson)
upper bound of the false-rejection rate lying below ``alpha / rules``. So with probability
``1 - delta`` no stratum loses more than ``alpha`` of its good documents to the rules. A stratum
with too few labels gets no cutoff and keeps everything that passes the base rules. With ``joint``
all rules tighten together along one sequence, tested against the whole ``alpha`` at level
``delta / strata``: with four strata and no false rejection 217 good labels do, not 1,151.

Scale: each text is counted once, and the texts never shuffle. Only the counts (one small row a
document) are joined with the labels; ``quality_rules`` keeps them in the shared checkpoint
folder, ``keep_good_documents`` writes them there beside the rows and reads both again. The
cutoff table has one row per stratum and rule and its size is bounded by the number of strata,
which is checked before broadcasting.

Defined results: a null or empty text has no words, all counts 0, and fails the base rules; a
null stratum is the stratum ``""``; null labels are ignored; a document with several labels
counts once, and as good only if all of them say so; documents with equal ids are separate rows
(each is joined with the label of that id); an empty table gives an empty result; columns other
than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.plans.materialize import materialize, stored

SPACE = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Cutoffs tried per rule, loosest first (fixed values). The strictest are those of published heuristics
#: for web text; the test decides how far towards them each stratum may go.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3),
    "repeat_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "mean_word_chars": (60.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 10.0),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(starts: Column) -> Column:
    """Words covered by windows at the sorted ``starts``."""
    last = F.size(starts) - 1
    spans = F.transform(
        starts,
        lambda at, j: F.when(j == last, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(starts, j + 1) - at)),
    )
    return F.aggregate(spans, F.lit(0), lambda a, b: a + b)


def _repeated_starts(hashes: Column) -> Column:
    """Sorted positions of the windows whose hash occurs twice or more."""

    def repeated(ordered: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(ordered, j)["h"] == e["h"], F.lit(False))
        twice = F.filter(ordered, lambda e, j: ((j > 0) & same(e, j - 1)) | same(e, j + 1))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)


def _repeat_words(words: Column) -> Column:
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))
    )
    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        _let(_repeated_starts(h), _covered)
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(hashes, some))


def measure(docs: DataFrame, *, id_col: str, text_col: str, stratum_col: str, whole_rows: bool = False) -> DataFrame:
    """doc_id, stratum and the counts of every whole text; with ``whole_rows`` also the input row."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    counted = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("x"),
        *row,
    )
    out = counted.select(
        "doc_id",
        "stratum",
        F.col("w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("x.n").cast("long").alias("n_lines"),
        (F.col("x.n") - F.col("x.d")).cast("long").alias("n_dup_lines"),
        F.col("w.r").cast("long").alias("n_repeat_words"),
        *["row"][: len(row)],
    )
    return out


def base_failed() -> Column:
    """Too short, or too much of it repeated."""
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _metrics() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "repeat_ratio": F.col("n_repeat_words") / words,
        "mean_word_chars": F.col("word_chars") / words,
    }


def _binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logs; 1 beyond the mean, where the test cannot pass anyway."""
    import math

    odds, first = math.log(p) - math.log1p(-p), n * math.log1p(-p)

    def more(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + F.lit(odds)
        high, low = F.greatest(acc["s"], term), F.least(acc["s"], term)
        return F.struct(term.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    total = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("t"), first.alias("s")),
        more,
        lambda acc: F.exp(acc["s"]),
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def risk_controlled_cutoffs(holdout: DataFrame, *, alpha: float, delta: float) -> DataFrame:
    """stratum, rule, cutoff, false_rejections, n_good: the strictest cutoff that qualifies.

    ``holdout``: the counts of good labelled documents that pass the base rules.
    """
    metrics = _metrics()
    counts = [
        F.count_if(metrics[rule] > c).alias(f"{rule}_{j}") for rule, cuts in CUTOFFS.items() for j, c in enumerate(cuts)
    ]
    per_stratum = holdout.groupBy("stratum").agg(F.count("*").alias("n_good"), *counts)
    tried = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{j}").alias("false_rejections"))
            for rule, cuts in CUTOFFS.items()
            for j, c in enumerate(cuts)
        ]
    )
    strata = per_stratum.agg(F.count("*").alias("s")).scalar()
    level = F.lit(delta) / (strata * len(CUTOFFS))
    tests = per_stratum.select("stratum", "n_good", F.inline(tried))
    p_value = _binomial_cdf(F.col("false_rejections"), F.col("n_good"), alpha / len(CUTOFFS))
    return (
        tests.where(p_value <= level)
        .groupBy("stratum", "rule")
        .agg(
            F.min("cutoff").alias("cutoff"),
            F.max("false_rejections").alias("false_rejections"),
            F.first("n_good").alias("n_good"),
        )
    )


def joint_cutoffs(holdout: DataFrame, *, alpha: float, delta: float) -> DataFrame:
    """stratum and one column of cutoffs per rule: the strictest joint vector that qualifies.

    All rules tighten together along one fixed sequence of vectors, so each is tested against the
    whole ``alpha`` at level ``delta / strata``: the union of the rules is what is counted.
    """
    metrics, steps = _metrics(), max(map(len, CUTOFFS.values()))
    vectors = [{r: cuts[j * (len(cuts) - 1) // (steps - 1)] for r, cuts in CUTOFFS.items()} for j in range(steps)]
    rejected = [reduce(or_, (metrics[r] > c for r, c in v.items())) for v in vectors]
    per_stratum = holdout.groupBy("stratum").agg(
        F.count("*").alias("n_good"), *[F.count_if(x).alias(f"k_{j}") for j, x in enumerate(rejected)]
    )
    strata = per_stratum.agg(F.count("*").alias("s")).scalar()
    tried = F.array(
        *[F.struct(F.lit(j).alias("step"), F.col(f"k_{j}").alias("k"), *[F.lit(c).alias(r) for r, c in v.items()]) for j, v in enumerate(vectors)]
    )
    tests = per_stratum.select("stratum", "n_good", F.inline(tried))
    # A later vector rejects all that an earlier one does, so no failed test lies before one that passes.
    passed = tests.where(_binomial_cdf(F.col("k"), F.col("n_good"), alpha) <= F.lit(delta) / strata)
    return passed.groupBy("stratum").agg(*[F.max_by(r, "step").alias(r) for r in CUTOFFS])


def _cutoff_table(
    measured: DataFrame, labels: DataFrame, label_id: str, good_col: str, alpha: float, delta: float, joint: bool
) -> DataFrame:
    """stratum and one column of cutoffs per rule."""
    # The exact bound needs independent documents: one label each.
    good = (
        labels.where(F.col(good_col).isNotNull() & F.col(label_id).isNotNull())
        .groupBy(F.col(label_id).alias("doc_id"))
        .agg(F.min(good_col).alias("least"), F.max(good_col).alias("most"))
        .where("least = 1 and most = 1")
        .select("doc_id")
    )
    holdout = measured.where(~base_failed()).join(good, "doc_id")
    if joint:
        return materialize(joint_cutoffs(holdout, alpha=alpha, delta=delta))
    cutoffs = risk_controlled_cutoffs(holdout, alpha=alpha, delta=delta)
    return materialize(cutoffs.groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.first("cutoff")))


def _judged(measured: DataFrame, cutoffs: DataFrame, most_strata: int) -> DataFrame:
    """``measured`` with failed (the rules that reject a row) and kept."""
    few = cutoffs.count() <= most_strata
    metrics = _metrics()
    failed = F.array_compact(F.array(*[F.when(metrics[r] > F.col(r), F.lit(r)) for r in CUTOFFS]))
    joined = measured.join(F.broadcast(cutoffs) if few else cutoffs, "stratum", "left")
    return joined.withColumn("failed", failed).withColumn("kept", ~base_failed() & (F.size("failed") == 0))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_id: str = "doc_id",
    good_col: str = "quality",
    alpha: float = 0.02,
    delta: float = 0.05,
    most_strata: int = 10_000,
    joint: bool = False,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules.

    ``alpha``: share of a stratum's good documents that the rules may reject at most; ``delta``:
    probability that this fails in any stratum. The cutoff table is broadcast only while the
    number of strata is at most ``most_strata``; beyond, it is joined by its key. ``joint``: one
    sequence of cutoffs of all rules together, which needs far fewer labels a stratum.
    """
    measured = materialize(measure(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col))
    cutoffs = _cutoff_table(measured, labels, label_id, good_col, alpha, delta, joint)
    return _judged(measured, cutoffs, most_strata).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        "kept",
        F.concat_ws(",", "failed").alias("failed_rules"),
    )


def keep_good_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_id: str = "doc_id",
    good_col: str = "quality",
    alpha: float = 0.02,
    delta: float = 0.05,
    most_strata: int = 10_000,
    joint: bool = False,
) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep.

    Every row is counted once and kept with its counts, as Parquet in the shared folder; the
    cutoffs read the counts from there, and then the rules read the rows.
    """
    at = {"id_col": id_col, "text_col": text_col, "stratum_col": stratum_col}
    measured = stored(measure(docs, **at, whole_rows=True))
    cutoffs = _cutoff_table(measured.drop("row"), labels, label_id, good_col, alpha, delta, joint)
    return _judged(measured, cutoffs, most_strata).where("kept").select("row.*")
