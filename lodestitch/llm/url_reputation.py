"""Empirical-Bayes host reputation.

Labelled page outcomes are shrunk through three beta-binomial levels: the corpus rate is the
prior of each public suffix, the suffix posterior mean is the prior of each registered domain,
and the domain posterior mean is the prior of each host. The strength of each level's prior is
fitted by moments (the within-group correlation of a beta-binomial). A page is allowed when the
lower bound of its host's posterior reaches ``min_lower``: when the posterior beta distribution
has no more than ``1 - level`` of its mass below it. That mass is the regularised incomplete
beta function, summed as a series of positive terms; nothing is approximated by a normal. A
list of explicit rules overrides the reputation; the longest rule that fits a url wins.

Everything is keyed aggregation and equi-joins: pages are reduced to one row per host, kept in
the shared folder, before any level is computed, so a host with a third of all pages costs a
partial aggregate, and the join back splits a hot host under adaptive execution.

Defined results: a null url, or one without ``://``, has an empty host and an empty path and is
judged as that (empty) host; a page without labels is judged by its host, domain or suffix;
labels that are null, or of unknown pages, are ignored; repeated pages are repeated in the
result and a repeated label counts each time (each is one outcome); an empty table gives an empty result; columns
other than the named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.plans.materialize import materialize

#: Two-part public suffixes under which names are registered: the default of a parameter. A public suffix list
#: is data that changes; production reads one and passes it.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule; both null without one."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(action)
    return rule, action


def _registered(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """(domain, suffix) of a host; a bare name or an address is its own domain and suffix."""
    name = F.regexp_replace(host, r":\d*$", "")
    parts = F.split(name, r"\.")
    n = F.size(parts)
    two = F.concat_ws(".", F.slice(parts, F.greatest(n - 1, F.lit(1)), 2))
    long_suffix = two.isin(*suffixes)
    whole = name.rlike(r"^[\d.]+$") | (n < 2)
    suffix = F.when(whole, name).when(long_suffix, two).otherwise(F.element_at(parts, -1))
    take = F.when(long_suffix, F.lit(3)).otherwise(F.lit(2))
    start = F.greatest(n - take + 1, F.lit(1))
    domain = F.when(whole, name).otherwise(F.concat_ws(".", F.slice(parts, start, take)))
    return domain, suffix


def _strength(level: DataFrame, least: float, most: float) -> Column:
    """Moment estimate of the prior strength of a level with columns n, y and prior."""
    spread = F.col("prior") * (1 - F.col("prior"))
    labelled = level.where("n > 0")
    ratio = labelled.agg(
        F.sum(F.col("n") * F.pow(F.col("y") / F.col("n") - F.col("prior"), F.lit(2.0)) - spread).alias("over"),
        F.sum((F.col("n") - 1) * spread).alias("scale"),
    ).select(F.when(F.col("scale") > 0, F.col("over") / F.col("scale")).otherwise(F.lit(0.0)).alias("rho"))
    rho = F.coalesce(F.greatest(F.least(F.col("rho"), F.lit(0.5)), F.lit(1e-4)), F.lit(1e-4))
    return F.greatest(F.least(ratio.select((1 / rho - 1).alias("m")).scalar(), F.lit(most)), F.lit(least))


def _mean(level: DataFrame, least: float, most: float) -> DataFrame:
    m = _strength(level, least, most)
    return level.withColumn("strength", m).withColumn(
        "mean", (F.col("strength") * F.col("prior") + F.col("y")) / (F.col("strength") + F.col("n"))
    )


def beta_mass_below(x: float, a: float, b: float) -> float:
    """P(X <= x) of a beta distribution, 0 < x < 1.

    The continued fraction of the incomplete beta function, from its top down, on the side of the mean where it
    converges fast: constant memory, and about as many steps as the square root of the labels.
    """
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_mass_below(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b))
    tiny = 1e-300
    # The fraction's convergents, by the ratios of their numerators (c) and denominators (1 / d) to the ones before.
    value, c, d, step = 1.0, 1 / tiny, 1.0, 0
    while True:
        step += 1
        m = step // 2
        top = -(a + m) * (a + b + m) if step % 2 else m * (b - m)
        term = top * x / ((a + step - 1) * (a + step))
        d, c = 1.0 / ((1.0 + term * d) or tiny), (1.0 + term / c) or tiny
        value, before = value * c * d, value
        if step > 2 and abs(value - before) <= 1e-14 * abs(value):
            return min(1.0, max(0.0, front * value))


def _mass_below(x: float, a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def mass(alpha: pd.Series, beta: pd.Series) -> pd.Series:
        return pd.Series([beta_mass_below(x, p, q) for p, q in zip(alpha, beta, strict=True)], dtype=float)

    return mass(a, b)


def host_reputation(
    hosts: DataFrame,
    *,
    min_lower: float = 0.5,
    suffixes: Sequence[str] = TWO_PART_SUFFIXES,
    least_strength: float = 1.0,
    most_strength: float = 1000.0,
) -> DataFrame:
    """host, n, y -> host, domain, n, posterior mean, and the posterior's mass below ``min_lower``.

    ``hosts`` has one row per host with its labelled pages ``n`` and good ones ``y``.
    """
    domain, suffix = _registered(F.col("host"), suffixes)
    base = hosts.select("host", "n", "y", domain.alias("domain"), suffix.alias("suffix"))
    by_domain = base.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    corpus = by_suffix.agg(((F.sum("y") + 1.0) / (F.sum("n") + 2.0)).alias("p")).scalar()
    suffixes = _mean(by_suffix.withColumn("prior", F.coalesce(corpus, F.lit(0.5))), least_strength, most_strength)
    domains = _mean(
        by_domain.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"), least_strength, most_strength
    )
    level = base.join(domains.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"])
    a = F.col("strength") * F.col("prior") + F.col("y")
    b = F.col("strength") * (1 - F.col("prior")) + F.col("n") - F.col("y")
    return _mean(level, least_strength, most_strength).select(
        "host", "domain", "n", "mean", _mass_below(min_lower, a.cast("double"), b.cast("double")).alias("below")
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    outcome: str = "quality",
    min_lower: float = 0.5,
    level: float = 0.95,
    suffixes: Sequence[str] = TWO_PART_SUFFIXES,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, labelled (of its host), below.

    ``below``: the host's posterior mass below ``min_lower``, three decimals; at most ``1 - level`` allows the page.
    ``labels`` holds outcomes 0 or 1 by page id. ``rules`` are (action, text) pairs such as
    ``("block", "net/")``: host up to the first slash, then a path prefix.
    """
    p = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    outcomes = (
        labels.where(F.col(outcome).isin(0, 1) & F.col(label_id).isNotNull())
        .groupBy(F.col(label_id).alias("page_id"))
        .agg(F.count("*").alias("n"), F.sum(F.col(outcome).cast("long")).alias("y"))
    )
    hosts = (
        p.join(outcomes, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y"))
    )
    reputation = materialize(host_reputation(materialize(hosts), min_lower=min_lower, suffixes=suffixes))
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("below") <= round(1 - level, 12), F.lit("allow")).otherwise(F.lit("block"))
    return p.join(reputation.select("host", "n", "below"), "host", "left").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(action, method).alias("verdict"),
        F.col("n").alias("labelled"),
        (F.floor(F.col("below") * 1000 + 0.5) / 1000).alias("below"),
    )
