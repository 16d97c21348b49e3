"""Mix documents to target domain weights by soft membership.

A labelled table names the domain of some documents. Per domain the means and
variances of eight writing rates (accents, capitals, symbols, digits ...) are
aggregated; with the share of the domain they give every document its posterior
over the domains (Gaussian naive Bayes, variances floored). Rates ``w >= 0`` of
the documents are then fitted so that the expected tokens of every domain,
``sum(w * tokens * posterior)``, meet the targets: projected-gradient least
squares from ``w = 1``, with squared errors weighted by the domain's share. In
that measure a step of 1 is safe, and each step is one aggregation over the
narrow table of posteriors. A document's rate after a step is an expression over
its own posterior and the residuals so far, so no rates are joined or collected.

Everything is a DataFrame expression. Defined cases: a null text has no tokens
and takes the prior as posterior; labels that are null count for no domain; a
document labelled more than once counts for each of its labels; targets of domains that no
document is labelled with are left out, the rest is scaled up; without any
labels or tokens every rate is 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.session import bounded, settle

# Rates per character, by pattern; "tokens" are the words.
RATES = {
    "romance": "[éèêçàùâîôû]",
    "german": "[äöüß]",
    "spanish": "[ñáíóú]",
    "northern": "[wkh]",
    "capitals": r"\p{Lu}",
    "symbols": r"[%#*&$!|]",
    "digits": "[0-9]",
    "spaces": r"\s",
}
TOKEN = r"\S+"
LEAST_SPREAD = 0.004
MOST_DOMAINS = 64
STEPS = 40
TOLERANCE = 1e-6


def writing_rates(documents: DataFrame, text: str) -> DataFrame:
    """``row`` (all columns), ``tokens`` and the rates of every whole text."""
    value = F.coalesce(F.col(text), F.lit(""))
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    rates = [(F.regexp_count(value, F.lit(pattern)) / size).alias(name) for name, pattern in RATES.items()]
    return documents.select(F.struct("*").alias("row"), F.regexp_count(value, F.lit(TOKEN)).cast("bigint").alias("tokens"), *rates)


def domain_moments(rates: DataFrame, labelled: DataFrame, key: str, domain: str) -> list[dict]:
    """Per domain: its name, count, means and variances of the rates; at most ``MOST_DOMAINS`` rows."""
    known = labelled.select(F.col(key).alias("_key"), F.col(domain).cast("string").alias("_domain")).dropna().distinct()
    known = bounded(known, "domains", F.lit(24) + F.length("_domain"), 16 * 1024 * 1024)
    joined = rates.select(F.col(f"row.`{key}`").alias("_key"), *RATES).join(known, "_key")
    measures = [F.avg(name).alias(f"{name}_mean") for name in RATES] + [F.var_pop(name).alias(f"{name}_variance") for name in RATES]
    rows = joined.groupBy("_domain").agg(F.count(F.lit(1)).alias("n"), *measures).orderBy("_domain").limit(MOST_DOMAINS + 1).collect()
    if len(rows) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    return [row.asDict() for row in rows]


def posterior_columns(moments: list[dict]) -> list[Column]:
    """The posterior of each domain, from the rates and ``tokens``."""
    import math

    total = sum(m["n"] for m in moments)
    scores = []
    for m in moments:
        prior = math.log(m["n"] / total)
        terms = [F.lit(prior)]
        for name in RATES:
            variance = max(m[f"{name}_variance"] or 0.0, LEAST_SPREAD**2)
            off = F.col(name) - F.lit(float(m[f"{name}_mean"]))
            terms.append(F.when(F.col("tokens") > 0, -off * off / (2 * variance) - 0.5 * math.log(variance)).otherwise(0.0))
        scores.append(reduce(lambda a, b: a + b, terms))
    return scores


def with_posteriors(rates: DataFrame, moments: list[dict]) -> DataFrame:
    """``row, tokens, p`` with ``p`` an array in the order of ``moments``."""
    scored = rates.select("row", "tokens", F.array(*posterior_columns(moments)).alias("s"))
    scored = scored.select("row", "tokens", "s", F.array_max("s").alias("top"))
    raised = scored.select("row", "tokens", F.transform("s", lambda x: F.exp(x - F.col("top"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return raised.select("row", "tokens", "e", total.alias("total")).select(
        "row", "tokens", F.transform("e", lambda x: x / F.col("total")).alias("p")
    )


def rate_column(residuals: list[list[float]]) -> Column:
    """The rate after the steps with these weighted residuals: a step down the gradient, cut at 0."""
    steps = F.array(*[F.array(*[F.lit(value) for value in residual]) for residual in residuals]).cast("array<array<double>>")

    def step(rate: Column, residual: Column) -> Column:
        slope = F.aggregate(F.zip_with("p", residual, lambda p, r: p * r), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), rate - slope)

    return F.aggregate(steps, F.lit(1.0), step)


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float]) -> list[list[float]]:
    """The residuals of every step; ``members`` has ``tokens, p`` and is read once a step."""

    def masses(rate: Column) -> list[float]:
        sums = [F.sum(rate * F.col("tokens") * F.col("p")[k]).alias(f"m{k}") for k in range(len(domains))]
        return [float(x or 0.0) for x in members.agg(*sums).first()]

    have = masses(F.lit(1.0))
    total, wanted = sum(have), {d: max(float(targets.get(d, 0.0)), 0.0) for d in domains}
    asked = sum(wanted[d] for d, mass in zip(domains, have, strict=True) if mass > 0)
    if total <= 0 or asked <= 0:
        return []
    goal = [total * wanted[d] / asked if mass > 0 else 0.0 for d, mass in zip(domains, have, strict=True)]
    residuals, now = [], have
    for _ in range(STEPS):
        error = [a - b for a, b in zip(now, goal, strict=True)]
        if max(abs(x) for x in error) <= TOLERANCE * total:
            break
        residuals.append([x / mass if mass > 0 else 0.0 for x, mass in zip(error, have, strict=True)])
        now = masses(rate_column(residuals))
    return residuals


def mix(
    documents: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    key: str = "doc_id",
    domain: str = "domain",
    text: str = "text",
) -> tuple[DataFrame, list[str]]:
    """``row, tokens, p, rate`` of every document, and the domains in the order of ``p``."""
    rates = settle(writing_rates(documents, text), "rates")
    moments = domain_moments(rates, labelled, key, domain)
    if not moments:
        return rates.select("row", "tokens", F.array().cast("array<double>").alias("p"), F.lit(1.0).alias("rate")), []
    domains = [m["_domain"] for m in moments]
    members = with_posteriors(rates, moments)
    narrow = settle(members.select("tokens", "p"), "posteriors")
    residuals = fit_rates(narrow, domains, targets)
    return members.withColumn("rate", rate_column(residuals)), domains
