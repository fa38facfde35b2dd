"""Empirical-Bayes reputation of web hosts, with explicit rules that take precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paracorpus.llm.common import pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One-sided normal quantile of the posterior bound (95 %), and the least good share it must reach.
Z, LEAST_GOOD = 1.645, 0.5
#: Bounds of the intra-class correlation: no level is trusted fully, none is pooled completely.
LEAST_RHO, MOST_RHO = 0.0001, 0.99

Rule = tuple[str, str, str]  # host, path, verdict


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does.

    A rule fits its host and all its subdomains if the path starts with its path. Of rules of equal
    length the one with the longer host wins. The rules are a list that is read with the query.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _strength(children: DataFrame, total: float, rate: float) -> float:
    """How many pages a prior weighs that has these children: 1 / rho - 1, where rho is the moment
    estimate of the intra-class correlation of beta-binomial counts (n, good)."""
    n, spread = F.col("n"), F.col("good") / F.col("n") - rate
    s, one, many = (
        children.where("n > 0")
        .agg(F.sum(n * spread * spread), F.sum(1 - n / total), F.sum(n * (1 - n / total)))
        .first()
    )
    noise = rate * (1 - rate)
    if s is None or noise <= 0 or many <= one:
        return 1 / LEAST_RHO - 1
    rho = (s - noise * one) / (noise * (many - one))
    return 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1


def host_posteriors(hosts: DataFrame) -> DataFrame:
    """host, n, good, posterior_mean, posterior_low from one row per host (host, n, good).

    n and good count a host's labelled pages. Registered domain: the last two labels of the host;
    suffix: the last one. The prior of a suffix is centred on the rate of all pages, that of a domain
    on its suffix's posterior mean, that of a host on its domain's. A prior weighs as many pages as
    the spread of the rates at its level says, so a host without labels has its domain's rate and
    one with many has its own. Only a few sums over `hosts`, which is read several times, come to
    the driver.
    """
    labels = F.split("host", r"\.")
    domain = F.when(F.size(labels) > 2, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.col("host"))
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", F.element_at(labels, -1))
    counts = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    total, good = suffixes.agg(*counts).first()
    total, good = total or 0, good or 0
    rate = good / total if total else 0.5  # no labelled page at all: as if one of two were good
    by_suffix, by_domain, by_host = (_strength(x, total, rate) for x in (suffixes, domains, hosts))
    n, hits = F.col("n"), F.col("good")
    suffix_rate = suffixes.select("suffix", ((hits + by_suffix * rate) / (n + by_suffix)).alias("suffix_rate"))
    domain_rate = domains.join(suffix_rate, "suffix").select(
        "domain", ((hits + by_domain * F.col("suffix_rate")) / (n + by_domain)).alias("domain_rate")
    )
    mean = (hits + by_host * F.col("domain_rate")) / (n + by_host)
    return (
        hosts.join(domain_rate, "domain")
        .withColumn("posterior_mean", mean)
        .withColumn("posterior_low", mean - Z * F.sqrt(mean * (1 - mean) / (n + by_host + 1)))
        .select("host", "n", "good", "posterior_mean", "posterior_low")
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    least_good: float = LEAST_GOOD,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, labelled_pages, good_pages.

    `outcomes` (id, good 0/1) has the labelled pages; a null outcome is no label, and of several rows of a page
    the worst counts. A page
    that no rule fits is allowed if the lower posterior bound of its host's good share is at least
    `least_good`. Counts are combined in every task before they are shuffled, so a host that holds
    most pages sends one row per task; the join back has one row per host, and Spark splits its
    large hosts. A null url, or one without ://, has an empty host, which is judged like any other.
    Repeated ids are counted and returned as often as they occur. Other columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    labelled = outcomes.where("good is not null").groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col("good").cast("long")).alias("good"))
    hosts = pin(
        urls.join(labelled, "_id", "left")
        .groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")),
        "hosts",
    )
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("posterior_low") >= least_good, F.lit("allow")).otherwise(F.lit("block"))
    return urls.join(host_posteriors(hosts), "host").select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(says, by_method).alias("verdict"),
        F.col("n").alias("labelled_pages"),
        F.col("good").alias("good_pages"),
    )
