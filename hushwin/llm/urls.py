"""URL filter: fixed rules, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and public
suffix; users and ports are no part of these, and an address has no levels.
Each level's bad rate is shrunk towards the level above by a beta-binomial
prior whose strength is estimated from how much the level's rates spread
(method of moments). A host is blocked when even the lower bound of its
posterior bad rate is above the limit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushwin.llm.common import staged
from hushwin.llm.suffixes import suffix_and_domain

#: (host, path, verdict); the longest fitting rule wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
MAX_SPREAD = 0.25    # greatest correlation a prior may show; a prior then weighs three pages at least
LIMIT = 0.5          # bad rate above which a host is blocked,
DEVIATIONS = 1.64    # if it stays above by so many posterior standard deviations
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty if the url is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(rows: DataFrame, mean: str) -> float:
    """Prior mass of (n, bad, mean) rows: 1 / rho - 1, rho being how much
    more the bad counts spread around the means than a binomial's would."""
    m = F.col(mean)
    var = m * (1 - m)
    got = rows.agg(F.sum((F.col("bad") - F.col("n") * m) ** 2 - F.col("n") * var).alias("over"),
                   F.sum(F.col("n") * (F.col("n") - 1) * var).alias("room")).first()
    rho = got.over / got.room if got.room else 0.0
    return 1 / min(max(rho or 0.0, 1e-4), MAX_SPREAD) - 1


def _shrunk(rows: DataFrame, above: str, own: str) -> DataFrame:
    """Adds the posterior mean and variance of each row's bad rate: its
    counts with the mean above as prior, and the share that the prior has of
    the uncertainty above."""
    mean = "base" if above == "base" else f"{above}_mean"
    k = _strength(rows, mean)
    m = (F.col("bad") + k * F.col(mean)) / (F.col("n") + k)
    passed = k / (F.col("n") + k)
    return (rows.withColumn(f"{own}_mean", m).withColumn(
        f"{own}_variance", F.col(f"{own}_mean") * (1 - F.col(f"{own}_mean")) / (F.col("n") + k + 1) + passed * passed * F.col(f"{above}_variance")))


def _placed(hosts: DataFrame) -> DataFrame:
    """Adds suffix and domain, by the public suffix list."""
    def run(batches):
        for batch in batches:
            found = [suffix_and_domain(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in found], pa.string()), pa.array([d for _, d in found], pa.string())],
                                             names=["host", "n", "bad", "suffix", "domain"])

    return hosts.select("host", "n", "bad").mapInArrow(run, "host string, n long, bad long, suffix string, domain string")


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, deviation) for every host of ``pages``
    (page_id, host), from ``outcomes`` (page_id, bad: 0 or 1).

    Counts combine map-side, so a hot host costs a row per task; everything
    after them is one row per host. Three pairs of numbers reach the driver."""
    marked = (outcomes.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull())
              .groupBy("page_id").agg(F.max("bad").cast("long").alias("bad")))
    hosts = staged(_placed(pages.join(marked, "page_id", "left").groupBy("host")
                           .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = (total.bad + 0.5) / (total.n + 1.0) if total.n else 0.5

    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = staged(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("base", F.lit(base)), "suffixes")
    suffixes = _shrunk(suffixes.withColumn("base_variance", F.lit(0.0)), "base", "suffix")
    domains = staged(domains.join(suffixes.select("suffix", "suffix_mean", "suffix_variance"), "suffix"), "domains")
    domains = _shrunk(domains, "suffix", "domain").select("suffix", "domain", "domain_mean", "domain_variance")
    hosts = staged(hosts.join(domains, ["suffix", "domain"]), "host-means")
    return _shrunk(hosts, "domain", "host").select("host", "n", "bad", F.col("host_mean").alias("mean"), F.sqrt("host_variance").alias("deviation"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, bad_rate (the host's).

    A url that is null or has no host is judged by the reputation of the
    empty host. Without any outcome nothing is blocked but by rule. Repeated
    rows are judged alike; an empty table gives no rows."""
    host, path = host_and_path(F.col("url").cast("string"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    known = reputation(p.select("page_id", "host"), outcomes)
    own = F.when(F.col("mean") - deviations * F.col("deviation") > limit, "block").otherwise("allow")
    return (p.join(known, "host").withColumn("rule", rule).withColumn("verdict", F.coalesce(fixed, own))
            .select("page_id", "host", "path", "rule", "verdict", F.col("mean").alias("bad_rate")))
