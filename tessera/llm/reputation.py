"""Judging pages by rules and, where none fits, by the reputation of their host.

Reputation: labelled page outcomes (bad or not) are counted for hosts, registered domains and suffixes. A rate at each level is
shrunk towards that of the level above by a beta-binomial prior whose strength is estimated from the spread of the rates at
that level (method of moments), so a host with few labels speaks with its domain's voice. A host is blocked when the lower
bound of its posterior bad rate is above a threshold; a host without labels has its domain's rate (else its suffix's, else that of all)
as its own. All of it is a handful of aggregates, the largest a row for each host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import small_or_not, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


@dataclass(frozen=True)
class Prior:
    """z: of the posterior bound; threshold: bad rates surely above it block. rho_*: bounds of the estimated correlation of
    outcomes within a group (the prior weighs as 1 / rho - 1 labels)."""

    z: float = 1.645
    threshold: float = 0.5
    rho_least: float = 0.001
    rho_most: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    none = F.coalesce(F.instr(url, "://"), F.lit(0)) == 0
    host, path = (F.when(none, "").otherwise(F.regexp_extract(url, pattern, i)) for i in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def reputation(outcomes: DataFrame, prior: Prior | None = None, others: DataFrame | None = None) -> DataFrame:
    """outcomes: host, bad (0 or 1) -> host, bound: the lower posterior bound of its bad rate.

    The registered domain is a host's last two labels and the suffix its last (no list of longer suffixes is at hand), and the bound is the
    normal one of the beta posterior (mean less z deviations). Rows with a null outcome don't count. others: host, of
    those that get a bound too where they have no outcomes, from the nearest level that has; without any outcomes it is null.
    """
    prior = prior or Prior()
    dots = F.substring_index
    hosts = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.sum("bad").cast("double").alias("b"), F.count("*").cast("double").alias("n"))
    levels = dots("host", ".", -2).alias("domain"), dots("host", ".", -1).alias("suffix")
    hosts = stored(hosts.select("host", *levels, "b", "n"), "reputation-hosts")
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    domains = total(hosts, "domain", "suffix")
    suffixes = total(domains, "suffix")
    top = total(suffixes).select((F.col("b") / F.col("n")).alias("up"))

    def strength(level: DataFrame) -> DataFrame:
        """level: b, n and up (the rate above) -> one row, the weight of the prior."""
        level = level.withColumns({"v": F.col("up") * (1 - F.col("up")), "d": F.col("n") * (F.col("b") / F.col("n") - F.col("up")) ** 2})
        rho = F.try_divide(F.sum("d") - F.sum("v"), F.sum(F.col("v") * (F.col("n") - 1)))  # null: one label each, or all alike
        rho = F.least(F.lit(prior.rho_most), F.greatest(F.lit(prior.rho_least), F.coalesce(rho, F.lit(prior.rho_least))))
        return F.broadcast(level.agg((1 / rho - 1).alias("k")))

    shrunk = lambda level: level.crossJoin(strength(level))
    rate = (F.col("b") + F.col("k") * F.col("up")) / (F.col("n") + F.col("k"))
    suffixes = stored(shrunk(suffixes.crossJoin(F.broadcast(top))).select("suffix", rate.alias("up")), "reputation-suffixes")
    domains = stored(shrunk(domains.join(small_or_not(suffixes), "suffix")).select("domain", rate.alias("up")), "reputation-domains")
    hosts = stored(hosts.join(small_or_not(domains), "domain").select("host", "b", "n", "up"), "reputation-priors")
    known = hosts
    if others is not None:
        rest = others.select("host").distinct().join(small_or_not(hosts).select("host"), "host", "left_anti").select("host", *levels)
        rest = rest.join(small_or_not(domains).withColumnRenamed("up", "domain_up"), "domain", "left").join(small_or_not(suffixes).withColumnRenamed("up", "suffix_up"), "suffix", "left")
        rest = rest.crossJoin(F.broadcast(top)).withColumn("up", F.coalesce("domain_up", "suffix_up", "up"))
        known = hosts.unionByName(rest.select("host", F.lit(0.0).alias("b"), F.lit(0.0).alias("n"), "up"))
    a, c = F.col("b") + F.col("k") * F.col("up"), F.col("n") - F.col("b") + F.col("k") * (1 - F.col("up"))
    bound = a / (a + c) - prior.z * F.sqrt(a * c / ((a + c) ** 2 * (a + c + 1)))
    return known.crossJoin(strength(hosts)).select("host", bound.alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], prior: Prior | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null) and verdict (the rule's, else the host's).

    outcomes: page_id, bad; pages without one count for nothing, several of one page count each. A host without labels is
    judged by the bound that the rate of its domain, else suffix, else of all labels gives it; without any labels it is allowed.
    """
    prior = prior or Prior()
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labelled = rows.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id")
    known = stored(reputation(labelled, prior, rows).where(F.col("bound") > prior.threshold).select("host", F.lit(True).alias("blocked")), "reputation-blocked")
    rule, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = r.fits(F.col("host"), F.col("path"))
        rule, allow = F.when(fits, r.name).otherwise(rule), F.when(fits, r.allow).otherwise(allow)
    rows = rows.join(small_or_not(known), "host", "left")
    verdict = F.coalesce(allow, ~F.coalesce("blocked", F.lit(False)))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.when(verdict, "allow").otherwise("block").alias("verdict"))
