"""URL filters: listed rules first, then empirical-Bayes reputation of hosts."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.storage import set_aside

#: bounds of the correlation of outcomes within one host, domain or suffix; it sets how strongly a parent's rate counts
LEAST_CORRELATION, MOST_CORRELATION = 0.001, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct of rule and verdict; null if none does.

    A rule fits its host and subdomains if the url's path starts with its path. Of equally long ones a block wins, then
    the smaller text. The list is part of the plan and meant for some hundred rules.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    return F.coalesce(*[
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
               F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, h, p in ordered], F.lit(None).cast("struct<rule:string,verdict:string>"))


def registered_domain(host: Column) -> Column:
    """The last two labels, without port."""
    return F.regexp_extract(F.regexp_replace(host, ":[0-9]*$", ""), r"[^.]*\.?[^.]*$", 0)


def suffix(host: Column) -> Column:
    """The last label, without port."""
    return F.regexp_extract(F.regexp_replace(host, ":[0-9]*$", ""), r"[^.]*$", 0)


def _strength(groups: DataFrame) -> float:
    """Pseudo-observations a parent's rate is worth: by the moments of groups (n, bad) around their parent's rate (prior).

    The weighted squares of n outcomes with correlation c around the prior sum to 1 + (n - 1) c a group on average.
    """
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) / (F.col("prior") * (1 - F.col("prior")))
    row = groups.where("prior > 0 and prior < 1").agg(
        F.sum(spread).alias("q"), F.count(F.lit(1)).alias("g"), F.sum("n").alias("n")).first()
    if not row["g"] or row["n"] <= row["g"]:
        return 1 / LEAST_CORRELATION - 1
    correlation = (row["q"] - row["g"]) / (row["n"] - row["g"])
    return 1 / min(max(correlation, LEAST_CORRELATION), MOST_CORRELATION) - 1


def host_reputation(outcomes: DataFrame, z: float = 1.645, above: float | None = None) -> DataFrame:
    """One row per host with labelled pages: host, bad_rate, lower_bound, blocked.

    ``outcomes`` has host and bad (0 or 1; null labels are left out). Counts are rolled up from hosts to registered
    domains and suffixes. Each level's rate is shrunk to its parent's by a beta-binomial prior whose strength is fitted
    to the level: the overall rate to suffixes, those to domains, those to hosts. A host is blocked if its posterior
    mean less ``z`` standard deviations is over ``above`` (None: the overall rate). Without outcomes no host is rated.
    """
    hosts = (outcomes.where("bad is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
             .withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))}))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = total["bad"] / total["n"] if total["n"] else 0.0
    prior = F.lit(overall).cast("double")

    def shrunk(groups: DataFrame) -> DataFrame:
        strength = _strength(groups)
        return groups.withColumn("a", F.col("bad") + strength * F.col("prior")).withColumn("ab", F.col("n") + F.lit(strength))

    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("prior", prior)).selectExpr("suffix", "a / ab as prior")
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = shrunk(domains).selectExpr("domain", "a / ab as prior")
    rated = shrunk(hosts.join(domains, "domain"))
    mean = F.col("a") / F.col("ab")
    bound = mean - z * F.sqrt(mean * (1 - mean) / (F.col("ab") + 1))
    return rated.select("host", mean.alias("bad_rate"), bound.alias("lower_bound"),
                        (bound > F.lit(overall if above is None else above)).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], **how) -> DataFrame:
    """``pages`` (with a url) with host, path, rule and verdict: a rule's, else block for blocked hosts, else allow.

    ``outcomes`` has url and bad. Null urls have an empty host, which is rated like any other; hosts without labelled
    pages are allowed. Columns of ``pages`` named like the new ones are replaced. Equal rows stay apart.
    """
    host, path = host_and_path(F.col("url"))
    reputation = host_reputation(outcomes.select(host.alias("host"), "bad"), **how)
    pages, restore = set_aside(pages, ["url"], ["host", "path", "rule", "verdict"])
    blocked = reputation.where("blocked").select(F.col("host").alias("_blocked"))
    judged = pages.withColumns({"host": host, "path": path})
    judged = judged.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    judged = judged.join(blocked, F.col("host") == F.col("_blocked"), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_blocked").isNotNull(), F.lit("block")), F.lit("allow"))
    return restore(judged.withColumns({"rule": F.col("_rule.rule"), "verdict": verdict}))
