"""URL filters: rules first, then the reputation of hosts by empirical Bayes.

A page under a rule takes the rule's verdict. These pages are the labelled outcomes (callers may
pass others), counted for each host. The share of blocked pages is shrunk from level to level: a
suffix towards the whole, a registered domain towards its suffix, a host towards its domain. Each
level's prior is a beta distribution around its parent's estimate; its strength comes from how far
the shares of a level scatter around their parents, by the method of moments. A page without a rule
is blocked where the lower bound of its host's posterior share reaches the limit.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, and is judged as the
host ''; hosts of one label are their own domain and suffix; ids and URLs may repeat; without any
labelled outcome everything is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host and path of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Second labels that make a suffix of two labels under a country's code.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Deviations below the mean that make the bound, and the share from which a host is blocked.
DEVIATIONS, LIMIT = 1.645, 0.8
#: Range of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 100.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls without one."""
    name = verdict = None
    for decision, of_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(prefix)
        name = F.when(fits, F.lit(of_host + prefix)).otherwise(F.lit(None).cast("string") if name is None else name)
        verdict = F.when(fits, F.lit(decision)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return name, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    labels = F.split(host, r"\.")
    two = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND)
    of_suffix = F.when(two, 2).otherwise(1)
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return tail(of_suffix + 1), tail(of_suffix)


def _strength(level: DataFrame) -> float:
    """The pages that a prior is worth, by the method of moments, over (n, blocked, parent's share)."""
    share = F.col("blocked") / F.col("n")
    spread = F.col("parent") * (1 - F.col("parent"))
    row = level.where("n > 0").agg(
        F.sum(F.col("n") * (share - F.col("parent")) ** 2).alias("seen"), F.sum(spread).alias("chance"),
        F.sum(spread * (F.col("n") - 1)).alias("room"),
    ).first()
    if not row["room"]:
        return STRONGEST
    alike = (row["seen"] - row["chance"]) / row["room"]
    return min(max(1 / alike - 1, WEAKEST), STRONGEST) if alike > 0 else STRONGEST


def reputation(outcomes: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, share, bound): posterior mean of the blocked share, and its lower bound.

    ``outcomes`` has a row for each host: (host, n, blocked), with n = 0 where nothing is labelled.
    """
    domain, suffix = levels(F.col("host"))
    hosts = outcomes.select("host", domain.alias("domain"), suffix.alias("suffix"), F.col("n").cast("double").alias("n"), F.col("blocked").cast("double").alias("blocked"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    whole = total["blocked"] / total["n"] if total["n"] else 0.0
    sums = (F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    of_domain = hosts.groupBy("domain", "suffix").agg(*sums)
    of_suffix = of_domain.groupBy("suffix").agg(*sums).withColumn("parent", F.lit(whole))
    raw = F.when(F.col("n") > 0, F.col("blocked") / F.col("n")).otherwise(F.lit(whole))
    of_suffix = _shrunk(of_suffix, _strength(of_suffix))
    raw_suffix, raw_domain = of_suffix.select("suffix", raw.alias("parent")), of_domain.select("domain", raw.alias("parent"))
    domain_strength = _strength(of_domain.join(raw_suffix, "suffix"))
    host_strength = _strength(hosts.join(raw_domain, "domain"))
    of_domain = _shrunk(of_domain.join(of_suffix.select("suffix", F.col("share").alias("parent")), "suffix"), domain_strength)
    of_host = hosts.join(of_domain.select("domain", F.col("share").alias("parent")), "domain")
    a = F.col("blocked") + host_strength * F.col("parent")
    b = F.col("n") - F.col("blocked") + host_strength * (1 - F.col("parent"))
    share = a / (a + b)
    bound = share - deviations * F.sqrt(share * (1 - share) / (a + b + 1))
    return of_host.select("host", share.alias("share"), bound.alias("bound"))


def _shrunk(level: DataFrame, strength: float) -> DataFrame:
    return level.withColumn("share", (F.col("blocked") + strength * F.col("parent")) / (F.col("n") + strength))


def judge(pages: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page."""
    host, path = split_url(F.col("url").cast("string"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"))
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    outcomes = ruled.groupBy("host").agg(
        F.count("by_rule").alias("n"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked"))
    known = reputation(outcomes).select("host", F.when(F.col("bound") >= limit, "block").otherwise("allow").alias("by_host"))
    return ruled.join(known, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))
