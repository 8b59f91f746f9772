"""URL filter: exact host and path rules, and an empirical-Bayes reputation for all other hosts.

Labelled page outcomes are counted per host. A suffix's rate is shrunk to the
rate of all pages, a registered domain's to its suffix, a host's to its domain,
each by a beta-binomial prior whose strength is estimated from the level
itself. A host is blocked when the lower posterior bound of its bad rate is
above the limit. Counting is one aggregation per level; labels join on the page
id, and verdicts, one row per host, join back without a hint, so adaptive
execution broadcasts a small table and splits a hot host otherwise.

Defined results: a null url or one without `://` has an empty host and path, no
rule and no reputation, and is allowed. A page without a label, or with a null
one, counts for nothing. A label that repeats counts once, as bad if any of its
rows is bad. Repeated pages are all returned. With no labels at all nothing is
blocked but by rules. Of rules that fit the longest wins; rules are different, so
there are no ties. An empty table of pages gives no rows. Urls of any length are
read whole. Only the named columns are read and returned, so others may have any
name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.llm.common import ascii_lower, stored
from causalrisk.llm.shrinkage import lower_bound, posterior_mean, prior_strength

#: Suffixes of two labels under which names are registered; any other last label is a suffix.
LONG_SUFFIXES = ("co.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")


@dataclass(frozen=True)
class Rule:
    """`host/path`: fits the host and its subdomains where the url's path starts with the rule's."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column, take: Column) -> Column:
    parts = F.split(host, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - take + 1, F.lit(1)), F.size(parts)), ".")


def suffix_of(host: Column) -> Column:
    return F.when(_labels(host, F.lit(2)).isin(*LONG_SUFFIXES), _labels(host, F.lit(2))).otherwise(_labels(host, F.lit(1)))


def domain_of(host: Column) -> Column:
    """The suffix and one label more."""
    return F.when(_labels(host, F.lit(2)).isin(*LONG_SUFFIXES), _labels(host, F.lit(3))).otherwise(_labels(host, F.lit(2)))


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Per host: `n` labelled pages, `k` bad ones, `rate` after shrinking and its lower `bound`; outcomes: `host`, `bad`."""
    hosts = stored(
        outcomes.where("host != '' and bad is not null").groupBy("host").agg(
            F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("k"),
        ).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}),
        "hosts",
    )
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = F.lit(total.k / total.n if total.n else 0.0)
    n, k = F.col("n"), F.col("k")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = suffixes.select("suffix", posterior_mean(n, k, overall, prior_strength(suffixes, "n", "k", overall)).alias("prior"))
    domains = domains.join(suffixes, "suffix")
    prior = F.col("prior")
    domains = domains.select("domain", posterior_mean(n, k, prior, prior_strength(domains, "n", "k", prior)).alias("prior"))
    hosts = hosts.join(domains, "domain")
    strength = prior_strength(hosts, "n", "k", prior)
    return hosts.select(
        "host", "n", "k", posterior_mean(n, k, prior, strength).alias("rate"), lower_bound(n, k, prior, strength, z).alias("bound"),
    )


def host_rules(hosts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Per host: the rules whose host it is or is under, as an array of (length, pattern, path, verdict)."""
    spark = hosts.sparkSession
    table = spark.createDataFrame(
        [(r.host, len(r.pattern), r.pattern, r.path, r.verdict) for r in rules], "rule_host string, size int, pattern string, path string, verdict string"
    )
    parts = F.split("host", r"\.")
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("rule_host"))
    return ends.join(table, "rule_host").groupBy("host").agg(F.collect_list(F.struct("size", "pattern", "path", "verdict")).alias("rules"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, max_bad_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """Every page (`page_id`, `url`) with `host`, `path`, `rule`, `verdict` and the host's `bound`; labels: `page_id`, `bad`."""
    pages = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    outcome = labels.where("page_id is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    reputation = host_reputation(pages.select("page_id", "host").join(outcome, "page_id"), z)
    hosts = pages.select("host").where("host != ''").distinct()
    known = hosts.join(reputation.select("host", "bound"), "host", "left").join(host_rules(hosts, rules), "host", "left")
    # stored, so that the join may broadcast it if small, or split a hot host's pages if not
    known = stored(known, "known-hosts")
    fits = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["path"])))
    judged = pages.join(known, "host", "left").withColumn("fit", fits)
    by_host = F.when(F.col("bound") > max_bad_rate, "block").otherwise("allow")
    return judged.select(
        "page_id", "url", "host", "path", F.col("fit.pattern").alias("rule"), F.coalesce("fit.verdict", by_host).alias("verdict"), "bound",
    )
