"""URL filters: fixed rules first, else the reputation of the host.

Labelled pages are good or bad. Good shares of hosts are shrunk towards those of their
registered domain, these towards their suffix, these towards the whole, each by a beta prior
around the parent's posterior mean whose strength is estimated from all groups of its level
(moments of the beta-binomial). A page is blocked if even the upper bound of its host's
posterior good share is below `least`.

Cases: a null url or one without `://` has empty host and path and is judged by the whole's
share. A host without labelled pages takes what its domain or suffix says. Labels with a
null quality and labels without page are left out; a repeated label counts once per row.
Ties of equally long rules go to the first. Without labels every page is judged by one half.
Very long urls are whole. An empty table of pages gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.session import cut_lineage

# Country suffixes below which names are registered one level further down.
LONG_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp com.br co.in co.za"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class Reputation:
    """`least` good share; `z` standard deviations up to the bound; hosts and domains are joined
    in `salts` parts each, so that neither a host's pages nor a domain's hosts need to meet in
    one task.
    """

    least: float = 0.5
    z: float = 2.0
    salts: int = 16


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix(name: Column) -> Column:
    """The last label of a host, or the last two where names are registered below those."""
    last_two = F.substring_index(name, ".", -2)
    return F.when(last_two.isin(*LONG_SUFFIXES.split()), last_two).otherwise(
        F.substring_index(name, ".", -1)
    )


def domain(name: Column) -> Column:
    """The registered domain: the suffix and one label before it."""
    long = F.substring_index(name, ".", -2).isin(*LONG_SUFFIXES.split())
    return F.when(long, F.substring_index(name, ".", -3)).otherwise(
        F.substring_index(name, ".", -2)
    )


def registered(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """`hosts` (distinct `host`) with `domain` and `suffix`.

    The longest of `suffixes` (a column `suffix`) that ends a host at a label is its suffix, else
    its last label; the domain has one label more, if there is one. Without a table the
    suffixes are `LONG_SUFFIXES`.
    """
    if suffixes is None:
        return hosts.withColumns({"domain": domain(F.col("host")), "suffix": suffix(F.col("host"))})
    labels = F.size(F.split("host", r"\."))
    tails = hosts.select("host", F.explode(F.sequence(F.lit(1), labels)).alias("k")).withColumn(
        "tail", F.expr("substring_index(host, '.', -k)")
    )
    known = suffixes.select(F.col("suffix").alias("tail")).distinct().withColumn("is", F.lit(True))
    longest = (
        tails.join(known, "tail", "left")
        .groupBy("host")
        .agg(F.coalesce(F.max(F.when(F.col("is"), F.col("k"))), F.lit(1)).alias("k"))
    )
    return hosts.join(longest, "host").select(
        *hosts.columns,
        F.expr("substring_index(host, '.', -(k + 1))").alias("domain"),
        F.expr("substring_index(host, '.', -k)").alias("suffix"),
    )


def rule_for(rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits columns `host` and `path`."""
    case = None
    for rule in sorted(rules, key=lambda r: -len(r.host + r.path)):
        fits = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits &= F.col("path").startswith(rule.path)
        said = F.struct(
            F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict")
        )
        case = F.when(fits, said) if case is None else case.when(fits, said)
    none = F.lit(None).cast("struct<rule: string, verdict: string>")
    return none if case is None else case.otherwise(none)


def _strength(groups: DataFrame) -> float:
    """Prior strength from groups (good, n, mean): how far shares stray beyond chance."""
    spread = F.col("mean") * (1 - F.col("mean"))
    stray = F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("mean"), F.lit(2.0)) / spread
    more, pairs = groups.where("n > 0").agg(F.sum(stray - 1), F.sum(F.col("n") - 1)).first()
    alike = (more / pairs) if pairs else 0.0
    # A prior is worth one page at least, so that one label alone settles nothing.
    alike = min(max(alike, 1e-4), 0.5)
    return 1 / alike - 1


def _shrunk(groups: DataFrame) -> tuple[DataFrame, float]:
    """`groups` (good, n, mean) with the posterior mean, and the strength of the prior."""
    strength = _strength(groups)
    posterior = (F.col("good") + F.col("mean") * strength) / (F.col("n") + strength)
    return groups.withColumn("posterior", posterior), strength


def reputations(
    pages: DataFrame,
    outcomes: DataFrame,
    suffixes: DataFrame | None = None,
    how: Reputation = Reputation(),
) -> DataFrame:
    """(host, mean, a, b) for every host of `pages` (page, host).

    `outcomes` (page, good) holds 0 or 1 per labelled page. `a` and `b` are the parameters of
    the beta posterior of the host's good share.
    """
    good = pages.join(outcomes, "page", "left").groupBy("host").agg(
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("n")
    )
    salt = F.pmod(F.xxhash64("host"), F.lit(how.salts)).cast("int")
    hosts = cut_lineage(registered(good, suffixes).withColumn("salt", salt))
    sums = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    shares = cut_lineage(hosts.groupBy("domain", "suffix", "salt").agg(*sums))
    domains = cut_lineage(shares.groupBy("domain", "suffix").agg(*sums))
    all_good, all_n = domains.agg(F.sum("good"), F.sum("n")).first()
    whole = ((all_good or 0) + 1) / ((all_n or 0) + 2)

    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("mean", F.lit(whole))
    suffixes, _ = _shrunk(cut_lineage(suffixes))
    above = suffixes.select("suffix", F.col("posterior").alias("mean"))
    domains, _ = _shrunk(cut_lineage(domains.join(above, "suffix")))
    # A domain meets its shares, each share its part of the domain's hosts.
    above = domains.select("domain", F.col("posterior").alias("mean"))
    above = shares.select("domain", "salt").join(above, "domain")
    hosts, strength = _shrunk(cut_lineage(hosts.join(above, ["domain", "salt"])))
    return hosts.select(
        "host",
        F.col("posterior").alias("mean"),
        (F.col("good") + F.col("mean") * strength).alias("a"),
        (F.col("n") - F.col("good") + (1 - F.col("mean")) * strength).alias("b"),
    )


def upper_bound(z: float) -> Column:
    """Mean and `z` deviations of the beta distribution with columns `a` and `b`."""
    n = F.col("a") + F.col("b")
    return F.col("a") / n + z * F.sqrt(F.col("a") * F.col("b") / (n * n * (n + 1)))


def judged(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    label_column: str = "doc_id",
    how: Reputation = Reputation(),
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict, reputation, bound) for every row of `pages`.

    A label belongs to the page with its number; a page is good if quality is 1 and toxic
    is not 1. `suffixes` (a column `suffix`) tells where names are registered.
    """
    url = F.col(url_column)
    parts = pages.select(
        F.col(id_column).alias("page"), host(url).alias("host"), path(url).alias("path")
    )
    outcomes = labels.where("quality is not null").select(
        F.col(label_column).alias("page"),
        ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int").alias("good"),
    )
    known = reputations(parts.select("page", "host"), outcomes, suffixes, how).select(
        "host", "mean", upper_bound(how.z).alias("bound")
    )
    spread = known.withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(how.salts - 1)))
    )
    salt = F.pmod(F.xxhash64("page", "path"), F.lit(how.salts)).cast("int")
    method = F.when(F.col("bound") < how.least, "block").otherwise("allow")
    return (
        parts.withColumn("salt", salt)
        .join(spread, ["host", "salt"])
        .withColumn("said", rule_for(rules))
        .select(
            F.col("page").alias(id_column),
            "host",
            "path",
            F.col("said.rule").alias("rule"),
            F.coalesce("said.verdict", method).alias("verdict"),
            F.col("mean").alias("reputation"),
            "bound",
        )
    )
