"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host, registered domain and suffix.  Each level's bad rate is
shrunk towards the level above by a beta prior whose strength is fitted to how much rates differ between
the groups of that level; a host is blocked where the lower bound of its posterior exceeds a limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


#: Suffixes of two labels under which names are registered, besides single labels (a parameter).
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "org.uk")


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where those are one of LONG_SUFFIXES."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES) & (host != two), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: a suffix and one label; an address or a bare name stands for itself."""
    two = F.substring_index(host, ".", -2)
    address = host.rlike(r"^[0-9.:\[\]]*$")
    return F.when(address, host).when(two.isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The fitting rule with the longest text as (rule, verdict), or null."""
    def fits(r: Rule) -> Column:
        return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)

    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    return F.coalesce(*(F.when(fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered), F.lit(None).cast("struct<rule:string,verdict:string>"))


def _level(groups: DataFrame, key: str, up: str | None) -> DataFrame:
    """One row per group ``key`` of (key, up, n, bad, mean of the level above): its posterior ``a`` and ``b``.

    The prior's strength is by moments over all groups: with the pooled variance of the rates around
    their parents' means, ``m (1 - m) / variance - 1``, held within 1 and 1000.
    """
    apart = F.col("bad") / F.col("n") - F.col("mean")
    fit = groups.where("n > 0").agg(
        (F.sum(F.col("mean") * (1 - F.col("mean")) * F.col("n")) / F.sum("n")).alias("noise"),
        F.sum(F.col("n") * apart * apart).alias("square"),
        F.count("*").alias("groups"),
        F.sum("n").alias("all"),
    )
    # between-group variance: what the squares have over what binomial noise alone would give
    between = (F.col("square") - F.col("noise") * F.col("groups")) / (F.col("all") - F.col("groups"))
    strength = F.when((F.col("all") > F.col("groups")) & (between > 0), F.least(F.greatest(F.round(F.col("noise") / between - 1, 6), F.lit(1.0)), F.lit(1000.0))).otherwise(1000.0)
    a, b = F.col("mean") * F.col("strength") + F.col("bad"), (1 - F.col("mean")) * F.col("strength") + F.col("n") - F.col("bad")
    return groups.join(F.broadcast(fit.select(strength.alias("strength")))).select(key, *([up] if up else []), a.alias("a"), b.alias("b"))  # one row


def _under(hosts: DataFrame, key: str, parents: DataFrame, up: str) -> DataFrame:
    """Counts of the groups ``key`` with their parents' posterior means."""
    means = parents.select(up, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
    return hosts.groupBy(key, up).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(means, up)


def reputations(outcomes: DataFrame, z: float = 1.0) -> DataFrame:
    """Hosts with ``bad_rate`` (posterior mean), ``bad_bound`` (its lower bound, mean - z deviations) and ``overall`` (the rate of all).

    ``outcomes`` has host and bad (0, 1, or null where unlabelled).  Hosts without labels get their
    domain's rate with the prior's width.  Without any label the mean is that of one good and one bad page.
    Outcomes are added up per host once and written; each level above is a written table of its groups, so
    no level is computed twice.
    """
    counted = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = cut(counted.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))), "hosts")
    root = cut(hosts.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("mean")), "overall")
    top = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(F.broadcast(root))  # one row
    suffixes = cut(_level(top, "suffix", None), "suffixes")
    domains = cut(_level(_under(hosts, "domain", suffixes, "suffix"), "domain", "suffix"), "domains")
    own = cut(_level(_under(hosts, "host", domains, "domain"), "host", "domain"), "posteriors")
    a, b = F.col("a"), F.col("b")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return own.join(F.broadcast(root)).select("host", (a / (a + b)).alias("bad_rate"), (a / (a + b) - z * deviation).alias("bad_bound"), F.col("mean").alias("overall"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float = 1.0, z: float = 1.0, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdicts on all ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``, ``bad_rate``, ``bad_bound``.

    ``outcomes`` (id, bad) labels some pages; several labels of a page all count, labels of unknown pages
    and null ids do not.  A fitting rule decides, else the host's bound: over ``limit`` times the rate of
    all labelled pages blocks, so with ``limit`` 1 a host goes whose pages are worse than the average with the
    certainty of ``z``, whatever that average is.  A null url or one without ``://`` has an empty host and path; that empty host is judged like any other.
    Repeated rows get equal verdicts; an empty table gives an empty one.

    Labels join pages by id and add up per host before anything is joined by host, so a host with a third
    of all pages costs one row here; AQE splits it in the last join, whose other side has a row a host.
    """
    judged = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labelled = outcomes.select(F.col(id_col).alias("id"), F.col("bad").cast("long").alias("bad"))
    known = reputations(judged.select("id", "host").join(labelled, "id", "left").select("host", "bad"), z)
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    return (
        judged.join(known, "host", "left")
        .withColumn("match", rule)
        .select(F.col("id").alias(id_col), "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.verdict", F.when(F.round("bad_bound", 9) > F.round(limit * F.col("overall"), 9), "block").otherwise("allow")).alias("verdict"), "bad_rate", "bad_bound")
    )
