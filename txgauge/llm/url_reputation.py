"""URL filtering by rules and by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host. Rates are shrunk along all pages -> suffix -> registered
domain -> host: each level's prior is a beta distribution around the level above without the row's own pages, its
concentration estimated from the whole level by the method of moments. A host is blocked if the lower posterior bound of its bad rate exceeds a
limit. Hosts without labels have the rate of their domain or suffix, with that level's uncertainty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txgauge.llm.common import ascii_lower, cut, others

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Public suffixes of two labels that are taken without a list of one's own.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.kr", "com.br", "com.cn", "co.in", "co.nz", "co.za")
ADDED = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host that reputation goes by: without user name, port and last dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def _is_address(site: Column) -> Column:
    return site.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")


def suffix_of(site: Column, suffixes: Sequence[str] = SECOND_LEVEL) -> Column:
    """The longest of the suffixes that the site ends in, else its last label; `ip` for addresses."""
    found = F.substring_index(site, ".", -1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        last = F.substring_index(site, ".", -n)
        found = F.when(last.isin(*[s for s in suffixes if s.count(".") + 1 == n]), last).otherwise(found)
    return F.when(_is_address(site), "ip").otherwise(found)


def domain_of(site: Column, suffixes: Sequence[str] = SECOND_LEVEL) -> Column:
    """The suffix and one label more, if there is one; addresses are domains of their own."""
    labels = F.size(F.split(suffix_of(site, suffixes), r"\.")) + 1
    cut_at = F.split(site, r"\.")
    return F.when(_is_address(site), site).otherwise(F.array_join(F.slice(cut_at, F.greatest(F.size(cut_at) - labels + 1, F.lit(1)), labels), "."))


def match_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _shrunk(level: DataFrame) -> DataFrame:
    """level (n, bad, and the parent's posterior pa, pb) with its own posterior alpha, beta.

    The prior is the parent without the row's own pages, so none count twice. Its mean is m; its intra-class
    correlation is that of the level, rho, and the parent's own uncertainty by the law of total variance. rho =
    (sum (bad - n m)^2 - sum n m (1 - m)) / sum n (n - 1) m (1 - m), kept within 0.001 and 0.5.
    """
    a, b = F.col("pa") - F.col("bad"), F.col("pb") - (F.col("n") - F.col("bad"))
    d = level.withColumns({"m": a / (a + b), "own": 1 / (a + b + 1)})
    v = F.col("n") * F.col("m") * (1 - F.col("m"))
    over = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("m"), 2) - v)
    rho = d.filter("n > 0").agg(F.coalesce(F.least(F.lit(0.5), F.greatest(F.lit(0.001), F.try_divide(over, F.sum(v * (F.col("n") - 1))))), F.lit(0.5)).alias("rho"))
    d = d.crossJoin(F.broadcast(rho))  # one row
    d = d.withColumn("k", 1 / (F.col("rho") + (1 - F.col("rho")) * F.col("own")) - 1)
    post = {"alpha": F.col("bad") + F.col("k") * F.col("m"), "beta": F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("m"))}
    return d.withColumns(post).drop("m", "own", "rho", "k", "pa", "pb")


def host_reputation(outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """host, n, bad, bad_rate, bad_bound from rows (host, n, bad), one a host, of all hosts to be judged.

    suffixes are public suffixes of more than one label, such as a full list of them; others are the last label.
    """
    # each level is read twice, for its rho and for its rows: written, it is computed once
    site = site_of(F.col("host"))
    d = cut(outcomes).withColumn("domain", domain_of(site, suffixes)).withColumn("suffix", suffix_of(site, suffixes))
    domains = cut(d.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    bad, n = F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    top = suffixes.agg((bad + 0.5).alias("pa"), (n - bad + 0.5).alias("pb"))
    parent = lambda x, key: cut(x.select(key, F.col("alpha").alias("pa"), F.col("beta").alias("pb")))
    s = parent(_shrunk(suffixes.crossJoin(F.broadcast(top))), "suffix")  # one row
    g = parent(_shrunk(domains.join(s, "suffix")), "domain")
    h = _shrunk(d.join(g, "domain"))
    total = F.col("alpha") + F.col("beta")
    spread = F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    h = h.withColumn("bad_rate", F.col("alpha") / total)
    return h.select("host", "n", "bad", "bad_rate", (F.col("bad_rate") - z * spread).alias("bad_bound"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule],
    most_bad: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    suffixes: Sequence[str] = SECOND_LEVEL,
) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    labels belong to the page whose identifier is their label_id: here the labels of documents speak of the pages of the
    same number. A labelled page is bad if it is toxic or of quality 0; several labels of one page count as one, the worst; null
    labels say nothing. Pages with a null identifier have no label. Null urls have an empty host and path. The host
    keeps port and user name, reputation goes by it without them. Input columns with the added names are replaced; an empty table
    gives an empty result.
    """
    said = labels.filter(F.col(label_id).isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull())).groupBy(F.col(label_id).alias("__id"))
    said = said.agg(F.max(F.when((F.col("toxic") > 0) | (F.col("quality") <= 0), 1).otherwise(0)).alias("__bad"))
    p = pages.select(*others(pages, ADDED)).withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    per_host = p.select("host", F.col(id_col).alias("__id")).join(said, "__id", "left").groupBy("host")
    outcomes = per_host.agg(F.count("__bad").alias("n"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("bad"))
    blocked = host_reputation(outcomes, suffixes=suffixes).select(F.col("host").alias("__host"), (F.col("bad_bound") > most_bad).alias("__blocked"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    out = p.join(blocked, F.col("host") == F.col("__host"), "left").drop("__host")
    own = F.when(F.coalesce("__blocked", F.lit(False)), "block").otherwise("allow")
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, own)).drop("__blocked")
