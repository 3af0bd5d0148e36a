"""URL filters (operator 6): host rules, and an empirical-Bayes reputation where no rule fits.

Outcomes of labelled pages (1: bad) are counted by host. A host's rate is shrunk towards its
registered domain's, that towards its suffix's, that towards the rate of all: each level's posterior
mean is the next level's prior mean, with a beta-binomial strength fitted by moments over that level.
A host without outcomes has the posterior of its domain, else of its suffix, for its own. A host is
blocked if the lower bound of its rate exceeds a limit, that is, if its beta posterior leaves less than
TAIL for rates up to the limit. With the limit at a half, blocking a host errs on fewer of its pages than
allowing it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values of the contract: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of two labels under which domains are registered (others: the last label). A
#: short list; a full one is a parameter, as it changes with time.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.kr", "com.br", "co.in")
STRENGTH_LEAST, STRENGTH_MOST, LIMIT, TAIL = 2.0, 200.0, 0.5, 0.05
SALTS = 16


def host_of(url) -> "F.Column":
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url) -> "F.Column":
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host, path, rules=RULES) -> "F.Column":
    """The longest rule whose host is the url's or a parent of it and whose path starts the url's."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        found = F.when(((host == name) | host.endswith("." + name)) & path.startswith(slash + start), F.lit(rule)).otherwise(found)
    return found


def suffix_of(host, suffixes: Sequence[str] = TWO_LABELS) -> "F.Column":
    two = F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)
    return F.when(two.isin(*suffixes), two).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def domain_of(host, suffixes: Sequence[str] = TWO_LABELS) -> "F.Column":
    two = F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)
    three = F.regexp_extract(host, r"([^.]*\.[^.]*\.[^.]*)$", 1)
    own = F.when(two.isin(*suffixes) & (three != ""), three).otherwise(two)
    return F.when(own == "", host).otherwise(own)


def _prior(counts: DataFrame) -> tuple[float, float]:
    """Pooled rate and beta-binomial strength (alpha + beta) of rows of (n, bad), by moments.

    The excess of the weighted variance of the rates over the binomial's gives the intra-class
    correlation; strength = 1 / correlation - 1, within bounds. Without an excess: the upper bound.
    """
    total = counts.agg(F.sum("n").alias("N"), F.sum("bad").alias("B"), F.sum(F.col("n") * F.col("n")).alias("N2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("S"), F.count("*").alias("k")).first()
    if not total.N:
        return 0.0, STRENGTH_MOST
    p = total.B / total.N
    spread = (total.S - total.N * p * p) - (total.k - 1) * p * (1 - p)
    room = p * (1 - p) * (total.N - total.N2 / total.N - (total.k - 1))
    rho = spread / room if room > 0 and spread > 0 else 0.0
    return p, min(STRENGTH_MOST, max(STRENGTH_LEAST, 1 / rho - 1)) if rho > 0 else STRENGTH_MOST


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """By Stirling's series at z + 8."""
    shift = sum(np.log(z + k) for k in range(8))
    y = z + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def beta_share(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of beta distributions at or below x: their continued fraction. 1 where a is 0 (no
    rate but 0), else 0 where b is 0."""
    some = (a > 0) & (b > 0)
    p, q = np.where(some, a, 1.0), np.where(some, b, 1.0)
    turned = x > (p + 1) / (p + q + 2)  # the fraction converges fast below the mean
    p, q, y = np.where(turned, q, p), np.where(turned, p, q), np.where(turned, 1 - x, x)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones(len(p)), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200 + 5 * int(np.sqrt((p + q).max(initial=1)))):
        for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h *= step
        if (np.abs(step - 1) < 1e-14).all():
            break
    share = np.clip(np.where(turned, 1 - front * h, front * h), 0, 1)
    return np.where(some, share, np.where(a <= 0, 1.0, 0.0))


def reputation(outcomes: DataFrame, others: DataFrame | None = None, *, limit: float = LIMIT, suffixes: Sequence[str] = TWO_LABELS) -> DataFrame:
    """host, n, bad, mean and doubt from labelled outcomes (host, bad in {0, 1}).

    mean is the posterior mean, doubt the posterior probability of a rate not above ``limit``. Hosts of
    ``others`` (host) without outcomes have n = bad = 0: the posterior of their domain, else of their
    suffix, else the rate of all is their prior.
    """
    placed = lambda f: f.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    counted = outcomes.filter("bad IS NOT NULL AND host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = cut(placed(counted), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix_sums = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    (rate, s2), (_, s1), (_, s0) = _prior(suffix_sums), _prior(domains), _prior(hosts)
    shrunk = lambda prior, s: (F.col("bad") + s * prior) / (F.col("n") + s)
    level2 = suffix_sums.select("suffix", shrunk(F.lit(rate), s2).alias("m_suffix"))
    level1 = domains.join(level2, "suffix").select("domain", "suffix", shrunk(F.col("m_suffix"), s1).alias("m_domain"))
    level0 = hosts.join(level1, ["domain", "suffix"]).select("host", "n", "bad", "m_domain")
    if others is not None:
        new = placed(others.filter("host <> ''").select("host").distinct().join(hosts, "host", "left_anti"))
        prior = F.coalesce("m_domain", "m_suffix", F.lit(rate))
        level0 = level0.union(new.join(level1, ["domain", "suffix"], "left").join(level2, "suffix", "left").select("host", F.lit(0).cast("long"), F.lit(0).cast("long"), prior))

    @F.pandas_udf("double")
    def doubt(mean: pd.Series, size: pd.Series) -> pd.Series:
        m, s = mean.to_numpy(float), size.to_numpy(float)
        return pd.Series(beta_share(limit, m * s, (1 - m) * s))

    level0 = level0.withColumn("mean", shrunk(F.col("m_domain"), s0))
    return level0.select("host", "n", "bad", "mean", doubt("mean", F.col("n") + s0).alias("doubt"))


def judge(pages: DataFrame, outcomes: DataFrame, *, rules=RULES, limit: float = LIMIT, tail: float = TAIL, suffixes: Sequence[str] = TWO_LABELS) -> DataFrame:
    """page_id, host, path, rule, verdict and doubt of each row of ``pages`` (page_id, url; others are
    ignored).

    outcomes: (host, bad); rows with a null of either teach nothing. A host without outcomes is judged by
    its domain's, else its suffix's, else the rate of all; the empty host of a url that is null or has no
    ``://`` is allowed. doubt is null where the reputation does not block. Repeated rows give repeated
    rows, an empty table none; without outcomes all that no rule blocks is allowed. Urls of any length
    are taken whole. The join on hosts is salted: a host that holds a third of the pages is dealt to
    SALTS tasks.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputation(outcomes, own, limit=limit, suffixes=suffixes).filter(F.col("doubt") < tail).select("host", "doubt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    found = salted.join(known, ["host", "salt"], "left").withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for said, rule in rules:
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return found.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("doubt").isNotNull(), "block").otherwise("allow")).alias("verdict"), "doubt")


#: DuckDB: rules and hierarchy written out; the share of a beta posterior up to a half is integrated
#: over the angle whose squared sine is the rate. The two-label suffixes do not occur in the tables.
SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT host, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS bad FROM u JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL AND host <> ''),
a AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, CASE WHEN host LIKE '%.%' THEN regexp_extract(host, '([^.]*\.[^.]*)$', 1) ELSE host END AS domain, regexp_extract(host, '([^.]*)$', 1) AS suffix
      FROM (SELECT DISTINCT host FROM u WHERE host <> '') LEFT JOIN o USING (host) GROUP BY host),
h AS (SELECT * FROM a WHERE n > 0),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
m AS (SELECT 0 AS level, sum(n) AS t, sum(bad) / sum(n) AS p, sum(n * n) AS q, sum(bad * bad / n) AS v, count(*) AS k FROM h
      UNION ALL SELECT 1, sum(n), sum(bad) / sum(n), sum(n * n), sum(bad * bad / n), count(*) FROM d
      UNION ALL SELECT 2, sum(n), sum(bad) / sum(n), sum(n * n), sum(bad * bad / n), count(*) FROM s),
r AS (SELECT level, p, (v - t * p * p) - (k - 1) * p * (1 - p) AS spread, p * (1 - p) * (t - q / t - (k - 1)) AS room FROM m),
g AS (SELECT level, p, CASE WHEN room > 0 AND spread > 0 THEN least(200.0, greatest(2.0, room / spread - 1)) ELSE 200.0 END AS z FROM r),
s2 AS (SELECT suffix, (bad + z * p) / (n + z) AS prior FROM s, g WHERE level = 2),
d2 AS (SELECT domain, d.suffix, (bad + z * prior) / (n + z) AS prior FROM d JOIN s2 USING (suffix), g WHERE level = 1),
h2 AS (SELECT host, (bad + z * coalesce(d2.prior, s2.prior, p)) / (n + z) AS mean, n + z AS size FROM a LEFT JOIN d2 USING (domain) LEFT JOIN s2 ON s2.suffix = a.suffix, g WHERE level = 0),
w AS (SELECT host, (k + 0.5) / 4000 < 0.5 AS low, exp((2 * mean * size - 1) * ln(sin((k + 0.5) / 4000 * pi() / 2) / sqrt(mean)) + (2 * (1 - mean) * size - 1) * ln(cos((k + 0.5) / 4000 * pi() / 2) / sqrt(1 - mean))) AS y FROM h2, range(4000) t(k) WHERE mean > 0 AND mean < 1),
f AS (SELECT host FROM w GROUP BY host HAVING sum(y) FILTER (low) < 0.05 * sum(y) UNION ALL SELECT host FROM h2 WHERE mean >= 1),
v AS (SELECT u.*, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN host IN (SELECT host FROM f) THEN 'block' ELSE 'allow' END AS verdict FROM v
"""
