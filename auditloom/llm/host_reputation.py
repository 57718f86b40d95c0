"""URL filters: rules first, then an empirical-Bayes reputation of the host. DataFrame functions only.

Labelled page outcomes (bad or not) are counted for each host, registered domain and suffix. The
share of bad pages is shrunk level by level with beta-binomial priors: a suffix towards the mean of
all suffixes, a domain towards its suffix, a host towards its domain. The strength of each prior is
estimated from the spread of the level's shares around those of its parents (method of moments);
where no spread is seen it is the number of units that show none, and of a single unit it is the least.
The variance of a host's share is that of its own posterior and, as far as its prior weighs, that
of its domain's, its suffix's and the whole's. A page is blocked where the lower posterior bound of its
host's share of bad ones is above a limit, and only there. With ``evidenced`` rules teach only
suffixes that they both block and allow, and the bound is null (no verdict against a page) below a
suffix without a labelled page.

The production queries have no page labels but the rules' own verdicts, so these are their outcomes.
The registered domain is the last two labels of the host, the suffix its last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm._common import stored

#: (verdict, host, path start)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: One-sided 95 % bound, the limit of it, and the range of a prior's strength in pages.
Z, LIMIT, LEAST_STRENGTH, MOST_STRENGTH = 1.645, 0.5, 1.0, 1000.0
#: Hosts with at least this share of the pages (so at most 1000 of them) are broadcast.
HOT_SHARE = 0.001

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as host and path start; of equal ones the blocking, then the first."""
    found = F.lit(None).cast("string")
    for _, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.lit(name + start)).otherwise(found)
    return found


def _rule_verdict(rule: Column, rules=RULES) -> Column:
    verdict = F.lit(None).cast("string")
    for kind, name, start in rules:
        verdict = F.when(rule == name + start, F.lit(kind)).otherwise(verdict)
    return verdict


def _strength(level: DataFrame) -> float:
    """The prior's strength from the spread of a level's shares around those of its parents (``prior``)."""
    row = level.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("prior")).alias("m"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("spread"), F.sum(F.col("prior") * (1 - F.col("prior"))).alias("noise"),
    ).first()
    if not row.n or row.k < 2 or row.n == row.nn / row.n:
        return LEAST_STRENGTH
    mean, variance = row.m / row.n, (row.spread - row.noise) / (row.n - row.nn / row.n)
    if variance <= 0:
        return min(MOST_STRENGTH, max(LEAST_STRENGTH, float(row.k)))
    return round(min(MOST_STRENGTH, max(LEAST_STRENGTH, mean * (1 - mean) / variance - 1)), 4)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"(?s)([^.]*)$", 1)


def taught_suffixes(rules=RULES) -> list[str]:
    """Suffixes that the rules both block and allow, so that their verdicts can tell good from bad."""
    by_kind = lambda kind: {name.rpartition(".")[2] for k, name, _ in rules if k == kind}
    return sorted(by_kind("block") & by_kind("allow"))


def host_reputations(pages: DataFrame, evidenced: bool = False) -> DataFrame:
    """(host, pages, n, mean, bound) from (host, bad): bad is 1, 0 or null where a page has no label."""
    hosts = stored(
        pages.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", F.regexp_extract("host", r"(?s)([^.]*\.[^.]*|^[^.]*)$", 1)).withColumn("suffix", suffix_of(F.col("host"))),
        "hosts",
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.where("n > 0").agg(F.count("*").alias("k"), F.coalesce(F.sum(F.col("bad") / F.col("n")), F.lit(0.0)).alias("shares")).first()
    prior = (whole.shares + 1) / (whole.k + 2)
    suffixes = suffixes.withColumns({"prior": F.lit(prior), "doubt": F.lit(prior * (1 - prior) / (whole.k + 3))})
    by_suffix = suffixes.select("suffix", *_posterior(_strength(suffixes), "prior", "doubt"), F.col("n").alias("known"))
    domains = domains.join(by_suffix, "suffix")
    by_domain = domains.select("domain", "known", *_posterior(_strength(domains), "prior", "doubt"))
    hosts = hosts.join(by_domain, "domain")
    mean, doubt = _posterior(_strength(hosts), "mean", "variance")
    rows = hosts.select("host", "pages", "n", "known", mean, doubt)
    bound = F.col("mean") - F.lit(Z) * F.sqrt("variance")
    return rows.select("host", "pages", "n", "mean", (F.when(F.col("known") > 0, bound) if evidenced else bound).alias("bound"))


def _posterior(strength: float, mean: str, variance: str) -> tuple[Column, Column]:
    """Mean and variance of a unit's share, from its counts and the prior and its doubt; a share varies at most as a coin does."""
    n, k = F.col("n"), F.lit(strength)
    share = (F.col("bad") + k * F.col("prior")) / (n + k)
    coin = F.greatest(share * (1 - share), F.lit(0.0))
    return share.alias(mean), F.least(coin, coin / (n + k + 1) + F.pow(k / (n + k), 2) * F.col("doubt")).alias(variance)


def judge_urls(pages: DataFrame, rules=RULES, limit: float = LIMIT, outcomes: DataFrame | None = None, evidenced: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_share, bad_bound) of every row of ``pages``.

    ``outcomes`` (page_id, bad 0/1, one row for each page) are labelled pages; without it the
    rules' verdicts serve. Of repeated page_ids in ``outcomes`` the worse counts. Host and path of a null url, or one without ``://``, are empty; such
    pages share one reputation. Without a rule the verdict is ``block`` just where ``bad_bound`` is above
    ``limit``. Repeated rows each get a row; a null page_id stays null and has no
    label; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if outcomes is None:
        labelled = rows.withColumn("bad", (_rule_verdict(F.col("rule"), rules) == "block").cast("int"))
        if evidenced:
            labelled = labelled.withColumn("bad", F.when(suffix_of(F.col("host")).isin(taught_suffixes(rules)), F.col("bad")))
    else:
        labelled = rows.join(outcomes.groupBy(F.col("page_id").cast("bigint").alias("page_id")).agg(F.max(F.col("bad").cast("int")).alias("bad")), "page_id", "left")
    reputation = stored(host_reputations(labelled.select("host", "bad"), evidenced), "reputations")
    count = reputation.agg(F.sum("pages").alias("n")).first().n or 0
    told, least = ("host", "mean", "bound"), max(1, int(count * HOT_SHARE))
    hot = F.broadcast(reputation.where(F.col("pages") >= least).select(F.col("host").alias("hot_host"), *(F.col(c).alias(f"hot_{c}") for c in told[1:])))
    cold = reputation.where(F.col("pages") < least).select(F.col("host").alias("cold_host"), *(F.col(c).alias(f"cold_{c}") for c in told[1:]))
    first = rows.join(hot, rows["host"] == hot["hot_host"], "left")
    # pages of hot hosts have their answer and are dealt out by a key of their own, so no host weighs on one task
    key = F.when(F.col("hot_host").isNull(), F.col("host")).otherwise(F.concat(F.lit("\0"), F.xxhash64("page_id", "path")))
    judged = first.withColumn("key", key).join(cold, F.col("key") == F.col("cold_host"), "left")
    mean, bound = (F.coalesce(f"hot_{c}", f"cold_{c}") for c in told[1:])
    verdict = F.coalesce(_rule_verdict(F.col("rule"), rules), F.when(bound > limit, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round(mean, 6).alias("bad_share"), F.round(bound, 6).alias("bad_bound"))


def _strength_sql(level: str, out: str) -> str:
    return f"""{out} AS (SELECT CASE WHEN k < 2 OR n = nn / n THEN {LEAST_STRENGTH} WHEN (spread - noise) / (n - nn / n) <= 0 THEN least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, k))
    ELSE round(least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, m / n * (1 - m / n) / ((spread - noise) / (n - nn / n)) - 1)), 4) END AS k
  FROM (SELECT count(*) AS k, coalesce(sum(n), 0) AS n, sum(n * n) AS nn, sum(n * prior) AS m, sum(n * pow(bad / n - prior, 2)) AS spread, sum(prior * (1 - prior)) AS noise FROM {level} WHERE n > 0))"""


def _posterior_sql(units: str, strength: str, out: str) -> str:
    """``out``: the rows of ``units`` (n, bad, prior, doubt) with share and variance."""
    return f"""{out} AS (SELECT *, least(share * (1 - share), share * (1 - share) / (n + k + 1) + pow(k / (n + k), 2) * doubt) AS variance FROM (SELECT u.*, k, (bad + k * prior) / (n + k) AS share FROM {units} u, {strength}))"""


def judgement_sql(evidenced: bool = False) -> str:
    """The production query in DuckDB SQL; of the suffixes the rules teach com alone where ``evidenced``."""
    taught = " AND (host = 'com' OR host LIKE '%.com')" if evidenced else ""
    bound = f"share - {Z} * sqrt(variance)"
    bound = f"CASE WHEN known > 0 THEN {bound} END" if evidenced else bound
    return f"""
WITH urls AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM urls),
judged AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule
  FROM ruled),
hosts AS (
  SELECT host, count(*) FILTER (by_rule IS NOT NULL{taught}) AS n, count(*) FILTER (by_rule = 'block'{taught}) AS bad,
         regexp_extract(host, '([^.]*\\.[^.]*|^[^.]*)$', 1) AS domain, regexp_extract(host, '([^.]*)$', 1) AS suffix
  FROM judged GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
whole AS (SELECT (sum(bad / n) + 1) / (count(*) + 2) AS prior, count(*) AS k FROM suffixes WHERE n > 0),
priors AS (SELECT coalesce(prior, 0.5) AS prior, k FROM whole),
at_suffix AS (SELECT s.*, prior, prior * (1 - prior) / (k + 3) AS doubt FROM suffixes s, priors),
{_strength_sql("at_suffix", "suffix_k")}, {_posterior_sql("at_suffix", "suffix_k", "by_suffix")},
at_domain AS (SELECT d.domain, d.n, d.bad, x.n AS known, x.share AS prior, x.variance AS doubt FROM domains d JOIN by_suffix x USING (suffix)),
{_strength_sql("at_domain", "domain_k")}, {_posterior_sql("at_domain", "domain_k", "by_domain")},
at_host AS (SELECT host, h.n, h.bad, known, d.share AS prior, d.variance AS doubt FROM hosts h JOIN by_domain d USING (domain)),
{_strength_sql("at_host", "host_k")}, {_posterior_sql("at_host", "host_k", "by_host")},
bounds AS (SELECT host, share AS mean, {bound} AS bound FROM by_host)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS bad_share, round(bound, 6) AS bad_bound
FROM judged JOIN bounds USING (host)
"""


ORACLE_SQL, EVIDENCED_SQL = judgement_sql(), judgement_sql(evidenced=True)
