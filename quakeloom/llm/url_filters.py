"""URL filter: listed rules first, then empirical-Bayes host reputation, in DataFrame operations only.

Reputation shrinks labelled page outcomes down a tree: all pages, suffix, registered domain, host. A node's prior is
Beta(m * k, (1 - m) * k), with m the posterior mean of its parent and k the level's concentration, estimated by the
method of moments from the spread of the level's rates around their parents' means. A host is blocked when the lower
bound of its posterior for "bad" (mean less Z standard deviations) exceeds the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_heavy, materialize, table

#: The contract's rules: what they match, and the verdict. Fixed values.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

#: Posterior bound: mean less Z standard deviations against LIMIT; concentration kept within K_RANGE.
Z, LIMIT, K_RANGE = 1.645, 0.35, (2.0, 1000.0)

#: Suffixes of two labels, below which domains are registered; every other suffix is the last label. Fixed values.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")


def host_of(url: str) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    return F.when(suffix.contains("."), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _posterior(nodes: DataFrame) -> DataFrame:
    """nodes (n labelled pages, bad of them, prior mean m) with the level's k and the posterior mean."""
    # method of moments: E[(rate - m)^2] = m (1 - m) (1 / n + (1 - 1 / n) / (k + 1)), summed over nodes with weight n
    seen = F.col("n") > 0
    spread = F.sum(F.when(seen, (F.col("bad") - F.col("n") * F.col("m")) * (F.col("bad") - F.col("n") * F.col("m")) / F.col("n")))
    base = F.sum(F.when(seen, F.col("m") * (1 - F.col("m"))))
    more = F.sum(F.when(seen, F.col("m") * (1 - F.col("m")) * (F.col("n") - 1)))
    level = nodes.agg(spread.alias("s"), base.alias("b"), more.alias("c"))
    k = F.expr(f"CASE WHEN s IS NULL OR s <= b THEN {K_RANGE[1]}D ELSE least({K_RANGE[1]}D, greatest({K_RANGE[0]}D, c / (s - b) - 1)) END")
    return nodes.crossJoin(F.broadcast(level.select(k.alias("k")))).withColumn("mean", F.expr("(m * k + bad) / (k + n)"))


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, bound): the posterior's lower bound of the share of bad pages; hosts: host, n (labelled pages), bad (of them)."""
    suffix = suffix_of(F.col("host"))
    hosts = hosts.select("host", "n", "bad", suffix.alias("suffix")).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("m"))
    suffixes = _posterior(suffixes.crossJoin(F.broadcast(whole)))
    domains = _posterior(domains.join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix"))
    hosts = _posterior(hosts.join(domains.select("domain", "suffix", F.col("mean").alias("m")), ["domain", "suffix"]))
    return hosts.withColumn("bound", F.expr(f"mean - {Z}D * sqrt(mean * (1 - mean) / (k + n + 1))")).select("host", "bound")


def judge(pages: DataFrame, rules: tuple = RULES, limit: float = LIMIT) -> DataFrame:
    """One row per page: page_id, host, path, rule (null where none fits), verdict (allow or block).

    pages: page_id, url, bad (1, 0, or null where the page has no label). Host and path are empty where the url is
    null or has no "://"; pages without a host share one reputation, that of the empty host. Without labels every
    page that no rule fits is judged by the prior alone, one half less the bound. Repeated rows are judged alike.
    """
    parts = materialize(pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), "bad"), "urls")
    hosts = parts.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("pages"))
    hosts = materialize(hosts, "hosts")
    bounds = materialize(reputation(hosts).join(hosts.select("host", "pages"), "host"), "reputation")
    rule, verdict = rule_of(rules)
    judged = join_heavy(parts.drop("bad"), bounds, "host", "pages")
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages with bad: 1 where the document that the page shows (its number is the first in the path) is labelled
    toxic or of quality 0, 0 where it is labelled otherwise, else null."""
    number = F.expr("try_cast(regexp_extract(coalesce(url, ''), '://[^/]*/[^/]*/([0-9]+)', 1) AS BIGINT)")
    bad = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("if(toxic = 1 OR quality = 0, 1, 0)")).alias("bad"))
    return pages.select("page_id", "url", number.alias("doc_id")).join(bad, "doc_id", "left").select("page_id", "url", "bad")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(outcomes(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")))


def _sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{t.partition('/')[0]}' OR suffix(host, '.{t.partition('/')[0]}')) AND prefix(path, '/{t.partition('/')[2]}') THEN '{t}'" for t, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    )
    says = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in RULES)

    def post(nodes: str) -> str:
        return f"""SELECT *, (m * k + bad) / (k + n) AS mean FROM {nodes}, (SELECT CASE WHEN s IS NULL OR s <= b THEN {K_RANGE[1]}
            ELSE least({K_RANGE[1]}, greatest({K_RANGE[0]}, c / (s - b) - 1)) END AS k FROM (SELECT
            sum((bad - n * m) * (bad - n * m) / n) FILTER (n > 0) AS s, sum(m * (1 - m)) FILTER (n > 0) AS b,
            sum(m * (1 - m) * (n - 1)) FILTER (n > 0) AS c FROM {nodes}))"""

    two = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
    return f"""WITH marks AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, marks.bad
        FROM pages LEFT JOIN marks ON doc_id = try_cast(regexp_extract(coalesce(url, ''), '://[^/]*/[^/]*/([0-9]+)', 1) AS BIGINT)),
    h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, CASE WHEN {two} IN {TWO_LABEL_SUFFIXES} THEN {two} ELSE string_split(host, '.')[-1] END AS suffix FROM parts GROUP BY host),
    h1 AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), CASE WHEN contains(suffix, '.') THEN -3 ELSE -2 END, -1), '.') AS domain FROM h0),
    d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h1 GROUP BY domain, suffix),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY suffix),
    s1 AS (SELECT s0.*, m FROM s0, (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS m FROM s0)), s2 AS ({post('s1')}),
    d1 AS (SELECT d0.*, s2.mean AS m FROM d0 JOIN s2 USING (suffix)), d2 AS ({post('d1')}),
    h2 AS (SELECT h1.*, d2.mean AS m FROM h1 JOIN d2 USING (domain, suffix)), h3 AS ({post('h2')}),
    judged AS (SELECT page_id, host, path, CASE {fits} END AS rule, mean - {Z} * sqrt(mean * (1 - mean) / (k + n + 1)) AS bound FROM parts JOIN h3 USING (host))
    SELECT page_id, host, path, rule, CASE rule {says} ELSE CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END END AS verdict FROM judged"""


QUERIES = {"op3_url_filters": op3_url_filters}
ORACLE_SQL = {"op3_url_filters": _sql()}
