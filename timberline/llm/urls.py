"""URL rules and empirical-Bayes host reputation, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import checked_broadcast, stage
from timberline.llm.quality import LOWER, UPPER

#: (verdict, host, path prefix); the query's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Fixed: suffixes of two names below which sites are registered by different owners. A short list of
#: well-known ones, not the whole public one; give ``suffixes`` for more.
SUFFIXES = (
    "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp",
    "co.kr", "or.kr", "co.in", "org.in", "com.br", "org.br", "com.mx", "com.ar", "com.cn", "org.cn", "com.tw", "com.hk", "com.sg",
    "com.tr", "co.za", "org.za", "co.il", "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "tumblr.com",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to a slash, question mark or hash sign, A-Z lowered; and the
    path after it up to a question mark or hash sign. Both empty for null or without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)


def longest_rule(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equal rules a block wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> dict[str, Column]:
    """The host, its registered domain and its suffix, without user, port and a dot at the end.

    The suffix is one of ``suffixes`` (two names each) or the last name; the registered domain has one
    name more. A numeric address is a domain and a suffix of its own.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), ":[0-9]*\\z", ""), "\\.\\z", "")
    address = bare.rlike("\\A[0-9.]+\\z") | bare.contains(":") | bare.contains("[")
    two = F.substring_index(bare, ".", -2)
    public = two.isin(*suffixes) if suffixes else F.lit(False)
    return {
        "host": host,
        "domain": F.when(address, bare).when(public, F.substring_index(bare, ".", -3)).otherwise(two),
        "suffix": F.when(address, bare).when(public, two).otherwise(F.substring_index(bare, ".", -1)),
    }


def _shrunk(groups: DataFrame) -> DataFrame:
    """``groups`` (n, bad, above) with ``mean``, shrunk to ``above``, and the strength ``k`` of the prior.

    The strength is fitted by moments: how far the groups' shares lie from ``above`` beyond chance. It is
    between 2 (a page or two weigh) and 1000 (groups hardly differ); without labelled pages it is 2.
    """
    chance = F.col("above") * (1 - F.col("above"))
    sums = groups.where("n > 0").agg(
        F.sum("n").alias("pages"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("above"), 2)).alias("v"),
        F.sum(chance).alias("c"),
        F.sum(F.col("n") * chance).alias("nc"),
    )
    between = F.greatest((F.col("v") - F.col("c")) / F.col("pages"), F.lit(1e-6))
    k = F.least(F.greatest(F.col("nc") / F.col("pages") / between - 1, F.lit(2.0)), F.lit(1000.0))
    fitted = groups.crossJoin(F.broadcast(sums.select(F.coalesce(k, F.lit(2.0)).alias("k"))))  # one row
    return fitted.withColumn("mean", (F.col("bad") + F.col("k") * F.col("above")) / (F.col("n") + F.col("k")))


def host_reputation(outcomes: DataFrame, z: float = 1.0, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, bad, overall, mean, lower): the posterior of each host's share of bad pages.

    ``outcomes``: host and labelled (long: 1 if the page's outcome is known), bad (long). Shares are
    shrunk from all pages (``overall``) to the suffix, from there to the registered domain, and from
    there to the host, each time by a beta prior whose mean is the level above and whose strength is
    fitted to that level. ``lower`` is ``z`` deviations below the posterior mean. Equal rows count
    each, equal shares need no order; a null host is a host of its own, with itself as domain and suffix;
    an empty table gives no rows.
    """
    own = outcomes.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad"))
    names = {k: F.coalesce(c, F.lit("")) for k, c in levels(F.col("host"), suffixes).items() if k != "host"}
    own = stage(own.withColumns(names), "hosts")
    counted = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    share = (F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)
    total = own.agg(share.alias("above"))
    suffix = own.groupBy("suffix").agg(*counted).crossJoin(F.broadcast(total))  # one row
    suffix = stage(_shrunk(suffix).select("suffix", F.col("above").alias("overall"), F.col("mean").alias("above")), "suffixes")
    domain = own.groupBy("domain", "suffix").agg(*counted).join(checked_broadcast(suffix), "suffix")
    domain = stage(_shrunk(domain).select("domain", "suffix", "overall", F.col("mean").alias("above")), "domains")
    host = _shrunk(own.join(checked_broadcast(domain), ["domain", "suffix"]))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("k") + 1))
    return host.select("host", "n", "bad", "overall", "mean", (F.col("mean") - z * deviation).alias("lower"))


def url_filter(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    times: float = 1.5,
    z: float = 1.0,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """A row per page: host, path, the rule that decides, the verdict, and the host's reputation
    (host_labelled, bad_mean, bad_lower, to six places).

    Where no rule fits, the host's reputation does: it is blocked if the lower bound of its share of
    bad pages exceeds ``times`` the share among all pages. A page's outcome is that of the labelled document whose number its
    path names first (bad: low quality or toxic); pages without one count for nothing. A null url
    has an empty host; hosts without labelled pages stand on their domain, suffix or all pages.
    Equal rows count each; an empty table gives no rows; labels that contradict are bad.
    """
    url = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    seen = url.select("page_id", host.alias("host"), path.alias("path"))
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
        .groupBy("doc").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    )
    number = F.regexp_extract("path", "/([0-9]{1,18})", 1)
    named = seen.select("host", F.when(number != "", number.cast("long")).alias("doc"))
    # Pages are counted by host and document before they meet the labels.
    counted = named.groupBy("host", "doc").agg(F.count(F.lit(1)).alias("pages")).join(known, "doc", "left")
    outcomes = counted.select(
        "host",
        F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0).alias("labelled"),
        F.coalesce(F.col("bad") * F.col("pages"), F.lit(0)).alias("bad"),
    )
    reputation = host_reputation(outcomes, z, suffixes).select(
        F.col("host").alias("of"), (F.col("lower") > times * F.col("overall")).alias("poor"),
        F.col("n").alias("host_labelled"), F.round("mean", 6).alias("bad_mean"), F.round("lower", 6).alias("bad_lower"),
    )
    verdicts = stage(reputation, "verdicts")
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    joined = seen.join(checked_broadcast(verdicts), F.col("host") == F.col("of"), "left")
    return joined.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("poor"), "block").otherwise("allow")).alias("verdict"),
        "host_labelled", "bad_mean", "bad_lower",
    )


FILTER_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM u
),
r AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                        ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(kind, name, prefix)
),
fit AS (
  SELECT page_id, arg_max(name || prefix, length(name || prefix)) AS rule, arg_max(kind, length(name || prefix)) AS kind
  FROM p JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix) GROUP BY page_id
),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
),
o AS (
  SELECT host, CASE WHEN l.bad IS NULL THEN 0 ELSE 1 END AS labelled, coalesce(l.bad, 0) AS bad
  FROM p LEFT JOIN l ON try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})', 1), '') AS BIGINT) = l.doc_id
),
b AS (
  SELECT host, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\z', ''), '\.\z', '') AS bare,
         CAST(sum(labelled) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad
  FROM o GROUP BY host
),
c AS (
  SELECT host, bare, n, bad, regexp_matches(bare, '\A[0-9.]+\z') OR contains(bare, ':') OR contains(bare, '[') AS address,
         regexp_extract(bare, '([^.]*\.)?[^.]*\z') AS two, list_contains([SUFFIXES], regexp_extract(bare, '([^.]*\.)?[^.]*\z')) AS public
  FROM b
),
h AS (
  SELECT host, n, bad, CASE WHEN address THEN bare WHEN public THEN regexp_extract(bare, '([^.]*\.)?([^.]*\.)?[^.]*\z') ELSE two END AS domain,
         CASE WHEN address THEN bare WHEN public THEN two ELSE regexp_extract(bare, '[^.]*\z') END AS suffix
  FROM c
),
t AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS overall FROM h),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(overall) AS above FROM h, t GROUP BY suffix),
s1 AS (SELECT suffix, (bad + k * above) / (n + k) AS mean FROM s0, (SELECT FITTED AS k FROM s0 WHERE n > 0)),
d0 AS (SELECT domain, h.suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(mean) AS above FROM h JOIN s1 ON h.suffix = s1.suffix GROUP BY domain, h.suffix),
d1 AS (SELECT domain, suffix, (bad + k * above) / (n + k) AS mean FROM d0, (SELECT FITTED AS k FROM d0 WHERE n > 0)),
h0 AS (SELECT host, n::DOUBLE AS n, bad::DOUBLE AS bad, mean AS above FROM h JOIN d1 ON h.domain = d1.domain AND h.suffix = d1.suffix),
h1 AS (SELECT host, n, k, (bad + k * above) / (n + k) AS mean FROM h0, (SELECT FITTED AS k FROM h0 WHERE n > 0)),
v AS (
  SELECT host, CAST(n AS BIGINT) AS host_labelled, mean, mean - 1.0 * sqrt(mean * (1 - mean) / (n + k + 1)) AS lower, overall FROM h1, t
)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.kind, CASE WHEN lower > 1.5 * overall THEN 'block' ELSE 'allow' END) AS verdict,
       host_labelled, round(mean, 6) AS bad_mean, round(lower, 6) AS bad_lower
FROM p LEFT JOIN fit ON p.page_id = fit.page_id LEFT JOIN v ON p.host = v.host
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in SUFFIXES)).replace(
    "FITTED",
    "coalesce(least(greatest(sum(n * above * (1 - above)) / sum(n) / "
    "greatest((sum(n * pow(bad / n - above, 2)) - sum(above * (1 - above))) / sum(n), 1e-6::DOUBLE) - 1, 2.0::DOUBLE), 1000.0::DOUBLE), 2.0::DOUBLE)",
)
