"""URL filter by empirical-Bayes host reputation (DataFrame operations only).

Labelled page outcomes are counted per host, summed per registered domain and
per suffix, and shrunk level by level: a suffix towards the corpus, a domain
towards its suffix, a host towards its domain.  Each level's prior is a beta
distribution whose mean is the parent's posterior mean and whose weight comes
from the moments of that level's rates.  A page without a rule is blocked when
the lower bound of its host's posterior bad rate passes a threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def split_url(url) -> tuple[F.Column, F.Column]:
    """(host, path): after the first `://`; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def two_label_suffixes(rows: DataFrame, column: str = "suffix", most: int = 20_000) -> tuple[str, ...]:
    """The suffixes of two labels that a table lists, for `two_label`; nulls and suffixes of other lengths are passed over.  A list over `most` is an error."""
    found = rows.select(F.lower(F.col(column)).alias("s")).where(F.size(F.split("s", r"\.")) == 2).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} suffixes")
    return tuple(sorted(r["s"] for r in found))


def suffix_of(host, two_label=TWO_LABEL_SUFFIXES) -> F.Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host, two_label=TWO_LABEL_SUFFIXES) -> F.Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(two)


def apply_rules(rows: DataFrame, rules=RULES) -> DataFrame:
    """Add `rule` and `rule_verdict`: the longest fitting rule (by host, then path); null where none fits."""
    rule = said = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, said = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    return rows.withColumn("rule", rule).withColumn("rule_verdict", said)


def _weight(df: DataFrame) -> DataFrame:
    """A beta prior's weight per parent by moments: m(1-m)/v - 1, held between 1 and 1000 (2 where v is 0 or unknown)."""
    m, v = F.col("pm"), F.col("v")
    return df.withColumn("w", F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(2.0))


def host_reputation(outcomes: DataFrame, z: float = 1.645, two_label=TWO_LABEL_SUFFIXES, others: DataFrame | None = None) -> DataFrame:
    """outcomes(host, bad 0/1) -> host, n, bad, mean, lower, upper of the posterior bad rate.

    others (host): hosts to judge as well; one without outcomes has n = 0 and the
    prior of its domain, of its suffix where the domain is new, or of the corpus
    where both are.  They change no prior; without any outcomes their bounds are 0 and 1.
    Rows with a null host or outcome are ignored.  Counts per host are
    aggregated before every shuffle, so a hot host costs a row per task.
    """
    hosts = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), two_label)).withColumn("suffix", suffix_of(F.col("host"), two_label))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"), F.var_pop(F.col("bad") / F.col("n")).alias("v"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"), F.var_pop(F.col("db") / F.col("dn")).alias("sv"))
    whole = suffixes.agg(F.sum("sn").alias("an"), F.sum("sb").alias("ab"), F.var_pop(F.col("sb") / F.col("sn")).alias("v"))
    s = _weight(suffixes.crossJoin(F.broadcast(whole)).withColumn("pm", (F.col("ab") + 0.5) / (F.col("an") + 1.0)))  # one row
    s = s.select("suffix", ((F.col("sb") + F.col("w") * F.col("pm")) / (F.col("sn") + F.col("w"))).alias("sm"), "sv")
    d = domains.withColumnRenamed("v", "dv").join(s, "suffix").withColumn("pm", F.col("sm")).withColumn("v", F.col("sv"))
    d = _weight(d).select("domain", ((F.col("db") + F.col("w") * F.col("pm")) / (F.col("dn") + F.col("w"))).alias("pm"), F.col("dv").alias("v"))
    h = hosts.select("host", "domain", "n", "bad").join(d, "domain")
    if others is not None:
        new = others.where("host is not null").select("host").distinct().join(hosts.select("host"), "host", "left_anti")
        new = new.withColumn("domain", domain_of(F.col("host"), two_label)).withColumn("suffix", suffix_of(F.col("host"), two_label))
        new = new.join(d.select("domain", F.struct("pm", "v").alias("of_domain")), "domain", "left").join(s.select("suffix", F.struct(F.col("sm").alias("pm"), F.col("sv").alias("v")).alias("of_suffix")), "suffix", "left")
        corpus = whole.select(F.struct(((F.col("ab") + 0.5) / (F.col("an") + 1.0)).alias("pm"), "v").alias("of_corpus"))
        new = new.crossJoin(F.broadcast(corpus)).withColumn("prior", F.coalesce("of_domain", "of_suffix", "of_corpus"))
        h = h.unionByName(new.select("host", "domain", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"), "prior.pm", "prior.v"))
    h = _weight(h)
    a, b = F.col("bad") + F.col("w") * F.col("pm"), F.col("n") - F.col("bad") + F.col("w") * (1 - F.col("pm"))
    h = h.withColumn("mean", a / (a + b)).withColumn("sd", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    return h.select("host", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - z * F.col("sd")).alias("lower"), F.least(F.lit(1.0), F.col("mean") + z * F.col("sd")).alias("upper"))


def judge_urls(pages: DataFrame, rules=RULES, outcomes: DataFrame | None = None, block_above: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url", two_label=TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_lower.

    outcomes (host, bad): labelled pages; where none are given, the pages that a
    rule judges are the labelled ones (block: bad).  A host without labelled
    pages is judged by the prior of its domain, suffix or corpus.  A null url has
    an empty host and path and no rule, and is allowed: it names no host.  Rows
    that repeat are judged each; other columns of `pages` are ignored.
    """
    host, path = split_url(F.col(url_col))
    rows = apply_rules(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")), rules)
    if outcomes is None:
        outcomes = rows.where("rule_verdict is not null").select("host", (F.col("rule_verdict") == "block").cast("int").alias("bad"))
    known = host_reputation(outcomes, z, two_label, rows.where("host <> ''")).select("host", F.col("lower").alias("bad_lower"))
    own = F.when(F.col("bad_lower") > block_above, "block").otherwise("allow")
    out = rows.join(known, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
), g AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM r
), h AS (
  SELECT host, count(*) AS n, sum(CASE WHEN said = 'block' THEN 1 ELSE 0 END) AS bad,
         CASE WHEN regexp_matches(host, '(^|\.)(ac\.uk|co\.jp|co\.nz|co\.uk|com\.au|com\.br|gov\.uk|org\.uk)$')
              THEN regexp_extract(host, '([^.]*\.)?[^.]*\.[^.]*$', 0) ELSE regexp_extract(host, '([^.]*\.)?[^.]*$', 0) END AS domain,
         CASE WHEN regexp_matches(host, '(^|\.)(ac\.uk|co\.jp|co\.nz|co\.uk|com\.au|com\.br|gov\.uk|org\.uk)$')
              THEN regexp_extract(host, '[^.]*\.[^.]*$', 0) ELSE regexp_extract(host, '[^.]*$', 0) END AS suffix
  FROM g WHERE said IS NOT NULL GROUP BY host
), d AS (
  SELECT suffix, domain, sum(n) AS dn, sum(bad) AS db, var_pop(bad / n::DOUBLE) AS dv FROM h GROUP BY ALL
), s AS (
  SELECT suffix, sum(dn) AS sn, sum(db) AS sb, var_pop(db / dn::DOUBLE) AS sv FROM d GROUP BY ALL
), a AS (
  SELECT (sum(sb) + 0.5) / (sum(sn) + 1.0) AS pm, var_pop(sb / sn::DOUBLE) AS v FROM s
), sm AS (
  SELECT suffix, sv, (sb + w * pm) / (sn + w) AS sm FROM (
    SELECT s.*, pm, CASE WHEN v > 0 THEN least(greatest(pm * (1 - pm) / v - 1, 1.0), 1000.0) ELSE 2.0 END AS w FROM s, a)
), dm AS (
  SELECT domain, dv, (db + w * sm) / (dn + w) AS pm FROM (
    SELECT d.*, sm, CASE WHEN sv > 0 THEN least(greatest(sm * (1 - sm) / sv - 1, 1.0), 1000.0) ELSE 2.0 END AS w FROM d JOIN sm USING (suffix))
), hm AS (
  SELECT host, bad + w * pm AS al, n - bad + w * (1 - pm) AS be FROM (
    SELECT h.*, pm, CASE WHEN dv > 0 THEN least(greatest(pm * (1 - pm) / dv - 1, 1.0), 1000.0) ELSE 2.0 END AS w FROM h JOIN dm USING (domain))
)
SELECT page_id, g.host, path, rule,
       coalesce(said, CASE WHEN al / (al + be) - 1.645 * sqrt(al * be / ((al + be) * (al + be) * (al + be + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM g LEFT JOIN hm ON g.host = hm.host
"""
