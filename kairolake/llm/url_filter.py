"""URL filters: written rules first, then the empirical-Bayes reputation of the host, with DataFrame functions only.

A rule names a host and the start of a path; it fits the host and all its subdomains, and the longest rule wins. Rules
are looked up once a distinct host, by equality with the host's endings, never once a page.

Where no rule fits, the host's reputation decides. Outcomes of labelled pages (bad or not) are counted by host and
shrunk through beta-binomial priors along host, registered domain and suffix: each level's posterior mean is the prior
mean of the level below, and how strong a prior is follows from how much the level's rates differ (method of moments).
A host is blocked when the lower bound of its posterior share of bad pages reaches the threshold, so that a few bad
pages don't block a host and hosts without labels take over what is known about their domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_heavy_apart, materialize, table

#: (host, start of the path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Share of bad pages that a host's lower bound must reach to be blocked, and the bound's distance in deviations (95 %, one side).
THRESHOLD, DEVIATIONS = 0.5, 1.645
#: Bounds of the correlation inside a level's groups: prior strengths from 999 down to 1/19 pages.
LEAST_RHO, MOST_RHO = 0.001, 0.95
#: Names in front of a country's letters that belong to the suffix (``co.uk``).
SECOND_LEVEL = "ac|co|com|edu|gov|net|org"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """A short list of rules as a table."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(r, ("rule_host", "rule_path", "rule_verdict"), strict=True)]) for r in rules])))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.position(F.lit("://"), text)
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain of a host: the last name (two of them before a country's letters, as in
    ``co.uk``), and one name more. User names and ports don't count; an address of digits is its own domain."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    suffix = F.regexp_extract(name, rf"(?:^|\.)((?:(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]*)\.?)$", 1)
    domain = F.regexp_extract(name, rf"(?:^|\.)((?:[^.]+\.)?(?:(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]*)\.?)$", 1)
    address = name.rlike(r"^[0-9.]+$|^\[")
    return F.when(address, name).otherwise(suffix), F.when(address, name).otherwise(domain)


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, n, rules): the rules whose host a host equals or ends with, the longest first; equally long ones: the
    longer host, then ``block``. ``hosts`` has one row a host."""
    verdict = F.col("rule_verdict")
    each = rules.select("rule_host", F.struct((-F.char_length(F.concat("rule_host", "rule_path"))).alias("o1"), (-F.char_length("rule_host")).alias("o2"), (verdict != "block").cast("int").alias("o3"), F.col("rule_path").alias("path"), F.concat("rule_host", "rule_path").alias("rule"), verdict.alias("verdict")).alias("r"))
    listed = each.groupBy("rule_host").agg(F.collect_set("r").alias("listed"))  # as many as somebody wrote for that host
    names = F.split("host", r"\.")
    endings = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))).alias("rule_host"))
    holders = endings.groupBy("rule_host").agg(F.count(F.lit(1)).alias("holders"))
    keyed = materialize(listed.join(holders, "rule_host"), "rules")
    found = join_heavy_apart(endings, keyed, "rule_host", "holders", hosts.count())
    fit = found.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("listed"))).alias("rules"))
    return hosts.join(fit, "host", "left")


def ruled_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with host, path) with ``rule`` and ``rule_verdict`` of the longest rule that fits, else null."""
    hosts = materialize(rules_by_host(pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")), rules), "hosts")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    matched = join_heavy_apart(pages, hosts, "host", "n", pages.count())
    return matched.withColumn("first", first).select(*pages.columns, F.col("first.rule").alias("rule"), F.col("first.verdict").alias("rule_verdict"))


def _digamma(x: Column) -> Column:
    y = x + 6
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - sum(1 / (x + i) for i in range(6))


def _trigamma(x: Column) -> Column:
    y = x + 6
    return 1 / y + 1 / (2 * y**2) + 1 / (6 * y**3) - 1 / (30 * y**5) + 1 / (42 * y**7) + sum(1 / (x + i) ** 2 for i in range(6))


def posterior_bound(bad: Column, good: Column, deviations: float) -> Column:
    """A bound of a share with the posterior Beta(bad, good), so many deviations above its mean (below, if
    negative), taken on the log odds, whose mean and variance are exact."""
    odds = _digamma(bad) - _digamma(good) + deviations * F.sqrt(_trigamma(bad) + _trigamma(good))
    return 1 / (1 + F.exp(-odds))


def prior_strength(spread: float, groups: int, rows: int) -> float:
    """Pages that a level's prior is worth, from the sum over its groups of n (rate - mean)^2 / (mean (1 - mean)):
    its mean is 1 + (n - 1) rho for each group, and the strength 1 / rho - 1."""
    rho = (spread - groups) / (rows - groups) if rows > groups else MOST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def host_reputation(hosts: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, bad, labelled, prior, strength, share, low, high) of each host in ``hosts`` (host, bad, labelled: its
    bad pages and all its labelled ones, both 0 without labels): prior mean and strength from its domain, posterior
    mean and bounds of the share of bad pages.

    Without any label all hosts have mean 1/2 and wide bounds. Nulls count as 0; hosts must be distinct; an empty
    table gives no rows. Counts are summed level by level before anything is joined, and the joins are on keys of
    which each holds one row."""
    suffix, domain = suffix_and_domain(F.col("host"))
    counts = hosts.select("host", F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("labelled", F.lit(0)).alias("labelled"), domain.alias("domain"), suffix.alias("suffix"))
    counts = materialize(counts, "outcomes")
    sums = [F.sum(c).alias(c) for c in ("bad", "labelled")]
    domains = materialize(counts.groupBy("domain").agg(*sums, F.min("suffix").alias("suffix"), F.count(F.lit(1)).alias("holders")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(*sums, F.count(F.lit(1)).alias("holders")), "suffixes")
    bad, labelled = suffixes.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    level = suffixes.withColumn("prior", F.lit((bad + 1) / (labelled + 2)))
    for name, below in (("suffix", domains), ("domain", counts), ("host", None)):
        mean = F.col("prior")
        seen = level.where("labelled > 0").agg(F.sum((F.col("bad") - F.col("labelled") * mean) ** 2 / (F.col("labelled") * mean * (1 - mean))), F.count(F.lit(1)), F.sum("labelled")).first()
        strength = prior_strength(*(x or 0 for x in seen))
        a, b = F.col("bad") + strength * mean, F.col("labelled") - F.col("bad") + strength * (1 - mean)
        if below is None:
            return level.select("host", "bad", "labelled", "prior", F.lit(strength).alias("strength"), (a / (a + b)).alias("share"), posterior_bound(a, b, -deviations).alias("low"), posterior_bound(a, b, deviations).alias("high"))
        means = level.select(name, "holders", (a / (a + b)).alias("prior"))
        level = materialize(join_heavy_apart(below, means.withColumnRenamed("holders", "holders_"), name, "holders_", below.count()).drop("holders_"), f"{name}_means")


def judge_urls(pages: DataFrame, rules: DataFrame, outcomes: DataFrame | None = None, threshold: float = THRESHOLD, deviations: float = DEVIATIONS, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict, low) of every page.

    ``rules`` has rule_host, rule_path and rule_verdict (allow or block), ``outcomes`` url and bad (0 or 1) of
    labelled pages; without it the labelled pages are those that a rule decides, bad where it blocks. The verdict is
    the rule's; without one, block if ``low``, the lower bound of the host's share of bad pages, reaches
    ``threshold``, else allow. ``low`` is null where a rule decides.

    Null URLs and those without ``://`` have empty host and path, which are judged as any host. Very long URLs are
    read whole; pages that repeat a URL or an id, and pages without an id, have a row each. Ties between rules:
    ``rules_by_host``. An empty table gives no rows, other columns are ignored."""
    host, path = host_and_path(F.col(url))
    ruled = materialize(ruled_pages(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), rules), "ruled")
    open_, decided = ruled.where("rule is null"), ruled.where("rule is not null")
    if outcomes is None:
        labels = decided.select("host", (F.col("rule_verdict") == "block").cast("long").alias("bad"))
    else:
        labels = outcomes.select(host_and_path(F.col("url"))[0].alias("host"), F.col("bad").cast("long").alias("bad")).where("bad is not null")
    counted = labels.groupBy("host").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("labelled"))
    known = materialize(open_.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(counted, "host", "full"), "known")
    low = host_reputation(known.select("host", "bad", "labelled"), deviations).select("host", "low").join(known.where("n is not null").select("host", "n"), "host")
    judged = join_heavy_apart(open_, materialize(low, "reputation"), "host", "n", open_.count())
    by_host = judged.select("id", "host", "path", "rule", F.when(F.col("low") >= threshold, "block").otherwise("allow").alias("verdict"), "low")
    by_rule = decided.select("id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("low"))
    return by_rule.unionAll(by_host).withColumnRenamed("id", id_col)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under ``RULES``, whose verdicts are the labelled outcomes."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bare = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
    end = rf"(?:(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]*)\.?)$"
    psi = lambda x: f"(ln({x} + 6) - 1 / (2 * ({x} + 6)) - 1 / (12 * pow({x} + 6, 2)) + 1 / (120 * pow({x} + 6, 4)) - 1 / (252 * pow({x} + 6, 6)) - {' - '.join(f'1 / ({x} + {i})' for i in range(6))})"
    psi1 = lambda x: f"(1 / ({x} + 6) + 1 / (2 * pow({x} + 6, 2)) + 1 / (6 * pow({x} + 6, 3)) - 1 / (30 * pow({x} + 6, 5)) + 1 / (42 * pow({x} + 6, 7)) + {' + '.join(f'1 / pow({x} + {i}, 2)' for i in range(6))})"
    strength = lambda rows: f"""(select 1 / least(greatest(case when sum(n) > count(*) then (sum(pow(k - n * m, 2) / (n * m * (1 - m))) - count(*)) / (sum(n) - count(*)) else {MOST_RHO} end, {LEAST_RHO}), {MOST_RHO}) - 1 from {rows} where n > 0)"""
    return rf"""
        with r(rh, rp, rv) as (values {values}),
        u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{upper.lower()}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as row from u),
        f as (select row, arg_max(rh || rp, (length(rh || rp), length(rh), rv)) as rule, arg_max(rv, (length(rh || rp), length(rh), rv)) as verdict
              from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by row),
        j as (select p.*, f.rule, f.verdict from p left join f using (row)),
        c as (select host, count(*) filter (where verdict = 'block') as k, count(rule) as n from j group by host),
        d as (select *, case when bare ~ '^[0-9.]+$' or starts_with(bare, '[') then bare else regexp_extract(bare, '(?:^|\.)((?:[^.]+\.)?{end}', 1) end as domain,
                     case when bare ~ '^[0-9.]+$' or starts_with(bare, '[') then bare else regexp_extract(bare, '(?:^|\.)({end}', 1) end as suffix from (select *, {bare} as bare from c)),
        l1 as (select suffix, sum(k) as k, sum(n) as n, (sum(sum(k)) over () + 1) / (sum(sum(n)) over () + 2) as m from d group by suffix),
        m1 as (select suffix, (k + s * m) / (n + s) as m from l1, (select {strength("l1")} as s)),
        l2 as (select domain, suffix, k, n, m from (select domain, min(suffix) as suffix, sum(k) as k, sum(n) as n from d group by domain) join m1 using (suffix)),
        m2 as (select domain, (k + s * m) / (n + s) as m from l2, (select {strength("l2")} as s)),
        l3 as (select host, k, n, m from d join m2 using (domain)),
        ab as (select host, k + s * m as a, n - k + s * (1 - m) as b from l3, (select {strength("l3")} as s)),
        q as (select host, 1 / (1 + exp(-({psi("a")} - {psi("b")} - {DEVIATIONS} * sqrt({psi1("a")} + {psi1("b")})))) as low from ab)
        select page_id, j.host, path, rule, coalesce(verdict, case when low >= {THRESHOLD} then 'block' else 'allow' end) as verdict from j join q on j.host = q.host"""


SQL = {"op13_url_filter": _sql()}
