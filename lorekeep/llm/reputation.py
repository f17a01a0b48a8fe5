"""URL filter: rules first, then the reputation of the host by hierarchical empirical Bayes.

Outcomes of labelled pages are counted for each host. A host's rate of bad pages has a beta prior whose mean is the rate of
its registered domain without the host itself, which is drawn in turn towards its suffix and that towards all pages; how
strongly is fitted for each level from the spread of the rates (beta-binomial moments). A host is blocked if its posterior
rate less SPREAD standard deviations is still THRESHOLD or more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import materialize, read, small

#: (verdict, host, path); a rule fits its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: By Cantelli's inequality at least SPREAD² / (1 + SPREAD²) of any posterior lies above the bound: four fifths for 2.
THRESHOLD, SPREAD = 0.5, 2.0
#: Labels of a host name that count as a bad outcome of each of its pages (seeds set by hand).
SEEDS = ("adult", "ads", "bets", "casino", "pills", "spam")
#: Suffixes of two labels under which names are registered; any other suffix is the last label.
SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "or.jp", "org.au", "org.uk")
#: Strength of a prior, in pages: the fit is held between these.
WEAKEST, STRONGEST = 1.0, 1_000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What is between the first :// and / ? # or the end, A-Z lower-cased, and what follows up to ? # or the end."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (host and path together, then host) that fits, as a struct (size, host_size, rule, verdict), or null."""
    if not rules:
        return F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    fits = []
    for verdict, h, p in rules:
        own = F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), own))
    return F.array_max(F.array_compact(F.array(*fits)))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host without user and port; a numeric address is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(name, r"\.", -1)
    two = F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), F.lit(2)), ".")
    n = F.when(two.isin(*suffixes), 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(labels, -F.least(F.size(labels), k), k), ".")
    number = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    return F.when(number, "").otherwise(last(n)), F.when(number, name).otherwise(last(n + 1))


def _strength(nodes: DataFrame) -> float:
    """Of nodes(k, n, prior): how many pages a prior of this level is worth."""
    spread = F.col("prior") * (1 - F.col("prior"))
    off = F.col("k") / F.col("n") - F.col("prior")
    sums = nodes.where("n > 0").agg(F.sum(F.col("n") * off * off - spread).alias("over"), F.sum((F.col("n") - 1) * spread).alias("of")).first()
    if not sums.of or sums.of <= 0:
        return STRONGEST
    alike = max(sums.over / sums.of, 1e-12)
    return min(max(1 / alike - 1, WEAKEST), STRONGEST)


def reputations(outcomes: DataFrame, spread: float = SPREAD) -> DataFrame:
    """(host, k, n, rate, bound) of every host of outcomes(host, suffix, domain, bad): bad pages and labelled pages, the
    posterior rate, and that less `spread` standard deviations. bad is 1, 0 or, for pages without label, null."""
    hosts = materialize(outcomes.groupBy("suffix", "domain", "host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"), F.count("bad").alias("n")), "hosts")
    total = hosts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    rate = lambda up, own: (F.col(f"{up}_w") * F.col(f"{up}_prior") + F.col(f"{up}_k") - F.col(own[0])) / (F.col(f"{up}_w") + F.col(f"{up}_n") - F.col(own[1]))
    levels = hosts.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    levels = levels.withColumn("prior", (F.lit(total.k) - F.col("k") + 0.5) / (F.lit(total.n) - F.col("n") + 1.0))
    for key, below in (("suffix", "domain"), ("domain", "host")):
        known = [c for c in ("suffix", "domain", "host") if c in levels.columns]
        levels = materialize(levels, f"reputation-{key}")
        up = levels.select(*known, F.col("k").alias("up_k"), F.col("n").alias("up_n"), F.col("prior").alias("up_prior"), F.lit(_strength(levels)).alias("up_w"))
        nodes = hosts.groupBy(*known, below).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
        levels = nodes.join(small(up), known).withColumn("prior", rate("up", ("k", "n"))).select(*known, below, "k", "n", "prior")
    levels = materialize(levels, "reputation-host")
    w = _strength(levels)
    a, b = w * F.col("prior") + F.col("k"), w * (1 - F.col("prior")) + F.col("n") - F.col("k")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return levels.select("host", "k", "n", (a / (a + b)).alias("rate"), (a / (a + b) - spread * deviation).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS, threshold: float = THRESHOLD, spread: float = SPREAD) -> DataFrame:
    """page_id, host, path, rule, verdict, host_labelled, host_bad of every row of pages(page_id, url).

    The verdict is that of the longest rule that fits (of equally long ones that with the longer host, then the greater
    text), else block if the lower bound of the host's rate of bad pages is threshold or more, else allow. A page is
    labelled by labels(doc_id, quality, toxic) with its id, bad if any such row has quality 0 or toxic 1 (rows that are
    null in both say nothing), and by seeds: a page whose host has one of them between dots and hyphens is bad.

    A null url or one without :// has an empty host and path, no outcome and no evidence: allow. Rows repeated in pages
    are outcomes each; a null page_id has no label. Hosts without labelled pages have the rate of their domain. With no
    labels at all nothing is blocked but by rule. An empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    suffix, domain = domain_of(F.col("host"))
    seeded = F.exists(F.split("host", r"[.\-]", -1), lambda x: x.isin(*seeds)) if seeds else F.lit(False)
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad).alias("_bad")).where("_bad IS NOT NULL AND page_id IS NOT NULL")
    named = rows.where("host <> ''").select("page_id", "host")
    outcomes = named.join(known, "page_id", "left").select("host", suffix.alias("suffix"), domain.alias("domain"), F.when(seeded, 1).otherwise(F.col("_bad")).alias("bad"))
    standing = materialize(reputations(outcomes, spread).select("host", F.col("n").alias("host_labelled"), F.col("k").alias("host_bad"), (F.col("bound") >= threshold).alias("_low")), "reputations")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.join(small(standing), "host", "left").withColumn("_rule", rule)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.coalesce("_low", F.lit(False)), "block").otherwise("allow"))
    zero = F.lit(0).cast("long")
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("host_labelled", zero).alias("host_labelled"), F.coalesce("host_bad", zero).alias("host_bad"))


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def _fit(level: str) -> str:
    return (
        f"(SELECT CASE WHEN coalesce(sum((n - 1) * prior * (1 - prior)), 0) <= 0 THEN {STRONGEST} ELSE least(greatest(1 / greatest(sum(n * (k / n - prior) ** 2 - prior * (1 - prior))"
        f" / sum((n - 1) * prior * (1 - prior)), 1e-12) - 1, {WEAKEST}), {STRONGEST}) END FROM {level} WHERE n > 0)"
    )


_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)
_SEEDS = ", ".join(f"'{s}'" for s in SEEDS)
_FITS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
URLS = rf"""WITH u AS (SELECT row_number() OVER () AS i, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
m AS (SELECT u.*, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM u WHERE host <> ''),
s AS (SELECT m.*, string_split(name, '.') AS w, regexp_full_match(name, '[0-9]+(\.[0-9]+){{3}}') AS ip FROM m),
t AS (SELECT s.*, CASE WHEN array_to_string(w[-2:], '.') IN ({_SUFFIXES}) THEN 2 ELSE 1 END AS c FROM s),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY 1),
o AS (SELECT t.host, CASE WHEN ip THEN '' ELSE array_to_string(w[-c:], '.') END AS suffix, CASE WHEN ip THEN name ELSE array_to_string(w[-c - 1:], '.') END AS domain,
  CASE WHEN len(list_filter(string_split_regex(host, '[.\-]'), lambda x: x IN ({_SEEDS}))) > 0 THEN 1 ELSE bad END AS bad FROM t LEFT JOIN l ON doc_id = page_id),
h AS (SELECT suffix, domain, host, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k, CAST(count(bad) AS DOUBLE) AS n FROM o GROUP BY ALL),
g AS (SELECT coalesce(sum(k), 0) AS k, coalesce(sum(n), 0) AS n FROM h),
a AS (SELECT suffix, k, n, ((SELECT k FROM g) - k + 0.5) / ((SELECT n FROM g) - n + 1) AS prior FROM (SELECT suffix, sum(k) AS k, sum(n) AS n FROM h GROUP BY 1)),
aw AS (SELECT {_fit("a")} AS w),
b AS (SELECT x.suffix, domain, x.k, x.n, (w * a.prior + a.k - x.k) / (w + a.n - x.n) AS prior FROM (SELECT suffix, domain, sum(k) AS k, sum(n) AS n FROM h GROUP BY ALL) x JOIN a USING (suffix), aw),
bw AS (SELECT {_fit("b")} AS w),
c AS (SELECT h.host, h.k, h.n, (w * b.prior + b.k - h.k) / (w + b.n - h.n) AS prior FROM h JOIN b USING (suffix, domain), bw),
e AS (SELECT host, k, n, w * prior + k AS p, w * (1 - prior) + n - k AS q FROM c, (SELECT {_fit("c")} AS w)),
z AS (SELECT host, k, n, p / (p + q) - {SPREAD} * sqrt(p * q / ((p + q) ** 2 * (p + q + 1))) >= {THRESHOLD} AS low FROM e),
r AS (SELECT i, max({{'s': length(rh || rp), 'h': length(rh), 'rule': rh || rp, 'verdict': rv}}) AS r FROM u, (VALUES {_FITS}) v(rv, rh, rp)
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT page_id, u.host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN low THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(n, 0) AS BIGINT) AS host_labelled, CAST(coalesce(k, 0) AS BIGINT) AS host_bad FROM u LEFT JOIN r USING (i) LEFT JOIN z ON z.host = u.host"""
