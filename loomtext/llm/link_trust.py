"""URL filters from rules and from the link graph between hosts, natively.

Pages are judged by the longest rule that fits. The others are judged by their host: pages that rules
allow or block are the seeds of two personalised PageRanks over the links between hosts. Trust flows along links
from allowed seeds, distrust flows against them from blocked seeds, since who links to bad hosts is suspect.
Both are in units of seed pages, so that they compare; a host is blocked when its distrust makes up more than a
share of both.

A round is one join of the ranks with the links, an aggregate that combines before its shuffle, and a table
in the shared folder. Links are counted per pair of hosts first, so a host with most pages is one node
with at most as many edges as there are hosts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

DAMPING = 0.85
ROUNDS = 20
SHARE = 0.5
#: rules up to this many are constants of the plan; more are joined
FEW_RULES = 256
#: fixed values: how pages name other hosts
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def with_rule(pages: DataFrame, rules: list[Rule], few: int = FEW_RULES) -> DataFrame:
    """``pages`` (with host and path) and the longest rule that fits, as struct ``fit`` (rule, verdict) or null.

    Of rules with the same host and path the last one given counts.
    """
    latest = {h + p: (h, p, v) for v, h, p in rules}
    if len(latest) > few:
        return _with_rule_joined(pages, latest)
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, (h, p, v) in sorted(latest.items(), key=lambda r: (len(r[0]), r[0])):  # later ones come before
        fit = F.when(_fits(F.col("host"), F.col("path"), h, p), F.struct(F.lit(name).alias("rule"), F.lit(v).alias("verdict"))).otherwise(fit)
    return pages.withColumn("fit", fit)


def _with_rule_joined(pages: DataFrame, latest: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Long rule lists: each distinct (host, path) looks up its host's suffixes with its path's prefixes."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(h, p, n, v) for n, (h, p, v) in latest.items()], "rh string, rp string, rule string, verdict string")
    lengths = sorted({len(p) for _, p, _ in latest.values()})
    distinct = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    keys = distinct.select("host", "path", F.explode(suffixes).alias("rh")).select("*", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    keys = keys.where(F.length("path") >= F.col("n")).withColumn("rp", F.col("path").substr(F.lit(1), F.col("n")))
    met = keys.join(table, ["rh", "rp"]).groupBy("host", "path")
    best = met.agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("m"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.struct("m.rule", "m.verdict").alias("fit"))
    out = pages.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.select(*pages.columns, "fit")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links of the pages of a host to other hosts. Relative links stay on their host."""
    found = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    edges = pages.where("host != '' and html like '%//%'").select(F.col("host").alias("src"), found.alias("dst"))
    edges = edges.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src != dst and dst != ''")
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from seeds (kind 0 or 1, host, mass) and links (src, dst, n).

    A round gives each host the mass of its seed and what its neighbours pass on in shares of their links; what a host without
    links would pass on is lost, in both kinds alike.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    into = links.groupBy("dst").agg(F.sum("n").alias("all"))
    forth = links.join(out, "src").select(F.lit(0).alias("kind"), F.col("src").alias("at"), F.col("dst").alias("host"), (F.col("n") / F.col("all")).alias("share"))
    back = links.join(into, "dst").select(F.lit(1).alias("kind"), F.col("dst").alias("at"), F.col("src").alias("host"), (F.col("n") / F.col("all")).alias("share"))
    steps = cut_lineage(forth.unionByName(back))
    base = cut_lineage(seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("v")))
    ranks = base
    for _ in range(0 if steps.isEmpty() else rounds):
        held = ranks.select("kind", F.col("host").alias("at"), "v")
        passed = steps.join(held, ["kind", "at"]).select("kind", "host", (F.col("share") * F.col("v") * damping).alias("v"))
        ranks = cut_lineage(base.unionByName(passed).groupBy("kind", "host").agg(F.sum("v").alias("v")))
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("v"))), F.lit(0.0)).alias(n) for k, n in enumerate(("trust", "distrust"))]
    return ranks.groupBy("host").agg(*sums)


def judge(pages: DataFrame, rules: list[Rule], rounds: int = ROUNDS, damping: float = DAMPING, share: float = SHARE, few: int = FEW_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust for each row of ``pages`` (page_id, url, html).

    Fixed results: a null url and one without ``://`` have empty host and path, fit no rule and are allowed, as
    is every host that no distrust reaches; equal trust and distrust allow; repeated rows are judged each for
    itself; an empty table gives no rows; other columns are not read.
    """
    cut = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = cut_lineage(with_rule(cut.select("page_id", "host", "path"), rules, few))
    kind = F.when(F.col("fit.verdict") == "allow", 0).when(F.col("fit.verdict") == "block", 1)
    seeds = ruled.where("fit is not null").groupBy(kind.alias("kind"), "host").agg(F.count(F.lit(1)).cast("double").alias("mass"))
    scores = propagate(seeds, cut_lineage(host_links(cut)), rounds, damping)
    # rounded, so that the order of a sum decides no verdict; written, so that a hot host of the pages can be split
    blocked = F.round("distrust", 9) > F.round((F.col("trust") + F.col("distrust")) * share, 9)
    scores = cut_lineage(scores.where("host != ''").select(F.col("host").alias("h"), "trust", "distrust", blocked.alias("bad")))
    own = F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")
    return ruled.join(scores, F.col("host") == F.col("h"), "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", own).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def sql(rules: list[Rule], rounds: int = ROUNDS, damping: float = DAMPING, share: float = SHARE) -> str:
    """The same in DuckDB's SQL, over ``pages``."""
    values = reduce(lambda a, b: f"{a}, {b}", [f"('{v}', '{h}', '{p}')" for v, h, p in rules])
    link = LINK.replace("'", "''")
    return f"""
with recursive rules(verdict, rh, rp) as (values {values}),
cut as (select page_id, html, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages),
p as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fit as (
  select page_id, host, path, rh || rp as rule, verdict from p left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
  qualify row_number() over (partition by page_id order by length(rh || rp) desc) = 1),
found as (select host as src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{UPPER}', '{LOWER}') as dst from p where host != ''),
links as (select src, dst, count(*) as n from found where src != dst and dst != '' group by src, dst),
steps as (
  select 0 as kind, src as at, dst as host, n / sum(n) over (partition by src) as share from links
  union all select 1, dst, src, n / sum(n) over (partition by dst) from links),
base as (select case verdict when 'allow' then 0 else 1 end as kind, host, count(*) * {1 - damping!r} as v from fit where verdict is not null group by all),
ranks as (
  select 0 as i, kind, host, v from base
  union all
  select i, kind, host, sum(v) from (
    select r.i + 1 as i, s.kind, s.host, s.share * r.v * {damping!r} as v from ranks r join steps s on s.kind = r.kind and s.at = r.host where r.i < {rounds}
    union all select r.i + 1, b.kind, b.host, b.v from base b, (select distinct i from ranks) r where r.i < {rounds}) group by i, kind, host),
scores as (select host, coalesce(sum(v) filter (where kind = 0), 0) as t, coalesce(sum(v) filter (where kind = 1), 0) as d from ranks where i = {rounds} group by host)
select page_id, f.host, path, rule, coalesce(verdict, case when f.host != '' and round(d, 9) > round((t + d) * {share!r}, 9) then 'block' else 'allow' end) as verdict,
  case when f.host = '' then 0.0 else coalesce(t, 0.0) end::double as trust, case when f.host = '' then 0.0 else coalesce(d, 0.0) end::double as distrust
from fit f left join scores s on f.host = s.host"""
