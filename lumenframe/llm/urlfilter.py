"""URL filter: host and path rules, and link-graph propagation for hosts that no rule names.

Trust flows along links from hosts of allowed pages (personalised PageRank), distrust against
them from hosts of blocked pages (the same on reversed edges): whoever links to a blocked host is
distrusted. A host without a rule is blocked where distrust exceeds trust by more than a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
#: Rules that are compiled into one expression; more of them are a table that hosts' suffixes are joined with.
COMPILED = 200


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def match_rule_table(parsed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``parsed(host, path, ...)`` with the same ``rule`` and ``ruled``: every suffix of a host, from a label on, meets the rules of that host."""
    spark = parsed.sparkSession
    rows = cut(parsed.withColumn("row", F.monotonically_increasing_id()))
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "suffix string, start string, rule string, ruled string")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = rows.where("host <> ''").select("row", "path", F.explode(F.array_distinct(suffixes)).alias("suffix")).join(table, "suffix").where(F.col("path").startswith(F.col("start")))
    best = met.groupBy("row").agg(F.max_by(F.struct("rule", "ruled"), F.struct(F.length("rule"), "rule")).alias("best"))
    return rows.join(best, "row", "left").withColumns({"rule": F.col("best.rule"), "ruled": F.col("best.ruled")}).drop("row", "best")


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(src, dst)``: distinct links between different hosts, from absolute and scheme-relative references in pages with a ``host``."""
    named = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1)))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), named.alias("dst"))
    return links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 12, damping: float = 0.85, cut_every: int = 4) -> DataFrame:
    """``(host, mass)``: personalised PageRank over ``edges(src, dst)`` from ``seeds(host)``, all seeds alike.

    A host hands its mass on in equal parts; what a host without links has goes no further. Sums
    are combined before every exchange, so a host with very many links costs a row a task.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = cut(edges.join(out, "src").select("src", "dst", (F.lit(damping) / F.col("degree")).alias("w")))
    start = cut(seeds.select("host").distinct().crossJoin(F.broadcast(seeds.agg(F.countDistinct("host").alias("n")))).select("host", ((1 - damping) / F.col("n")).alias("base")))
    mass = start.select("host", F.col("base").alias("mass"))
    for k in range(rounds):
        moved = mass.join(weighted, mass.host == weighted.src).select(F.col("dst").alias("host"), (F.col("mass") * F.col("w")).alias("mass"))
        mass = moved.unionByName(start.select("host", F.col("base").alias("mass"))).groupBy("host").agg(F.sum("mass").alias("mass"))
        if k % cut_every == cut_every - 1:
            mass = cut(mass)
    return mass


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.0, default: str = "allow", rounds: int = 12, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages``.

    The longest rule that fits decides. Otherwise the page's host is blocked if its distrust is
    more than ``threshold`` above its trust, and gets ``default`` if not. A host whose ruled pages
    are mostly allowed (blocked) has trust (distrust) of its own, with links or without; any other
    host that no link reaches has neither. A null url, or one without ``://``, has an empty host and path and gets
    ``default``. A null html has no links. Repeated rows, and rows with a null id, each keep their
    row. Urls and pages of any length are taken whole; other columns are not looked at, whatever
    their names. An empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    if len(rules) > COMPILED:
        judged = match_rule_table(parsed.drop("html"), rules)
    else:
        rule, ruled = match_rule(F.col("host"), F.col("path"), rules)
        judged = parsed.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    edges = cut(host_edges(parsed))
    votes = judged.where("ruled IS NOT NULL AND host <> ''").groupBy("host").agg(F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(-1)).alias("n"))
    votes = cut(votes)
    trust = propagate(edges, votes.where("n > 0"), rounds)
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), votes.where("n < 0"), rounds)
    masses = trust.select("host", F.col("mass").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("mass").alias("distrust")))
    hosts = cut(masses.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    scored = judged.join(hosts, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    method = F.when(F.col("distrust") - F.col("trust") > threshold, F.lit("block")).otherwise(F.lit(default))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
