"""URL filters by host-suffix and path-prefix expressions, in DataFrame functions only.

Every distinct URL is expanded into the expressions that a rule for it could have: each label suffix of its host
with each prefix of its path that is as long as some rule's path. Expressions meet rules by an equi-join on a
short prefix of their SHA-256, the full digest confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import table

#: Hexadecimal digits of the digest that are joined on.
SHORT = 8
#: The verdict on a URL that no rule fits.
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for other texts."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: F.Column) -> F.Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: F.Column, path: F.Column, lengths: F.Column) -> F.Column:
    """All host suffixes by all path prefixes of the given lengths that the path has."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(lengths, lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    pairs = F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))
    return F.array_distinct(F.flatten(pairs))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``rules`` has host, path, verdict.

    A rule fits its host and all subdomains if the path of the URL starts with the rule's. The longest rule
    wins, then the longest host, then ``allow`` before ``block``. Null URLs and URLs without ``://`` have an
    empty host and path, which no rule with a path fits. Repeated pages keep their rows.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    text = F.concat("r_host", "r_path")
    rules = rules.select(text.alias("r_rule"), F.length("r_host").alias("r_size"), "r_verdict", F.sha2(text, 256).alias("r_digest"), F.length("r_path").alias("r_length"))
    # the lengths of rule paths: one row, as wide as the longest path at most
    lengths = rules.agg(F.collect_set("r_length").alias("lengths"))
    urls = pages.select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = lengths.first()["lengths"]
    offered = F.array(*map(F.lit, sorted(known))) if known else F.array().cast("array<int>")
    open_ = urls.select("url", F.explode(expressions(F.col("host"), F.col("path"), offered)).alias("expression"))
    open_ = open_.withColumn("digest", F.sha2("expression", 256))
    met = open_.join(rules, F.substring("digest", 1, SHORT) == F.substring("r_digest", 1, SHORT)).where("digest = r_digest")
    best = F.max(F.struct(F.length("r_rule").alias("a"), F.col("r_size").alias("b"), (F.col("r_verdict") == "allow").alias("c"), F.col("r_rule"), F.col("r_verdict")))
    best = met.groupBy("url").agg(best.alias("best")).withColumnRenamed("url", "__url")
    out = pages.select("page_id", F.coalesce("url", F.lit("")).alias("__of"))
    out = out.join(best, F.col("__of") == F.col("__url"), "left")
    return out.select(
        "page_id",
        host_of(F.col("__of")).alias("host"),
        path_of(F.col("__of")).alias("path"),
        F.col("best.r_rule").alias("rule"),
        F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"),
    )


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


OP6_SQL = r"""
with r(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                       ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
f as (
  select u.page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
  from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) group by u.page_id)
select u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') as verdict from u left join f on u.page_id = f.page_id
"""
