"""URL filters: fixed host and path rules, and association rules mined from labelled urls.

Every labelled url is a basket of its tokens (host labels, path segments, query names) and its
verdict.  FP-growth finds the frequent combinations; rules that imply ``block`` are kept by
support and confidence, and a rule goes when a shorter one inside it is as confident.  A rule
is filed under its rarest token in an inverted index; urls meet rules by that token alone.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Up to so many fixed rules are one expression; more are joined by host.
EXPRESSION_RULES = 100
#: A mined rule needs so many pages, in a table of any size.
LEAST_PAGES = 20
BLOCK, ALLOW = "=block", "=allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_verdict(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; of equally long ones the last."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def joined_verdict(rows: DataFrame, rules) -> DataFrame:
    """Adds the same struct as ``_fixed`` by a join of each host and its suffixes with the rules' hosts.

    Distinct hosts and paths are judged once, so a host that holds many rows is no hot key of the join with the rules.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(h, p, h + p, v, i) for i, (v, h, p) in enumerate(rules)], "suffix string, rule_path string, rule string, verdict string, place int")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    judged = rows.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).join(table, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    best = judged.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "place")).alias("_fixed"))
    return rows.join(best, ["host", "path"], "left")


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a url: h: host labels, p: path segments, q: names in the query."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = [
        F.transform(F.split(host, r"[.:@]"), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x)),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))),
    ]
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: F.length(x) > 2))


def mined_rules(labelled: DataFrame, min_support: float, min_confidence: float, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Rules (tokens, anchor, confidence, support) for ``block`` from rows (url, blocked boolean).

    A rule stands on a share ``min_support`` of the rows and on ``least_pages`` of them at least, so a few
    rows never make one.  The frequent sets, and so the rules, number at most what ``min_support`` allows, whatever the
    number of urls.  Rows with a null url or a null label are not used.
    """
    baskets = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select(F.array_append(url_tokens(F.col("url")), F.when(F.col("blocked"), BLOCK).otherwise(ALLOW)).alias("items"))
    n = baskets.count()
    min_support = min(1.0, max(min_support, least_pages / max(n, 1)))
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=parts).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BLOCK)).where(~F.array_contains("antecedent", ALLOW))
    rules = rules.where(F.col("support") * n >= least_pages - 0.5).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    anchors = rules.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    rules = rules.join(anchors, "tokens")
    inner = rules.select("anchor", F.col("tokens").alias("_inner"), F.col("confidence").alias("_conf"))
    wider = rules.select("tokens", "confidence", F.explode("tokens").alias("anchor")).join(inner, "anchor")
    wider = wider.where((F.size("_inner") < F.size("tokens")) & (F.col("_conf") >= F.col("confidence")) & (F.size(F.array_except("_inner", "tokens")) == 0))
    return rules.join(wider.select("tokens").distinct(), "tokens", "left_anti")


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each url that meets a rule: (url, rule_tokens, confidence) of the most confident one."""
    tokens = urls.where(F.col("url").isNotNull()).select("url").distinct().withColumn("_tokens", url_tokens(F.col("url")))
    met = tokens.withColumn("anchor", F.explode("_tokens")).join(rules, "anchor").where(F.size(F.array_except("tokens", "_tokens")) == 0)
    best = F.max(F.struct("confidence", "support", "tokens")).alias("_best")
    return met.groupBy("url").agg(best).select("url", F.col("_best.tokens").alias("rule_tokens"), F.col("_best.confidence").alias("confidence"))


def url_filter(pages: DataFrame, labelled: DataFrame, rules=RULES, min_support: float = 0.005, min_confidence: float = 0.8, least_pages: int = LEAST_PAGES, key: str = "page_id", url: str = "url") -> DataFrame:
    """Judges every page: the longest fixed rule that fits, else ``block`` if a mined rule matches.

    Of mined rules the most confident is reported, then the one of most support, then the last by its tokens.

    ``labelled`` has the columns url and blocked.  A url that is null or lacks ``://`` has empty
    host and path and is allowed, unless mined tokens say otherwise.  Without labelled urls no rule is
    mined.  Repeated pages stay repeated, an empty table gives no rows, very long urls are read whole;
    other columns are not read, whatever they are called.
    """
    base = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    mined = mined_rules(labelled.select("url", "blocked"), min_support, min_confidence, least_pages)
    found = matched_rules(base, mined)
    # A null url meets no rule; its rows stay out of the join, where they would be one key.
    out = base.where(F.col("url").isNotNull()).join(found, "url", "left").unionByName(base.where(F.col("url").isNull()), allowMissingColumns=True)
    host, path = host_and_path(F.col("url"))
    out = out.withColumns({"host": host, "path": path})
    out = out.withColumn("_fixed", fixed_verdict(F.col("host"), F.col("path"), rules)) if len(rules) <= EXPRESSION_RULES else joined_verdict(out, rules)
    method = F.when(F.col("rule_tokens").isNotNull(), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.col("_fixed.rule").alias("rule"), F.coalesce(F.col("_fixed.verdict"), method).alias("verdict"),
        F.array_join("rule_tokens", " ").alias("rule_tokens"), "confidence",
    )
