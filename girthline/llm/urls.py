"""URL filter: host suffixes and path prefixes of each URL, looked up by short hash prefixes.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; the path goes on from there to ``?``,
``#`` or the end. A null URL or one without ``://`` has neither and no rule fits it. A rule (host, path, verdict) fits its host and all
subdomains if the URL's path starts with the rule's path. The longest fitting rule (host and path together) decides; of equally
long ones that with the longer host, and of contrary verdicts on one rule ``block``. Without a fitting rule the verdict is ``default``.

Each distinct URL is expanded into its host suffixes of as many labels, and path prefixes of as many characters, as some rule
has, so the expansion is exact for any rule and bounded by the rules and not by the URL. The expressions are joined with the
rules on the first 32 bits of their SHA-256 digest; a match counts if the whole digests agree. URLs that occur often are
judged once; the verdicts are joined back on the URL, a join that adaptive execution may split.

Empty tables, repeated rows and null ids need nothing special: every row of ``pages`` gives one row. Rules with a null host,
path or verdict are no rules. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Block or allow, with the rule's host and path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``, null without one. Found once for host and path, so a later ``://`` can't count."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    after = F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1)
    return F.coalesce(F.translate(after, CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*+(/[^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", row_id: str = "page_id", url: str = "url") -> DataFrame:
    """``row_id``, ``host``, ``path``, ``rule`` and ``verdict`` of each page."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block after allow
    sizes = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.char_length("path")).alias("lengths")
    ).first()
    labels, lengths = sorted(sizes["labels"]), sorted(sizes["lengths"])
    keyed = rules.withColumn("digest", _digest(F.col("host"), F.col("path"))).select(
        F.substring("digest", 1, 8).alias("prefix"), F.col("digest").alias("rule_digest"), F.col("host").alias("rule_host"),
        F.col("path").alias("rule_path"), "verdict",
    )
    at = pages.select(F.col(row_id).alias("row_id"), F.col(url).alias("url"))
    urls = at.where("url IS NOT NULL").select("url").distinct().withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -n) for n in labels)) if labels else F.array(F.lit(None).cast("string")))
    prefixes = F.filter(F.array(*(F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths)) if lengths else F.array(F.lit(None).cast("string")), lambda p: p.isNotNull())
    spread = urls.select("url", F.explode(suffixes).alias("s"), prefixes.alias("ps")).select("url", "s", F.explode("ps").alias("p"))
    spread = spread.withColumn("digest", _digest(F.col("s"), F.col("p"))).withColumn("prefix", F.substring("digest", 1, 8))
    fits = spread.join(keyed, "prefix").where(F.col("digest") == F.col("rule_digest"))
    order = F.struct(F.char_length("rule_host") + F.char_length("rule_path"), F.char_length("rule_host"), "verdict")
    best = fits.groupBy("url").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), order).alias("best"))
    out = at.join(best.withColumnRenamed("url", "of"), F.col("url") == F.col("of"), "left")
    return out.select(
        F.col("row_id").alias(row_id), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(pages: DataFrame, rules=RULES) -> DataFrame:
    return pages.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
