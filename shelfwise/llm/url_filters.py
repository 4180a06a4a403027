"""URL filters: allow and block rules looked up by hash.

A rule is a host (fitting itself and its subdomains) and a path prefix.  Each
distinct (host, path) is expanded into host-suffix x path-prefix expressions,
only of the label counts and path lengths that some rule has; the expressions
meet the rules by an equi-join on the first 32 bits of the SHA-256 of
``host + path``; the full digest confirms the hit, and the longest rule wins.
DataFrame functions only, no rule is compared with every URL.

Defined results: a null url, or one without ``://``, has an empty host and an
empty path, which no rule fits; a rule without a host fits nothing; of rules
of equal length the longer host wins, and of an allow and a block rule for the
same expression the block; repeated rows are all judged; an empty table or
rule list gives the default verdict or no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VERDICT = "allow"     # a block list: what no rule names may pass
PREFIX_HEX = 8                # 32 bits of the digest as the join key


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) between the first ``://`` and the next of / ? #,
    and the path from there up to ? or #."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) -> one row per expression with its full digest
    and join key; allow and block of the same expression become block."""
    r = rules.select(F.coalesce("host", F.lit("")).alias("host"),
                     F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    digest = F.sha2(F.concat("host", "path"), 256)
    return r.select(F.concat("host", "path").alias("rule"), "verdict",
                    F.length("host").alias("host_len"),
                    F.size(F.split("host", r"\.")).alias("labels"),
                    F.length("path").alias("path_len"), digest.alias("rule_digest"),
                    F.substring(digest, 1, PREFIX_HEX).alias("key"))


def expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, digest, key) for every host suffix and path prefix whose
    label count and length some rule has, so a long URL is cut only where a
    rule can end: label counts are plain numbers until they have met the
    shapes of the rules."""
    shapes = rules.select("labels", "path_len").distinct()
    labels = F.split("host", r"\.")
    e = (urls.where("host <> ''")
         .withColumn("labels", F.explode(F.sequence(F.lit(1), F.size(labels))))
         .join(shapes, "labels").where(F.length("path") >= F.col("path_len"))
         .withColumn("suffix", F.expr("substring_index(host, '.', -labels)"))
         .withColumn("expr", F.concat("suffix", F.expr("substring(path, 1, path_len)"))))
    digest = F.sha2(F.col("expr"), 256)
    return e.select("host", "path", "suffix", digest.alias("digest"),
                    F.substring(digest, 1, PREFIX_HEX).alias("key"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id",
               url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict.

    Each distinct (host, path) is judged once, so a URL that a third of the
    pages share costs one lookup; the verdict meets the pages on the same two
    columns."""
    host, path = host_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    ready = prepare_rules(rules)
    hits = expressions(judged.select("host", "path").distinct(), ready).join(
        ready.select("key", "rule_digest", "host_len", "rule", "verdict"), "key")
    hits = hits.where((F.col("digest") == F.col("rule_digest"))
                      & (F.length("suffix") == F.col("host_len")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        F.length("rule").alias("len"), "host_len", "rule", "verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"),
                       F.col("best.verdict").alias("verdict"))
    return (judged.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("verdict", F.lit(default)).alias("verdict")))
