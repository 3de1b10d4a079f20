"""URL rules by host suffix and path prefix, looked up by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wishgrid.llm.common import UPPER

#: Rules up to this number are broadcast (about 150 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return F.translate(host, UPPER, UPPER.lower()), path


def short_hash(expression: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(expression), 40)


def rule_table(rules: DataFrame) -> DataFrame:
    """rules(rule, verdict): ``host/path`` strings. Repeated rules count once, block before allow; nulls are left out."""
    rule = F.col("rule")
    return (
        rules.where(rule.isNotNull() & F.col("verdict").isin("allow", "block") & rule.contains("/"))
        .groupBy("rule")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            "rule",
            "verdict",
            F.length(rule).alias("n"),
            F.length(F.substring_index(rule, "/", 1)).alias("n_host"),
            F.size(F.split(F.substring_index(rule, "/", 1), r"\.")).alias("labels"),
            short_hash(rule).alias("short"),
            F.sha2(rule, 256).alias("digest"),
        )
    )


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """pages(page_id, url), rules(rule, verdict) -> page_id, host, path, rule, verdict.

    A rule ``host/path`` fits the host and its subdomains when the path starts with the rule's path. The longest rule
    wins, of equal ones that with the longer host. A URL without a rule gets ``otherwise``. One row per page: repeated,
    null and empty URLs each keep theirs; no rules or no pages give no rule or no rows. Other columns are not read.

    Each distinct (host, path) is judged once, so a URL on a third of all pages costs one lookup. Its expressions are
    the host's last labels and the path's first characters, of just the lengths that occur in the rules.
    """
    table = rule_table(rules)
    shape = table.select("labels", (F.col("n") - F.col("n_host")).alias("path")).distinct().collect()  # lengths only
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shape:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    labels = F.split("host", r"\.")
    expressions = F.array(
        *(
            F.when(
                (F.size(labels) >= s.labels) & (F.length("path") >= s.path),
                F.concat(
                    F.array_join(F.slice(labels, -s.labels, s.labels), "."), F.substring("path", 1, s.path)
                ),
            )
            for s in sorted(shape, key=lambda s: (s.labels, s.path))
        )
    )
    if table.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        table = F.broadcast(table)
    winner = F.max(F.struct("n", "n_host", "rule", "verdict"))
    verdicts = (
        judged.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(F.array_distinct(F.array_compact(expressions))).alias("expression"))
        .withColumn("short", short_hash(F.col("expression")))
        .join(table, "short")
        .where(F.sha2("expression", 256) == F.col("digest"))
        .groupBy("host", "path")
        .agg(winner.alias("w"))
        .select("host", "path", "w.rule", "w.verdict")
    )
    return judged.join(verdicts, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")
    )
