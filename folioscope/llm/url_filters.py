"""URL filters: a sort-merge range join of urls with nested host rules, in DataFrame functions only.

A host becomes its labels in reverse with a dot behind each (``com.example.www.``), so that a host and all
its subdomains form one interval of keys: from ``com.example.`` up to ``com.example/`` (``/`` follows ``.``).
The intervals of a rule set nest or are disjoint. Each rule host gives two markers, one at each end of its interval, that
carry the stack of rules active from there on; urls and markers are sorted together, and a window hands each
url the stack of the marker before it. Only rules on that stack, whose host already fits, are held against
the path; the longest wins.

Skew: the sweep is dealt by a salt, not by host, and each salt gets all markers (rules x salts rows), so a host with
a third of all urls spreads over all tasks and nothing is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_columns, lower_ascii, shuffle_partitions

#: Host: after the first "://"; path: what follows, up to "?", "#" or the end.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
OWN = ("host", "path", "rule", "verdict")


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def reversed_host(h: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(h, r"\.")), "."), F.lit("."))


def _markers(rules: DataFrame) -> DataFrame:
    """(key, side, stack): where the set of active rules changes, and the rules active from there on, longest first."""
    rules = rules.select(
        lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).filter("host is not null and host <> '' and verdict is not null")
    # two rules with one host and path: the greater verdict ("block" over "allow") holds
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    above = rules.select("host").distinct().select(F.col("host").alias("of"), F.explode(suffixes).alias("host"))
    by_rank = lambda a, b: (  # noqa: E731  longest rule first, then the longer host, then by name
        F.when(a["length"] != b["length"], b["length"] - a["length"])
        .when(F.length(a["host"]) != F.length(b["host"]), F.length(b["host"]) - F.length(a["host"]))
        .when(a["host"] < b["host"], -1)
        .when(a["host"] > b["host"], 1)
        .otherwise(0)
    )
    stacks = (
        above.join(rules.hint("merge"), "host")
        .groupBy("of")
        .agg(F.collect_list(F.struct("host", "path", "verdict", (F.length("host") + F.length("path")).alias("length"))).alias("stack"))
        .withColumn("stack", F.array_sort("stack", by_rank))
    )
    start = reversed_host(F.col("of"))
    ends = F.array(
        F.struct(start.alias("key"), F.col("stack").alias("stack")),
        F.struct(
            F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit("/")).alias("key"),
            F.filter("stack", lambda r: r["host"] != F.col("of")).alias("stack"),
        ),
    )
    return stacks.withColumn("k", start).select(F.explode(ends).alias("m")).select("m.key", "m.stack")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """Adds host, path, rule (host and path of the longest rule that fits, else null) and verdict to every row.

    rules: (host, path, verdict). A rule fits its host and all subdomains where the url's path starts with
    the rule's path. Null urls and those without "://" have an empty host and path, fit no rule and get ``default``.
    Columns of pages named like the results are replaced; repeated rows stay repeated; an empty
    table gives an empty result; without rules all get ``default``. Rules with a null or empty host or a null verdict are ignored.
    """
    n = salts or shuffle_partitions(pages.sparkSession)
    url = F.col(f"`{url_col}`")
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in drop_columns(pages, OWN).columns]).alias("row"),
        host(url).alias("host"),
        path(url).alias("path"),
    ).select("row", "host", "path", reversed_host(F.col("host")).alias("key"), F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int").alias("salt"))
    markers = _markers(rules).select("key", "stack", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"))
    both = rows.withColumn("side", F.lit(1)).unionByName(markers.withColumn("side", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("salt").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("side = 1")
    best = F.get(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return swept.withColumn("best", best).select(
        "row.*",
        "host",
        "path",
        F.concat("best.host", "best.path").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
