"""URL filter rules by a sort-merge range join (operator 8).

A host is written with its labels reversed (``www.example.org`` as ``org.example.www.``), so that a
rule for a host and its subdomains is a prefix, and a prefix is an interval of the sorted keys.
Intervals of prefixes are nested or apart: one sweep over rules and keys in order keeps a stack of
the rules that are open at each key. The sweep runs twice, over the hosts and, for every rule host
that a host lies under, over host and path.

Keys are dealt to ranges between cut points of a bounded sample; a rule goes to every range that its
interval meets. Only distinct keys are swept, so a hot host or address is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecocline.sources.storage import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (range, key, rules before points): each point with its open rules."""
    stack: list[str] = []
    span = None
    for batch in batches:
        points, opened = [], []
        for at, key, is_point in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if at != span:
                span = at
                stack = []
            while stack and not key.startswith(stack[-1]):
                stack.pop()
            if not is_point:
                stack.append(key)
            elif stack:
                points.append(key)
                opened.append(list(stack))
        yield pa.RecordBatch.from_arrays(
            [pa.array(points, pa.string()), pa.array(opened, pa.list_(pa.string()))],
            names=["key", "open"],
        )


def prefixes_of(points: DataFrame, rules: DataFrame, sample: int = 4096) -> DataFrame:
    """For every ``key`` of points that starts with a ``key`` of rules: key, open (from short to long)."""
    spark = points.sparkSession
    points = materialise(points.select("key").filter("key is not null").distinct(), "points")
    drawn = points.orderBy(F.xxhash64("key"), "key").limit(sample).collect()  # bounded by ``sample``
    ranges = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1024, len(drawn))
    drawn = sorted((r.key for r in drawn), key=lambda k: k.encode("utf-8", "surrogatepass"))
    cuts = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if ranges > 1 else []
    cuts = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<string>")
    key = F.col("key")
    first = F.size(F.filter(cuts, lambda c: c <= key))
    last = F.size(F.filter(cuts, lambda c: (c <= key) | F.startswith(c, key)))
    dealt = (
        rules.select("key").distinct()
        .select(F.explode(F.sequence(first, last)).alias("range"), "key", F.lit(False).alias("point"))
        .union(points.select(first, "key", F.lit(True)))
    )
    return (
        dealt.repartition("range").sortWithinPartitions("range", "key", "point")
        .mapInArrow(_sweep, "key string, open array<string>")
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
) -> DataFrame:
    """The longest rule that fits each url, and its verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains, where the url's
    path starts with the rule's. Returns id_column, host, path, rule (host and path; NULL if none
    fits) and verdict (the rule's, else ``default``): one row for every input row.

    A NULL url, or one without ``://``, has an empty host and path and meets no rule. Of rules with
    the same host and path, block wins over allow. Repeated rows are judged one by one; other
    columns are not read, whatever their names.
    """
    source = pages.select(F.col(id_column), F.col(url_column).alias("_url")).select(
        F.col(id_column), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")
    )
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        host_key(F.col("host")).alias("prefix"),
        F.concat(host_key(F.col("host")), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"), "verdict",
    )
    places = materialise(
        source.groupBy("host", "path").agg(F.lit(1).alias("one")).select("host", "path"), "places"
    )
    hosts = places.select("host", host_key(F.col("host")).alias("key")).distinct()
    under = prefixes_of(hosts, rules.select(F.col("prefix").alias("key")))
    under = hosts.join(under, "key").select("host", F.explode("open").alias("prefix"))
    points = materialise(
        places.join(under, "host").select("host", "path", F.concat("prefix", "path").alias("key")),
        "under",
    )
    fitting = prefixes_of(points, rules).select("key", F.element_at("open", -1).alias("rule_key"))
    longest = (
        points.join(fitting, "key")
        .join(rules.select(F.col("key").alias("rule_key"), "rule", "verdict"), "rule_key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return source.join(longest, ["host", "path"], "left").select(
        id_column, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
