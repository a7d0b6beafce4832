"""Column, predicate, join, reshape, set and storage operators on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecocline.functions import scalar
from ecocline.operators import ordering, relations, reshape, spatial, summaries
from ecocline.plans.registry import SAMPLES, TAXA, query, rounded, samples, taxa
from ecocline.sources import schemas, storage
from ecocline.sources.tables import parquet, read_csv, write_csv


@query(
    "project_rename_reorder",
    """SELECT o_orderkey AS order_key, 'kept' AS tag, o_custkey AS "customer key",
  o_totalprice AS "Total+Price", o_orderstatus FROM orders""",
)
def project_rename_reorder(spark, sf):
    """Select, drop, rename (also to names with spaces and signs), reorder, constant tag."""
    out = parquet(spark, sf, "orders").drop("o_orderdate", "o_orderpriority")
    out = out.withColumnsRenamed(
        {"o_orderkey": "order_key", "o_custkey": "customer key", "o_totalprice": "Total+Price"}
    )
    return relations.relocate(out.withColumn("tag", F.lit("kept")), "tag", after="order_key")


@query(
    "column_range_apply",
    """SELECT l_linenumber, round(avg(l_quantity), 4) AS l_quantity,
  round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount,
  round(avg(l_tax), 6) AS l_tax, max(l_tax * 2) AS twice
FROM lineitem GROUP BY l_linenumber""",
)
def column_range_apply(spark, sf):
    """A positional column range, one function over all of its columns."""
    df = parquet(spark, sf, "lineitem")
    names = relations.cols_between(df, "l_quantity", "l_tax")
    digits = dict(zip(names, (4, 4, 6, 6)))
    doubled = relations.apply_to(df.withColumn("twice", F.col("l_tax")), ["twice"], lambda c: c * 2)
    return doubled.groupBy("l_linenumber").agg(
        *[F.round(F.avg(c), digits[c]).alias(c) for c in names], F.max("twice").alias("twice")
    )


@query(
    "computed_columns",
    """SELECT p_partkey, CASE WHEN p_size = 10 THEN NULL ELSE round(p_retailprice / (p_size - 10), 6)
  END + 0.0 AS per_size, round(p_retailprice * 2 - p_size, 6) AS net, 'part' AS kind FROM part""",
)
def computed_columns(spark, sf):
    """Arithmetic columns; a zero divisor gives NULL."""
    c = F.col
    return rounded(parquet(spark, sf, "part").select(
        "p_partkey",
        scalar.ratio("p_retailprice", c("p_size") - 10).alias("per_size"),
        (c("p_retailprice") * 2 - c("p_size")).alias("net"),
        F.lit("part").alias("kind"),
    ))


@query(
    "casts",
    """SELECT c_custkey, CAST(substr(c_name, 10) AS BIGINT) AS number,
  TRY_CAST(c_mktsegment AS DOUBLE) AS not_a_number, CAST(c_nationkey AS VARCHAR) AS nation_text,
  CAST(c_acctbal AS DOUBLE) AS balance FROM customer""",
)
def casts(spark, sf):
    """Number from text, failed casts as NULL, text from number."""
    c = F.col
    return parquet(spark, sf, "customer").select(
        "c_custkey",
        F.substring("c_name", 10, 20).cast("long").alias("number"),
        c("c_mktsegment").try_cast("double").alias("not_a_number"),
        c("c_nationkey").cast("string").alias("nation_text"),
        c("c_acctbal").cast("double").alias("balance"),
    )


@query(
    "dates_from_text",
    """SELECT date_trunc('day', o_orderdate)::DATE AS day, count(*) AS n FROM orders
WHERE o_orderdate IS NOT NULL GROUP BY 1""",
)
def dates_from_text(spark, sf):
    """Dates read from month/day/year text and from ISO text."""
    text = parquet(spark, sf, "orders").select(
        F.date_format("o_orderdate", "M/d/yyyy").alias("us"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"),
    )
    day = F.to_date("us", "M/d/yyyy")
    kept = text.filter(day == F.to_date("iso"))
    return kept.groupBy(day.alias("day")).agg(F.count("*").alias("n"))


@query(
    "predicates",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 3) AS quantity FROM lineitem
WHERE l_linestatus = 'F' AND l_returnflag <> 'N' AND (l_linenumber IN (1, 2, 3) OR l_tax > 0.05)
  AND l_quantity < 40 AND l_discount <= 0.08 GROUP BY l_returnflag""",
)
def predicates(spark, sf):
    """Equality, inequality, membership, alternatives and thresholds, pushed to the scan."""
    c = F.col
    kept = parquet(spark, sf, "lineitem").filter(
        (c("l_linestatus") == "F") & (c("l_returnflag") != "N")
        & (c("l_linenumber").isin(1, 2, 3) | (c("l_tax") > 0.05))
        & (c("l_quantity") < 40) & (c("l_discount") <= 0.08)
    )
    out = kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    return rounded(out, 3)


@query(
    "drop_missing",
    f"""WITH {SAMPLES}, holes AS (SELECT site, discount, nullif(tax, 0) AS tax FROM samples)
SELECT site, count(*) FILTER (discount IS NOT NULL) AS with_discount,
  count(*) FILTER (discount IS NOT NULL AND tax IS NOT NULL) AS complete FROM holes
GROUP BY site""",
)
def drop_missing(spark, sf):
    """Rows with a value in one named column, and rows with a value in every column."""
    c = F.col
    holes = samples(spark, sf).select("site", "discount", F.nullif(c("tax"), F.lit(0.0)).alias("tax"))
    complete = c("discount").isNotNull() & c("tax").isNotNull()
    return holes.groupBy("site").agg(
        F.count("discount").alias("with_discount"), F.count_if(complete).alias("complete")
    )


@query(
    "set_operations",
    f"""WITH {TAXA},
a AS (SELECT DISTINCT taxon_name, taxon_group FROM taxa WHERE size <= 20),
b AS (SELECT DISTINCT taxon_name, taxon_group FROM taxa WHERE size > 30)
SELECT 'both' AS part, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'only_small', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'only_large', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def set_operations(spark, sf):
    """Distinct, intersection, differences and a union by column name."""
    items = taxa(spark, sf).select("taxon_name", "taxon_group", "size")
    a = items.filter("size <= 20").drop("size").distinct()
    b = items.filter("size > 30").drop("size").distinct()
    tag = lambda df, name: df.withColumn("part", F.lit(name))
    return relations.stack(
        tag(a.intersect(b), "both"), tag(a.subtract(b), "only_small"), tag(b.subtract(a), "only_large")
    )


@query(
    "distinct_counts",
    f"""WITH {SAMPLES}
SELECT site, count(DISTINCT taken) AS days, count(DISTINCT (tide, day_night)) AS conditions
FROM samples GROUP BY site""",
)
def distinct_counts(spark, sf):
    """Distinct rows and distinct counts per site, counted in two stages."""
    df = samples(spark, sf)
    days = df.select("site", "taken").distinct().groupBy("site").agg(F.count("*").alias("days"))
    kinds = df.select("site", "tide", "day_night").dropDuplicates().groupBy("site")
    return days.join(kinds.agg(F.count("*").alias("conditions")), "site")


@query(
    "recode_values",
    """SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'Std' WHEN 'ECONOMY' THEN 'Eco'
  ELSE p_type END AS short_type, CASE p_type WHEN 'PROMO' THEN 'Offer' WHEN 'LARGE' THEN 'Big' END
  AS listed_only, coalesce(CASE p_type WHEN 'PROMO' THEN 'Offer' WHEN 'LARGE' THEN 'Big' END, ' ')
  AS blank FROM part""",
)
def recode_values(spark, sf):
    """Nested recodes that keep other values, recodes that do not, and blanks for NULL."""
    listed = scalar.recode("p_type", {"PROMO": "Offer", "LARGE": "Big"}, keep_other=False)
    return parquet(spark, sf, "part").select(
        "p_partkey",
        scalar.recode("p_type", {"STANDARD": "Std", "ECONOMY": "Eco"}).alias("short_type"),
        listed.alias("listed_only"),
        F.coalesce(listed, F.lit(" ")).alias("blank"),
    )


@query(
    "unite_separate",
    """SELECT p_partkey,
  coalesce(p_brand, 'NA') || ',' || coalesce(nullif(p_type, 'PROMO'), 'NA') AS with_na,
  concat_ws(',', p_brand, nullif(p_type, 'PROMO')) AS without_na,
  split_part(p_name, ' ', 1) AS genus, split_part(p_name, ' ', 2) AS species,
  CAST(NULL AS VARCHAR) AS strain FROM part""",
)
def unite_separate(spark, sf):
    """Join text columns with and without NA text; split into parts, missing parts NULL."""
    kind = F.nullif(F.col("p_type"), F.lit("PROMO"))
    return parquet(spark, sf, "part").select(
        "p_partkey",
        scalar.unite(["p_brand", kind], ",").alias("with_na"),
        scalar.unite(["p_brand", kind], ",", drop_null=True).alias("without_na"),
        *scalar.separate("p_name", " +", ["genus", "species", "strain"]),
    )


@query(
    "short_names",
    """WITH s AS (SELECT p_partkey, p_name,
  substr(p_name, 1, 1) || '.' || split_part(p_name, ' ', 2) AS short FROM part),
r AS (SELECT p_partkey, CASE short WHEN 's.ring' THEN 'small ring' ELSE short END AS name FROM s)
SELECT p_partkey, name,
  CASE WHEN name = 'b.ring' THEN name ELSE 'italic(''' || name || ''')' END AS label FROM r""",
)
def short_names(spark, sf):
    """Abbreviated two-word names with an exception, and decorated labels."""
    name = scalar.short_name("p_name", {"s.ring": "small ring"})
    out = parquet(spark, sf, "part").select("p_partkey", name.alias("name"))
    return out.withColumn("label", scalar.decorate("name", "italic('", "')", ["b.ring"]))


@query(
    "replace_matching",
    """SELECT lang, CASE WHEN regexp_matches(text, '[Ll]icen[cs]e|[Cc]opyright')
  THEN 'license line' ELSE lang END AS kind, count(*) AS n, sum(length(text))::BIGINT AS chars
FROM documents GROUP BY 1, 2""",
)
def replace_matching(spark, sf):
    """Whole values replaced where a pattern occurs anywhere in the text."""
    docs = parquet(spark, sf, "documents").select("lang", "text")
    found = scalar.replace_matching("text", "[Ll]icen[cs]e|[Cc]opyright", "license line")
    kind = F.when(found == "license line", found).otherwise(F.col("lang"))
    return docs.groupBy("lang", kind.alias("kind")).agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "rounding",
    """WITH v AS (SELECT o_orderkey, o_totalprice AS x, o_totalprice / 500000 AS r FROM orders)
SELECT o_orderkey, round_even(x, 1) AS even,
  CASE WHEN r > 0.1 THEN round_even(r, 2) ELSE round_even(r, 3) END AS r2,
  round_even(x / pow(10, floor(log10(x)) - 1), 0) * pow(10, floor(log10(x)) - 1) AS two_digits,
  round(ln(x), 9) AS log_price
FROM v""",
)
def rounding(spark, sf):
    """Half-even rounding, two or three decimals by size, significant digits, logarithm."""
    x = F.col("o_totalprice")
    return parquet(spark, sf, "orders").select(
        "o_orderkey",
        scalar.round_even(x, 1).alias("even"),
        scalar.round_r2(x / 500000).alias("r2"),
        scalar.signif(x, 2).alias("two_digits"),
        F.round(F.ln(x), 9).alias("log_price"),
    )


@query(
    "level_order",
    """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 0
  WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 END AS ord FROM orders""",
)
def level_order(spark, sf):
    """Rows in an explicit level order, then by key; unlisted levels last."""
    ord_ = ordering.level_order(F.col("o_orderpriority"), ["5-LOW", "3-MEDIUM", "1-URGENT"])
    out = parquet(spark, sf, "orders").select("o_orderkey", "o_orderpriority", ord_.alias("ord"))
    return out.orderBy(F.asc_nulls_last("ord"), F.desc("o_orderkey"))


@query(
    "slice_rows",
    """SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
  FROM orders) WHERE rank <= 2""",
)
def slice_rows(spark, sf):
    """First rows of every group in a declared order."""
    orders = parquet(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordering.top_rows(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


@query(
    "long_form",
    """FROM (SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE AS s_nationkey FROM supplier)
UNPIVOT INCLUDE NULLS (value FOR parameter IN (s_acctbal, s_nationkey))""",
)
def long_form(spark, sf):
    """Wide to long."""
    df = parquet(spark, sf, "supplier").select(
        "s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey")
    )
    return reshape.wide_to_long(df, ["s_acctbal", "s_nationkey"])


@query(
    "wide_form",
    """SELECT user_id, round(avg(value) FILTER (event_type = 'view'), 6) AS view,
  round(avg(value) FILTER (event_type = 'click'), 6) AS click,
  round(avg(value) FILTER (event_type = 'error'), 6) AS error,
  round(avg(value) FILTER (event_type = 'signup'), 6) AS signup,
  round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM events GROUP BY user_id""",
)
def wide_form(spark, sf):
    """Long to wide with the column values stated up front."""
    kinds = ["view", "click", "error", "signup", "purchase"]
    means = (
        parquet(spark, sf, "events")
        .groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    )
    return rounded(reshape.long_to_wide(means, ["user_id"], "event_type", "value", kinds))


@query(
    "dense_grid",
    """WITH s AS (
  SELECT user_id, event_type, sum(value) AS value FROM events GROUP BY ALL),
g AS (SELECT DISTINCT user_id, unnest(['view', 'click', 'error', 'signup', 'purchase']) AS event_type FROM s)
SELECT user_id, event_type, round(coalesce(value, 0.0), 6) AS value
FROM g LEFT JOIN s USING (user_id, event_type)""",
)
def dense_grid(spark, sf):
    """Long table completed with zeros over the listed values."""
    kinds = ["view", "click", "error", "signup", "purchase"]
    sums = (
        parquet(spark, sf, "events")
        .groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    )
    return rounded(reshape.dense_long(sums, ["user_id"], "event_type", "value", kinds))


@query(
    "crossed_long",
    """WITH w AS (
  SELECT o_custkey, sum(o_totalprice) AS total, max(o_totalprice) AS top, count(*)::DOUBLE AS n,
    min(o_totalprice) AS low FROM orders GROUP BY o_custkey),
x AS (FROM w UNPIVOT INCLUDE NULLS (x FOR parameter IN (total, top)))
SELECT o_custkey, parameter, round(x, 2) AS x, 'n' AS dependent, round(n, 2) AS y FROM x
UNION ALL SELECT o_custkey, parameter, round(x, 2), 'low', round(low, 2) FROM x""",
)
def crossed_long(spark, sf):
    """Every dependent beside every predictor."""
    wide = parquet(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("top"),
        F.count("*").cast("double").alias("n"), F.min("o_totalprice").alias("low"),
    )
    return rounded(reshape.crossed_long(wide, ["n", "low"], ["total", "top"], ["o_custkey"]), 2)


@query(
    "join_right",
    """SELECT s_suppkey, s_nationkey, n_name FROM supplier RIGHT JOIN nation
ON s_nationkey = n_nationkey AND s_acctbal > 9000""",
)
def join_right(spark, sf):
    """Right join: every nation, with its rich suppliers if it has any."""
    rich = parquet(spark, sf, "supplier").filter("s_acctbal > 9000").select("s_suppkey", "s_nationkey")
    nation = parquet(spark, sf, "nation").select(F.col("n_nationkey"), "n_name")
    out = rich.join(nation, rich["s_nationkey"] == nation["n_nationkey"], "right")
    return out.select("s_suppkey", "s_nationkey", "n_name")


@query(
    "join_left_natural",
    """WITH a AS (SELECT p_partkey, nullif(p_type, 'PROMO') AS kind, p_size AS size,
    p_retailprice AS price FROM part),
b AS (SELECT kind, size, count(*) AS n FROM a WHERE price > 1000 GROUP BY ALL)
SELECT p_partkey, a.kind, a.size, n FROM a LEFT JOIN b
ON a.kind IS NOT DISTINCT FROM b.kind AND a.size = b.size""",
)
def join_left_natural(spark, sf):
    """Left join on all shared columns, where a missing key matches a missing key."""
    c = F.col
    a = parquet(spark, sf, "part").select(
        "p_partkey", F.nullif(c("p_type"), F.lit("PROMO")).alias("kind"), c("p_size").alias("size"),
        c("p_retailprice").alias("price"),
    )
    b = a.filter("price > 1000").groupBy("kind", "size").agg(F.count("*").alias("n"))
    return relations.natural_join(a.drop("price"), b, "left")


@query(
    "join_full_coalesce",
    """WITH a AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, max(c_acctbal) AS high
  FROM customer WHERE c_acctbal > 9900 GROUP BY ALL),
b AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, min(c_acctbal) AS low
  FROM customer WHERE c_acctbal < -900 GROUP BY ALL)
SELECT nation, segment, high, low, high - low AS range FROM a FULL JOIN b USING (nation, segment)""",
)
def join_full_coalesce(spark, sf):
    """Full join keeping each key from whichever side has it."""
    c = F.col
    base = parquet(spark, sf, "customer").select(
        c("c_nationkey").alias("nation"), c("c_mktsegment").alias("segment"), "c_acctbal"
    )
    keys = ["nation", "segment"]
    a = base.filter("c_acctbal > 9900").groupBy(*keys).agg(F.max("c_acctbal").alias("high"))
    b = base.filter("c_acctbal < -900").groupBy(*keys).agg(F.min("c_acctbal").alias("low"))
    return relations.natural_join(a, b, "full").withColumn("range", c("high") - c("low"))


@query(
    "join_semi",
    """SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_tax = 0.08)""",
)
def join_semi(spark, sf):
    """Membership in another table's column."""
    c = F.col
    big = parquet(spark, sf, "lineitem").filter((c("l_quantity") >= 49) & (c("l_tax") == 0.08))
    orders = parquet(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return orders.join(big.select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(
        "o_custkey", "o_orderkey"
    )


@query(
    "share_of_total",
    """WITH s AS (SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT o_orderpriority, o_orderstatus, round(v / sum(v) OVER (PARTITION BY o_orderpriority) * 100, 6)
  AS share FROM s""",
)
def share_of_total(spark, sf):
    """Value as a percentage of its group."""
    sums = parquet(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.sum("o_totalprice").alias("v")
    )
    return rounded(summaries.share_of_total(sums, ["o_orderpriority"], "v").drop("v"))


@query(
    "stats_on_rows",
    """SELECT s_suppkey, s_nationkey, s_acctbal,
  round(avg(s_acctbal) OVER w, 4) AS mean,
  round(stddev_samp(s_acctbal) OVER w / sqrt(count(s_acctbal) OVER w), 4) AS se
FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""",
)
def stats_on_rows(spark, sf):
    """Group mean and standard error kept on every row."""
    df = parquet(spark, sf, "supplier").drop("s_name")
    stats = {"mean": F.avg("s_acctbal"), "se": scalar.standard_error("s_acctbal")}
    return rounded(summaries.with_group_stats(df, ["s_nationkey"], stats), 4)


@query(
    "global_deviation",
    """WITH s AS (SELECT user_id, avg(value) AS mean FROM events GROUP BY user_id)
SELECT user_id, round(mean, 6) AS mean, round(avg(mean) OVER (), 6) AS grand,
  round(mean - avg(mean) OVER (), 6) + 0.0 AS deviation FROM s""",
)
def global_deviation(spark, sf):
    """Deviation from the mean over all groups."""
    means = parquet(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("mean"))
    out = summaries.with_global(means, {"grand": F.avg("mean")})
    return rounded(out.withColumn("deviation", F.col("mean") - F.col("grand")))


@query(
    "z_scores",
    """SELECT s_suppkey,
  round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER (), 6) + 0.0 AS s_acctbal,
  round((s_nationkey - avg(s_nationkey) OVER ()) / stddev_samp(s_nationkey) OVER (), 6) + 0.0
  AS s_nationkey FROM supplier""",
)
def z_scores(spark, sf):
    """Centred and scaled columns."""
    df = parquet(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return rounded(summaries.z_scores(df, ["s_acctbal", "s_nationkey"]))


@query(
    "strict_sums",
    f"""WITH {SAMPLES}
SELECT site, tide, round(sum(discount), 6) AS lenient,
  CASE WHEN count(*) FILTER (discount IS NULL) = 0 THEN round(sum(discount), 6) END AS strict
FROM samples GROUP BY site, tide""",
)
def strict_sums(spark, sf):
    """Sums that skip missing values, and sums that a missing value makes missing."""
    df = samples(spark, sf).groupBy("site", "tide")
    return rounded(df.agg(F.sum("discount").alias("lenient"), scalar.strict_sum("discount").alias("strict")))


@query(
    "nested_rows",
    f"""WITH {SAMPLES},
s AS (SELECT site, round(avg(price), 2) AS price, round(avg(discount), 4) AS discount,
  round(avg(tax), 4) AS tax FROM samples GROUP BY site),
long AS (FROM s UNPIVOT INCLUDE NULLS (v FOR parameter IN (price, discount, tax)))
SELECT site, count(*)::INTEGER AS n, list(parameter ORDER BY parameter)[1] AS first_name,
  list(v ORDER BY parameter)[1] AS first_value, list(v ORDER BY parameter)[3] AS last_value
FROM long GROUP BY site""",
)
def nested_rows(spark, sf):
    """A site's parameters nested into one array of structs, and read back from it."""
    digits = {"price": 2, "discount": 4, "tax": 4}
    wide = samples(spark, sf).groupBy("site").agg(
        *[F.round(F.avg(p), d).alias(p) for p, d in digits.items()]
    )
    entry = lambda p: F.struct(F.lit(p).alias("parameter"), F.col(p).alias("v"))
    nested = wide.select("site", F.array_sort(F.array(*[entry(p) for p in digits])).alias("rows"))
    return nested.select(
        "site", F.size("rows").alias("n"), F.col("rows")[0]["parameter"].alias("first_name"),
        F.col("rows")[0]["v"].alias("first_value"), F.col("rows")[2]["v"].alias("last_value"),
    )


@query(
    "median_centroid",
    """SELECT c_nationkey AS location, round(median(c_acctbal + 0.00013), 6) AS lon,
  round(median(c_custkey::DOUBLE), 6) AS lat FROM customer GROUP BY 1""",
)
def median_centroid(spark, sf):
    """Exact median position per location, with a longitude offset."""
    c = F.col
    sites = parquet(spark, sf, "customer").select(
        c("c_nationkey").alias("location"), c("c_acctbal").alias("lon"),
        c("c_custkey").cast("double").alias("lat"),
    )
    return rounded(spatial.centroids(sites, "location", "lon", "lat", 0.00013))


@query(
    "median_samples",
    f"""WITH {SAMPLES}
SELECT tide, day_night, round(median(price), 6) AS price, round(median(discount), 6) AS discount
FROM samples GROUP BY ALL""",
)
def median_samples(spark, sf):
    """Exact medians of very large groups, without bringing a group together."""
    columns = {"price": "price", "discount": "discount"}
    return rounded(ordering.exact_median(samples(spark, sf), ["tide", "day_night"], columns))


@query(
    "csv_round_trip",
    """SELECT s_suppkey, s_name, nullif(s_nationkey, 3) AS s_nationkey, s_acctbal FROM supplier""",
)
def csv_round_trip(spark, sf):
    """Written as CSV to the shared folder and read back by schema, NA as NULL."""
    df = parquet(spark, sf, "supplier").withColumn("s_nationkey", F.nullif("s_nationkey", F.lit(3)))
    path = storage.new_path(spark, "suppliers-csv")
    write_csv(df, path)
    return read_csv(spark, path, df.schema)


@query(
    "csv_row_names",
    """SELECT p_type AS fe, round(avg(p_size), 6) AS pc1, round(avg(p_retailprice), 6) AS pc2
FROM part GROUP BY p_type""",
)
def csv_row_names(spark, sf):
    """A table keyed by an unnamed first column, written and read back."""
    df = parquet(spark, sf, "part").groupBy(F.col("p_type").alias("fe")).agg(
        F.avg("p_size").alias("pc1"), F.avg("p_retailprice").alias("pc2")
    )
    path = storage.new_path(spark, "coordinates-csv")
    write_csv(rounded(df), path, row_key="fe")
    return read_csv(spark, path, T.StructType(schemas.FE_COORD.fields[:3]))


@query(
    "stored_table",
    """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def stored_table(spark, sf):
    """An intermediate result written once to the shared folder and scanned from there."""
    df = parquet(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total")
    )
    return storage.materialise(rounded(df, 2), "orders-by-customer")


@query(
    "data_dictionary",
    """SELECT 's_suppkey' AS attribute, NULL::VARCHAR AS units, 'Site identifier' AS description,
  count(s_suppkey) AS n_values FROM supplier
UNION ALL SELECT 's_name', NULL, NULL, count(s_name) FROM supplier
UNION ALL SELECT 's_nationkey', NULL, 'Location of the site', count(s_nationkey) FROM supplier
UNION ALL SELECT 's_acctbal', 'USD', 'Balance', count(s_acctbal) FROM supplier""",
)
def data_dictionary(spark, sf):
    """Dictionary generated from a table's schema metadata, with its value counts."""
    df = schemas.describe_columns(
        parquet(spark, sf, "supplier"),
        {"s_acctbal": "USD"},
        {"s_suppkey": "Site identifier", "s_nationkey": "Location of the site", "s_acctbal": "Balance"},
    )
    return schemas.data_dictionary(df)
