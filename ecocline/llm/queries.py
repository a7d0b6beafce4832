"""The registered queries of this subpackage, each beside the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecocline.llm.collocations import mine_collocations
from ecocline.llm.jaccard import jaccard_join
from ecocline.llm.licenses import NOTICES, PHRASES, scan_licenses
from ecocline.llm.lines import drop_repeated_lines
from ecocline.llm.mixing import mix
from ecocline.llm.outliers import judge_quality
from ecocline.llm.packing import pack
from ecocline.llm.periods import find_runs
from ecocline.llm.tokens import count_tokens
from ecocline.llm.topk import top_k
from ecocline.llm.toxicity import score_toxicity
from ecocline.llm.urls import judge_urls
from ecocline.llm.vectors import near_vectors, usable
from ecocline.sources.tables import parquet

#: The tokenizer file; it is read in place on every executor.
VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Upper-case ASCII letters to lower case; other letters stay.
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_jaccard_join", f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words
        WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY 1),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM runs x JOIN runs y ON x.run = y.run AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
  WHERE 100 * common.n >= 85 * (p.n + q.n - common.n)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT doc_id, b FROM reach JOIN links ON other = a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
""")  # fmt: skip
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join(parquet(spark, sf, "documents"), words=4, percent=85)


@query("op2_pivot_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
""")  # fmt: skip
def op2(spark: SparkSession, sf: str) -> DataFrame:
    vectors = parquet(spark, sf, "embeddings").select(
        "vec_id",
        F.when(
            usable(F.col("embedding")),
            F.transform("embedding", lambda x: F.floor(1024 * x.cast("double"))),
        ).alias("embedding"),
    )
    return top_k(vectors, "vec_id % 100 = 0")


@query("op7_near_vectors", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e)
    >= 0.9 * sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))),
reach AS (
  SELECT vec_id, vec_id AS other FROM v UNION SELECT vec_id, b FROM reach JOIN links ON other = a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(other) AS component_id,
  vec_id = min(other) AS kept
FROM reach LEFT JOIN counts ON vec_id = a GROUP BY vec_id
""")  # fmt: skip
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(parquet(spark, sf, "embeddings"), threshold=0.9, recall=0.999)


URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query("op8_url_rules", """
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id) USING (page_id)
""")  # fmt: skip
def op8(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(parquet(spark, sf, "pages"), rules)


@query("op10_curriculum_mix", """
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))) AS place
  FROM documents),
catalogue AS (
  SELECT *, [5, 2, 1][turn + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS lim FROM (
    SELECT source, sum(size)::BIGINT AS source_size,
      (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
    FROM sized GROUP BY source)),
levels AS (
  SELECT *, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS nth, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER earlier, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM catalogue
  WINDOW earlier AS (ORDER BY lim / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, least(lim, coalesce(weight * arg_min(level, nth) FILTER (level * weight < lim) OVER (), lim))
    AS target,
    [0.5, 0.0, -0.5][turn + 1]::DOUBLE AS tilt
  FROM levels),
placed AS (
  SELECT d.*, source_size, target, tilt, round(target)::BIGINT AS wanted,
    coalesce(round(target)::BIGINT // nullif(source_size, 0), 0) AS passes,
    (sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS UNBOUNDED PRECEDING) - size)::BIGINT
      AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, greatest(0, least(wanted - passes * source_size - before, size)) AS part FROM placed)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (passes * size + part)::BIGINT AS taken,
  CASE WHEN size > 0 AND passes * size + part > 0 THEN round(
    2 * (before / target) / (1 + tilt + sqrt((1 + tilt) ** 2 - 4 * tilt * (before / target))), 9) END
    AS position
FROM taking
""")  # fmt: skip
def op10(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix(parquet(spark, sf, "documents")).drop("positions")
    return mixed.withColumn("target", F.round("target", 6))


@query("op6_token_counts")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(parquet(spark, sf, "documents"), vocabulary(), limit=512)


@query("op3_bin_slack_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return pack(parquet(spark, sf, "documents"), vocabulary(), capacity=2048, end=1)


def _grams(k: int = 2) -> str:
    """The templates' k-grams as SQL values."""
    rows, at = [], 0
    for exact, table in (("true", PHRASES), ("false", NOTICES)):
        for text, label in table.items():
            words = text.split(" ")
            n = len(words) - k + 1
            rows += [f"({at}, '{label}', {exact}, {n}, {i}, '{' '.join(words[i:i + k])}')" for i in range(n)]
            at += 1
    return ", ".join(rows)


@query("op4_license_scan", f"""
WITH templates(template, label, exact, grams, tpos, gram) AS (VALUES {_grams()}),
d AS (
  SELECT doc_id, regexp_extract_all({LOWER.replace('text', "coalesce(text, '')")},
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
rolled AS (
  SELECT doc_id, x[3] AS pos, x[1] || ' ' || x[2] AS run
  FROM (SELECT doc_id, unnest(list_zip(w, w[2:], range(len(w)))) AS x FROM d WHERE len(w) > 1)),
votes AS (
  SELECT doc_id, template, label, exact, grams, pos - tpos AS diagonal, list(tpos) AS found,
    min(pos) AS low, max(pos) AS high
  FROM rolled JOIN templates ON gram = run GROUP BY ALL),
fresh AS (
  SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER along <= 2 IS NOT TRUE THEN 1 ELSE 0 END
    AS fresh
  FROM votes WINDOW along AS (PARTITION BY doc_id, template ORDER BY diagonal)),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM fresh),
spans AS (
  SELECT doc_id, label, exact, grams, len(list_distinct(flatten(list(found)))) AS held,
    min(low) AS low, max(high) AS high
  FROM numbered GROUP BY doc_id, template, label, exact, grams, span),
judged AS (
  SELECT *, exact AND held = grams AS base,
    NOT exact AND held / grams >= 0.75 AND high - low + 1 <= grams * 2 AS notice
  FROM spans)
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(low) FILTER (base) AS n_base,
  (min(low) FILTER (base))::BIGINT AS first_word, (max(low) FILTER (base))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR notice), '') AS labels,
  coalesce(max(CASE WHEN base THEN 1.0 WHEN notice THEN held / grams ELSE 0.0 END), 0.0)::DOUBLE AS score
FROM d LEFT JOIN judged USING (doc_id) GROUP BY d.doc_id, w
""")  # fmt: skip
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(parquet(spark, sf, "documents"))


@query("op5_line_windows", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, unnest(range(0, len(lines) - 2)) AS line, lines FROM l WHERE len(lines) >= 3),
h AS (
  SELECT doc_id, line, lines[line + 1] || chr(10) || lines[line + 2] || chr(10) || lines[line + 3] AS win
  FROM w WHERE trim(lines[line + 1] || lines[line + 2] || lines[line + 3]) <> ''),
seen AS (
  SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(line) OVER o AS first_line,
    row_number() OVER o AS nth
  FROM h WINDOW o AS (PARTITION BY win ORDER BY doc_id, line)),
gone AS (
  SELECT DISTINCT doc_id, unnest([line, line + 1, line + 2]) AS line FROM seen
  WHERE nth > 1 AND NOT (doc_id = first_doc AND line < first_line + 3)),
cut AS (SELECT doc_id, list(line) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines,
  coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(
    [x FOR x, i IN lines IF NOT list_contains(gone, i - 1)], chr(10)) END AS text
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN cut USING (doc_id)
""")  # fmt: skip
def op5(spark: SparkSession, sf: str) -> DataFrame:
    documents = parquet(spark, sf, "documents").select("doc_id", "text")
    return drop_repeated_lines(documents).select("doc_id", "n_lines", "n_removed", "text")


@query("op9_toxicity")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return score_toxicity(parquet(spark, sf, "documents"), parquet(spark, sf, "labels"))


@query("op11_collocations", f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({LOWER.replace('text', "coalesce(text, '')")},
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM pieces, range(1, 4) AS sizes(k))
  GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut
  FROM counts WHERE k > 1),
scored AS (
  SELECT c.lang, c.k, c.phrase, a, cut, l.f AS l, r.f AS r,
    (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[:cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(f) AS around FROM (
    SELECT lang, f, string_split(phrase, ' ') AS w, unnest([1, 2]) AS i FROM counts WHERE k = 3)
  GROUP BY ALL),
kept AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best b LEFT JOIN inside USING (lang, phrase) WHERE coalesce(100 * around < 50 * a, true))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n,
  score::BIGINT AS score
FROM kept JOIN totals USING (lang) WHERE rank <= 2000
""")  # fmt: skip
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return mine_collocations(parquet(spark, sf, "documents"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by their id, repeats its own words from a place on.

    A NULL text or id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    g = documents.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    start = F.col("g") % n
    placed = g.filter("size(w) > 0").select(
        "doc_id", "w", start.cast("int").alias("a"),
        (1 + F.floor((n - start) / (3 + F.col("g") % 8))).cast("int").alias("p"),
    )
    again = F.transform(
        F.sequence(F.col("a"), F.size("w") - 1),
        lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")),
    )
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    rest = g.filter("w IS NULL OR size(w) = 0").select("doc_id", "text")
    return placed.select("doc_id", text.alias("text")).unionByName(rest)


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = find_runs(with_planted_runs(parquet(spark, sf, "documents")))
    # of equal exponents the first stays: runs are in the order of start, then period
    best = F.aggregate(
        "runs", F.get("runs", 0),
        lambda held, run: F.when(
            run["length"] * held["period"] > held["length"] * run["period"], run
        ).otherwise(held),
    )
    lines = F.transform(
        "runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    )
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_quality_outliers")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return judge_quality(parquet(spark, sf, "documents"))
