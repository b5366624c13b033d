"""op1 to op13: each operator over its whole table, with the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents, stored
from .queries import query

# Fixed rules of the URL query: (verdict, host and path prefix).
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
# Where no rule fits: hosts with a name part that begins with "spam-".
URL_BLOCKED = ("spam-~/*", "~.spam-~/*", "spam-~", "~.spam-~")

OP4_SQL = rf"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
fits AS (
  SELECT p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM parts p LEFT JOIN rules r
    ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))
  GROUP BY ALL)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(^|\.)spam-') THEN 'block' ELSE 'allow' END) AS verdict
FROM fits
"""


@query("op4_url_filter", OP4_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, URL_RULES, URL_BLOCKED).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = rf"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (last IS NOT NULL AND doc_id <> last)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM lines LEFT JOIN often USING (key) GROUP BY doc_id
"""


@query("op5_line_dedup", OP5_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
placed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM by_source),
sorted AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) - 1 AS at FROM placed),
levels AS (  -- with the first k sources clamped: what is left for the weights that are left
  SELECT k.at AS k, (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM placed) - coalesce(sum(2 * s.source_size) FILTER (s.at < k.at), 0)::DOUBLE AS remaining,
         sum(s.weight) FILTER (s.at >= k.at) AS free, min(2 * s.source_size / s.weight) FILTER (s.at >= k.at) AS next
  FROM sorted k, sorted s GROUP BY k.at),
level AS (SELECT remaining, free FROM levels WHERE remaining / free < next ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, least(weight * remaining / free, (2 * source_size)::DOUBLE) AS target FROM placed, level),
keyed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS copies,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('7|' || s.doc_id || '|' || s.size) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN ahead + size / 2 <= target - copies * source_size AND ahead < target - copies * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM keyed
"""


@query("op2_mix_sources", OP2_SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources, word_count

    sized = documents(spark, sf_dir).select("doc_id", "source", word_count("text").alias("words"))
    mixed = mix_sources(stored(sized, "words"), weights=(5, 2, 1), share=1.5, max_epochs=2, size="words")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


PLANTED = r"\### Assistant: </turn> ok"

OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (SELECT *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') AS body,
                 replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') AS head FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(head) + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op9_chat_format", OP9_SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import chain, format_trees, read_loss, read_turns

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, :said AS text UNION ALL SELECT -7L, 1L, 'assistant', :said", args={"said": PLANTED})
    trees = chain(rows.union(planted), "conv_id", "turn", "role", "text")
    out = format_trees(trees, "conv_id").withColumns({"turns": read_turns("formatted"), "said": read_loss("formatted", "loss")})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_quality_ratio")
def op3_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_ratio import quality_filter

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = quality_filter(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_languages

    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    return identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    pieces = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_pivot_search")
def op8_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_search import search

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP10_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
numbered AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split),
windows AS (SELECT doc_id, words[i:i + 12] AS win, i FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM split WHERE len(words) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
starts AS (SELECT doc_id, i FROM windows JOIN firsts USING (win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM starts, generate_series(0, 12) AS g(k)),
kept AS (SELECT n.doc_id, n.i, n.word, g.i IS NOT NULL AS removed FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i)
SELECT s.doc_id, coalesce(len(s.words), 0)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN (SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS text FROM kept GROUP BY doc_id) k USING (doc_id)
"""


@query("op10_substring_dedup", OP10_SQL)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    docs = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op1_jaccard_join")
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), width=3, percent=90)


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


# crc32 bit by bit: a byte of the decimal id enters before the first of its eight steps.
OP12_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
hashed AS (
  SELECT doc_id, words, len(words) AS n,
         xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
             lambda c, x: xor(xor(c, x) // 2, CASE WHEN xor(c, x) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h
  FROM split),
placed AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM hashed WHERE h % 10 = 0 AND n > 0),
looped AS (
  SELECT doc_id, list_transform(range(0, n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS words FROM placed
  UNION ALL SELECT doc_id, words FROM hashed WHERE h % 10 <> 0 OR n = 0),
windows AS (SELECT doc_id, i, words[i + 1:i + 16] AS win FROM (SELECT doc_id, words, unnest(range(0, len(words) - 15)) AS i FROM looped WHERE len(words) >= 24)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.win = y.win AND y.i > x.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q AS period, min(i) AS start, max(i) - min(i) + 16 + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(period) AS period FROM stretches WHERE length >= greatest(24, 3 * period) GROUP BY doc_id, start, length),
best AS (SELECT doc_id, start, length, period, row_number() OVER (PARTITION BY doc_id ORDER BY (length * 1000000000000) // period DESC, start, period) AS place FROM runs),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM looped) w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT s.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
       (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM split s LEFT JOIN listed l ON s.doc_id = l.doc_id LEFT JOIN (SELECT * FROM best WHERE place = 1) b ON s.doc_id = b.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id
"""


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which the texts of a tenth of the ids repeat a part of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("__words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    n, g = F.size("__words"), F.floor(h / 10)
    docs = docs.withColumns({"__n": n, "__a": (g % n).cast("int"), "__k": (3 + g % 8).cast("int")})
    period = F.expr("CAST(1 + (__n - __a) DIV __k AS INT)")
    loop = F.flatten(F.array_repeat(F.slice("__words", F.col("__a") + 1, period), F.col("__k")))
    text = F.array_join(F.slice(F.concat(F.slice("__words", F.lit(1), F.col("__a")), loop), F.lit(1), F.col("__n")), " ")
    return docs.select("doc_id", F.when(F.col("__n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs", OP12_SQL)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import collapse_runs

    docs = collapse_runs(looped(documents(spark, sf_dir).select("doc_id", "text")), min_length=24, min_exponent=3)
    # of runs with one exponent the list has the first start and period first
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.reduce("runs", F.get("runs", F.lit(0)), better)
    docs = docs.withColumns({"best": best, "n_runs": F.size("runs").cast("long"), "lines": F.array_join(lines, "")})
    return docs.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) DIV best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


OP13_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (SELECT lang, k, words[i:i + k - 1] AS gram FROM (SELECT lang, words, k, unnest(generate_series(1, len(words) - k + 1)) AS i FROM worded, generate_series(1, 5) AS g(k) WHERE len(words) >= k)),
f AS (SELECT lang, k, gram, count(*) AS a FROM grams GROUP BY lang, k, gram HAVING count(*) >= 100),
cuts AS (SELECT lang, k, gram, a, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.gram, c.k, c.cut, c.a, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.gram = c.gram[1:c.cut] JOIN f y ON y.lang = c.lang AND y.gram = c.gram[c.cut + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
inside AS (SELECT DISTINCT lang, gram[i:i + m - 1] AS gram, a FROM (SELECT lang, gram, a, m, unnest(generate_series(1, k - m + 1)) AS i FROM f, generate_series(2, 4) AS g(m) WHERE m < k)),
kept AS (SELECT b.*, array_to_string(b.gram, ' ') AS phrase FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside s WHERE s.lang = b.lang AND s.gram = b.gram AND 100 * s.a >= 100 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(documents(spark, sf_dir).select("doc_id", "lang", "text"), longest=5, min_count=100, absorb=100, top=2000)
