"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat, mixing, ngram_join, packing, quality_classifier, quality_rules, sidecar, suffix_tree, top_k, url_filters, warc

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def prepare(spark: SparkSession) -> None:
    """A checkpoint folder where none is set, as in tests; a cluster names a shared one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints/graphloom")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows to an Arrow batch than Spark's 10,000, for long texts pass whole through several stages' workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(divisor: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor, F.lit(-1))


URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Pages that are also linked to with these parameters are listed.
TRACKING = r"[?&](utm_[a-z]+|ref)="


def op1_bloom_cascade_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.filter_urls(spark, pages, pages.where(F.col("url").rlike(TRACKING)), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    bool_or(coalesce(regexp_matches(url, '[?&](utm_[a-z]+|ref)='), false)) OVER (PARTITION BY host || path) AS listed FROM h
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = quality_classifier.train(docs, labels, crc_of_id(3) != 1)
    scored = quality_classifier.score(docs.select("doc_id", "text"), network)
    return scored.select("doc_id", (crc_of_id(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_vector_approximation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = top_k.whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    vocabulary, ranks = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    return chat.read_back(chat.format_windows(told.unionByName(more), budget=1024, tokens=lambda written: len(packing.encode(written, vocabulary, ranks))))


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_of_id(10) == 0
    scored = suffix_tree.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.measured_with_verdict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def chat_window_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the windows: all of op5 but their length."""
    return op5_budgeted_chat_windows(spark, sf_dir).drop("formatted_chars")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256 FROM d
"""


def quality_rule_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the rules: all of op7 but the verdict."""
    return op7_quality_rules(spark, sf_dir).drop("kept")


MEASURES_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g WHERE n > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
"""


def op8_partenum_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE
    WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op9_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.spread_of(F.col("doc_id"), F.col("text")).alias("spread"))
    drawn = mixing.copies(sized, F.col("size"), F.col("source"), spread=F.col("spread"))
    return drawn.select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("size")).alias("taken"))


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = warc.write(pages, sidecar.new_folder(spark, "warc"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH d AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS least FROM d
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(5 * i // 4 + 1 AS BIGINT), 2) AS INTEGER) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN least IS NULL OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN least <> coalesce(page_id, least - 1) THEN least END AS refers_to
FROM r
"""


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 8) AS BIGINT) AS spread FROM documents
), c AS (
  SELECT *, length(bin(size)) AS class FROM d
), k AS (
  SELECT *, spread % CAST(ceil(count(*) OVER (PARTITION BY source, class) / 1000.0) AS BIGINT) AS salt FROM c
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS stop FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(stop, max(level) OVER () * weight) AS target,
    CAST(CAST('0x' || substr(sha256('17:' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift FROM l
), r AS (
  SELECT doc_id, size, source_size, target, shift, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY k.source ORDER BY class, salt, size, doc_id NULLS FIRST, spread) AS n
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(floor(n * rate + shift) - floor((n - 1) * rate + shift) AS BIGINT) * size AS taken FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_bloom_cascade_url_filter, op2_quality_classifier, op3_vector_approximation_search, op4_sum_of_squares_packing, op5_budgeted_chat_windows,
        op6_suffix_tree_scores, op7_quality_rules, op8_partenum_ngram_join, op9_systematic_mixing, op10_warc_segments,
        chat_window_digests, quality_rule_measures,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op1_bloom_cascade_url_filter": OP1_SQL, "op3_vector_approximation_search": OP3_SQL, "op8_partenum_ngram_join": OP8_SQL, "op9_systematic_mixing": OP9_SQL, "op10_warc_segments": OP10_SQL, "chat_window_digests": CHAT_SQL, "quality_rule_measures": MEASURES_SQL}
