"""The registered queries of this subpackage and the SQL that DuckDB can run beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import Steps, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Words of a text for DuckDB: split at runs of 0x20 and 0x09-0x0D, blanks dropped.
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def register(sql: str | None = None) -> Callable:
    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[query.__name__] = query
        if sql is not None:
            SQL[query.__name__] = sql
        return query
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(sql=rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE len(w) WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM docs),
classes AS (SELECT min(doc_id) AS cid, any_value(s) AS s FROM (
    SELECT doc_id, s, md5(array_to_string(list_sort(s), '|')) AS h FROM sets WHERE len(s) > 0) GROUP BY h),
members AS (SELECT x.doc_id, c.cid FROM
    (SELECT doc_id, md5(array_to_string(list_sort(s), '|')) AS h FROM sets WHERE len(s) > 0) x
    JOIN (SELECT cid, md5(array_to_string(list_sort(s), '|')) AS h FROM classes) c USING (h)),
freq AS (SELECT t, count(*) AS f FROM (SELECT unnest(s) AS t FROM classes) GROUP BY t),
tokens AS (SELECT cid, t, len_s, row_number() OVER (PARTITION BY cid ORDER BY f, t) AS r FROM
    (SELECT cid, len(s) AS len_s, unnest(s) AS t FROM classes) JOIN freq USING (t)),
prefix AS (SELECT cid, t, len_s FROM tokens WHERE r <= len_s - ceil(0.8 * len_s) + 1),
cand AS (SELECT DISTINCT a.cid AS a, b.cid AS b FROM prefix a JOIN prefix b ON a.t = b.t AND a.cid < b.cid
    AND 100 * least(a.len_s, b.len_s) >= 80 * greatest(a.len_s, b.len_s)),
links AS (SELECT a, b FROM cand JOIN classes x ON x.cid = a JOIN classes y ON y.cid = b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT cid, cid FROM classes UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id,
  coalesce(r.root, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN members m ON m.doc_id = s.doc_id LEFT JOIN roots r ON r.node = m.cid
""")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept")


@register(sql=rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS k, {WORDS} AS w FROM documents),
starts AS (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
windows AS (SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS j FROM windows JOIN often USING (h)),
lost AS (SELECT k, list(j) AS js FROM gone GROUP BY k),
kept AS (SELECT doc_id, w, coalesce(len(js), 0) AS r, coalesce(js, []::BIGINT[]) AS js FROM docs LEFT JOIN lost USING (k)),
marked AS (SELECT doc_id, w, r, map_from_entries(list_transform(js, lambda j: {{'k': j, 'v': true}})) AS m FROM kept)
SELECT doc_id, len(w)::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(
  list_filter(w, lambda x, i: m[i] IS NULL), ' ')) AS kept_sha256 FROM marked
""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.substring import remove_repeats

    words = F.trim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "))
    with Steps(spark, "repeats") as steps:
        rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), steps, length=35)
        return materialize(rows.select("doc.doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256")))


@register()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gleaner.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False,
                encode_special_tokens=False)


@register()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.rules import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "votes", "posterior")


@register()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 3, 1, 0.7)


@register()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 5, 0, 0.3)


@register()
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.decontaminate import find_leaks

    rows = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc.doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@register()
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.sharding import shuffle_to_shards

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_to_shards(docs, 8).select("doc.*", F.lit("rows").alias("law"), "shard", "slot",
                                             F.lit(None).cast("int").alias("grown_shard"))


@register(sql="""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


@register()
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.html_crf import main_text

    return main_text(table(spark, sf_dir, "pages"))


def _dearer(weight: str, cost: str, letter: str) -> str:
    """A path's text of twelve digits of cost and then its audit, one edit longer."""
    return f"lpad((({weight})[1:12]::BIGINT + {cost})::VARCHAR, 12, '0') || ({weight})[13:] || '{letter}'"


_GOOD = "f NOT IN ('blank', 'duplicate')"
_KEPT = "CASE WHEN f = 'truncated' THEN 5 ELSE 0 END"


@register(sql=rf"""
WITH RECURSIVE bits AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8),
    lambda v, b: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) r(i))),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT raw.*, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind FROM raw, bits),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending, left(role, 1) AS s FROM damaged),
faulty AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f,
  lag(s) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
paths(conv_id, i, w0, w1, w2, w3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000000', NULL::VARCHAR, '000000000005I', NULL::VARCHAR FROM conversations
  UNION ALL
  SELECT conv_id, i, w0, w1, least(w2, {_dearer("least(w0, w1, w3)", "5", "I")}), least(w3, {_dearer("w2", "5", "I")}) FROM (
    SELECT p.conv_id, p.i + 1 AS i, {_dearer("w0", "2", "D")} AS w0,
      least({_dearer("w1", "2", "D")}, CASE WHEN {_GOOD} AND s = 's' THEN {_dearer("w0", _KEPT, "K")} END) AS w1,
      least({_dearer("w2", "2", "D")}, CASE WHEN {_GOOD} AND s = 'u' THEN {_dearer("least(w0, w1, w3)", _KEPT, "K")} END,
        CASE WHEN {_GOOD} THEN {_dearer("least(w0, w1, w3)", f"1 + {_KEPT}", "R")} END) AS w2,
      least({_dearer("w3", "2", "D")}, CASE WHEN {_GOOD} AND s = 'a' THEN {_dearer("w2", _KEPT, "K")} END,
        CASE WHEN {_GOOD} THEN {_dearer("w2", f"1 + {_KEPT}", "R")} END) AS w3
    FROM paths p JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)),
best AS (SELECT conv_id, max_by(least(w0, w3), i) AS w FROM paths GROUP BY conv_id),
edits AS (SELECT r.*, replace(w[13:], 'I', '')[r.i] AS edit FROM faulty r JOIN best b ON r.conv_id IS NOT DISTINCT FROM b.conv_id),
roles AS (SELECT *, CASE WHEN edit <> 'R' THEN role WHEN coalesce(sum((edit <> 'D' AND NOT (edit = 'K' AND s = 's'))::INT) OVER (
    PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0
    THEN 'user' ELSE 'assistant' END AS new_role FROM edits),
stats AS (SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
  count(*) FILTER (f = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || s NOT IN ('su', 'ua', 'au')) AS illegal,
  string_agg(new_role || ':' || text, chr(10) ORDER BY i) FILTER (edit <> 'D') AS repaired FROM roles GROUP BY conv_id)
SELECT b.conv_id, coalesce(n_rows, 0)::BIGINT AS n_rows, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  w[1:12]::BIGINT AS cost, w[13:] AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM best b LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM b.conv_id
""")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.conversations import damage, find_repairs, repair_digests

    rows = damage(table(spark, sf_dir, "conversations"))
    with Steps(spark, "repairs") as steps:
        return materialize(repair_digests(rows, steps.keep(find_repairs(rows))))


@register(sql="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1),
    lambda i: q.x[i] * c.x[i])), 0)::BIGINT AS score FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored) WHERE rank <= 20
""")
def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.topk import top_k
    from gleaner.llm.vectors import whole_vectors

    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), 64)
    with Steps(spark, "search") as steps:
        return materialize(top_k(vectors, F.col("vec_id") % 20 == 0, 20, steps))


@register()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.vectors import whole_vectors
    from gleaner.llm.whitening import whiten

    # The contract's + 100000 shifts rows and mean alike: what is centred, and so every column, stays the same.
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), 1024)
    with Steps(spark, "whitening") as steps:
        return materialize(whiten(vectors, 8, steps))
