"""The operators over whole tables with production parameters, and SQL of those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import (
    collocations,
    decontamination,
    language_id,
    lm_scoring,
    packing,
    prefix_trie,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    token_files,
    warc,
)
from hirelake.llm.tokens import public_vocabulary
from hirelake.operators.skew import heavy_keys, left_join_default
from hirelake.sources.staging import stage

VOCABULARY = "byte_bpe_50k.json"
CAPACITY, PACKING_END, FILE_END = 2048, 1, 2
SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, public_vocabulary(VOCABULARY), CAPACITY, PACKING_END)


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    rows = sharding.with_slots(placed).withColumn("law", F.lit("key"))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.learn(docs, ~language_id.held_out(F.col("doc_id")))
    labelled = language_id.label(docs, model)
    return labelled.select(
        "doc_id",
        language_id.held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        "score",
        F.size("spans").cast("long").alias("n_spans"),
    )


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("failed_rule")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_files.read(token_files.write(docs, public_vocabulary(VOCABULARY), FILE_END))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), public_vocabulary(VOCABULARY))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Numbered turns (see `prefix_trie.digested`) of conversations that begin with the first turns of every fifth one."""
    own = turns.filter("position = 1").select("conv_id", F.col("of").alias("n"))
    own = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % 9, "base": F.col("conv_id") - F.col("conv_id") % 5})
    of_base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    n_head = F.least("h", F.coalesce("n_base", F.lit(0)))
    own = own.join(of_base, "base", "left").withColumn("n_head", n_head)
    own = own.withColumn("of", F.col("n_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    head = turns.filter("position <= 8").select(F.col("conv_id").alias("base"), "position", "t1", "t2", "n_bytes")
    head = own.select("conv_id", "base", "h", "of").join(head, "base").filter("position <= h").drop("base", "h")
    heavy = heavy_keys(turns, {"conv": ["conv_id"]})["conv"]
    rest = left_join_default(turns.drop("of"), own.select("conv_id", "h", "n_head", "of"), ["conv_id"], heavy=heavy, salt_by=["position"])
    rest = rest.filter("position > h").withColumn("position", F.col("position") - F.col("h") + F.col("n_head")).drop("h", "n_head")
    turnless = own.filter("of = 0").select("conv_id", *[F.lit(None).cast("bigint").alias(c) for c in ("position", "of", "t1", "t2", "n_bytes")])
    return head.unionByName(rest).unionByName(turnless)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stage(prefix_trie.digested(_table(spark, sf_dir, "conversations")), "conversation-turns")
    whole = stage(rebuilt(turns), "rebuilt-turns")
    return prefix_trie.trie(whole.filter("position IS NOT NULL"), whole.filter("position IS NULL").select("conv_id"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents")).withColumnRenamed("label", "lang")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_vocabulary(VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_harmonic_packing,
        op2_rendezvous_sharding,
        op3_benchmark_decontamination,
        op4_language_id,
        op5_quality_cascade,
        op6_token_files,
        op7_warc_bundles,
        op8_substring_dedup,
        op9_simhash_near_dedup,
        op10_stupid_backoff,
        op11_conversation_trie,
        op12_phrase_collocations,
        op13_token_counts,
    )
}


def _score(shard: int) -> str:
    digits = f"('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/{shard}'), 1, 13))::BIGINT"
    return f"ln(({digits} + 0.5) / CAST({16**13} AS DOUBLE))"


def _best(shards: int) -> str:
    scores = ", ".join(_score(s) for s in range(shards))
    return f"CAST(list_position([{scores}], greatest({scores})) - 1 AS INTEGER)"


_PLACED = f"""
WITH byte_values AS (SELECT range AS b FROM range(256)),
 step AS (SELECT b, b AS r FROM byte_values),
 crc_table AS (SELECT list(r ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || range(8), lambda r, k:
   CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END) AS r FROM step)),
 body AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
 summed AS (SELECT doc_id, strlen(text) AS bytes,
   xor(list_reduce([4294967295] || list_transform(range(strlen(text)), lambda i:
     ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda acc, b: xor(t[xor(acc, b) % 256 + 1], acc >> 8)), 4294967295) AS crc
  FROM body, crc_table),
 placed AS (SELECT doc_id, bytes + 1 AS size, crc AS text_crc32, {_best(SHARDS)} AS shard, {_best(SHARDS + 1)} AS grown_shard
  FROM summed)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
 row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM placed"""

_LEADS5 = " || ' ' || ".join(f"lead(word, {k}) OVER p" for k in range(1, 5))


def _shingles(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, shingle FROM (
  SELECT {key}, word || ' ' || {_LEADS5} AS shingle FROM (
   SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM {table}) WINDOW p AS (PARTITION BY {key} ORDER BY i)
  UNION ALL SELECT {key}, array_to_string(w, ' ') FROM {table} WHERE len(w) BETWEEN 1 AND 4) WHERE shingle IS NOT NULL"""


_CONTAINED = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
 short AS (SELECT DISTINCT len(w) AS s FROM b WHERE len(w) BETWEEN 1 AND 4),
 words AS (SELECT doc_id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM d WHERE EXISTS (FROM short)),
 runs AS (SELECT doc_id, [w1, lead(w1, 1) OVER p, lead(w1, 2) OVER p, lead(w1, 3) OVER p] AS w FROM words
  WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
 ds AS ({_shingles("d", "doc_id")} UNION SELECT doc_id, array_to_string(list_slice(w, 1, s), ' ') FROM runs, short WHERE w[s] IS NOT NULL),
 bs AS ({_shingles("b", "item_id")}),
 n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM ds JOIN bs USING (shingle) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item
HAVING 10 * count(*) >= 8 * n_item"""

_LEADS8 = " || ' ' || ".join(f"lead(word, {k}) OVER p" for k in range(1, 8))
_SEPARATED = r"[^\x20\x09-\x0D]"
_JUDGED = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, regexp_extract_all(t, '{_SEPARATED}+') AS w,
   list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_SEPARATED}')) AS lines FROM d),
 grams AS (SELECT doc_id, i, word || ' ' || {_LEADS8} AS g FROM (
   SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w) WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
 twice AS (SELECT doc_id, g FROM grams WHERE g IS NOT NULL GROUP BY doc_id, g HAVING count(*) > 1),
 covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (doc_id, g), range(8) r(k) GROUP BY doc_id),
 m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
   len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
   coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper,
   len(regexp_extract_all(t, '!!')) AS n_bangs FROM w LEFT JOIN covered USING (doc_id)),
 j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_upper > 3 * word_chars OR 10 * n_bangs > n_words
  OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept FROM j"""

_RECORDS = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
 r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS rep FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN rep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN rep <> page_id THEN rep END AS refers_to FROM r"""

_TRIE = """
WITH crc_table AS (SELECT list(r ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || range(8), lambda r, k:
   CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END) AS r FROM (SELECT range AS b FROM range(256)))),
 o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM o GROUP BY conv_id),
 h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce([4294967295] || list_transform(range(length(s)), lambda i:
   CAST(ascii(substr(s, i + 1, 1)) AS BIGINT)), lambda acc, b: xor(t[xor(acc, b) % 256 + 1], acc >> 8)), 4294967295) % 9 AS h
   FROM c, crc_table),
 head AS (SELECT h.conv_id, i AS pos, role, text FROM h JOIN o ON o.conv_id = base AND i <= h),
 n AS (SELECT conv_id, count(*) AS n_head FROM head GROUP BY conv_id),
 r AS (SELECT * FROM head UNION ALL SELECT conv_id, i - h + coalesce(n_head, 0), role, text
   FROM h JOIN o USING (conv_id) LEFT JOIN n USING (conv_id) WHERE i > h),
 keyed AS (SELECT conv_id, pos, strlen(text) AS b, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM r
   UNION ALL SELECT conv_id, 0, 0, [] FROM h),
 path AS (SELECT conv_id, pos, b, min(conv_id) OVER (PARTITION BY key) AS m, max(pos) OVER (PARTITION BY conv_id) AS last FROM keyed),
 nodes AS (SELECT m, pos, count(*) AS n_convs, any_value(b) AS b,
   string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE pos = last) AS ids FROM path GROUP BY m, pos),
 up AS (SELECT nodes.*, q.m AS pm FROM nodes LEFT JOIN path q ON q.conv_id = nodes.m AND q.pos = nodes.pos - 1),
 kids AS (SELECT pm AS m, pos - 1 AS pos, count(*) AS n_children FROM up WHERE pos > 0 GROUP BY 1, 2),
 x AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (m, pos)),
 sub AS (SELECT q.m, q.pos, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * x.b) AS saved
   FROM x JOIN path q ON q.conv_id = x.m AND q.pos <= x.pos GROUP BY q.m, q.pos)
SELECT x.m AS conv_id, x.pos AS depth, pm AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
 CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM x JOIN sub USING (m, pos)"""

_PIECES = ".,;:!?" + "".join(map(chr, range(10, 14)))

_COLLOCATIONS = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
   translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
 p AS (SELECT row, lang, unnest(string_split(translate(t, '{_PIECES}', repeat(chr(10), {len(_PIECES)})), chr(10))) AS piece FROM d),
 w AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
 one AS (SELECT id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
 n AS (SELECT lang, count(*) AS n FROM one GROUP BY lang),
 grams AS (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4
   FROM one WINDOW o AS (PARTITION BY id ORDER BY i)),
 f AS (SELECT lang, w, count(*) AS a FROM (SELECT lang, [w1] AS w FROM grams
   UNION ALL SELECT lang, [w1, w2] FROM grams WHERE w2 IS NOT NULL
   UNION ALL SELECT lang, [w1, w2, w3] FROM grams WHERE w3 IS NOT NULL
   UNION ALL SELECT lang, [w1, w2, w3, w4] FROM grams WHERE w4 IS NOT NULL) GROUP BY lang, w HAVING count(*) >= 30),
 c AS (SELECT * FROM f WHERE len(w) > 1),
 cuts AS (SELECT c.lang, c.w, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
   FROM c JOIN range(1, 4) t(k) ON k < len(c.w) JOIN f l ON l.lang = c.lang AND l.w = list_slice(c.w, 1, k)
   JOIN f r ON r.lang = c.lang AND r.w = list_slice(c.w, k + 1, len(c.w))),
 low AS (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS place FROM cuts),
 inner_ AS (SELECT lang, list_slice(w, i, i + s - 1) AS w, max(a) AS most FROM c JOIN range(2, 4) t(s) ON s < len(w)
   JOIN range(1, 4) u(i) ON i + s - 1 <= len(w) GROUP BY ALL),
 kept AS (SELECT low.lang, array_to_string(low.w, ' ') AS phrase, a, l, r, n.n, CAST(score AS BIGINT) AS score
   FROM low JOIN n ON n.lang = low.lang LEFT JOIN inner_ ON inner_.lang = low.lang AND inner_.w = low.w
   WHERE place = 1 AND NOT coalesce(100 * most >= 80 * a, false)),
 ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
   phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000"""

ORACLES: dict[str, str] = {
    "op2_rendezvous_sharding": _PLACED,
    "op3_benchmark_decontamination": _CONTAINED,
    "op5_quality_cascade": _JUDGED,
    "op7_warc_bundles": _RECORDS,
    "op11_conversation_trie": _TRIE,
    "op12_phrase_collocations": _COLLOCATIONS,
}
