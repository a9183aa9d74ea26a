"""The corpus operators as registered queries, with production parameters, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saccade.llm import decontaminate, fill_middle, lexical_search, line_dedup, mixing, ngram_join, quality, sharding, substring_dedup, suffix_dedup, token_counts, token_output, toxicity
from saccade.llm.common import read, shared_dir


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "place")


OP1_SQL = """
WITH RECURSIVE c AS (SELECT coalesce('s' || source, 'none') AS src, count(*) AS n FROM documents GROUP BY 1),
sh AS (SELECT src, greatest(CAST(round(1000 * pow(n, 0.5) / sum(pow(n, 0.5)) OVER ()) AS BIGINT), 1) AS e FROM c),
one AS (SELECT list(e ORDER BY src) AS es, CAST(sum(e) AS BIGINT) AS p FROM sh),
num AS (SELECT src, e, row_number() OVER (ORDER BY src) AS i FROM sh),
run(t, done, pick) AS (
  SELECT CAST(0 AS BIGINT), list_transform(es, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM one
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: CASE WHEN i = pk THEN d + 1 ELSE d END), pk FROM (
    SELECT t, done, list_sort(list_filter(list_transform(range(1, len(es) + 1),
      lambda i: {'due': ((done[i] + 1) * p + es[i] - 1) // es[i], 'i': i, 'rel': (done[i] * p) // es[i]}), lambda s: s.rel <= t))[1].i AS pk
    FROM run, one WHERE t < p)),
s AS (SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM run WHERE pick IS NOT NULL),
d AS (SELECT doc_id, source, coalesce('s' || source, 'none') AS src,
  row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents)
SELECT doc_id, source, r // 64 AS block, ((r // 64) // e) * p + slot AS slot, CAST(r % 64 AS INTEGER) AS place
FROM d JOIN num USING (src) CROSS JOIN one JOIN s ON s.i = num.i AND s.k = (r // 64) % e
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (SELECT rid, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM (
    SELECT rowid AS rid, string_split(coalesce(text, ''), chr(10)) AS a FROM (SELECT row_number() OVER () AS rowid, text FROM documents))),
k AS (SELECT *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
r AS (SELECT rid, count(*) AS n_lines, count(f.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '') AS kept FROM k LEFT JOIN f USING (key) GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM r JOIN (SELECT row_number() OVER () AS rid, doc_id FROM documents) USING (rid)
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.score(docs).select("doc_id", *quality.BASE, "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('h' || source, 'none') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
m AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM m, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
l AS (SELECT rid, host, t, pos, line FROM (SELECT rid, host, t, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM (SELECT *, string_split(t, chr(10)) AS a FROM d)) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid),
n AS (SELECT rid, host, t, pos, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
  trim(translate(lower(line), chr(9) || chr(11) || chr(12) || chr(13), '    ')) AS key FROM l),
sk AS (SELECT DISTINCT host, md5(t) AS m, list_sort(list_transform(list_distinct(w), lambda x: md5(x)))[1:32] AS s FROM w),
o AS (SELECT DISTINCT host, key, md5(t) AS m FROM n),
many AS (SELECT host, key, count(*) AS docs, min(m) AS hub FROM o GROUP BY host, key HAVING count(*) > 10),
far AS (SELECT host, key, docs, count(*) AS others FROM many JOIN o USING (host, key) JOIN sk AS a ON a.host = o.host AND a.m = o.m JOIN sk AS b ON b.host = o.host AND b.m = hub
  WHERE 5 * len(list_intersect(a.s, b.s)) < 4 * greatest(len(a.s), len(b.s)) GROUP BY host, key, docs),
f AS (SELECT host, key FROM far WHERE 8 * (others + 1 - 10) > docs - others - 1),
gone AS (SELECT rid, sum(words) AS gone FROM n SEMI JOIN f USING (host, key) GROUP BY rid),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(gone, 0) AS BIGINT) AS rest
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rest >= 50 AND rest >= 0.3 * n_words AS kept FROM b
"""


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start", "n_bytes", "n_chunks", "first_id", "is_first")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    rows = decontaminate.decontaminate(docs, items)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM b)),
g AS (SELECT rid, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
m AS (SELECT rid, s, k, item_id FROM g JOIN win USING (k, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.shard(read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards")
    t = F.coalesce(F.col("text"), F.lit(""))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length(t).cast("long").alias("n_bytes"), F.md5(t).alias("text_md5"), F.col("_shard").isNotNull().alias("in_manifest"))


OP7_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS text_md5, true AS in_manifest FROM documents
"""


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    token_output.write_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path("word_bpe_49k.json"))
    rows = token_output.read_tokens(spark, path)
    return rows.select("doc_id", "start", "n_tokens", token_output.ids_crc32("token_ids").alias("ids_crc32"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.drop_repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT row_number() OVER () AS iid, item_id, list_distinct(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark),
q AS (SELECT iid, unnest(w) AS term FROM b),
z AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), z),
m AS (SELECT rid, doc_id, 100 - 90 + ((90 * CAST(len(w) AS BIGINT) * n) // l) AS m FROM d, z WHERE len(w) > 0),
i AS (SELECT rid, doc_id, term, f.w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS v FROM p JOIN f USING (term) JOIN m USING (rid)),
s AS (SELECT iid, rid, any_value(doc_id) AS doc_id, CAST(sum(v) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY iid, rid)
SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s JOIN b USING (iid) WHERE score > 0 QUALIFY rank <= 10
"""


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_token_output": op8_token_output,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_fill_middle": op12_fill_middle,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES: dict[str, str] = {"op1_mixing": OP1_SQL, "op3_line_dedup": OP3_SQL, "op6_decontamination": OP6_SQL, "op7_sharding": OP7_SQL, "op9_quality": OP9_SQL, "op12_fill_middle": OP12_SQL, "op13_lexical_search": OP13_SQL}
