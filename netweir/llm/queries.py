"""The corpus operators as queries over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

import corpus_pipeline
from netweir.llm import chat, decontaminate, html_text, infill, mixing, ngram_filter, ordinal, quality_rules, records, simhash, spelling, substrings, urls
from netweir.llm.common import shared_folder, table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function
    return keep


@query(r"""
WITH w AS (SELECT doc_id, rid, w[1] IS NOT NULL AS any_word, w FROM (SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)),
i AS (SELECT item_id, w FROM (SELECT item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark)),
ds AS (SELECT DISTINCT doc_id, rid, array_to_string(w[k:k + 4], ' ') AS s FROM (
    SELECT doc_id, rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
si AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (
    SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item::DOUBLE AS containment
FROM ds JOIN si USING (s) JOIN n USING (item_id) GROUP BY doc_id, rid, item_id, n_item HAVING count(*) >= 0.8 * n_item""")
def op1_benchmark_leaks(spark, sf):
    return decontaminate.leaking_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op2_robust_quality(spark, sf):
    judged = quality_rules.judge(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"__counts.{c}").alias(c) for c in counts], F.col("__verdict.failed").alias("base_failed"),
                         F.col("__verdict.kept").alias("kept"), F.col("__verdict.distance").alias("distance"))


@query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations),
s AS (SELECT t.conv_id, perspective, place, place // 64 AS piece, role = perspective AS own,
    CASE WHEN role = perspective THEN '<|assistant|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head,
    text || chr(10) || '<|end|>' || chr(10) AS tail FROM t JOIN p USING (conv_id)),
o AS (SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, perspective ORDER BY place) AS upto FROM s)
SELECT conv_id, perspective, piece, min(place) AS first_turn, count(*) AS n_turns, count(*) FILTER (own) AS n_own_turns,
    (min(upto - length(head) - length(tail)))::BIGINT AS begin, string_agg(head || tail, '' ORDER BY place) AS rendered,
    string_agg((upto - length(tail))::BIGINT || '-' || upto::BIGINT, ',' ORDER BY place) FILTER (own) AS masks,
    sum(length(tail)) FILTER (own)::BIGINT AS n_masked
FROM o GROUP BY conv_id, perspective, piece""")
def op3_chat_perspectives(spark, sf):
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return chat.perspectives(table(spark, sf, "conversations")).withColumn("masks", spans)


@query()
def op4_line_blocks(spark, sf):
    found = html_text.extract(table(spark, sf, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS w,
    (3 * source_size)::DOUBLE AS most FROM s0),
s2 AS (SELECT *, most / w AS ratio FROM s1),
s3 AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s0) - (sum(most) OVER (ORDER BY ratio, skey) - most))
    / (sum(w) OVER () - sum(w) OVER (ORDER BY ratio, skey) + w) AS level FROM s2),
lv AS (SELECT level FROM s3 WHERE ratio >= level ORDER BY ratio, skey LIMIT 1),
tg AS (SELECT skey, source_size, least(most, coalesce(w * (SELECT level FROM lv), most)) AS target FROM s3),
need AS (SELECT *, ceil(source_size / 128.0)::BIGINT AS blocks, target * ceil(source_size / 128.0) / source_size AS need
    FROM tg WHERE source_size > 0),
cum AS (SELECT *, round(sum(need) OVER (ORDER BY skey) / (SELECT sum(need) FROM need) * 2147483648)::BIGINT AS hi FROM need),
rng AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY skey), 0) AS lo FROM cum),
pts AS (SELECT i AS slot, (i % 2147483648) * 1327217885 % 2147483648 AS x
    FROM range((SELECT round(sum(need))::BIGINT FROM need)) t(i)),
slots AS (SELECT skey, blocks, row_number() OVER (PARTITION BY skey ORDER BY slot) - 1 AS rk FROM pts JOIN rng ON x >= lo AND x < hi),
uses AS (SELECT skey, rk % blocks AS block, count(*) AS uses FROM slots WHERE rk // blocks < 3 GROUP BY ALL),
pos AS (SELECT *, sum(size) OVER (PARTITION BY skey ORDER BY md5('17|' || coalesce(doc_id::VARCHAR, '')), doc_id, size
    ROWS UNBOUNDED PRECEDING) - size AS b, row_number() OVER () AS rid FROM d WHERE size > 0),
parts AS (SELECT *, unnest(range((b // 128)::BIGINT, ((b + size - 1) // 128 + 1)::BIGINT)) AS block FROM pos),
tk AS (SELECT rid, sum((least(b + size, (block + 1) * 128) - greatest(b, block * 128)) * coalesce(uses, 0))::BIGINT AS taken
    FROM parts LEFT JOIN uses USING (skey, block) GROUP BY rid)
SELECT doc_id, size, source_size, target, taken FROM pos JOIN tk USING (rid) JOIN tg USING (skey)
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM d JOIN tg USING (skey) WHERE size = 0"""


@query(MIX_SQL)
def op5_source_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op6_repeated_substrings(spark, sf):
    return substrings.remove_repeats(table(spark, sf, "documents"), digest=True)


@query()
def op7_token_records(spark, sf):
    import public_tokenizers
    path, index = shared_folder(spark, "records"), shared_folder(spark, "record-index")
    records.write_records(table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return records.write_index(spark, path, index).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "file", "offset", "length")


@query()
def op8_ordinal_quality(spark, sf):
    docs = table(spark, sf, "documents")
    grade = F.when(F.col("toxic") == 1, 0).otherwise(F.lit(1) + F.col("quality"))
    model = ordinal.fit(docs, table(spark, sf, "labels").select("doc_id", grade.alias("grade")))
    return ordinal.score(docs, model, ["doc_id"]).withColumn("kept", F.col("tail_probability") >= 0.6)


@query()
def op9_simhash_trie(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (SELECT host, path, max(lpad(length(h || p)::VARCHAR, 6, '0') || CASE v WHEN 'block' THEN '1' ELSE '0' END || h || p) AS b
    FROM (SELECT DISTINCT host, path FROM u) x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, substr(b, 8) AS rule, CASE WHEN substr(b, 7, 1) = '1' THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN best USING (host, path)""")
def op10_url_rules(spark, sf):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf, "pages"), rules, ["page_id"])


@query(r"""
WITH d AS (SELECT coalesce(text, '') AS t, doc_id, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
    ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM u),
p AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, coalesce(array_to_string(w[1:a], ''), '') AS prefix,
    coalesce(array_to_string(w[a + 1:b], ''), '') AS middle, coalesce(array_to_string(w[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""")
def op11_fill_in_middle(spark, sf):
    rows = infill.restore(infill.fill_in_middle(table(spark, sf, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


@query()
def op12_spelling_variants(spark, sf):
    return spelling.spelling_groups(table(spark, sf, "documents"), drop=31)


@query()
def op13_ngram_filter_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = ngram_filter.learn(docs.where(ngram_filter.training("doc_id")))
    return ngram_filter.score(docs, model).withColumns({
        "held_out": ~ngram_filter.training("doc_id"), "train_tokens": F.lit(model.tokens).cast("long")})


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
