"""Registered queries over the corpus tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, htmltext, infill, jaccard, mixing, periodic, pieces, quality, suffix, urlfilter, vectors, warc
from millrace.session import small_batches, stage_path, table

#: Fixed values of the contract: action, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Fixed values of the contract: weights of sources in code-point order, repeating.
MIX_WEIGHTS = (5, 2, 1)
#: Words of a passage whose repetition op5 reports beside the strings of the contract.
PASSAGE_WORDS = 50
#: Folder of public tokenizers, unless ``MILLRACE_TOKENIZERS`` names another; and the model of op13.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id")))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = jaccard.join_similar(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "class_size", "keeper")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage_words=PASSAGE_WORDS, keep_text=False)


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    field = warc.header_field
    return warc.check_records(spark, path).select(
        warc.page_of("WARC-Record-ID").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        field("WARC-Type").alias("record_type"),
        warc.page_of("WARC-Refers-To").cast("long").alias("refers_to"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)


def repeated_tail(doc_id: Column, words: Column) -> Column:
    """The words of a text, of every tenth text (by crc32 of the id) with a tail that repeats a short stretch."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    at = (g % n).cast("int")
    period = (1 + F.floor((n - at) / (3 + g % 8))).cast("int")
    times = (F.floor((n - at) / period) + 1).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, at + 1, period), times))
    return F.when((h % 10 == 0) & (n > 0), F.slice(F.concat(F.slice(words, F.lit(1), at), tail), F.lit(1), n.cast("int"))).otherwise(words)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("words"))
    found = periodic.find_runs(docs.select("doc_id", F.array_join(repeated_tail(F.col("doc_id"), F.col("words")), " ").alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    exponent = F.floor(1000 * length / period)
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    made = infill.rearrange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model: str = "") -> DataFrame:
    small_batches(spark)
    vocabulary = pieces.load(model or f"{TOKENIZERS}/{PIECE_MODEL}")
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, packed=True)
    decoded = pieces.decode(encoded.drop("text"), vocabulary)
    n_tokens = F.floor(F.octet_length("ids") / 4).alias("n_tokens")
    return decoded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_url_filters": op2_url_filters,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_source_mixing": op4_source_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc_archive": op6_warc_archive,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_html_extraction": op8_html_extraction,
    "op9_exact_topk": op9_exact_topk,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_sentencepiece": op13_sentencepiece,
}

SQL_OP3 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (
  SELECT r, array_to_string(list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) END)), chr(10)) AS grams
  FROM d WHERE len(w) > 0),
c AS (SELECT min(r) AS c, grams, count(*) AS docs FROM g GROUP BY grams),
s AS (SELECT c, docs, unnest(string_split(grams, chr(10))) AS gram FROM c),
n AS (SELECT c, docs, count(*) AS n FROM s GROUP BY c, docs),
p AS (SELECT a.c AS a, b.c AS b, count(*) AS same FROM s a JOIN s b ON a.gram = b.gram AND a.c <> b.c GROUP BY a.c, b.c),
l AS (SELECT a, b, y.docs FROM p JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE same * 5 >= (x.n + y.n - same) * 4),
t AS (SELECT c AS a, c AS b FROM c UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b),
m AS (SELECT a AS c, min(b) AS class FROM t GROUP BY a),
k AS (SELECT c, sum(docs) AS linked FROM (SELECT a AS c, docs FROM l) GROUP BY c),
f AS (
  SELECT g.r, class, coalesce(linked, 0) + docs - 1 AS n_links FROM g JOIN c USING (grams) JOIN m USING (c) LEFT JOIN k USING (c)),
o AS (SELECT doc_id, f.n_links, CASE WHEN class IS NULL THEN -d.r ELSE class END AS class FROM d LEFT JOIN f USING (r))
SELECT doc_id, min(doc_id) OVER (PARTITION BY class) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links,
  count(*) OVER (PARTITION BY class)::BIGINT AS class_size, doc_id = min(doc_id) OVER (PARTITION BY class) AS keeper
FROM o
"""

SQL_OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (SELECT r, n_bytes, [h[2 * z + 1 : 2 * z + 2000] for z in range(0, n_bytes, 600)] AS parts FROM d),
x AS (SELECT r, k, hash(parts[k // 600 + 1][2 * (k % 600) + 1 : 2 * (k % 600) + 800]) AS v FROM (SELECT r, parts, unnest(range(0, n_bytes - 399)) AS k FROM b)),
y AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY v) AS n FROM x) WHERE n > 1),
i AS (SELECT r, k, CASE WHEN k - lag(k) OVER (PARTITION BY r ORDER BY k) <= 400 THEN 0 ELSE 1 END AS fresh FROM y),
j AS (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING) AS span FROM i),
u AS (SELECT r, span, min(k) AS a, max(k) + 400 AS z FROM j GROUP BY r, span),
g AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM u),
c AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(z) AS last FROM u GROUP BY r),
kept AS (SELECT r, string_agg(h[2 * before + 1 : 2 * a], '' ORDER BY a) AS head FROM g JOIN d USING (r) GROUP BY r),
pw AS (SELECT r, s, array_to_string(w[s : s + 49], ' ') AS v FROM (SELECT r, w, unnest(range(1, len(w) - 48)) AS s FROM d)),
pt AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY v) AS n FROM pw) WHERE n > 1),
pn AS (SELECT r, count(DISTINCT s + z) AS n FROM pt, (SELECT unnest(range(50)) AS z) GROUP BY r)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || h[2 * coalesce(last, 0) + 1 :])) AS kept_sha256, coalesce(n, 0)::BIGINT AS n_passage_words
FROM d LEFT JOIN c USING (r) LEFT JOIN kept USING (r) LEFT JOIN pn USING (r)
"""

SQL_OP4 = r"""
WITH d AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(doc_id::VARCHAR) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (
  SELECT *,
    (sum(source_size) OVER () * 150 - coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 200)::BIGINT AS spare,
    (sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM w),
f AS (SELECT *, source_size * 200 * rest > spare * w AS free FROM l),
t AS (
  SELECT source, source_size,
    CASE WHEN free THEN (w * max(CASE WHEN free THEN {'rest': rest, 'spare': spare} END) OVER ()['spare'])::DOUBLE
                        / (max(CASE WHEN free THEN rest END) OVER () * 100)::DOUBLE
         ELSE (source_size * 2)::DOUBLE END AS target
  FROM f),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT size, (cum + r * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(r) WHERE size > 0),
r AS (SELECT finish, sum(size) OVER (ORDER BY finish RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM i),
c AS (SELECT coalesce(max(finish), 0.0) AS cut FROM r WHERE run <= (SELECT sum(size) * 150 // 100 FROM d))
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN (CASE WHEN cum::DOUBLE / target <= cut THEN size ELSE 0 END)
                        + (CASE WHEN (cum + source_size)::DOUBLE / target <= cut THEN size ELSE 0 END) ELSE 0 END::BIGINT AS taken
FROM q, c
"""

SQL_OP6 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, payload, sha1(payload) AS x,
         min(page_id) OVER (PARTITION BY payload) AS lead
  FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform([0, 1, 2, 3], lambda g: array_to_string(list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 1 + 10 * g, 10))::BIGINT >> (5 * j)) & 31) + 1)::BIGINT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM h
"""

SQL_OP7 = r"""
WITH p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
c AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS turns,
    string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10)
      || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1| >', 'g') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
  FROM p GROUP BY conv_id)
SELECT conv_id, n AS n_turns, text, length(text)::BIGINT AS n_chars FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.n > a.n AND b.turns[1 : a.n] = a.turns)
  AND NOT EXISTS (SELECT 1 FROM c b WHERE b.n = a.n AND b.turns = a.turns AND b.conv_id < a.conv_id)
"""

SQL_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

SQL_OP10 = r"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
br AS (SELECT row_number() OVER () AS br, item, w FROM b WHERE len(w) > 0),
d AS (
  SELECT doc_id, row_number() OVER () AS dr, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT br, item, n, o, array_to_string(w[o : o + n - 1], ' ') AS win
  FROM (SELECT br, item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS o FROM br)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT dr, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT dr, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
m AS (SELECT dr, s, dw.n, br, item, o FROM dw JOIN bw USING (n, win)),
hit AS (SELECT dr, count(DISTINCT p) AS n_hit FROM (SELECT dr, unnest(range(s, s + n)) AS p FROM m) GROUP BY dr),
it AS (SELECT dr, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT dr, item FROM m WHERE item IS NOT NULL) GROUP BY dr),
runs AS (
  SELECT dr, count(*) + any_value(n) - 1 AS words, min(s) - 1 AS start
  FROM (SELECT dr, br, s - o AS line, s, n, s - row_number() OVER (PARTITION BY dr, br, s - o ORDER BY s) AS island FROM m)
  GROUP BY dr, br, line, island),
lg AS (SELECT dr, max(words) AS words, min(start) FILTER (words = most) AS start FROM (SELECT *, max(words) OVER (PARTITION BY dr) AS most FROM runs) GROUP BY dr)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(words, 0)::BIGINT AS longest_match, start::BIGINT AS longest_start
FROM d LEFT JOIN hit USING (dr) LEFT JOIN it USING (dr) LEFT JOIN lg USING (dr)
"""

SQL_OP11 = r"""
WITH RECURSIVE c AS (
  SELECT row_number() OVER () AS dr, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (
  SELECT dr, range(256)::UINTEGER[] AS t, 0 AS r FROM (SELECT 0 AS dr)
  UNION ALL SELECT dr, list_transform(t, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UINTEGER) ELSE x >> 1 END), r + 1 FROM b WHERE r < 8),
h AS (
  SELECT dr, doc_id, w, len(w)::BIGINT AS n,
    xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UINTEGER)),
      lambda s, x: xor(s >> 8, t[xor(s & 255, x) + 1])), 4294967295::UINTEGER)::BIGINT AS h
  FROM c, (SELECT t FROM b WHERE r = 8)),
a AS (SELECT dr, doc_id, w, n, h % 10 = 0 AND n > 0 AS turned, CASE WHEN n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS k FROM h),
d AS (
  SELECT dr, doc_id, n, CASE WHEN turned THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + k)) END + 1]) ELSE w END AS w
  FROM a),
x AS (SELECT dr, unnest(w) AS word, unnest(range(n)) AS i FROM d),
l AS (
  SELECT 1::BIGINT AS size, dr, i, hash(word) AS v FROM x
  UNION ALL
  SELECT size * 2, dr, i, hash(v, y) FROM (SELECT size, dr, i, v, lead(v, size) OVER (PARTITION BY dr ORDER BY i) AS y FROM l) WHERE y IS NOT NULL AND size < 1048576),
q AS (SELECT size, dr, i, lead(i) OVER (PARTITION BY size, dr, v ORDER BY i) - i AS period FROM l),
s AS (SELECT size, dr, i, period, i - row_number() OVER (PARTITION BY size, dr, period ORDER BY i) AS island FROM q WHERE period <= size AND period > size // 2),
r AS (
  SELECT dr, min(i) AS start, count(*) + size + period - 1 AS length, period FROM s GROUP BY size, dr, period, island
  HAVING count(*) + size + period - 1 >= greatest(6, 4 * period)),
g AS (
  SELECT dr, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS best
  FROM r GROUP BY dr),
o AS (SELECT DISTINCT dr, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT dr, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN o USING (dr, i) GROUP BY dr)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
  (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN g USING (dr) LEFT JOIN k USING (dr)
"""

SQL_OP12 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x
  FROM documents),
h AS (SELECT doc_id, text, w, len(w)::BIGINT AS n, list_transform([0, 1, 2, 3], lambda k: ('0x' || substr(x, 1 + 8 * k, 8))::BIGINT) AS h FROM t),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, array_to_string(w[1 : a], '') AS prefix, array_to_string(w[a + 1 : b], '') AS middle, array_to_string(w[b + 1 :], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

ORACLES = {"op3_ngram_jaccard_join": SQL_OP3, "op5_suffix_dedup": SQL_OP5, "op4_source_mixing": SQL_OP4, "op6_warc_archive": SQL_OP6, "op7_chat_formatting": SQL_OP7, "op9_exact_topk": SQL_OP9, "op10_decontamination": SQL_OP10, "op11_periodic_runs": SQL_OP11, "op12_fill_in_middle": SQL_OP12}
