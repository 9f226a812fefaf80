"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.llm import decontaminate, embeddings, langid, licenses, minhash, packing, pii, quality, urls, warc


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark, sf_dir):
    got = pii.annotate(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda x: x["kind"].isin(pii.KINDS))

    def n(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return got.select("doc_id", *map(n, pii.KINDS), F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op2_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(langid.remainder("doc_id", 4) == 2, F.lit(False))
    profiles = langid.learn(docs.where(~held))
    got = langid.identify(docs, profiles, ["doc_id"])
    return got.select("doc_id", F.coalesce(langid.remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark, sf_dir):
    got = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_licenses(spark, sf_dir):
    got = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op8_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), ["page_id"])


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(langid.remainder("doc_id", 5) != 0)
    model = quality.train(docs, labels)
    got = quality.score(docs, model, ["doc_id"])
    return got.select("doc_id", F.coalesce(langid.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_minhash, op3_embeddings, op4_warc, op5_langid, op6_decontaminate, op7_licenses, op8_urls, op9_quality, op10_packing)}

_WORDS = r"list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP2 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
t AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) k FROM d),
cls AS (SELECT min(doc_id) rep, k, len(k) n FROM t WHERE len(k) > 0 GROUP BY k),
x AS (SELECT rep, n, unnest(k) g FROM cls),
p AS (SELECT a.rep u, b.rep v, a.n nu, b.n nv, count(*) c FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT u, v FROM p WHERE 100 * c >= 75 * (nu + nv - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT rep node, rep label FROM cls UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.node WHERE r.label < e.v),
c AS (SELECT node, min(label) component FROM r GROUP BY node)
SELECT t.doc_id, CAST(len(t.k) AS BIGINT) n_shingles, coalesce(c.component, t.doc_id) component_id, coalesce(c.component, t.doc_id) = t.doc_id kept
FROM t LEFT JOIN cls ON t.k = cls.k LEFT JOIN c ON c.node = cls.rep
"""

_OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) n, sha256(coalesce(html, '')) digest FROM pages),
f AS (SELECT digest, min(page_id) first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) payload_bytes, p.digest payload_digest, CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END record_type,
CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END refers_to FROM p LEFT JOIN f ON p.digest = f.digest
"""

_OP6 = f"""
WITH b AS (SELECT item_id, {_WORDS.format('text')} w FROM benchmark), d AS (SELECT doc_id, row_number() OVER () r, {_WORDS.format('text')} w FROM documents),
g AS (SELECT DISTINCT item_id, m, g FROM (SELECT item_id, least(len(w), 10) m, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) g FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM g),
x AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) i FROM d, sizes WHERE len(w) >= m)),
h AS (SELECT r, i, x.m, item_id FROM x JOIN g ON x.g = g.g AND x.m = g.m),
n AS (SELECT r, count(DISTINCT q) n_hit FROM (SELECT r, unnest(range(i, i + m)) q FROM h) GROUP BY r),
t AS (SELECT r, count(*) n_items, string_agg(t, ',' ORDER BY t) ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) t FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

ORACLE = {"op2_minhash": _OP2, "op4_warc": _OP4, "op6_decontaminate": _OP6}
