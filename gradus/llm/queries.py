"""The registered queries of the training-data operators, with production parameters over whole
tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import backoff, decontam, dialogue, langid, mixing, ngram_join, periodic, perplexity, pii, tokens, toxicity, urls, vectors
from gradus.llm.common import scratch_path, table

TOKENIZER, END_ID = "word_bpe_49k.json", 1
PII_KEY = b"gradus demonstration key"  # a deployment passes its own secret
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op1_pseudonyms")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_documents(table(spark, sf_dir, "documents"), PII_KEY, keep=["doc_id"])


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    graded = toxicity.sample_labels(labels.where("toxic is not null").select("doc_id", F.col("toxic").alias("grade")))
    model = toxicity.fit(docs, graded, severity_levels=3)
    if model is None:  # nothing to tell grades apart by
        return docs.select("doc_id", F.lit(0.0).alias("expected_severity"), F.lit(0).alias("grade"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("toxic"))
    return toxicity.predict(docs, model, keep=["doc_id"])


@query("op4_perplexity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")  # trusted: labelled good, and nowhere bad
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    return perplexity.judge(table(spark, sf_dir, "documents"), (), trusted_ids=good)


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = langid.fit(docs.where(~held_out()))
    p = langid.predict(docs, trees, keep=["doc_id"])
    return p.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op6_decontamination", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT item_id, w, least(13, len(w)) AS k FROM i) WHERE k > 0)),
dw AS (SELECT r, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hit AS (SELECT r, p, k, item_id FROM dw JOIN iw USING (k, s)),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS x FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.digest(found).drop("spans")


@query("op7_url_filter", """
WITH RECURSIVE pg AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
refs AS (
  SELECT DISTINCT url AS from_url, r AS ref FROM (
    SELECT url, unnest(list_concat(
      list_transform(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
      list_transform(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)))) AS r
    FROM pages WHERE contains(url, '://')) WHERE r <> ''),
links AS (
  SELECT DISTINCT from_url, CASE WHEN contains(ref, '://') THEN ref WHEN starts_with(ref, '//') THEN regexp_replace(sch, '//$', '') || ref
    WHEN starts_with(ref, '/') THEN sch || ho || ref ELSE sch || ho || regexp_replace(pa, '[^/]*$', '') || ref END AS to_url
  FROM (SELECT from_url, ref, regexp_extract(from_url, '(?s)^(.*?://)', 1) AS sch, regexp_extract(from_url, '(?s)^.*?://([^/?#]*)', 1) AS ho,
               regexp_extract(from_url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS pa FROM refs)),
urls AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         regexp_extract(regexp_extract(url, '(?s)^[^#]*', 0), '(?s)\\?(.*)$', 1) AS q
  FROM (SELECT url FROM pages UNION SELECT to_url FROM links) WHERE contains(url, '://')),
rules(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ruled AS (
  SELECT url, action, rh || rp AS rule FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rh || rp) DESC, action) = 1),
nodes AS (
  SELECT url, regexp_replace(host, '^(?:www|m)\\.', '') || regexp_replace(path, '(?:/index\\.html?|\\.html?|/+)$', '') ||
    CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS node
  FROM (SELECT *, coalesce(array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|ref)(?:=|$)')), '&'), '') AS kept FROM urls)),
edges AS (SELECT a.node AS x, b.node AS y FROM links JOIN nodes a ON from_url = a.url JOIN nodes b ON to_url = b.url),
both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach(node, other) AS (SELECT DISTINCT node, node FROM nodes UNION SELECT node, y FROM reach JOIN both_ways ON other = x),
class AS (SELECT node, min(other) AS class FROM reach GROUP BY node),
decided AS (SELECT class, max(action = 'allow') AS class_allow FROM ruled JOIN nodes USING (url) JOIN class USING (node) GROUP BY class)
SELECT page_id, pg.host, pg.path, rule, coalesce(action, CASE WHEN class_allow THEN 'allow' WHEN NOT class_allow THEN 'block' END, 'allow') AS verdict
FROM pg LEFT JOIN ruled USING (url) LEFT JOIN nodes USING (url) LEFT JOIN class USING (node) LEFT JOIN decided USING (class)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op8_near_vectors", """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
       WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS x, b.r AS y, b.vec_id AS other FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
         AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
comp AS (SELECT x, min(vec_id) AS component_id FROM reach JOIN v ON y = r GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN deg ON v.r = deg.x LEFT JOIN comp ON v.r = comp.x
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_token_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, path = table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), tokenizer_path()
    tokens.write_tokens(docs, folder, path, END_ID)
    return tokens.read_tokens(tokens.row_keys(docs), folder, tokens.id_type(path)).drop("k")


@query("op10_poisson_mix", """
WITH RECURSIVE s AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source),
t AS (SELECT sum(size) AS total, sum(pow(size, 0.7)) AS total_w FROM s),
r AS (SELECT source, 1.0::DOUBLE * total * pow(size, 0.7) / total_w / size AS rate FROM s, t),
c(source, rate, k, p, c) AS (SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
u AS (SELECT row_number() OVER () AS r, doc_id, text, lang, source, n_chars, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.r, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.c <= u.u GROUP BY u.r)
SELECT doc_id, text, lang, source, n_chars, n::INT AS n_copies, copy::INT AS copy, md5('17-order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS mix_key
FROM (SELECT u.*, n.n, unnest(range(1, n.n + 1)) AS copy FROM u JOIN n USING (r))
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


@query("op5_ngram_join", """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT r, w, least(3, len(w)) AS k FROM d) WHERE k > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_ AS (SELECT a.r AS x, b.r AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
link AS (SELECT x, y FROM both_ JOIN n nx ON x = nx.r JOIN n ny ON y = ny.r WHERE 100 * m >= 90 * (nx.n + ny.n - m)),
reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
comp AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN d ON y = r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN comp ON d.r = comp.x
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults dealt by a hash of their key."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text, role = blank("text"), blank("role")
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(role)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return dialogue.repair(damaged(talks), ids=talks.select("conv_id"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.run_digests(docs, ["doc_id"], change=periodic.planted, by="doc_id")


@query("op12_backoff_score")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    s = backoff.score_texts(table(spark, sf_dir, "documents"), ~held, ["doc_id"])
    return s.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
