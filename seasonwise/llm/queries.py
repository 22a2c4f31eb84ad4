"""The operators on the given tables, with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonwise.llm import (embedding_dedup, hnsw, html_text, language, minhash, packing,
                            periodic_runs, pseudo_likelihood, secrets, sentencepieces,
                            token_counts, url_filters, whitening)
from seasonwise.llm.common import read

QUERIES = {}
# Queries that SQL can express, by exact sets and distances and a recursion over links.
REACH = """reach AS (SELECT a AS node, b AS other FROM links
          UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
lowest AS (SELECT node, min(other) AS other FROM reach GROUP BY node)"""
SQL = {
    "op2_minhash_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4
         THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2),
         lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
{REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
       least(doc_id, coalesce(other, doc_id)) AS component_id,
       doc_id <= coalesce(other, doc_id) AS kept
FROM sets LEFT JOIN lowest ON node = doc_id""",
    "op7_embedding_dedup": f"""
WITH RECURSIVE points AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM points a JOIN points b USING (label)
  WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        AND list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)
            * list_inner_product(b.v, b.v)) >= 0.98),
{REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
       least(vec_id, coalesce(other, vec_id)) AS component_id,
       vec_id <= coalesce(other, vec_id) AS kept
FROM embeddings LEFT JOIN lowest ON node = vec_id""",
}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), "word_bpe_49k.json")


@query
def op8_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), "byte_bpe_50k.json", window=2048,
                        end_id=1)


@query
def op10_sentencepieces(spark, sf_dir):
    return sentencepieces.digests(read(spark, sf_dir, "documents"), "piece_bpe_32k.model")


@query
def op2_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op4_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs, per_language=1000))


@query
def op7_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.98)


@query
def op1_nearest_neighbours(spark, sf_dir):
    return hnsw.nearest(read(spark, sf_dir, "embeddings"), every=20, k=20)


@query
def op3_html_text(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages"))


@query
def op6_secrets(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents")).drop("row", "value")


@query
def op5_pseudo_likelihood(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = pseudo_likelihood.fit(docs)
    return pseudo_likelihood.score(docs, model, rows=model.rows)


@query
def op11_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=16)


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
             ("com/fr/", "allow"), ("com/de/", "block")]


@query
def op12_url_filters(spark, sf_dir):
    table = url_filters.rules(spark, URL_RULES, [(p, "block") for p in url_filters.PATTERNS])
    return url_filters.judge(read(spark, sf_dir, "pages"), table)


SQL["op12_url_filters"] = f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3)
         ELSE '' END AS rest FROM pages),
places AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules AS (
  SELECT split_part(rule, '/', 1) AS host, substr(rule, instr(rule, '/')) AS path, rule, verdict
  FROM (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)}) t(rule, verdict)),
best AS (
  SELECT page_id, p.url, p.host, p.path,
         (SELECT arg_max(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule))
          FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host))
                             AND starts_with(p.path, r.path)) AS hit
  FROM places p)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN regexp_matches(url,
  '(^|[^0-9a-z])({"|".join(p.strip("^").replace("^", "[^0-9a-z]") for p in url_filters.PATTERNS)
  })([^0-9a-z]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM best"""


def _repeated(docs: DataFrame) -> DataFrame:
    """Documents, one in ten with its words from one place on replaced by a repetition.

    With h = crc32(doc_id) and g = floor(h / 10): if h % 10 = 0, word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"),
                                                     F.lit(1)))
    docs = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
    size = F.when(F.size("w") > 0, F.size("w"))
    docs = docs.select("*", size.alias("n"), (F.col("g") % size).alias("a")).select(
        "*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    place = "cast(if(i < a, i, a + (i - a) % p) as int)"
    text = F.expr(f"array_join(transform(sequence(0, n - 1), i -> w[{place}]), ' ')")
    return docs.select("doc_id", F.when(F.col("n").isNotNull(), text).otherwise(
        F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs.find_runs(_repeated(read(spark, sf_dir, "documents")),
                                    least_words=6, least_repeats=4)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"),
        (-r["period"]).alias("period"))))
    lines = F.expr("array_join(transform(runs, r -> "
                   "concat(concat_ws(',', r.start, r.length, r.period), '\\n')), '')")
    rows = found.withColumn("best", longest)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
