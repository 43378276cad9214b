"""The operators as named queries over whole tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.llm import (
    bpe_trie, classlm, collocations, idfiles, jaccard_join, merge_dropout, packing, quality, secret_scan, substring_dedup,
    term_stages, token_count, topk,
)
from fedlens.llm.common import documents
from fedlens.session import workspace
from fedlens.sources.tables import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_count.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    return token_count.count_tokens(spark, documents(spark, sf_dir), tokens)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.measure(spark, documents(spark, sf_dir))
    return quality.judged(spark, stats, fit_on=stats).select(F.col("doc_id").cast("long"), "quality.*")


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    encoded = merge_dropout.encode_documents(spark, documents(spark, sf_dir), model, rate=0.1, seed=20240)
    return merge_dropout.digests(spark, encoded, model)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scanned(spark, documents(spark, sf_dir), owner="source", repository="doc_id"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.scored(spark, documents(spark, sf_dir))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", factor=64)
    return topk.top_k(spark, vectors, F.col("vec_id") % 20 == 0, k=20)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), window=2048)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(spark, documents(spark, sf_dir), size=3, percent=90)


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "id-files")
    idfiles.write_ids(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"))
    return idfiles.digests(idfiles.read_ids(spark, path))


TOPK_SQL = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), usual AS (SELECT len(v) AS n FROM vectors GROUP BY len(v) ORDER BY count(*) DESC, n LIMIT 1
), alike AS (SELECT r, vec_id, v FROM vectors JOIN usual ON len(v) = n
), scored AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM alike q JOIN alike c ON q.vec_id % 20 = 0 AND c.r <> q.r
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(spark, documents(spark, sf_dir), span=13)


#: The assignment pattern with both cases of every letter spelled out.
ASSIGN_SQL = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRET_SQL = r"""
WITH kinds(k, kind, least) AS (VALUES (0, 'assign', 6), (1, 'access', 20), (2, 'hex', 24), (3, 'owned', 20)), texts AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT r, doc_id, source, 0 AS k, string_split_regex(text, '{assign}') AS gaps,
         regexp_extract_all(text, '{assign}', 0) AS wholes,
         regexp_extract_all(text, '{assign}', 2) AS vals
  FROM texts
  UNION ALL SELECT r, doc_id, source, 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM texts
  UNION ALL SELECT r, doc_id, source, 2, string_split_regex(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}') FROM texts
  UNION ALL SELECT r, doc_id, source, 3, string_split_regex(text, '[A-Za-z0-9_+/-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9_+/-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9_+/-]{20,}') FROM texts
), placed AS (
  SELECT r, doc_id, source, k, i, wholes[i] AS whole, vals[i] AS val,
         list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(wholes[1:i - 1], lambda g: length(g))), 0) AS "at"
  FROM (SELECT *, unnest(range(1, len(wholes) + 1)) AS i FROM parts)
), spans AS (
  SELECT p.r, p.doc_id, p.source, p.k, kind, CAST("at" AS BIGINT) AS beg, CAST("at" + length(whole) AS BIGINT) AS til, val
  FROM placed p JOIN kinds USING (k) WHERE length(val) >= least
), base AS (SELECT * FROM spans WHERE k < 3),
more AS (
  SELECT * FROM spans g WHERE k = 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
    AND len(list_distinct(string_split(val, ''))) >= 10
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = g.r AND b.beg < g.til AND g.beg < b.til)
), each AS (SELECT * FROM base UNION ALL SELECT * FROM more),
owners AS (SELECT val, count(DISTINCT coalesce(source, chr(0))) AS n_owners FROM each GROUP BY val),
judged AS (SELECT e.*, n_owners, kind || ':' || beg || ':' || til AS span FROM each e JOIN owners USING (val) WHERE k < 3 OR n_owners = 1),
summed AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         coalesce(string_agg(span, ',' ORDER BY beg, k) FILTER (k < 3), '') AS base_spans, string_agg(span, ',' ORDER BY beg, k) AS spans,
         count(*) FILTER (n_owners >= 3) AS n_copied, count(*) FILTER (n_owners = 1) AS n_single_owner
  FROM judged GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_copied, 0) AS n_copied, coalesce(n_single_owner, 0) AS n_single_owner
FROM texts LEFT JOIN summed USING (r)
""".replace("{assign}", ASSIGN_SQL)

def op11_term_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_stages.search(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=10)


SEARCH_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), words AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '{term}')) AS term FROM texts),
counts AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY r),
total AS (SELECT count(*) AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_terms FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM counts, total GROUP BY term
), items AS (
  SELECT row_number() OVER () AS i, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM benchmark
), asked AS (SELECT i, item_id, unnest(regexp_extract_all(t, '{term}')) AS term FROM items),
summed AS (
  SELECT i, item_id, c.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN counts c USING (term) JOIN weights USING (term) JOIN lengths l ON l.r = c.r, total
  GROUP BY i, item_id, c.r, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM summed WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
""".replace("{term}", term_stages.TERM_SQL)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, documents(spark, sf_dir), support=30, longest=4, inside_percent=80, top=2000)


PHRASE_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[p : p + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM split, (SELECT unnest(range(1, 5)) AS size))
), freq AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE size > 1 AND f >= 30),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scores AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = lp JOIN freq y ON y.lang = c.lang AND y.phrase = rp
), lowest AS (SELECT lang, phrase, a, l, r, score FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(w[p : p + part - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - part + 2)) AS p FROM candidates, (SELECT unnest([2, 3]) AS part) WHERE part < size)
), most AS (SELECT lang, phrase, max(a) AS m FROM inner_phrases GROUP BY ALL),
kept AS (
  SELECT c.* FROM lowest c LEFT JOIN most m ON m.lang = c.lang AND m.phrase = c.phrase
  WHERE m.m IS NULL OR 100::HUGEINT * m.m < 80::HUGEINT * a
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM kept JOIN total USING (lang)
) WHERE rank <= 2000
"""


def op13_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digests(spark, documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_merge_dropout": op3_merge_dropout,
    "op4_secret_scan": op4_secret_scan,
    "op5_class_lm": op5_class_lm,
    "op6_exact_topk": op6_exact_topk,
    "op7_packing": op7_packing,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_id_files": op9_id_files,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_term_stages": op11_term_stages,
    "op12_collocations": op12_collocations,
    "op13_bpe_trie": op13_bpe_trie,
}
SQL: dict[str, str] = {"op4_secret_scan": SECRET_SQL, "op6_exact_topk": TOPK_SQL, "op11_term_stages": SEARCH_SQL, "op12_collocations": PHRASE_SQL}
