"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import centroids, collocations, dedup, jaccard, lengths, licences, packing, pieces, pii, quality, secret_scan, token_files, toxicity
from flowlake.llm.common import stored, table
from flowlake.session import new_folder

#: Length of the packed sequences.
SEQUENCE = 2048


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(table(spark, sf_dir, "documents"), SEQUENCE), SEQUENCE)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    rows = token_files.checksums(token_files.read_tokens(spark, path))
    return token_files.with_starts(rows, spark, path)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(lengths.length_counts(table(spark, sf_dir, "documents")), "lengths")
    return lengths.histogram(counts)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.col("doc_id").cast("string"))
    found = licences.scan(table(spark, sf_dir, "documents").select(path.alias("path"), "text"))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "*")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = collocations.phrase_counts(table(spark, sf_dir, "documents"))
    return collocations.collocations(counts)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(centroids.cluster(table(spark, sf_dir, "embeddings")), spark)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_packing, op2_exact_dedup, op3_token_files, op4_pii, op5_jaccard_join, op6_sentencepiece, op7_toxicity, op8_quality_rules, op9_token_counts,
                                   op10_licences, op11_collocations, op12_centroids, op13_secrets)}

_TEXTS = "SELECT doc_id, lang, coalesce(text, '') AS text FROM documents"


def _quality_sql() -> str:
    steps = quality.vectors()
    lost = ", ".join("count(*) FILTER (WHERE NOT base_failed AND (" + " OR ".join(
        f"coalesce({e} > {v[r]}, false)" for r, (e, _) in quality.RULES.items()) + f")) AS k{i}" for i, v in enumerate(steps))
    tries = " UNION ALL ".join(f"SELECT lang, n, {i} AS step, k{i} AS k FROM counted" for i in range(len(steps)))
    failed = ", ".join(f"CASE WHEN {e} > ([{', '.join(str(v[r]) for v in steps)}])[failed_step] THEN '{r}' END"
                       for r, (e, _) in sorted(quality.RULES.items()))
    rate, error = quality.RATE, quality.ERROR
    return rf"""
    WITH t AS ({_TEXTS}),
    w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t)),
    five AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d) AS run
             FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(w, 4) OVER d IS NOT NULL),
    again AS (SELECT doc_id, i FROM five QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, range(5) x(o) GROUP BY doc_id),
    m AS (SELECT t.doc_id, lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
                 length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '[!?]+')) AS n_loud,
                 len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
                 len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_different,
                 coalesce(c.n, 0) AS n_repeat_words
          FROM t LEFT JOIN covered c ON c.doc_id = t.doc_id),
    c AS MATERIALIZED (SELECT *, n_lines - n_different AS n_dup_lines,
                 n_words < {quality.FEWEST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m),
    counted AS MATERIALIZED (SELECT lang, count(*) AS n, {lost} FROM c
                WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang),
    tests AS ({tries}),
    tested AS (SELECT lang, step, k < n * {rate} AND list_sum(list_transform(range(0, k + 1), lambda j:
               exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - lgamma(n - j + 1) + j * ln({rate}) + (n - j) * ln(1 - {rate}))))
               <= {error} / (SELECT count(*) FROM counted) AS passes FROM tests),
    -- list positions start at 1, so the step before the first failed one stands at the failed one's number
    chosen AS MATERIALIZED (SELECT lang, coalesce(min(step) FILTER (WHERE NOT passes), {len(steps)}) AS failed_step FROM tested GROUP BY lang),
    judged AS (SELECT c.*, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed
               FROM c LEFT JOIN chosen ON chosen.lang IS NOT DISTINCT FROM c.lang AND failed_step > 0)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules FROM judged"""


_COLLOCATION_SQL = rf"""
    WITH p AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
           SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
           FROM documents)),
    g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) s(k) WHERE len(w) >= k)),
    f AS MATERIALIZED (SELECT lang, k AS size, phrase, count(*) AS f FROM g GROUP BY ALL),
    t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND f >= 30),
    cuts AS (SELECT c.*, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
             FROM c, range(1, 4) s(k) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
                  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ') WHERE k < c.size),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    hidden AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
               FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM c, range(2, 4) s(m) WHERE m < size) GROUP BY ALL)
    SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score
    FROM best JOIN t USING (lang) LEFT JOIN hidden USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
    WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000"""

def _centroid_sql() -> str:
    """Vectors and centroids as (number, component, value) rows; each round is two steps."""
    parts = [rf"""
    v0 AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, [floor(256e0 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
        WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM v0),
    c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM (
        SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v0 QUALIFY c < {centroids.CLUSTERS}))"""]
    for i in range(centroids.ROUNDS + 1):
        parts.append(f"""
    a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{i} USING (j) GROUP BY r, c)
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < centroids.ROUNDS:
            parts.append(f"""
    m{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY c, j),
    c{i + 1} AS MATERIALIZED (SELECT c, j, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, y) AS y FROM c{i} LEFT JOIN m{i} USING (c, j))""")
    k = centroids.ROUNDS
    return f"""WITH {",".join(parts)},
    h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{k} GROUP BY c)
    SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
           (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{k} JOIN v0 USING (r) JOIN h USING (c)"""


SQL: dict[str, str] = {
    "op12_centroids": _centroid_sql(),
    "op11_collocations": _COLLOCATION_SQL,
    "op2_exact_dedup": rf"""
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM (SELECT doc_id, sha256(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM ({_TEXTS}))
    WINDOW g AS (PARTITION BY text_sha256)""",
    "op8_quality_rules": _quality_sql(),
}
