"""The registered queries of this folder and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, contexts, curve, digests, lines, ngrams, packing, quality, substrings, suffixes, templates, variants, wavelet
from ..plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op6_hilbert_sharding")
def hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.assign(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])


@query("op8_wavelet_matrix")
def wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = wavelet.shard_folder(spark)
    wavelet.write_shards(table(spark, sf_dir, "documents"), folder)
    return wavelet.read_shards(spark, folder).withColumnRenamed("key", "doc_id")


@query("op5_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.verdicts(documents, quality.train(documents, table(spark, sf_dir, "labels")))


LEAKS_SQL = f"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
split AS (SELECT side, id, list_filter(string_split(trim(regexp_replace(
              regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\p{{M}} \\t\\n\\x0B\\f\\r]+', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM texts),
starts AS (SELECT side, id, words, least(len(words), {templates.WINDOW}) AS n FROM split WHERE len(words) >= {templates.LITERAL}
             AND (side = 'b' OR len(words) >= {templates.LITERAL})),
sizes AS (SELECT DISTINCT n FROM starts WHERE side = 'b'),
cut AS (SELECT side, id, n, i AS place, len(words) - n + 1 AS total, words[i + 1:i + n] AS w
        FROM (SELECT s.side, s.id, s.words, z.n FROM starts s JOIN sizes z ON CASE WHEN s.side = 'b' THEN s.n = z.n ELSE len(s.words) >= z.n END) s,
             unnest(range(0, len(words) - n + 1)) AS r(i)),
shaped AS (SELECT *, list_transform(range(1, n + 1), lambda j: CASE
    WHEN regexp_matches(w[j], '^\\p{{N}}+$') THEN '<num>'
    WHEN regexp_matches(w[j], '^\\p{{N}}+\\p{{L}}+$') THEN '<num-unit>'
    WHEN j > 1 AND list_contains([{', '.join(f"'{u}'" for u in templates.UNITS)}], lower(w[j])) AND regexp_matches(w[j - 1], '^\\p{{N}}+$') THEN '<unit>'
    WHEN regexp_matches(w[j], '^\\p{{Lu}}') THEN '<name>' ELSE lower(w[j]) END) AS shape FROM cut),
b AS (SELECT * FROM shaped WHERE side = 'b' AND len(list_filter(shape, lambda t: NOT starts_with(t, '<'))) >= {templates.LITERAL}),
pairs AS (SELECT d.id AS doc_id, b.id AS item_id, b.place, b.total, d.w AS dw, b.w AS bw, d.shape, d.n
          FROM shaped d JOIN b ON d.side = 'd' AND d.shape = b.shape),
slots AS (SELECT *, list_filter(range(1, n + 1), lambda j: starts_with(shape[j], '<')) AS s FROM pairs),
ok AS (SELECT doc_id, item_id, place, total,
              list_transform(dw, lambda x: lower(x)) = list_transform(bw, lambda x: lower(x)) AS same FROM slots
       WHERE len(list_distinct(list_transform(s, lambda j: shape[j] || chr(9) || dw[j] || chr(9) || bw[j])))
           = len(list_distinct(list_transform(s, lambda j: shape[j] || chr(9) || dw[j])))
         AND len(list_distinct(list_transform(s, lambda j: shape[j] || chr(9) || dw[j] || chr(9) || bw[j])))
           = len(list_distinct(list_transform(s, lambda j: shape[j] || chr(9) || bw[j])))),
seen AS (SELECT doc_id, item_id, place, max(total) AS total, bool_or(same) AS same FROM ok GROUP BY 1, 2, 3)
SELECT doc_id, item_id, count(*) AS n_windows, max(total)::BIGINT AS item_windows, bool_and(same) AS exact FROM seen GROUP BY 1, 2
"""


@query("op9_benchmark_decontamination", LEAKS_SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_groups(table(spark, sf_dir, "documents"))


@query("op3_context_tree_scores")
def context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.score(table(spark, sf_dir, "documents"))


@query("op7_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"), removed="n_removed_lines")
    return found.select("doc_id", "n_removed_lines", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


DIGESTS_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, length(text) AS chars, sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t),
r AS (SELECT *, row_number() OVER w AS i, first_value(doc_id) OVER w AS keep_id FROM d
      WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, i = 1 AS kept, text_sha256 FROM r
"""


@query("op11_exact_dedup", DIGESTS_SQL)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.dedup(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
said AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, w[i:i + k - 1] AS p FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM said), range(1, 6) AS r(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM said GROUP BY lang),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1),
cuts AS (SELECT c.lang, c.p, a, n, k, l.f AS l, r.f AS r, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
         FROM c JOIN n USING (lang), range(1, 5) AS z(k), f AS l, f AS r
         WHERE k < len(c.p) AND l.lang = c.lang AND l.p = c.p[:k] AND r.lang = c.lang AND r.p = c.p[k + 1:]),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS i FROM cuts),
inside AS (SELECT DISTINCT s.lang, s.p FROM (SELECT lang, a, p[i:i + m - 1] AS p FROM c, range(1, 5) AS x(i), range(2, 5) AS y(m)
           WHERE m < len(c.p) AND i + m - 1 <= len(c.p)) s JOIN c ON c.lang = s.lang AND c.p = s.p WHERE 100 * s.a >= 100 * c.a),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM best b WHERE i = 1
           AND NOT EXISTS (SELECT 1 FROM inside s WHERE s.lang = b.lang AND s.p = b.p)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM ranked)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM numbered WHERE rank <= 2000
"""


@query("op12_phrase_collocations", COLLOCATIONS_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
