"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annular_codes, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, paragraph_dedup, quality_fm, quality_rules, sort_means, trie_lm, url_filter, vector_sql


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target weights of the mixture, by path in the tree of domains, languages and sources; all others are 1.
TARGETS = {("domain0",): 2.0, ("domain1",): 1.5, ("domain0", "en"): 3.0, ("domain1", "en"): 2.0, ("domain2", "de"): 2.0}


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.prefixes(_read(spark, sf_dir, "documents"), weight=mixing.targets(TARGETS))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _read(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.judged(_read(spark, sf_dir, "documents"), trusted)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(_read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_read(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(_read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.identities(_read(spark, sf_dir, "documents"))


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.assigned(_read(spark, sf_dir, "embeddings"))


def op12_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_lm.scored(_read(spark, sf_dir, "documents"))


def op13_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annular_codes.coded(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_mixing, op3_quality_rules, op4_ngram_join, op5_line_dedup, op6_url_filter, op7_language_id, op8_exact_dedup, op9_paragraph_dedup, op10_packing, op11_sort_means, op12_trie_lm, op13_annular_codes)}

SQL = {
    "op4_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v
            FROM documents),
        s AS (
            SELECT doc_id, unnest(CASE WHEN len(v) = 0 THEN [] WHEN len(v) < 5 THEN [array_to_string(v, ' ')]
                ELSE list_distinct(list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' '))) END) AS t FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, g.b FROM r JOIN g ON g.a = r.seen)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.seen) AS component_id
        FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.node = w.doc_id GROUP BY w.doc_id""",
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op11_sort_means": vector_sql.sort_means(),
    "op13_annular_codes": vector_sql.annular_codes(),
}
