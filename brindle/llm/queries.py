"""The registered queries of the training-data operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer file lies; LLM_TOKENIZERS may name another folder."""
    if folder := os.environ.get("LLM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.html_extraction import extract_pages, train_weights

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages, train_weights(pages))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.toxicity import score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    named, covered = F.col("places.label"), F.col("spans.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        joined(named).alias("base_labels"),
        joined(F.concat(named, covered)).alias("labels"),
        F.greatest(F.coalesce(F.array_max("spans.cover"), F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.quality_rules import judge, language_references

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = judge(docs, language_references(docs, once=False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def url_rules() -> tuple:
    """The rules of the registered query."""
    from brindle.llm.url_filter import Rule

    return (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.url_filter import judge_urls, labelled_by_rules, train_trees

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_rules()
    return judge_urls(pages, rules, train_trees(labelled_by_rules(pages, rules))).drop("url")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.quality_classifier import score_quality, train_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.scratch import Scratch
    from brindle.llm.token_files import read_tokens, write_tokens

    folder = Scratch(spark, "token-files").folder
    write_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), folder, 2)
    return read_tokens(spark, folder)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe": op6_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_files": op9_token_files,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

def _quality_sql() -> str:
    """``op5_quality_rules`` in DuckDB's SQL, from the operator's fixed values and default rules."""
    from brindle.llm.quality_rules import CLASSES, COMMON, MARKS, OTHER_MARKS, SYMBOLS, WORDS, Rules

    rules = Rules()
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    white = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    count = lambda chars: f"length(t) - length(translate(t, {quote(chars)}, ''))"
    words = lambda k: "CASE " + " ".join(f"WHEN lang = '{lang}' THEN len(list_filter(w, lambda x: x = '{ws[k]}'))" for lang, ws in COMMON.items()) + " ELSE 0 END"
    columns = [*CLASSES, *WORDS]

    def distance(names):
        p = {c: f"(CASE WHEN ({' + '.join('f.' + n for n in names)}) > 0 THEN f.{c} / ({' + '.join('f.' + n for n in names)}) ELSE 0 END)" for c in names}
        q = {c: f"(CASE WHEN r.{c} IS NULL THEN a.{c} / greatest(1, {' + '.join('a.' + n for n in names)}) ELSE r.{c} / greatest(1, {' + '.join('r.' + n for n in names)}) END)" for c in names}
        part = lambda x, y: f"(CASE WHEN {x} > 0 THEN {x} * ln(2 * {x} / ({x} + {y})) ELSE 0 END)"
        return "sqrt(greatest(0, (" + " + ".join(part(p[c], q[c]) + " + " + part(q[c], p[c]) for c in names) + ") / 2 / ln(2)))"

    sums = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in columns)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(map(quote, COMMON))}) THEN lang END AS lang FROM documents),
e AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, translate(t, {white}, '') AS m, list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {white}, '')) > 0) AS lines FROM d),
b AS (SELECT doc_id, lang, w, lines, length(m) AS word_chars, len(w) AS n_words, {count('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} AS capitals, {count('0123456789')} AS digits,
  {count(SYMBOLS)} AS symbols, {count(MARKS)} AS marks, {count(OTHER_MARKS)} AS other_marks, strlen(m) - length(m) AS wide, {', '.join(f'{words(k)} AS word{k}' for k in range(8))} FROM e),
f AS (SELECT *, greatest(word_chars - capitals - digits - symbols - marks - other_marks - wide, 0) AS plain, n_words - {' - '.join(f'word{k}' for k in range(8))} AS word_rest FROM b),
r AS (SELECT lang, {sums} FROM f GROUP BY lang),
a AS (SELECT {sums} FROM f),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM b WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM i),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
v AS (SELECT f.doc_id, f.lang, f.n_words, f.word_chars, f.symbols AS n_symbols, len(f.lines) - len(list_distinct(f.lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  {distance(CLASSES)} AS x, {distance(WORDS)} AS y
  FROM f CROSS JOIN a LEFT JOIN r ON r.lang = f.lang LEFT JOIN c ON c.doc_id = f.doc_id),
z AS (SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.most_repeated} * n_words AS base_failed FROM v)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {rules.char_words} AND x > {rules.char_distance}) AND NOT (lang IS NOT NULL AND n_words >= {rules.common_words} AND y > {rules.common_distance}) AS kept
FROM z
"""


#: DuckDB SQL of the queries that it can express.
ORACLES: dict[str, str] = {
    "op5_quality_rules": _quality_sql(),
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
h AS (SELECT g.doc_id, g.n, g.g FROM g SEMI JOIN r ON g.g = r.g),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(x, y) AS (
  SELECT x, y FROM o UNION SELECT reach.x, o.y FROM reach JOIN o ON reach.y = o.x
), low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(low.y, s.doc_id)) AS component_id
FROM s LEFT JOIN low ON low.x = s.doc_id
""",
}
