"""Registered queries of this subpackage: name -> function of (spark, data folder), and DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_and_decode
from .common import read, remainder
from .decontaminate import ALIKE, RUN, overlaps
from .language import identify, language_model
from .lexical import ranked_search
from .mixing import MOST, mix_plan
from .quality import CUT, quality_model, score_quality
from .records import read_records, record_digests, records_folder, write_records
from .secrets import find_secrets
from .simhash import simhash_components
from .spelling import variant_groups, word_counts
from .token_counts import token_counts
from .toxicity import score_toxicity, toxicity_model
from .winnowing import compare_edited

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Id that ends each document in the record files.
END_ID = 2
#: Toxicity from which a document counts as toxic.
TOXIC = 0.3


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(read(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, language_model(docs, hold_of=4, held=2))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return encode_and_decode(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = records_folder(spark)
    write_records(read(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_BPE), END_ID)
    return record_digests(read_records(spark, folder))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_quality(docs, quality_model(docs, read(spark, sf_dir, "labels"), hold_of=5, held=0))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_toxicity(docs, toxicity_model(docs, read(spark, sf_dir, "labels"), hold_of=4, held=2), threshold=TOXIC)
    return scored.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        F.size("offending").cast("bigint").alias("n_offending"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(word_counts(read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_winnowing": op1_winnowing,
        "op2_language": op2_language,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_simhash": op4_simhash,
        "op5_decontamination": op5_decontamination,
        "op6_record_files": op6_record_files,
        "op7_quality": op7_quality,
        "op8_toxicity": op8_toxicity,
        "op9_secrets": op9_secrets,
        "op10_token_counts": op10_token_counts,
        "op11_mixing": op11_mixing,
        "op12_lexical_search": op12_lexical_search,
        "op13_spelling": op13_spelling,
    }


_WORDS = "list_filter(string_split(regexp_replace(lower(text), '[\\t\\n\\x0B\\f\\r]', ' ', 'g'), ' '), lambda x: x <> '')"
#: Every alignment of every item with every document, by their equal words; the run and share are those of the operator.
OVERLAPS_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos, len(w) AS n FROM dw),
i AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos, len(w) AS n FROM iw),
m AS (SELECT doc_id, item_id, d.pos - i.pos AS shift, i.pos AS j, d.n AS dn, i.n AS n FROM d JOIN i USING (word)),
g AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= ceil(least({RUN}, n) * {ALIKE})),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING) AS in_run FROM g),
p AS (SELECT doc_id, item_id, shift, any_value(dn) AS dn, any_value(n) AS n, count(*) AS n_equal FROM r
  GROUP BY doc_id, item_id, shift HAVING max(in_run) >= ceil(least({RUN}, any_value(n)) * {ALIKE})),
b AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id) AS n_places FROM p
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, shift) = 1)
SELECT doc_id, item_id, CAST(greatest(shift, 0) AS INTEGER) AS doc_word, CAST(greatest(-shift, 0) AS INTEGER) AS item_word,
  CAST(least(n, dn - shift) - greatest(-shift, 0) AS INTEGER) AS n_words, CAST(n_equal AS INTEGER) AS n_equal, n_places FROM b"""


#: Sources that fill up are a prefix in the order of size over weight, so one pass finds the level.
MIX_SQL = f"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
t AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w),
o AS (SELECT *, total - {MOST} * coalesce(sum(source_size) OVER before, 0) AS rest, weights - coalesce(sum(weight) OVER before, 0) AS shares FROM t
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, {MOST} * source_size * shares <= weight * rest AS full_up FROM o),
l AS (SELECT any_value(total) - {MOST} * coalesce(sum(source_size) FILTER (full_up), 0) AS rest, any_value(weights) - coalesce(sum(weight) FILTER (full_up), 0) AS shares FROM f),
g AS (SELECT source, source_size, CASE WHEN full_up THEN CAST({MOST} * source_size AS DOUBLE) ELSE CAST(weight * l.rest AS DOUBLE) / l.shares END AS target FROM f, l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, {MOST}.0) ELSE 0.0 END AS rate,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r"""

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SEARCH_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
a AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM c),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
o AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM c) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM o, a GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM c, a),
s AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN o USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OVERLAPS_SQL, "op11_mixing": MIX_SQL, "op12_lexical_search": SEARCH_SQL}
