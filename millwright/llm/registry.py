"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators.shared_table import shared_folder

from . import (
    byte_pairs, exact_dedup, line_dedup, lz_fingerprint, mixing, piece_sampling, prefix_trie, quality_classifier, simhash_dedup,
    source_divergence, substring_dedup, token_files, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    paragraphs = substring_dedup.repeated_paragraphs(documents).withColumn("part", F.lit("paragraph"))
    return paragraphs.unionByName(substring_dedup.repeated_passages(documents).withColumn("part", F.lit("passage")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    rows = piece_sampling.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", same.alias("lossless"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write(_table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return token_files.index(spark, path)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(_table(spark, sf_dir, "documents"))


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.with_edited(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    rebuilt = prefix_trie.with_reused_beginnings(prefix_trie.turns(conversations))
    return prefix_trie.nodes(rebuilt, conversations)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    rows = byte_pairs.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    rows = byte_pairs.decode(rows.drop("text"), ranks)
    return rows.select(
        "doc_id", byte_pairs.count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Query]:
    found = (
        op1_substring_dedup, op2_mixing, op3_quality, op4_piece_sampling, op5_simhash_dedup, op6_token_files,
        op7_toxicity, op8_exact_dedup, op9_line_dedup, op10_lz_fingerprint, op11_prefix_trie, op12_source_divergence,
        op13_byte_pairs,
    )
    return {query.__name__: query for query in found}


_OP8 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_OP2 = """
WITH sizes AS (
    SELECT source, sum(length(coalesce(text, '')) + 1) AS size FROM documents GROUP BY source
), rates AS (
    SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate
    FROM sizes
), parts AS (
    SELECT source, greatest(ceil(rate / 8), 1)::INT AS parts, rate / greatest(ceil(rate / 8), 1)::INT AS mean
    FROM rates
), terms AS (
    SELECT source, parts, mean, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p
    FROM parts, range(0, 73) AS r(k)
), upto AS (
    SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM terms
), draws AS (
    SELECT doc_id, d.source, part,
           ('0x' || substr(md5(concat_ws(':', '0', doc_id::VARCHAR, part::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0 AS u
    FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(1, parts + 1) AS r(part)
), times AS (
    SELECT doc_id, count(*) AS times
    FROM draws JOIN upto ON draws.source IS NOT DISTINCT FROM upto.source AND upto.upto <= draws.u
    GROUP BY doc_id
)
SELECT d.*, copy::INT AS copy, md5(concat_ws(':', 'order 0', d.doc_id::VARCHAR, copy::VARCHAR)) AS shuffle_key
FROM documents d JOIN times USING (doc_id), range(1, times + 1) AS r(copy)
"""

_OP9 = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
    FROM documents
), sets AS (
    SELECT doc_id, line::INT AS line, row_number() OVER (ORDER BY doc_id, line) AS spot,
           list_sort(list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda w: w <> '')) AS words
    FROM lines
), worded AS (
    SELECT *, len(words) AS n, min(spot) OVER (PARTITION BY words) AS first FROM sets WHERE len(words) > 0
), firsts AS (
    SELECT spot, n, words FROM worded WHERE spot = first
), tokens AS (
    SELECT spot, n, unnest(words) AS word FROM firsts
), counted AS (
    SELECT *, count(*) OVER (PARTITION BY word) AS lines FROM tokens
), ranked AS (
    SELECT spot, n, word, row_number() OVER (PARTITION BY spot ORDER BY lines, word) AS place FROM counted
), prefix AS (
    SELECT * FROM ranked WHERE place <= n - ceil(0.8 * n) + 1
), pairs AS (
    SELECT DISTINCT x.spot AS later, y.spot AS earlier
    FROM prefix x JOIN prefix y ON x.word = y.word AND y.spot < x.spot AND y.n >= 0.8 * x.n AND x.n >= 0.8 * y.n
), gone AS (
    SELECT DISTINCT later FROM pairs JOIN firsts x ON later = x.spot JOIN firsts y ON earlier = y.spot
    WHERE 9 * len(list_intersect(x.words, y.words)) >= 4 * (x.n + y.n)
)
SELECT doc_id, line FROM worded WHERE spot <> first OR first IN (SELECT later FROM gone)
"""

_OP11 = """
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
    SELECT c, list({'role': role, 'text': text} ORDER BY place) AS own FROM turns GROUP BY c
), reused AS (
    SELECT c, own, c - c % 5 AS base, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
        lambda crc, byte: list_reduce(
            list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda rest, bit: xor(rest >> 1, 3988292384 * (rest & 1))
        )
    )) % 9 AS h
    FROM lists
), rebuilt AS (
    SELECT r.c, list_concat(coalesce(b.own, [])[1:h], r.own[h + 1:]) AS seq
    FROM reused r LEFT JOIN lists b ON b.c = r.base
), steps AS (
    SELECT c, len(seq) AS n, d, seq[1:d] AS path FROM rebuilt, range(0, len(seq) + 1) AS r(d)
), nodes AS (
    SELECT d, path, min(c) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends
    FROM steps GROUP BY d, path
), own AS (
    SELECT n.*, p.conv_id AS parent, coalesce((n.n_convs - 1) * strlen(n.path[-1].text), 0) AS saved
    FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
), counted AS (
    SELECT o.*, (SELECT count(*) FROM own k WHERE k.d = o.d + 1 AND k.path[1:o.d] = o.path) AS children FROM own o
), under AS (
    SELECT a.d, path[1:a.d] AS top, sum(saved) AS saved, count(*) FILTER (children = 0) AS leaves
    FROM counted, range(0, counted.d + 1) AS a(d) GROUP BY a.d, path[1:a.d]
)
SELECT c.conv_id, c.d::BIGINT AS depth, parent AS parent_conv_id, n_convs, children AS n_children,
       leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM counted c JOIN under u ON u.d = c.d AND u.top = c.path
"""

_OP12 = r"""
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), grp AS (
    SELECT DISTINCT lang, source FROM docs
), kept AS (
    SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 30
), found AS (
    SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs) JOIN kept USING (lang, term)
    GROUP BY lang, source, term
), every AS (
    SELECT lang, source, term, coalesce(n, 0) AS n FROM grp JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)
), shares AS (
    SELECT lang, source, term, n,
           1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER g + 5 * count(*) OVER g) AS p,
           sum(n) OVER (PARTITION BY lang, term) AS lang_n
    FROM every WINDOW g AS (PARTITION BY lang, source)
), audited AS (
    SELECT *, 1 + 1000000000::HUGEINT * (lang_n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q
    FROM shares
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), items AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM audited WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, part, item, value::BIGINT AS value,
           row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
    FROM items
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": _OP2, "op8_exact_dedup": _OP8, "op9_line_dedup": _OP9, "op11_prefix_trie": _OP11, "op12_source_divergence": _OP12}
