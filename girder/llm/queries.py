"""Queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, fill_in_middle, language_id, licenses, near_dup, packing, prefix_trie, secrets, token_attribution, tool_calls, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "representative")


@query
def op2_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op3_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_attribution.count_by_section(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


@query
def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leak into documents."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")


@query
def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in canonical form, its calls and results linked."""
    return tool_calls.link(table(spark, sf_dir, "conversations"))


# The tables' conversations hold no tool markup; on messages with markup this SQL gives null, which would show as a difference.
ORACLE_SQL["op6_tool_call_linking"] = """
SELECT conv_id, turn, role, turn AS order_turn, CAST(0 AS INTEGER) AS order_step, CAST(0 AS INTEGER) AS n_calls, CAST(0 AS INTEGER) AS n_results, CAST(0 AS INTEGER) AS n_linked, '' AS problems,
  CASE WHEN contains(coalesce(text, ''), '<tool_') OR contains(coalesce(text, ''), 'tool_call') THEN NULL
       ELSE CAST(to_json({'content': coalesce(text, ''), 'role': role}) AS VARCHAR) END AS canonical
FROM conversations
"""


@query
def op7_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.digests(table(spark, sf_dir, "documents"))


@query
def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


@query
def op10_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations with the first turns of their families."""
    turns, _ = prefix_trie.encode(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.graft(turns)).drop("turn_id")


ORACLE_SQL["op11_prefix_trie"] = r"""
WITH m AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, turns, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h FROM m),
g AS (SELECT h.c, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS s FROM h LEFT JOIN m b ON b.c = h.c - h.c % 20),
w AS (SELECT c, s, d, s[1:d] AS p FROM g, LATERAL (SELECT unnest(range(len(s) + 1)) AS d)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(s) = d), '')) AS ends_sha256 FROM w GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS q, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS own FROM n LEFT JOIN k ON k.q = n.p),
u AS (SELECT p[1:a] AS top, own, n_children FROM f, LATERAL (SELECT unnest(range(d + 1)) AS a)),
t AS (SELECT top, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM u GROUP BY top)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, t.n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN t ON t.top = f.p LEFT JOIN n o ON o.p = f.p[1:f.d - 1] AND f.d > 0
"""


@query
def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive and read back from it."""
    return warc.read_archive(warc.write_archive(table(spark, sf_dir, "pages")))


ORACLE_SQL["op12_warc_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS top FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || h[5 * i + 1:5 * i + 5] AS BIGINT)) AS five FROM w)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((five[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM v
"""


@query
def op13_bit_parallel_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a fill-in-the-middle form, and what its form restores to."""
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


ORACLE_SQL["op13_bit_parallel_fim"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, t, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
