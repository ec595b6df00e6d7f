"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc, divergence, fm_quality, hard_negatives, jaccard_join, lsh_forest, packing, prefix_trie, rank_queue_bpe, token_store, tool_calls, toxicity_chain, weighted_sampling
from .common import table

BYTE_BPE, MULTI_BPE = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op5_toxicity_chain")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_chain.score(docs, toxicity_chain.fit(docs, table(spark, sf_dir, "labels")))


def _op6_sql() -> str:
    """The same rules in SQL: windows and lines by unnesting, references by language, distances by joins on classes and words."""
    r = divergence.DivergenceRules()
    blank = r"[\x20\x09-\x0D]"
    vocabulary = "(VALUES " + ", ".join("('" + w.replace("'", "''") + "')" for w in r.vocabulary) + ") v(word)"
    languages = ", ".join(f"'{x}'" for x in r.languages)
    xlog = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
    js = f"sum({xlog.format('p', 'q')} + {xlog.format('q', 'p')})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{blank}+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT k, i, list_slice(words, i, i + {r.window - 1}) AS win FROM (SELECT k, words, unnest(range(1, len(words) - {r.window - 2})) AS i FROM w WHERE len(words) >= {r.window})),
rep AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, win) > 1),
cov AS (SELECT k, count(DISTINCT i + j) AS n FROM rep, range({r.window}) t(j) GROUP BY k),
lines AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
ch AS (SELECT k, length(text) AS total, length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS letters,
    length(text) - length(regexp_replace(text, '[\p{{Lu}}\p{{Lt}}]', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '\p{{N}}', '', 'g')) AS digit,
    length(text) - length(regexp_replace(text, '{blank}', '', 'g')) AS blank, length(text) - length(regexp_replace(text, '[.,;:''"()-]', '', 'g')) AS stop,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS shout, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS symbol FROM d),
cls AS (SELECT k, total, unnest([letters - upper, upper, digit, blank, stop, shout, symbol, total - letters - digit - blank - stop - shout - symbol]) AS n, unnest(range(8)) AS c FROM ch),
cref AS (SELECT lang, c, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cls JOIN d USING (k) WHERE lang IN ({languages}) GROUP BY lang, c),
cdist AS (SELECT k, min(s) AS dist FROM (SELECT k, lang, sqrt(greatest({js} / 2, 0)) AS s FROM (SELECT k, lang, n / total AS p, q FROM cls JOIN cref USING (c) WHERE total >= {r.char_min_chars}) GROUP BY k, lang) GROUP BY k),
cw AS (SELECT k, word, count(*) AS n FROM (SELECT k, unnest(words) AS word FROM w) JOIN {vocabulary} USING (word) GROUP BY k, word),
size AS (SELECT k, lang, len(words) AS n_words FROM w),
wall AS (SELECT lang, sum(n_words) AS total FROM size WHERE lang IN ({languages}) GROUP BY lang),
wref AS (SELECT lang, word, coalesce(n, 0) / total AS q FROM wall CROSS JOIN {vocabulary} LEFT JOIN (SELECT lang, word, sum(n) AS n FROM cw JOIN size USING (k) GROUP BY lang, word) USING (lang, word)),
both_ AS (SELECT s.k, f.lang, f.word, coalesce(c.n, 0) / s.n_words AS p, f.q FROM size s CROSS JOIN wref f LEFT JOIN cw c ON c.k = s.k AND c.word = f.word WHERE s.n_words >= {r.word_min_words}),
full_ AS (SELECT k, lang, p, q FROM both_ UNION ALL SELECT k, lang, greatest(1 - sum(p), 0), 1 - sum(q) FROM both_ GROUP BY k, lang),
wdist AS (SELECT k, min(s) AS dist FROM (SELECT k, lang, sqrt(greatest({js} / 2, 0)) AS s FROM full_ GROUP BY k, lang) GROUP BY k),
m AS (SELECT d.doc_id, size.n_words, ch.total - ch.blank AS word_chars, ch.symbol AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    cdist.dist AS char_distance, wdist.dist AS word_distance
  FROM d JOIN size USING (k) JOIN ch USING (k) LEFT JOIN lines USING (k) LEFT JOIN cov USING (k) LEFT JOIN cdist USING (k) LEFT JOIN wdist USING (k))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance,
  NOT base_failed AND NOT coalesce(char_distance > {r.char_limit}, false) AND NOT coalesce(word_distance > {r.word_limit}, false) AS kept
FROM (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed FROM m)
"""


@query("op6_divergence_rules", _op6_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = divergence.divergence_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_fm_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fm_quality.score(docs, fm_quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op2_prefix_forest")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query("op3_token_store")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_check(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=2)


@query("op4_rank_queue_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return rank_queue_bpe.digest_texts(table(spark, sf_dir, "documents"), vocabulary(MULTI_BPE), public_tokenizers.PATTERN)


@query("op7_partition_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""


@query("op8_arc_to_warc", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.convert_pages(table(spark, sf_dir, "pages")).drop("url")


OP9_SQL = """
WITH RECURSIVE a AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'assistant'),
e AS (SELECT a.conv_id, a.turn, p.turn AS parent FROM a LEFT JOIN a p ON p.conv_id = a.conv_id AND a.turn > 1 AND p.turn = a.turn // 2),
levels(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0 FROM e WHERE parent IS NULL
  UNION ALL SELECT e.conv_id, e.turn, l.level + 1 FROM e JOIN levels l ON l.conv_id = e.conv_id AND l.turn = e.parent),
r AS (SELECT conv_id, turn - 1 AS turn, coalesce(text, '') AS content FROM conversations),
c AS (
  SELECT a.conv_id, 'call_' || a.conv_id || '_' || a.turn AS call_id, a.turn, l.level, r.content, n,
    CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'note' ELSE 'convert' END AS name,
    CASE WHEN n % 3 = 0 AND n % 7 = 0 THEN 'limit is no integer' WHEN n % 3 = 1 AND n % 5 = 0 THEN 'colour is unknown'
         WHEN n % 3 = 2 AND n % 5 = 0 THEN 'value is missing' ELSE '' END AS errors,
    CASE n % 3 WHEN 0 THEN '{"limit":' || CASE WHEN n % 7 = 0 THEN '"many"' ELSE a.turn::VARCHAR END || ',"query":' || to_json(a.text)::VARCHAR || '}'
      WHEN 1 THEN '{' || CASE WHEN n % 5 = 0 THEN '"colour":1,' ELSE '' END || '"tags":["b","a"],"title":' || to_json(a.text)::VARCHAR || '}'
      ELSE '{"unit":"char"' || CASE WHEN n % 5 = 0 THEN '' ELSE ',"value":' || n || '.5' END || '}' END AS arguments,
    row_number() OVER (PARTITION BY a.conv_id ORDER BY l.level, a.turn) - 1 AS position
  FROM a JOIN levels l USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn))
SELECT conv_id, call_id, turn, name, CAST(level AS INTEGER) AS level, CAST(position AS BIGINT) AS position,
  CASE WHEN content IS NULL THEN 'unanswered' ELSE 'linked' END AS status, errors,
  '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '","position":' || position || ',"result":' ||
  coalesce(to_json(content)::VARCHAR, 'null') || ',"valid":' || CASE WHEN errors = '' THEN 'true' ELSE 'false' END || '}' AS record
FROM c
"""


@query("op9_tool_call_links", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_calls(tool_calls.messages_of(table(spark, sf_dir, "conversations")))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), window=1024, end_id=0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256e0 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.v, v.v) AS BIGINT) AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op13_shared_list_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), hard_negatives.whole_numbers(F.col("embedding"), 256).alias("vector"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query("op12_consistent_sampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.compare_with_next(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no FROM conversations WHERE conv_id IS NOT NULL),
bytes(conv_id, s, i, crc) AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 1, CAST(4294967295 AS BIGINT) FROM t
  UNION ALL SELECT conv_id, s, i + 1, list_reduce(list_prepend(xor(crc, CAST(ascii(substr(s, i, 1)) AS BIGINT)), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
    lambda x, y: xor(x // 2, 3988292384 * (x % 2))) FROM bytes WHERE i <= length(s)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(crc, 4294967295) % 4 AS h FROM bytes WHERE i > length(s)),
lists AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY no) AS turns FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), coalesce(o.turns[h + 1:], [])) AS turns
  FROM c JOIN lists o USING (conv_id) LEFT JOIN lists b ON b.conv_id = c.base),
m AS (SELECT conv_id, d, md5(CAST(turns[1:d] AS VARCHAR)) || d AS node, CASE WHEN d > 0 THEN md5(CAST(turns[1:d - 1] AS VARCHAR)) || (d - 1) END AS parent,
    CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words, d = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY node),
k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM n LEFT JOIN k ON k.parent = n.node),
up(node, above) AS (SELECT node, node FROM own UNION ALL SELECT up.node, n.parent FROM up JOIN n ON n.node = up.above WHERE n.parent IS NOT NULL),
s AS (SELECT above, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM up JOIN own USING (node) GROUP BY above)
SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, own.n_convs, own.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN s ON s.above = own.node LEFT JOIN n p ON p.node = own.parent
"""


@query("op11_prefix_slots", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.borrow_starts(turns)).drop("node", "parent")
