"""The queries of this subpackage, by name, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import op6_embeddings
from .langid import op10_langid
from .mixing import op1_mixing
from .neardup import op3_jaccard
from .packing import op7_packing
from .quality import op2_quality
from .rules import op4_rules
from .secrets import op8_secrets
from .sharding import op5_sharding
from .substrings import op9_substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_jaccard": op3_jaccard,
    "op4_rules": op4_rules,
    "op5_sharding": op5_sharding,
    "op6_embeddings": op6_embeddings,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_substrings": op9_substrings,
    "op10_langid": op10_langid,
}



def _part(query: Callable[[SparkSession, str], DataFrame], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """What SQL can say of a query's result; the rest of it comes of a model, a hash or token ids."""
    return lambda spark, sf_dir: query(spark, sf_dir).selectExpr(*columns)


QUERIES |= {
    "sql_op1_targets": _part(op1_mixing, "doc_id", "size", "source_size", "round(target, 2) as target", "taken <= 2 * size and taken % greatest(size, 1) = 0 as whole"),
    "sql_op4_base": _part(op4_rules, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept and base_failed as wrong"),
    "sql_op5_sizes": _part(op5_sharding, "doc_id", "size", "law", "shard between 0 and 39 as placed"),
    "sql_op8_counts": _part(op8_secrets, "doc_id", "n_assign", "n_access", "n_hex"),
    "sql_op10_held_out": _part(op10_langid, "doc_id", "score between 0 and 1 as scored", "lang_pred = 'und' as unknown"),
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Smallest node reachable by links (x, y), which hold both directions.
_REACH = """reach(x, y) AS (SELECT x, x FROM nodes UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
class AS (SELECT x, min(y) AS root FROM reach GROUP BY x), degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)"""

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id AS x, {_WORDS} AS words FROM documents),
shingles AS (SELECT DISTINCT x, array_to_string(words[i : i + 4], ' ') AS s FROM (SELECT x, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
nodes AS (SELECT w.x, count(s) AS n FROM w LEFT JOIN shingles USING (x) GROUP BY w.x),
links AS (SELECT p.x, p.y FROM (SELECT a.x, b.x AS y, count(*) AS k FROM shingles a JOIN shingles b USING (s) WHERE a.x <> b.x GROUP BY 1, 2) p
 JOIN nodes a ON a.x = p.x JOIN nodes b ON b.x = p.y WHERE CAST(k AS DOUBLE) / (a.n + b.n - k) >= 0.8),
{_REACH}
SELECT nodes.x AS doc_id, root AS class_id, coalesce(degree.n, 0) AS n_links, nodes.n AS n_shingles, root = nodes.x AS kept FROM nodes JOIN class USING (x) LEFT JOIN degree USING (x)""",
    "op6_embeddings": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS x FROM embeddings),
v AS (SELECT vec_id AS x, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT x, label, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
links AS (SELECT a.x, b.x AS y FROM u a JOIN u b ON a.label = b.label AND a.x <> b.x AND len(a.e) = len(b.e) WHERE a.size > 0 AND b.size > 0 AND list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98),
{_REACH}
SELECT x AS vec_id, coalesce(degree.n, 0) AS n_links, root AS component_id, root = x AS kept FROM class LEFT JOIN degree USING (x)""",
    "op9_substrings": f"""WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM starts WHERE s IN (SELECT s FROM starts GROUP BY s HAVING count(*) > 1)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "sql_op1_targets": f"""WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
r AS (SELECT *, 2.0 * source_size / weight AS full_at FROM s),
c AS (SELECT *, 1.5 * sum(source_size) OVER () AS budget, sum(2.0 * source_size) OVER f AS caps, sum(weight) OVER () - sum(weight) OVER f AS rest FROM r WINDOW f AS (ORDER BY full_at, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT budget / (SELECT sum(weight) FROM r) AS level, 0 AS from_at FROM c UNION ALL SELECT (budget - caps) / rest, full_at FROM c WHERE rest > 0),
level AS (SELECT max(level) AS level FROM levels WHERE level >= from_at)
SELECT doc_id, size, source_size, round(least(2.0 * source_size, level * weight), 2) AS target, true AS whole FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, level""",
    "sql_op4_base": rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + 2], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM windows JOIN (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1) USING (doc_id, s)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (SELECT w.doc_id, len(words) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, false AS wrong FROM counts""",
    "sql_op5_sizes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, 'bytes' AS law, true AS placed FROM documents",
    "sql_op8_counts": r"""SELECT doc_id,
 CAST(len(list_filter(regexp_extract_all(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 12)) AS BIGINT) AS n_assign,
 CAST(len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 18)) AS BIGINT) AS n_access,
 CAST(len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: len(x) >= 16)) AS BIGINT) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
    "sql_op10_held_out": r"""SELECT doc_id, true AS scored, NOT regexp_matches(coalesce(text, ''), '\p{L}') AS unknown FROM documents""",
}
