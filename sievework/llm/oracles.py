"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import chat, licenses, sharding

# crc32 of UTF-8 bytes: eight shifts for each byte, with the reversed polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

crc32 = _CRC.format


def _jump(shards: int) -> str:
    """A recursive relation (doc_id, shard) of jump consistent hashing in 64-bit arithmetic."""
    return f"""
    SELECT i, k, -1::BIGINT AS b, 0::BIGINT AS j FROM keys
    UNION ALL
    SELECT i, (k * {sharding.STEP}::UHUGEINT + 1) % {1 << 64}::UHUGEINT, j,
           floor((j + 1) * ({1 << 31}::DOUBLE / ((((k * {sharding.STEP}::UHUGEINT + 1) % {1 << 64}::UHUGEINT) // {1 << 33}::UHUGEINT) + 1)::DOUBLE))::BIGINT
    FROM {{name}} WHERE j < {shards}"""


def op1(shards: int = 40) -> str:
    walks = ", ".join(f"{name}(i, k, b, j) AS ({_jump(n).format(name=name)})" for name, n in (("w", shards), ("g", shards + 1)))
    return f"""
WITH RECURSIVE keys AS (SELECT DISTINCT coalesce(doc_id, 0) AS i, (CASE WHEN coalesce(doc_id, 0) < 0 THEN {1 << 64}::HUGEINT + doc_id ELSE coalesce(doc_id, 0) END)::UHUGEINT AS k FROM documents),
{walks},
placed AS (SELECT w.i, w.b AS shard, g.b AS grown_shard FROM w JOIN g USING (i) WHERE w.j >= {shards} AND g.j >= {shards + 1}),
own AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE {crc32(t="text")} END AS text_crc32 FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY left(md5(concat_ws('|', doc_id, size, text_crc32)), 3), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM own JOIN placed ON placed.i = coalesce(own.doc_id, 0)
"""


OP3 = """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, t.vec_id, list_inner_product(q.v, t.v)::BIGINT AS score FROM f q JOIN f t ON q.vec_id % 20 = 0 AND q.vec_id <> t.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _escaped(text: str, controls: list[str]) -> str:
    """Backslashes first; no control string has one."""
    out = f"replace({text}, '\\', '\\\\')"
    for c in controls:
        out = f"replace({out}, '{c}', '\\{c}')"
    return out


def op5(template: dict = chat.TEMPLATE) -> str:
    t, newline = template, "' || chr(10) || '"
    moves = " ".join(f"WHEN state = '{a}' AND r = '{role}' THEN '{b}'" for a, by in t["moves"].items() for role, b in by.items())
    loss = ", ".join(f"'{x}'" for x in t["loss"])
    around = len(t["head"] + t["mark"] + t["end"])
    role = _escaped("role", t["controls"])
    role = f"replace(replace({role}, ':', '\\:'), chr(10), '\\' || chr(10))"
    said = "\\### Assistant: </turn> ok"
    return f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM turns),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || '{newline}' || text || '{newline}', '' ORDER BY n)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role IN ({loss})), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role IN ({loss})), '')) AS loss_sha256,
        sum({around} + length({role}) + length({_escaped("text", t["controls"])}))::BIGINT AS formatted_chars FROM o GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, '{t["start"]}' AS state FROM d
  UNION ALL
  SELECT conv_id, n, CASE {moves} ELSE 'wrong' END FROM (SELECT w.conv_id, o.n, w.state, o.role AS r FROM walk w JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.n = w.n + 1 WHERE w.state <> 'wrong')),
ends AS (SELECT conv_id, bool_and(state <> 'wrong') AND arg_max(state, n) IN ({", ".join(f"'{x}'" for x in t["finals"])}) AS valid FROM walk GROUP BY conv_id)
SELECT d.*, valid FROM d JOIN ends ON ends.conv_id IS NOT DISTINCT FROM d.conv_id
"""


_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_base() -> str:
    """The base columns of op2: places of the phrases among the words of each text."""
    hits, labels = [], []
    for phrase, label in licenses.PHRASES.items():
        words = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        hits.append(f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {same})")
        labels.append(f"CASE WHEN len({hits[-1]}) > 0 THEN '{label}' END")
    every = f"flatten([{', '.join(hits)}])"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
h AS (SELECT doc_id, w, {every} AS places, [{', '.join(labels)}] AS labels FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
       array_to_string(list_sort(list_filter(labels, lambda x: x IS NOT NULL)), ',') AS base_labels FROM h
"""


def lm_base() -> str:
    """The base columns of op9: unigram counts of the training documents, add-one log probabilities."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce({crc32(t="doc_id::VARCHAR")} % 7 = 2, true) AS held_out,
             list_append(regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+'), '') AS w FROM documents),
t AS (SELECT i, held_out, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
s AS (SELECT i, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base FROM t LEFT JOIN c USING (word) CROSS JOIN n GROUP BY 1)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 4) AS base_score FROM d JOIN s USING (i) CROSS JOIN n
"""


#: Every anchor against every row, then every positive against every row of another label.
OP11 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS own, list_dot_product(a.v, c.v)::BIGINT AS score FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

#: Targets as the one level that fills all sources up to three times their size: l of the sum of least(3 * size, weight * l).
MIX_BASE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight) AS i FROM w),
l AS (SELECT i, 3 * source_size / weight < (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_ FROM o),
f AS (SELECT (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) FILTER (full_), 0) AS rest, sum(weight) FILTER (NOT full_) AS free FROM o JOIN l USING (i))
SELECT doc_id, size, source_size, CASE WHEN full_ THEN (3 * source_size)::DOUBLE ELSE (weight * rest)::DOUBLE / free::DOUBLE END AS target
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source JOIN l USING (i) CROSS JOIN f
"""
