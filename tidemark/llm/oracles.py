"""SQL (DuckDB) for the operators that it can express."""

from __future__ import annotations

from .quality import CLASSES, COMMON

WORDS = r"[^\x20\x09-\x0D]+"

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

_OWN = "<|im_end|><|im_start|>assistant ok"
CHAT = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_OWN}'), (-1, 1, 'assistant', '{_OWN}')),
 e AS (SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
 CAST(sum(24 + length(replace(r, chr(10), '\n')) + length(t)) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


def _quality() -> str:
    listed = ", ".join(f"('{lang}', '{w}')" for lang, words in COMMON.items() for w in words)
    found = ", ".join(f"length(regexp_replace(t, '{pattern}', '', 'g')) AS {name}" for name, pattern in CLASSES.items())
    return rf"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
 l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines, length(array_to_string(ws, '')) AS word_chars, {found} FROM w),
 g AS (SELECT rid, i, ws[i:i+7] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
 k AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
 b AS (SELECT l.*, len(ws) AS n_words, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(k.n, 0) > 30 * len(ws) AS base_failed FROM l LEFT JOIN k USING (rid)),
 h AS (SELECT rid, lang, base_failed, 'char' AS kind, unnest(['symbol', 'upper', 'digit', 'space', 'wide', 'rest']) AS cell,
   unnest([symbol, upper, digit, length(t) - word_chars, octet_length(encode(t)) - length(t), greatest(0, word_chars - symbol - upper - digit)]) AS n FROM b),
 cw AS (SELECT * FROM (VALUES {listed}) cw(lang, word)),
 d AS (SELECT b.rid, b.lang, b.base_failed, cw.word, len(list_filter(ws, lambda x: x = cw.word)) AS n FROM b JOIN cw ON b.lang = cw.lang),
 a AS (SELECT rid, lang, base_failed, kind, cell, n FROM h UNION ALL SELECT rid, lang, base_failed, 'word', word, n FROM d
   UNION ALL SELECT d.rid, any_value(d.lang), any_value(d.base_failed), 'word', '', any_value(len(b.ws)) - sum(d.n) FROM d JOIN b USING (rid) GROUP BY d.rid),
 f AS (SELECT lang, kind, cell, sum(n) AS n FROM a WHERE NOT base_failed GROUP BY ALL),
 q AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY lang, kind), 0) AS q FROM f),
 p AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY rid, kind), 0) AS p FROM a),
 j AS (SELECT p.rid, p.kind, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js
   FROM p JOIN q ON p.lang IS NOT DISTINCT FROM q.lang AND p.kind = q.kind AND p.cell = q.cell WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY p.rid, p.kind),
 x AS (SELECT rid, sqrt(greatest(0, coalesce(max(CASE WHEN kind = 'char' THEN js END), 0))) AS c, sqrt(greatest(0, coalesce(max(CASE WHEN kind = 'word' THEN js END), 0))) AS w FROM j GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(symbol AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND (n_words < 50 OR (coalesce(x.c, 0) <= 0.25 AND coalesce(x.w, 0) <= 0.5)) AS kept FROM b LEFT JOIN x USING (rid)"""


QUALITY = _quality()


def _mixing(weights: dict[tuple[str, str], int]) -> str:
    levels = ["domain", "lang", "source"]

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{v}' THEN {w}" for (at, v), w in weights.items() if at == level)
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    ctes = [
        f"s AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS n_tokens FROM documents)",
        "d AS (SELECT *, 'd' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS BIGINT) % 4, 0) AS domain FROM s)",
        "leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, 2 * sum(n_tokens) AS cap FROM d GROUP BY ALL)",
        "b0 AS (SELECT least(sum(tokens) * 7 // 10, sum(cap)) AS budget FROM leaf)",
    ]
    for i, level in enumerate(levels):
        keys, above = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
        part = f"PARTITION BY {above} " if above else ""
        join = f"JOIN b{i} USING ({above})" if above else "CROSS JOIN b0"
        order = f"{part}ORDER BY cap::DOUBLE / weight, {level}"
        ctes += [
            f"n{i} AS (SELECT c.*, {weight(level)} AS weight, budget AS pb FROM (SELECT {keys}, sum(cap) AS cap FROM leaf GROUP BY {keys}) c {join})",
            f"m{i} AS (SELECT *, (pb - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight >= cap * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM n{i})",
            f"b{i + 1} AS (SELECT {keys}, CASE WHEN filled THEN cap ELSE (pb - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({part}), 0)) * weight // sum(CASE WHEN NOT filled THEN weight END) OVER ({part}) END AS budget FROM m{i})",
        ]
    ctes += [
        "p AS (SELECT d.*, leaf.tokens AS leaf_tokens, b3.budget AS leaf_budget, CASE WHEN leaf.tokens > 0 THEN b3.budget // leaf.tokens ELSE 0 END AS whole FROM d JOIN leaf USING (domain, lang, source) JOIN b3 USING (domain, lang, source))",
        "e AS (SELECT *, unnest(range(0, CAST(least(whole, 1) AS BIGINT) + 1)) AS epoch FROM p)",
        "r AS (SELECT *, leaf_budget - leaf_tokens * epoch - sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('1:' || epoch || ':' || doc_id), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) + n_tokens AS room FROM e)",
    ]
    return f"WITH {', '.join(ctes)} SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(CASE WHEN epoch < whole THEN n_tokens ELSE least(n_tokens, room) END AS BIGINT) AS taken_tokens, CAST(leaf_tokens AS BIGINT) AS leaf_tokens, CAST(leaf_budget AS BIGINT) AS leaf_budget FROM r WHERE epoch < whole OR least(n_tokens, room) > 0"


def _sharding(shards: int = 16) -> str:
    """Longest first, one group at a time; which of the groups of one size a shard gets goes by their rank."""
    start = "[" + ", ".join(["0::HUGEINT"] * shards) + "]"
    least = "list_position(loads, list_min(loads))"
    table = "list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x))"
    return f"""WITH RECURSIVE b AS (SELECT doc_id, encode(coalesce(text, '')) AS t, md5(coalesce(text, '')) AS key FROM documents),
 crc AS (SELECT key, xor(list_reduce(list_transform(regexp_extract_all(hex(t), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, k.k[xor(c & 255, x) + 1]), 4294967295), 4294967295) AS text_crc32
   FROM (SELECT key, any_value(t) AS t FROM b GROUP BY key), (SELECT {table} AS k) k),
 g AS (SELECT key, CAST(sum(octet_length(t) + 1) AS HUGEINT) AS s FROM b GROUP BY key),
 o AS (SELECT *, row_number() OVER (ORDER BY s DESC, key) AS k, row_number() OVER (PARTITION BY s ORDER BY key) AS rank FROM g),
 l AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS HUGEINT) AS s, {start} AS loads, CAST(0 AS BIGINT) AS shard UNION ALL
   SELECT o.k, o.s, list_transform(loads, lambda x, i: x + CASE WHEN i = {least} THEN o.s ELSE 0 END), {least} - 1 FROM l JOIN o ON o.k = l.k + 1),
 w AS (SELECT s, shard, row_number() OVER (PARTITION BY s ORDER BY shard) AS rank FROM l WHERE k > 0)
SELECT doc_id, octet_length(t) + 1 AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
 row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || key)) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
 FROM b JOIN crc USING (key) JOIN o USING (key) JOIN w USING (s, rank)"""


def oracle_sql(mix_weights: dict[tuple[str, str], int]) -> dict[str, str]:
    return {"op4_exact_topk": TOPK, "op5_chat_formatting": CHAT, "op6_quality_rules": QUALITY, "op9_sharding": _sharding(), "op10_mixing": _mixing(mix_weights)}
