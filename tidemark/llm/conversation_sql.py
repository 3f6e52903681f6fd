"""DuckDB SQL for the rows of the two conversation queries."""

from __future__ import annotations

#: White space as the contracts have it, for trim().
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string."""
    shift = "lambda x, k: xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {shift})"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)), {byte}))"


def _paid(way: str, cost: str, edit: str) -> str:
    """A way, which is six digits of cost and then its edits, with one more edit."""
    return f"(lpad((substr({way}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({way}, 7) || '{edit}')"


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


_U = _least("wu", *(_paid(w, "2", "I") for w in ("w0", "ws", "wa")))
_KEEP = {x: f"CASE WHEN fault IN ('-', 't') AND initial = '{x}' THEN" for x in "sua"}

REPAIR = f"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), kinds AS (
    SELECT *, {crc32("name")} % 20 AS kind FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM kinds, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) WHERE kind <> 0
), lines AS (
    SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, left(role, 1) AS initial, trim(text, {_BLANKS}) AS bare
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), marked AS (
    SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM lines
), summary AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM marked GROUP BY conv_id
), opened AS (
    SELECT conv_id, 0::BIGINT AS i, '000000' AS w0, NULL::VARCHAR AS ws, NULL::VARCHAR AS wu, NULL::VARCHAR AS wa FROM summary
), ways AS (
    SELECT conv_id, i, w0, ws, {_U} AS wu, {_least("wa", _paid(_U, "2", "I"))} AS wa FROM opened
    UNION ALL
    SELECT conv_id, i, w0, ws, {_U} AS wu, {_least("wa", _paid(_U, "2", "I"))} AS wa FROM (
        SELECT m.conv_id, m.i, {_paid("w0", "3", "D")} AS w0,
            {_least(_paid("ws", "3", "D"), f"{_KEEP['s']} {_paid('w0', 'late', 'K')} END")} AS ws,
            {_least(_paid("wu", "3", "D"), *(f"CASE WHEN stays THEN {_paid(w, '2 + late', 'R')} END" for w in ("w0", "ws", "wa")), *(f"{_KEEP['u']} {_paid(w, 'late', 'K')} END" for w in ("w0", "ws", "wa")))} AS wu,
            {_least(_paid("wa", "3", "D"), f"CASE WHEN stays THEN {_paid('wu', '2 + late', 'R')} END", f"{_KEEP['a']} {_paid('wu', 'late', 'K')} END")} AS wa
        FROM ways JOIN (SELECT *, fault IN ('-', 't') AS stays, (fault = 't')::INT AS late FROM marked) m ON m.conv_id IS NOT DISTINCT FROM ways.conv_id AND m.i = ways.i + 1
    )
), best AS (
    SELECT s.*, least(w0, wa) AS way FROM ways JOIN summary s ON s.conv_id IS NOT DISTINCT FROM ways.conv_id AND s.n = ways.i
), steps AS (
    SELECT conv_id, 0 AS k, 0::BIGINT AS i, '' AS state, NULL::VARCHAR AS kept FROM best
    UNION ALL
    SELECT conv_id, k, i, CASE edit WHEN 'D' THEN state WHEN 'K' THEN initial ELSE added END,
        CASE edit WHEN 'D' THEN kept ELSE concat_ws(chr(10), kept, CASE edit WHEN 'K' THEN role ELSE CASE added WHEN 'u' THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END) END
    FROM (
        SELECT s.conv_id, s.k + 1 AS k, e.i, s.state, s.kept, e.edit, m.role, m.text, m.initial, CASE s.state WHEN 'u' THEN 'a' ELSE 'u' END AS added
        FROM steps s
        JOIN (SELECT conv_id, j AS k, way[6 + j] AS edit, (SELECT count(*) FROM unnest(range(1, j + 1)) x(z) WHERE way[6 + z] <> 'I') AS i FROM best, unnest(range(1, length(way) - 5)) t(j)) e
            ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.k = s.k + 1
        LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.i = e.i
    )
), repaired AS (
    SELECT b.*, s.kept FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.k = length(b.way) - 6
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(way, 1, 6)::BIGINT, 0) AS cost, coalesce(substr(way, 7), '') AS audit, sha256(coalesce(kept, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

TRIE = f"""
WITH ordered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text, conv_id::VARCHAR AS name FROM conversations WHERE conv_id IS NOT NULL
), talks AS (
    SELECT conv_id, {crc32("name")} % 6 AS h FROM (SELECT DISTINCT conv_id, name FROM ordered)
), rebuilt AS (
    SELECT t.conv_id, 0 AS part, o.pos, o.role, o.text FROM talks t JOIN ordered o ON o.conv_id = t.conv_id - t.conv_id % 100 AND o.pos <= t.h
    UNION ALL
    SELECT t.conv_id, 1, o.pos, o.role, o.text FROM talks t JOIN ordered o ON o.conv_id = t.conv_id AND o.pos > t.h
), steps AS (
    SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS node
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), paths AS (
    SELECT conv_id, depth, chars, node FROM steps UNION ALL SELECT conv_id, 0, 0, '' FROM talks
), ended AS (
    SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM paths
), nodes AS (
    SELECT node, min(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM ended GROUP BY node
), kids AS (
    SELECT n.*, (n.n_convs - 1) * n.chars AS saved, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent) k ON k.parent = n.node
), sums AS (
    SELECT p.node, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(k.saved) AS saved_tokens FROM kids k JOIN paths p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY p.node
)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM kids k JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = k.parent
"""
