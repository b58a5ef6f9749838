"""SQL of conversation repair and of the Merkle manifest."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """The crc32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda a, i: xor(a >> 1, (a & 1) * 3988292384::UBIGINT))"
    first, given = "4294967295::UBIGINT", f"list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend({first}, {given}), lambda c, b: {byte}), {first})"


def _leaf(text: str) -> str:
    told = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(told)})"


def _levels(name: str, first: str, key: str) -> str:
    """A recursive table of trees' nodes: key, level, i, w (nodes of the level) and d (digest)."""
    return f"""{name} AS (
            {first}
            UNION ALL
            SELECT {key}, level + 1, i // 3, (any_value(w) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE w > 1 GROUP BY {key}, level, i // 3)"""


def _add(state: str, cost: int | str, letters: str) -> str:
    """A state, nine digits of cost and the audit, with more of both."""
    return f"(lpad((substr({state}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letters}')"


def _taken(state: str, initial: str) -> str:
    return f"CASE WHEN gone THEN '400000000' WHEN ini = '{initial}' THEN {_add(state, 'extra', 'K')} ELSE {_add(state, 'extra + 2', 'R')} END"


_INSERTED = f"""least(n2, {_add('n0', 2, 'I')}, {_add('n1', 2, 'I')}, {_add('n3', 2, 'I')}) AS s2,
                   least(n3, {_add('n2', 2, 'I')}, {_add('n0', 4, 'II')}, {_add('n1', 4, 'II')}) AS s3"""

CONVERSATION_REPAIR = f"""
        WITH RECURSIVE z AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
        d AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again
            FROM z),
        o AS (
            SELECT *, row_number() OVER c AS pos, lag(role[1]) OVER c || role[1] AS pair
            FROM d WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen FROM o),
        f AS (
            SELECT *, role[1] AS ini, fault IN ('B', 'D') AS gone, (fault = 'T')::INT AS extra
            FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'B' WHEN seen THEN 'D' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'T' ELSE '' END AS fault FROM q)),
        g AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'B') AS blank,
                   count(*) FILTER (fault = 'D') AS duplicate, count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id),
        p AS (
            SELECT conv_id, n, 0::BIGINT AS pos, '000000000' AS s0, '400000000' AS s1, '000000002I' AS s2, '000000004II' AS s3 FROM g
            UNION ALL
            SELECT conv_id, n, pos, n0, n1, {_INSERTED}
            FROM (
                SELECT p.conv_id, p.n, f.pos, {_add('s0', 3, 'D')} AS n0,
                       least({_add('s1', 3, 'D')}, CASE WHEN NOT gone AND ini = 's' THEN {_add('s0', 'extra', 'K')} ELSE '400000000' END) AS n1,
                       least({_add('s2', 3, 'D')}, {_taken('s0', 'u')}, {_taken('s1', 'u')}, {_taken('s3', 'u')}) AS n2,
                       least({_add('s3', 3, 'D')}, {_taken('s2', 'a')}) AS n3
                FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1)),
        e AS (SELECT conv_id, substr(least(s0, s3), 1, 9)::BIGINT AS cost, substr(least(s0, s3), 10) AS audit FROM p WHERE pos = n),
        r AS (
            SELECT conv_id, audit, 0 AS i, 0::BIGINT AS pos, '' AS last, NULL::VARCHAR AS piece FROM e
            UNION ALL
            SELECT r.conv_id, audit, i + 1, CASE WHEN audit[i + 1] = 'I' THEN r.pos ELSE r.pos + 1 END,
                   CASE audit[i + 1] WHEN 'D' THEN last WHEN 'K' THEN role[1] ELSE CASE last WHEN 'u' THEN 'a' ELSE 'u' END END,
                   CASE audit[i + 1] WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text
                        ELSE CASE last WHEN 'u' THEN 'assistant:' ELSE 'user:' END || CASE audit[i + 1] WHEN 'R' THEN text ELSE '' END END
            FROM r LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1 WHERE i < length(audit)),
        t AS (SELECT conv_id, sha256(coalesce(string_agg(piece, chr(10) ORDER BY i), '')) AS sha FROM r GROUP BY conv_id)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id"""

MERKLE_MANIFEST = f"""
        WITH RECURSIVE l AS (
            SELECT *, {_leaf("text")} AS leaf,
                   CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS tampered
            FROM documents),
        n AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS w FROM l),
        {_levels("t", "SELECT source, 0 AS level, i, w, leaf AS d FROM n", "source")},
        s AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS w FROM t WHERE w = 1),
        {_levels("u", "SELECT true AS top, 0 AS level, i, w, d FROM s", "top")},
        place AS (
            SELECT n.k, false AS top, t.level, t.source, t.i, t.level AS step FROM n JOIN t ON t.source IS NOT DISTINCT FROM n.source AND t.w > 1 AND t.i = n.i // (3 ** t.level)::BIGINT
            UNION ALL
            SELECT n.k, true, u.level, NULL, u.i, 1000 + u.level FROM n JOIN s ON s.source IS NOT DISTINCT FROM n.source JOIN u ON u.w > 1 AND u.i = s.i // (3 ** u.level)::BIGINT),
        node AS (SELECT source, false AS top, level, i, d FROM t WHERE w > 1 UNION ALL SELECT NULL, true, level, i, d FROM u WHERE w > 1),
        sib AS (
            SELECT k, step, row_number() OVER (PARTITION BY k ORDER BY step) AS nth, coalesce(string_agg(d, '' ORDER BY node.i) FILTER (node.i < p.i), '') AS lefts,
                   coalesce(string_agg(d, '' ORDER BY node.i) FILTER (node.i > p.i), '') AS rights
            FROM place p JOIN node ON node.top = p.top AND node.level = p.level AND node.source IS NOT DISTINCT FROM p.source AND node.i // 3 = p.i // 3
            GROUP BY k, step),
        proof AS (SELECT k, sha256(string_agg(lefts || rights, '' ORDER BY nth)) AS p FROM sib GROUP BY k),
        f AS (
            SELECT k, 0 AS nth, coalesce(tampered, leaf) AS d FROM n
            UNION ALL
            SELECT f.k, f.nth + 1, sha256(lefts || d || rights) FROM f JOIN sib ON sib.k = f.k AND sib.nth = f.nth + 1),
        folded AS (SELECT k, arg_max(d, nth) AS d FROM f GROUP BY k),
        root AS (SELECT d FROM u WHERE w = 1)
        SELECT doc_id, leaf, s.d AS subroot, root.d AS root, coalesce(p, sha256('')) AS proof_sha256, folded.d AS folded_root, folded.d = root.d AS verified
        FROM n JOIN folded USING (k) LEFT JOIN proof USING (k) JOIN s ON s.source IS NOT DISTINCT FROM n.source, root"""
