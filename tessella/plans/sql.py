"""SQL of the registered queries, from shared common table expressions."""

from __future__ import annotations

from ..operators.generation import ABSTENTIONS
from .queries import DOMAINS


def _tokens(text: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower(coalesce({text}, '')), '''s\\b', '', 'g'), '[a-z0-9]+')"


BASE = f"""
    chunks AS (SELECT doc_id AS chunk_id, lang AS domain, coalesce(text, '') AS content, source, {_tokens("text")} AS t FROM documents),
    q AS (SELECT item_id AS query_id, text AS question, {_tokens("text")} AS t FROM benchmark),
    domains(domain, place, allocation) AS (VALUES {", ".join(map(str, DOMAINS))}),
    post AS (SELECT domain, chunk_id, term, len(t) AS dl, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM chunks) GROUP BY ALL),
    dom AS (SELECT domain, count(*) AS n, avg(len(t)) AS avgdl FROM chunks GROUP BY domain),
    plain AS (
        SELECT domain, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS plain
        FROM (SELECT domain, term, count(*) AS df FROM post GROUP BY ALL) JOIN dom USING (domain)),
    terms AS (
        SELECT domain, term, df, CASE WHEN plain < 0 THEN 0.25 * avg(plain) OVER (PARTITION BY domain) ELSE plain END AS idf
        FROM plain),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY ALL),
    sc AS (
        SELECT query_id, domain, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM qt JOIN terms USING (term) JOIN post USING (domain, term) JOIN dom USING (domain) GROUP BY ALL),
    sparse AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc)
        WHERE rank <= 10 AND score > 0),
    unit AS (
        SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN s = 0 THEN 1 ELSE s END) AS v
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS s FROM embeddings)),
    dense AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY round(score, 9) DESC, chunk_id) AS rank
            FROM (
                SELECT query_id, domain, chunk_id, list_dot_product(a.v, b.v) AS score
                FROM q JOIN unit a ON a.vec_id = query_id, unit b JOIN chunks ON b.vec_id = chunk_id))
        WHERE rank <= 10),
    lists AS (SELECT *, 0 AS list FROM dense UNION ALL SELECT *, 1 FROM sparse),
    fused AS (
        SELECT query_id, domain, chunk_id, sum(1 / (60 + rank)) AS rrf, min((place, list, rank, chunk_id)) AS first, min(place) AS place,
               min(rank) FILTER (list = 0) AS dense_rank, min(rank) FILTER (list = 1) AS sparse_rank
        FROM lists JOIN domains USING (domain) GROUP BY ALL),
    per_domain AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, domain_rank) AS position
        FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY round(rrf, 12) DESC, first) AS domain_rank FROM fused)
        JOIN domains USING (domain, place) WHERE domain_rank <= allocation),
    over_all AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first) AS position FROM fused)
        WHERE position <= 10)"""

GATED = """,
    cand AS (
        SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS position, content, c.t AS ct, q.t AS qt,
               len(c.t) AS token_count, 459 - len(q.t) AS budget
        FROM sparse JOIN chunks c USING (domain, chunk_id) JOIN q USING (query_id)),
    starts AS (
        SELECT *, CASE WHEN len(ct) <= budget THEN [0]
                       ELSE list_distinct(list_append(range(0, len(ct) - budget + 1, greatest(1, budget - least(50, budget // 2))), len(ct) - budget)) END AS s
        FROM cand WHERE len(qt) <= 150),
    win AS (SELECT query_id, chunk_id, qt, ct, budget, unnest(s) AS w FROM starts),
    raw AS (
        SELECT query_id, chunk_id, max(8 * len(list_intersect(list_distinct(qt), ct[w + 1 : w + budget])) / len(list_distinct(qt)) - 4) AS raw
        FROM win GROUP BY ALL),
    scored AS (SELECT cand.*, round(1 / (1 + exp(-raw / 4)), 4) AS score FROM cand JOIN raw USING (query_id, chunk_id)),
    gated AS (
        SELECT *, score >= 0.45 OR (fallback AND rank = 1) AS passed_gate
        FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank,
                   max(score) OVER (PARTITION BY query_id) < 0.45 AS fallback
            FROM scored)),
    fits AS (
        SELECT *, passed_gate AND (rank = 1 OR sum(CASE WHEN passed_gate THEN token_count ELSE 0 END)
                      OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) <= 3500) AS in_context
        FROM gated),
    placed AS (SELECT *, count(*) FILTER (in_context) OVER (PARTITION BY query_id) AS n FROM fits)"""

CLAIMS = f"""
    told AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, text AS answer FROM conversations WHERE role = 'assistant'),
    sent AS (
        SELECT query_id, list_filter(list_transform(string_split(regexp_replace(coalesce(answer, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)),
                                     lambda x: len(regexp_extract_all(x, '\\S+')) >= 3)[1:8] AS s
        FROM told),
    claimed AS (SELECT query_id, unnest(s) AS claim, generate_subscripts(s, 1) AS claim_no FROM sent),
    pairs AS (
        SELECT query_id, claim_no, turn AS chunk_no,
               CASE WHEN len({_tokens("claim")}) = 0 THEN 0
                    ELSE len(list_intersect(list_distinct({_tokens("claim")}), {_tokens("c.text")})) / len(list_distinct({_tokens("claim")})) END AS e
        FROM claimed JOIN told USING (query_id) JOIN conversations c ON c.conv_id = told.conv_id AND c.role <> 'assistant'),
    best AS (SELECT query_id, claim_no, max(e) AS e, arg_min(chunk_no, (-e, chunk_no)) AS chunk_no FROM pairs GROUP BY ALL),
    checked AS (
        SELECT query_id, claim_no, claim, round(coalesce(e, 0), 4) AS best_entailment, coalesce(e, 0) >= 0.5 AS faithful,
               CASE WHEN e > 0 THEN chunk_no END AS supporting_chunk
        FROM claimed LEFT JOIN best USING (query_id, claim_no))"""

TRUTHS = """,
    truths AS (SELECT DISTINCT query_id, chunk_id FROM q JOIN chunks ON contains(content, question)),
    metrics AS (
        SELECT query_id, CASE WHEN len(t) > 40 THEN 'long' ELSE 'short' END AS kind, coalesce(n_truth, 0) AS n_truth, first
        FROM q LEFT JOIN (SELECT query_id, count(*) AS n_truth FROM truths GROUP BY ALL) USING (query_id)
        LEFT JOIN (SELECT query_id, min(position) AS first FROM over_all JOIN truths USING (query_id, chunk_id) GROUP BY ALL) USING (query_id))"""
_HIT = {k: f"CASE WHEN n_truth > 0 THEN CASE WHEN coalesce(first, 1000) <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END" for k in (1, 3, 5, 10)}
_RR = "CASE WHEN n_truth > 0 THEN coalesce(1 / first, 0.0) END"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


#: Name, expression and the group that is the match of each kind of leftover, as RE2 reads them.
RE2_PATTERNS = {
    "expression_tag": (r"\[EXPR:[^\]]+\]", 0),
    "double_curly_braces_template": (r"\{\{[^}]{2,}\}\}", 0),
    "question_mark_pipe_values": (r"\?\|[a-zA-Z0-9_]+=", 0),
    "unresolved_wiki_link": (r"\[\[[^\]]*\]\]", 0),
    "html_tags": (r"<[a-zA-Z][a-zA-Z0-9]*[^>]*>", 0),
    "pipe_separated_template_fragment": (r'(?:^|[^|])(\|[a-zA-Z0-9_]+=(?:[^|"\\]|\\[^\n])*(?:\|[a-zA-Z0-9_]+=))', 1),
    "unresolved_magic_words": (r"__[A-Z]+__", 0),
    "parser_functions": (r"\{\{#(if|switch|ifeq|expr|rel2abs|titleparts):[^}]+\}\}", 1),
    "wiki_table_remnants": (r"(?:^|\n)(?:\{\||\|\}|\|\+|\|-|!|\|)", 0),
    "category_tags": (r"(?i)\[\[Category:[^\]]*\]\]", 0),
    "ref_tags": (r"(?is)<ref[^>]*>.*?</ref>", 0),
    "nowiki_tags": (r"(?is)<nowiki[^>]*>.*?</nowiki>", 0),
    "gallery_tags": (r"(?is)<gallery[^>]*>.*?</gallery>", 0),
    "triple_apostrophe_bold": (r"'''[^']+'''", 0),
    "double_apostrophe_italic": (r"''[^']+''", 0),
    "equals_heading": (r"(?:^|\n)={2,}[^=]+=+", 0),
    "template_parameter_default": (r"\{\{\{[^}]+\}\}\}", 0),
    "unresolved_file_image": (r"(?i)\[\[(?:File|Image):[^\]]*\]\]", 0),
    "html_entities": (r"&[a-z0-9#]+;", 0),
    "unicode_escape_sequence": (r"\\u[0-9a-fA-F]{4}", 0),
}
#: Which matches of a kind count.
COUNTED = {
    "double_curly_braces_template": r"""regexp_matches(m, '[|]|\{\{(show|Gold|Rune|Ability|Item|Hero)') OR NOT contains(m, '":')""",
    "double_apostrophe_italic": "length(m) > 4 AND substr(m, 3, 1) <> 's'",
    "html_tags": r"NOT regexp_matches(m, '^<br\s*/?\s*>') AND NOT regexp_matches(lower(m), '<br|<p>|</p>|<strong|</strong')",
}


def _findings() -> str:
    parts = []
    for name, (pattern, group) in RE2_PATTERNS.items():
        found = f"regexp_extract_all(coalesce(html, ''), '{pattern.replace(chr(39), chr(39) * 2)}', {group})"
        parts.append(f"SELECT page_id AS item_id, '{name}' AS type, list_filter({found}, lambda m: {COUNTED.get(name, 'true')}) AS m FROM pages")
    return "found AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE len(m) > 0)"


#: The benchmark's items answered by their own text, with their claims against the chunks of their contexts.
SELF = f""",
    told AS (SELECT query_id, question AS answer FROM q),
    sent AS (
        SELECT query_id, list_filter(list_transform(string_split(regexp_replace(coalesce(answer, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)),
                                     lambda x: len(regexp_extract_all(x, '\\S+')) >= 3)[1:8] AS s
        FROM told),
    claimed AS (SELECT query_id, claim_no, claim, {_tokens("claim")} AS c FROM (SELECT query_id, unnest(s) AS claim, generate_subscripts(s, 1) AS claim_no FROM sent)),
    parts AS (
        SELECT query_id, claim_no, c, ct, 400 - len(c) AS room,
               unnest(CASE WHEN len(ct) <= 400 - len(c) THEN [0]
                      ELSE list_distinct(list_append(range(0, len(ct) - (400 - len(c)) + 1, greatest(1, 400 - len(c) - least(50, (400 - len(c)) // 2))), len(ct) - (400 - len(c)))) END) AS w
        FROM claimed JOIN placed USING (query_id) WHERE in_context),
    entailed AS (
        SELECT query_id, max(round(e, 4)) AS best
        FROM (SELECT query_id, claim_no, max(CASE WHEN len(c) = 0 THEN 0 ELSE len(list_intersect(list_distinct(c), ct[w + 1 : w + room])) / len(list_distinct(c)) END) AS e FROM parts GROUP BY ALL)
        GROUP BY query_id),
    cited AS (
        SELECT query_id, median(score) AS score, length('Sources:' || chr(10) || string_agg('[' || rank || '] ' || chunk_id || ' (0.00)', chr(10))) AS chars
        FROM placed WHERE in_context GROUP BY query_id),
    signals AS (
        SELECT query_id, answer, coalesce(score, 0) AS reranker_median, coalesce(best, 0) AS max_entailment, coalesce(chars + 2, 0) AS chars,
               round(0.7::DOUBLE * coalesce(score, 0) + 0.3::DOUBLE * coalesce(best, 0), 4) AS confidence
        FROM told LEFT JOIN cited USING (query_id) LEFT JOIN entailed USING (query_id)),
    tiers AS (SELECT *, CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence > 0.5 THEN 'moderate' WHEN confidence >= 0.2 THEN 'low' ELSE 'dead' END AS tier FROM signals)"""

#: A page's text without markup that isn't a template: links, tags, quotes, leftovers.
CLEANED = "regexp_replace(html, '<sm2>.*?</sm2>|<ref>.*?</ref>', '', 'g')"
for _pattern, _replacement in [
    (r"\[\[(?:[^\[\]|]*\|)?([^\[\]]+)\]\]", r"\1"), (r"<code>(.*?)</code>", r"\1"), (r"<br\s*/?>|\s+", " "), ("''''''([^'']+)''''''|''''([^'']+)''''", r"\1\2"), (r"(\|\w+)?\}\}", ""),
    (r"\s+", " "), (r"\( ?\)|\[ ?\]", ""), (r" ?[*]{3} ?", " "),
]:
    CLEANED = f"regexp_replace({CLEANED}, '{_pattern}', '{_replacement}', 'g')"

_ROOM = "greatest(100, 510 - len(regexp_extract_all(head, '\\S+')))"
ORACLE_SQL = {
    "h1_tokens": _with(BASE, "SELECT chunk_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM chunks"),
    "h2_index_terms": _with(BASE, "SELECT domain, term, df, round(idf, 6) AS idf FROM terms"),
    "h4_bm25_topk": _with(BASE, "SELECT query_id, domain, chunk_id, round(score, 5) AS score, rank FROM sparse"),
    "h5_dense_topk": _with(BASE, "SELECT query_id, domain, chunk_id, round(score, 5) AS score, rank FROM dense"),
    "h6_filtered_topk": _with(BASE, """
        SELECT query_id, domain, chunk_id, round(score, 5) AS score, rank
        FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY round(score, 9) DESC, chunk_id) AS rank
            FROM (
                SELECT query_id, domain, chunk_id, list_dot_product(a.v, b.v) AS score
                FROM q JOIN unit a ON a.vec_id = query_id, unit b JOIN chunks ON b.vec_id = chunk_id
                WHERE query_id % 3 <> 0 OR source = 'src' || (query_id % 20)))
        WHERE rank <= 10"""),
    "h8_merged_lists": _with(BASE, "SELECT query_id, domain, chunk_id, round(rrf, 6) AS rrf, dense_rank, sparse_rank FROM fused"),
    "h9_rrf_per_domain": _with(BASE, "SELECT query_id, domain, chunk_id, round(rrf, 6) AS rrf, position FROM per_domain"),
    "h10_rrf_over_all": _with(BASE, "SELECT query_id, domain, chunk_id, round(rrf, 6) AS rrf, position FROM over_all"),
    "h12_counts": _with(BASE, """SELECT query_id, count(*) FILTER (list = 0) AS dense_count, count(*) FILTER (list = 1) AS sparse_count,
        coalesce((SELECT count(*) FROM per_domain p WHERE p.query_id = lists.query_id), 0) AS fused_count, 'en' AS majority_domain
        FROM lists GROUP BY query_id"""),
    "i9_gate": _with(BASE + GATED, "SELECT query_id, chunk_id, score, rank, passed_gate, fallback FROM gated"),
    "i11_context": _with(BASE + GATED, "SELECT query_id, chunk_id, n - rank + 1 AS context_position FROM placed WHERE in_context"),
    "i12_context_edges": _with(BASE + GATED, "SELECT query_id, chunk_id, CASE WHEN rank % 2 = 1 THEN n - (rank - 1) // 2 ELSE rank // 2 END AS context_position FROM placed WHERE in_context"),
    "i13_admitted": _with(BASE + GATED, """SELECT q.query_id, count(*) FILTER (in_context) AS n_context, count(*) FILTER (passed_gate AND NOT in_context) AS n_trimmed,
        count(*) FILTER (NOT passed_gate) AS n_gated_out, CAST(coalesce(sum(token_count) FILTER (in_context), 0) AS BIGINT) AS context_tokens,
        round(coalesce(max(score) FILTER (in_context), 0), 4) AS max_score, round(coalesce(min(score) FILTER (in_context), 0), 4) AS min_score,
        coalesce(bool_or(fallback), false) AS fallback
        FROM q LEFT JOIN placed USING (query_id) GROUP BY q.query_id"""),
    "i15_context_text": _with(BASE + GATED, "SELECT query_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY rank DESC)) AS context_md5, count(*) AS n_citations FROM placed WHERE in_context GROUP BY query_id"),
    "j1_prompt": "SELECT item_id AS query_id, md5('Question: ' || text || chr(10) || chr(10) || '<context>' || chr(10) || 'none' || chr(10) || '</context>' || chr(10) || chr(10) || 'Question: ' || text) AS prompt_md5 FROM benchmark",
    "j8_abstentions": "SELECT conv_id * 1000 + turn AS query_id, " + " OR ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in ABSTENTIONS) + " AS abstains FROM conversations WHERE role = 'assistant'",
    "k5_claims": _with(CLAIMS, "SELECT query_id, claim_no, claim, best_entailment, faithful, supporting_chunk FROM checked"),
    "k7_faithfulness": _with(CLAIMS, """SELECT told.query_id, coalesce(round(avg(best_entailment), 8), 0) AS mean_entailment, coalesce(max(best_entailment), 0) AS max_entailment,
        count(*) FILTER (faithful) AS n_faithful, count(claim_no) AS n_claims FROM told LEFT JOIN checked USING (query_id) GROUP BY told.query_id"""),
    "m10_rank_metrics": _with(BASE + TRUTHS, f"SELECT query_id, n_truth, {', '.join(f'{h} AS hit_{k}' for k, h in _HIT.items())}, round({_RR}, 6) AS rr FROM metrics"),
    "m13_summary": _with(BASE + TRUTHS, f"SELECT kind AS slice, grouping(kind)::INT AS level, count(*) AS n, {', '.join(f'round(avg({h}), 6) AS hit_{k}' for k, h in _HIT.items())}, round(avg({_RR}), 6) AS rr FROM metrics GROUP BY GROUPING SETS ((kind), ())"),
    "f1_findings": _with(_findings(), "SELECT item_id, type, len(m) AS match_count, array_to_string(m[1:10], chr(10)) AS matches FROM found"),
    "f4_counts": _with(_findings(), "SELECT type, count(*) AS n_findings, CAST(sum(len(m)) AS BIGINT) AS n_matches FROM found GROUP BY type"),
    "e2_word_chunks": _with(BASE + f""",
        w AS (SELECT chunk_id, 'Source: ' || source || ' | Language: ' || domain || ' | Data: ' AS head, regexp_extract_all(content, '\\S+') AS w FROM chunks),
        r AS (SELECT *, {_ROOM} AS room FROM w WHERE len(w) > 0),
        s AS (SELECT *, CASE WHEN len(w) <= room THEN [0]
              ELSE list_sort(list_distinct(list_append(range(0, len(w) - room + 1, room - least(50, room // 2)), len(w) - room))) END AS s FROM r),
        c AS (SELECT chunk_id, generate_subscripts(s, 1) - 1 AS chunk_index, head || array_to_string(w[unnest(s) + 1 : unnest(s) + room], ' ') AS content FROM s)""",
        f"SELECT chunk_id, chunk_index, md5(content) AS content_md5, len({_tokens('content')}) AS token_count FROM c"),
    "g2_normalised": _with(BASE, "SELECT vec_id, len(v) AS dim, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS square, round(v[1], 6) AS first FROM unit"),
    "g5_chunk_ids": "SELECT doc_id, coalesce(lang, 'Unknown') || '_' || coalesce(nullif(source, ''), 'general') || '_unknown_path_' || doc_id AS chunk_id FROM documents",
    "b4_upsert": """
        WITH o AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY user_id),
        n AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id),
        u AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n))
        SELECT user_id, event_id, event_type FROM u JOIN events USING (user_id, event_id)""",
    "d1_sections": "SELECT conv_id, role AS section, md5(arg_max(coalesce(text, ''), turn)) AS content_md5 FROM conversations GROUP BY conv_id, role",
    "d4_derived": """
        WITH h AS (SELECT p_partkey, p_size AS s, p_partkey % 30 AS a, p_partkey % 25 AS i, p_partkey % 4 AS k, p_partkey % 50 AS low FROM part),
        b AS (SELECT *, CASE k WHEN 0 THEN s WHEN 1 THEN a WHEN 2 THEN i ELSE round(0.7::DOUBLE * (s + a + i), 1) END AS bonus FROM h)
        SELECT p_partkey, (120 + 22 * s)::DOUBLE AS total_health, (75 + 12 * i)::DOUBLE AS total_mana, (bonus + low)::DOUBLE AS damage_min, (bonus + low + 6)::DOUBLE AS damage_max,
            round(0.09::DOUBLE * s + 0.5, 2) AS total_health_regen, round(0.05::DOUBLE * i, 2) AS total_mana_regen, round(-1.0 + a / 6, 2) AS total_armor FROM b""",
    "d18_versions": """
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position FROM conversations)
        SELECT conv_id, position, turn::VARCHAR AS version, position = 1 AS most_recent, role || ';  * turn ' || turn AS changes FROM t WHERE position <= 3""",
    "e4_nested_nodes": """
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS chunk_index FROM conversations)
        SELECT conv_id, 'guide' AS primary_node, 'turns.told.' || role || '-' || turn AS sub_node, chunk_index, '{"turn":' || turn || ',"name":"' || role || '-' || turn || '"}' AS text FROM t""",
    "m6_contexts": """
        WITH i AS (SELECT item_id, unnest([item_id * 3 % 200, item_id, -1 - item_id]) AS doc_id, unnest([1, 2, 3]) AS pos FROM benchmark),
        f AS (SELECT i.item_id, pos, d.doc_id, coalesce(text, '') AS text FROM i LEFT JOIN documents d USING (doc_id))
        SELECT item_id AS query_id, md5(coalesce(string_agg(text, '|' ORDER BY pos) FILTER (doc_id IS NOT NULL), '')) AS contexts_md5, count(*) FILTER (doc_id IS NULL) AS n_missing FROM f GROUP BY item_id""",
    "b3_report": _with(_findings() + ", n AS (SELECT type, count(*) AS n FROM found GROUP BY type)", "SELECT CAST(sum(n) AS BIGINT) AS n_findings, string_agg(type, ',' ORDER BY n DESC, type) AS types FROM n"),
    "l6_tiers": _with(BASE + GATED + SELF, f"""
        SELECT query_id, reranker_median, max_entailment, confidence, tier,
               CASE tier WHEN 'dead' THEN length('The sources do not answer this question.')
                    WHEN 'moderate' THEN length('Parts of this answer may be incomplete.') + 2 + length(answer) + chars
                    WHEN 'low' THEN length('The sources support this answer weakly.') + 2 + length(answer) + chars
                    ELSE length(answer) + chars END AS response_chars
        FROM tiers"""),
    "d3_plain_pages": f"SELECT page_id, md5(trim({CLEANED})) AS plain_md5 FROM pages",
    "e5_bundles": f"""
        WITH RECURSIVE t AS (
            SELECT conv_id, turn, len({_tokens("text")}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, len({_tokens("text")})) AS pos FROM conversations),
        b AS (
            SELECT conv_id, turn, pos, 0::BIGINT AS bundle, n AS used FROM t WHERE pos = 1
            UNION ALL
            SELECT t.conv_id, t.turn, t.pos, CASE WHEN used > 0 AND used + n > 60 THEN bundle + 1 ELSE bundle END,
                   CASE WHEN used > 0 AND used + n > 60 THEN n ELSE used + n END
            FROM b JOIN t ON t.conv_id = b.conv_id AND t.pos = b.pos + 1)
        SELECT conv_id, turn, bundle FROM b""",
    "h11_retrieval": _with(BASE, """
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place, domain_rank) AS position, chunk_id,
               CASE domain WHEN 'fr' THEN 'unknown' ELSE domain END AS domain, round(rrf, 6) AS rrf, CASE WHEN chunk_id % 2 = 1 THEN 1 ELSE length(content) END AS token_count
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY round(rrf, 12) DESC, first) AS domain_rank FROM fused) f
        JOIN chunks USING (domain, chunk_id)
        WHERE query_id % 7 <> 0 AND domain_rank <= CASE WHEN query_id % 3 <> 0 THEN 2 WHEN domain = 'en' THEN 2 WHEN domain = 'es' THEN 5 ELSE 0 END"""),
    "i16_citations": _with(BASE + GATED, """
        SELECT query_id, n - rank + 1 AS context_position, chunk_id, domain, score, round(raw, 6) AS raw, source
        FROM placed JOIN raw USING (query_id, chunk_id) JOIN chunks USING (chunk_id) WHERE in_context"""),
    "i17_score_report": _with(BASE + GATED, """,
        s AS (SELECT gated.*, raw, domain FROM gated JOIN raw USING (query_id, chunk_id) JOIN chunks USING (chunk_id)),
        d AS (SELECT query_id, string_agg(domain || ':' || n, ',' ORDER BY domain) AS domains FROM (SELECT query_id, domain, count(*) AS n FROM s GROUP BY ALL) GROUP BY query_id)
        SELECT query_id, count(*) AS n_scored, count(*) FILTER (NOT passed_gate) AS n_gated_out, max(score) AS max_score, min(score) AS min_score,
               list_sort(list(score))[count(*) // 2 + 1] AS median_score, round(max(raw), 6) AS max_raw, round(min(raw), 6) AS min_raw, round(list_sort(list(raw))[count(*) // 2 + 1], 6) AS median_raw,
               array_to_string(coalesce(list(chunk_id ORDER BY rank) FILTER (NOT passed_gate), [])[1:5], ',') AS gated_out, any_value(domains) AS domains
        FROM s JOIN d USING (query_id) GROUP BY query_id""".lstrip(",")).replace("n FROM fits)\n", "n FROM fits),\n"),
    "m9_list_metrics": """
        WITH r AS (
            SELECT item_id AS i, list_sort(list_distinct(list_filter([CASE WHEN item_id % 6 = 0 THEN NULL ELSE item_id * 2 END, item_id * 2,
                       CASE WHEN item_id % 2 = 0 THEN item_id + 2 END, CASE WHEN item_id % 9 = 0 THEN item_id END], lambda x: x IS NOT NULL)::VARCHAR[])) AS truth,
                   list_concat(CASE WHEN item_id % 5 = 0 THEN [] ELSE [item_id, item_id + 1, item_id + 2] END, CASE WHEN item_id % 3 = 0 THEN [item_id + 7, item_id * 2] ELSE [] END)::VARCHAR[] AS ranking,
                   item_id % 4 <> 0 AND item_id % 5 <> 0 AS evaluable
            FROM benchmark WHERE item_id % 3 = 0),
        f AS (SELECT *, list_min(list_filter(range(1, len(ranking) + 1), lambda k: list_contains(truth, ranking[k]))) AS first FROM r)
        SELECT i AS query_id, array_to_string(truth, ',') AS truth, array_to_string(ranking, ',') AS ranking, evaluable,
               """ + ", ".join(f"CASE WHEN coalesce(first, 1000) <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_{k}" for k in (1, 3, 5, 10)) + """, round(coalesce(1 / first, 0), 6) AS rr FROM f""",
    "m14_describe": """
        WITH x AS (SELECT 'size' AS metric, p_size::DOUBLE AS x FROM part UNION ALL SELECT 'price', p_retailprice::DOUBLE FROM part)
        SELECT metric, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS least, round(quantile_cont(x, 0.25), 4) AS q25,
               round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.75), 4) AS q75, round(max(x), 4) AS largest FROM x GROUP BY metric""",
    "j5_confidence": """
        WITH p AS (SELECT vec_id AS query_id, exp(-abs(unnest(embedding)::DOUBLE)) AS p FROM embeddings)
        SELECT query_id, round(coalesce(median(p) FILTER (p < 0.8), median(p)), 6) AS confidence, count(*) FILTER (p < 0.8) AS n_factual FROM p GROUP BY query_id""",
    "j6_overrides": _with(CLAIMS, """SELECT told.query_id, any_value(told.query_id % 100) / 100 > 0.75 AND coalesce(round(avg(best_entailment), 8), 0) < 0.4 AS overrides
        FROM told LEFT JOIN checked USING (query_id) GROUP BY told.query_id"""),
    "j7_entities": _with(BASE, """SELECT query_id, string_agg(DISTINCT source, ',' ORDER BY source) AS entities
        FROM sparse JOIN chunks USING (domain, chunk_id) JOIN q USING (query_id) WHERE NOT contains(lower(question), lower(source)) GROUP BY query_id"""),
    "b4_buckets": """
        WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 2 ELSE 1 END AS batch FROM events)
        SELECT user_id, arg_max(event_id, (batch, ts, event_id)) AS event_id, arg_max(event_type, (batch, ts, event_id)) AS event_type FROM e GROUP BY user_id""",
    "a8_first_file": "SELECT user_id, event_type, max(event_id) AS event_id FROM events JOIN (SELECT user_id, min(event_type) AS event_type FROM events GROUP BY ALL) USING (user_id, event_type) GROUP BY ALL",
    "d16_guide": """
        SELECT conv_id, role || turn AS section, unnest([0, 1])::BIGINT AS item_no, unnest(['turn ' || turn, length(coalesce(text, ''))::VARCHAR]) AS item FROM conversations""",
    "d16_builds": """
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) - 1 AS build_no FROM conversations),
        l AS (SELECT conv_id, build_no, role AS name, turn::VARCHAR AS level, CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS ability FROM t)
        SELECT * FROM l UNION ALL SELECT conv_id, build_no, name, '9', 'z' FROM l WHERE level <> '9'""",
    "d16_items": """
        SELECT conv_id, role || '_items' AS phase, 0::BIGINT AS item_no, 'item ' || max(turn) AS item, 'for turn ' || max(turn) AS description FROM conversations GROUP BY conv_id, role""",
    "d7_blocks": """
        SELECT conv_id || '-' || turn AS page, 'abilities' AS kind, 't' || turn AS ability,
               md5('{{Ability' || chr(10) || '| name = t' || turn || chr(10) || '| v = ' || repeat('{{n|', 3 * turn) || translate(coalesce(text, ''), '{}|' || chr(10), '') || repeat('}}', 3 * turn) || chr(10) || '}}') AS block_md5
        FROM conversations""",
    "c2_variables": """
        WITH t AS (SELECT conv_id, role || ' ' || turn AS ability, turn FROM conversations)
        SELECT conv_id, ability || ' cooldown' AS name, turn || '/9' AS value FROM t
        UNION ALL SELECT conv_id, ability || ' value1', turn || '.5' FROM t
        UNION ALL SELECT conv_id, ability || ' value2 alt', turn || '0' FROM t
        UNION ALL SELECT conv_id, 'of' || turn, turn || '0' FROM t
        UNION ALL SELECT conv_id, ability || ' value3', ((turn || '.5')::DOUBLE / 100)::VARCHAR FROM t
        UNION ALL SELECT conv_id, arg_max(ability, turn) || ' mana', '70' FROM t GROUP BY conv_id""",
    "c10_references": """
        SELECT conv_id, 'start ' || CASE WHEN min(turn) > 1 THEN '[none yet]'
                    WHEN min(turn) = 0 THEN 'start.' || string_agg(role, '.' ORDER BY turn) FILTER (turn <= 1)
                    ELSE '[VAR:v0].' || arg_min(role, turn) END || ' end [VAR:none]' AS text
        FROM conversations GROUP BY conv_id""",
    "d19_records": """
        SELECT conv_id, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (turn % 4 <> 3), '') AS turns,
               CASE WHEN bool_or(turn % 4 = 3) THEN '1 braces open, 0 close' END AS error, string_agg(DISTINCT role, ',' ORDER BY role) AS roles
        FROM conversations GROUP BY conv_id""",
    "e7_deep_nodes": """
        SELECT doc_id, array_to_string(list_transform(range(doc_id % 16), lambda x: 'a'), '.') AS path, 0::BIGINT AS item_no, '["' || doc_id || '"]' AS text FROM documents""",
    "g4_token_metadata": f"SELECT doc_id, 2 AS n_keys, source, len({_tokens('text')}) AS token_count FROM documents",
    "a7_chunk_texts": """
        WITH l AS (
            SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 4 WHEN 0 THEN 'c' || (doc_id % 100) WHEN 1 THEN 'm' || doc_id WHEN 2 THEN 'G_axe_unknown_path_' || doc_id END AS chunk_id
            FROM documents)
        SELECT chunk_id, md5(arg_max(text, doc_id)) AS content_md5 FROM l WHERE chunk_id IS NOT NULL GROUP BY chunk_id""",
}
