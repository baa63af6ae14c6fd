"""SQL for DuckDB over the same tables, written apart from the Spark plans."""

from __future__ import annotations

from lectern.functions import text as fixed
from lectern.functions import urls

_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.STOP_WORDS) + "]"
_CJK = "[㐀-鿿]"


def _flat(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{fixed.SPACE}', ' ', 'g'))"


def _pairs(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({x}, '{_CJK}+'), lambda r: list_transform(range(1, length(r)), lambda k: substring(r, k, 2))))"


def _tokens(x: str) -> str:
    return f"list_distinct(list_concat(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_-]{{2,}}'), {_pairs(f'lower(coalesce({x}, {chr(39)*2}))')}))"


def _terms(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    return f"list_filter(list_concat(list_filter(regexp_extract_all({low}, '[a-z0-9_]+'), lambda w: length(w) >= 2), flatten(list_transform(regexp_extract_all({low}, '{_CJK}+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda k: substring(r, k, 2)) END))), lambda w: NOT list_contains({_STOP}, w))"


_ASKED = f"asked AS (SELECT item_id AS query_id, {_flat('text')} AS question FROM benchmark)"
_MESSAGES = "messages AS (SELECT conv_id, turn AS msg_idx, role, coalesce(text, '') AS content FROM conversations WHERE role IN ('user', 'assistant'))"
_TURNS = f"""{_MESSAGES},
placed AS (SELECT *, row_number() OVER w - 1 AS turn_idx, lead(role) OVER w AS next_role, lead(content) OVER w AS answer FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY msg_idx)),
turns AS (SELECT conv_id, turn_idx, content AS question, answer, length(content) + length(answer) AS turn_length FROM placed WHERE role = 'user' AND next_role = 'assistant')"""
_LAST = "last_asked AS (SELECT conv_id, arg_max(content, msg_idx) AS question FROM messages WHERE role = 'user' GROUP BY conv_id)"
_HELD = f"""held AS (SELECT doc_id AS article_id, lang || ' > ' || source AS section, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_flat('x')} <> '') AS ls FROM documents),
lines AS (SELECT article_id, section, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS ord FROM held)"""
_LINES = f"{_HELD},\nparts AS (SELECT article_id, ord AS chunk_idx, section || ' > part ' || (ord // 5) AS section, text FROM lines)"
_TURN_ASKED = f"""{_ASKED}, one_asked AS (SELECT d.doc_id AS article_id, a.query_id, a.question, d.lang || ' > ' || d.source AS base FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS n FROM asked) a ON a.n = d.doc_id % (SELECT count(*) FROM asked))"""


def _anchors(foci: str) -> str:
    """CTEs from a CTE foci(article_id, query_id, focus_text, focus_section) over parts to anchored(article_id, query_id, chunk_idx, place)."""
    both = "p.section || chr(10) || p.text"
    share = lambda q, c: f"(CASE WHEN len({q}) = 0 THEN 0.0 ELSE len(list_intersect({q}, {c})) / len({q}) END)"
    return f"""{foci},
told AS (SELECT *, {_tokens('focus_text')} AS ft, {_tokens('focus_section')} AS st, {_flat("lower(coalesce(focus_text, ''))")} AS fn, lower(trim(coalesce(focus_section, ''))) AS given FROM foci),
own AS (SELECT p.*, {_tokens(both)} AS ct, {_tokens('p.section')} AS pt, regexp_replace(lower({both}), '{fixed.SPACE}', ' ', 'g') AS content FROM parts p SEMI JOIN foci f ON f.article_id = p.article_id),
scored_lines AS (SELECT t.article_id, t.query_id, o.chunk_idx, o.section, t.given <> '' AND lower(o.section) = t.given AS exact,
  {share('t.ft', 'o.ct')} + {share('t.st', 'o.pt')} * 0.5 + (CASE WHEN t.fn <> '' AND contains(o.content, t.fn) THEN 0.5 ELSE 0.0 END) + (CASE WHEN t.given <> '' AND lower(o.section) = t.given THEN 0.5 ELSE 0.0 END) AS score FROM told t JOIN own o USING (article_id)),
first_line AS (SELECT * FROM scored_lines QUALIFY row_number() OVER (PARTITION BY article_id, query_id ORDER BY exact DESC, score DESC, chunk_idx) = 1),
near_lines AS (SELECT f.article_id, f.query_id, p.chunk_idx, CASE p.chunk_idx - f.chunk_idx WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN -1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS o FROM first_line f JOIN parts p ON p.article_id = f.article_id AND abs(p.chunk_idx - f.chunk_idx) <= 2 WHERE f.score > 0),
anchored AS (SELECT article_id, query_id, chunk_idx, row_number() OVER (PARTITION BY article_id, query_id ORDER BY o) AS place FROM near_lines)"""


def _whole(q: str) -> str:
    """Whether a lower-case question is about a whole article; the patterns are the fixed values."""
    has = lambda pattern: f"regexp_matches({q}, '{pattern}')"
    return f"(({has(fixed.WHOLE_SCOPE_ZH)} AND {has(fixed.WHOLE_TASK_ZH)}) OR ({has(fixed.WHOLE_SCOPE_EN)} AND {has(fixed.WHOLE_TASK_EN)}) OR {has(fixed.WHOLE_ABOUT_EN)})"


def _bm25(queries: str, most: int, of: str = "SELECT source AS article_id, doc_id AS chunk_idx, lang AS section, text FROM documents", bound: bool = False) -> str:
    """CTEs from a CTE asked_text(query_id, pos, text; article_id if bound) to best(article_id, query_id, pos, chunk_idx, matched, score, rank)."""
    own = "article_id, " if bound else ""
    return f"""{queries},
searched AS ({of}),
fields AS (SELECT article_id, chunk_idx, 'section' AS field, {_terms('section')} AS terms FROM searched
  UNION ALL SELECT article_id, chunk_idx, 'text', {_terms('text')} FROM searched),
stats AS (SELECT article_id, field, count(*) AS chunks, avg(len(list_distinct(terms))) AS avglen FROM fields GROUP BY ALL),
opened AS (SELECT article_id, chunk_idx, field, len(list_distinct(terms)) AS n_terms, unnest(terms) AS term FROM fields),
post AS (SELECT article_id, chunk_idx, field, n_terms, term, count(*) AS tf FROM opened GROUP BY ALL),
df AS (SELECT article_id, field, term, count(*) AS n FROM post GROUP BY ALL),
wanted AS (SELECT {own}query_id, pos, list_distinct({_terms('text')}) AS terms FROM asked_text),
wanted_terms AS (SELECT {own}query_id, pos, len(terms) AS n_wanted, unnest(terms) AS term FROM wanted),
weights AS (SELECT p.article_id, p.chunk_idx, p.term, sum((CASE WHEN p.field = 'section' THEN 3.0 ELSE 1.0 END) * ln(1 + (s.chunks - d.n + 0.5) / (d.n + 0.5)) * (0.5 + p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.7 + 0.7 * p.n_terms / s.avglen)))) AS w
  FROM post p JOIN df d USING (article_id, field, term) JOIN stats s USING (article_id, field) GROUP BY ALL),
scored AS (SELECT article_id, query_id, pos, chunk_idx, n_wanted, count(*) AS matched, round(sum(w), 9) AS score FROM weights JOIN wanted_terms USING ({own}term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY article_id, query_id, pos ORDER BY score DESC, chunk_idx) AS rank FROM scored WHERE matched >= CASE WHEN n_wanted >= 3 THEN 2 ELSE 1 END),
best AS (SELECT * FROM ranked WHERE rank <= {most})"""


_URL = """CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN
  lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1))
  || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/' ELSE rtrim_one END
  || CASE WHEN params = '' THEN '' ELSE '?' || params END
  || CASE WHEN regexp_matches(frag, '^#!?/') THEN frag ELSE '' END END"""

SQL = {
    "url_normalize": f"""WITH parts AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/$', '') AS rtrim_one, regexp_extract(url, '(#.*)$', 1) AS frag,
      array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT list_contains({list(urls.TRACKING)}, lower(string_split(p, '=')[1])))), '&') AS params FROM pages)
      SELECT page_id, {_URL} AS normalized_url, page_id::VARCHAR || ':' || {_URL} AS page_key, regexp_matches(lower(url), '^https?://') AS supported FROM parts""",
    "url_hosts": "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "token_sets": f"WITH t AS (SELECT doc_id, list_sort({_tokens('text')}) AS tokens FROM documents) SELECT doc_id, len(tokens)::BIGINT AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM t",
    "term_stats": f"WITH t AS (SELECT lang, doc_id, unnest({_terms('text')}) AS term FROM documents) SELECT lang, term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM t GROUP BY ALL",
    "overlap_topk": f"""WITH {_ASKED}, q AS (SELECT query_id, {_tokens('question')} AS t FROM asked), d AS (SELECT doc_id, {_tokens('text')} AS t FROM documents),
      s AS (SELECT query_id, doc_id, round(len(list_intersect(q.t, d.t)) / len(q.t), 6) AS score FROM q, d WHERE len(list_intersect(q.t, d.t)) > 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
    "bm25_topk": f"WITH {_ASKED}, {_bm25('asked_text AS (SELECT query_id, 0 AS pos, question AS text FROM asked)', 5)} SELECT article_id, query_id, chunk_idx AS doc_id, matched, round(score, 5) AS score, rank FROM best",
    "rrf_fusion": f"""WITH {_ASKED}, words AS (SELECT query_id, string_split(question, ' ') AS w, (len(string_split(question, ' ')) + 1) // 2 AS h FROM asked), halves AS (SELECT query_id, 0 AS pos, array_to_string(w[1:h], ' ') AS text FROM words UNION ALL SELECT query_id, 1, array_to_string(w[h + 1:], ' ') FROM words),
      {_bm25("asked_text AS (SELECT query_id, pos, text FROM halves WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY pos) = 1)", 20)},
      f AS (SELECT article_id, query_id, chunk_idx AS doc_id, round(sum(1.0 / (60 + rank)), 12) AS fused, min(rank) AS best_rank FROM best GROUP BY ALL),
      p AS (SELECT *, row_number() OVER (PARTITION BY article_id, query_id ORDER BY fused DESC, best_rank, doc_id) AS place FROM f)
      SELECT article_id, query_id, doc_id, round(fused, 9) AS fused, best_rank, place FROM p WHERE place <= 5""",
    "neighbor_window": f"WITH {_LINES} SELECT article_id, chunk_idx, CASE WHEN lag(section) OVER w = section THEN lag(chunk_idx) OVER w END AS before, CASE WHEN lead(section) OVER w = section THEN lead(chunk_idx) OVER w END AS after FROM parts WINDOW w AS (PARTITION BY article_id ORDER BY chunk_idx)",
    "exact_match_rank": f"""WITH {_ASKED}, lits AS (SELECT query_id, unnest(list_distinct(list_concat([{_flat('lower(question)')}], list_filter(list_transform(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_./:-]{{3,}}'), lambda w: lower(w)), lambda w: NOT list_contains({_STOP}, w))))) AS literal FROM asked),
      body AS (SELECT source AS article_id, doc_id, {_flat("lower(lang || chr(10) || coalesce(text, ''))")} AS content FROM documents),
      m AS (SELECT article_id, query_id, doc_id, max(length(literal)) AS longest, count(*) AS matches FROM body JOIN lits ON length(literal) >= 3 AND contains(content, literal) GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY article_id, query_id ORDER BY longest DESC, matches DESC, doc_id) AS place FROM m) SELECT * FROM r WHERE place <= 3""",
    "section_scope": f"""WITH {_LINES}, f AS (SELECT doc_id AS article_id, doc_id % 3 AS turn, lower(CASE doc_id % 3 WHEN 0 THEN lang || ' > ' || source || ' > part 1' ELSE lang || ' > ' || source END) AS given FROM documents),
      i AS (SELECT p.* FROM parts p JOIN f USING (article_id) WHERE turn = 2 OR lower(section) = given OR starts_with(lower(section), given || ' > ')),
      s AS (SELECT article_id, chunk_idx, sum(length(section) + length(text) + 3) OVER w AS used, row_number() OVER w AS n FROM i WINDOW w AS (PARTITION BY article_id ORDER BY chunk_idx ROWS UNBOUNDED PRECEDING))
      SELECT article_id, chunk_idx FROM s WHERE used <= 2000 AND n <= 8""",
    "coverage_groups": "SELECT source AS article_id, doc_id AS chunk_idx, CASE WHEN length(source) % 2 = 0 THEN source || ' > ' || lang WHEN min(lang) OVER w = max(lang) OVER w THEN lang || ' > ' || source ELSE lang END AS group_key FROM documents WINDOW w AS (PARTITION BY source)",
    "even_spacing": f"""WITH {_LINES}, n AS (SELECT article_id, count(*) AS n, least(count(*), 5) AS k FROM lines GROUP BY 1), i AS (SELECT article_id, n, k, unnest(range(greatest(k, 1))) AS i FROM n)
      SELECT DISTINCT article_id, (CASE WHEN k <= 1 THEN 0 ELSE floor(i * (n - 1) / (k - 1) + 0.5) END)::INTEGER AS idx FROM i""",
    "whole_question": f"""WITH {_MESSAGES}, q AS (SELECT conv_id, msg_idx, lower(trim((CASE msg_idx % 4 WHEN 0 THEN 'Summarize the whole page: ' WHEN 1 THEN 'What is the article about? ' WHEN 2 THEN '请总结全文：' ELSE '' END) || content)) AS q FROM messages WHERE role = 'user')
      SELECT conv_id, msg_idx, {_whole('q')} AS whole FROM q""",
    "completed_turns": f"WITH {_TURNS} SELECT * FROM turns",
    "recent_turns_budget": f"""WITH {_TURNS}, r AS (SELECT conv_id, turn_idx, row_number() OVER w AS newest, sum(turn_length) OVER w AS used FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn_idx DESC ROWS UNBOUNDED PRECEDING))
      SELECT conv_id, turn_idx, newest, used::BIGINT AS used FROM r WHERE newest <= 2 AND used <= 1500""",
    "recalled_turns": f"""WITH {_TURNS}, {_LAST}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_idx DESC) AS newest FROM turns),
      s AS (SELECT n.conv_id, n.turn_idx, len(list_intersect({_tokens('l.question')}, {_tokens("n.question || chr(10) || n.answer")})) / len({_tokens('l.question')}) AS score FROM n JOIN last_asked l USING (conv_id) WHERE newest > 1),
      r AS (SELECT conv_id, turn_idx, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn_idx DESC) AS place FROM s WHERE score > 0)
      SELECT conv_id, turn_idx, round(score, 6) AS score, place FROM r WHERE place <= 2""",
    "memory_selection": f"""WITH RECURSIVE {_TURNS}, {_LAST}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_idx DESC) AS newest, sum(turn_length) OVER (PARTITION BY conv_id) AS total FROM turns),
      kept AS (SELECT conv_id, turn_idx, turn_length FROM n WHERE newest = 1 AND turn_length <= 900),
      s AS (SELECT n.conv_id, n.turn_idx, n.turn_length, len(list_intersect({_tokens('l.question')}, {_tokens("n.question || chr(10) || n.answer")})) / len({_tokens('l.question')}) AS score FROM n JOIN last_asked l USING (conv_id) WHERE newest > 1),
      offers AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn_idx DESC) AS place FROM s WHERE score > 0 QUALIFY place <= 2),
      fold AS (SELECT DISTINCT n.conv_id, 0::BIGINT AS place, 1800 - coalesce(k.turn_length, 0) AS remaining, -1::BIGINT AS taken FROM n LEFT JOIN kept k USING (conv_id)
        UNION ALL SELECT f.conv_id, o.place, f.remaining - CASE WHEN o.turn_length <= f.remaining THEN o.turn_length ELSE 0 END, CASE WHEN o.turn_length <= f.remaining THEN o.turn_idx ELSE -1 END FROM fold f JOIN offers o ON o.conv_id = f.conv_id AND o.place = f.place + 1)
      SELECT n.conv_id, n.turn_idx, CASE WHEN total <= 1800 THEN 'all' WHEN k.turn_idx IS NOT NULL THEN 'recent' WHEN f.taken IS NOT NULL THEN 'recalled' ELSE 'omitted' END AS how,
        NOT total <= 1800 AND (first.turn_idx IS NULL OR n.turn_idx < first.turn_idx) AS compacted
      FROM n LEFT JOIN kept k ON k.conv_id = n.conv_id AND k.turn_idx = n.turn_idx LEFT JOIN fold f ON f.conv_id = n.conv_id AND f.taken = n.turn_idx LEFT JOIN kept first ON first.conv_id = n.conv_id""",
    "memory_counts": None,
    "diagnostic_rules": """WITH c AS (SELECT doc_id, doc_id % 3 = 0 AS body, doc_id % 200 AS readable, doc_id % 700 AS whole, doc_id % 7 = 0 AS fallback FROM documents)
      SELECT doc_id, concat_ws(',', CASE WHEN readable < 80 THEN 'low-readable-text' END, CASE WHEN body THEN 'body-fallback' END, CASE WHEN false THEN '' END, CASE WHEN doc_id % 3 + doc_id % 4 + doc_id % 5 > 0 THEN 'unsupported-structure' END, CASE WHEN doc_id % 6 > 0 THEN 'dynamic-loading' END,
        CASE WHEN doc_id % 7 > 0 THEN 'excluded-blocks' END, CASE WHEN NOT fallback AND whole - readable >= 120 AND whole - readable > 1.5 * readable THEN 'unmatched-markup' END) AS issues FROM c""",
    "stale_operations": f"""WITH {_MESSAGES}, v AS (SELECT conv_id, count(*) AS now FROM messages WHERE role = 'user' GROUP BY 1) SELECT m.conv_id::VARCHAR AS key, m.msg_idx, m.msg_idx % 4 AS version FROM messages m LEFT JOIN v USING (conv_id) WHERE coalesce(now, 0) = m.msg_idx % 4""",
    "trace_retention": f"WITH {_MESSAGES} SELECT conv_id, msg_idx FROM messages WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) <= 2",
    "question_rail": f"WITH {_MESSAGES}, q AS (SELECT conv_id, msg_idx, {_flat('content')} AS question FROM messages WHERE role = 'user') SELECT * FROM q WHERE question <> '' QUALIFY count(*) OVER (PARTITION BY conv_id) >= 3",
    "archive_summary": f"""WITH {_MESSAGES} SELECT 'https://example.com/c/' || conv_id AS url, 'Conversation ' || conv_id AS title, min(msg_idx) AS created_at, max(msg_idx) AS updated_at, count(*) FILTER (role = 'user') AS question_count, arg_max(content, msg_idx) FILTER (role = 'user') AS last_question FROM messages GROUP BY conv_id""",
    "archive_search": f"""WITH {_MESSAGES} SELECT 'https://example.com/c/' || conv_id AS url, count(*) FILTER (role = 'user') AS question_count FROM messages GROUP BY conv_id HAVING bool_or(contains(lower(content), 'the'))""",
    "archive_usage": f"WITH {_MESSAGES} SELECT coalesce(sum(strlen(content)), 0)::BIGINT AS bytes_in_use, 10485760::BIGINT AS quota_bytes, coalesce(sum(strlen(content)), 0) >= 0.8 * 10485760 AS near_limit FROM messages",
    "archive_bytes": f"""WITH {_MESSAGES}, l AS (SELECT *, lead(role) OVER w AS next_role, lead(msg_idx) OVER w AS next_idx, lead(content) OVER w AS answer, max(msg_idx) OVER (PARTITION BY conv_id) AS last_idx FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY msg_idx)),
      t AS (SELECT conv_id, conv_id // 2 AS page, msg_idx, last_idx, '{{"id":"' || conv_id || '-' || msg_idx || '","role":"user","content":' || to_json(content) || ',"created_at":' || msg_idx || '}},{{"id":"' || conv_id || '-' || next_idx || '","role":"assistant","content":' || to_json(answer) || ',"created_at":' || next_idx || '}}' AS j
        FROM l WHERE role = 'user' AND next_role = 'assistant'),
      c AS (SELECT strlen('{{"normalized_url":"https://example.com/p/' || page || '","schema_version":2,"title":"Page ' || arg_max(conv_id, last_idx * 1000000 - conv_id) || '","messages":[' || string_agg(j, ',') || '],"created_at":' || min(msg_idx) || ',"updated_at":1000}}') AS n FROM t GROUP BY page)
      SELECT coalesce(sum(n), 0)::BIGINT AS bytes_in_use, 10485760::BIGINT AS quota_bytes, round(coalesce(sum(n), 0) / 10485760, 6) AS share, coalesce(sum(n), 0) / 10485760 >= 0.8 AS near_limit FROM c""",
    "archive_merge": f"""WITH {_TURNS}, rows AS (SELECT conv_id % 2 AS src, 'https://example.com/p/' || (conv_id // 2) AS url, CASE WHEN turn_idx = 0 THEN 'first' ELSE conv_id || '-' || turn_idx END AS question_id, turn_idx AS pos, question FROM turns),
      one AS (SELECT url, question_id, min(src * 1000000 + pos) AS spot, arg_max(question, src * 1000000 + pos) AS question, arg_max(pos, src * 1000000 + pos) AS created_at FROM rows GROUP BY ALL)
      SELECT url, question_id, row_number() OVER (PARTITION BY url ORDER BY created_at, spot) - 1 AS ord, created_at, question FROM one""",
    "outline": """WITH f AS (SELECT lang, source, min(doc_id) AS first FROM documents GROUP BY ALL), u AS (SELECT lang, first, '- ' || source AS line, sum(length(source) + 3) OVER (PARTITION BY lang ORDER BY first ROWS UNBOUNDED PRECEDING) - 1 AS used FROM f)
      SELECT lang, string_agg(line, chr(10) ORDER BY first) AS outline FROM u WHERE used <= 100 GROUP BY lang""",
    "full_context_fit": """SELECT source AS article_id, 'full-context' AS strategy, count(*) AS chunks, sum(length(lang) + length(coalesce(text, '')) + 3)::BIGINT AS article_characters FROM documents GROUP BY 1 HAVING sum(length(lang) + length(coalesce(text, '')) + 3) <= 110000""",
    "query_plan_parse": f"""WITH {_ASKED}, c AS (SELECT query_id, query_id % 5 AS shape, left(question, 500) AS q, left(trim(repeat('ab ', 300)), 500) AS long FROM asked),
      p AS (SELECT query_id, shape, CASE shape WHEN 0 THEN q WHEN 1 THEN q WHEN 4 THEN long END AS rewritten, CASE shape WHEN 0 THEN [q] || list_filter(['b', 'c', 'd'], lambda x: x <> lower(q)) WHEN 1 THEN [q] WHEN 4 THEN [long] END AS qs, q FROM c)
      SELECT query_id, rewritten, array_to_string(qs, '|') AS queries, CASE WHEN shape = 1 THEN 'need/r|' || q || '/evidence for the answer' ELSE array_to_string(list_transform(qs, lambda x: x || '/evidence for the answer'), '|') END AS needs,
        CASE WHEN rewritten IS NULL THEN NULL WHEN shape = 0 THEN 'multi-section' ELSE 'focused' END AS coverage, CASE WHEN rewritten IS NULL THEN NULL ELSE shape = 0 END AS use_conversation FROM p""",
    "checkpoint_validate": f"""WITH b AS (SELECT item_id AS query_id, regexp_replace(text, '[\\n"\\\\]', ' ', 'g') AS t FROM benchmark), g AS (SELECT query_id, {_flat("CASE WHEN query_id % 2 = 0 THEN t ELSE repeat(t, 9) END")} AS goal FROM b)
      SELECT query_id, length(goal) <= 600 AS valid, (CASE WHEN length(goal) <= 600 THEN length(goal) ELSE 0 END)::BIGINT AS goal_length FROM g""",
    "chunk_bounds": f"WITH {_LINES} SELECT article_id, sum(length(text))::BIGINT AS characters, count(*) AS lines FROM lines GROUP BY 1",
    "reading_scope": f"WITH {_LINES} SELECT article_id, section, count(*) AS blocks, min(ord) AS first_ord FROM lines GROUP BY ALL",
    "focus_anchor": f"""WITH {_TURN_ASKED}, {_LINES}, {_anchors("foci AS (SELECT article_id, query_id, question AS focus_text, base || ' > part 1' AS focus_section FROM one_asked)")}
      SELECT article_id, query_id, chunk_idx, place FROM anchored WHERE place <= 3""",
    "select_context": f"""WITH {_TURN_ASKED}, {_LINES}, sized AS (SELECT *, 'chunk-' || (chunk_idx + 1) AS chunk_id, length(section) + length(text) + 3 AS cost, lag(section) OVER w = section AS joins, lead(section) OVER w = section AS joined, lag(length(text)) OVER w AS before, lead(length(text)) OVER w AS after FROM parts WINDOW w AS (PARTITION BY article_id ORDER BY chunk_idx)),
      whole AS (SELECT article_id, query_id, 'whole' AS mode, false AS truncated, 'whole' AS branch, row_number() OVER (PARTITION BY article_id, query_id ORDER BY chunk_idx) AS rank, chunk_id, cost FROM one_asked JOIN sized USING (article_id) WHERE article_id % 4 = 0 OR ({_whole('lower(question)')})),
      rest AS (SELECT * FROM one_asked WHERE article_id % 4 <> 0 AND NOT ({_whole('lower(question)')})),
      section AS (SELECT article_id, query_id, 'section' AS branch, chunk_idx FROM rest JOIN sized USING (article_id) WHERE article_id % 4 = 1 AND lower(section) = lower(base || ' > part 1') QUALIFY row_number() OVER (PARTITION BY article_id, query_id ORDER BY chunk_idx) = 1),
      left_1 AS (SELECT * FROM rest r ANTI JOIN section s ON s.article_id = r.article_id),
      {_anchors("foci AS (SELECT article_id, query_id, CASE WHEN article_id % 4 = 2 THEN question END AS focus_text, CASE WHEN article_id % 4 = 1 THEN base || ' > part 1' END AS focus_section FROM left_1 WHERE article_id % 4 <> 3)")},
      anchor AS (SELECT article_id, query_id, 'anchor' AS branch, chunk_idx FROM anchored WHERE place = 1),
      left_2 AS (SELECT * FROM left_1 l ANTI JOIN anchor a ON a.article_id = l.article_id),
      {_bm25("asked_text AS (SELECT article_id, query_id, 0 AS pos, question AS text FROM left_2)", 20, "SELECT * FROM parts WHERE article_id IN (SELECT article_id FROM left_2)", True)},
      found AS (SELECT b.article_id, b.query_id, s.chunk_idx, s.chunk_idx - (CASE WHEN s.joins THEN 1 ELSE 0 END) AS lo, s.chunk_idx + (CASE WHEN s.joined THEN 1 ELSE 0 END) AS hi, s.cost + (CASE WHEN s.joins THEN s.before + 1 ELSE 0 END) + (CASE WHEN s.joined THEN s.after + 1 ELSE 0 END) AS cost
        FROM best b JOIN sized s ON s.article_id = b.article_id AND s.chunk_idx = b.chunk_idx WHERE b.rank = 1)
      SELECT article_id, query_id, mode, truncated, branch, rank, chunk_id, cost FROM whole
      UNION ALL SELECT article_id, query_id, 'relevant', false, branch, 1, chunk_id, cost FROM (SELECT * FROM section UNION ALL SELECT * FROM anchor) JOIN sized USING (article_id, chunk_idx)
      UNION ALL SELECT article_id, query_id, 'relevant', false, 'search', 1, 'window-chunk-' || (lo + 1) || '-chunk-' || (hi + 1), cost FROM found""",
    "request_budgets": f"""WITH {_LINES}, s AS (SELECT article_id, sum(length(section) + length(text) + 3)::BIGINT AS full_ FROM parts GROUP BY 1),
      c AS (SELECT article_id, full_, CASE WHEN article_id % 5 = 0 THEN 700 ELSE 0 END AS cp, article_id % 1000 * 20 AS history, article_id % 2 = 0 AS uses, article_id % 3 = 0 AS planned FROM s),
      r AS (SELECT *, 3000 - cp AS room, full_ <= 3000 - cp AS fits FROM c),
      h AS (SELECT *, CASE WHEN fits THEN room - full_ ELSE least(CASE WHEN uses THEN 16000 ELSE 8000 END, room) END AS most FROM r)
      SELECT article_id, 0::BIGINT AS query_id, 3000::BIGINT AS "limit", full_ AS full_article_characters, cp::BIGINT AS checkpoint_characters, room::BIGINT AS available, most::BIGINT AS history_limit, least(history, most)::BIGINT AS history_characters,
        (CASE WHEN fits THEN full_ ELSE greatest(1, room - least(history, most)) END)::BIGINT AS article_budget, CASE WHEN fits THEN 'full-context' ELSE 'fused-retrieval' END AS strategy, CASE WHEN fits THEN 'whole' ELSE 'relevant' END AS mode, NOT fits AS is_truncated, NOT fits AND NOT planned AS needs_planning FROM h""",
    "conversation_archive": f"""WITH {_MESSAGES}, m AS (SELECT *, lead(role) OVER w AS next_role, lead(msg_idx) OVER w AS next_idx FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY msg_idx)),
      t AS (SELECT conv_id, conv_id // 2 AS page, conv_id % 2 AS src, msg_idx, next_idx FROM m WHERE role = 'user' AND next_role = 'assistant')
      SELECT 'https://example.com/p/' || page AS normalized_url, 'Page ' || max(conv_id) AS title, coalesce(min(msg_idx) FILTER (src = 0), min(msg_idx)) AS created_at, CASE WHEN max(src) = 1 THEN 2000 ELSE 1000 END AS updated_at, 2 * count(*) AS n_messages,
        string_agg(conv_id || '-' || msg_idx || ',' || conv_id || '-' || next_idx, ',' ORDER BY msg_idx, src) AS message_ids FROM t GROUP BY page""",
    "archive_list": f"""WITH {_MESSAGES}, m AS (SELECT *, lead(role) OVER w AS next_role, lead(content) OVER w AS answer FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY msg_idx)),
      t AS (SELECT 'https://example.com/p/' || conv_id AS normalized_url, 'Page ' || conv_id AS title, msg_idx, content, answer FROM m WHERE role = 'user' AND next_role = 'assistant'),
      c AS (SELECT normalized_url, title, min(msg_idx) AS created_at, 5::BIGINT AS updated_at, count(*) AS question_count, arg_max(content, msg_idx) AS last_question FROM t GROUP BY 1, 2 HAVING bool_or(contains(lower(content), 'the') OR contains(lower(answer), 'the')))
      SELECT * FROM c""",
    "context_clear": f"WITH {_MESSAGES} SELECT conv_id AS tab_id, 0::BIGINT AS n_messages, CASE WHEN conv_id % 3 = 0 THEN max(msg_idx) ELSE 9999 END AS updated_at FROM messages GROUP BY 1",
    "turn_recovery": f"""WITH {_MESSAGES} SELECT conv_id AS tab_id, 'ready' AS status, CASE WHEN conv_id % 2 = 0 THEN 9999 ELSE max(msg_idx) END AS updated_at,
      CASE WHEN conv_id % 2 = 0 THEN coalesce(conv_id || '-' || max(msg_idx) FILTER (role = 'user'), '') ELSE '' END AS failed FROM messages GROUP BY conv_id""",
    "checkpoint_prepare": f"""WITH {_TURNS}, l AS (SELECT conv_id, list(turn_idx::VARCHAR ORDER BY turn_idx) AS ids FROM turns GROUP BY 1), k AS (SELECT *, CASE WHEN conv_id % 8 < 4 AND conv_id % 4 BETWEEN 1 AND len(ids) THEN conv_id % 4 ELSE 0 END AS done FROM l)
      SELECT conv_id, done > 0 AS keeps_previous, array_to_string(ids[done + 1:], ',') AS answers, len(ids)::BIGINT AS covered, len(ids) > done AS needs_update FROM k""",
    "history_lines": f"""WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_idx DESC) AS n FROM turns)
      SELECT conv_id, string_agg('User: ' || left(question, 60) || chr(10) || 'Assistant: ' || left(answer, 60), chr(10) ORDER BY turn_idx) AS history FROM r WHERE n <= 2 GROUP BY 1""",
    "translation_retry": f"""WITH {_MESSAGES}, c AS (SELECT conv_id, msg_idx, {_flat('lower(content)')} AS given, lower({_flat("CASE WHEN msg_idx % 2 = 0 THEN upper(content) ELSE content || 'x' END")}) AS output FROM messages)
      SELECT conv_id, msg_idx, length(given) > 1 AND regexp_matches(given, '^[a-z][a-z ''-]*$') AND given = output AS again FROM c""",
    "markdown_normalize": None,
}
SQL["indexed_topk"] = SQL["bm25_topk"]
SQL["memory_counts"] = f"SELECT conv_id, count(*) FILTER (how IN ('all', 'recent')) AS recent_turns, count(*) FILTER (how = 'recalled') AS recalled_turns, count(*) FILTER (how = 'omitted') AS omitted_turns, count(*) FILTER (compacted) AS compacted_turns FROM ({SQL['memory_selection']}) GROUP BY 1"
SQL = {k: v for k, v in SQL.items() if v}
