"""SQL for queries whose choices depend on those before them: recursive, one step a row."""

from __future__ import annotations

from lectern.functions import text as fixed
from lectern.operators import evidence as E
from lectern.plans.sql import _HELD, _LINES, _STOP, _TURN_ASKED, _TURNS, _anchors, _bm25, _flat, _tokens

_SIZED = """sized AS (SELECT *, length(section) + length(text) + 3 AS cost, coalesce(CASE WHEN lag(section) OVER w = section THEN lag(chunk_idx) OVER w END, -1) AS b, coalesce(length(lag(text) OVER w), 0) + 1 AS bn,
  coalesce(CASE WHEN lead(section) OVER w = section THEN lead(chunk_idx) OVER w END, -1) AS a, coalesce(length(lead(text) OVER w), 0) + 1 AS an FROM parts WINDOW w AS (PARTITION BY article_id ORDER BY chunk_idx))"""

#: From cand(article_id, query_id, source, need, place, chunk_idx, most, budget) and sized to win(article_id, query_id, source, need, rank, lo, hi, cost).
_KEY = "article_id, query_id, source, need"
_WINDOWS = f"""wc AS (SELECT c.*, s.cost, s.b, s.bn, s.a, s.an FROM cand c JOIN sized s USING (article_id, chunk_idx)),
wf AS (SELECT {_KEY}, 0::BIGINT AS place, min(budget)::BIGINT AS left_, []::BIGINT[] AS taken, 0::BIGINT AS n, false AS made, 0::BIGINT AS lo, 0::BIGINT AS hi, 0::BIGINT AS cost FROM wc GROUP BY ALL
  UNION ALL SELECT {_KEY}, place, CASE WHEN go THEN left_ - total ELSE left_ END, CASE WHEN go THEN taken || range(lo, hi + 1) ELSE taken END, CASE WHEN go THEN n + 1 ELSE n END, go, lo, hi, total FROM (
    SELECT *, CASE WHEN back THEN b ELSE chunk_idx END AS lo, CASE WHEN one + an <= left_ AND a >= 0 AND NOT list_contains(taken, a) THEN a ELSE chunk_idx END AS hi, one + CASE WHEN one + an <= left_ AND a >= 0 AND NOT list_contains(taken, a) THEN an ELSE 0 END AS total FROM (
      SELECT c.article_id, c.query_id, c.source, c.need, c.place, f.left_, f.taken, f.n, c.chunk_idx, c.b, c.a, c.an, f.n < c.most AND NOT list_contains(f.taken, c.chunk_idx) AND c.cost <= f.left_ AS go,
        c.b >= 0 AND NOT list_contains(f.taken, c.b) AND c.cost + c.bn <= f.left_ AS back, c.cost + CASE WHEN c.b >= 0 AND NOT list_contains(f.taken, c.b) AND c.cost + c.bn <= f.left_ THEN c.bn ELSE 0 END AS one
      FROM wf f JOIN wc c ON c.article_id = f.article_id AND c.query_id = f.query_id AND c.source = f.source AND c.need = f.need AND c.place = f.place + 1))),
win AS (SELECT {_KEY}, n - 1 AS rank, lo, hi, cost FROM wf WHERE made)"""

_CANDIDATES = "STRUCT(key VARCHAR, chunk_id VARCHAR, cost BIGINT, lo BIGINT, hi BIGINT, score DOUBLE, pinned BOOLEAN, sources VARCHAR[], needs BIGINT[])[]"
_SOURCES, _WEIGHTS = list(E.WEIGHTS), list(E.WEIGHTS.values())


def _packed(needs: str) -> str:
    """CTEs from win, single(article_id, query_id, source, rank, chunk_idx), left_for(article_id, query_id, budget) and sized to picked(article_id, query_id,
    article_characters, evidence). needs: a query of article_id, query_id, need."""
    return f"""off AS (SELECT *, 'window-chunk-' || (lo + 1) || '-chunk-' || (hi + 1) AS chunk_id FROM win
  UNION ALL SELECT article_id, query_id, source, -1, rank, chunk_idx, chunk_idx, cost, 'chunk-' || (chunk_idx + 1) FROM single JOIN sized USING (article_id, chunk_idx)),
ofs AS (SELECT *, row_number() OVER (PARTITION BY article_id, query_id ORDER BY list_position({_SOURCES}, source), need, rank) AS o, {_WEIGHTS}[list_position({_SOURCES}, source)]::DOUBLE / (60 + rank + 1) AS score, source = 'focus-anchor' AS pinned FROM off),
ff AS (SELECT DISTINCT article_id, query_id, 0::BIGINT AS o, []::{_CANDIDATES} AS held FROM ofs
  UNION ALL SELECT article_id, query_id, o, list_filter(held, lambda c: c.key <> name AND (c.hi < lo OR hi < c.lo)) || [{{'key': coalesce(touched[1].key, name), 'chunk_id': best.c.chunk_id, 'cost': best.c.cost, 'lo': best.c.lo, 'hi': best.c.hi, 'score': coalesce(list_sum(list_transform(touched, lambda c: c.score)), 0.0) + score, 'pinned': pinned OR len(list_filter(touched, lambda c: c.pinned)) > 0,
    'sources': list_sort(list_distinct(flatten(list_transform(touched, lambda c: c.sources)) || [source])), 'needs': list_distinct(flatten(list_transform(touched, lambda c: c.needs)) || [need])}}]::{_CANDIDATES} FROM (
    SELECT *, list_sort(list_transform(touched || [{{'key': name, 'chunk_id': chunk_id, 'cost': cost, 'lo': lo, 'hi': hi, 'score': score, 'pinned': pinned, 'sources': [source], 'needs': [need]}}]::{_CANDIDATES}, lambda c, k: {{'p': NOT c.pinned, 'b': c.lo - c.hi, 'n': -c.cost, 'k': k, 'c': c}}))[1] AS best FROM (
      SELECT x.*, f.held, x.lo || '-' || x.hi AS name, list_filter(f.held, lambda c: c.key = x.lo || '-' || x.hi OR (c.lo <= x.hi AND x.lo <= c.hi)) AS touched FROM ff f JOIN ofs x ON x.article_id = f.article_id AND x.query_id = f.query_id AND x.o = f.o + 1))),
fl AS (SELECT * FROM ff QUALIFY row_number() OVER (PARTITION BY article_id, query_id ORDER BY o DESC) = 1),
pk AS (SELECT article_id, query_id, c.*, row_number() OVER (PARTITION BY article_id, query_id ORDER BY c.pinned DESC, c.score DESC, c.chunk_id) AS k FROM (SELECT article_id, query_id, unnest(held) AS c FROM fl)),
tries AS (SELECT article_id, query_id, 1 AS phase, k AS spot, [k] AS ks FROM pk WHERE pinned UNION ALL SELECT n.article_id, n.query_id, 2, n.need, list(p.k ORDER BY p.k) FROM ({needs}) n JOIN pk p ON p.article_id = n.article_id AND p.query_id = n.query_id AND list_contains(p.needs, n.need) GROUP BY ALL
  UNION ALL SELECT article_id, query_id, 3, k, [k] FROM pk WHERE list_contains(sources, 'document-coverage') UNION ALL SELECT article_id, query_id, 4, k, [k] FROM pk),
tn AS (SELECT *, row_number() OVER (PARTITION BY article_id, query_id ORDER BY phase, spot) AS o FROM tries),
pc AS (SELECT article_id, query_id, list(cost ORDER BY k) AS costs, list(chunk_id || '|' || array_to_string(sources, '+') || '|' || pinned || '|' || round(score * 1000000000)::BIGINT || '|' || cost ORDER BY k) AS said, min(budget) AS budget FROM pk JOIN left_for USING (article_id, query_id) GROUP BY ALL),
pf AS (SELECT article_id, query_id, 0::BIGINT AS o, budget::BIGINT AS left_, []::BIGINT[] AS picks FROM pc
  UNION ALL SELECT article_id, query_id, o, CASE WHEN go THEN left_ - costs[k] ELSE left_ END, CASE WHEN go THEN picks || [k] ELSE picks END FROM (SELECT *, coalesce(len(picks) < 8 AND costs[k] <= left_, false) AS go FROM (
    SELECT t.article_id, t.query_id, t.o, f.left_, f.picks, c.costs, list_filter(t.ks, lambda k: NOT list_contains(f.picks, k))[1] AS k FROM pf f JOIN tn t ON t.article_id = f.article_id AND t.query_id = f.query_id AND t.o = f.o + 1 JOIN pc c ON c.article_id = f.article_id AND c.query_id = f.query_id))),
pl AS (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY article_id, query_id ORDER BY o DESC) = 1),
picked AS (SELECT article_id, query_id, coalesce(list_sum(list_transform(picks, lambda k: costs[k])), 0)::BIGINT AS article_characters, array_to_string(list_transform(picks, lambda k: said[k]), ';') AS evidence FROM pl JOIN pc USING (article_id, query_id))"""


def _literals(question: str, focus: str) -> str:
    quoted = " || ".join(f"regexp_extract_all({question}, '{p}', 1)" for p in fixed.QUOTED)
    long = f"list_filter(list_transform([coalesce({focus}, '')] || {quoted}, lambda x: {_flat('lower(x)')}), lambda x: length(x) >= 3)"
    runs = f"list_filter(list_transform(regexp_extract_all({question}, '[\\p{{L}}\\p{{N}}_./:-]{{3,}}'), lambda x: lower(x)), lambda x: NOT list_contains({_STOP}, x))"
    return f"list_distinct({long} || {runs})"


def _spread(lines: str, budget: str) -> str:
    """CTE spread(article_id, query_id, i): of articles whose sections have one chunk each, as many evenly spaced chunks as fit, up to 8. lines: article_id, query_id, cost, chunk_idx, budget."""
    even = "CASE WHEN k <= 1 THEN [0] ELSE list_distinct(list_transform(range(k), lambda i: floor(i * (len(costs) - 1) / (k - 1) + 0.5)::BIGINT)) END"
    return f"""cs AS (SELECT article_id, query_id, {budget} AS b, list(cost ORDER BY chunk_idx) AS costs FROM ({lines}) GROUP BY ALL),
ck AS (SELECT article_id, query_id, costs, max(k) AS k FROM (SELECT *, unnest(range(1, least(8, len(costs)) + 1)) AS k FROM cs) WHERE list_sum(list_transform({even}, lambda i: costs[i + 1])) <= b GROUP BY ALL),
spread AS (SELECT article_id, query_id, unnest({even}) AS i FROM ck)"""


_PART_1 = "base || ' > part 1'"
_ASKS = """asked_text AS (SELECT article_id, {'q': query_id, 's': 'focus-anchor', 'n': -1::BIGINT} AS query_id, 0::BIGINT AS pos, asked_ AS text FROM rest WHERE t = 3 OR (t IN (1, 2) AND article_id NOT IN (SELECT article_id FROM sec) AND article_id NOT IN (SELECT article_id FROM anchored))
  UNION ALL (SELECT article_id, {'q': query_id, 's': 'global-search', 'n': -1::BIGINT}, pos, text FROM gq QUALIFY row_number() OVER (PARTITION BY article_id, query_id, lower(text) ORDER BY pos) = 1)
  UNION ALL SELECT article_id, {'q': query_id, 's': 'planned-need', 'n': need::BIGINT}, 0, text FROM nq)"""

_QUESTION_CONTEXT = f"""WITH RECURSIVE {_TURN_ASKED}, {_TURNS}, {_HELD},
parts AS (SELECT article_id, ord AS chunk_idx, CASE WHEN article_id % 8 = 6 THEN 'part ' || ord || ' > ' || section ELSE section || ' > part ' || (ord // 5) END AS section, text FROM lines), {_SIZED},
qp AS (SELECT article_id, query_id, base, article_id % 8 AS t, article_id % 16 = 14 AS wide, t IN (4, 5) OR wide AS has_plan, CASE WHEN t = 6 AND NOT wide THEN 'Summarize the whole article: ' || question ELSE question END AS asked_, CASE WHEN t = 2 THEN question END AS focus_text, string_split(question, ' ') AS w,
  left(array_to_string(w[1:12], ' '), 500) AS rewritten, array_to_string(w[13:24], ' ') AS planned, list_filter([array_to_string(w[1:5], ' '), array_to_string(w[6:10], ' ')], lambda x: x <> '') AS wanted_needs FROM one_asked),
bd AS (SELECT q.*, coalesce(full_, 0) AS full_, CASE WHEN t = 7 THEN 700 ELSE 0 END AS cp, 3000 - cp AS avail, coalesce(full_, 0) <= avail AS fits, CASE WHEN fits THEN avail - coalesce(full_, 0) ELSE least(CASE WHEN t = 5 THEN 16000 ELSE 8000 END, avail) END AS room
  FROM qp q LEFT JOIN (SELECT article_id, sum(cost)::BIGINT AS full_ FROM sized GROUP BY 1) USING (article_id)),
hn AS (SELECT b.article_id, b.room, t.turn_idx, t.turn_length, {_tokens("t.question || chr(10) || t.answer")} AS told, {_tokens("b.asked_ || coalesce(chr(10) || b.focus_text, '')")} AS said, row_number() OVER w AS newest, sum(turn_length) OVER w AS used, sum(turn_length) OVER (PARTITION BY b.article_id) AS total
  FROM bd b JOIN turns t ON t.conv_id = b.article_id WHERE room > 0 WINDOW w AS (PARTITION BY b.article_id ORDER BY t.turn_idx DESC ROWS UNBOUNDED PRECEDING)),
hk AS (SELECT *, CASE WHEN total <= room THEN 'all' WHEN newest <= 6 AND used <= least(room, 8000) THEN 'recent' END AS how FROM hn),
hs AS (SELECT *, room - coalesce(sum(turn_length) FILTER (how = 'recent') OVER (PARTITION BY article_id), 0) AS left0, len(list_intersect(said, told)) / len(said) AS score FROM hk),
ho AS (SELECT article_id, turn_idx, turn_length, left0, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, turn_idx DESC) AS place FROM hs WHERE total > room AND newest > 6 AND score > 0 QUALIFY place <= 6),
hf AS (SELECT DISTINCT article_id, 0::BIGINT AS place, left0::BIGINT AS left_, -1::BIGINT AS taken FROM ho
  UNION ALL SELECT f.article_id, o.place, f.left_ - CASE WHEN o.turn_length <= f.left_ THEN o.turn_length ELSE 0 END, CASE WHEN o.turn_length <= f.left_ THEN o.turn_idx ELSE -1 END FROM hf f JOIN ho o ON o.article_id = f.article_id AND o.place = f.place + 1),
hist AS (SELECT article_id, turn_idx, turn_length, how FROM hk WHERE how IS NOT NULL UNION ALL SELECT o.article_id, o.turn_idx, o.turn_length, 'recalled' FROM hf f JOIN ho o ON o.article_id = f.article_id AND o.turn_idx = f.taken),
hsum AS (SELECT article_id, sum(turn_length)::BIGINT AS hc, string_agg(turn_idx || ':' || how, ',' ORDER BY turn_idx) AS history FROM hist GROUP BY 1),
rq AS (SELECT b.*, coalesce(hc, 0)::BIGINT AS history_characters, coalesce(s.history, '') AS history, greatest(1, avail - coalesce(hc, 0)) AS budget FROM bd b LEFT JOIN hsum s USING (article_id)),
rest AS (SELECT * FROM rq WHERE NOT fits),
sec AS (SELECT article_id, chunk_idx, place FROM (SELECT article_id, chunk_idx, budget, row_number() OVER w AS place, sum(cost) OVER w AS used FROM rest JOIN sized USING (article_id) WHERE t = 1 AND (lower(section) = lower({_PART_1}) OR starts_with(lower(section), lower({_PART_1}) || ' > ')) WINDOW w AS (PARTITION BY article_id ORDER BY chunk_idx ROWS UNBOUNDED PRECEDING)) WHERE place <= 3 AND used <= budget),
{_anchors(f"foci AS (SELECT article_id, query_id, focus_text, CASE WHEN t = 1 THEN {_PART_1} END AS focus_section FROM rest WHERE t = 2 OR (t = 1 AND article_id NOT IN (SELECT article_id FROM sec)))")},
gq AS (SELECT article_id, query_id, unnest(g) AS text, generate_subscripts(g, 1) - 1 AS pos FROM (SELECT article_id, query_id, list_filter([asked_, focus_text] || (CASE WHEN has_plan THEN [rewritten, CASE WHEN planned = '' THEN rewritten ELSE planned END] ELSE [] END), lambda x: x <> '') AS g FROM rest)),
nq AS (SELECT article_id, query_id, unnest(wanted_needs) AS text, generate_subscripts(wanted_needs, 1) - 1 AS need FROM rest WHERE has_plan),
{_bm25(_ASKS, 20, "SELECT article_id, chunk_idx, section, text FROM parts WHERE article_id IN (SELECT article_id FROM rest)", True)},
fq AS (SELECT article_id, query_id, chunk_idx, round(sum(1.0 / (60 + rank)), 12) AS fused, min(rank) AS best_rank FROM best GROUP BY ALL),
lits AS (SELECT article_id, query_id, unnest({_literals('asked_', 'focus_text')}) AS literal FROM rest),
xm AS (SELECT article_id, query_id, chunk_idx, max(length(literal)) AS longest, count(*) AS matches FROM (SELECT article_id, chunk_idx, {_flat("lower(section || chr(10) || text)")} AS content FROM parts) JOIN lits USING (article_id) WHERE contains(content, literal) GROUP BY ALL),
found AS (SELECT article_id, query_id.q AS query_id, query_id.s AS source, query_id.n AS need, chunk_idx, row_number() OVER (PARTITION BY article_id, query_id ORDER BY fused DESC, best_rank, chunk_idx) AS place FROM fq
  UNION ALL SELECT article_id, query_id, 'exact-match', -1, chunk_idx, row_number() OVER (PARTITION BY article_id, query_id ORDER BY longest DESC, matches DESC, chunk_idx) FROM xm),
cand AS (SELECT f.*, r.budget, CASE WHEN source IN ('global-search', 'exact-match') THEN 8 ELSE 3 END AS most FROM found f JOIN rest r USING (article_id, query_id)),
{_spread("SELECT article_id, query_id, cost, chunk_idx, budget FROM rest JOIN sized USING (article_id) WHERE t = 6", "least(budget, 8000)")},
single AS (SELECT article_id, query_id, 'focus-anchor' AS source, place - 1 AS rank, chunk_idx FROM sec JOIN rest USING (article_id) UNION ALL SELECT article_id, query_id, 'focus-anchor', place - 1, chunk_idx FROM anchored WHERE place <= 3
  UNION ALL SELECT article_id, query_id, 'document-coverage', row_number() OVER (PARTITION BY article_id ORDER BY i) - 1, i FROM spread),
left_for AS (SELECT article_id, query_id, budget FROM rest),
{_WINDOWS},
{_packed("SELECT article_id, query_id, need FROM nq")},
full_ev AS (SELECT article_id, query_id, string_agg('chunk-' || (chunk_idx + 1) || '|full-article|false|1000000000|' || cost, ';' ORDER BY chunk_idx) AS evidence FROM rq JOIN sized USING (article_id) WHERE fits GROUP BY ALL)
SELECT article_id, query_id, CASE WHEN fits THEN 'full-context' ELSE 'fused-retrieval' END AS strategy, CASE WHEN fits THEN 'whole' ELSE 'relevant' END AS mode, NOT fits AS is_truncated, NOT fits AND t NOT IN (4, 5) AS needs_planning, full_::BIGINT AS full_article_characters,
  (CASE WHEN fits THEN full_ ELSE coalesce(article_characters, 0) END)::BIGINT AS article_characters, history_characters, cp::BIGINT AS checkpoint_characters, history, coalesce(e.evidence, p.evidence, '') AS evidence
FROM rq LEFT JOIN full_ev e USING (article_id, query_id) LEFT JOIN picked p USING (article_id, query_id)"""

#: Coverage of articles that are one group: from gl(article_id, b, lim, costs) to gp(article_id, picks), the first chunk, the last, then those nearest to the middle.
_ONE_GROUP = """gs AS (SELECT article_id, costs, lim, CASE WHEN list_sum(costs) <= b AND len(costs) <= lim THEN range(len(costs)) WHEN costs[1] <= b THEN [0] ELSE []::BIGINT[] END AS picks, b - costs[1] AS left_ FROM gl),
gr AS (SELECT article_id, costs, lim, picks, left_ FROM gs
  UNION ALL SELECT article_id, costs, lim, picks || [next], left_ - costs[next + 1] FROM (
    SELECT *, CASE WHEN len(picks) = 1 THEN len(costs) - 1 ELSE list_sort(list_transform(list_filter(range(len(costs)), lambda k: NOT list_contains(picks, k)), lambda k: {'away': abs(2 * k - len(costs) + 1), 'k': k}))[1].k END AS next FROM gr WHERE len(picks) BETWEEN 1 AND least(lim, len(costs)) - 1)
  WHERE costs[next + 1] <= left_),
gp AS (SELECT article_id, arg_max(picks, len(picks)) AS picks FROM gr GROUP BY 1)"""
_ONE_ASKED_TEXT = "asked_text AS (SELECT article_id, query_id, 0 AS pos, question AS text FROM one_asked)"
_FUSED = "fr AS (SELECT article_id, query_id, chunk_idx, row_number() OVER (PARTITION BY article_id, query_id ORDER BY round(1.0 / (60 + rank), 12) DESC, rank, chunk_idx) AS place FROM best)"
_LINE_COSTS = "SELECT article_id, list(cost ORDER BY chunk_idx) AS costs FROM sized GROUP BY 1"
_ORDERED = "SELECT article_id, query_id, unnest(picks) AS k, generate_subscripts(picks, 1)::INTEGER AS rank FROM pl"

FOLDS = {
    "question_context": _QUESTION_CONTEXT,
    "document_coverage": f"WITH RECURSIVE {_LINES}, {_SIZED}, gl AS (SELECT article_id, 2000 AS b, 4 AS lim, costs FROM ({_LINE_COSTS})), {_ONE_GROUP} SELECT article_id, unnest(picks)::INTEGER AS chunk_idx FROM gp",
    "window_pack": f"""WITH RECURSIVE {_TURN_ASKED}, {_LINES}, {_SIZED}, {_bm25(_ONE_ASKED_TEXT, 20, "SELECT * FROM parts", True)}, {_FUSED},
cand AS (SELECT article_id, query_id, 'global-search' AS source, -1 AS need, place, chunk_idx, 4 AS most, 2000 AS budget FROM fr), {_WINDOWS}
SELECT article_id, query_id, (rank + 1)::INTEGER AS rank, 'window-chunk-' || (lo + 1) || '-chunk-' || (hi + 1) AS chunk_id, cost::INTEGER AS cost FROM win""",
    "evidence_pack": f"""WITH RECURSIVE {_TURN_ASKED}, {_LINES}, {_SIZED}, rest AS (SELECT article_id, query_id, question FROM one_asked WHERE (SELECT sum(cost) FROM sized s WHERE s.article_id = one_asked.article_id) > 3000),
{_bm25(_ONE_ASKED_TEXT.replace("FROM one_asked", "FROM rest"), 20, "SELECT * FROM parts WHERE article_id IN (SELECT article_id FROM rest)", True)}, {_FUSED},
lits AS (SELECT article_id, query_id, unnest({_literals('question', "''")}) AS literal FROM rest),
xm AS (SELECT article_id, query_id, chunk_idx, max(length(literal)) AS longest, count(*) AS matches FROM (SELECT article_id, chunk_idx, {_flat("lower(section || chr(10) || text)")} AS content FROM parts) JOIN lits USING (article_id) WHERE contains(content, literal) GROUP BY ALL),
xr AS (SELECT article_id, query_id, chunk_idx, row_number() OVER (PARTITION BY article_id, query_id ORDER BY longest DESC, matches DESC, chunk_idx) AS place FROM xm QUALIFY place <= 8),
cand AS (SELECT article_id, query_id, 'global-search' AS source, -1 AS need, place, chunk_idx, 8 AS most, 2500 AS budget FROM fr UNION ALL SELECT article_id, query_id, 'exact-match', -1, place, chunk_idx, 8, 2500 FROM xr),
gl AS (SELECT article_id, 1000 AS b, 3 AS lim, costs FROM ({_LINE_COSTS}) SEMI JOIN rest USING (article_id)), {_ONE_GROUP},
single AS (SELECT article_id, query_id, 'document-coverage' AS source, row_number() OVER (PARTITION BY article_id ORDER BY i) - 1 AS rank, i AS chunk_idx FROM (SELECT article_id, unnest(picks) AS i FROM gp) JOIN rest USING (article_id)),
left_for AS (SELECT article_id, query_id, 2500 AS budget FROM rest), {_WINDOWS}, {_packed("SELECT article_id, query_id, 0 AS need FROM rest WHERE false")}
SELECT article_id, query_id, rank, chunk_id, array_to_string(sources, ',') AS sources, pinned, round(score, 9) AS score, cost::INTEGER AS cost, 'fused-retrieval' AS strategy FROM ({_ORDERED}) JOIN pk USING (article_id, query_id, k)
UNION ALL SELECT article_id, query_id, (chunk_idx + 1)::INTEGER, 'chunk-' || (chunk_idx + 1), 'full-article', false, 1.0, cost::INTEGER, 'full-context' FROM one_asked JOIN sized USING (article_id) WHERE article_id NOT IN (SELECT article_id FROM rest)""",
}
