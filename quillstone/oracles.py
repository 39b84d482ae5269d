"""DuckDB SQL for the queries, written apart from the Spark plans: named steps put together by need."""

from __future__ import annotations

import re

from .functions.text import STOP_WORDS
from .operators.faithfulness import MEASURES
from .operators.evaluation import parse_settings
from .queries import HEADINGS, LAMBDAS, SETTINGS

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN, _GAP = "[0-9a-z]+", r"[\t ]"
_TOKEN = f"{_RUN}(?:[-'']{_RUN})*"
_HEAD = _GAP + "{0,3}" + "#{1,6}" + _GAP + r"+[^\n]*"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_MARK = "chr(57344)"


def _norm(x: str) -> str:
    return f"replace(translate({x}, '’‘“”', '''''\"\"'), '—', ' - ')"


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({_norm(x)}), '{_TOKEN}')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sents(x: str) -> str:
    cut = f"list_transform(string_split_regex(regexp_replace({_norm(x)}, '(?m)^{_HEAD}$', chr(10) || chr(10) || '\\0' || chr(10) || chr(10), 'g'), '\\n{_WS}*\\n'), lambda p: string_split(regexp_replace({_strip('p')}, '([.!?]){_WS}+([\"''(\\[]?[A-Z0-9])', '\\1' || {_MARK} || '\\2', 'g'), {_MARK}))"
    return f"list_filter(list_transform(flatten({cut}), lambda s: {_strip(f'''regexp_replace(s, '{_WS}+', ' ', 'g')''')}), lambda s: s <> '')"


def _content(x: str) -> str:
    t = _tok(x)
    kept = f"list_filter({t}, lambda w: NOT list_contains({_STOP}, w))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {t} END"


def _top(source: str, k: int, rank: str = "rank") -> str:
    return f"SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index))::INT AS {rank} FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) <= {k}"


def _bm25(weights: str) -> str:
    return f"SELECT * FROM (SELECT query_id, chunk_index, round(sum(weight * impact), 10) AS score FROM {weights} JOIN postings USING (term) GROUP BY ALL) WHERE score > 0"


def _cosine(vectors: str) -> str:
    return f"SELECT * FROM (SELECT query_id, chunk_index, round(sum(qw * w), 10) AS score FROM {vectors} JOIN postings USING (term) GROUP BY ALL) WHERE score > 0"


_FUSE = "SELECT query_id, chunk_index, round(coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0), 10) AS score, b.rank AS bm25_rank, v.rank AS vector_rank FROM {b} b FULL JOIN {v} v USING (query_id, chunk_index)"

#: name: (steps it needs, SQL)
STEPS: dict[str, tuple[str, str]] = {
    "docs": ("", "SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text FROM documents"),
    "q": ("", "SELECT item_id::VARCHAR AS query_id, coalesce(text, '') AS question FROM benchmark"),
    "dsents": ("docs", f"SELECT doc_id, {_sents('text')} AS s FROM docs"),
    "sents": ("dsents", f"SELECT doc_id, unnest(range(len(s))) AS sent_idx, unnest(s) AS sentence, len({_tok('unnest(s)')}) AS n FROM dsents"),
    "docp": ("sents", "SELECT doc_id, count(*) AS n, list_prepend(0, list(t ORDER BY sent_idx)) AS p FROM (SELECT doc_id, sent_idx, sum(n) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS t FROM sents) GROUP BY doc_id"),
    "spans": (
        "docp",
        """SELECT doc_id, 0::BIGINT AS ord, 0::BIGINT AS a, coalesce(list_filter(range(1, n), lambda x: p[x + 2] - p[1] > 120)[1], n) AS j FROM docp
UNION ALL
SELECT doc_id, ord + 1, a, coalesce(list_filter(range(e + 1, n), lambda x: p[x + 2] - p[a + 1] > 120)[1], n) FROM (SELECT s.doc_id, s.ord, s.j AS e, coalesce(list_filter(range(s.a + 1, s.j), lambda x: d.p[s.j + 1] - d.p[x + 1] <= 30)[1], s.j - 1) AS a, d.p, d.n FROM spans s JOIN docp d USING (doc_id) WHERE s.j < d.n)""",
    ),
    "chunks": (
        "spans sents",
        "SELECT (row_number() OVER (ORDER BY doc_id, ord) - 1)::INT AS chunk_index, doc_id, ord::INT AS chunk_ord, doc_id || '::' || ord AS chunk_id, string_agg(sentence, chr(10) ORDER BY sent_idx) AS text, sum(s.n)::INT AS token_count, a::INT AS sentence_start, (j - 1)::INT AS sentence_end FROM spans JOIN sents s USING (doc_id) WHERE sent_idx BETWEEN a AND j - 1 GROUP BY doc_id, ord, a, j",
    ),
    "lengths": ("chunks", f"SELECT chunk_index, len({_tok('text')})::INT AS len FROM chunks"),
    "stats": ("lengths", "SELECT count(*) AS n, coalesce(avg(len), 0) AS avg_len FROM lengths"),
    "tf": ("chunks", f"SELECT chunk_index, term, count(*)::INT AS tf FROM (SELECT chunk_index, unnest({_tok('text')}) AS term FROM chunks) GROUP BY ALL"),
    "terms": ("tf stats", "SELECT term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf_bm25, ln((1.0::DOUBLE + n) / (1 + df)) + 1 AS idf_tfidf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats"),
    "postings": (
        "tf terms lengths stats",
        "SELECT chunk_index, term, tf, len, idf_bm25 * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)) AS impact, raw / sqrt(sum(raw * raw) OVER (PARTITION BY chunk_index)) AS w FROM (SELECT tf.*, len, idf_bm25, (1 + ln(tf)) * idf_tfidf AS raw FROM tf JOIN terms USING (term) JOIN lengths USING (chunk_index)), stats",
    ),
    "qt": ("q", f"SELECT query_id, term, count(*)::INT AS qtf, (min(pos) - 1)::INT AS first_pos FROM (SELECT query_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT query_id, {_tok('question')} AS t FROM q)) GROUP BY ALL"),
    "qw": ("qt", "SELECT query_id, term, qtf::DOUBLE AS weight FROM qt"),
    "qx": ("qt", "SELECT query_id, term, qtf::DOUBLE / (1 + first_pos) AS weight FROM qt"),
    "qv": ("qt terms", "SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS qw FROM (SELECT query_id, term, (1 + ln(qtf)) * idf_tfidf AS raw FROM qt JOIN terms USING (term))"),
    "qxv": ("qx terms", "SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS qw FROM (SELECT query_id, term, weight * idf_tfidf AS raw FROM qx JOIN terms USING (term))"),
    "bm25": ("qw postings", _bm25("qw")),
    "cosine": ("qv postings", _cosine("qv")),
    "b25": ("bm25", _top("bm25", 25)),
    "v25": ("cosine", _top("cosine", 25)),
    "pool": ("b25 v25", f"SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index))::INT AS pool_rank FROM ({_FUSE.format(b='b25', v='v25')})"),
    "found": ("pool chunks", "SELECT query_id, pool_rank AS rank, p.chunk_index, doc_id, chunk_id, text, score, bm25_rank, vector_rank FROM pool p JOIN chunks USING (chunk_index) WHERE pool_rank <= 20"),
    "ranked": ("found", "SELECT query_id, doc_id AS item, (row_number() OVER (PARTITION BY query_id ORDER BY best))::INT AS rank FROM (SELECT query_id, doc_id, min(rank) AS best FROM found GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best) <= 5"),
    "gold": (
        "q dsents",
        f"SELECT DISTINCT query_id, doc_id AS item FROM (SELECT query_id, unnest({_sents('question')}) AS sentence FROM q) JOIN (SELECT doc_id, unnest(s) AS sentence FROM dsents) USING (sentence) WHERE len({_tok('sentence')}) > 3",
    ),
    "ranked3": (
        "pool b25 v25 chunks",
        "SELECT method, query_id, doc_id AS item, row_number() OVER (PARTITION BY method, query_id ORDER BY min(r)) AS rank FROM (SELECT 'hybrid' AS method, query_id, chunk_index, pool_rank AS r FROM pool UNION ALL SELECT 'bm25', query_id, chunk_index, rank FROM b25 UNION ALL SELECT 'vector', query_id, chunk_index, rank FROM v25) JOIN chunks USING (chunk_index) WHERE r <= 20 GROUP BY method, query_id, doc_id QUALIFY row_number() OVER (PARTITION BY method, query_id ORDER BY min(r)) <= 5",
    ),
    "slices": (
        "ranked3 gold q ks",
        """SELECT method, query_id, k, CASE WHEN length(question) < 200 THEN 'short' ELSE 'long' END AS difficulty, coalesce(hit, 0) AS hit, coalesce(found / g.n, 0) AS recall, coalesce(precision, 0) AS precision, coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(k, g.n) + 1) t(i)), 0) AS ndcg, coalesce(1.0::DOUBLE / f.best, 0) AS rr
FROM q CROSS JOIN ks CROSS JOIN (SELECT unnest(['hybrid', 'bm25', 'vector']) AS method) LEFT JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL) g USING (query_id)
LEFT JOIN (SELECT method, query_id, k, max(y) AS hit, sum(y)::DOUBLE AS found, avg(y) AS precision, sum(y / log2(rank + 1)) AS dcg FROM (SELECT r.*, (g.item IS NOT NULL)::INT AS y FROM ranked3 r LEFT JOIN gold g USING (query_id, item)) JOIN ks ON rank <= k GROUP BY ALL) USING (method, query_id, k)
LEFT JOIN (SELECT method, query_id, min(rank) AS best FROM ranked3 JOIN gold USING (query_id, item) GROUP BY ALL) f USING (method, query_id)""",
    ),
    "ks": ("", "SELECT unnest([1, 3, 5])::INT AS k"),
    "judged": ("ranked gold ks q", "SELECT query_id, k, r.item, r.rank, g.item IS NOT NULL AS rel FROM q CROSS JOIN ks LEFT JOIN ranked r USING (query_id) LEFT JOIN gold g USING (query_id, item) WHERE r.rank IS NULL OR r.rank <= k"),
    "metrics": (
        "judged gold q ks",
        "SELECT q.query_id, k, coalesce(max(rel::INT), 0)::DOUBLE AS hit, coalesce((count(DISTINCT item) FILTER (WHERE rel))::DOUBLE / max(g.n), 0) AS recall, coalesce(avg(rel::INT) FILTER (WHERE item IS NOT NULL), 0)::DOUBLE AS precision FROM q CROSS JOIN ks LEFT JOIN judged USING (query_id, k) LEFT JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL) g USING (query_id) GROUP BY ALL",
    ),
    "gain1": ("gold", "SELECT query_id, item, 1.0::DOUBLE AS gain FROM gold"),
    "gain2": ("gold", "SELECT query_id, item, coalesce(l.gain, 1)::DOUBLE AS gain FROM gold LEFT JOIN (SELECT doc_id::VARCHAR AS item, max(quality) + 1 AS gain FROM labels GROUP BY ALL) l USING (item)"),
    "ndcg": ("q ks ranked gain1", ""),
    "ndcg2": ("q ks ranked gain2", ""),
    "rr": ("q ranked gold", "SELECT query_id, coalesce(1.0::DOUBLE / min(r.rank) FILTER (WHERE g.item IS NOT NULL), 0) AS rr FROM q LEFT JOIN ranked r USING (query_id) LEFT JOIN gold g USING (query_id, item) GROUP BY ALL"),
    "fw": ("pool", "SELECT query_id, chunk_index, score / sum(score) OVER (PARTITION BY query_id) AS weight FROM pool WHERE pool_rank <= 5"),
    "rm": (
        "fw postings qt terms",
        f"SELECT query_id, term, value / sum(value) OVER (PARTITION BY query_id) AS weight FROM (SELECT query_id, term, round(sum(weight * tf / len) * max(idf_bm25), 12) AS value FROM fw JOIN postings USING (chunk_index) JOIN terms USING (term) WHERE NOT list_contains({_STOP}, term) AND NOT regexp_full_match(term, '[0-9]+') AND NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id = fw.query_id AND qt.term = postings.term) GROUP BY ALL) WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, term) <= 5",
    ),
    "rm5": ("rm", "SELECT query_id, term, weight / sum(weight) OVER (PARTITION BY query_id) AS weight FROM rm"),
    "xq": (
        "rm5 qt",
        "SELECT query_id, term, (CASE WHEN query_id IN (SELECT query_id FROM rm5) THEN 0.8::DOUBLE ELSE 1 END) * qtf / sum(qtf) OVER (PARTITION BY query_id) AS weight FROM qt UNION ALL SELECT query_id, term, 0.2::DOUBLE * weight FROM rm5",
    ),
    "xw": ("xq rm5", "SELECT * FROM xq WHERE query_id IN (SELECT query_id FROM rm5)"),
    "xv": ("xw terms", "SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS qw FROM (SELECT query_id, term, weight * idf_tfidf AS raw FROM xw JOIN terms USING (term))"),
    "xb25": ("xw postings", _top(f"({_bm25('xw')})", 25)),
    "xv25": ("xv postings", _top(f"({_cosine('xv')})", 25)),
    "xpool": ("xb25 xv25", f"SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index))::INT AS pool_rank FROM ({_FUSE.format(b='xb25', v='xv25')})"),
    "res": ("found", "SELECT * FROM found WHERE rank <= 4"),
    "tw": (
        "q res",
        f"SELECT query_id, term, ln((1.0::DOUBLE + n) / (1 + coalesce(df, 0))) + 1 AS weight FROM (SELECT query_id, unnest(list_distinct({_content('question')})) AS term FROM q) JOIN (SELECT query_id, count(*) AS n FROM res GROUP BY ALL) USING (query_id) LEFT JOIN (SELECT query_id, term, count(*) AS df FROM (SELECT query_id, unnest(list_distinct({_tok('text')})) AS term FROM res) GROUP BY ALL) USING (query_id, term)",
    ),
    "rs": ("res", f"SELECT query_id, rank, doc_id, chunk_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM (SELECT *, {_sents('text')} AS s FROM res)"),
    "ss": (
        "rs tw",
        f"SELECT query_id, rank, pos, sentence, doc_id, chunk_id, round(sum(weight) / sqrt(max(m)) / rank, 10) AS score FROM (SELECT *, len(t) AS m, unnest(t) AS term FROM (SELECT *, list_distinct({_tok('sentence')}) AS t FROM rs WHERE NOT regexp_full_match({_strip('sentence')}, '{_HEAD}'))) JOIN tw USING (query_id, term) GROUP BY query_id, rank, pos, sentence, doc_id, chunk_id",
    ),
    "best": (
        "ss",
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS r FROM (SELECT * FROM ss QUALIFY row_number() OVER (PARTITION BY query_id, sentence ORDER BY score DESC, rank, pos) = 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) <= 3",
    ),
    "answers": (
        "q res best",
        "SELECT q.query_id, coalesce(b.text, t.text, 'Nothing in these documents answers the question.') AS text, coalesce(b.d, CASE WHEN t.doc_id IS NULL THEN [] ELSE [t.doc_id] END) AS cites, coalesce(b.c, CASE WHEN t.doc_id IS NULL THEN [] ELSE [t.chunk_id] END) AS support FROM q LEFT JOIN (SELECT * FROM res WHERE rank = 1) t USING (query_id) LEFT JOIN (SELECT query_id, string_agg(sentence, chr(10) ORDER BY r) AS text, list(doc_id ORDER BY r) AS d, list(chunk_id ORDER BY r) AS c FROM best GROUP BY ALL) b USING (query_id)",
    ),
    "uniq": (
        "answers",
        "SELECT query_id, text, list_filter(cites, lambda x, i: list_position(cites, x) = i) AS cites, list_filter(support, lambda x, i: list_position(support, x) = i) AS support FROM answers",
    ),
    "asents": ("uniq", f"SELECT query_id, cites, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM (SELECT *, {_sents('text')} AS s FROM uniq)"),
    "support": (
        "asents res",
        f"SELECT DISTINCT a.query_id, a.pos, r.doc_id, list_contains(a.cites, r.doc_id) AS cited FROM asents a JOIN res r USING (query_id) WHERE len({_tok('a.sentence')}) > 0 AND contains(' ' || array_to_string({_tok('r.text')}, ' ') || ' ', ' ' || array_to_string({_tok('a.sentence')}, ' ') || ' ')",
    ),
    "faith": (
        "uniq asents support res",
        f"""SELECT u.query_id, coalesce(g.grounded::DOUBLE / n.n, 0) AS sentence_grounding, coalesce(t.tg, 0) AS token_grounding, coalesce(p.used, 0)::DOUBLE / greatest(len(u.cites), 1) AS citation_precision, coalesce(g.credited::DOUBLE / g.grounded, 0) AS citation_recall FROM uniq u
LEFT JOIN (SELECT query_id, count(*) AS n FROM asents GROUP BY ALL) n USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS grounded, sum(c::INT) AS credited FROM (SELECT query_id, pos, bool_or(cited) AS c FROM support GROUP BY ALL) GROUP BY query_id) g USING (query_id)
LEFT JOIN (SELECT query_id, count(DISTINCT doc_id) AS used FROM support WHERE cited GROUP BY ALL) p USING (query_id)
LEFT JOIN (SELECT query_id, avg((k.token IS NOT NULL)::INT) AS tg FROM (SELECT query_id, unnest({_content('text')}) AS token FROM uniq) LEFT JOIN (SELECT DISTINCT query_id, unnest({_tok('text')}) AS token FROM res) k USING (query_id, token) GROUP BY ALL) t USING (query_id)""",
    ),
}
for _n, _g in (("ndcg", "gain1"), ("ndcg2", "gain2")):
    STEPS[_n] = (
        STEPS[_n][0],
        f"""SELECT query_id, k, coalesce(d.dcg / i.idcg, 0) AS ndcg FROM q CROSS JOIN ks LEFT JOIN (SELECT query_id, k, sum(gain / log2(rank + 1)) AS dcg FROM (SELECT query_id, item, min(rank) AS rank FROM ranked GROUP BY ALL) JOIN {_g} USING (query_id, item) JOIN ks ON rank <= k GROUP BY query_id, k) d USING (query_id, k)
LEFT JOIN (SELECT query_id, k, sum(gain / log2(r + 1)) AS idcg FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, item) AS r FROM {_g} WHERE gain > 0) JOIN ks ON r <= k GROUP BY query_id, k) i USING (query_id, k)""",
    )


_SETTINGS = [(i, n, e.feedback_terms, e.original_weight) for i, (n, e) in enumerate(parse_settings(SETTINGS))]
_LAMBDAS = [(f"{x:g}", x) for x in LAMBDAS if x is not None]
_RUN, _OWN = "split_part(query_id, chr(31), 1)::INT", "split_part(query_id, chr(31), 2)"


def _slices(ranked: str, names: list[str]) -> str:
    """The step ``slices`` for other runs than the three methods."""
    return STEPS["slices"][1].replace("ranked3", ranked).replace("['hybrid', 'bm25', 'vector']", str(names))


_value = STEPS["rm"][1].split(" FROM (SELECT", 1)[1].rsplit(" WHERE value > 0", 1)[0]
STEPS |= {
    # expansion settings: query ids carry the number of the setting
    "xset": ("", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {t}, {a!r}::DOUBLE)" for i, n, t, a in _SETTINGS) + ") t(i, setting, terms, alpha)"),
    "rmv": (STEPS["rm"][0], f"SELECT query_id, term, value, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, term) AS r FROM (SELECT{_value} WHERE value > 0"),
    "srm": ("rmv xset", "SELECT i || chr(31) || query_id AS query_id, term, alpha, value / sum(value) OVER (PARTITION BY i, query_id) AS weight FROM rmv JOIN xset ON r <= terms AND alpha < 1"),
    "sq": ("srm qt xset", "SELECT i || chr(31) || query_id AS query_id, term, alpha * qtf / sum(qtf) OVER (PARTITION BY i, query_id) AS weight FROM qt CROSS JOIN xset WHERE i || chr(31) || query_id IN (SELECT query_id FROM srm) UNION ALL SELECT query_id, term, (1 - alpha) * weight FROM srm"),
    "sv": ("sq terms", STEPS["xv"][1].replace("xw", "sq")),
    "sb25": ("sq postings", _top(f"({_bm25('sq')})", 25)),
    "sv25": ("sv postings", _top(f"({_cosine('sv')})", 25)),
    "spool": ("sb25 sv25", STEPS["xpool"][1].replace("xb25", "sb25").replace("xv25", "sv25")),
    "ranked_s": (
        "spool pool srm xset chunks",
        f"SELECT setting AS method, {_OWN} AS query_id, item, rank FROM (SELECT query_id, doc_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY min(pool_rank)) AS rank FROM (SELECT query_id, chunk_index, pool_rank FROM spool UNION ALL SELECT i || chr(31) || query_id, chunk_index, pool_rank FROM pool CROSS JOIN xset WHERE i || chr(31) || query_id NOT IN (SELECT query_id FROM srm)) JOIN chunks USING (chunk_index) WHERE pool_rank <= 20 GROUP BY query_id, doc_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(pool_rank)) <= 5) JOIN xset ON i = {_RUN}",
    ),
    "slices_s": ("ranked_s gold q ks", _slices("ranked_s", [n for _, n, *_ in _SETTINGS])),
    # marginal relevance: one more chunk a round
    "rel": ("pool", "SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS relevance FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM pool)"),
    "psims": ("pool postings", "SELECT x.query_id, x.chunk_index AS a, y.chunk_index AS b, round(sum(m.w * n.w), 10) AS sim FROM pool x JOIN pool y ON x.query_id = y.query_id AND x.chunk_index <> y.chunk_index JOIN postings m ON m.chunk_index = x.chunk_index JOIN postings n ON n.chunk_index = y.chunk_index AND n.term = m.term GROUP BY ALL"),
    "mmr": (
        "rel psims",
        f"""SELECT lam, query_id, 0, []::INT[] FROM (SELECT DISTINCT query_id FROM pool) CROSS JOIN (SELECT unnest({[x for _, x in _LAMBDAS]})::DOUBLE AS lam)
UNION ALL
SELECT lam, query_id, step + 1, list_append(chosen, (min({{'v': -val, 'r': pool_rank, 'c': chunk_index}})).c) FROM (SELECT m.lam, m.query_id, m.step, m.chosen, p.chunk_index, p.pool_rank, round(m.lam * p.relevance - (1 - m.lam) * coalesce(max(s.sim), 0), 10) AS val FROM mmr m JOIN rel p ON p.query_id = m.query_id AND NOT list_contains(m.chosen, p.chunk_index) LEFT JOIN psims s ON s.query_id = m.query_id AND s.a = p.chunk_index AND list_contains(m.chosen, s.b) WHERE m.step < 20 GROUP BY m.lam, m.query_id, m.step, m.chosen, p.chunk_index, p.pool_rank, p.relevance) GROUP BY lam, query_id, step, chosen""",
    ),
    "mmrs": ("mmr", "SELECT lam, query_id, unnest(chosen) AS chunk_index, unnest(range(1, len(chosen) + 1)) AS place FROM (SELECT * FROM mmr QUALIFY row_number() OVER (PARTITION BY lam, query_id ORDER BY step DESC) = 1)"),
    "lams": ("", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {x!r}::DOUBLE)" for n, x in _LAMBDAS) + ") t(setting, lam)"),
    "places": ("mmrs lams pool", "SELECT setting AS method, query_id, chunk_index, place FROM mmrs JOIN lams USING (lam) UNION ALL SELECT 'off', query_id, chunk_index, pool_rank FROM pool"),
    "ranked_d": ("places chunks", "SELECT method, query_id, doc_id AS item, row_number() OVER (PARTITION BY method, query_id ORDER BY min(place)) AS rank FROM places JOIN chunks USING (chunk_index) WHERE place <= 20 GROUP BY method, query_id, doc_id QUALIFY row_number() OVER (PARTITION BY method, query_id ORDER BY min(place)) <= 5"),
    "slices_d": ("ranked_d gold q ks", _slices("ranked_d", ["off", *(n for n, _ in _LAMBDAS)])),
    "spread": (
        "places psims chunks q",
        "SELECT method, q.query_id, coalesce(red, 0) AS redundancy, coalesce(docs, 0) AS docs FROM q CROSS JOIN (SELECT DISTINCT method FROM places) LEFT JOIN (SELECT method, query_id, count(DISTINCT doc_id) AS docs FROM places JOIN chunks USING (chunk_index) WHERE place <= 5 GROUP BY ALL) USING (method, query_id) LEFT JOIN (SELECT x.method, x.query_id, round(sum(sim) / (max(n) * (max(n) - 1) / 2), 9) AS red FROM (SELECT *, count(*) OVER (PARTITION BY method, query_id) AS n FROM places WHERE place <= 5) x JOIN places y ON x.method = y.method AND x.query_id = y.query_id AND x.chunk_index < y.chunk_index AND y.place <= 5 JOIN psims s ON s.query_id = x.query_id AND s.a = x.chunk_index AND s.b = y.chunk_index GROUP BY ALL) USING (method, query_id)",
    ),
    # answers from several numbers of results
    "kq": ("q", "SELECT k || chr(31) || query_id AS query_id, question FROM q CROSS JOIN (SELECT unnest([3, 4, 5]) AS k)"),
    "kres": ("found", "SELECT k || chr(31) || query_id AS query_id, rank, doc_id, chunk_id, text FROM found JOIN (SELECT unnest([3, 4, 5]) AS k) ON rank <= k"),
}
_K = r"\b(q|res|tw|rs|ss|best|answers|uniq|asents|support)\b"
for _n in ("tw", "rs", "ss", "best", "answers", "uniq", "asents", "support", "faith"):
    STEPS["k" + _n] = (re.sub(_K, r"k\1", STEPS[_n][0]), re.sub(_K, r"k\1", STEPS[_n][1]))
_RECURSIVE = {"spans": "(doc_id, ord, a, j)", "mmr": "(lam, query_id, step, chosen)"}


def build(tail: str, needs: str) -> str:
    """A statement of the steps that ``needs`` and what they need in turn, then ``tail``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in STEPS[name][0].split():
                visit(n)
            order.append(name)

    for n in needs.split():
        visit(n)
    parts = [f"{n}{_RECURSIVE.get(n, '')} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({STEPS[n][1]})" for n in order]
    return (f"WITH RECURSIVE {','.join(parts)} " if parts else "") + tail


def _headings() -> str:
    rows = ", ".join("('made {}', ['{}'])".format(i, h.replace("\n", "' || chr(10) || '")) for i, h in enumerate(HEADINGS))
    return f"SELECT doc_id, len(lines)::INT AS n_lines, len(list_filter(lines, lambda l: regexp_full_match({_strip('l')}, '{_HEAD}')))::INT AS n_headings FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM docs UNION ALL SELECT * FROM (VALUES {rows}) t(doc_id, lines))"


def _report(source: str, label: str) -> str:
    means = ", ".join(f"round(avg({c}), 6)::DOUBLE AS {n}" for c, n in (("hit", "hit"), ("recall", "recall"), ("precision", "precision"), ("ndcg", "ndcg"), ("rr", "mrr")))
    return f"SELECT coalesce(difficulty, 'all') AS slice, k, count(*) AS queries, {means}, method AS {label} FROM {source} GROUP BY GROUPING SETS ((method, k), (method, k, difficulty))"


def _list(source: str) -> tuple[str, str]:
    return f"SELECT query_id, rank, chunk_index, round(score, 6) AS score FROM ({_top(source, 10)})", source


def _metric(name: str) -> tuple[str, str]:
    return f"SELECT query_id, k, round({name}, 6) AS {name} FROM metrics", "metrics"


def oracle_sql() -> dict[str, str]:
    weighted = {"bm25_weighted_topk": (_bm25("qx"), "qx postings"), "tfidf_weighted_topk": (_cosine("qxv"), "qxv postings")}
    made = {
        "normalize": (f"SELECT doc_id, md5({_norm('text')}) AS normal_md5 FROM docs", "docs"),
        "tokenize": (f"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tok('text')} AS t FROM docs)", "docs"),
        "tokenize_nostop": (f"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_filter({_tok('text')}, lambda w: NOT list_contains({_STOP}, w)) AS t FROM docs)", "docs"),
        "headings": (_headings(), "docs"),
        "sentences": ("SELECT doc_id, sent_idx::INT AS sent_idx, sentence, n::INT AS n_tokens FROM sents", "sents"),
        "chunks": ("SELECT * FROM chunks", "chunks"),
        "chunk_stats": ("SELECT (SELECT count(*) FROM docs) AS documents, count(*) AS chunks, (SELECT count(*) FROM terms) AS vocabulary, round(coalesce(avg(len), 0), 6) AS mean_tokens, coalesce(min(len), 0)::DOUBLE AS min_tokens, coalesce(max(len), 0)::DOUBLE AS max_tokens FROM lengths", "docs terms lengths"),
        "term_freq": ("SELECT * FROM tf", "tf"),
        "chunk_len": ("SELECT * FROM lengths", "lengths"),
        "doc_freq": ("SELECT term, df FROM terms", "terms"),
        "bm25_idf": ("SELECT term, round(idf_bm25, 9) AS idf FROM terms", "terms"),
        "tfidf_idf": ("SELECT term, round(idf_tfidf, 9) AS idf FROM terms", "terms"),
        "tfidf_vectors": ("SELECT chunk_index, term, round(w, 6) AS w FROM postings", "postings"),
        "bm25_scores": ("SELECT query_id, count(*) AS chunks, round(sum(score), 4) AS total, round(max(score), 6) AS best FROM bm25 GROUP BY ALL", "bm25"),
        "bm25_topk": _list("bm25"),
        "tfidf_topk": _list("cosine"),
        **{n: (f"SELECT query_id, rank, chunk_index, round(score, 6) AS score FROM ({_top(f'({s})', 10)})", needs) for n, (s, needs) in weighted.items()},
        "rrf_fusion": ("SELECT query_id, chunk_index, round(score, 6) AS score, bm25_rank, vector_rank FROM pool", "pool"),
        "search": ("SELECT query_id, rank, chunk_index, doc_id, chunk_id, text, round(score, 6) AS score, bm25_rank, vector_rank FROM found WHERE rank <= 5", "found"),
        "index_roundtrip": ("SELECT query_id, rank, chunk_index, round(score, 6) AS score FROM found WHERE rank <= 5", "found"),
        "search_components": ("SELECT query_id, rank, round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 6) AS bm25_rrf, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 6) AS vector_rrf FROM found WHERE rank <= 5", "found"),
        "ranked_docs": ("SELECT query_id, item AS doc_id, rank FROM ranked", "ranked"),
        "pairwise_similarity": (
            "SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE round(coalesce(s, 0), 6) END::DOUBLE AS sim FROM (SELECT DISTINCT x.chunk_index AS a, y.chunk_index AS b FROM found x JOIN found y USING (query_id) WHERE x.rank <= 5 AND y.rank <= 5 AND x.chunk_index <= y.chunk_index) p LEFT JOIN LATERAL (SELECT round(sum(m.w * n.w), 10) AS s FROM postings m JOIN postings n USING (term) WHERE m.chunk_index = p.a AND n.chunk_index = p.b) ON true",
            "found postings",
        ),
        "feedback_weights": ("SELECT query_id, chunk_index, round(weight, 6) AS weight FROM fw", "fw"),
        "relevance_model": ("SELECT query_id, term, round(weight, 6) AS weight FROM rm5", "rm5"),
        "expanded_query": ("SELECT query_id, term, round(weight, 6) AS weight FROM xq", "xq"),
        "expanded_search": ("SELECT query_id, pool_rank AS rank, chunk_index, round(score, 6) AS score FROM (SELECT query_id, pool_rank, chunk_index, score FROM xpool UNION ALL SELECT query_id, pool_rank, chunk_index, score FROM pool WHERE query_id NOT IN (SELECT query_id FROM rm5)) WHERE pool_rank <= 5", "xpool pool rm5"),
        "minmax_scores": ("SELECT query_id, chunk_index, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 6)::DOUBLE AS relevance FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM pool)", "pool"),
        "redundancy": (
            "SELECT query_id, round(CASE WHEN n > 1 THEN coalesce(s, 0) / (n * (n - 1) / 2) ELSE 0 END, 6)::DOUBLE AS redundancy FROM (SELECT query_id, count(*) AS n FROM found WHERE rank <= 5 GROUP BY ALL) LEFT JOIN (SELECT query_id, sum(d) AS s FROM (SELECT x.query_id, x.chunk_index AS a, y.chunk_index AS b, round(sum(m.w * n.w), 10) AS d FROM found x JOIN found y ON x.query_id = y.query_id AND x.chunk_index < y.chunk_index AND x.rank <= 5 AND y.rank <= 5 JOIN postings m ON m.chunk_index = x.chunk_index JOIN postings n ON n.chunk_index = y.chunk_index AND n.term = m.term GROUP BY ALL) GROUP BY query_id) USING (query_id)",
            "found postings",
        ),
        "term_weights": ("SELECT query_id, term, round(weight, 6) AS weight FROM tw", "tw"),
        "sentence_scores": ("SELECT query_id, rank, pos, sentence, round(score, 6) AS score FROM ss", "ss"),
        "extractive_answer": ("SELECT query_id, text, array_to_string(cites, '|') AS citations, 'extractive' AS method, array_to_string(support, '|') AS supporting_chunks, CASE WHEN len(cites) > 0 THEN text || chr(10) || chr(10) || 'Sources: ' || array_to_string(cites, ', ') ELSE text END AS formatted FROM uniq", "uniq"),
        "prompt": ("SELECT query_id, 'Sources:' || chr(10) || coalesce(b, '') || chr(10) || chr(10) || 'Question: ' || question AS prompt FROM q LEFT JOIN (SELECT query_id, string_agg('[' || rank || '] (' || doc_id || ') ' || text, chr(10) || chr(10) ORDER BY rank) AS b FROM res GROUP BY ALL) USING (query_id)", "q res"),
        "hit_at_k": _metric("hit"),
        "recall_at_k": _metric("recall"),
        "precision_at_k": _metric("precision"),
        "ndcg_at_k": ("SELECT query_id, k, round(ndcg, 6)::DOUBLE AS ndcg FROM ndcg", "ndcg"),
        "ndcg_graded": ("SELECT query_id, k, round(ndcg, 6)::DOUBLE AS ndcg FROM ndcg2", "ndcg2"),
        "mrr": ("SELECT query_id, round(rr, 6)::DOUBLE AS rr FROM rr", "rr"),
        "metric_slices": (_report("slices", "method"), "slices"),
        "expansion_report": (_report("slices_s", "setting"), "slices_s"),
        "diversity_report": (
            f"SELECT setting, k, queries, hit, mrr, redundancy, distinct_docs FROM ({_report('slices_d', 'setting')}) JOIN (SELECT method AS setting, round(avg(redundancy), 6)::DOUBLE AS redundancy, round(avg(docs), 6)::DOUBLE AS distinct_docs FROM spread GROUP BY ALL) USING (setting) WHERE slice = 'all' AND k IN (1, 5)",
            "slices_d spread",
        ),
        "faithfulness_report": (
            f"SELECT {_RUN} AS k, count(*) AS queries, " + ", ".join(f"round(avg(round({c}, 9)), 6)::DOUBLE AS {c}" for c in MEASURES) + f", round(avg(y), 6)::DOUBLE AS cited_gold FROM kfaith JOIN (SELECT u.query_id, max((g.item IS NOT NULL)::INT) AS y FROM (SELECT query_id, unnest(list_append(cites, NULL)) AS item FROM kuniq) u LEFT JOIN gold g ON g.query_id = {_OWN.replace('query_id', 'u.query_id')} AND g.item = u.item GROUP BY ALL) USING (query_id) GROUP BY ALL",
            "kfaith kuniq gold",
        ),
        "mmr_topk": ("SELECT query_id, place::INT AS mmr_rank, chunk_index, round(score, 6) AS score FROM mmrs JOIN pool USING (query_id, chunk_index) WHERE lam = 0.7 AND place <= 5", "mmrs pool"),
        "gold_summary": ("SELECT count(*) AS questions, count(*) FILTER (WHERE n > 1) AS multiple FROM (SELECT query_id, count(DISTINCT item) AS n FROM gold GROUP BY ALL)", "gold"),
        "dense_scores": ("SELECT query_id, n AS chunks, n - count(score) AS zeros, round(coalesce(sum(score), 0), 4) AS total FROM q CROSS JOIN stats LEFT JOIN bm25 USING (query_id) GROUP BY query_id, n", "q stats bm25"),
        "answer_fallbacks": (
            "SELECT query_id, CASE WHEN query_id::BIGINT % 2 = 1 THEN r.text ELSE 'Nothing in these documents answers the question.' END AS text, CASE WHEN query_id::BIGINT % 2 = 1 THEN r.doc_id ELSE '' END AS citations, CASE WHEN query_id::BIGINT % 2 = 1 THEN r.chunk_id ELSE '' END AS supporting_chunks FROM q LEFT JOIN (SELECT * FROM res WHERE rank = 1) r USING (query_id)",
            "q res",
        ),
        "misses_partials": ("SELECT query_id, CASE WHEN hit = 0 THEN 'miss' ELSE 'partial' END AS outcome FROM metrics WHERE k = 1 AND recall < 1 AND query_id IN (SELECT query_id FROM gold)", "metrics gold"),
        "supporting_docs": ("SELECT query_id, pos, doc_id FROM support", "support"),
        "faithfulness": ("SELECT query_id, round(sentence_grounding, 9) AS sentence_grounding, round(token_grounding, 9) AS token_grounding, round(citation_precision, 9) AS citation_precision, round(citation_recall, 9) AS citation_recall FROM faith", "faith"),
        "faithfulness_mean": ("SELECT " + ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in MEASURES) + " FROM faith", "faith"),
        "cited_gold": ("SELECT query_id, bool_or(g.item IS NOT NULL)::INT AS cited_gold FROM (SELECT query_id, unnest(cites) AS item FROM uniq UNION ALL SELECT query_id, NULL FROM uniq) LEFT JOIN gold g USING (query_id, item) GROUP BY ALL", "uniq gold"),
        "weakest_answers": ("SELECT query_id, round(token_grounding, 9) AS token_grounding FROM faith ORDER BY round(token_grounding, 9), query_id LIMIT 3", "faith"),
        "fingerprint": (
            "SELECT sha256(concat_ws('|', count(*)::VARCHAR, " + ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR, '')" for i in range(8)) + ", '120', '30')) AS fingerprint FROM (SELECT sha256('d' || length(doc_id) || ':' || doc_id || text) AS h FROM docs)",
            "docs",
        ),
        "build_index": ("SELECT count(*) AS postings, count(DISTINCT term) AS terms, sum(tf)::BIGINT AS tokens FROM tf", "tf"),
    }
    return {name: build(tail, needs) for name, (tail, needs) in made.items()}
