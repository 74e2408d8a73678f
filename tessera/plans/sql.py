"""Common table expressions of the oracle SQL: the corpus, its terms, both legs and their fusion, over the driver's tables."""

from __future__ import annotations

from ..config import DEFAULT as S
from ..config import STOP_WORDS


def r4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

CHUNKS = """ch AS (SELECT d.doc_id AS chunk_key, d.source AS spec_id, d.lang AS series, d.lang AS series_desc, CAST(d.doc_id // 20 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY d.source) AS INTEGER) AS total_chunks,
 'Rel-' || CAST(15 + d.doc_id % 4 AS VARCHAR) AS release, CASE l.quality WHEN 1 THEN 'TS' WHEN 0 THEN 'TR' END AS doc_type, CASE WHEN d.lang = 'en' THEN 0 ELSE 1 END AS db_idx, split_part(ltrim(d.text, ' '), chr(10), 1) AS title, d.text, d.doc_id AS load_ord
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

TERMS = f"""qs AS (SELECT item_id AS query_id, text AS q FROM benchmark),
w0 AS (SELECT query_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (SELECT query_id, regexp_split_to_array(q, '\\s+') AS l FROM qs)),
qt AS (SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, lower(regexp_replace(t, '[^A-Za-z0-9-]', '', 'g')) AS term, pos FROM w0) WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY query_id, term),
sp AS (SELECT *, CASE WHEN regexp_matches(term, '[0-9]') THEN 0 WHEN contains(term, '-') THEN 1 WHEN length(term) <= 6 THEN 2 WHEN length(term) <= 9 THEN 3 ELSE 4 END AS spec FROM qt),
ar AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY spec, length(term), term) AS rn, sum(CASE WHEN spec = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS digits FROM sp),
wanted AS (SELECT query_id, 1 AS stage, term FROM ar WHERE rn <= CASE WHEN digits > {S.and_limit} THEN least(digits, {S.digit_limit}) ELSE {S.and_limit} END
 UNION ALL SELECT query_id, 2, term FROM ar WHERE rn <= CASE WHEN digits > {S.and_limit - 1} THEN least(digits, {S.digit_limit}) ELSE {S.and_limit - 1} END
 UNION ALL SELECT query_id, 4, term FROM qt)"""


def _weights(hits: str) -> str:
    return f"""SELECT h.chunk_key, h.db_idx, h.term, greatest(ln((st.n_docs - f.df + 0.5) / (f.df + 0.5)), {S.least_idf}) * h.tf * {S.k1 + 1} / (h.tf + {S.k1} * (1 - {S.b} + {S.b} * h.len / st.avg_len)) AS w
 FROM {hits} h JOIN (SELECT db_idx, term, count(*) AS df FROM {hits} GROUP BY 1, 2) f ON h.db_idx = f.db_idx AND h.term = f.term JOIN st ON h.db_idx = st.db_idx"""


INDEX = f"""tok AS (SELECT chunk_key, db_idx, toks, rest, len(toks) + len(rest) AS len FROM (SELECT chunk_key, db_idx, {_TOKENS.format("text || chr(10) || series_desc")} AS toks, {_TOKENS.format("title || chr(10) || spec_id")} AS rest FROM ch)),
st AS (SELECT db_idx, count(*) AS n_docs, avg(len) AS avg_len FROM tok GROUP BY db_idx),
hs AS (SELECT chunk_key, db_idx, len, term, count(*) AS tf FROM (SELECT chunk_key, db_idx, len, unnest(toks) AS term FROM tok) WHERE term IN (SELECT term FROM wanted WHERE stage < 4) GROUP BY 1, 2, 3, 4),
ha AS (SELECT chunk_key, db_idx, len, term, count(*) AS tf FROM (SELECT chunk_key, db_idx, len, unnest(list_concat(toks, rest)) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3, 4),
ws AS ({_weights("hs")}),
wa AS ({_weights("ha")}),
nt AS (SELECT query_id, stage, count(*) AS n FROM wanted GROUP BY 1, 2),
strict AS (SELECT query_id, stage, chunk_key, db_idx, score FROM (SELECT query_id, stage, chunk_key, db_idx, {r6("sum(w)")} AS score, count(*) AS got FROM wanted JOIN ws USING (term) WHERE stage < 4 GROUP BY 1, 2, 3, 4) JOIN nt USING (query_id, stage) WHERE got = n),
loose AS (SELECT query_id, 4 AS stage, chunk_key, db_idx, {r6("sum(w)")} AS score FROM qt JOIN wa USING (term) GROUP BY 1, 2, 3, 4)"""

#: Without a series filter or terms of other domains, the loose stage runs on the first source only.
LEXICAL = f"""stages AS (SELECT *, min(stage) OVER (PARTITION BY query_id, db_idx) AS f FROM (SELECT * FROM strict UNION ALL SELECT * FROM loose WHERE db_idx = 0)),
perdb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, db_idx ORDER BY score DESC, chunk_key) AS r FROM stages WHERE stage = f) WHERE r <= {S.candidates}),
lex AS (SELECT query_id, stage, chunk_key, db_idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM perdb) WHERE rank <= {S.candidates})"""


def _unit(v: str) -> str:
    return f"list_transform(CAST({v} AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST({v} AS DOUBLE[]), CAST({v} AS DOUBLE[]))))"


DENSE = f"""qv AS (SELECT query_id, {_unit("e.embedding")} AS v FROM qs JOIN embeddings e ON e.vec_id = query_id),
vv AS (SELECT vec_id AS chunk_key, {_unit("embedding")} AS v FROM embeddings),
cosine AS (SELECT query_id, vv.chunk_key, spec_id, db_idx, load_ord, series, {r6("list_dot_product(qv.v, vv.v)")} AS score FROM vv CROSS JOIN qv JOIN ch ON ch.chunk_key = vv.chunk_key),
dense AS (SELECT query_id, chunk_key, spec_id, db_idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, load_ord) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, spec_id ORDER BY score DESC, load_ord) AS n FROM cosine) WHERE n <= {S.dense_cap}) WHERE rank <= {S.candidates})"""

#: Titles of study reports, and numbers after the first dot of an id.
STUDY = f"(regexp_matches(title, '\\b(study\\s+(on|of|into)|feasibility\\s+study|technical\\s+report\\b)', 'i') OR coalesce(TRY_CAST(regexp_extract(spec_id, '^[^.]*\\.([+-]?[0-9]+)(-.*)?$', 1) AS INTEGER) BETWEEN {S.study_from} AND {S.study_to - 1}, false))"

FUSED = f"""fused0 AS (SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.chunk_key, l.chunk_key) AS chunk_key, d.rank AS d_rank, l.rank AS l_rank, coalesce(1.0 / ({S.rrf_k} + d.rank), 0.0) + coalesce(1.0 / ({S.rrf_k} + l.rank), 0.0) AS rrf0 FROM dense d FULL JOIN lex l ON d.query_id = l.query_id AND d.chunk_key = l.chunk_key),
boosted AS (SELECT query_id, chunk_key, d_rank, l_rank, CASE WHEN d_rank <= 10 AND l_rank <= 10 THEN rrf0 * {S.co_occurrence} ELSE rrf0 END AS rrf FROM fused0),
fused AS (SELECT b.query_id, b.chunk_key, d_rank, l_rank, rrf * (CASE WHEN db_idx = 1 THEN {S.extras_discount} ELSE 1.0 END) * (CASE WHEN coalesce(upper(doc_type) = 'TR', false) OR {STUDY} THEN {S.study_discount} ELSE 1.0 END) AS rrf FROM boosted b JOIN ch USING (chunk_key))"""


def pooled(cap: int, k: int, name: str = "pooled") -> str:
    order = "rrf DESC, d_rank NULLS LAST, l_rank NULLS LAST, chunk_key"
    printable = r"regexp_replace(substr(text, 1, 600), '[\x20-\x7E\n\r\t]', '', 'g')"
    return f"""{name}0 AS (SELECT f.*, ch.spec_id, ch.db_idx, ch.series, ch.release, ch.doc_type, ch.title, ch.chunk_index, ch.text, least(1.0, rrf / {2.0 / (S.rrf_k + 1)!r}) AS score, row_number() OVER (PARTITION BY query_id, spec_id ORDER BY {order}) AS n FROM fused f JOIN ch USING (chunk_key) WHERE least(1.0, rrf / {2.0 / (S.rrf_k + 1)!r}) >= {S.min_score}),
{name} AS (SELECT * REPLACE ({r4("score")} AS score) FROM (SELECT p.*, qs.q, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS pos FROM {name}0 p JOIN qs USING (query_id) JOIN (SELECT spec_id, count(*) AS sc FROM ch GROUP BY 1) USING (spec_id)
 WHERE n <= {cap} AND NOT (sc <= {S.stub_chunks} AND length(text) < {S.stub_chars}) AND NOT (trim(text) = '' OR length({printable}) * 5 > length(substr(text, 1, 600)))) WHERE pos <= {k})"""


def content(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9_]+'), lambda t: length(t) >= 3))"


RERANKED = f"""scored AS (SELECT * REPLACE (1.0 / (1.0 + exp(-(6.0 * (CASE WHEN len({content("q")}) = 0 THEN 0.0 ELSE len(list_intersect({content("q")}, {content("title || ': ' || text")})) / CAST(len({content("q")}) AS DOUBLE) END - 0.5)))) AS score) FROM pooled),
adjusted AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS pos) FROM (SELECT * REPLACE ({r4(f"score * (CASE WHEN coalesce(upper(spec_type) = 'TR', false) OR {STUDY} THEN {S.study_discount} ELSE 1.0 END) * {S.extras_discount}")} AS score) FROM scored JOIN (SELECT spec_id, arg_min(doc_type, load_ord) FILTER (doc_type IS NOT NULL) AS spec_type FROM ch GROUP BY 1) USING (spec_id)))"""


def final(source: str, k: int, cap: int) -> str:
    return f"""flagged AS (SELECT *, row_number() OVER (PARTITION BY query_id, spec_id ORDER BY pos) <= {cap} AS kept FROM {source}),
counted AS (SELECT *, coalesce(sum(CAST(kept AS INTEGER)) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM flagged),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM counted WHERE kept AND so_far < {k})"""


SUPPORT = f"""support AS (SELECT query_id, spec_id, CAST(count(DISTINCT leg) AS INTEGER) AS support FROM (SELECT query_id, chunk_key, 'd' AS leg FROM dense WHERE rank <= {S.agreement_depth} UNION ALL SELECT query_id, chunk_key, 'l' FROM lex WHERE rank <= {S.agreement_depth}) JOIN ch USING (chunk_key) GROUP BY 1, 2)"""

LEGS = [CHUNKS, TERMS, INDEX, LEXICAL, DENSE]


def query(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
