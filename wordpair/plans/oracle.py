"""DuckDB SQL equivalents of the registered queries (independent oracle).

Written against the driver's pre-registered views (documents, conversations,
events, embeddings, ...).  Shared pieces are composed as CTE text.
"""

from __future__ import annotations

# Fixed values, written out here on their own so that a wrong constant in the
# code under test does not pass on both sides.
MIN_COUNT, WINDOW, X_FLOOR, TOP_WORDS = 5, 10, 10, 1000
EVENT_MIN_COUNT, EVENT_WINDOW = 1, 3
X_MAX, C0, LR, EPS = 100.0, 4.605170185988092, 0.05, 1e-8
TOP_K, HIST_BINS, PAIR_OFFSETS, X_MODULUS = 10, 60, 5, 150

DOC_TOKS = """doc_toks AS (
  SELECT doc_id AS seq_id, unnest(generate_series(1, len(t))) AS pos, unnest(t) AS token
  FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS t
        FROM documents))"""

CONV_TOKS = """conv_toks AS (
  SELECT conv_id AS seq_id, turn, unnest(generate_series(1, len(t))) AS pos,
         unnest(t) AS token
  FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS t
        FROM conversations))"""

EV_TOKS = """ev_toks AS (
  SELECT user_id AS seq_id, ts, event_id, event_type AS token
  FROM events WHERE event_type IS NOT NULL)"""


def vocab_cte(name: str, toks: str, min_count: int, max_size: int | None) -> str:
    lim = f"LIMIT {max_size}" if max_size else ""
    return f"""{name} AS (
  SELECT CAST(row_number() OVER (ORDER BY cnt DESC, word) AS INTEGER) AS id, word,
         CAST(cnt AS BIGINT) AS count
  FROM (SELECT token AS word, count(*) AS cnt FROM {toks} GROUP BY token
        HAVING count(*) >= {min_count})
  ORDER BY cnt DESC, word {lim})"""


def enc_cte(name: str, toks: str, vocab: str, order: str, stream: bool = False) -> str:
    part = "" if stream else "PARTITION BY t.seq_id"
    return f"""{name} AS (
  SELECT t.seq_id, row_number() OVER ({part} ORDER BY t.seq_id, {order}) AS p, v.id
  FROM {toks} t JOIN {vocab} v ON t.token = v.word)"""


def pairs_cte(name: str, enc: str, window: int, stream: bool = False) -> str:
    same = "" if stream else "a.seq_id = b.seq_id AND"
    return f"""{name} AS MATERIALIZED (
  SELECT CAST(least(a.id, b.id) AS INTEGER) AS w1, CAST(greatest(a.id, b.id) AS INTEGER) AS w2,
         CAST(count(*) AS BIGINT) AS x
  FROM (SELECT seq_id, p, id, unnest(range(1, {window + 1})) AS k FROM {enc}) a
  JOIN {enc} b ON {same} b.p = a.p + a.k
  WHERE a.id <> b.id
  GROUP BY 1, 2)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


DOC_VOCAB = vocab_cte("vocab", "doc_toks", MIN_COUNT, None)
DOC_ENC = enc_cte("enc", "doc_toks", "vocab", "t.pos")
DOC_PAIRS = pairs_cte("pairs", "enc", WINDOW)
DOC_BASE = (DOC_TOKS, DOC_VOCAB, DOC_ENC, DOC_PAIRS)

MARG = """marg AS (
  SELECT id, CAST(sum(x) AS BIGINT) AS row_sum
  FROM (SELECT w1 AS id, x FROM pairs UNION ALL SELECT w2 AS id, x FROM pairs) GROUP BY id)"""

PMI = f"""pmi AS (
  SELECT p.w1, p.w2, p.x,
         ln(CAST(p.x AS DOUBLE)) + ln((SELECT 2.0 * sum(x) FROM pairs))
           - ln(CAST(m1.row_sum AS DOUBLE)) - ln(CAST(m2.row_sum AS DOUBLE)) AS pmi
  FROM pairs p JOIN marg m1 ON m1.id = p.w1 JOIN marg m2 ON m2.id = p.w2
  WHERE p.x >= {X_FLOOR})"""


def sql() -> dict[str, str]:
    base = with_(*DOC_BASE)
    out = {
        "vocab_documents": with_(DOC_TOKS, DOC_VOCAB) + "SELECT id, word, count FROM vocab",
        "vocab_top_k_documents": with_(DOC_TOKS, vocab_cte("vocab", "doc_toks", MIN_COUNT, TOP_WORDS))
        + "SELECT id, word, count FROM vocab",
        "vocab_stats_documents": with_(DOC_TOKS, DOC_VOCAB)
        + "SELECT count(*) AS n_words, CAST(coalesce(sum(count), 0) AS BIGINT) AS total_count FROM vocab",
        "tokenize_documents": with_(DOC_TOKS, DOC_VOCAB, DOC_ENC)
        + "SELECT seq_id, CAST(p AS INTEGER) AS pos, id FROM enc",
        "cooccurrence_documents": base + "SELECT w1, w2, x FROM pairs",
        "cooccurrence_documents_blocks": base + "SELECT w1, w2, x FROM pairs",
        "cooccurrence_stream": with_(DOC_TOKS, DOC_VOCAB,
                                     enc_cte("enc", "doc_toks", "vocab", "t.pos", stream=True),
                                     pairs_cte("pairs", "enc", WINDOW, stream=True))
        + "SELECT w1, w2, x FROM pairs",
        "cooccurrence_conversations": with_(
            CONV_TOKS, vocab_cte("vocab", "conv_toks", MIN_COUNT, None),
            enc_cte("enc", "conv_toks", "vocab", "t.turn, t.pos"),
            pairs_cte("pairs", "enc", WINDOW)) + "SELECT w1, w2, x FROM pairs",
        "cooccurrence_events": with_(
            EV_TOKS, vocab_cte("vocab", "ev_toks", EVENT_MIN_COUNT, None),
            enc_cte("enc", "ev_toks", "vocab", "t.ts, t.event_id"),
            pairs_cte("pairs", "enc", EVENT_WINDOW)) + "SELECT w1, w2, x FROM pairs",
        "matrix_facts_documents": base + """SELECT CAST(2 * count(*) AS BIGINT) AS nnz,
  CAST(2 * coalesce(sum(x), 0) AS BIGINT) AS total,
  CAST(coalesce(greatest(max(w1), max(w2)), 0) AS INTEGER) AS n,
  coalesce(bool_and(w1 < w2), true) AS symmetric FROM pairs""",
        "pair_marginals_documents": with_(*DOC_BASE, MARG) + "SELECT id, row_sum FROM marg",
        "symmetric_degree_documents": base + """SELECT w, CAST(count(*) AS BIGINT) AS nnz,
  CAST(sum(x) AS BIGINT) AS row_sum, CAST(sum(CASE WHEN w = c THEN 1 ELSE 0 END) AS BIGINT) AS diag
FROM (SELECT w1 AS w, w2 AS c, x FROM pairs UNION ALL SELECT w2, w1, x FROM pairs) GROUP BY w""",
        "pmi_documents": with_(*DOC_BASE, MARG, PMI)
        + "SELECT w1, w2, x, round(pmi, 6) AS pmi FROM pmi",
        "top_pmi_documents": with_(*DOC_BASE, MARG, PMI) + """SELECT t.w1, t.w2, v1.word AS word1,
  v2.word AS word2, t.x, round(t.pmi, 6) AS pmi
FROM (SELECT * FROM pmi ORDER BY pmi DESC, w1, w2 LIMIT 20) t
JOIN vocab v1 ON v1.id = t.w1 JOIN vocab v2 ON v2.id = t.w2""",
    }
    return out


# ================================================================ vectors
VEC = """vec AS (
  SELECT CAST(vec_id + 1 AS INTEGER) AS id, 'w' || CAST(vec_id + 1 AS VARCHAR) AS word,
         CAST(100000 // (vec_id + 1) + 1 AS BIGINT) AS count,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)
             * (CAST(1 AS DOUBLE) + CAST(vec_id % 7 AS DOUBLE) / CAST(4 AS DOUBLE))) AS v
  FROM embeddings)"""

SPAIRS = f"""pairs AS (
  SELECT w1, w2, CAST(1 + (w1 * 7 + w2 * 13) % {X_MODULUS} AS BIGINT) AS x
  FROM (SELECT id AS w1, CAST(id + k AS INTEGER) AS w2 FROM vec, range(1, {PAIR_OFFSETS + 1}) r(k))
  WHERE w2 <= (SELECT max(id) FROM vec))"""

CTX = """ctx AS (
  SELECT CAST(vec_id AS BIGINT) AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c
  FROM embeddings)"""

QUEST = """quest AS (
  SELECT CAST(vec_id * 2 + copy AS BIGINT) AS qid,
         CASE WHEN vec_id % 250 = 7 THEN 'rare' ELSE CAST(label AS VARCHAR) END AS relation,
         'w' || CAST(vec_id + 1 AS VARCHAR) AS a,
         CASE WHEN vec_id % 13 = 5 THEN 'nowhere' ELSE 'w' || CAST(vec_id + 2 AS VARCHAR) END AS b,
         CASE WHEN vec_id % 11 = 3 THEN 'missing' ELSE 'w' || CAST(vec_id + 3 AS VARCHAR) END AS c,
         CASE WHEN vec_id % 5 = 0 THEN 'W' ELSE 'w' END || CAST(vec_id + 4 AS VARCHAR) AS d
  FROM (SELECT vec_id, label,
               unnest(CASE WHEN vec_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM embeddings))"""

SQN = "list_sum(list_transform({v}, lambda e: e * e))"


def _dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


TERMS = f"""terms AS (
  SELECT w1, w2, x, least(CAST(x AS DOUBLE), {_dbl(X_MAX)}) AS xbar, vs,
         ln(CAST(x AS DOUBLE)) - {SQN.format(v='vs')} - {_dbl(C0)} AS r
  FROM (SELECT p.w1, p.w2, p.x, list_transform(list_zip(a.v, b.v), lambda e: e[1] + e[2]) AS vs
        FROM pairs p JOIN vec a ON a.id = p.w1 JOIN vec b ON b.id = p.w2))"""

GRAD = """ends AS (
  SELECT w1 AS id, CAST(-4 AS DOUBLE) * xbar * r AS coef, vs FROM terms
  UNION ALL SELECT w2 AS id, CAST(-4 AS DOUBLE) * xbar * r AS coef, vs FROM terms),
grad AS (
  SELECT id, k, sum(g) AS g FROM (
    SELECT id, unnest(generate_series(1, len(vs))) AS k,
           unnest(list_transform(vs, lambda e: e * coef)) AS g FROM ends)
  GROUP BY id, k)"""

SMARG = """marg AS (
  SELECT id, CAST(sum(x) AS BIGINT) AS row_sum
  FROM (SELECT w1 AS id, x FROM pairs UNION ALL SELECT w2 AS id, x FROM pairs) GROUP BY id)"""

SCATTER = f"""often AS MATERIALIZED (
  SELECT p.w1, p.w2, p.x,
         ln(CAST(p.x AS DOUBLE)) + ln((SELECT CAST(2 * sum(x) AS DOUBLE) FROM pairs))
           - ln(CAST(m1.row_sum AS DOUBLE)) - ln(CAST(m2.row_sum AS DOUBLE)) AS pmi_emp
  FROM (SELECT * FROM pairs WHERE x >= {X_FLOOR}) p
       JOIN marg m1 ON m1.id = p.w1 JOIN marg m2 ON m2.id = p.w2),
scatter AS (
  SELECT p.w1, p.w2, p.x, p.pmi_emp, list_dot_product(a.v, b.v) AS pmi_pred
  FROM often p JOIN vec a ON a.id = p.w1 JOIN vec b ON b.id = p.w2)"""


def pf_cte(renormalize: bool) -> str:
    scale = "CAST(4 AS DOUBLE) / (SELECT avg(sqrt(" + SQN.format(v="v") + ")) FROM vec)"
    cvec = ("list_transform(c, lambda e: e / sqrt(" + SQN.format(v="c") + ") * sc)") if renormalize \
        else "list_transform(c, lambda e: e * sc)"
    return f"""cs AS (SELECT t, {cvec} AS c FROM (SELECT t, c, {scale} AS sc FROM ctx)),
zt AS (SELECT cs.t AS s, sum(exp(list_dot_product(vec.v, cs.c))) AS z FROM cs, vec GROUP BY cs.t),
pf AS (SELECT s, z, z / (SELECT avg(z) FROM zt) AS normalised FROM zt)"""


NORMED = """vn AS (
  SELECT id, list_transform(v, lambda e: e / nrm) AS vn
  FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda e: e * e))) AS nrm FROM vec)),
el AS (
  SELECT q.qid, q.relation, a.id AS a_id, b.id AS b_id, c.id AS c_id, d.id AS d_id,
         list_transform(list_zip(b.v, a.v, c.v), lambda e: e[1] - e[2] + e[3]) AS raw
  FROM quest q JOIN vec a ON a.word = lower(q.a) JOIN vec b ON b.word = lower(q.b)
       JOIN vec c ON c.word = lower(q.c) JOIN vec d ON d.word = lower(q.d)),
qn AS (
  SELECT qid, a_id, b_id, c_id, list_transform(raw, lambda e: e / nrm) AS qn
  FROM (SELECT *, sqrt(list_sum(list_transform(raw, lambda e: e * e))) AS nrm FROM el)),
sc AS (
  SELECT qn.qid, vn.id, list_dot_product(vn.vn, qn.qn) AS s FROM qn, vn
  WHERE vn.id <> qn.a_id AND vn.id <> qn.b_id AND vn.id <> qn.c_id),
best AS (
  SELECT qid, id AS pred, s AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rn
    FROM sc WHERE NOT isnan(s)) WHERE rn = 1),
pred AS (
  SELECT el.qid, el.relation, CAST(coalesce(best.pred, 0) AS INTEGER) AS pred, best.score,
         coalesce(best.pred, 0) = el.d_id AS correct
  FROM el LEFT JOIN best ON best.qid = el.qid)"""

LINES = """lq AS (
  SELECT CASE WHEN qid % 97 = 3 THEN '' ELSE relation END AS relation, qid, a, b, c, d FROM quest),
unranked AS (
  SELECT DISTINCT relation, 0 AS kind, CAST(-1 AS BIGINT) AS qid, ' :  ' || relation || ' ' AS value
  FROM lq WHERE relation <> ''
  UNION ALL SELECT relation, 1, qid, concat_ws('  ', a, b, c, d) FROM lq
  UNION ALL SELECT relation, 2, qid, concat_ws(' ', a, b, c) FROM lq WHERE qid % 29 = 0
  UNION ALL SELECT relation, 3, qid, concat_ws(' ', a, b, c, d, a) FROM lq WHERE qid % 31 = 0
  UNION ALL SELECT relation, 4, qid, '   ' FROM lq WHERE qid % 37 = 0),
lines AS (
  SELECT 'analogies' AS file, value,
         row_number() OVER (ORDER BY relation, kind, qid) AS line_no FROM unranked),
stripped AS (
  SELECT file, line_no, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS s FROM lines),
heads AS (
  SELECT file, line_no AS h_line, regexp_replace(substr(s, 2), '^\\s+|\\s+$', '', 'g') AS relation
  FROM stripped WHERE s LIKE ':%'),
qlines AS (
  SELECT file, line_no, regexp_split_to_array(s, '\\s+') AS f
  FROM stripped WHERE s <> '' AND NOT s LIKE ':%')"""

EMIT = f"""lg AS (
  SELECT cs.t, vec.id, list_dot_product(vec.v, cs.c) AS logit FROM cs, vec),
nz AS (SELECT t, max(logit) AS m FROM lg GROUP BY t),
zz AS (SELECT lg.t, sum(exp(lg.logit - nz.m)) AS z FROM lg JOIN nz ON nz.t = lg.t GROUP BY lg.t),
probs AS (
  SELECT lg.t, lg.id, exp(lg.logit - nz.m) / zz.z AS p,
         row_number() OVER (PARTITION BY lg.t ORDER BY lg.logit DESC, lg.id) AS rank
  FROM lg JOIN nz ON nz.t = lg.t JOIN zz ON zz.t = lg.t)"""


def vector_sql() -> dict[str, str]:
    return {
        "norm_vs_frequency": with_(VEC) + f"""SELECT id, round({SQN.format(v='v')}, 6) AS sq_norm,
  round(ln(CAST(count AS DOUBLE) / (SELECT CAST(sum(count) AS DOUBLE) FROM vec)), 6) AS log_freq FROM vec""",
        "norm_vs_frequency_summary": with_(VEC) + f"""SELECT count(*) AS n,
  round(corr({SQN.format(v='v')}, ln(CAST(count AS DOUBLE) / (SELECT CAST(sum(count) AS DOUBLE) FROM vec))), 6)
    AS correlation FROM vec""",
        "sn_loss": with_(VEC, SPAIRS, TERMS) + """SELECT round(sum(xbar * r * r), 4) AS loss,
  round(sum(xbar), 4) AS weight, round(sum(xbar * r * r) / sum(xbar), 4) AS wmse,
  round(sum(CAST(-2 AS DOUBLE) * xbar * r), 4) AS grad_c FROM terms""",
        "sn_gradient": with_(VEC, SPAIRS, TERMS, GRAD)
        + "SELECT id, CAST(k AS INTEGER) AS k, round(g, 5) AS g FROM grad",
        "adagrad_step": with_(VEC, SPAIRS, TERMS, GRAD) + f"""SELECT vec.id, CAST(gk.k AS INTEGER) AS k,
  round(CASE WHEN grad.g IS NULL THEN vec.v[gk.k]
             ELSE vec.v[gk.k] - {_dbl(LR)} * grad.g / (sqrt(grad.g * grad.g) + {_dbl(EPS)}) END, 5) AS v,
  round(sqrt(coalesce(grad.g * grad.g, CAST(0 AS DOUBLE))), 5) AS g_rms
FROM vec CROSS JOIN LATERAL (SELECT unnest(generate_series(1, len(vec.v))) AS k) gk
LEFT JOIN grad ON grad.id = vec.id AND grad.k = gk.k""",
        "pmi_scatter": with_(VEC, SPAIRS, SMARG, SCATTER)
        + "SELECT w1, w2, x, round(pmi_emp, 6) AS pmi_emp, round(pmi_pred, 6) AS pmi_pred FROM scatter",
        "pmi_scatter_summary": with_(VEC, SPAIRS, SMARG, SCATTER) + """SELECT count(*) AS n,
  round(corr(pmi_emp, pmi_pred), 6) AS correlation, round(regr_slope(pmi_emp, pmi_pred), 6) AS slope,
  round(regr_intercept(pmi_emp, pmi_pred), 6) AS intercept FROM scatter""",
        "partition_function_path": with_(VEC, CTX, pf_cte(False))
        + "SELECT s, round(z, 5) AS z, round(normalised, 6) AS normalised FROM pf",
        "partition_function_path_summary": with_(VEC, CTX, pf_cte(False)) + """SELECT count(*) AS n,
  round(avg(z), 5) AS mean_z,
  round(CAST(4 AS DOUBLE) / (SELECT avg(sqrt(list_sum(list_transform(v, lambda e: e * e)))) FROM vec), 6)
    AS c_norm,
  round(stddev_samp(normalised), 6) AS std_ratio,
  round(avg(CASE WHEN normalised BETWEEN 0.9 AND 1.1 THEN 1.0 ELSE 0.0 END), 6) AS frac_in_band FROM pf""",
        "partition_function_directions": with_(VEC, CTX, pf_cte(True))
        + "SELECT s, round(z, 5) AS z, round(normalised, 6) AS normalised FROM pf",
        "z_histogram": with_(VEC, CTX, pf_cte(False)) + f""", mm AS (
  SELECT min(normalised) AS lo, max(normalised) AS hi FROM pf),
hb AS (
  SELECT CAST(CASE WHEN mm.hi > mm.lo
                   THEN least(floor((pf.normalised - mm.lo) / ((mm.hi - mm.lo) / {HIST_BINS})) + 1, {HIST_BINS})
                   ELSE 1 END AS INTEGER) AS bin, mm.lo, mm.hi
  FROM pf, mm)
SELECT bin, round(lo + (bin - 1) * ((hi - lo) / {HIST_BINS}), 6) AS lo,
       round(lo + bin * ((hi - lo) / {HIST_BINS}), 6) AS hi, count(*) AS count
FROM hb GROUP BY bin, lo, hi""".replace("WITH", "WITH", 1),
        "singular_energy": with_(VEC) + f"""SELECT CAST(least(count(*), max(len(v))) AS BIGINT) AS n_values,
  round(sum({SQN.format(v='v')}), 4) AS energy FROM vec""",
        "analogy_predictions": with_(VEC, QUEST, NORMED)
        + "SELECT qid, pred, round(score, 6) AS score, correct FROM pred",
        "analogy_by_relation": with_(VEC, QUEST, NORMED) + """SELECT relation,
  CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total,
  round(CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS accuracy
FROM pred GROUP BY relation""",
        "analogy_summary": with_(VEC, QUEST, NORMED) + """SELECT
  round(CASE WHEN count(*) > 0 THEN CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS DOUBLE) / count(*)
             ELSE 0.0 END, 6) AS overall,
  CAST(coalesce(sum(CASE WHEN correct THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_correct,
  count(*) AS n_eligible, (SELECT count(*) FROM quest) AS n_total,
  (SELECT count(DISTINCT relation) FROM quest) AS n_relations FROM pred""",
        "analogy_parse": with_(QUEST, LINES) + """SELECT q.file, q.line_no,
  coalesce((SELECT h.relation FROM heads h WHERE h.file = q.file AND h.h_line < q.line_no
            ORDER BY h.h_line DESC LIMIT 1), '') AS relation,
  q.f[1] AS a, q.f[2] AS b, q.f[3] AS c, q.f[4] AS d
FROM qlines q WHERE len(q.f) = 4""",
        "relation_pairs": with_(VEC, QUEST) + """SELECT q.relation, count(*) AS n_pairs
FROM quest q JOIN vec a ON a.word = lower(q.a) JOIN vec b ON b.word = lower(q.b)
GROUP BY q.relation HAVING count(*) >= 5""",
        "emission_probs": with_(VEC, CTX, pf_cte(False), EMIT)
        + "SELECT t, CAST(rank AS INTEGER) AS rank, id, round(p, 8) AS p FROM probs WHERE rank <= "
        + str(TOP_K),
        "context_norm_deviation": with_(CTX) + f"""SELECT count(*) AS n,
  round(max(abs(sqrt({SQN.format(v='c')}) - CAST(1 AS DOUBLE))), 10) AS max_dev FROM ctx""",
        "pmi_extent": with_(VEC, SPAIRS, SMARG, SCATTER)
        + "SELECT round(min(pmi_pred), 6) AS lo, round(max(pmi_pred), 6) AS hi FROM scatter",
        "embedding_summary": with_(VEC)
        + "SELECT CAST(max(len(v)) AS INTEGER) AS d, count(*) AS n, " + _dbl(C0) + " AS c FROM vec",
    }


DVEC = """dvec AS (
  SELECT v.id, v.word, v.count, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)
           * (CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + CAST(v.id % 5 AS DOUBLE)))) AS v
  FROM vocab v JOIN embeddings e ON e.vec_id = (v.id - 1) % (SELECT count(*) FROM embeddings))"""


def hash52(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT)"


def uniform(*parts: str) -> str:
    return f"((CAST({hash52(*parts)} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"


def minibatch_ctes(steps: int, scale: str = "0.125", vec: str = "vec") -> list[str]:
    """Two AdaGrad steps by hand: vectors in long form, one gradient per batch."""
    out = [f"""s0 AS (
  SELECT id, k, v * CAST({scale} AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS g
  FROM (SELECT id, unnest(generate_series(1, len(v))) AS k, unnest(v) AS v FROM {vec}))""",
           f"c0 AS (SELECT {_dbl(C0)} AS c, CAST(0 AS DOUBLE) AS g)"]
    for i in range(steps):
        out.append(f"""t{i} AS MATERIALIZED (
  SELECT p.w1, p.w2, least(CAST(p.x AS DOUBLE), {_dbl(X_MAX)}) AS xbar,
         ln(CAST(p.x AS DOUBLE)) - sum((a.v + b.v) * (a.v + b.v)) - (SELECT c FROM c{i}) AS r
  FROM pairs p JOIN s{i} a ON a.id = p.w1 JOIN s{i} b ON b.id = p.w2 AND b.k = a.k
  WHERE (p.w1 + p.w2) % 2 = {i} GROUP BY p.w1, p.w2, p.x),
l{i} AS (SELECT sum(xbar * r * r) / sum(xbar) AS wmse, sum(CAST(-2 AS DOUBLE) * xbar * r) AS gc FROM t{i}),
g{i} AS (
  SELECT id, k, sum(coef * (va + vb)) AS g FROM (
    SELECT unnest([t.w1, t.w2]) AS id, a.k, CAST(-4 AS DOUBLE) * t.xbar * t.r AS coef, a.v AS va, b.v AS vb
    FROM t{i} t JOIN s{i} a ON a.id = t.w1 JOIN s{i} b ON b.id = t.w2 AND b.k = a.k)
  GROUP BY id, k),
s{i + 1} AS MATERIALIZED (
  SELECT s.id, s.k, CASE WHEN g.g IS NULL THEN s.v
           ELSE s.v - {_dbl(LR)} * g.g / (sqrt(s.g + g.g * g.g) + {_dbl(EPS)}) END AS v,
         s.g + coalesce(g.g * g.g, CAST(0 AS DOUBLE)) AS g
  FROM s{i} s LEFT JOIN g{i} g ON g.id = s.id AND g.k = s.k),
c{i + 1} AS (
  SELECT c.c - {_dbl(LR)} * l.gc / (sqrt(c.g + l.gc * l.gc) + {_dbl(EPS)}) AS c, c.g + l.gc * l.gc AS g
  FROM c{i} c, l{i} l)""")
    return out


def first_direction_ctes(squarings: int) -> list[str]:
    """The leading eigenvector of every relation's moment matrix by repeated squaring."""
    out = ["""rp AS (
  SELECT q.relation, a.id AS a_id, b.id AS b_id, count(*) AS w, any_value(a.v) AS va, any_value(b.v) AS vb
  FROM quest q JOIN vec a ON a.word = lower(q.a) JOIN vec b ON b.word = lower(q.b)
  GROUP BY q.relation, a.id, b.id),
sz AS (SELECT relation, CAST(sum(w) AS BIGINT) AS n_pairs FROM rp GROUP BY relation HAVING sum(w) >= 5),
df AS MATERIALIZED (
  SELECT rp.relation, a_id, b_id, w, unnest(generate_series(1, len(va))) AS k,
         unnest(list_transform(list_zip(va, vb), lambda e: e[1] - e[2])) AS d
  FROM rp JOIN sz ON sz.relation = rp.relation),
m0 AS MATERIALIZED (
  SELECT x.relation, x.k AS i, y.k AS j, sum(x.w * x.d * y.d) AS m
  FROM df x JOIN df y ON x.relation = y.relation AND x.a_id = y.a_id AND x.b_id = y.b_id
  GROUP BY x.relation, x.k, y.k)"""]
    for i in range(squarings):
        out.append(f"""m{i + 1} AS MATERIALIZED (
  SELECT a.relation, a.i, b.j, sum(a.m * b.m / (t.t * t.t)) AS m
  FROM m{i} a JOIN m{i} b ON a.relation = b.relation AND a.j = b.i
  JOIN (SELECT relation, sum(m) AS t FROM m{i} WHERE i = j GROUP BY relation) t ON t.relation = a.relation
  GROUP BY a.relation, a.i, b.j)""")
    last = f"m{squarings}"
    out.append(f"""u AS (
  SELECT m.relation, m.i AS k, m.m / sqrt(sum(m.m * m.m) OVER (PARTITION BY m.relation)) AS u
  FROM {last} m JOIN (SELECT relation, arg_max(j, m) AS j FROM {last} WHERE i = j GROUP BY relation) c
    ON c.relation = m.relation AND c.j = m.j),
cs1 AS (
  SELECT df.relation, df.a_id, df.b_id, any_value(df.w) AS w, sum(df.d * u.u) / sqrt(sum(df.d * df.d)) AS c
  FROM df JOIN u ON u.relation = df.relation AND u.k = df.k GROUP BY df.relation, df.a_id, df.b_id),
mean1 AS (SELECT relation, sum(w * c) / sum(w) AS m FROM cs1 GROUP BY relation)""")
    return out


def second_direction_ctes(squarings: int) -> list[str]:
    """The second eigenvector: the first one's part is taken out of the matrix, and the
    rest is squared again."""
    out = ["""d0 AS MATERIALIZED (
  SELECT m.relation, m.i, m.j, m.m - l.v * a.u * b.u AS m
  FROM m0 m JOIN u a ON a.relation = m.relation AND a.k = m.i JOIN u b ON b.relation = m.relation AND b.k = m.j
  JOIN (SELECT m.relation, sum(m.m * a.u * b.u) AS v FROM m0 m
        JOIN u a ON a.relation = m.relation AND a.k = m.i JOIN u b ON b.relation = m.relation AND b.k = m.j
        GROUP BY m.relation) l ON l.relation = m.relation)"""]
    for i in range(squarings):
        out.append(f"""d{i + 1} AS MATERIALIZED (
  SELECT a.relation, a.i, b.j, sum(a.m * b.m / (t.t * t.t)) AS m
  FROM d{i} a JOIN d{i} b ON a.relation = b.relation AND a.j = b.i
  JOIN (SELECT relation, sum(m) AS t FROM d{i} WHERE i = j GROUP BY relation) t ON t.relation = a.relation
  GROUP BY a.relation, a.i, b.j)""")
    last = f"d{squarings}"
    out.append(f"""u2 AS (
  SELECT m.relation, m.i AS k, m.m / sqrt(sum(m.m * m.m) OVER (PARTITION BY m.relation)) AS u
  FROM {last} m JOIN (SELECT relation, arg_max(j, m) AS j FROM {last} WHERE i = j GROUP BY relation) c
    ON c.relation = m.relation AND c.j = m.j),
cs2 AS (
  SELECT df.relation, df.a_id, df.b_id, any_value(df.w) AS w, sum(df.d * u2.u) / sqrt(sum(df.d * df.d)) AS c
  FROM df JOIN u2 ON u2.relation = df.relation AND u2.k = df.k GROUP BY df.relation, df.a_id, df.b_id),
mean2 AS (SELECT relation, sum(w * c) / sum(w) AS m FROM cs2 GROUP BY relation)""")
    return out


def more_sql() -> dict[str, str]:
    real = (*DOC_BASE, DVEC)
    scatter = SCATTER.replace("JOIN vec ", "JOIN dvec ")
    terms = TERMS.replace("JOIN vec ", "JOIN dvec ")
    return {
        "sn_loss_documents": with_(*real, terms) + """SELECT round(sum(xbar), 4) AS weight,
  round(sum(xbar * r * r) / sum(xbar), 6) AS wmse,
  round(sum(CAST(-2 AS DOUBLE) * xbar * r) / sum(xbar), 6) AS grad_c_mean FROM terms""",
        "pmi_scatter_documents": with_(*real, SMARG, scatter)
        + "SELECT w1, w2, x, round(pmi_emp, 6) AS pmi_emp, round(pmi_pred, 6) AS pmi_pred FROM scatter",
        "norm_vs_frequency_documents": with_(DOC_TOKS, DOC_VOCAB, DVEC)
        + f"""SELECT id, round({SQN.format(v='v')}, 6) AS sq_norm,
  round(ln(CAST(count AS DOUBLE) / (SELECT CAST(sum(count) AS DOUBLE) FROM dvec)), 6) AS log_freq FROM dvec""",
        "word_lookup": with_(VEC, QUEST) + """SELECT q.qid, q.word, CAST(coalesce(v.id, 0) AS INTEGER) AS id
FROM (SELECT qid, unnest([a, b, c, d]) AS word FROM quest) q LEFT JOIN vec v ON v.word = lower(q.word)""",
        "vector_lookup": with_(VEC, QUEST) + f"""SELECT q.qid, q.b AS word,
  round({SQN.format(v='v.v')}, 6) AS sq_norm FROM quest q LEFT JOIN vec v ON v.word = q.b""",
        "upper_triangle_documents": with_(*DOC_BASE) + "SELECT w1, w2, x FROM pairs",
        "merged_pairs_documents": with_(*DOC_BASE) + "SELECT w1, w2, x FROM pairs",
        "pmi_intercept_documents": with_(*real, SMARG, scatter) + """SELECT count(*) AS n,
  round(ln(CAST(45 AS DOUBLE)), 6) AS gamma,
  round(regr_intercept(pmi_emp, pmi_pred), 6) AS intercept FROM scatter""",
        "analogy_topk": with_(VEC, QUEST, NORMED) + """SELECT qid, CAST(rank AS INTEGER) AS rank, id,
  round(s, 6) AS score
FROM (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank
      FROM sc WHERE NOT isnan(s)) WHERE rank <= 3""",
        "analogy_report": vector_sql()["analogy_by_relation"] + " ORDER BY relation",
        "relation_first_direction": with_(VEC, QUEST, *first_direction_ctes(12)) + """SELECT cs1.relation,
  any_value(sz.n_pairs) AS n_pairs, round(abs(any_value(mean1.m)), 5) AS mean1,
  round(sqrt(sum(w * (c - mean1.m) * (c - mean1.m)) / (sum(w) - 1)), 5) AS std1
FROM cs1 JOIN mean1 ON mean1.relation = cs1.relation JOIN sz ON sz.relation = cs1.relation
GROUP BY cs1.relation""",
        "relation_second_direction": with_(VEC, QUEST, *first_direction_ctes(12), *second_direction_ctes(13))
        + """SELECT cs2.relation, round(abs(any_value(mean2.m)), 4) AS mean2,
  round(sqrt(sum(w * (c - mean2.m) * (c - mean2.m)) / (sum(w) - 1)), 4) AS std2
FROM cs2 JOIN mean2 ON mean2.relation = cs2.relation GROUP BY cs2.relation""",
        "singular_power_sums": with_(VEC) + """, long AS (
  SELECT id, unnest(generate_series(1, len(v))) AS k, unnest(v) AS v FROM vec),
gram AS (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS m FROM long a JOIN long b ON a.id = b.id GROUP BY a.k, b.k),
square AS (SELECT a.i, b.j, sum(a.m * b.m) AS m FROM gram a JOIN gram b ON a.j = b.i GROUP BY a.i, b.j)
SELECT (SELECT least(count(*), max(len(v))) FROM vec) AS n_values,
       (SELECT round(sum(m), 3) FROM gram WHERE i = j) AS p2,
       (SELECT round(ln(sum(m * m)), 8) FROM gram) AS log_p4,
       (SELECT round(ln(sum(g.m * s.m)), 8) FROM gram g JOIN square s ON s.i = g.i AND s.j = g.j) AS log_p6""",
        "train_minibatch_losses": with_(VEC, SPAIRS, *minibatch_ctes(2)) + """
SELECT 1 AS epoch, 0 AS batch, round(l0.wmse, 5) AS wmse, round(c1.c, 6) AS c FROM l0, c1
UNION ALL SELECT 1, 1, round(l1.wmse, 5), round(c2.c, 6) FROM l1, c2""",
        "tokenize_conversations": with_(
            CONV_TOKS, vocab_cte("vocab", "conv_toks", MIN_COUNT, None),
            enc_cte("enc", "conv_toks", "vocab", "t.turn, t.pos")) + "SELECT seq_id, CAST(p AS INTEGER) AS pos, id FROM enc",
        "cooccurrence_files": _corpus_sql()["cooccurrence_stream"],
        "stage_pairs_documents": with_(*DOC_BASE) + f"SELECT w1, w2, x, CAST({WINDOW} AS INTEGER) AS \"window\" FROM pairs",
        "pmi_sample_documents": with_(*DOC_BASE, MARG, PMI) + f"""SELECT w1, w2, x, round(pmi, 6) AS pmi
FROM pmi ORDER BY {hash52('1', 'w1', 'w2')}, w1, w2 LIMIT 5000""",
        "analogy_topk_pruned": with_(VEC, QUEST, NORMED) + """SELECT qid, CAST(rank AS INTEGER) AS rank, id,
  round(s, 6) AS score
FROM (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank
      FROM sc WHERE NOT isnan(s)) WHERE rank <= 3""",
        "partition_function_random": with_(VEC, f"""ctx AS (
  SELECT s AS t, list(g ORDER BY k) AS c FROM (
    SELECT s, k, sqrt(CAST(-2 AS DOUBLE) * ln({uniform('0', 's', 'k', '0')}))
                 * cos(2 * pi() * {uniform('0', 's', 'k', '1')}) AS g
    FROM range(1000) a(s), (SELECT unnest(range(max(len(v)))) AS k FROM vec)) GROUP BY s)""", pf_cte(True))
        + "SELECT s, round(z, 5) AS z, round(normalised, 6) AS normalised FROM pf",
        "fit_documents": with_(*DOC_BASE, DVEC, "short AS (SELECT id, v[1:8] AS v FROM dvec)",
                               *minibatch_ctes(2, "1", "short"), """fitted AS MATERIALIZED (
  SELECT s.id, list(s.v ORDER BY s.k) AS v, any_value(w.count) AS count
  FROM s2 s JOIN vocab w ON w.id = s.id GROUP BY s.id)""", SMARG, SCATTER.replace("JOIN vec ", "JOIN fitted "))
        + f"""SELECT (SELECT round(wmse, 5) FROM l0) AS wmse0, (SELECT round(wmse, 5) FROM l1) AS wmse1,
  (SELECT round(c, 6) FROM c2) AS c,
  (SELECT round(corr({SQN.format(v='v')}, ln(CAST(count AS DOUBLE) / (SELECT sum(count) FROM fitted))), 5)
   FROM fitted) AS d2_correlation,
  count(*) AS d4_n, round(corr(pmi_emp, pmi_pred), 4) AS d4_correlation,
  round(regr_slope(pmi_emp, pmi_pred), 4) AS d4_slope, round(regr_intercept(pmi_emp, pmi_pred), 4) AS d4_intercept
FROM scatter""",
    }


_corpus_sql = sql


def sql() -> dict[str, str]:  # noqa: F811
    return {**_corpus_sql(), **vector_sql(), **more_sql()}
