"""DuckDB SQL of the queries whose SQL is built from patterns and constants."""

from __future__ import annotations

from wordpair.llm import secret_scan

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mixing_targets(rounds: int = 8) -> str:
    """Sizes and targets: every round freezes the sources above three times their size and
    shares the rest among the others (more rounds than the tables have sources)."""
    steps = "".join(f""",
        t{i + 1} AS (
          SELECT source, size, w, CASE WHEN target IS NOT NULL THEN target
                   WHEN free * w / weight > 3 * size THEN CAST(3 * size AS DOUBLE) END AS target,
                 free * w / weight AS share
          FROM (SELECT source, size, w, target, (SELECT total FROM sums) - coalesce(sum(target) OVER (), 0) AS free,
                       sum(CASE WHEN target IS NULL THEN w END) OVER () AS weight FROM t{i}))""" for i in range(rounds))
    return rf"""
        WITH d AS (
          SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                                     lambda x: x <> '')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) AS r
              FROM d GROUP BY source),
        sums AS (SELECT CAST(sum(size) AS DOUBLE) AS total FROM s),
        t0 AS (SELECT source, size, CAST([5, 2, 1][(r - 1) % 3 + 1] AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS target,
                      CAST(0 AS DOUBLE) AS share FROM s){steps}
        SELECT d.doc_id, d.size, t.size AS source_size, round(coalesce(t.target, t.share), 3) AS target
        FROM d JOIN t{rounds} t ON t.source IS NOT DISTINCT FROM d.source"""


def conversation_repair() -> str:
    return r"""
        WITH RECURSIVE crc_table AS (
          SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce([CAST(i AS UBIGINT)] || list_transform(range(8), lambda x: CAST(x AS UBIGINT)),
                     lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c
            FROM range(256) r(i))),
        src AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
          FROM conversations),
        fated AS (
          SELECT conv_id, turn, role, text,
                 xor(list_reduce([CAST(4294967295 AS UBIGINT)]
                   || list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS UBIGINT)),
                   lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) % 20 AS fate
          FROM src, crc_table),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                 CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
          FROM fated WHERE fate <> 0),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                 regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
          FROM damaged),
        faults AS (
          SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
                 CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                      WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
          FROM placed),
        ins(q, audit, cost, p, roles) AS (VALUES
          (0, '', 0, 0, []), (0, 'I', 3, 2, ['user']), (0, 'II', 6, 3, ['user', 'assistant']),
          (1, '', 0, 1, []), (1, 'I', 3, 2, ['user']), (1, 'II', 6, 3, ['user', 'assistant']),
          (2, '', 0, 2, []), (2, 'I', 3, 3, ['assistant']),
          (3, '', 0, 3, []), (3, 'I', 3, 2, ['user'])),
        edit(p, e, initial, cost, after, role) AS (VALUES
          (0, 'D', NULL, 4, 0, NULL), (1, 'D', NULL, 4, 1, NULL), (2, 'D', NULL, 4, 2, NULL), (3, 'D', NULL, 4, 3, NULL),
          (0, 'R', NULL, 3, 2, 'user'), (1, 'R', NULL, 3, 2, 'user'), (2, 'R', NULL, 3, 3, 'assistant'),
          (3, 'R', NULL, 3, 2, 'user'),
          (0, 'K', 's', 0, 1, NULL), (0, 'K', 'u', 0, 2, NULL), (1, 'K', 'u', 0, 2, NULL), (2, 'K', 'a', 0, 3, NULL),
          (3, 'K', 'u', 0, 2, NULL)),
        start AS (SELECT DISTINCT conv_id FROM faults),
        dp AS (
          SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': 0, 'audit': '', 'out': CAST([] AS VARCHAR[])} AS best FROM start
          UNION ALL
          SELECT f.conv_id, f.i, e.after AS q,
                 min({'cost': dp.best.cost + n.cost + e.cost + CASE WHEN f.fault = 'truncated' AND e.e <> 'D' THEN 3 ELSE 0 END,
                      'audit': dp.best.audit || n.audit || e.e,
                      'out': dp.best.out || list_transform(n.roles, lambda r: r || ':')
                             || CASE e.e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.role || ':' || f.text] END})
          FROM dp JOIN faults f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
          JOIN ins n ON n.q = dp.q
          JOIN edit e ON e.p = n.p AND (e.initial IS NULL OR e.initial = f.initial)
               AND (e.e = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
          GROUP BY f.conv_id, f.i, e.after),
        ends AS (
          SELECT dp.conv_id, min({'cost': dp.best.cost + n.cost, 'audit': dp.best.audit || n.audit,
                                  'out': dp.best.out || list_transform(n.roles, lambda r: r || ':')}) AS best
          FROM dp JOIN (SELECT conv_id, max(i) AS last FROM faults GROUP BY conv_id) l
               ON l.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = l.last
          JOIN ins n ON n.q = dp.q AND n.p IN (0, 3)
          GROUP BY dp.conv_id),
        sums AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM faults GROUP BY conv_id)
        SELECT c.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank,
               coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
               coalesce(s.illegal, 0) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost,
               coalesce(e.best.audit, '') AS audit,
               sha256(coalesce(array_to_string(e.best.out, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


def collocations(longest: int = 3, least: int = 10, top: int = 2000) -> str:
    return rf"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang,
                 unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                           '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
        n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        grams AS (
          SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
          FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
                FROM w, (SELECT unnest(range(1, {longest} + 1)) AS size) WHERE len(ws) >= size)),
        f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
        cuts AS (
          SELECT lang, phrase, a, size, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
        scored AS (
          SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r,
                 CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
          FROM cuts c
          JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
          JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ')),
        best AS (
          SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_phrases AS (
          SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
          FROM (SELECT lang, a, ws, m, unnest(range(1, size - m + 2)) AS i
                FROM (SELECT DISTINCT lang, a, size, ws, unnest(range(2, size)) AS m FROM cuts))
          GROUP BY ALL),
        kept AS (
          SELECT b.* FROM best b LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase
          WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n.n, score
        FROM kept k JOIN n ON n.lang = k.lang QUALIFY rank <= {top}"""


def secret_scan_sql(reach: int = 200) -> str:
    parts = {k: (p, least, g) for k, (p, least, g) in {**secret_scan.BASE, **secret_scan.WEAK}.items()}
    parts["blank"] = (secret_scan.BLANK_LINE, 0, 0)
    rank = {k: i for i, k in enumerate(["blank", *secret_scan.KINDS])}
    found = "\n UNION ALL ".join(
        f"""SELECT uid, '{k}' AS kind, {rank[k]} AS rank, {least} AS least, regexp_extract_all(t, {_text(p)}) AS whole,
              regexp_extract_all(t, {_text(p)}, {g}) AS counts, string_split_regex(t, {_text(p)}) AS between FROM held"""
        for k, (p, least, g) in parts.items())
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
        held AS (SELECT * FROM d WHERE regexp_matches(t, {_text(secret_scan.TRIGGER)})),
        m AS ({found}),
        one AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m WHERE len(whole) > 0),
        placed AS (
          SELECT uid, kind, rank, least, whole[i] AS value, length(counts[i]) AS n,
                 CAST(list_sum(list_transform(between[1:i], lambda x: length(x)))
                      + list_sum(list_transform(whole[1:i], lambda x: length(x))) AS BIGINT) AS e
          FROM one),
        cand AS (
          SELECT uid, CASE WHEN kind = 'assign' AND n < least THEN 'short' ELSE kind END AS kind,
                 CASE WHEN kind = 'assign' AND n < least THEN {rank['short']} ELSE rank END AS rank,
                 e - length(value) AS s, e
          FROM placed
          WHERE (n >= least OR (kind = 'assign' AND n >= 4))
            AND (kind <> 'key' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')))),
        seen AS (
          SELECT *, kind IN ('assign', 'access', 'hex') AS base,
                 max(CASE WHEN kind IN ('assign', 'access', 'hex') THEN e END) OVER (
                   PARTITION BY uid ORDER BY s, rank, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_end,
                 min(CASE WHEN kind IN ('assign', 'access', 'hex') THEN s END) OVER (
                   PARTITION BY uid ORDER BY s, rank, e ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS under_start
          FROM cand),
        free AS (
          SELECT uid, CASE WHEN kind = 'short' THEN 'key' ELSE kind END AS kind,
                 CASE WHEN kind = 'short' THEN {rank['key']} ELSE rank END AS rank, s, e, base
          FROM seen WHERE base OR NOT (coalesce(over_end > s, false) OR coalesce(under_start < e, false))),
        opened AS (
          SELECT *, CAST(kind = 'blank' OR coalesce(s - max(CASE WHEN kind <> 'blank' THEN e END) OVER (
                   PARTITION BY uid ORDER BY s, rank, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {reach}, false)
                   AS INTEGER) AS opens FROM free),
        scoped AS (SELECT *, sum(opens) OVER (PARTITION BY uid ORDER BY s, rank, e ROWS UNBOUNDED PRECEDING) AS scope FROM opened),
        linked AS (
          SELECT *, bool_or(kind IN ('access', 'ident')) OVER (PARTITION BY uid, scope)
                    AND bool_or(kind IN ('assign', 'hex', 'key')) OVER (PARTITION BY uid, scope) AS linked
          FROM scoped WHERE kind <> 'blank'),
        told AS (
          SELECT uid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                 count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (base) AS base,
                 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans
          FROM linked WHERE base OR linked GROUP BY uid)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
               coalesce(n_hex, 0) AS n_hex, sha256(coalesce(told.base, '')) AS base_sha256,
               coalesce(spans, '') AS spans
        FROM d LEFT JOIN told ON told.uid = d.uid"""
