"""SQL that a single-node engine can run for those operators whose results SQL can express."""

from __future__ import annotations

import string

from dataveil.llm import mixing

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

NEAR_DUP = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN [w] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) END AS s
  FROM docs WHERE len(w) > 0
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared WHERE 100 * c >= 80 * (n + m - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_id AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM docs d LEFT JOIN sets s USING (doc_id) JOIN least_id l ON l.a = d.doc_id
"""

VECTORS = """
WITH RECURSIVE able AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), least_id AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least_id l ON l.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

WINNOWING = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), items AS (
  SELECT item_id, w FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark) WHERE len(w) > 0
), held AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(0, greatest(len(w) - 9, 1)), lambda j: w[j + 1:j + 10])) AS win FROM items
), sizes AS (
  SELECT DISTINCT len(win) AS size FROM held
), places AS (
  SELECT doc_id, size, unnest(range(0, greatest(len(w) - size + 1, 0))) AS j, w FROM docs, sizes
), hits AS (
  SELECT p.doc_id, p.j, p.size, h.item_id FROM places p JOIN held h ON p.w[p.j + 1:p.j + p.size] = h.win
), words_hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + size)) AS k FROM hits) GROUP BY 1
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words_hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

MIXING = f"""
WITH quality AS (
  SELECT doc_id, {mixing.LOW} + {mixing.HIGH - mixing.LOW} * least(greatest(avg(quality), 0), 1) AS weight
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1
), keyed AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('{mixing.SEED}' || coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS tie, coalesce(q.weight, {mixing.UNKNOWN}) AS weight
  FROM documents d LEFT JOIN quality q ON q.doc_id = d.doc_id
), drawn AS (
  SELECT *, -ln((('0x' || substr(tie, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight AS e FROM keyed
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM drawn GROUP BY source
), leveled AS (
  SELECT *, row_number() OVER o AS place, 2 * source_size / w AS ratio,
    ({mixing.SHARE}::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER before_this, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER before_this, 0)) AS level
  FROM sources
  WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST), before_this AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, CASE WHEN level >= ratio THEN (2 * source_size)::DOUBLE
    ELSE w * arg_min(level, place) FILTER (WHERE level < ratio) OVER () END AS target
  FROM leveled
), epochs AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS full_times FROM goals
), placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.full_times,
    CASE WHEN full_times < 2 THEN g.target - full_times * g.source_size ELSE 0 END AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY e, tie RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, e, tie) AS peers
  FROM drawn d JOIN epochs g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (size * (full_times + CASE WHEN rest > 0 AND 2 * upto - peers <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

# ---- checksums --------------------------------------------------------------------------------

# The table of the checksum's polynomial by its rule, and the checksum of a text's UTF-8 bytes.
_CRC_TABLE = """crc AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
)"""


def _crc(text: str) -> str:
    """Unsigned CRC-32 of a SQL text, beside the table ``crc``."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: {byte})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INT])), 4294967295)"


SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]{{7,}}')) AS run FROM documents) GROUP BY 1, 2
), summed AS (
  SELECT run, n, {_crc("(id || ':' || run)")} AS h FROM runs, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM summed GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7
), lacking AS (
  SELECT word, n, substr(word, 1, i::INT) AS head, substr(word, i::INT + 2) AS tail FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM lacking a JOIN lacking b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM lacking a JOIN words w ON w.word = a.head || a.tail
  UNION SELECT w.word, a.word, a.n FROM lacking a JOIN words w ON w.word = a.head || a.tail
), best AS (
  SELECT word, count(*) AS n_near, min({{'less': -m, 'other': other}}) AS top FROM near GROUP BY 1
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 10 * w.n THEN top.other END AS form,
    CASE WHEN -top.less >= 10 * w.n THEN -top.less END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), ways AS (
  SELECT word, form AS goal, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT w.word, f.form, w.step + 1 FROM ways w JOIN forms f ON f.word = w.goal WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(goal, step) AS root FROM ways GROUP BY 1
)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN ends e ON e.word = f.word
"""


def _plus(best: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state's best repair (c, a, l) with one more edit."""
    lines = f"{best}.l || chr(10) || {line}" if line else f"{best}.l"
    return f"CASE WHEN {best} IS NOT NULL THEN {{'c': {best}.c + {cost}, 'a': {best}.a || '{letter}', 'l': {lines}}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _edited() -> str:
    """The four states after a row, from those before it with turns made in between."""
    stays = "(fault = 'truncated')::INT"
    kept = lambda best, role: f"CASE WHEN able AND initial = '{role}' THEN {_plus(best, stays, 'K', 'line')} END"
    named = lambda best, role: f"CASE WHEN able THEN {_plus(best, f'2 + {stays}', 'R', f"('{role}:' || text)")} END"
    after = {
        "b0": [_plus("b0", "3", "D")], "b1": [_plus("b1", "3", "D"), kept("b0", "s")],
        "b2": [_plus("m2", "3", "D"), *[kept(b, "u") for b in ("b0", "b1", "m3")], *[named(b, "user") for b in ("b0", "b1", "m3")]],
        "b3": [_plus("m3", "3", "D"), kept("m2", "a"), named("m2", "assistant")],
    }
    return ", ".join(f"{_least(*ways)} AS {state}" for state, ways in after.items())


_MADE = f"{_least('b2', *[_plus(b, '2', 'I', repr('user:')) for b in ('b0', 'b1', 'b3')])} AS m2"
_MADE_3 = f"{_least('b3', _plus('m2', '2', 'I', repr('assistant:')))} AS m3"

CONVERSATIONS = f"""
WITH RECURSIVE {_CRC_TABLE}, dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS r FROM conversations, crc
), broken AS (
  SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role,
    CASE r WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE r WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt
), told AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail, left(role, 1) AS initial, role || ':' || text AS line,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS rn FROM broken
), faults AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
      WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial AS pair FROM told
), rows_ AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS able FROM faults
), ids AS (SELECT DISTINCT conv_id FROM conversations
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'l': ''}} AS b0, NULL::STRUCT(c INTEGER, a VARCHAR, l VARCHAR) AS b1,
    NULL::STRUCT(c INTEGER, a VARCHAR, l VARCHAR) AS b2, NULL::STRUCT(c INTEGER, a VARCHAR, l VARCHAR) AS b3 FROM ids
  UNION ALL
  SELECT conv_id, rn, {_edited()}
  FROM (SELECT *, {_MADE_3} FROM (
    SELECT w.conv_id, r.rn, w.b0, w.b1, w.b2, w.b3, r.initial, r.text, r.line, r.fault, r.able, {_MADE}
    FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.rn = w.i + 1))
), ended AS (
  SELECT conv_id, {_least('b0', 'm3')} AS best FROM (SELECT *, {_MADE_3} FROM (
    SELECT conv_id, b0, b3, {_MADE} FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv_id)))
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY 1
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(substr(best.l, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLES = {
    "op5_minhash_near_dedup": NEAR_DUP,
    "op7_weighted_mixing": MIXING,
    "op8_kmeans_vector_dedup": VECTORS,
    "op9_winnowing_decontamination": WINNOWING,
    "op12_fm_index_spelling": SPELLING,
    "op13_auction_conversation_repair": CONVERSATIONS,
}
