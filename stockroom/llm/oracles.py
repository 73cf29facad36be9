"""DuckDB SQL for the text queries that SQL can express, written from their definitions.

Language ID, packing, token counts after edits, SentencePiece ids, and secrets with checksums are beyond
SQL; their tests compare them with brute force, the libraries, or held-out labels.
"""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

CHATS = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
               FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM turns),
grown AS (SELECT *, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS beginning,
                 count(*) OVER (PARTITION BY conv_id) AS n FROM numbered),
whole AS (SELECT n, beginning, min(conv_id) AS conv_id, count(*) AS n_copies FROM grown WHERE pos = n GROUP BY n, beginning),
kept AS (SELECT * FROM whole WHERE NOT EXISTS (
  SELECT 1 FROM grown g WHERE g.pos = whole.n AND g.beginning = whole.beginning AND g.n > g.pos))
SELECT conv_id, CAST((pos - 1) // 256 AS INTEGER) AS segment, any_value(kept.n) AS n_turns, any_value(n_copies) AS n_copies,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |')
                  || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM kept JOIN numbered USING (conv_id) GROUP BY conv_id, (pos - 1) // 256
"""

NEIGHBOURS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS size FROM v),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
                 list_reduce(list_transform(list_zip(c.e, q.e), lambda z: z[1] * z[2]), lambda a, b: a + b)
                   / (q.size * c.size) AS score
          FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
          WHERE q.size > 0 AND c.size > 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
           FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

PRODUCTS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(c.x, q.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
           FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def _edit(cost: str, state: str, letter: str) -> str:
    """A state, 9 digits of cost and then the audit, after one more edit; NULL stays NULL."""
    return f"(lpad(CAST(CAST(substr({state}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}')"


def _turn(target: str, sources: list[str]) -> str:
    """The best way for a row to become ``target`` after one of the states ``sources``: kept or given the role."""
    best = sources[0] if len(sources) == 1 else f"least({', '.join(sources)})"
    return f"CASE WHEN NOT must_go THEN CASE WHEN initial = '{target}' THEN {_edit('extra', best, 'K')} ELSE {_edit('2 + extra', best, 'R')} END END"


# The checksum is taken bit by bit; the repair goes row by row from the left with the best way into each of four
# states: none (no turn yet), s, u, a (the last turn's role).
REPAIRS = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(name)),
    lambda j: CAST((ascii(substr(name, CAST(j // 8 + 1 AS INTEGER), 1)) >> CAST(j % 8 AS INTEGER)) & 1 AS BIGINT))),
    lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) % 20 AS fault FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE fault <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), md5(text)) AS i,
    substr(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), -1) AS final FROM damaged),
classed AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN final = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS kind FROM ordered),
facts AS (SELECT *, kind IS NOT DISTINCT FROM 'blank' OR kind IS NOT DISTINCT FROM 'duplicate' AS must_go,
    CASE WHEN kind = 'truncated' THEN 1 ELSE 0 END AS extra,
    CAST(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS INTEGER) AS bad FROM classed),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
    count(*) FILTER (kind = 'truncated') AS truncated, CAST(coalesce(sum(bad), 0) AS BIGINT) AS illegal FROM facts GROUP BY conv_id),
walk AS (
  SELECT conv_id, n, CAST(1 AS BIGINT) AS i, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u,
         CAST(NULL AS VARCHAR) AS a FROM counts
  UNION ALL
  SELECT conv_id, n, i + 1, {_edit('3', 'z', 'D')}, least({_edit('3', 's', 'D')}, CASE WHEN NOT must_go AND initial = 's' THEN {_edit('extra', 'z', 'K')} END),
         least({_edit('3', 'u', 'D')}, {_turn('u', ['z', 's', 'a'])}), least({_edit('3', 'a', 'D')}, {_turn('a', ['u'])})
  FROM (SELECT w.conv_id, w.n, w.i, z, s, u, least(a, {_edit('2', 'u', 'I')}) AS a, f.must_go, f.extra, f.initial
        FROM (SELECT conv_id, n, i, z, s, least(u, {_edit('2', 'least(z, s, a)', 'I')}) AS u, a FROM walk WHERE i <= n) w
        JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i)),
ends AS (SELECT conv_id, least(z, a, {_edit('2', 'u', 'I')}, {_edit('4', 'least(z, s)', 'II')}) AS best FROM walk WHERE i = n + 1),
kept AS (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ends),
letters AS (SELECT conv_id, length(replace(audit, 'D', '')) % 2 AS system, unnest(range(1, length(audit) + 1)) AS j, audit FROM kept),
placed AS (SELECT conv_id, j, substr(audit, j, 1) AS edit, system,
    length(replace(substr(audit, 1, j - 1), 'D', '')) AS place, length(replace(substr(audit, 1, j), 'I', '')) AS i FROM letters),
texts AS (SELECT p.conv_id, string_agg(CASE WHEN edit = 'K' THEN f.role WHEN (place - system) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY j) AS repaired
  FROM placed p LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND edit <> 'I'
  WHERE edit <> 'D' GROUP BY p.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN kept k ON k.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _sketch(text: str) -> str:
    """Hashes of a text's 5-word runs below an eighth of their range, or else the least."""
    hashes = (f"[substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 12) FOR i IN "
              f"range(1, greatest(len(w) - 4, 1) + 1) IF len(w) > 0]")
    return (f"(SELECT list_sort(CASE WHEN len(low) > 0 THEN low WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END) FROM ("
            f"SELECT h, list_distinct([x FOR x IN h IF x < '200000000000']) AS low FROM ("
            f"SELECT {hashes} AS h FROM (SELECT {_WORDS.format(_LOWER.format(text))} AS w))))")


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC, text DESC),
                         first_value(text) OVER (ORDER BY doc_id DESC, text DESC)) AS after FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2) AS edited FROM n),
s AS (SELECT *, {_sketch('e.text')} AS a, {_sketch('e.edited')} AS b, {_sketch('e.after')} AS c FROM e)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
       coalesce(array_to_string(a, ','), '') AS fingerprint, coalesce(array_to_string(b, ','), '') AS edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(a, b)) AS DOUBLE)
            / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(a, c)) AS DOUBLE)
            / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next,
       CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(a) END AS held_by_edited
FROM s
"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (s) WHERE doc_id > least),
removed AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN covered USING (doc_id, i)
         GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

COMPONENTS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
           FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
          WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""
