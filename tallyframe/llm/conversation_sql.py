"""The queries over conversations as DuckDB SQL: the trie by grouping prefixes, the repair by a recursion from the last row to the first."""

from __future__ import annotations

#: The table of the checksum: what it makes of each byte.
_CRC = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """SQL of the unsigned crc32 of an ASCII text, given the table t."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) for x in string_split({text}, '')]), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


TRIE = f"""WITH {_CRC}, o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
  ids AS (SELECT conv_id, conv_id - conv_id % 100 AS head, {_crc('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), crc_table),
  joined AS (SELECT i.conv_id, 0 AS part, o.pos, o.role, o.text FROM ids i JOIN o ON o.conv_id = i.head AND o.pos <= i.h UNION ALL SELECT i.conv_id, 1, o.pos, o.role, o.text FROM ids i JOIN o ON o.conv_id = i.conv_id AND o.pos > i.h),
  turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, md5(concat(length(role), ':', role, text)) AS turn, length(text) AS chars FROM joined),
  paths AS (SELECT conv_id, d, chars, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM turns UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
  walked AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS above, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM paths),
  nodes AS (SELECT key, any_value(d) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(chars) AS saves, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM walked GROUP BY key),
  kids AS (SELECT above AS key, count(*) AS kids FROM nodes WHERE above IS NOT NULL GROUP BY 1),
  below AS (SELECT w.key, sum(n.saves) AS saved, count(*) FILTER (k.kids IS NULL) AS leaves FROM nodes n LEFT JOIN kids k ON k.key = n.key JOIN walked w ON w.conv_id = n.conv_id AND w.d <= n.depth GROUP BY 1)
  SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.kids, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256 FROM nodes n LEFT JOIN nodes p ON p.key = n.above LEFT JOIN kids k ON k.key = n.key JOIN below b ON b.key = n.key"""


def _least(*ways: str) -> str:
    """SQL of the cheapest of structs (cost, letters), ties ASCII-least."""
    return f"list_sort([x for x in [{', '.join(ways)}] if x IS NOT NULL])[1]"


def _way(letter: str, cost: str, to: str, on: str = "true") -> str:
    return f"CASE WHEN {on} THEN {{'c': {to}.c + {cost}, 's': concat('{letter}', {to}.s)}} END"


_UNDELETED = "fault NOT IN ('blank', 'duplicate')"
_MORE = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
_TO_USER = (_way("K", _MORE, "a2", f"{_UNDELETED} AND role[1] = 'u'"), _way("R", f"3 + {_MORE}", "a2", _UNDELETED))
_TO_ASSISTANT = (_way("K", _MORE, "a3", f"{_UNDELETED} AND role[1] = 'a'"), _way("R", f"3 + {_MORE}", "a3", _UNDELETED))
_TO_SYSTEM = (_way("K", _MORE, "a1", f"{_UNDELETED} AND role[1] = 's'"),)
_FAR = "{'c': CAST(1000000000 AS BIGINT), 's': ''}"
_DONE = "{'c': CAST(0 AS BIGINT), 's': ''}"
#: The cheapest edits from the back: for each row and state of the pattern (0 nothing, 1 system, 2 user, 3 assistant before it) the least cost and letters to the end.
REPAIR = f"""WITH RECURSIVE {_CRC}, x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations, crc_table),
  y AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE kind <> 0),
  z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM y),
  f AS (SELECT conv_id, turn, role, text, i, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    concat(left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1), left(role, 1)) AS step FROM z),
  st AS (SELECT conv_id, max(i) AS i, {_DONE} AS a0, {{'c': CAST(6 AS BIGINT), 's': 'II'}} AS a1, {{'c': CAST(3 AS BIGINT), 's': 'I'}} AS a2, {_DONE} AS a3 FROM f GROUP BY conv_id
   UNION ALL SELECT conv_id, i - 1, {_least('b0', _way('I', '3', 'b2'))}, {_least('b1', _way('I', '3', 'b2'))}, b2, {_least('b3', _way('I', '3', 'b2'))}
    FROM (SELECT conv_id, i, b0, b1, {_least('b2', _way('I', '3', 'b3'))} AS b2, b3
      FROM (SELECT st.conv_id, st.i, {_least(_way('D', '4', 'a0'), *_TO_USER, *_TO_SYSTEM)} AS b0, {_least(_way('D', '4', 'a1'), *_TO_USER)} AS b1, {_least(_way('D', '4', 'a2'), *_TO_ASSISTANT)} AS b2, {_least(_way('D', '4', 'a3'), *_TO_USER)} AS b3
        FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i))),
  best AS (SELECT conv_id, a0.c AS cost, a0.s AS audit FROM st WHERE i = 0),
  letters AS (SELECT * FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS p FROM best) WHERE letter <> ''),
  placed AS (SELECT *, sum(CAST(letter <> 'I' AS INT)) OVER o AS i, sum(CAST(letter <> 'D' AS INT)) OVER o - 1 - sum(CAST(letter <> 'D' AS INT)) OVER (PARTITION BY conv_id) % 2 AS place FROM letters WINDOW o AS (PARTITION BY conv_id ORDER BY p)),
  pieces AS (SELECT l.conv_id, l.p, concat(CASE WHEN letter = 'K' THEN f.role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN letter <> 'I' THEN f.text ELSE '' END) AS piece FROM placed l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE letter <> 'D'),
  joined AS (SELECT conv_id, string_agg(piece, chr(10) ORDER BY p) AS whole FROM pieces GROUP BY 1),
  counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND step NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
  SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM c.conv_id"""
