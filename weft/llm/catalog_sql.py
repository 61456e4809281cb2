"""DuckDB SQL of the operators that SQL can express: fill-in-the-middle, and the repair of conversations as a forward DP."""

from __future__ import annotations

FILL_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cuts AS (
  SELECT doc_id, text, n,
    least(('0x' || h[1:8])::BIGINT % (n + 1), ('0x' || h[9:16])::BIGINT % (n + 1)) AS a,
    greatest(('0x' || h[1:8])::BIGINT % (n + 1), ('0x' || h[9:16])::BIGINT % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM texts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cuts
"""


def _more(state: str, cost: int | str, letter: str) -> str:
    """A state's best so far, six digits of cost and then the audit, with one more edit. Without an edit that leads there it is null."""
    return f"lpad(CAST(CAST({state}[1:6] AS INT) + {cost} AS VARCHAR), 6, '0') || {state}[7:] || '{letter}'"


def _least(*found: str) -> str:
    return f"least({', '.join(found)})"


def _conversations_sql() -> str:
    rerole = "2 + cut"
    keep = lambda state, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_more(state, 'cut', 'K')} END"
    swap = lambda state: f"CASE WHEN NOT gone THEN {_more(state, rerole, 'R')} END"
    to_user = [x for q in ("i0", "i1", "i3") for x in (keep(q, "u"), swap(q))]
    return f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hashed AS (
  SELECT *, xor(4294967295, list_reduce(
    flatten(list_transform(range(1, length(key) + 1), lambda i: list_transform(range(0, 8), lambda j: (ascii(key[i]) >> j) & 1))),
    lambda c, bit: xor(c >> 1, xor(c & 1, bit) * 3988292384), 4294967295)) % 20 AS fault
  FROM source
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended FROM damaged
), judged AS (
  SELECT *, ended = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, ended[-1:] NOT IN ('.', '!', '?') AS open_,
    role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), layers AS (
  SELECT conv_id, i, role, text, initial, blank OR again AS gone, CASE WHEN open_ THEN 1 ELSE 0 END AS cut, max(i) OVER (PARTITION BY conv_id) AS n FROM judged
), dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, n, '000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM layers
  UNION ALL
  SELECT conv_id, i, n,
    {_more('i0', 3, 'D')} AS s0,
    {_least(_more('i1', 3, 'D'), keep('i0', 's'))} AS s1,
    {_least(_more('i2', 3, 'D'), *to_user)} AS s2,
    {_least(_more('i3', 3, 'D'), keep('i2', 'a'), swap('i2'))} AS s3
  FROM (
    SELECT *, {_least('s3', _more('i2', 2, 'I'))} AS i3 FROM (
      SELECT l.conv_id, l.i, l.n, l.initial, l.gone, l.cut, s0 AS i0, s1 AS i1, s3, {_least('s2', _more('s0', 2, 'I'), _more('s1', 2, 'I'), _more('s3', 2, 'I'))} AS i2
      FROM dp JOIN layers l ON l.conv_id IS NOT DISTINCT FROM dp.conv_id AND l.i = dp.i + 1
    )
  )
), best AS (
  SELECT conv_id, {_least('s0', 's3', _more('s2', 2, 'I'), _more(f"({_more('s1', 2, 'I')})", 2, 'I'))} AS found FROM dp WHERE i = n
), letters AS (
  SELECT conv_id, found, unnest(range(1, length(found) - 5)) AS j FROM best
), edits AS (
  SELECT conv_id, j, found[6 + j] AS letter, count(CASE WHEN found[6 + j] <> 'I' THEN 1 END) OVER w AS i, count(CASE WHEN found[6 + j] <> 'D' THEN 1 END) OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), made AS (
  SELECT e.conv_id, j, letter, place, l.role, CASE WHEN letter = 'I' THEN '' ELSE l.text END AS text, max(CASE WHEN place = 1 AND letter = 'K' AND l.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN layers l ON l.conv_id IS NOT DISTINCT FROM e.conv_id AND l.i = e.i WHERE letter <> 'D'
), texts AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place)) AS repaired FROM made GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE WHEN blank THEN 1 END) AS blank, count(CASE WHEN again AND NOT blank THEN 1 END) AS duplicate,
    count(CASE WHEN open_ AND NOT blank AND NOT again THEN 1 END) AS truncated, count(CASE WHEN i > 1 AND before || initial NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(found[1:6] AS INT), 0) AS BIGINT) AS cost,
  coalesce(found[7:], '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


CONVERSATIONS_SQL = _conversations_sql()
