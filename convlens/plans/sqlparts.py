"""DuckDB SQL fragments shared by the oracle queries.

They restate, in plain SQL over the driver tables, what the Spark operators
compute; the driver runs them side by side with the Spark plans.
"""

# conversations -> labelled raw turns -> parts split on '|' -> speaker + text
TURNS_CTE = r"""
t AS (
  SELECT conv_id AS id, turn,
         (CASE role WHEN 'user' THEN 'Interviewer: ' WHEN 'assistant' THEN 'Interviewee: ' ELSE '' END)
           || coalesce(text, '') AS raw
  FROM conversations
),
p AS (
  SELECT id, turn,
         unnest(range(len(string_split(raw, '|')))) AS sub,
         unnest(string_split(raw, '|')) AS part
  FROM t
),
lp AS (
  SELECT id, turn, sub, part,
         CASE WHEN starts_with(regexp_replace(part, '^\s+|\s+$', '', 'g'), 'Interviewer:') THEN 'interviewer'
              WHEN starts_with(regexp_replace(part, '^\s+|\s+$', '', 'g'), 'Interviewee:') THEN 'interviewee'
         END AS speaker
  FROM p
),
lt AS (
  SELECT id, turn, sub, part, speaker,
         CASE speaker
           WHEN 'interviewer' THEN regexp_replace(replace(part, 'Interviewer:', ''), '^\s+|\s+$', '', 'g')
           WHEN 'interviewee' THEN regexp_replace(replace(part, 'Interviewee:', ''), '^\s+|\s+$', '', 'g')
         END AS text
  FROM lp
),
st AS (
  SELECT id,
         coalesce(string_agg(text, ' ' ORDER BY turn, sub) FILTER (WHERE speaker = 'interviewer'), '') AS interviewer_text,
         coalesce(string_agg(text, ' ' ORDER BY turn, sub) FILTER (WHERE speaker = 'interviewee'), '') AS interviewee_text
  FROM lt GROUP BY id
)
"""


def wc(expr: str) -> str:
    """Whitespace word count."""
    return f"len(list_filter(regexp_split_to_array({expr}, '\\s+'), lambda w: w <> ''))"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def ascii_word_view(expr: str) -> str:
    """Map non-ASCII letters to 'a' so RE2's ASCII ``\\b`` sees the same
    boundaries as Java's Unicode-aware one (oracle-side only)."""
    return f"regexp_replace({expr}, '[^\\P{{L}}\\x00-\\x7F]', 'a', 'g')"


def rcount(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, '{pattern}'))"


# individual table of the driver binding: per conversation lengths, ratio,
# cosine of the speakers' term counts and cluster = conv_id mod 5
INDIVIDUAL_BODY = r"""
lens AS (
  SELECT id, length(interviewer_text) AS interviewer_length, length(interviewee_text) AS interviewee_length
  FROM st
),
tok AS (
  SELECT id, speaker, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term
  FROM lt WHERE speaker IS NOT NULL
),
tc AS (SELECT id, speaker, term, count(*)::DOUBLE AS n FROM tok GROUP BY ALL),
dotp AS (
  SELECT a.id, sum(a.n * b.n) AS dot FROM tc a JOIN tc b ON a.id = b.id AND a.term = b.term
  WHERE a.speaker = 'interviewer' AND b.speaker = 'interviewee' GROUP BY a.id
),
nrm AS (
  SELECT id, sqrt(sum(n * n) FILTER (WHERE speaker = 'interviewer')) AS na,
             sqrt(sum(n * n) FILTER (WHERE speaker = 'interviewee')) AS nb
  FROM tc GROUP BY id
),
ind AS (
  SELECT l.id, l.interviewer_length, l.interviewee_length,
         CASE WHEN l.interviewer_length = 0 THEN NULL
              ELSE l.interviewee_length::DOUBLE / l.interviewer_length END AS ratio,
         CASE WHEN coalesce(n.na, 0) = 0 OR coalesce(n.nb, 0) = 0 THEN 0.0
              ELSE coalesce(d.dot, 0) / (n.na * n.nb) END AS similarity,
         (l.id % 5)::INTEGER AS cluster
  FROM lens l LEFT JOIN dotp d ON l.id = d.id LEFT JOIN nrm n ON l.id = n.id
)
"""
INDIVIDUAL_CTE = TURNS_CTE + "," + INDIVIDUAL_BODY
