"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .licenses import license_sql

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')) AS chars,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
      ELSE 1 + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ': ', ':\ ')) END AS label
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
    sum(4 + label + 2 + chars + 8)::BIGINT AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY k) AS roles
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(roles, 's?(ua)+') AS valid,
  CASE WHEN regexp_full_match(roles, 's?(ua)+') THEN 'answered' WHEN regexp_full_match(roles, 's?(ua)*u') THEN 'asked'
    WHEN roles = 's' THEN 'briefed' ELSE 'error' END AS end_state
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": _CHAT, "op4_license_scans": license_sql()}
