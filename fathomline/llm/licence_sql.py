"""DuckDB SQL for the licence query: every unit of every document against every template, without the bound on the cosine."""

from __future__ import annotations

from fathomline.llm.licences import GAP, TAG, TERM, statements


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licence_sql() -> str:
    rows = ",\n".join(f"({k}, {_literal(name)}, {_literal(said)})" for k, (name, said) in enumerate(statements()))

    def terms(text: str) -> str:
        return f"regexp_extract_all(regexp_replace(lower({text}), '{TAG}', 'spdx:', 'g'), '{TERM}')"

    return rf"""
WITH known(template, licence, statement) AS (VALUES {rows}),
total AS (SELECT count(*) AS files FROM documents),
held AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({terms("text")})) AS term FROM documents) GROUP BY term),
word AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest({terms("statement")}) AS term FROM known) GROUP BY ALL),
goal AS (SELECT template, licence, term, tf * (ln((files + 1) / (coalesce(n, 0) + 1)) + 1) AS w FROM word LEFT JOIN held USING (term), total),
lengths AS (SELECT template, sqrt(sum(w * w)) AS length FROM goal GROUP BY template),
texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT text, unnest(regexp_split_to_array(text, '{GAP}')) AS said FROM texts),
sentences AS (
  SELECT text, unnest(string_split(regexp_replace(regexp_replace(said, '\n[^\p{{L}}\p{{N}}\n]*', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS said FROM blocks),
units AS (
  SELECT text, text AS said FROM texts UNION SELECT text, said FROM blocks UNION SELECT text, said FROM sentences
  UNION SELECT text, unnest(string_split(said, chr(10))) FROM blocks
  UNION SELECT text, unnest(regexp_extract_all(text, '(?i){TAG}[a-z0-9]+(?:[.+-]+[a-z0-9]+)*\+?')) FROM texts),
vector AS (
  SELECT said, term, tf * (ln((files + 1) / (coalesce(n, 0) + 1)) + 1) AS v
  FROM (SELECT said, term, count(*) AS tf FROM (SELECT said, unnest({terms("said")}) AS term FROM (SELECT DISTINCT said FROM units)) GROUP BY ALL)
  LEFT JOIN (SELECT term, n FROM held) USING (term), total),
own AS (SELECT said, sqrt(sum(v * v)) AS length FROM vector GROUP BY said),
score AS (
  SELECT said, licence, round(sum(v * w) / (any_value(own.length) * any_value(lengths.length)), 6) AS score
  FROM vector JOIN goal USING (term) JOIN own USING (said) JOIN lengths USING (template) GROUP BY said, template, licence),
best AS (
  SELECT text, min(struct_pack(s := -score, licence := licence)) AS b
  FROM units JOIN score USING (said) WHERE score >= 0.6 GROUP BY text),
files AS (
  SELECT doc_id, doc_id % 5 = 0 AS named, text,
    coalesce(source, 'none') || '/p' || (doc_id // 500) || CASE WHEN doc_id % 10 <> 0 THEN '/m' || (doc_id // 50 % 10) ELSE '' END
      || CASE WHEN doc_id % 5 = 0 THEN '/LICENSE.' ELSE '/text.' END || doc_id AS path FROM documents),
judged AS (
  SELECT doc_id, named, path, regexp_replace(path, '/?[^/]*$', '') AS dir, b.licence AS own_licence, -b.s AS own_score
  FROM files LEFT JOIN best USING (text)),
lent AS (
  SELECT dir AS up, min(struct_pack(s := -own_score, path := path, licence := own_licence)).licence AS given
  FROM judged WHERE named AND own_licence IS NOT NULL GROUP BY dir),
nearest AS (
  SELECT dir, arg_max(up, length(up)) AS up, arg_max(given, length(up)) AS given
  FROM (SELECT DISTINCT dir FROM judged) JOIN lent ON dir = up OR up = '' OR starts_with(dir, up || '/') GROUP BY dir)
SELECT doc_id, path, own_licence, own_score, coalesce(own_licence, given) AS licence, CASE WHEN own_licence IS NULL THEN up END AS licence_dir
FROM judged LEFT JOIN nearest USING (dir)
"""
