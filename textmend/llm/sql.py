"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import repetition

WORD = r"[^\x20\x09-\x0D]+"


def _covered(n: int) -> str:
    return f"""g{n} AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i+{n - 1}], ' ')) AS c
  FROM w, unnest(range(1, len(ws) - {n - 2})) AS t(i)),
c{n} AS (SELECT DISTINCT doc_id, i + j AS i FROM g{n}, range({n}) AS r(j) WHERE c >= 2),
s{n} AS (SELECT c.doc_id, count(*) AS k, sum(length(w.ws[c.i])) AS chars FROM c{n} c JOIN w ON w.doc_id = c.doc_id GROUP BY c.doc_id)"""


def _repetition() -> str:
    sizes = sorted({repetition.BASE_N, *repetition.NGRAMS})
    joins = "".join(f" LEFT JOIN s{n} ON s{n}.doc_id = w.doc_id" for n in sizes)
    dup = {n: f"coalesce(s{n}.chars, 0)" for n in repetition.NGRAMS}
    failed = f"(len(w.ws) < {repetition.MIN_WORDS} OR 100 * coalesce(s{repetition.BASE_N}.k, 0) > {repetition.BASE_PERCENT} * len(w.ws))"
    rules = [f"100 * coalesce(d.chars, 0) <= {repetition.LINE_PERCENT} * b.word_chars"] + [f"100 * {dup[n]} <= {most} * b.word_chars" for n, most in repetition.NGRAMS.items()]
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
b AS (SELECT doc_id, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM w)
  WHERE regexp_matches(line, '{WORD}')),
d AS (SELECT doc_id, count(*) AS k, sum(list_sum(list_transform(regexp_extract_all(line, '{WORD}'), lambda x: length(x)))) AS chars FROM l WHERE n > 1 GROUP BY doc_id),
{", ".join(_covered(n) for n in sizes)}
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, b.word_chars, b.n_symbols::BIGINT AS n_symbols, coalesce(d.k, 0)::BIGINT AS n_dup_lines,
  coalesce(s{repetition.BASE_N}.k, 0)::BIGINT AS n_repeat_words, {failed} AS base_failed,
  (NOT {failed} AND {" AND ".join(rules)}) AS kept, coalesce(d.chars, 0)::BIGINT AS dup_line_chars,
  {", ".join(f"{x}::BIGINT AS dup_chars_{n}" for n, x in dup.items())}
FROM w JOIN b ON b.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id{joins}"""


SQL: dict[str, str] = {"op5_repetition": _repetition()}
