"""DuckDB SQL of the registered queries, where SQL can express them over whole tables."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP1 = rf"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
cuts AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS beg
  FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[beg:beg + n - 1], ' ') AS win FROM cuts),
lens AS (SELECT DISTINCT n FROM wins),
docs AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS beg FROM docs, lens),
hits AS (
  SELECT s.doc_id, s.beg, s.n, b.item
  FROM (SELECT doc_id, beg, n, array_to_string(w[beg:beg + n - 1], ' ') AS win FROM spots) s JOIN wins b ON b.win = s.win AND b.n = s.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(beg, beg + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words h USING (doc_id) LEFT JOIN named i USING (doc_id)"""


def _clashes(value: str, codes: str, plains: list[str]) -> str:
    """A rendered value would not parse back: it holds an escape or a control string."""
    held = [f"contains({value}, '\\{c}')" for c in codes] + [f"contains({value}, '{p}')" for p in plains]
    return " OR ".join(held)


def _escaped(value: str, pairs: list[tuple[str, str]]) -> str:
    out = f"replace({value}, '\\', '\\\\')"
    for plain, coded in pairs:
        out = f"replace({out}, '{plain}', '{coded}')"
    return out


OP6 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
shown AS (
  SELECT *,
    CASE WHEN {_clashes('role', '\\ehc', ['</turn>', '### ', ':'])}
         THEN {_escaped('role', [('</turn>', '\\e'), ('### ', '\\h'), (':', '\\c')])} ELSE role END AS r,
    CASE WHEN {_clashes('text', '\\eh', ['</turn>', '### '])}
         THEN {_escaped('text', [('</turn>', '\\e'), ('### ', '\\h')])} ELSE text END AS t
  FROM rows),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(length('### ' || r || ': ' || t || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
  FROM shown GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM joined"""


def _near(n: int) -> str:
    """The nearest entry of every part under codebook n, ties to the lower index."""
    gap = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v, c)])"
    return f"""near{n} AS (SELECT row_id, p, any_value(v) AS v, arg_min(e, gap * 64 + e) AS e, min(gap) AS gap
  FROM (SELECT row_id, p, v, e, {gap} AS gap FROM parts JOIN book{n} USING (p)) GROUP BY ALL)"""


def _refined(n: int) -> str:
    """Codebook n + 1: floored means of the parts, unused entries as they were."""
    return f"""cells{n} AS (SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x
  FROM near{n}, (SELECT unnest(range(1, 5)) AS i) GROUP BY p, e, i),
book{n + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{n} b
  LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS c FROM cells{n} GROUP BY p, e) m USING (p, e))"""


# 64 components: 16 parts of 4
OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, label, [CAST(floor(256 * x) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE len(embedding) > 0 AND list_bool_and([coalesce(isfinite(x), false) for x in embedding])),
parts AS MATERIALIZED (SELECT row_id, p, v[4 * p + 1:4 * p + 4] AS v FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, e, k.v[4 * p + 1:4 * p + 4] AS c
  FROM (SELECT v, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < 64) k,
    (SELECT unnest(range(16)) AS p)),
{_near(0)}, {_refined(0)}, {_near(1)}, {_refined(1)}, {_near(2)},
coded AS (SELECT row_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(gap) AS BIGINT) AS error
  FROM near2 GROUP BY row_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY p, e) FROM book2)) AS codebooks_sha256
FROM coded JOIN kept USING (row_id)"""


OP13 = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
  FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces"""
