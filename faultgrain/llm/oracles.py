"""SQL of the word and manifest queries, kept apart from ``queries`` for its length."""

from __future__ import annotations

from faultgrain.llm import spellings

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8, bit by bit."""
    code = f"hex(encode({text}))"
    octets = f"list_transform(range(0, length({code}) // 2), lambda i: CAST('0x' || substr({code}, 2 * i + 1, 2) AS BIGINT))"
    octet = "list_reduce(range(0, 8), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)), xor(c, b))"
    return f"xor(list_reduce({octets}, lambda c, b: {octet}, CAST(4294967295 AS BIGINT)), 4294967295)"


def spelling_sql(delete_every: int) -> str:
    return f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
hashed AS (SELECT w, {_crc32("concat(doc_id, ':', w)")} AS h FROM runs WHERE length(w) >= {spellings.LEAST_LENGTH}),
typed AS (SELECT CASE WHEN h % {delete_every} = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS w FROM hashed),
counted AS (SELECT w, count(*) AS n FROM typed WHERE length(w) >= {spellings.LEAST_LENGTH} GROUP BY w HAVING count(*) >= {spellings.LEAST_COUNT}),
places AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS p FROM counted),
gaps AS (SELECT w, n, p, length(w) AS size, concat(substr(w, 1, p - 1), substr(w, p + 1)) AS rest FROM places),
pairs AS (SELECT a.w, b.w AS near, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.p = b.p AND a.w <> b.w AND a.size = b.size
  UNION SELECT g.w, c.w, c.n FROM gaps g JOIN counted c ON g.rest = c.w
  UNION SELECT c.w, g.w, g.n FROM gaps g JOIN counted c ON g.rest = c.w),
best AS (SELECT w, count(*) AS n_near, max(n) AS near_n FROM pairs GROUP BY w),
named AS (SELECT p.w, min(p.near) AS near FROM pairs p JOIN best b ON p.w = b.w AND p.n = b.near_n GROUP BY p.w),
judged AS (SELECT c.w, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spellings.RATIO} * c.n THEN near END AS form,
  CASE WHEN near_n >= {spellings.RATIO} * c.n THEN near_n END AS form_n
  FROM counted c LEFT JOIN best b ON c.w = b.w LEFT JOIN named d ON c.w = d.w),
way AS (SELECT w, form AS root, 1 AS steps FROM judged WHERE form IS NOT NULL
  UNION ALL SELECT y.w, j.form, steps + 1 FROM way y JOIN judged j ON j.w = y.root WHERE j.form IS NOT NULL),
roots AS (SELECT w, arg_max(root, steps) AS root FROM way GROUP BY w)
SELECT j.w AS word, form, coalesce(root, j.w) AS root, n, n_near, form_n FROM judged j LEFT JOIN roots r ON j.w = r.w"""


def _floors_sql(name: str, depth: int) -> str:
    """``name0(tree, i, d, n)`` reduced eight to one ``depth`` times, and each node's siblings left and right in its run."""
    steps = []
    run = "PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN"
    for k in range(depth):
        steps.append(f"""{name}{k + 1} AS (SELECT tree, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d,
  (n + 7) // 8 AS n FROM {name}{k} GROUP BY tree, i // 8, n)""")
        steps.append(f"""{name}_beside{k} AS (SELECT tree, i, n, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})""")
    return ",\n".join(steps)


def _folds_sql(name: str, floors: str, start: str, depth: int) -> str:
    """``start(doc, tree, i, cur, proof)`` folded through all floors into ``name``."""
    steps, last = [], start
    for k in range(depth):
        steps.append(f"""{name}{k} AS (SELECT f.doc, f.tree, f.i // 8 AS i, CASE WHEN n > 1 THEN sha256(concat(l, cur, r)) ELSE cur END AS cur,
  concat(proof, l, r) AS proof FROM {last} f JOIN {floors}_beside{k} s ON s.tree IS NOT DISTINCT FROM f.tree AND s.i = f.i)""")
        last = f"{name}{k}"
    steps.append(f"{name} AS (FROM {last})")
    return ",\n".join(steps)


def manifest_sql(tampered_every: int, depth: int = 8) -> str:
    """For up to 8 ** ``depth`` rows of a language."""

    def leaf(text: str) -> str:
        parts = [f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(strlen(CAST({v} AS VARCHAR)), ':', {v}) END" for v in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256(concat({', '.join(parts)}))"

    other = f"CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % {tampered_every} = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    return f"""
WITH hashed AS (SELECT doc_id, lang, {leaf("text")} AS leaf, {leaf("other")} AS tampered FROM (SELECT *, {other} AS other FROM documents)),
leaves AS (SELECT *, row_number() OVER () AS doc, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY lang) AS n FROM hashed),
a0 AS (SELECT lang AS tree, i, leaf AS d, n FROM leaves),
{_floors_sql("a", depth)},
b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, d, count(*) OVER () AS n, tree AS lang FROM a{depth}),
{_floors_sql("b", depth)},
start AS (SELECT doc, lang AS tree, i, tampered AS cur, '' AS proof FROM leaves),
{_folds_sql("low", "a", "start", depth)},
middle AS (SELECT doc, b0.tree, b0.i, cur, proof FROM low JOIN b0 ON b0.lang IS NOT DISTINCT FROM low.tree),
{_folds_sql("high", "b", "middle", depth)}
SELECT doc_id, leaf, b0.d AS subroot, top.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = top.d AS verified
FROM leaves JOIN high USING (doc) JOIN b0 ON b0.lang IS NOT DISTINCT FROM leaves.lang CROSS JOIN b{depth} top"""
