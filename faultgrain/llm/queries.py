"""One query a numbered operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.llm import chunks, decontaminate, licenses, lines, manifest, packing, secrets, simhash, spellings, substrings, toxicity, urls, windows
from faultgrain.llm.oracles import manifest_sql, spelling_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def n(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = joined(F.filter("spans", lambda s: s["kind"] != "markov"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.edit_likeness(table(spark, sf_dir, "documents"))


# The contract plants a misspelling in every word whose checksum this divides.
MISSPELT_EVERY = 31


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.spelling_variants(table(spark, sf_dir, "documents"), delete_every=MISSPELT_EVERY)


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_documents(table(spark, sf_dir, "documents"), windows.tokenizer_path())


# The contract tampers with the rows whose checksum this divides.
TAMPERED_EVERY = 3


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    text = F.when(touched, manifest.lowered(F.col("text"))).otherwise(F.col("text"))
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered={"text": text})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    run.__name__: run
    for run in (
        op1_license_scans, op2_url_filters, op3_simhash_near_dedup, op4_best_fit_packing, op5_substring_dedup,
        op6_line_dedup, op7_benchmark_decontamination, op8_toxicity, op9_secret_scans, op10_document_fingerprints,
        op11_spelling_variants, op12_window_packing, op13_merkle_manifest,
    )
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _template_rows() -> str:
    rows = []
    for number, template in enumerate([*licenses.BASE, *licenses.MORE]):
        own = template.words.split()
        for place, word in enumerate(own):
            key = place < (template.key or len(own))
            rows.append(f"({number}, '{template.label}', {number < len(licenses.BASE)}, {place}, '{word}', {key})")
    return ", ".join(rows)


_LICENSE_SQL = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM texts),
templates(t, label, base, place, word, key) AS (VALUES {_template_rows()}),
sizes AS (SELECT t, count(*) AS words, count(*) FILTER (key) AS keys FROM templates GROUP BY t),
hits AS (SELECT doc_id, t, label, base, pos - place AS start, count(*) AS n, count(*) FILTER (key) AS k
  FROM places JOIN templates USING (word) GROUP BY ALL),
found AS (SELECT doc_id, t, label, base, count(*) AS n, min(start) AS low, max(start) AS high, sum(h.n) / (any_value(words) * count(*)) AS share
  FROM hits h JOIN sizes USING (t) WHERE k = keys AND start >= 0 GROUP BY doc_id, t, label, base)
SELECT doc_id, any_value(len(w)) AS n_words, CAST(coalesce(sum(n) FILTER (base), 0) AS BIGINT) AS n_base,
  min(low) FILTER (base) AS first_word, max(high) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND share >= {licenses.LEAST_SCORE}), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= {licenses.LEAST_SCORE}), '') AS labels,
  coalesce(max(share), 0.0) AS score
FROM texts LEFT JOIN found USING (doc_id) GROUP BY doc_id"""


def _host_sql(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '')"


def _path_sql(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _key_sql(url: str) -> str:
    path = f"CASE WHEN {_path_sql(url)} = '' THEN '/' ELSE {_path_sql(url)} END"
    query = f"regexp_extract({url}, '(?s)^.*?://[^?#]*\\?([^#]*)', 1)"
    named = f"array_to_string(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{urls.TRACKING}')), '&')"
    return f"CASE WHEN {_host_sql(url)} <> '' THEN concat({_host_sql(url)}, {path}, CASE WHEN {named} <> '' THEN concat('?', {named}) ELSE '' END) END"


def _dots_sql(path: str) -> str:
    """``path`` with its ``.`` and ``..`` steps taken."""
    whole = f"CASE WHEN regexp_matches({path}, '(?s)/\\.\\.?$') THEN concat({path}, '/') ELSE {path} END"
    step = "CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE concat(a, '/', x) END"
    return f"coalesce(nullif(list_reduce(string_split({whole}, '/')[2:], lambda a, x: {step}, ''), ''), '/')"


def _rule_sql(column: int) -> str:
    cases = []
    for rule in sorted(urls.RULES, key=lambda r: (-len(r.host + r.path), r.verdict)):
        fits = f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"
        cases.append(f"WHEN {fits} THEN '{(rule.host + rule.path, rule.verdict)[column]}'")
    return f"CASE {' '.join(cases)} END"


_HREF = """(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)"""
_QUOTED = str.maketrans({"'": "''"})

_URL_SQL = f"""
WITH RECURSIVE tags AS (SELECT url, unnest(list_concat(
  list_transform(regexp_extract_all(html, '{urls.CANONICAL.translate(_QUOTED)}', 1), lambda tag: regexp_extract(tag, '{_HREF}', 1)),
  regexp_extract_all(html, '{urls.REFRESH.translate(_QUOTED)}', 1))) AS link FROM pages),
linked AS (SELECT url, link, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root, regexp_extract(link, '(?s)^([^?#]*)', 1) AS stem,
  regexp_extract(link, '(?s)^[^?#]*(.*)$', 1) AS tail, concat('/', regexp_extract({_path_sql("url")}, '(?s)^/(.*/)', 1)) AS folder FROM tags WHERE link <> ''),
absolute AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
  WHEN starts_with(link, '//') THEN concat(regexp_extract(url, '(?s)^(.*?:)//', 1), link)
  WHEN starts_with(link, '/') THEN concat(root, {_dots_sql("stem")}, tail)
  WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN stem = '' THEN concat(root, {_path_sql("url")}, tail)
  ELSE concat(root, {_dots_sql("concat(folder, stem)")}, tail) END AS target FROM linked),
pairs AS (SELECT {_key_sql("url")} AS a, {_key_sql("target")} AS b, {_host_sql("target")} AS host, {_path_sql("target")} AS path
  FROM absolute WHERE target IS NOT NULL),
sure AS (SELECT * FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL),
edges AS (SELECT a, b FROM sure WHERE a <> b UNION SELECT b, a FROM sure WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
named AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
split AS (SELECT page_id, {_host_sql("url")} AS host, {_path_sql("url")} AS path, {_key_sql("url")} AS node FROM pages),
judged AS (SELECT page_id, host, path, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS own, coalesce(component, s.node) AS alias_of
  FROM split s LEFT JOIN named n ON n.node = s.node),
told AS (SELECT alias_of, own FROM judged UNION ALL SELECT coalesce(component, b), {_rule_sql(1)} FROM sure LEFT JOIN named n ON n.node = b),
spread AS (SELECT alias_of, bool_or(own = 'block') AND NOT coalesce(bool_or(own = 'allow'), FALSE) AS blocked FROM told GROUP BY alias_of)
SELECT page_id, host, path, rule, j.alias_of,
  coalesce(own, CASE WHEN j.alias_of IS NOT NULL AND blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN spread s ON s.alias_of = j.alias_of"""

_SUBSTRING_SQL = """
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM texts),
spans AS (SELECT doc_id, pos, array_to_string(w[pos : pos + 12], ' ') AS key FROM starts),
firsts AS (SELECT key, min(doc_id) AS low FROM spans GROUP BY key),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM spans JOIN firsts USING (key), range(13) r(k) WHERE doc_id > low),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
judged AS (SELECT p.doc_id, p.pos, word, g.pos IS NOT NULL AS gone FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS line FROM judged GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id"""

ORACLES: dict[str, str] = {
    "op1_license_scans": _LICENSE_SQL,
    "op2_url_filters": _URL_SQL,
    "op5_substring_dedup": _SUBSTRING_SQL,
    "op6_line_dedup": f"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
split AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM texts),
keyed AS (SELECT doc_id, pos, line,
  translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
common AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op11_spelling_variants": spelling_sql(MISSPELT_EVERY),
    "op13_merkle_manifest": manifest_sql(TAMPERED_EVERY),
}
