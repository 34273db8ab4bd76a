"""Queries of the surface instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import surface as s
from ..sources.tables import table

# DuckDB's regular expressions have no lookaround: single-letter dots are hidden first, then runs are marked.
_WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_C = s.CLOSERS.replace("'", "''")
_T = s.TERMINALS


def _marked(text: str) -> str:
    hidden = text
    for _ in range(2):
        hidden = f"regexp_replace({hidden}, '(^|[^A-Za-z])([A-Za-z])\\.', '\\1\\2' || chr(57344), 'g')"
    runs = f"regexp_replace({hidden}, '([{_T}][{_T}{_C}.]*|\\.[{_C}][{_T}{_C}.]*)', '\\1' || chr(64976), 'g')"
    return f"replace(regexp_replace({runs}, '\\.([{_WS}]|\\z)', '.' || chr(64976) || '\\1', 'g'), chr(57344), '.')"


def _chars(text: str) -> str:
    return f"length(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


_LINES = r"""lines AS (
  SELECT doc_id, unnest(string_split_regex(text, '[\r\n]')) AS piece, generate_subscripts(string_split_regex(text, '[\r\n]'), 1) AS line
  FROM documents WHERE text IS NOT NULL)"""
_PIECES = f"""{_LINES}, parts AS (SELECT doc_id, line, string_split({_marked('piece')}, chr(64976)) AS ps FROM lines),
pieces AS (SELECT doc_id, line, unnest(ps) AS piece, generate_subscripts(ps, 1) AS part, len(ps) AS parts FROM parts)"""


def _placed(source: str, gap: str, order: str) -> str:
    return f"""placed AS (SELECT *, coalesce(sum(length(piece) + {gap}) OVER (PARTITION BY doc_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
  length(piece) - length(regexp_replace(piece, '^[{_WS}]+', '')) AS lead,
  length(regexp_replace(regexp_replace(piece, '^[{_WS}]+', ''), '[{_WS}]+\\z', '')) AS bare, {_chars('piece')} AS chars FROM {source}),
kept AS (SELECT * FROM placed WHERE chars > 0)"""


_SENTENCES = f"""WITH {_PIECES}, {_placed('pieces', 'CASE WHEN part = parts THEN 1 ELSE 0 END', 'line, part')},
sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, part) - 1 AS sentence,
  dense_rank() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS paragraph, (base + lead)::BIGINT AS start_cp, (base + lead + bare)::BIGINT AS end_cp, chars AS content_chars FROM kept)"""
_PARAGRAPHS = f"""WITH {_LINES}, {_placed('lines', '1', 'line')},
paragraphs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS paragraph, (base + lead)::BIGINT AS start_cp, (base + lead + bare)::BIGINT AS end_cp, chars AS content_chars FROM kept)"""

_WIDE = f"""{_SENTENCES},
paras AS (SELECT doc_id, line, {_chars('piece')} AS c FROM lines),
per_para AS (SELECT doc_id, paragraph, count(*) AS s FROM sentences GROUP BY 1, 2),
p AS (SELECT doc_id, count(*) FILTER (c > 0) AS n_paragraphs, sum(c)::BIGINT AS n_content FROM paras GROUP BY 1),
o AS (SELECT doc_id, count(*) FILTER (s = 1) AS n_single FROM per_para GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n, median(content_chars) AS med, quantile_cont(content_chars::DOUBLE, 0.75) - quantile_cont(content_chars::DOUBLE, 0.25) AS iqr, quantile_cont(content_chars::DOUBLE, 0.9) AS q90 FROM sentences GROUP BY 1),
mad AS (SELECT s.doc_id, median(abs(content_chars - med)) AS mad FROM sentences s JOIN m USING (doc_id) GROUP BY 1),
pairs AS (SELECT doc_id, content_chars AS a, lead(content_chars) OVER (PARTITION BY doc_id ORDER BY sentence) AS b FROM sentences),
steps AS (SELECT doc_id, avg(abs(b - a)) AS step FROM pairs WHERE b IS NOT NULL GROUP BY 1),
ranked AS (SELECT doc_id, rank() OVER (PARTITION BY doc_id ORDER BY a) + (count(*) OVER (PARTITION BY doc_id, a) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY doc_id ORDER BY b) + (count(*) OVER (PARTITION BY doc_id, b) - 1) / 2.0 AS y FROM pairs WHERE b IS NOT NULL),
rho AS (SELECT doc_id, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS rho FROM ranked GROUP BY 1),
wide AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, n_paragraphs, n_content,
  CASE WHEN n_content > 0 THEN 1000.0 * n_paragraphs / n_content END AS f002, CASE WHEN n_paragraphs > 0 THEN coalesce(n_single, 0) / n_paragraphs::DOUBLE END AS f003,
  med AS f013, iqr AS f014, q90 AS f015, mad / nullif(med, 0) AS f016, step / nullif(med, 0) AS f024, rho AS f025
  FROM p LEFT JOIN o USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN mad USING (doc_id) LEFT JOIN steps USING (doc_id) LEFT JOIN rho USING (doc_id))"""
_LONG = f"""{_WIDE}, long AS (
  {' UNION ALL '.join(f"SELECT doc_id, n_content, '{f}' AS feature_id, {f.lower()}::DOUBLE AS value, {unit} >= {least} AS enough FROM wide" for f, (unit, least) in s._RULES.items())}),
flong AS (SELECT doc_id, feature_id, round(value, 9) + 0.0 AS value, CASE WHEN value IS NULL THEN 'unavailable' WHEN round(value, 9) = 0 THEN 'zero_observed' ELSE 'observed' END AS status,
  value IS NOT NULL AND enough AND n_content >= 200 AS eligible FROM long)"""


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def _column(*names: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return s.measured(_documents(spark, folder)).where("n_content is not null").select("doc_id", *((F.round(n, 9) + 0.0).alias(n) for n in names))

    return query, f"{_WIDE} SELECT doc_id, {', '.join(f'round({n}, 9) + 0.0 AS {n}' for n in names)} FROM wide"


QUERIES = {
    "content_chars": (
        lambda spark, d: _documents(spark, d).select("doc_id", s.content_chars(F.col("text")).alias("content_chars")),
        f"SELECT doc_id, {_chars('text')} AS content_chars FROM documents",
    ),
    "paragraph_spans": (lambda spark, d: s.paragraphs(_documents(spark, d)), f"{_PARAGRAPHS} SELECT * FROM paragraphs"),
    "sentence_spans": (lambda spark, d: s.sentences(_documents(spark, d)), f"{_SENTENCES} SELECT * FROM sentences"),
    "sentences_per_paragraph": (
        lambda spark, d: s.sentences(_documents(spark, d)).groupBy("doc_id", "paragraph").agg(F.count("*").alias("n_sentences")),
        f"{_SENTENCES} SELECT doc_id, paragraph, count(*) AS n_sentences FROM sentences GROUP BY 1, 2",
    ),
    "f002_paragraph_density": _column("f002"),
    "f003_single_share": _column("f003"),
    "f013_median": _column("f013"),
    "f014_iqr": _column("f014"),
    "f015_q90": _column("f015"),
    "f016_mad": _column("f016"),
    "f024_adjacent_change": _column("f024"),
    "f025_lag_spearman": _column("f025"),
    "surface_features_long": (lambda spark, d: s.features_long(_documents(spark, d)), f"{_LONG} SELECT * FROM flong"),
    "review_locations": (
        lambda spark, d: s.review_locations(_documents(spark, d)),
        f"""{_SENTENCES} SELECT doc_id, sentence, start_cp, end_cp, content_chars FROM (SELECT *, min(content_chars) OVER (PARTITION BY doc_id) AS low, max(content_chars) OVER (PARTITION BY doc_id) AS high FROM sentences)
WHERE content_chars IN (low, high)""",
    ),
    "band_compare": (
        lambda spark, d: s.band_comparison(s.features_long(_documents(spark, d)), table(spark, d, "reference_bands"), "web"),
        f"""{_LONG} SELECT doc_id, feature_id, value, q10, q90, eligible, CASE WHEN eligible THEN NOT (value BETWEEN q10 AND q90) END AS outside
FROM flong JOIN reference_bands b USING (feature_id) WHERE b.source = 'web' AND b.supported""",
    ),
    "surface_proxies": (
        lambda spark, d: s.proxies(_documents(spark, d)),
        f"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[。！？!?\\n]+|\\.(?:[{_WS}]|\\z)'), lambda t: len(regexp_extract_all(t, '[\\x{{3400}}-\\x{{9fff}}]|[A-Za-z0-9_]+'))), lambda n: n > 0) AS a,
  list_filter(list_transform(string_split_regex(text, '\\n[ \\t\\r\\f\\x0b]*\\n'), lambda t: len(regexp_extract_all(t, '[\\x{{3400}}-\\x{{9fff}}]|[A-Za-z0-9_]+'))), lambda n: n > 0) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(a) AS n_sentence_proxies, coalesce(list_max(a), 0) AS longest_sentence, len(b) AS n_paragraph_proxies, coalesce(list_max(b), 0) AS longest_paragraph FROM x""",
    ),
}
