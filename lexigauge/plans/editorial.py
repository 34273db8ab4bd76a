"""Queries of the editorial operators: each document against an altered next one, and scans of all altered documents.

Documents hold few soft patterns or signs, so drafts are the documents with a line added by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import editorial as ed
from ..sources.tables import table

#: What is added to the documents whose id leaves the remainder of its place.
_ADDED = (
    "", "\n\nIn conclusion, not only rings but also fields are flat.", "\n\nsame words 3\n \nsame words 3", "\nFor ≤ and ∀ see page 7%.", "\n\nGreat question. 赋能 综上所述 cite_start",
    "\nWhy is it so? One might ask why it may not be 12月.", "\n$$a$$ $$b$$\n\n\\[c\\]\n$d$\n", "",
)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    added = F.element_at(F.array(*map(F.lit, _ADDED)), (F.col("doc_id") % len(_ADDED) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat("text", added).alias("text"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    old = table(spark, d, "documents").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("original"))
    return old.join(docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("candidate")), "pair_id")


_TEXTS = ", ".join("'" + x.replace("'", "''") + "'" for x in _ADDED)
_PAIRS = f"""drafts AS (SELECT doc_id, text AS original, text || ([{_TEXTS}])[doc_id % {len(_ADDED)} + 1] AS text FROM documents),
pairs AS (SELECT doc_id AS pair_id, original, text AS candidate FROM drafts)"""
# The protected parts and items for an engine without look-around and back references: equal where fences, ticks and formulas are well formed.
_PROTECTED = (
    r"(?ms)^ {0,3}```[^\n]*\n.*?^ {0,3}```[^\n]*(?:\n|$)|``[^\n]+?``|`[^`\n]+`|\$\$.*?\$\$|\$[^$\n]+\$|\\\[.*?\\\]|\\\(.*?\\\)|^>[^\n]*(?:\n|$)|https?://[^\s<>\]\)]+"
)
_W = r"\p{L}\p{N}_"
_ITEMS = {
    "quantity": [(rf"(?:^|[^{_W}])(\p{{Nd}}[\p{{Nd}},]*(?:\.\p{{Nd}}+)?[%％]?)|(\p{{Nd}}+(?:\.\p{{Nd}}+)?(?:年|月|日|元|人|次|小时|分钟|公里|米|倍))", g) for g in (1, 2)],
    "logic": [(rf"(不超过|不少于|至少|至多|最多|仅限|仅|只有|除非|否则|如果|可能|推测|尚未|不得|不能|并非|不|未)|((?i)no|not|only|unless|may)(?:[^{_W}]|$)", g) for g in (1, 2)],
    "symbol": [(f"([{ed.SYMBOLS}])", 1)],
}


def _body(c: str, what: str) -> str:
    return f"coalesce({c}, '')" if what == "symbol" else f"regexp_replace(coalesce({c}, ''), '{_PROTECTED}', ' ', 'g')"


def _diffed(what: str) -> str:
    def items(c: str) -> str:
        return " || ".join(f"list_filter(regexp_extract_all({_body(c, what)}, '{p}', {g}), lambda v: v <> '')" for p, g in _ITEMS[what])

    return f"""x AS (SELECT pair_id, unnest({items('candidate')}) AS item, 1 AS v FROM pairs UNION ALL SELECT pair_id, unnest({items('original')}), -1 FROM pairs),
s AS (SELECT pair_id, item, sum(v)::BIGINT AS v FROM x GROUP BY 1, 2)"""


def _diff(what: str):
    return (
        lambda spark, d: ed.prose_diff(_pairs(spark, d), what),
        f"WITH {_PAIRS}, {_diffed(what)} SELECT pair_id, item, greatest(-v, 0) AS removed, greatest(v, 0) AS added FROM s WHERE v <> 0",
    )


_LOCKS = ["theorem", "lemma", "图", "https://", "\\begin{proof}"]

QUERIES = {
    "quantity_diff": _diff("quantity"),
    "logic_diff": _diff("logic"),
    "symbol_diff": _diff("symbol"),
    "lock_counts": (
        lambda spark, d: ed.lock_counts(_pairs(spark, d), spark.createDataFrame([(x,) for x in _LOCKS], "literal string")),
        f"""WITH {_PAIRS}, l AS (SELECT unnest([{', '.join("'" + x + "'" for x in _LOCKS)}]) AS literal),
c AS (SELECT pair_id, literal, (length(coalesce(original, '')) - length(replace(coalesce(original, ''), literal, ''))) // length(literal) AS n_original,
  (length(coalesce(candidate, '')) - length(replace(coalesce(candidate, ''), literal, ''))) // length(literal) AS n_candidate FROM pairs, l)
SELECT *, CASE WHEN n_original = 0 THEN 'absent' WHEN n_original <> n_candidate THEN 'changed' ELSE 'kept' END AS state FROM c""",
    ),
    "repeated_paragraphs": (
        lambda spark, d: ed.repeated_paragraphs(_docs(spark, d)).select("doc_id", "n"),
        rf"""WITH {_PAIRS}, p AS (SELECT pair_id, trim(unnest(string_split_regex({_body('candidate', 'p')}, '\n\s*\n')), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(12288)) AS p FROM pairs),
k AS (SELECT pair_id, p, count(*) AS n FROM p WHERE p <> '' GROUP BY 1, 2) SELECT pair_id AS doc_id, n FROM k WHERE n > 1""",
    ),
    "unicode_scan": (
        lambda spark, d: ed.invisible(_docs(spark, d)).select("doc_id", "offset_cp", "codepoint"),
        f"""WITH {_PAIRS}, c AS (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) - 1 AS offset_cp, unnest(string_split(text, '')) AS c FROM drafts WHERE regexp_matches(text, '{ed.INVISIBLE}'))
SELECT doc_id, offset_cp, 'U+' || lpad(to_hex(unicode(c)), 4, '0') AS codepoint FROM c WHERE regexp_matches(c, '{ed.INVISIBLE}')""",
    ),
    "soft_pattern_counts": (
        lambda spark, d: ed.soft_findings(_docs(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n")),
        f"WITH {_PAIRS}, x AS ("
        + " UNION ALL ".join(f"SELECT pair_id AS doc_id, '{k}' AS kind, len(regexp_extract_all({_body('candidate', k)}, '(?i){p}'))::BIGINT AS n FROM pairs" for k, p in ed.SOFT.items())
        + ") SELECT * FROM x WHERE n > 0",
    ),
    "soft_patterns": (lambda spark, d: ed.soft_findings(_docs(spark, d)), None),
    "protected_counts": (
        lambda spark, d: ed.protected_spans(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end_cp") - F.col("start_cp")).alias("n_chars")),
        f"WITH {_PAIRS}, x AS (SELECT pair_id AS doc_id, unnest(regexp_extract_all(candidate, '{_PROTECTED}')) AS p FROM pairs) SELECT doc_id, count(*) AS n, sum(length(p))::BIGINT AS n_chars FROM x GROUP BY 1",
    ),
    "protected_spans": (lambda spark, d: ed.protected_spans(_docs(spark, d)), None),
    "presentation_review": (lambda spark, d: ed.presentation_findings(_docs(spark, d)), None),
    "lint_status": (lambda spark, d: ed.review(_pairs(spark, d)), None),
    "lint_counts": (
        lambda spark, d: ed.review(_pairs(spark, d)).select("pair_id", "protected_changed", "n_symbol", "n_invisible", "n_soft"),
        f"""WITH {_PAIRS} SELECT pair_id, regexp_extract_all(coalesce(original, ''), '{_PROTECTED}') <> regexp_extract_all(coalesce(candidate, ''), '{_PROTECTED}') AS protected_changed,
(CASE WHEN pair_id % {len(_ADDED)} = 3 AND original IS NOT NULL THEN 2 ELSE 0 END)::BIGINT AS n_symbol, len(regexp_extract_all(coalesce(candidate, ''), '{ed.INVISIBLE}'))::BIGINT AS n_invisible,
({' + '.join(f"len(regexp_extract_all({_body('candidate', k)}, '(?i){p}'))" for k, p in ed.SOFT.items())})::BIGINT AS n_soft FROM pairs""",
    ),
}
