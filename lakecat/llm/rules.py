r"""Quality rules: a threshold table compiled into Spark expressions of length, symbol, stop-word and line ratios.

All measures are built-in expressions over one row; nothing is shuffled. Repeated three-word windows are told by 64-bit hashes
within the row: texts that have one twice sort theirs, so the cost of a long text grows as n log n. Stop words are compared as they
are written: a capital at the start of a sentence does not count.

Defined results: a null text has no words and fails the base rules; a ratio over no words or no lines is zero; texts of any
length are measured whole; repeated rows and null ids are kept as they are; an empty table gives an empty result; extra
columns pass through `judged`, but for those of the names of its measures and verdicts, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their this to was were will with you
aber als am an auf auch aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch sich sie sind so und von vor war wie wir zu zum zur
au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous
al como con de del el ella en era es esta este fue ha la las lo los más no o para pero por que se ser si sin sobre su sus un una y ya
""".split()

#: (measure, smallest allowed value or None, largest or None): a text is kept if all hold.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, 1_000_000),
    ("mean_word_chars", 2, 14),
    ("symbol_ratio", None, 0.2),
    ("stop_word_ratio", 0.05, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.5),
]

_EDGE = ".,;:!?\"'()"


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _without(text: Column, characters: str) -> Column:
    """The text without these characters; a replacement each, which costs less than one `translate` of all."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measured(docs: DataFrame, text: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """docs with the counts and ratios that thresholds are about."""
    full = F.coalesce(F.col(text), F.lit(""))
    inner = F.btrim(full, F.lit(common.SPACES))
    # columns that are used more than once stay columns of their own: inside a lambda they must not be computed anew
    words = docs.withColumn("__words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, common.SPACE_CLASS + "+")))
    counted = words.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(_without(full, common.SPACES)).cast("long"),
        "n_symbols": (F.length(full) - F.length(_without(full, "#*$%&|<>"))).cast("long"),
        "__lines": F.filter(F.split(full, "\n"), lambda x: F.btrim(x, F.lit(common.SPACES)) != ""),
        "n_stop_words": F.size(F.filter("__words", lambda w: F.translate(w, _EDGE, "").isin(*dict.fromkeys(stop_words)))).cast("long"),
        "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
    })
    windows = F.when(F.size("__hashes") >= 3, F.sequence(F.lit(0), F.size("__hashes") - 3)).otherwise(F.array().cast("array<int>"))
    hashed = counted.withColumn("__windows", F.transform(windows, lambda i: F.xxhash64(F.get("__hashes", i), F.get("__hashes", i + 1), F.get("__hashes", i + 2)))).drop("__words", "__hashes")
    # most texts have no window twice and are done here
    twice = hashed.withColumn("__twice", F.size(F.array_distinct("__windows")) < F.size("__windows"))
    sorted_ = twice.withColumn("__sorted", F.when(F.col("__twice"), F.sort_array(F.transform("__windows", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).otherwise(F.array().cast("array<struct<k:bigint,i:int>>")))
    same = lambda x, i: F.coalesce(F.get("__sorted", i)["k"] == x["k"], F.lit(False))
    again = sorted_.withColumn("__again", F.sort_array(F.transform(F.filter("__sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    # each window found again brings as many words as lie before the next one starts, three at most
    brings = F.transform("__again", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__again", j + 1) - p, F.lit(3))))
    out = again.withColumns({
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_repeat_words": F.aggregate(brings, F.lit(0).cast("long"), lambda a, x: a + x),
    })
    ratios = out.withColumns({
        "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_word_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_word_ratio": _ratio(F.col("n_repeat_words"), F.col("n_words")),
    })
    return ratios.drop("__lines", "__windows", "__twice", "__sorted", "__again")


def compiled(thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> Column:
    """One boolean expression that holds if every threshold does."""
    verdict = F.lit(True)
    for measure, least, most in thresholds:
        if least is not None:
            verdict = verdict & (F.col(measure) >= least)
        if most is not None:
            verdict = verdict & (F.col(measure) <= most)
    return verdict


def judged(docs: DataFrame, thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """docs with all measures, base_failed and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(thresholds))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql(thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> str:
    """The query for DuckDB."""
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(STOP_WORDS))
    tests = [f"{m} >= {lo}" for m, lo, _ in thresholds if lo is not None] + [f"{m} <= {hi}" for m, _, hi in thresholds if hi is not None]
    spaces = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    return rf"""
WITH split_ AS (
  SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), wins AS (
  SELECT row_, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT row_, words, unnest(range(1, len(words) - 1)) AS i FROM split_)
), again AS (
  SELECT row_, i FROM (SELECT row_, i, count(*) OVER (PARTITION BY row_, w) AS c FROM wins) WHERE c > 1
), covered AS (
  SELECT row_, count(*) AS n FROM (SELECT DISTINCT row_, i + j AS p FROM again, (VALUES (0), (1), (2)) AS o(j)) GROUP BY row_
), counts AS (
  SELECT s.row_, doc_id, len(words) AS n_words, length(translate(text, {spaces}, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: translate(x, {spaces}, '') <> '') AS lines,
         len(list_filter(words, lambda w: list_contains([{stop}], translate(w, '{_EDGE.replace("'", "''")}', '')))) AS n_stop_words,
         coalesce(n, 0) AS n_repeat_words
  FROM split_ s LEFT JOIN covered c ON s.row_ = c.row_
), ratios AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio,
         CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines))) / len(lines) ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_ratio,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counts
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept
FROM ratios
"""
