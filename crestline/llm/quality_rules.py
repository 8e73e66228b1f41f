"""Quality rules: a table of thresholds compiled into one projection of length, symbol, stop-word and line ratios.

All steps are DataFrame functions without a shuffle.  Words are runs of characters other than ASCII white space.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; repeated rows each get a row; an
empty table gives no rows.  Extra columns are not read.  Repeated windows are told by 64-bit hashes of eight words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions.let import let
from crestline.llm.common import read, whole_text

WINDOW = 8
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# fixed values: the most frequent function words of the four languages
STOP_WORDS = (
    "the of and to in is it that for was with as on are this by be from or at an not "
    "der die das und ist von zu den mit sich des auf für ein eine dem nicht im es "
    "le la les de et des du un une est que en dans pour qui sur pas au par ce avec "
    "el los las del y se con para una al su lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` for texts of ``least`` words or more."""

    measure: str
    low: float
    high: float
    least: int = 0


RULES = (
    Rule("n_words", 20, float("inf")),
    Rule("repeat_ratio", 0, 0.30),
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", 0, 0.10),
    Rule("stop_word_ratio", 0.04, 1, least=50),
    Rule("dup_line_ratio", 0, 0.40),
    Rule("capital_ratio", 0, 0.50, least=20),
)


def _repeated(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more; each word counts once."""
    n = F.size(words)
    each = F.transform(words, lambda w: F.xxhash64(w))
    window = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    hashes = let(each, lambda w: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: window(w, i)))

    def starts(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(o: Column) -> Column:
            same = lambda p, k: F.coalesce(F.get(o, k)["h"] == p["h"], F.lit(False))
            marked = F.transform(o, lambda p, k: F.when(same(p, k + 1) | ((k > 0) & same(p, F.greatest(k - 1, F.lit(0)))), p["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        return let(ordered, twins)

    def covered(s: Column) -> Column:
        begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
        step = lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"))
        return F.aggregate(s, begin, step, lambda a: a["sum"])

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(starts(h))).otherwise(F.lit(0)))
    return F.when(n > WINDOW, some).otherwise(F.lit(0)).cast("long")


def _length_without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts every rule is made of."""
    def counts(words: Column, lines: Column) -> Column:
        text = F.col("text")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _length_without(text, SPACE).cast("long").alias("word_chars"),
            (F.length(text) - _length_without(text, SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))).cast("long").alias("n_capitals"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    both = let(words, lambda w: let(lines, lambda ls: counts(w, ls)))
    return docs.select("doc_id", whole_text().alias("text")).select("doc_id", both.alias("m")).select("doc_id", "m.*")


def ratios() -> dict[str, Column]:
    """The measures that rules may name, over the columns of ``measures``."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words"),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "mean_word_length": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "capital_ratio": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one boolean."""
    known, passed = ratios(), F.lit(True)
    for rule in rules:
        holds = known[rule.measure] >= rule.low
        if rule.high != float("inf"):
            holds &= known[rule.measure] <= rule.high
        passed &= holds | (F.col("n_words") < rule.least) if rule.least else holds
    return passed


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, base_failed and kept for every row of ``docs``."""
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measures(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & verdict(rules)).alias("kept"),
        "n_lines",
        "n_capitals",
        "n_stop_words",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))


QUERIES = {"op6_quality_rules": op6_quality_rules}
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = {
    "op6_quality_rules": f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
    SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
    FROM texts),
windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda k: w[k:k + 7])) AS g
    FROM parts WHERE len(w) > 8),
twice AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
gaps AS (
    SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8)) AS fresh FROM twice),
repeated AS (
    SELECT doc_id, sum(fresh) AS n FROM gaps GROUP BY doc_id),
counts AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           CAST(len(l) AS BIGINT) AS n_lines,
           CAST(length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS BIGINT) AS n_capitals,
           CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words
    FROM parts LEFT JOIN repeated USING (doc_id)),
judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS n FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_capitals, n_stop_words,
       NOT base_failed AND n_repeat_words / n <= 0.30 AND word_chars / n BETWEEN 2.0 AND 14.0 AND n_symbols / n <= 0.10
       AND (n_words < 50 OR n_stop_words / n BETWEEN 0.04 AND 1)
       AND n_dup_lines / greatest(n_lines, 1) <= 0.40
       AND (n_words < 20 OR n_capitals / greatest(word_chars, 1) <= 0.50) AS kept
FROM judged
"""
}
