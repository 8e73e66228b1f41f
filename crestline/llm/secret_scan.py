"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

All steps are DataFrame functions.  Both models are bigram tables over ASCII, trained from strings that the patterns
label: values inside pattern matches are random strings, other long tokens of the same texts ordinary identifiers.

Defined cases: a null or empty text has no spans; repeated rows each get a row; an empty table gives no rows and leaves
both models at their smoothed start.  Positions are code points, ends exclusive.  Extra columns are not read, except by
``redact``, which keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions.let import let
from crestline.llm.common import read, running_most, running_sums, whole_text

# fixed values: the kinds in order, each with its pattern
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run of AKIA[A-Z0-9]+ is taken whole, so 20 characters or more are these
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "A-Za-z0-9+/_=-"
#: Shortest token that the models judge, and shortest one they are trained on.
JUDGED, TRAINED = 16, 8
#: Documents whose tokens train the models.
SAMPLE = 20_000
#: A token is a secret when it is this many times likelier than not, given how rare random strings are.
ODDS = 1000.0
SYMBOLS = 66
#: Weight, in pairs, of a character's own frequency where its pair is rare.
BACKOFF = 50
MASK = "[SECRET]"
#: Characters of a piece of a text from which stretches are read.
PIECE = 2000


def _found(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans (start, rank, stop, value) of the leftmost matches that do not overlap; matches that fail ``keep`` go.

    Texts between and inside matches have known lengths, so positions are their running sum.
    """
    def placed(pieces: Column, values: Column) -> Column:
        lengths = F.zip_with(F.slice(pieces, 1, F.size(values)), values, lambda p, v: F.length(p) + F.length(v))
        spans = lambda stops: F.zip_with(values, stops, lambda v, stop: F.struct((stop - F.length(v)).alias("start"), F.lit(kind).alias("rank"), stop.alias("stop"), v.alias("value")))
        found = let(running_sums(lengths), spans)
        return F.filter(found, lambda s: keep(s["value"])) if keep else found

    both = let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda v: placed(p, v)))
    return F.when(text.rlike(pattern), both.cast(SPANS)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,rank:int,stop:int,value:string>>"


def base_spans(text: Column) -> Column:
    assign = _found(text, ASSIGN, 0, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(assign, _found(text, ACCESS, 1), _found(text, HEX, 2)))


class Markov:
    """Log-likelihood ratio of two character bigram models, as one table indexed by two ASCII codes."""

    def __init__(self, counts: dict[tuple[int, str], int], tokens: dict[int, int]) -> None:
        table = [0.0] * (128 * 128)
        totals: dict[tuple[int, str], int] = {}
        for (label, pair), n in counts.items():
            totals[label, pair[0]] = totals.get((label, pair[0]), 0) + n
        letters = [chr(c) for c in range(33, 127)]

        single: dict[tuple[int, str], int] = {}
        for (label, pair), n in counts.items():
            single[label, pair[1]] = single.get((label, pair[1]), 0) + n
        whole = {label: sum(n for (own, _), n in single.items() if own == label) for label in (0, 1)}

        def log_p(label: int, a: str, b: str) -> float:
            alone = (single.get((label, b), 0) + 0.5) / (whole[label] + 0.5 * SYMBOLS)
            return math.log((counts.get((label, a + b), 0) + BACKOFF * alone) / (totals.get((label, a), 0) + BACKOFF))

        for a in letters:
            for b in letters:
                table[ord(a) * 128 + ord(b)] = round(log_p(1, a, b) - log_p(0, a, b), 4)
        self.table = table
        self.threshold = math.log((tokens.get(0, 0) + 1) / (tokens.get(1, 0) + 1)) + math.log(ODDS)

    @classmethod
    def train(cls, docs: DataFrame, sample: int = SAMPLE) -> Markov:
        """Counts over about ``sample`` documents, chosen by a hash of the id; at most two bigram tables are collected."""
        rate = min(1.0, sample / max(1, docs.count()))
        some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000)).select(whole_text().alias("text"))
        spans = base_spans(F.col("text"))
        value = F.transform(spans, lambda s: F.when(s["rank"] == 0, F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"]))
        rest = F.col("text")
        for pattern in (ASSIGN, ACCESS, HEX):
            rest = F.regexp_replace(rest, pattern, " ")
        plain = F.regexp_extract_all(rest, F.lit(f"[{ALPHABET}]{{{TRAINED},}}"), 0)
        labelled = F.concat(
            F.transform(value, lambda v: F.struct(F.lit(1).alias("label"), v.alias("token"))),
            F.transform(plain, lambda v: F.struct(F.lit(0).alias("label"), v.alias("token"))),
        )
        tokens = some.select(F.explode(labelled).alias("t")).select("t.*").where(F.length("token") >= 2)
        pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
        # the empty pair counts the tokens themselves
        counted = tokens.select("label", F.explode(F.concat(F.array(F.lit("")), pairs)).alias("pair")).groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()
        return cls({(r["label"], r["pair"]): r["n"] for r in counted if r["pair"]}, {r["label"]: r["n"] for r in counted if not r["pair"]})

    def ratio(self, token: Column) -> Column:
        table = F.split(F.lit(",".join(map(str, self.table))), ",").cast("array<double>")
        code = lambda i: F.ascii(F.substring(token, i, F.lit(1)))
        steps = F.sequence(F.lit(1), F.length(token) - 1)
        return F.aggregate(steps, F.lit(0.0), lambda total, i: total + F.get(table, code(i) * 128 + code(i + 1)))

    def spans(self, text: Column, base: Column) -> Column:
        """Tokens that the models call random and that no base span touches."""
        tokens = _found(text, f"[{ALPHABET}]{{{JUDGED},}}", 3)

        def secret(span: Column) -> Column:
            free = ~F.exists(base, lambda b: (b["start"] < span["stop"]) & (span["start"] < b["stop"]))
            return free & (self.ratio(span["value"]) > self.threshold)

        return F.filter(tokens, secret)


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(each, ",")


def _spans(text: Column, model: Markov) -> Column:
    """Struct of base spans and all spans of one text, each worked out once."""
    return let(
        base_spans(text),
        lambda base: F.struct(base.alias("base"), F.array_sort(F.concat(base, model.spans(text, base))).alias("all")),
    )


def scan(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) for every row of ``docs``."""
    model = model or Markov.train(docs)
    found = docs.select("doc_id", whole_text().alias("text")).select("doc_id", _spans(F.col("text"), model).alias("found"))
    count = lambda rank: F.size(F.filter("found.all", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("found.base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("found.all")).alias("spans"),
        count(3).alias("n_markov"),
    )


def redact(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``MASK``; ``n_chars`` follows the new text where it is a column.

    Spans that overlap are replaced together.  Texts without a span, null ones too, stay as they are.
    """
    model = model or Markov.train(docs)

    def cut(text: Column, spans: Column) -> Column:
        """The text between the spans, joined with masks; a stretch is read from pieces of ``PIECE`` characters."""
        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0), lambda pieces: masked(text, pieces, spans))

    def masked(text: Column, pieces: Column, spans: Column) -> Column:
        def stretch(start: Column, stop: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor(stop / PIECE).cast("int") - first + 1), "")
            return F.substring(some, start - first * PIECE + 1, stop - start)

        def joined(reach: Column) -> Column:
            behind = lambda k: F.coalesce(F.get(reach, k - 1), F.lit(0))
            before = F.transform(spans, lambda s, k: F.when(s["start"] >= behind(k), stretch(behind(k), s["start"])))
            return F.concat(F.array_join(F.transform(F.array_compact(before), lambda x: F.concat(x, F.lit(MASK))), ""), stretch(F.element_at(reach, -1), F.length(text)))

        return let(running_most(F.transform(spans, lambda s: s["stop"])), joined)

    columns, text = docs.columns, F.col("text")
    clean = let(_spans(whole_text(), model), lambda found: F.when(F.size(found["all"]) > 0, cut(text, found["all"])).otherwise(text))
    out = docs.withColumn("text", clean)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE: dict[str, str] = {}
