"""Quality rules: line-first cleaning, then rejection of documents that lost too much text. DataFrame functions only.

Every line of a text is held against three kinds of rule: punctuation (it ends like a sentence or, if long, has the end of one
inside, as cut-off prose does; it is not made of symbols or exclamation marks and does not repeat itself), navigation (no menu of separators) and boilerplate (no short licence or site
notice). Failing lines are removed; a document is rejected when too small a share of its characters is left.

Defined results: null and empty texts have no words, fail the base rules and are rejected; their cleaned text is empty.
Blank lines neither pass nor fail and are kept. Repeated rows are judged one by one. An empty table gives an empty result. A
very long text is judged whole, in time that grows with its length (its windows are sorted if any repeats). Other columns are
passed through whatever their names; where one is named like the added column, the added one has an underscore behind its name.
All work is within a row, so there is no shuffle and no key to be skewed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, unused, words

# Fixed values.
SYMBOLS = "[#*$%&|<>]"
SENTENCE_END = r"""[.!?:;…。！？؟।"'”’»)\]]\s*$"""
SENTENCE_INSIDE = r"[.!?…] |[。！？]"
SEPARATORS = r"[|»›•·¦→]|\s>\s"
MARKS = "[!#*$%&|<>»›•·¦→]"  # a line without these needs no count of them
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|released under the|copyright\s*(©|\(c\)|\d)|©|terms of (use|service)"
    r"|privacy policy|cookie policy|use of cookies|enable javascript|click here|read more\b|sign (in|up)\b|log ?in\b"
    r"|subscribe (now|to)|share (this|on)|follow us|powered by|back to top|skip to (main )?content|lorem ipsum"
)


@dataclass(frozen=True)
class Rules:
    """Thresholds. Shares are of the words of a line unless said otherwise."""

    min_words: int = 10  # base: fewer words fail
    max_repeat_percent: int = 20  # base: a larger share of words in repeated windows fails
    window: int = 5
    symbol_share: float = 0.3
    exclamation_share: float = 0.3
    separator_share: float = 0.15
    least_separators: int = 3
    boilerplate_words: int = 25  # longer lines are prose that mentions such a phrase
    unpunctuated_words: int = 3  # a line of more words has to end like a sentence
    prose_words: int = 20  # or, if it has so many, to hold a sentence's end
    least_distinct_share: float = 0.3
    distinct_from: int = 10  # lines of fewer words may repeat theirs
    kept_share: float = 0.5  # of the document's characters


def repeated_words(ws: Column, window: int) -> Column:
    """How many words stand in windows (of so many words) that the text has twice or more.

    Windows are compared by a 64-bit hash. If all are distinct, the answer is 0; else they are sorted with their places,
    equal neighbours give the repeated places, and each place adds the words it covers before the next one.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        def total(p: Column) -> Column:
            each = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
            return F.aggregate(each, F.lit(0), lambda a, x: a + x)

        return let(let(placed, places), total)

    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - window), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(window)]))
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(ws) <= window, F.lit(0)).otherwise(counted)


def line_ok(line: Column, ws: Column, rules: Rules) -> Column:
    """True if the line, of the words ws, passes every rule; blank lines do."""
    n = F.size(ws)
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    navigation = let(count(SEPARATORS), lambda k: (k >= rules.least_separators) & (k > n * rules.separator_share))
    marked = (count(SYMBOLS) > n * rules.symbol_share) | (count("!") > n * rules.exclamation_share) | navigation
    return F.when(n == 0, F.lit(True)).otherwise(
        ((n <= rules.unpunctuated_words) | line.rlike(SENTENCE_END) | ((n >= rules.prose_words) & line.rlike(SENTENCE_INSIDE)))
        & ~(line.rlike(MARKS) & marked)
        & ~((n <= rules.boilerplate_words) & line.rlike(BOILERPLATE))
        & ((n < rules.distinct_from) | (F.size(F.array_distinct(ws)) >= n * rules.least_distinct_share))
    )


def apply_rules(docs: DataFrame, text: str = "text", rules: Rules = Rules(), into: str = "quality") -> DataFrame:
    """docs with one more column, `quality` unless named otherwise: the base counts, base_failed, kept, kept_share and the cleaned text.

    Each step is a projection of its own, so that nothing is computed again for each column that uses it.
    """
    into, lines, worded, ws = unused([into, "__lines", "__worded", "__words"], docs.columns)
    counts = "__count_" + "_" * max(map(len, docs.columns))  # longer than any of theirs
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn(lines, F.split(raw, "\n", -1))
    rows = rows.withColumn(worded, F.transform(lines, lambda x: F.struct(x.alias("line"), words(x).alias("ws"))))
    rows = rows.withColumn(ws, F.flatten(F.col(f"{worded}.ws")))
    said = F.transform(F.filter(worded, lambda x: F.size(x["ws"]) > 0), lambda x: x["line"])
    given = [F.col(f"`{c}`") for c in docs.columns]
    counted = rows.select(
        *given,
        F.size(ws).cast("long").alias(f"{counts}n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias(f"{counts}word_chars"),
        F.length(F.regexp_replace(raw, "[^#*$%&|<>]+", "")).cast("long").alias(f"{counts}n_symbols"),
        let(said, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias(f"{counts}n_dup_lines"),
        repeated_words(F.col(ws), rules.window).cast("long").alias(f"{counts}n_repeat_words"),
        F.filter(worded, lambda x: line_ok(x["line"], x["ws"], rules)).alias(f"{counts}passed"),
    )
    count = lambda name: F.col(f"{counts}{name}")
    share = F.length(F.array_join(F.flatten(F.col(f"{counts}passed.ws")), "")) / count("word_chars")
    judged = counted.withColumn(f"{counts}share", F.when(count("word_chars") > 0, share).otherwise(0.0))
    failed = (count("n_words") < rules.min_words) | (100 * count("n_repeat_words") > rules.max_repeat_percent * count("n_words"))
    found = F.struct(
        *[count(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & (count("share") >= rules.kept_share)).alias("kept"),
        count("share").alias("kept_share"),
        F.array_join(F.col(f"{counts}passed.line"), "\n").alias("text"),
    )
    # Filters on what explode() makes aren't pushed below it, where they would compute all counts again.
    return judged.select(*given, F.explode(F.array(found)).alias(into))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all documents: counts and verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_rules(docs)
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept kept_share".split()
    return out.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in fields])


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, the others keep their passing lines (n_chars follows the text)."""
    (made,) = unused(["quality"], docs.columns)
    out = apply_rules(docs, into=made).filter(f"{made}.kept")
    now = {"text": F.col(f"{made}.text"), "n_chars": F.length(f"{made}.text").cast("long")}
    return out.select(*[(now[c] if c in now else F.col(f"`{c}`")).alias(c) for c in docs.columns])
