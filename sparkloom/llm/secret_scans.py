"""Secret scans through a trigram inverted index. DataFrame functions only.

1. Each rule's regular expression is parsed, and a Boolean query of mandatory trigrams (an OR of ANDs, in lower case) is
   derived from its parse tree.
2. The index holds postings (trigram, doc_id), for the trigrams that some query names.
3. Postings are intersected: a document is a candidate of a rule if, for some AND of its query, it is on all postings.
4. Candidates are verified by the regular expression itself, over the whole text. Rules without mandatory trigrams (hex)
   scan every text.

The candidates (an id and a bit mask) are small, but grow with the corpus: they are written to the shared folder, counted,
and broadcast up to BROADCAST_ROWS; beyond, both sides are joined by a shuffle on the id and a salt of the row's place, so that
an id of very many rows is dealt over SALTS tasks. Verification is exact either way, so rows with equal ids and different texts
do no harm.

Defined results: null and empty texts have no spans. Null ids are an id of their own. Repeated rows each get their spans.
Places are code points, the end is exclusive. An empty table gives an empty result. A very long text, or one with very many
matches, takes time in proportion: places are running sums over blocks of matches, and masks are set in blocks of the text.
Columns of the caller's are passed through whatever their names; where one is named `spans`, the added one has an underscore
behind its name.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, let, save, scanned, unused

BROADCAST_ROWS = 1_000_000  # of an id and a mask: some 16 MB
MOST_STRINGS = 96  # of exact strings that a derivation carries along
MASK = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; those whose group (0: the match) is shorter than least are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# Fixed values. hex: a maximal run of 24 or more is what [0-9a-f]+ finds when shorter ones are dropped.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

Query = frozenset[frozenset[str]]  # an OR of ANDs of trigrams; the empty AND is true
ANY: Query = frozenset({frozenset()})


def absorb(query: Iterable[frozenset[str]]) -> Query:
    """Without the ANDs that a smaller one implies."""
    sets = set(query)
    return frozenset(s for s in sets if not any(t < s for t in sets))


def both(a: Query, b: Query) -> Query:
    return absorb(x | y for x in a for y in b)


def trigrams(strings: Iterable[str]) -> Query:
    """What holds of a text that contains one of the strings."""
    return absorb(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def derive(items) -> tuple[frozenset[str] | None, Query]:
    """Of a parsed sequence: the strings that it can match (None: too many), and a query that holds of all its matches."""
    exact: frozenset[str] | None = frozenset({""})
    query, whole = ANY, True  # exact: of the part since the last break
    for op, arg in items:
        strings, inner = derive_item(op, arg)
        if strings is not None and len(strings) * len(exact) <= MOST_STRINGS:
            exact = frozenset(a + b for a, b in product(exact, strings))
            continue
        query = both(both(query, trigrams(exact)), inner if strings is None else ANY)
        whole, exact = False, strings if strings is not None else frozenset({""})
    return (exact, trigrams(exact)) if whole else (None, both(query, trigrams(exact)))


def derive_item(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is C.LITERAL:
        return frozenset({chr(arg).lower()}), ANY
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                chars.update(chr(y).lower() for y in range(x[0], x[1] + 1))
            else:
                return None, ANY
        return (frozenset(chars), ANY) if len(chars) <= 8 else (None, ANY)
    if op is C.SUBPATTERN:
        return derive(arg[-1])
    if op is C.BRANCH:
        parts = [derive(x) for x in arg[1]]
        query = absorb(s for _, q in parts for s in q)
        return (None, query) if any(s is None for s, _ in parts) else (frozenset().union(*(s for s, _ in parts)), query)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = derive(inner)
        if strings is not None and most <= 4 and len(strings) ** int(most) <= MOST_STRINGS:
            made = [frozenset(map("".join, product(strings, repeat=n))) for n in range(int(least), int(most) + 1)]
            return frozenset().union(*made), ANY
        return None, query if least else ANY
    if op is C.AT:
        return frozenset({""}), ANY
    return None, ANY


def trigram_query(pattern: str) -> Query:
    """An OR of ANDs of trigrams which the lower-cased text of any match contains; ANY if none is mandatory."""
    return derive(parser.parse(pattern))[1]


def postings(docs: DataFrame, queries: Iterable[Query]) -> DataFrame:
    """The index: a row (trigram, doc_id) for each trigram of the queries that a document contains."""
    wanted = sorted({t for q in queries for s in q for t in s})
    low = docs.select("doc_id", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in wanted]))
    return low.select("doc_id", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(doc_id, mask): the bits of the rules one of whose ANDs has the document on all its postings."""
    clauses = [(rule, f"{rule}/{n}", len(s), t) for rule, q in queries.items() for n, s in enumerate(sorted(map(sorted, q))) for t in s]
    entry = lambda c: F.struct(F.lit(c[0]).alias("rule"), F.lit(c[1]).alias("clause"), F.lit(c[2]).alias("size"))
    pairs = [(F.lit(t), F.array(*[entry(c) for c in clauses if c[3] == t])) for t in sorted({c[3] for c in clauses})]
    names = F.create_map(*[x for pair in pairs for x in pair])
    each = index.select("doc_id", F.explode(F.element_at(names, F.col("trigram"))).alias("c"))
    met = each.groupBy("doc_id", "c.rule", "c.clause", "c.size").agg(F.count("*").alias("n"))
    met = met.filter(F.col("n") >= F.col("size"))  # more where an id is repeated: verification decides
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("mask"))


NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind, end) of the rule's matches, each found after the gap that the search skips."""
    search = F.lit(rf"\G([\s\S]*?)({rule.pattern})")
    part = lambda k: F.transform(F.regexp_extract_all(text, search, F.lit(k)), F.length)

    def placed(lengths: Column) -> Column:
        """Of (gap, match, value) lengths."""
        ends = scanned(F.transform(lengths, lambda x: x["gap"] + x["match"]), lambda a, b: a + b)
        spans = F.zip_with(lengths, ends, lambda x, end: F.struct((end - x["match"]).alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["value"].alias("value")))
        kept = F.filter(spans, lambda x: x["value"] >= rule.least) if rule.least else spans
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    parts = F.arrays_zip(part(1).alias("gap"), part(2).alias("match"))
    if rule.group:
        rows = F.zip_with(parts, part(rule.group + 2), lambda x, v: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), v.alias("value")))
    else:
        rows = F.transform(parts, lambda x: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), x["match"].alias("value")))
    return let(rows, placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (with doc_id and text) and one more column `spans`: array of (start, kind, end), kind being the rule's place."""
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q != ANY}
    none = F.array().cast(NO_SPANS)
    whole, own, mask, salt, own_salt, into = unused(["__text", "__id", "__mask", "__salt", "__own_salt", "spans"], docs.columns)
    rows = docs.withColumn(whole, F.coalesce(F.col("text"), F.lit("")))
    if indexed:
        found = save(candidates(postings(docs.select("doc_id", "text"), indexed.values()), indexed), "secret-candidates")
        small = found.count() <= BROADCAST_ROWS
        side = found.select(F.col("doc_id").alias(own), F.col("mask").alias(mask))
        same = F.col("doc_id").eqNullSafe(F.col(own))
        if small:
            rows = rows.join(F.broadcast(side), same, "left").drop(own)
        else:
            rows = rows.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
            side = side.withColumn(own_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.join(side, same & (F.col(salt) == F.col(own_salt)), "left").drop(own, salt, own_salt)
    else:
        rows = rows.withColumn(mask, F.lit(0))
    text, each = F.col(whole), []
    for i, r in enumerate(rules):
        may = F.coalesce(F.col(mask).bitwiseAND(1 << i) != 0, F.lit(False)) if i in indexed else text.rlike(r.pattern)
        each.append(F.when(may, matches(text, r, i)).otherwise(none))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.sort_array(F.concat(*each)).alias(into))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


PAGE = 4096  # characters of the blocks that a text is cut into, as a place in a long one is found from its begin


def redact(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by MASK."""

    def masked(pages: Column, ends: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            """The characters of a..b-1."""
            first, last = F.floor(a / PAGE).cast("int"), F.floor(b / PAGE).cast("int")
            page = lambda k: F.coalesce(F.get(pages, k), F.lit(""))
            inner = F.array_join(F.slice(pages, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            far = F.concat(F.substring(page(first), a % PAGE + 1, F.lit(PAGE)), inner, F.substring(page(last), F.lit(1), b % PAGE))
            return F.when(first == last, F.substring(page(first), a % PAGE + 1, b - a)).otherwise(far)

        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        placed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), before(i).alias("from")))
        parts = F.transform(F.filter(placed, lambda x: x["start"] >= x["from"]), lambda x: F.concat(between(x["from"], x["start"]), F.lit(MASK)))
        return F.concat(F.array_join(parts, ""), between(before(F.size(ends)), F.length(text)))

    whole = let(F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{PAGE}}}"), F.lit(0)), lambda pages: let(scanned(F.transform(spans, lambda s: s["end"]), F.greatest), lambda ends: masked(pages, ends)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = {r.kind: i for i, r in enumerate(RULES) if r.base}
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == base[k])).cast("long")
    return scan(docs).select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < len(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; the stretches that hold secrets are masked (n_chars follows the text)."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text")
    out = scan(own).withColumn("__new", redact(F.col("text"), F.col("spans")))
    now = {"text": F.col("__new"), "n_chars": F.coalesce(F.length("__new").cast("long"), F.col("__row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(now[c] if c in now else F.col("__row").getField(c)).alias(c) for c in docs.columns])
