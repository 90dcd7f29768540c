"""Secret scans by a trigram index.

Every rule is a pattern with a Boolean query over trigrams (runs of three characters after lower-casing)
that any match must satisfy: a disjunction of conjunctions, derived from the pattern
(``trigram_query``).  An inverted index holds, for each trigram that some query names, the ids of the documents
that contain it.  Postings of the trigrams are intersected per document; only documents that satisfy a
rule's query are searched with its pattern.  A rule without a mandatory trigram searches every document.

Only DataFrame functions are used.  The candidates are a written table of ids and rules, so Spark
knows their size before it joins them with the texts.

Defined results: null and empty texts have no spans; null ids are ids of their own; several documents
with one id share candidates (a superset), and are searched each for itself; repeated rows are found alike;
an empty table gives an empty table.  Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tables import text_of
from tidewire.llm.trigram_query import derived
from tidewire.session import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``pattern`` is searched leftmost first without overlaps; matches whose group ``group`` is shorter than
    ``least`` are dropped afterwards.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def query(self) -> tuple[frozenset[str], ...]:
        """Disjunction of sets of trigrams; empty if the pattern demands none: then all texts are searched."""
        return derived(self.pattern)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "password passwd secret token".split()
_NAME = "|".join([*map(_either_case, _NAMES), f"{_either_case('api')}_?{_either_case('key')}"])
#: The base rules, in the order of their names in results.  A run of hexadecimal digits, or of an access id, is matched
#: whole, so its least length may stand in the pattern; a failing assignment takes part of the text and must be found.
BASE = (
    Rule("assign", rf"""({_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)
_BEGIN, _END = "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----END [A-Z ]*PRIVATE KEY-----"
_GAP, _BASE64 = r"[\x09-\x0D\x20\\]", "[A-Za-z0-9+/=]"
_BODY = r"[A-Za-z0-9+/=\x09-\x0D\x20\\]"
_HEADERS = rf"(?:{_GAP}*(?:Proc-Type|DEK-Info): [A-Za-z0-9,-]*){{0,2}}{_GAP}*"
#: A header with its body and END line; without an END line (a key that was cut), with the lines of base64 that follow.
#: A body of more than one line begins with 24 characters of base64, so prose between two such lines is none.  Loops
#: without bounds are over single characters, so that long texts do not recurse.
_PRIVATE_KEY = (
    rf"{_BEGIN}(?:{_HEADERS}{_BASE64}{{24}}{_BODY}*{_END}|{_GAP}*{_BASE64}*{_GAP}*{_END}"
    rf"|{_HEADERS}{_BASE64}{{24}}{_BASE64}*(?:{_BODY}*{_BASE64}{{16}})?(?:{_GAP}+{_BASE64}*\z)?)?"
)
#: Rules that add spans of other kinds.
ADDED = (
    Rule("private_key", _PRIVATE_KEY),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9+/_.=-]{20,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]{3,}@"),
)
RULES = BASE + ADDED


def inverted_index(docs: DataFrame, rules: tuple[Rule, ...], id_column: str, text_column: str) -> DataFrame:
    """Postings (trigram, _id) of the trigrams that the rules ask for."""
    wanted = sorted(set().union(*(part for rule in rules for part in rule.query())))
    lowered = docs.select(F.col(id_column).alias("_id"), F.lower(text_of(text_column)).alias("_text"))
    held = F.filter(
        F.array(*(F.when(F.contains("_text", F.lit(t)), F.lit(t)) for t in wanted)), lambda t: t.isNotNull()
    )
    return lowered.select("_id", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_id, _rules): for every id the rules whose queries the intersected postings satisfy, as an array of kinds."""
    wanted = sorted(set().union(*(part for rule in rules for part in rule.query())))
    place = {t: i for i, t in enumerate(wanted)}
    words = range(-(-len(wanted) // 62))
    bit = F.create_map(*itertools.chain(*((F.lit(t), F.lit(1 << i % 62)) for t, i in place.items())))
    word = F.create_map(*itertools.chain(*((F.lit(t), F.lit(i // 62)) for t, i in place.items())))
    marked = postings.select("_id", bit[F.col("trigram")].alias("_bit"), word[F.col("trigram")].alias("_word"))
    held = marked.groupBy("_id").agg(
        *(F.bit_or(F.when(F.col("_word") == w, F.col("_bit")).otherwise(F.lit(0))).alias(f"_held{w}") for w in words)
    )

    def satisfied(part: frozenset[str]) -> Column:
        tests = []
        for w in words:
            mask = sum(1 << place[t] % 62 for t in part if place[t] // 62 == w)
            if mask:
                tests.append(F.col(f"_held{w}").bitwiseAND(F.lit(mask)) == F.lit(mask))
        return _all(tests)

    kinds = [
        F.when(_any([satisfied(part) for part in rule.query()]), F.lit(rule.kind)) for rule in rules if rule.query()
    ]
    found = held.select("_id", F.filter(F.array(*kinds), lambda k: k.isNotNull()).alias("_rules"))
    return found.where(F.size("_rules") > 0)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _marked(docs: DataFrame, rules: tuple[Rule, ...], id_column: str, text_column: str) -> DataFrame:
    """``docs`` with ``_rules``, the indexed rules that each document must be searched for."""
    none = F.array().cast("array<string>")
    indexed = tuple(rule for rule in rules if rule.query())
    if not indexed:
        return docs.withColumn("_rules", none)
    found = written(candidates(inverted_index(docs, indexed, id_column, text_column), indexed), "candidates")
    found = found.select(F.col("_id").alias("_candidate"), F.col("_rules").alias("_candidate_rules"))
    joined = docs.join(found, F.col(id_column).eqNullSafe(F.col("_candidate")), "left")
    return joined.withColumn("_rules", F.coalesce("_candidate_rules", none)).select(*docs.columns, "_rules")


def _matches(rule: Rule, text: str) -> Column:
    """Struct of a rule's matches, their verdicts and the gaps around them; null if it need not or cannot match."""
    search = F.array_contains("_rules", rule.kind) if rule.query() else F.lit(True)
    if rule.group:
        kept = lambda x: F.length(F.regexp_extract(x, rule.pattern, rule.group)) >= rule.least
    else:
        kept = lambda x: F.length(x) >= rule.least
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    if not rule.query():
        search = F.size(found) > 0
    return F.when(
        search,
        F.struct(
            F.lit(RULE_RANK.get(rule.kind, len(RULE_RANK))).alias("rank"),
            F.lit(rule.kind).alias("kind"),
            found.alias("found"),
            F.transform(found, kept).alias("kept"),
            F.split(text, rule.pattern, -1).alias("gaps"),
        ),
    )


RULE_RANK = {rule.kind: i for i, rule in enumerate(RULES)}

#: Stages over the rules that matched: lengths of each match with the gap before it, their sums by blocks of 64, what
#: lies before each block (summed once, so that very many matches stay cheap), the end of each match, the spans kept.
_STAGES = (
    "transform(_hits, e -> struct(e.rank AS rank, e.kind AS kind, e.kept AS kept,"
    " transform(e.found, x -> length(x)) AS lengths,"
    " transform(e.found, (x, i) -> bigint(length(x) + length(e.gaps[i]))) AS steps))",
    "transform(_hits, e -> struct(e.rank AS rank, e.kind AS kind, e.kept AS kept, e.lengths AS lengths,"
    " transform(sequence(0, (size(e.steps) - 1) div 64), b -> slice(e.steps, int(b * 64 + 1), 64)) AS blocks))",
    "transform(_hits, e -> struct(e.rank AS rank, e.kind AS kind, e.kept AS kept, e.lengths AS lengths, e.blocks AS blocks,"
    " transform(e.blocks, x -> aggregate(x, 0L, (n, y) -> n + y)) AS sums))",
    "transform(_hits, e -> struct(e.rank AS rank, e.kind AS kind, e.kept AS kept, e.lengths AS lengths,"
    " e.blocks AS blocks, aggregate(e.sums, struct(0L AS total, cast(array() AS array<bigint>) AS firsts), (n, x) ->"
    " struct(n.total + x AS total, concat(n.firsts, array(n.total)) AS firsts)).firsts AS firsts))",
    "transform(_hits, e -> struct(e.rank AS rank, e.kind AS kind, e.kept AS kept, e.lengths AS lengths,"
    " flatten(transform(e.blocks, (x, b) -> transform(x, (y, j) ->"
    " e.firsts[b] + aggregate(slice(x, 1, j + 1), 0L, (n, z) -> n + z)))) AS ends))",
    "sort_array(flatten(transform(_hits, e -> filter(zip_with(e.ends, sequence(0, size(e.ends) - 1), (x, i) ->"
    " if(e.kept[i], struct(x - e.lengths[i] AS start, e.rank AS rank, x AS `end`, e.kind AS kind), null)),"
    " x -> x IS NOT NULL))))",
)


def scan(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, rank, end, kind) by start, then in the order of the rules."""
    marked = _marked(docs, rules, id_column, text_column).withColumn("_text", text_of(text_column))
    hits = F.filter(
        F.array(*(_matches(rule, "_text") for rule in rules)), lambda e: e.isNotNull() & (F.size(e["found"]) > 0)
    )
    staged = marked.withColumn("_hits", hits).drop("_text", "_rules")
    for stage in _STAGES:
        staged = staged.withColumn("_hits", F.expr(stage))
    kept = [c for c in docs.columns if c != "secret_spans"]
    return staged.select(*kept, F.col("_hits").alias("secret_spans"))


def digest(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
    mask: str = "[REDACTED]",
) -> DataFrame:
    """``docs`` with every kept match of every rule replaced by ``mask``, one rule after the other.

    Private keys come first, so that no other mask breaks their header.
    """
    staged = _marked(docs, rules, id_column, text_column).withColumn("_text", F.col(text_column))
    for rule in sorted(rules, key=lambda rule: rule.kind != "private_key"):
        staged = staged.withColumn("_hit", _matches(rule, "_text"))
        # One gap more than matches: the text after the last match.
        shown = F.transform(
            F.col("_hit.gaps"),
            lambda gap, i: F.concat(
                gap,
                F.coalesce(F.when(F.get("_hit.kept", i), F.lit(mask)).otherwise(F.get("_hit.found", i)), F.lit("")),
            ),
        )
        hit = F.coalesce(F.exists("_hit.kept", lambda k: k), F.lit(False))
        staged = staged.withColumn("_text", F.when(hit, F.array_join(shown, "")).otherwise(F.col("_text")))
    return staged.withColumn(text_column, F.col("_text")).select(docs.columns)
