"""Quality rules by distribution divergence.

The histogram of character classes and the histogram of common words of a document are compared
with references of its language by Jensen-Shannon distance.  The references are averages over all
documents of the language that are long enough, as the table names languages; a language needs no
list of its own, since common words of several languages are counted for every document.  A
document is rejected if it repeats itself or is too short (the base rules), or if a distance is
above its limit and the document has enough words for that histogram to mean something.

Only DataFrame functions are used.  Repeated windows are found within the row by sorting 64-bit hashes
of windows, so no words are shuffled; references have one row per language.

Defined results: null and empty texts have no words and fail the base rules; a null language has
its own reference; a language without a long enough document has no reference and its documents are
judged by the base rules alone; repeated rows are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tables import BLANK_CLASS, BLANKS, text_of, words
from tidewire.session import written

#: Words that are common in running text (fixed values).
COMMON = (
    "the of and to in is that it for was "
    "der die und das von zu nicht ein mit sich "
    "de la le les et un une en que est "
    "el y los del se las por con para su"
).split()
#: Character classes after lower-case letters, as patterns.
CLASSES = (r"\p{L}", r"\p{N}", r"[.,;:?'\"()-]", "[#*$%&|<>]", "[!@=+~^_{}/]")
SYMBOLS = 3
#: A document needs this many words for the base rules, for a comparison of characters, and of common words.
MIN_WORDS, MIN_WORDS_CHARS, MIN_WORDS_COMMON = 50, 50, 100
#: Largest distances (0 to 1): no labelled good document of 50 words or more was above them, most bad ones were.
MAX_CHARS, MAX_COMMON = 0.28, 0.28
#: Shares are whole numbers of this unit while they are summed, so that sums do not depend on their order.
UNIT = 10**9


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), text_column: str = "text") -> DataFrame:
    """The columns ``keep`` with base statistics and the two histograms, ``_chars`` and ``_common``.

    Repeated words are those in 3-word windows found twice or more: in order of place, each such window adds
    the words since the one before, at most three.
    """
    stages = {
        "_text": text_of(text_column),
        "_words": words(F.col("_text")),
        "_hashes": F.expr(
            "CASE WHEN size(_words) < 3 THEN array() ELSE"
            " transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"
        ),
        # Only documents with a window that occurs again sort their windows.
        "_sorted": F.expr(
            "CASE WHEN size(array_distinct(_hashes)) = size(_hashes) THEN array()"
            " ELSE sort_array(transform(_hashes, (x, i) -> struct(x AS h, i AS i))) END"
        ),
        "_again": F.expr(
            "sort_array(transform(filter(_sorted, (x, k) -> (k > 0 AND _sorted[k - 1].h = x.h)"
            " OR (k < size(_sorted) - 1 AND _sorted[k + 1].h = x.h)), x -> x.i))"
        ),
        "_lines": F.filter(F.split(F.col("_text"), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
        "_listed": F.filter("_words", lambda x: x.isin(COMMON)),
        "_no_lower": F.regexp_replace("_text", r"\p{Ll}+", ""),
        "_rest": F.regexp_replace("_no_lower", f"{BLANK_CLASS}+", ""),
        "_counts": F.array(*(_count("_rest", pattern) for pattern in CLASSES)),
    }
    staged = docs.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(text_column))
    for name, column in stages.items():
        staged = staged.withColumn(name, column)
    lower = (F.length("_text") - F.length("_no_lower")).cast("long")
    other = F.length("_rest") - F.aggregate("_counts", F.lit(0).cast("long"), lambda n, x: n + x)
    listed = F.transform(
        F.array(*map(F.lit, COMMON)),
        lambda c: (F.size("_listed") - F.size(F.array_remove(F.col("_listed"), c))).cast("long"),
    )
    unlisted = (F.size("_words") - F.size("_listed")).cast("long")
    repeated = F.expr(
        "aggregate(_again, struct(-3 AS last, 0L AS n),"
        " (s, i) -> struct(i AS last, s.n + least(3, i - s.last) AS n), s -> s.n)"
    )
    return staged.select(
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        F.size("_words").cast("long").alias("n_words"),
        (lower + F.length("_rest")).cast("long").alias("word_chars"),
        F.col("_counts")[SYMBOLS].alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.concat(F.array(lower, other), F.col("_counts")).alias("_chars"),
        F.concat(F.array(unlisted), listed).alias("_common"),
    )


def _count(column: str, pattern: str) -> Column:
    return (F.length(column) - F.length(F.regexp_replace(column, f"{pattern}+", ""))).cast("long")


def _with_shares(stats: DataFrame) -> DataFrame:
    """Both histograms as shares of their sums, in ``_share_chars`` and ``_share_common``."""
    for name in ("_chars", "_common"):
        total = F.aggregate(name, F.lit(0).cast("long"), lambda n, x: n + x)
        share = F.transform(name, lambda x: F.when(F.col("_total") > 0, x / F.col("_total")).otherwise(F.lit(0.0)))
        stats = stats.withColumn("_total", total).withColumn(f"_share{name}", share).drop("_total")
    return stats


def references(stats: DataFrame, language: str = "lang") -> DataFrame:
    """One row per language: the mean histograms of its documents that are long enough, each document with equal weight."""
    sums = []
    for name, size, least in (
        ("_chars", 2 + len(CLASSES), MIN_WORDS_CHARS),
        ("_common", 1 + len(COMMON), MIN_WORDS_COMMON),
    ):
        share = F.col(f"_share{name}")
        enough = F.col("n_words") >= least
        for k in range(size):
            sums.append(F.sum(F.when(enough, F.floor(share[k] * UNIT))).alias(f"{name}{k}"))
    summed = stats.groupBy(F.col(language).alias("_language")).agg(*sums)
    by_name = {
        "_ref_chars": [F.col(f"_chars{k}") for k in range(2 + len(CLASSES))],
        "_ref_common": [F.col(f"_common{k}") for k in range(1 + len(COMMON))],
    }
    for name, parts in by_name.items():
        total = sum(parts[1:], parts[0])
        summed = summed.withColumn(name, F.when(total > 0, F.array(*(c / total for c in parts))))
    return summed.select("_language", *by_name)


def distance(shares: str, reference: str) -> Column:
    """Jensen-Shannon distance (base 2, between 0 and 1) of shares from reference shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(shares, reference, lambda p, q: (part(p, q) + part(q, p)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda n, x: n + x)))


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), language: str = "lang", text_column: str = "text") -> DataFrame:
    """``keep`` with base statistics, ``base_failed``, both distances (null: not compared) and ``kept``."""
    columns = tuple(dict.fromkeys((*keep, language)))
    stats = _with_shares(written(measured(docs, columns, text_column), "histograms"))
    means = written(references(stats, language), "references")  # known size: Spark broadcasts it if it is small
    judged = stats.join(means, F.col(language).eqNullSafe(F.col("_language")), "left")
    chars = F.when(F.col("n_words") >= MIN_WORDS_CHARS, distance("_share_chars", "_ref_chars"))
    common = F.when(F.col("n_words") >= MIN_WORDS_COMMON, distance("_share_common", "_ref_common"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    far = F.coalesce(F.col("chars_distance") > MAX_CHARS, F.lit(False)) | F.coalesce(
        F.col("common_distance") > MAX_COMMON, F.lit(False)
    )
    return (
        judged.select(*keep, *base, failed.alias("base_failed"), chars.alias("chars_distance"), common.alias("common_distance"))
        .withColumn("kept", ~F.col("base_failed") & ~far)
    )
