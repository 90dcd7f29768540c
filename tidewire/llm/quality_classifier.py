"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Statistics of every document are Spark columns.  A small random forest is fitted on labelled documents; every
path of its trees, from the root to a node, is a conjunction of bounds, a rule.  A lasso logistic regression
over all rules keeps the few that matter and weighs them.  The kept rules are compiled into one Spark column
expression, so scoring is a projection.  Forest and regression are fitted by Spark on all labelled rows that
are not held out; nothing is collected but the fitted model, whose size is set by ``TREES`` and ``DEPTH``.

Defined results: null and empty texts have the statistics of an empty text and a score like any other; documents with a
null id cannot be labelled; several labels of one document all count; without labelled rows, or with labels of one
kind only, the score is the share of label 1 (0.5 without any); repeated rows score alike; an empty table gives an empty
table.  Language, source and id are never inputs; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import log
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tables import BLANK_CLASS, BLANKS, text_of, words
from tidewire.session import written

TREES, DEPTH, SEED = 12, 3, 7
#: Strength of the lasso.
LASSO = 0.002
#: Score from which a document is taken as good.
ACCEPT = 0.3

Rule = tuple[tuple[int, str, float], ...]

FEATURES = (
    "log_words",
    "word_length",
    "upper",
    "digit",
    "symbol",
    "bang",
    "stop",
    "pipe",
    "distinct_words",
    "distinct_lines",
    "line_words",
    "other",
)


def _count(column: str, pattern: str) -> Column:
    return F.length(column) - F.length(F.regexp_replace(column, f"{pattern}+", ""))


def statistics(docs: DataFrame, keep: tuple[str, ...], text_column: str = "text") -> DataFrame:
    """``keep`` and one double column per statistic; no statistic is null."""
    stages = {
        "_text": text_of(text_column),
        "_words": words(F.col("_text")),
        "_lines": F.filter(F.split(F.col("_text"), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
        "_no_lower": F.regexp_replace("_text", r"\p{Ll}+", ""),
        "_rest": F.regexp_replace("_no_lower", f"{BLANK_CLASS}+", ""),
        "_upper": _count("_rest", r"\p{Lu}"),
        "_digit": _count("_rest", r"\p{N}"),
        "_symbol": _count("_rest", "[#*$%&<>@~^=+]"),
        "_bang": _count("_rest", "[!?]"),
        "_stop": _count("_rest", r"[.,;:'\"()-]"),
        "_pipe": _count("_rest", r"[|_\\/{}]"),
    }
    staged = docs.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(text_column))
    for name, column in stages.items():
        staged = staged.withColumn(name, column)
    n_words, n_lines = F.size("_words"), F.size("_lines")
    chars = F.length("_text") - F.length("_no_lower") + F.length("_rest")
    named = F.col("_upper") + F.col("_digit") + F.col("_symbol") + F.col("_bang") + F.col("_stop") + F.col("_pipe")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")

    values = (
        F.log1p(n_words.cast("double")),
        share(chars, n_words),
        *(share(F.col(f"_{x}"), chars) for x in ("upper", "digit", "symbol", "bang", "stop", "pipe")),
        share(F.size(F.array_distinct("_words")), n_words),
        share(F.size(F.array_distinct("_lines")), n_lines),
        share(n_words, n_lines),
        share(F.length("_rest") - named, chars),
    )
    return staged.select(
        *[F.col(f"_keep_{c}").alias(c) for c in keep], *(v.alias(f"stat_{n}") for n, v in zip(FEATURES, values, strict=True))
    )


def _paths(node, so_far: Rule = ()) -> list[Rule]:
    """All conjunctions from the root of a fitted tree to its nodes."""
    found = [so_far] if so_far else []
    if node.subtreeDepth() > 0:
        split = node.split()
        at, bound = split.featureIndex(), split.threshold()
        found += _paths(node.leftChild(), (*so_far, (at, "<=", bound)))
        found += _paths(node.rightChild(), (*so_far, (at, ">", bound)))
    return found


def _merged(rule: Rule) -> Rule:
    """One bound per statistic and side."""
    tightest: dict[tuple[int, str], float] = {}
    for at, side, bound in rule:
        held = tightest.get((at, side), bound)
        tightest[at, side] = min(held, bound) if side == "<=" else max(held, bound)
    return tuple(sorted((at, side, bound) for (at, side), bound in tightest.items()))


def holds(rule: Rule) -> Column:
    """A rule as a Spark condition on the statistics."""
    tests = []
    for at, side, bound in rule:
        column = F.col(f"stat_{FEATURES[at]}")
        tests.append(column <= bound if side == "<=" else column > bound)
    return reduce(and_, tests)


def fit(labelled: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from rows with statistics and ``label`` (0 or 1)."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return _logit(share if counts else 0.5), []
    inputs = VectorAssembler(inputCols=[f"stat_{n}" for n in FEATURES], outputCol="_features")
    data = inputs.transform(labelled).select("_features", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(
        featuresCol="_features", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird"
    ).fit(data)
    rules = sorted({_merged(path) for tree in forest.trees for path in _paths(tree._call_java("rootNode"))})
    if not rules:
        return _logit(counts[1] / sum(counts.values())), []
    marks = [holds(rule).cast("double").alias(f"_rule{i}") for i, rule in enumerate(rules)]
    marked = VectorAssembler(inputCols=[f"_rule{i}" for i in range(len(rules))], outputCol="_rules").transform(
        labelled.select(F.col("label").cast("double").alias("label"), *marks)
    )
    lasso = LogisticRegression(featuresCol="_rules", elasticNetParam=1.0, regParam=LASSO, maxIter=80)
    fitted = lasso.fit(marked.select("label", "_rules"))
    weights = fitted.coefficients.toArray()
    return float(fitted.intercept), [(rule, float(w)) for rule, w in zip(rules, weights, strict=True) if w]


def _logit(share: float) -> float:
    return log(share / (1 - share))


def score_column(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The fitted model as one column expression on the statistics."""
    terms = [F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in rules]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(intercept))))


def held_out(id_column: str) -> Column:
    """Documents whose labels are never used: one in five by id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _model(stats: DataFrame, labels: DataFrame, label_column: str) -> Column:
    """Score column fitted on ``stats`` (with ``doc_id``) and ``labels``."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(label_column).cast("int").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & ~held_out("_id"))
    joined = stats.join(marked, F.col("doc_id") == F.col("_id")).select("label", *(f"stat_{n}" for n in FEATURES))
    return score_column(*fit(written(joined, "training")))


def scored(docs: DataFrame, labels: DataFrame, label_column: str = "quality", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) and the statistics of every document."""
    stats = written(statistics(docs, ("doc_id",), text_column), "statistics")
    score = _model(stats, labels, label_column)
    return stats.select(
        "*", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= ACCEPT).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, label_column: str = "quality", text_column: str = "text") -> DataFrame:
    """The documents that the classifier takes as good, with their own columns."""
    stats = written(statistics(docs, ("doc_id",), text_column), "statistics")
    score = _model(stats, labels, label_column)
    given = statistics(docs, tuple(docs.columns), text_column)  # a projection: texts are not shuffled
    return given.where(score >= ACCEPT).select(docs.columns)
