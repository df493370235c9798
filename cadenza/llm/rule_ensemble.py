"""Quality classifier: a sparse ensemble of rules.

Shallow trees are grown on statistics of the texts; every path from a root
to a node is a rule, a conjunction of conditions on the statistics. A
logistic regression with lasso penalty weighs the rules, and those left
with a weight are compiled into one Spark column expression. Scoring is
that expression over the statistics of every whole text.

Only the fit uses a sample: at most ``SAMPLE_ROWS`` labelled rows of each
class, none of them held out. Labels, language, source and id are never
inputs.

Defined results: a null or empty text has zero statistics and is scored by
them; without labels of both classes every score is the share of label 1
(0.5 without labels); repeated rows score alike; extra columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.labels import held_out, sample
from cadenza.llm.text_statistics import with_statistics
from cadenza.session import checkpoint

SAMPLE_ROWS = 8_000
TREES, DEPTH = 20, 3
PENALTY = 0.0005
SEED = 5
#: A score from here on predicts label 1.
CUT = 0.3

COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_distinct_words", "n_upper", "n_digits", "n_stops", "longest_word"]


def inputs() -> dict[str, Column]:
    """The statistics (``NAMES``), from counts."""
    def per(a, b):
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {"log_words": F.log1p("n_words"), "word_length": per("word_chars", "n_words"),
            "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
            "repeats": per("n_repeat_words", "n_words"), "distinct": per("n_distinct_words", "n_words"),
            "upper": per("n_upper", "n_chars"), "digits": per("n_digits", "n_chars"),
            "stops": per("n_stops", "n_words"), "longest": F.col("longest_word").cast("double"),
            "line_words": per("n_words", "n_lines")}


NAMES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "stops",
         "longest", "line_words"]

#: A rule: (statistic, is it at most the value, value) for each condition.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, at_most, value in rule:
        out = out & ((F.col(name) <= value) if at_most else (F.col(name) > value))
    return out


def tree_rules(node, path: Rule = ()) -> list[Rule]:
    """Conjunctions of all paths from the root of a fitted tree (its JVM
    node) to any other node."""
    out = [path] if path else []
    if node.subtreeDepth() > 0:
        split = node.split()
        name, value = NAMES[split.featureIndex()], float(split.threshold())
        out += tree_rules(node.leftChild(), path + ((name, True, value),))
        out += tree_rules(node.rightChild(), path + ((name, False, value),))
    return out


def simplified(rule: Rule) -> Rule:
    """One bound of each kind and statistic, in order of name."""
    best: dict[tuple[str, bool], float] = {}
    for name, at_most, value in rule:
        old = best.get((name, at_most), value)
        best[name, at_most] = min(old, value) if at_most else max(old, value)
    return tuple((name, at_most, value) for (name, at_most), value in sorted(best.items()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality",
        text_col: str = "text") -> Ensemble:
    rows = sample(labels, label, SAMPLE_ROWS, ~held_out(id_col), id_col)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col), text).join(F.broadcast(rows), id_col).select("y", "weight", "text")
    rows = with_statistics(rows, ["y", "weight"], COUNTS)
    rows = rows.select(F.col("y").cast("double").alias("label"), "weight",
                       *(c.cast("double").alias(n) for n, c in inputs().items()))
    # the scan and the counts run in as many tasks as the documents ask for; then the bounded
    # sample becomes one sorted partition, so that fits repeat
    rows = checkpoint(checkpoint(rows).coalesce(1).sortWithinPartitions("label", *NAMES))
    sizes = {r["label"]: r["w"] for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    if len(sizes) < 2:
        share = {0.0: 0.0, 1.0: 1.0}.get(next(iter(sizes), None), 0.5)
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Ensemble(math.log(p / (1 - p)), [])
    frame = rows.select("label", "weight", array_to_vector(F.array(*NAMES)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.5, weightCol="weight",
                                    featureSubsetStrategy="sqrt", seed=SEED).fit(frame)
    found = {simplified(r) for t in forest.trees for r in tree_rules(t._java_obj.rootNode())}
    rules = sorted(found)
    if not rules:
        return Ensemble(math.log(sizes[1.0] / sizes[0.0]), [])
    marks = F.array(*(condition(r).cast("double") for r in rules))
    frame = checkpoint(rows.select("label", "weight", array_to_vector(marks).alias("features")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, weightCol="weight",
                               standardization=False, maxIter=60).fit(frame)
    weights = lasso.coefficients.toArray()
    return Ensemble(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w != 0.0])


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row; one pass."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    stats = with_statistics(docs.select(F.col(id_col), text), [id_col], COUNTS)
    rows = stats.withColumns({n: c.cast("double") for n, c in inputs().items()})
    return rows.select(id_col, held_out(id_col).alias("held_out"), model.score().alias("score")) \
        .withColumn("predicted", (F.col("score") >= CUT).cast("int"))
