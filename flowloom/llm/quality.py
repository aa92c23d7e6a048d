"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of each text are Spark expressions over the whole text. A random forest of shallow trees is grown on the labelled
rows (Spark ML); each path from a root to a node is a conjunctive rule. A logistic regression with lasso penalty weighs the
rules, most weights become zero, and the rest is compiled into one Spark column expression: no Python runs on scoring.

Training takes all labelled rows of which ``held_out`` is false. Labels, language, source and ``doc_id`` are no inputs.

Null text counts as empty; empty texts get a score like any other (their statistics are 0). Rows with null ``doc_id`` are scored
and never trained on. Several labels for one document count by their mean. Without labels of both kinds there is no model, and
every score is the share of label 1 (1.0 without any label). Repeated rows are scored alike. Other columns pass through.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import new_name, stored

ID_FOLDS, TEST_FOLD = 4, 2
# fixed values: classes of characters that the statistics count
MARKS = "!?"
SYMBOLS = "#$%&*+<=>@\\^_`{|}~/[]"
STOPS = ".,;:"
DIGITS = "0123456789"


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Name and expression of each statistic of a text column."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    words = F.split(F.trim(F.translate(text, "\n\t\r", "   ")), " +")
    lines = F.split(text, "\n", -1)
    n = F.size(words)
    per = lambda x: F.when(size > 0, x / size).otherwise(0.0)
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    return {
        "log_chars": F.log1p(size.cast("double")),
        "log_words": F.log1p(n.cast("double")),
        "word_length": size / n,
        "distinct_pairs": F.size(F.array_distinct(F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)))) / n,
        "upper": per(upper),
        "marks": per(_count(text, MARKS)),
        "symbols": per(_count(text, SYMBOLS)),
        "stops": per(_count(text, STOPS)),
        "digits": per(_count(text, DIGITS)),
        "line_words": n / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "blank": per(size - F.length(F.translate(text, " ", ""))),
    }


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % ID_FOLDS == TEST_FOLD, F.lit(False))


@dataclass
class Model:
    """Rules ``[(name, is_above, limit), ...]`` with their weights, and the weight without any rule."""

    bias: float
    rules: list[tuple[list[tuple[str, bool, float]], float]]

    def column(self) -> Column:
        """Score as an expression over columns of statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def condition(rule: list[tuple[str, bool, float]]) -> Column:
    found = F.lit(True)
    for name, above, limit in rule:
        found = found & ((F.col(name) > limit) if above else (F.col(name) <= limit))
    return found


def memberships(values: Column, names: list[str], rules: list[list[tuple[str, bool, float]]]) -> Column:
    """1.0 or 0.0 for each rule, in their order, from the array ``values`` of the statistics ``names``.

    The rules are one constant that a short expression reads, so the code generated for it does not grow with them.
    """
    tests = json.dumps([[{"at": names.index(name), "above": above, "limit": limit} for name, above, limit in rule] for rule in rules])
    held = F.from_json(F.lit(tests), "array<array<struct<at: int, above: boolean, limit: double>>>")
    return F.transform(held, lambda rule: F.forall(rule, lambda t: (F.get(values, t["at"]) > t["limit"]) == t["above"]).cast("double"))


def tree_rules(text: str, names: list[str]) -> list[list[tuple[str, bool, float]]]:
    """The path to each node below a root, from the printed form of a forest; a rule is kept once."""
    path: list[tuple[int, tuple[str, bool, float]]] = []
    found: dict[tuple, list] = {}
    for line in text.splitlines():
        test = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEeInfa]+)\)", line)
        if not test:
            continue
        depth = len(test[1])
        path = [x for x in path if x[0] < depth] + [(depth, (names[int(test[2])], test[3] == ">", float(test[4])))]
        rule = _tight([x[1] for x in path])
        found[tuple(rule)] = rule
    return list(found.values())


def _tight(rule):
    """One bound for each statistic and side, in a fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, above, limit in rule:
        have = bounds.get((name, above), limit)
        bounds[name, above] = max(have, limit) if above else min(have, limit)
    return [(name, above, limit) for (name, above), limit in sorted(bounds.items())]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text statistics) of each row, written once."""
    stats = statistics(F.col("text"))
    return stored(docs.select("doc_id", *(c.cast("double").alias(n) for n, c in stats.items())))


def fit(stats: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 4, penalty: float = 0.0004, seed: int = 7) -> Model:
    """Grow trees on labelled rows, turn their paths into rules, and weigh the rules."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    names = [c for c in stats.columns if c != "doc_id"]
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    rows = stored(stats.where(~held_out(F.col("doc_id"))).join(marked, "doc_id").select("label", *names, F.array(*names).alias("_values")))
    share = rows.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return Model(math.inf if share is None else math.log(max(share, 1e-9) / max(1 - share, 1e-9)), [])
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, subsamplingRate=0.7, cacheNodeIds=False).fit(vectors)
    rules = tree_rules(forest.toDebugString, names)
    if not rules:
        return Model(math.log(share / (1 - share)), [])
    held = rows.select("label", array_to_vector(memberships(F.col("_values"), names, rules)).alias("_member"))
    held = VectorAssembler(inputCols=["_member"], outputCol="features").transform(held).select("label", "features")  # sparse where that is smaller
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=60).fit(stored(held))
    return Model(float(lasso.intercept), [(rules[i], float(w)) for i, w in enumerate(lasso.coefficients) if abs(w) > 1e-6])


def score(stats: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) from columns of statistics."""
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Rows whose text reaches the threshold, with their own columns only."""
    mark = new_name(docs)
    stats = {mark + n: c.cast("double") for n, c in statistics(F.col("text")).items()}
    named = Model(model.bias, [([(mark + n, a, x) for n, a, x in r], w) for r, w in model.rules])
    # a filter on a generated column is not pushed below the statistics, where each rule would compute them anew
    scored = docs.withColumns(stats).select(*docs.columns, F.explode(F.array(named.column())).alias(mark))
    return scored.where(F.col(mark) >= threshold).select(*docs.columns)
