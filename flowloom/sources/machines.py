"""State machines from DOT files: many files in one job, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import stripped
from ..operators.machine import CLAUSES
from .traces import entity_from_path

# A file is a list of statements, each a head and an optional attribute list in brackets, closed by a semicolon at the end
# of a line. A head is a node number, or two nodes and an arrow. Of the attributes only the quoted label is read.
_CLOSE = r";[ \t\r]*(?:\n|$)"
# a label item of a node: name, number in parentheses, and one number or a bracketed list of numbers
_ITEM = r"([a-z]+)\((\d+)\):(\[[^\]]*\]|\d+)"
# a test on an edge: attribute, comparison, signed decimal number with optional exponent
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_TEST = rf"(?<![\w.+-])(\d+)\s*([<>]=?|==)\s*({_NUMBER})(?![\w.+-])"


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    whole = spark.read.text(paths, wholetext=True)
    path = F.col("_metadata.file_path")
    name = F.regexp_replace(F.element_at(F.split(F.url_decode(path), "/"), -1), r"\.[^.]*$", "")
    return whole.select(name.alias("model_id"), entity_from_path(path).alias("entity"), "value")


def _statements(texts: DataFrame) -> DataFrame:
    """(model_id, at, src, dst, label) of each statement; ``dst`` is NULL for nodes, ``label`` where there is none."""
    # the opening line of the graph and its closing brace belong to no statement
    body = F.regexp_replace("value", r"^[^{\n]*\{", "")
    split = texts.select("model_id", F.posexplode(F.split(body, _CLOSE)).alias("at", "line"))
    head = stripped(F.substring_index("line", "[", 1))
    label = F.substring_index(F.get(F.split("line", 'label="', 2), F.lit(1)), '"', 1)
    ends = F.split(head, r"\s+->\s+", 2)
    return split.select("model_id", "at", F.get(ends, F.lit(0)).alias("src"), F.get(ends, F.lit(1)).alias("dst"),
                        label.alias("label"))


def _named(text: Column) -> Column:
    return F.when(text == "I", "root").otherwise(text)


def read_state_models(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of :func:`parse_state_models`; the model takes the name of its file."""
    return parse_state_models(_files(spark, paths))


def parse_state_models(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(states, bins, transitions)`` of multivariate machines ``(model_id, value)``.

    ``fin`` and ``total`` are final and all visits, ``counts`` the observations
    per quantile. Repeated edges are alternatives of one guard. An edge names its
    own source, so lines need no order.
    """
    lines = _statements(texts)
    nodes = lines.filter(F.col("dst").isNull() & F.col("src").rlike(r"^\d+$") & F.col("label").isNotNull()).select(
        "model_id", F.when(F.col("label") == "root", "root").otherwise(F.col("src")).alias("state"),
        F.arrays_zip(*(F.regexp_extract_all("label", F.lit(_ITEM), F.lit(i)).alias(n) for i, n in enumerate(("kind", "attr", "text"), 1))).alias("items"),
    )
    facts = nodes.select("model_id", "state", F.explode_outer("items").alias("f")).select(
        "model_id", "state", "f.kind", "f.attr", F.filter(F.split(F.translate("f.text", "[] ", ""), ","), lambda v: v != "").alias("v"))

    def last(kind: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("kind") == kind, F.get("v", F.lit(0)).cast("long"))), F.lit(0).cast("long"))

    states = facts.groupBy("model_id", "state").agg(last("fin").alias("fin"), (last("fin") + last("symb")).alias("total"))
    bins = facts.filter(F.col("kind") == "attr").select(
        "model_id", "state", "attr", F.transform("v", lambda x: x.cast("double")).alias("counts")
    )
    edges = lines.filter(F.col("dst").isNotNull()).select("model_id", "at", _named(F.col("src")).alias("src"), "dst", F.coalesce("label", F.lit("")).alias("text"))
    tests = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(_TEST), F.lit(i)).alias(n) for i, n in enumerate("aob", 1)))
    clause = F.transform(tests, lambda c: F.struct(c["a"].cast("int").alias("attr"), c["o"].alias("op"), c["b"].cast("double").alias("bound")))
    # a comparison left over after all tests are taken out would be a guard read wrongly
    rest = F.regexp_replace("text", _TEST, "")
    clause = F.when(rest.rlike("[<>]|=="), F.raise_error(F.concat(F.lit("unread condition: "), rest)).cast(CLAUSES.removeprefix("array<").removesuffix(">"))).otherwise(clause)
    ordered = F.sort_array(F.collect_list(F.struct("at", clause.alias("clause"))))
    transitions = edges.groupBy("model_id", "src", "dst").agg(ordered.alias("_c")).select(
        "model_id", "src", "dst", F.col("_c.clause").cast(CLAUSES).alias("clauses")
    )
    return states, bins, transitions


def read_symbolic_models(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Edges of :func:`parse_symbolic_models`; the model takes the name of its file."""
    return parse_symbolic_models(_files(spark, paths))


def parse_symbolic_models(texts: DataFrame) -> DataFrame:
    """``edges(model_id, src, symbol, dst, cnt)``; of repeated edges the last one counts."""
    edges = _statements(texts).filter(F.col("dst").isNotNull() & F.col("label").isNotNull())
    # a label is a list of symbol:count
    items = F.filter(F.split("label", r"\s+"), lambda x: x.contains(":"))
    pairs = F.transform(items, lambda x: F.struct(F.substring_index(x, ":", 1).alias("symbol"), F.substring_index(x, ":", -1).alias("cnt")))
    rows = edges.select("model_id", "src", "dst", "at", F.posexplode(pairs).alias("k", "p"))
    newest = F.max_by(F.struct("dst", F.col("p.cnt").cast("long").alias("cnt")), F.struct("at", "k"))
    kept = rows.groupBy("model_id", "src", F.col("p.symbol").alias("symbol")).agg(newest.alias("_e"))
    return kept.select("model_id", "src", "symbol", F.col("_e.dst").alias("dst"), F.col("_e.cnt").alias("cnt"))
