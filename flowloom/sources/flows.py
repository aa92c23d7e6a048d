"""Flow files of four layouts, and the label-partitioned store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scalar import stripped


@dataclass(frozen=True)
class Layout:
    """Kept positions of a comma-separated file, their names, and how dates are written."""

    width: int
    columns: dict[int, str]
    date_formats: tuple[str, ...]
    header: bool = True
    null: str | None = None
    encoding: str = "UTF-8"


def _named(positions, names: str) -> dict[int, str]:
    return dict(zip(positions, names.split()))


# Column positions, names and date formats of the public data sets.
LAYOUTS = {
    "ctu_uni": Layout(
        13,
        _named([*range(8), 9, 10, 12],
               "date duration protocol src_ip src_port dst_ip dst_port flags packets bytes label"),
        ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",),
    ),
    "ctu_bi": Layout(
        15,
        _named([*range(9), *range(11, 15)],
               "date duration protocol src_ip src_port direction dst_ip dst_port state packets bytes src_bytes label"),
        ("yyyy/MM/dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",),
    ),
    "unsw": Layout(
        49,
        _named([*range(9), *range(11, 14), 16, 17, 28, 29, 47, 48],
               "src_ip src_port dst_ip dst_port protocol state duration src_bytes dst_bytes missed_src_bytes "
               "missed_dst_bytes service src_packets dst_packets date end_date detailed_label label"),
        ("epoch",),
        header=False,
        null="-",
    ),
    "cicids": Layout(
        85,
        _named([*range(1, 12), 84],
               "src_ip src_port dst_ip dst_port protocol date duration total_fwd_packets total_bwd_packets "
               "src_bytes dst_bytes label"),
        ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm"),
        encoding="ISO-8859-1",
    ),
}

TEXT_COLUMNS = (
    "date duration protocol src_ip src_port dst_ip dst_port flags tos packets bytes flows label".split()
)


def parse_date(column: Column, formats: tuple[str, ...]) -> Column:
    """First format that fits; ``epoch`` stands for seconds since 1970."""
    if formats == ("epoch",):
        return F.timestamp_seconds(column.try_cast("double"))
    return F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in formats])


def _lines(spark: SparkSession, path: str | list[str], layout: Layout, header: bool) -> DataFrame:
    """All fields as text with the true field count; the extra column catches long lines."""
    names = [f"c{i}" for i in range(layout.width + 1)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]])
    reader = spark.read.schema(schema).options(
        header=str(header).lower(), enforceSchema="true", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt",
        encoding=layout.encoding,
    )
    if layout.null is not None:
        reader = reader.option("nullValue", layout.null)
    return reader.csv(path)


def read_flows(
    spark: SparkSession, path: str | list[str], layout: str, header: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(flows, rejects)`` of one layout.

    Short lines are filled with NULL; lines with too many fields are rejects and
    keep their text. ``header`` overrides the layout for files that differ.
    """
    rules = LAYOUTS[layout]
    lines = _lines(spark, path, rules, rules.header if header is None else header)
    too_long = F.col(f"c{rules.width}").isNotNull()
    columns = [F.col(f"c{i}").alias(n) for i, n in rules.columns.items()]
    kept = lines.filter(~too_long).select(*columns)
    dates = {n: parse_date(F.col(n), rules.date_formats) for n in ("date", "end_date") if n in kept.columns}
    numbers = {"duration": F.col("duration").try_cast("double")}
    if layout == "unsw":
        numbers["label"] = F.col("label").try_cast("int")
    rejects = lines.filter(too_long).select(F.coalesce(F.col("_corrupt"), F.concat_ws(",", *[f"c{i}" for i in range(rules.width + 1)])).alias("line"))
    return kept.withColumns({**dates, **numbers}), rejects


def read_netflow_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whitespace-separated unidirectional records; the first line of a file is its title.

    Addresses carry their port after the last colon, so IPv6 addresses stay whole.
    """
    lines = spark.read.text(path).select(F.split(stripped("value"), r"\s+").alias("t"))
    t = [F.get("t", F.lit(i)) for i in range(14)]
    body = lines.filter(t[0].rlike(r"^\d"))
    whole = F.concat_ws(" ", t[0], t[1])

    def address(token):
        return F.when(token.contains(":"), F.regexp_extract(token, r"^(.*):[^:]*$", 1)).otherwise(token)

    def port(token):
        return F.regexp_extract(token, r":(\d+)$", 1).try_cast("int")

    values = [
        parse_date(whole, LAYOUTS["ctu_uni"].date_formats), t[2].try_cast("double"), t[3], address(t[4]), port(t[4]),
        address(t[6]), port(t[6]), *t[7:14],
    ]
    return body.select(*[v.alias(n) for v, n in zip(values, TEXT_COLUMNS)])


def write_label_store(flows: DataFrame, path: str) -> None:
    """Flows partitioned by ``label_class`` and sorted by time inside each file."""
    flows.sortWithinPartitions("label_class", "date_us").write.mode("overwrite").partitionBy("label_class").parquet(path)


def read_label_store(spark: SparkSession, path: str, classes: list[str] = ("benign", "anomalous")) -> DataFrame:
    """Union of the wanted classes; the others are pruned by partition."""
    return spark.read.parquet(path).filter(F.col("label_class").isin(*classes))
