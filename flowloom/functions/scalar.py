"""Row-wise expressions. All are built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Protocol list of the bidirectional layout, in code order.
BIDIRECTIONAL_PROTOCOLS = ["udp", "tcp", "icmp", "arp", "igmp", "rtp", "pim", "rtcp", "udt", "ipv6"]


def code_from_list(column: str | Column, values: list[str]) -> Column:
    """Position in a fixed list, -1 if absent."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), c).cast("int") - 1, F.lit(-1))


def port_number(column: str) -> Column:
    """Port text to int: hexadecimal when it holds an ``x``, -1 when missing."""
    c = F.col(column).cast("string")
    digits = F.regexp_replace(F.lower(c), "^0x", "")
    return F.coalesce(F.when(c.contains("x"), F.conv(digits, 16, 10).try_cast("int")).otherwise(c.try_cast("int")), F.lit(-1))


def percentile_bin(value: Column, limits: Column | list[float]) -> Column:
    """Index of the first limit that is not below the value; the number of limits if none."""
    if isinstance(limits, list):
        limits = F.array(*[F.lit(float(p)) for p in limits])
    return F.size(F.filter(limits, lambda p: p < value.cast("double"))).cast("int")


def list_index(value: Column, seen: Column | list) -> Column:
    """Position in the list of seen values; the length of the list if absent."""
    if isinstance(seen, list):
        seen = F.array(*[F.lit(v) for v in seen])
    at = F.array_position(seen, value)
    return F.when(at > 0, at - 1).otherwise(F.size(seen)).cast("int")


def mixed_radix_code(digits: list[Column], sizes: list[int]) -> Column:
    """One integer from several bin indices; ``sizes`` counts the bins of each feature."""
    code, place = F.lit(0).cast("long"), 1
    for digit, size in zip(reversed(digits), reversed(sizes)):
        code, place = code + digit.cast("long") * F.lit(place).cast("long"), place * size
    return code


def alphabet_size(limit_counts: list[int]) -> int:
    size = 1
    for n in limit_counts:
        size *= n + 1
    return size


def record_text(values: list[Column], ints: bool = True) -> Column:
    """Comma-joined record; numbers are truncated to integers unless ``ints`` is off."""
    kind = "long" if ints else "double"
    return F.concat_ws(",", *[v.cast(kind).cast("string") for v in values])


def record_values(text: Column) -> Column:
    """Inverse of :func:`record_text`."""
    return F.transform(F.split(text, ","), lambda t: t.cast("double"))


def writes_ints(features: list[str], aggregated: bool = False) -> bool:
    """Traces hold integers unless they are aggregated or contain a duration."""
    return "duration" not in features and not (aggregated and "encoding" not in features)


def stripped(column: str | Column) -> Column:
    """Text without white space at its ends, tabs included."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def connection_key(src: str = "src_ip", dst: str = "dst_ip") -> Column:
    return F.concat_ws("-", F.col(src), F.col(dst))


def method_name(column: str | Column) -> Column:
    """Last ``_`` token of a model name without a trailing hyphen."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.element_at(F.split(c, "_"), -1), "-$", "")


def malicious(layout: str, column: str = "label") -> Column:
    """0/1 label of a flow by dataset layout."""
    c = F.col(column)
    tests = {
        "ctu_uni": c.contains("Botnet"),
        "ctu_bi": c.contains("Botnet"),
        "iot": c.contains("Malicious"),
        "unsw": c.cast("int") == 1,
        "cicids": c != "BENIGN",
    }
    return tests[layout].cast("int")


def label_class(layout: str, column: str = "label", keep_background: bool = False) -> Column:
    """``benign``, ``anomalous``, ``background`` or NULL.

    With ``keep_background`` the bidirectional layout counts everything that is
    not botnet traffic as benign.
    """
    c = F.col(column)
    if layout == "ctu_uni":
        return F.when(c == "Botnet", "anomalous").when(c == "LEGITIMATE", "benign").when(c == "Background", "background")
    if layout == "ctu_bi":
        anomalous = F.when(c.contains("From-Botnet"), "anomalous")
        if keep_background:
            return anomalous.when(~c.contains("Botnet"), "benign")
        return anomalous.when(c.contains("From-Normal"), "benign").when(c.contains("Background"), "background")
    if layout == "unsw":
        return F.when(c.cast("int") == 1, "anomalous").when(c.cast("int") == 0, "benign")
    return F.when(c == "BENIGN", "benign").otherwise("anomalous")


def within(start_us: int | Column, end_us: int | Column, column: str = "date_us") -> Column:
    """Closed time interval."""
    return F.col(column).between(start_us, end_us)
