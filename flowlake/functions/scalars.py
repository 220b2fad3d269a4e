"""Scalar expressions; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# TCP flag masks and protocol numbers.
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16
TCP, UDP, ICMP = 6, 17, 1


def name(column: str) -> Column:
    """Column reference that keeps dots and spaces in ``column`` literal."""
    return F.col("`" + column.replace("`", "``") + "`")


def number(text: Column) -> Column:
    """Text to double, unreadable text to null.

    The cast alone would read the Java suffixes in ``'1d'`` and ``'1f'`` as numbers.
    """
    t = text.cast("string")
    return F.when(~t.rlike(r"[0-9.]\s*[dDfF]\s*$"), t.try_cast("double"))


def is_infinite(x: Column) -> Column:
    return F.abs(x.cast("double")) == F.lit(float("inf"))


def is_finite(x: Column) -> Column:
    """False for null, NaN and both infinities (NaN sorts above infinity)."""
    return F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))


def finite_or_null(x: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def finite(x: Column, default: float = 0.0) -> Column:
    """``x`` as double with null, NaN and infinities replaced."""
    return F.coalesce(finite_or_null(x.cast("double")), F.lit(float(default)))


def ratio(num: Column, den: Column) -> Column:
    """Quotient that is 0 where it is undefined."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def ms_to_us(x: Column) -> Column:
    return finite(x) * 1000.0


def iso_utc(epoch_s: Column) -> Column:
    """Epoch seconds to ``yyyy-mm-ddThh:mm:ssZ`` (session time zone UTC)."""
    return F.date_format(F.timestamp_seconds(epoch_s), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def proto_name(proto: Column) -> Column:
    return (F.when(proto == TCP, F.lit("TCP")).when(proto == UDP, F.lit("UDP"))
            .when(proto == ICMP, F.lit("ICMP")).otherwise(proto.cast("string")))


def has_flag(flags: Column, mask: int) -> Column:
    return F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(mask)) != 0


def tcp_header_bytes(proto: Column, dataofs: Column) -> Column:
    """Header length of the transport layer as counted for TCP; 0 for UDP."""
    words = F.when(F.coalesce(dataofs, F.lit(0)) != 0, dataofs * 4).otherwise(F.lit(20))
    return F.when(proto == TCP, words).otherwise(F.lit(0))


def payload_bytes(proto: Column, ip_len: Column, ip_ihl: Column, dataofs: Column,
                  udp_len: Column) -> Column:
    tcp = ip_len - ip_ihl * 4 - tcp_header_bytes(proto, dataofs)
    return F.greatest(F.when(proto == TCP, tcp).otherwise(udp_len - 8), F.lit(0))


def safe_label(label: str) -> str:
    """Class label as the tail of a column name."""
    return label.replace(" ", "_").replace("/", "_")


def top_entries(probabilities: Column, n: int = 2) -> Column:
    """The ``n`` largest entries of a map, largest first, equal values by key."""
    def order(a: Column, b: Column) -> Column:
        return (F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
                .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))

    return F.slice(F.array_sort(F.map_entries(probabilities), order), 1, n)
