"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

AMOUNT = DecimalType(12, 2)
RATE = DecimalType(18, 8)
TEXT_CLOCK = "yyyy-MM-dd HH:mm:ss Z"

# Raw status -> canonical status.
SNAKE_STATUS = {
    "pending": "placed",
    "paid": "paid",
    "partially_refunded": "refunded",
    "refunded": "refunded",
    "voided": "cancelled",
}
PASCAL_STATUS = {
    "Pending": "placed",
    "Unshipped": "paid",
    "Shipped": "paid",
    "Canceled": "cancelled",
    "Refunded": "refunded",
}
# The text feed's states that name no later one.
LIST_OPEN = ("unpaid", "pending")
LIST_PARTS = ("returned", "canceled", "cancelled", "delivered", "shipped")
CANONICAL_STATUS = ("placed", "paid", "refunded", "cancelled")
NO_REVENUE = ("refunded", "cancelled")


def text_clock(c: Column, strict: bool = True) -> Column:
    """Text time with an offset -> instant. Strict raises on malformed text, lenient gives null."""
    return (F.to_timestamp if strict else F.try_to_timestamp)(c, F.lit(TEXT_CLOCK) if not strict else TEXT_CLOCK)


def mapped_status(c: Column, mapping: dict[str, str], default: str = "placed") -> Column:
    """Enumerated map; unknown and null values take the default."""
    groups: dict[str, list[str]] = {}
    for raw, canonical in mapping.items():
        groups.setdefault(canonical, []).append(raw)
    out = None
    for canonical, raws in groups.items():
        out = F.when(c.isin(raws), canonical) if out is None else out.when(c.isin(raws), canonical)
    return out.otherwise(default)


def list_status(c: Column) -> Column:
    """Comma list with a fixed precedence (a fixed value, like the maps), matched by substring: returned, cancelled, paid, else placed."""
    return (
        F.when(c.contains("returned"), "refunded")
        .when(c.contains("canceled") | c.contains("cancelled"), "cancelled")
        .when(c.contains("delivered") | c.contains("shipped"), "paid")
        .otherwise("placed")
    )


def listed_status(c: Column, market: str) -> Column:
    """Whether a market's vocabulary lists a raw value; false for null, so that defaults never hide an unknown value."""
    if market == "lazada":
        known = c.isin(*LIST_OPEN)
        for part in LIST_PARTS:
            known = known | c.contains(part)
    else:
        known = c.isin(*(SNAKE_STATUS if market == "shopify" else PASCAL_STATUS))
    return F.coalesce(known, F.lit(False))


def revenue(status: Column, amount: Column) -> Column:
    return F.when(status.isin(*NO_REVENUE), F.lit(0)).otherwise(amount).cast(AMOUNT)


def row_hash(*cols: Column) -> Column:
    """SHA-256 of a row that keeps nulls apart from empty text and from their neighbours."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\0")) for c in cols]), 256)


def pct_change(before: Column, after: Column) -> Column:
    d = "decimal(38,8)"
    return F.coalesce((after - before).cast(d) / F.nullif(before.cast(d), F.lit(0).cast(d)) * 100, F.lit(0)).cast("decimal(18,4)")
