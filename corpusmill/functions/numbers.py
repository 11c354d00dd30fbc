"""Number columns: rounding with halves to even, as the thresholds are compared after rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int) -> Column:
    """Halves to the even digit, on the decimal digits of a double; NULL stays NULL."""
    return F.bround(c.cast("decimal(38,12)"), digits).cast("double")


def number(c: Column, digits: int = 0, comma: bool = False) -> Column:
    """With so many digits, a decimal comma if asked; a dash for NULL."""
    text = F.bround(c.cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})").cast("string")
    return F.coalesce(F.replace(text, F.lit("."), F.lit(",")) if comma else text, F.lit("—"))


def signed(c: Column, comma: bool = False) -> Column:
    return F.concat(F.when(c > 0, "+").otherwise(""), number(c, 0, comma))


def percent(share: Column, narrow: bool = False) -> Column:
    """A share as percent, with a narrow space before the sign if asked."""
    return F.when(share.isNull(), "—").otherwise(F.concat(number(share * 100), F.lit(" %" if narrow else "%")))
