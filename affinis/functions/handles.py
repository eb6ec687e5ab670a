"""Channel handles and result texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinis.functions import constants as C


def normalise_handle(text: Column) -> Column:
    """The handle named in a request: after a site prefix or ``@``, or the bare text; else null."""
    inside = F.regexp_extract(text, C.HANDLE_IN_TEXT, 2)
    alone = F.regexp_extract(text, C.HANDLE_ALONE, 1)
    return F.coalesce(F.nullif(inside, F.lit("")), F.nullif(alone, F.lit("")))


def result_line(link: Column, title: Column, sim: Column | None = None) -> Column:
    """``@link - title (NN%)``; halves round to even."""
    head = F.concat(F.lit("@"), link, F.lit(" - "), title)
    if sim is None:
        return head
    percent = F.bround(sim * 100, 0).cast("bigint").cast("string")
    return F.concat(head, F.lit(" ("), percent, F.lit("%)"))


def subscriber_count(text: Column) -> Column:
    """First run of digits and spaces as a number, -1 when there is none to read."""
    run = F.regexp_extract(text, rf"(?:[0-9]|{C.WS})+", 0)
    digits = F.btrim(F.replace(run, F.lit(" "), F.lit("")), F.lit(C.WS_CHARS))
    number = F.when(digits.rlike("^[0-9]+$"), digits.try_cast("bigint"))
    return F.coalesce(number, F.lit(-1).cast("bigint"))
