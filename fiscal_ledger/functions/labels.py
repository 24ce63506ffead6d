"""``code - name`` labels and month names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiscal_ledger import schema as s


def code_name_label(code: Column, name: Column) -> Column:
    """``code - name``; a missing part leaves its side empty, the label is never NULL."""
    blank = F.lit("")
    return F.concat(
        F.coalesce(code.cast("string"), blank), F.lit(s.LABEL_SEPARATOR), F.coalesce(name.cast("string"), blank)
    )


def label_code(label: Column) -> Column:
    """The code in front of a ``code - name`` label."""
    return F.split_part(label, F.lit(s.LABEL_SEPARATOR), F.lit(1))


def month_name(month: Column) -> Column:
    """Spanish month name; NULL for a month outside 1..12."""
    names = F.create_map(*[F.lit(item) for item in chain.from_iterable(s.MONTH_NAMES.items())])
    return F.try_element_at(names, month)
