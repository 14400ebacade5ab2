"""Constants of many items, each handed to Spark in one call instead of one for every item."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str | None) -> str:
    """A SQL literal."""
    return "NULL" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(items: Sequence[str | None]) -> Column:
    return F.expr(f"cast(array({', '.join(map(quoted, items))}) as array<string>)")


def string_map(table: Mapping[str, Sequence[str]]) -> Column:
    """From string to strings."""
    return F.expr(f"map({', '.join(f'{quoted(k)}, array({", ".join(map(quoted, v))})' for k, v in table.items())})")


def number_map(table: Mapping[str, Sequence[int]]) -> Column:
    """From string to ints."""
    return F.expr(f"map({', '.join(f'{quoted(k)}, array({", ".join(map(str, v))})' for k, v in table.items())})")


def among(c: Column, items: Collection[str]) -> Column:
    """c.isin(*items): a look-up in a hashed set, where the items are more than a few."""
    if not items:
        return F.lit(False)
    inner = getattr(c, "_jc", None)
    if inner is None or any("\x1f" in x for x in items) or len(items) < 20:
        return c.isin(*items)
    from pyspark.sql import SparkSession
    from pyspark.sql.classic.column import Column as Classic

    jvm = SparkSession.active()._jvm
    parts = jvm.java.util.regex.Pattern.compile("\x1f").splitAsStream("\x1f".join(sorted(items)))
    return Classic(inner.isInCollection(parts.collect(jvm.java.util.stream.Collectors.toList())))
