"""JSON text built from a column's schema: spaced, and with sorted keys."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


#: What JSON text has escapes for; U+FFFD stands for bytes that are no UTF-8.
_ESCAPED = r'["\\\x00-\x1F\x{FFFD}]'


def json_text(c: Column, kind: DataType, ordered: bool = False) -> Column:
    """A value as JSON with a blank after : and , between members, nulls written.

    With ``ordered`` the keys of structs and maps are sorted at every level, also inside
    arrays and maps. Text is built member by member in one pass, whatever its length; a
    null value is ``null``.
    """
    if isinstance(kind, StructType):
        names = sorted(kind.names) if ordered else kind.names
        members = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ": "), json_text(c[n], kind[n].dataType, ordered)) for n in names]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_text(x, kind.elementType, ordered)), ", "), F.lit("]"))
    elif isinstance(kind, MapType):
        entries = F.map_entries(c)
        if ordered:  # by key alone: values need not be comparable
            keys = F.array_sort(F.map_keys(c))
            entries = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(c, k).alias("value")))

        def member(e: Column) -> Column:
            return F.concat(json_text(e["key"].cast("string"), StringType(), ordered), F.lit(": "), json_text(e["value"], kind.valueType, ordered))

        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, member), ", "), F.lit("}"))
    else:
        whole = F.to_json(F.array(c), {"ignoreNullFields": "false"})
        text = F.substring(whole, F.lit(2), F.length(whole) - 2)
        if isinstance(kind, StringType):  # few texts need the JSON writer
            text = F.when(c.rlike(_ESCAPED), text).otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    return F.when(c.isNotNull(), text).otherwise("null")


def row_text(schema: StructType, columns: list[str] | None = None, ordered: bool = False) -> Column:
    """A row, or some of its columns, as JSON."""
    names = columns or schema.names
    some = StructType([schema[n] for n in names])
    return json_text(F.struct(*[F.col("`" + n.replace("`", "``") + "`") for n in names]), some, ordered)
