"""Predicate strings (``field<op>value``) as filter columns, with sort keys and paging.

A field that no column has is looked up in the JSON column ``attrs``, if there is
one. Semantics kept on purpose: operators are looked for in a fixed order, not
by position; a missing value fails every predicate, ``!=`` too; a numeric literal
compares as a number and a value that is no number fails; ``~`` with a numeric
literal matches no scalar.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The order in which operators are looked for, and true words.
OPERATORS = (">=", "<=", "!=", ">", "<", "~", "=")
TRUE_WORDS = ("true", "1", "yes")
NUMBER = re.compile(r"-?\d+(?:\.\d+)?")


class PredicateError(ValueError):
    pass


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: str

    @property
    def numeric(self) -> bool:
        return NUMBER.fullmatch(self.value) is not None


def parse(text: str) -> Predicate:
    for op in OPERATORS:
        at = text.find(op)
        if at > 0:
            return Predicate(text[:at].strip(), op, text[at + len(op) :].strip())
    raise PredicateError(f"no operator in {text!r}")


def field_column(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    for f in df.schema.fields:
        if f.name == name:
            return F.col(f"`{name}`"), f.dataType
    if "attrs" in df.columns:
        if isinstance(df.schema["attrs"].dataType, T.VariantType):
            return F.try_variant_get("attrs", f"$['{name}']", "string"), T.StringType()
        return F.get_json_object("attrs", f"$['{name}']"), T.StringType()
    return F.lit(None).cast("string"), T.StringType()


def _compared(left: Column, op: str, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def condition(df: DataFrame, predicate: Predicate | str) -> Column:
    p = parse(predicate) if isinstance(predicate, str) else predicate
    column, kind = field_column(df, p.field)
    if isinstance(kind, T.ArrayType):
        items = column.cast("array<string>")
        test = {"=": F.array_contains(items, p.value), "!=": ~F.array_contains(items, p.value), "~": F.exists(items, lambda x: F.contains(x, F.lit(p.value)))}.get(p.op, F.lit(False))
    elif isinstance(kind, T.BooleanType):
        wanted = F.lit(p.value.lower() in TRUE_WORDS)
        test = {"=": column == wanted, "!=": column != wanted}.get(p.op, F.lit(False))
    elif p.numeric:
        test = F.lit(False) if p.op == "~" else _compared(column.try_cast("double"), p.op, F.lit(float(p.value)))
    else:
        text = column.cast("string")
        test = F.contains(text, F.lit(p.value)) if p.op == "~" else _compared(text, p.op, F.lit(p.value))
    return F.coalesce(test & column.isNotNull(), F.lit(False)) if isinstance(kind, T.ArrayType) else test


def filtered(df: DataFrame, types: Iterable[str] = (), where: Iterable[str] = ()) -> DataFrame:
    """Types are alternatives, predicates all hold."""
    types = list(dict.fromkeys(types))
    if types:
        df = df.where(F.col("type").isin(*types))
    for text in where:
        df = df.where(condition(df, text))
    return df


def sort_keys(df: DataFrame, field: str | None = None, descending: bool = False, tie: str = "id") -> list[Column]:
    """Missing last; numbers before texts; ties by id, which a descending sort reverses as well."""
    if field is None:
        return [F.col(tie).asc()]
    column, kind = field_column(df, field)
    number = column.cast("int").cast("double") if isinstance(kind, T.BooleanType) else (F.lit(None).cast("double") if isinstance(kind, T.ArrayType) else column.try_cast("double"))
    text = F.when(number.isNull(), column.cast("string"))
    if not descending:
        return [column.isNull().asc(), number.asc_nulls_last(), text.asc(), F.col(tie).asc()]
    return [column.isNull().asc(), number.desc_nulls_last(), text.desc(), F.when(column.isNull(), F.col(tie)).asc(), F.col(tie).desc()]


def ranked(df: DataFrame, keys: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """The page of a sort with its ``rank`` from 1, as a top-k plan where there is a limit.

    Only the page is numbered, so the single-partition window never holds more than it.
    """
    page = df.orderBy(*keys)
    if offset:
        page = page.offset(offset)
    if limit is not None:
        page = page.limit(limit)
    return page.withColumn("rank", (F.row_number().over(Window.orderBy(*keys)) + offset).cast("long"))


def truncated(total: int, limit: int | None, offset: int = 0) -> bool:
    return limit is not None and total > offset + limit


def truncated_column(total: Column, limit: int | None, offset: int = 0) -> Column:
    """``truncated`` of a column of totals."""
    return F.lit(False) if limit is None else total > offset + limit


def grouped(df: DataFrame, field: str) -> DataFrame:
    """group, n: counts by a field's text; missing values form the group ``_missing``."""
    column, _ = field_column(df, field)
    return df.groupBy(F.coalesce(column.cast("string"), F.lit("_missing")).alias("group")).agg(F.count(F.lit(1)).alias("n"))


def grouped_with_total(df: DataFrame, field: str) -> DataFrame:
    """``grouped`` and a row ``_total``."""
    column, _ = field_column(df, field)
    keyed = df.select(F.coalesce(column.cast("string"), F.lit("_missing")).alias("group"))
    return keyed.rollup("group").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("group", F.lit("_total")).alias("group"), "n")
