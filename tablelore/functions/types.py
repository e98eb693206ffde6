"""Schema tests and typed helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from . import fixed


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_exact_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, (T.IntegralType, T.DecimalType))


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, T.FractionalType) and not isinstance(dt, T.DecimalType)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dt: T.DataType) -> bool:
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return True
    return dt.simpleString().startswith("time(")


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.StructType, T.MapType, T.VariantType))


def is_orderable(dt: T.DataType) -> bool:
    """True when min/max and comparison are defined and worth reporting."""
    return not is_nested(dt) and not isinstance(dt, (T.BinaryType, T.CalendarIntervalType))


def ref(name: str) -> Column:
    """Column by exact name; dots in names stay part of the name."""
    return F.col(sql_name(name))


def sql_name(name: str) -> str:
    """The name as it is written in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(name: str, dt: T.DataType) -> str:
    """SQL for the readable text form of any value."""
    if isinstance(dt, T.BinaryType):
        return f"hex({sql_name(name)})"
    if is_nested(dt):
        return f"to_json({sql_name(name)})"
    return f"cast({sql_name(name)} as string)"


def sql_length(name: str, dt: T.DataType) -> str:
    """SQL for the length of the text form; binary values count bytes."""
    if isinstance(dt, T.BinaryType):
        return f"length({sql_name(name)})"
    return f"length({sql_text(name, dt)})"


def sql_number(name: str, dt: T.DataType) -> str:
    """SQL for the value as a finite double; NaN and infinities become null."""
    number = f"cast({sql_name(name)} as double)"
    if is_floating(dt):
        return f"if(abs({number}) < double('infinity'), {number}, null)"
    return number


def sql_struct(fields: dict[str, str]) -> str:
    """SQL for a struct of named expressions."""
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def as_text(name: str, dt: T.DataType) -> Column:
    return F.expr(sql_text(name, dt))


def as_number(name: str, dt: T.DataType) -> Column:
    return F.expr(sql_number(name, dt))


def bare_type(type_text: Column) -> Column:
    """Type name without its parameters: ``decimal(18,4)`` is ``decimal``."""
    return F.trim(F.regexp_replace(type_text, r"\(.*\)", ""))


def type_family(type_text: Column) -> Column:
    name = F.trim(F.element_at(F.split(F.lower(type_text), r"\("), 1))
    return (
        F.when(name.isin(*fixed.NUMERIC_FAMILY), F.lit("numeric"))
        .when(name.isin(*fixed.TEXT_FAMILY), F.lit("text"))
        .otherwise(name)
    )


def is_text_type(type_text: Column) -> Column:
    return contains_any(F.upper(type_text), fixed.TEXT_TYPE_WORDS)


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | F.contains(c, F.lit(word))
    return test


def ends_with_any(c: Column, words: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | F.endswith(c, F.lit(word))
    return test
