"""printf with a format of each row; formats that are literals never come here but are Spark expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

DIRECTIVE = re.compile(r"%(?P<flags>[-+ 0,#]*)(?P<width>\d*)(?:\.(?P<prec>\d+))?(?P<conv>[diufFeEgGsxXoc%q])")
_NUMBER = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def _number(text: str | None) -> float | int:
    """The number that a text starts with, or 0."""
    m = _NUMBER.match(text or "")
    if not m:
        return 0
    return int(m[0]) if re.fullmatch(r"\s*[+-]?\d+", m[0]) else float(m[0])


def formatted(form: str, given: list[str | None]) -> str:
    """The format with its directives filled by the arguments in order; missing ones count as NULL (0 or empty)."""
    rest = iter(given)

    def fill(m: re.Match) -> str:
        conv, flags, width, prec = m["conv"], m["flags"], m["width"], m["prec"]
        if conv == "%":
            return "%"
        arg = next(rest, None)
        if conv in "diu":
            comma = "," if "," in flags else ""
            sign = "+" if "+" in flags else " " if " " in flags else ""
            return _wide(format(int(_number(arg)), f"{sign}{comma}d"), flags, width)
        if conv in "fFeEgG":
            return f"%{flags.replace(',', '')}{width}.{prec or 6}{conv}" % float(_number(arg))
        if conv in "xXo":
            return f"%{flags.replace(',', '')}{width}{conv}" % (int(_number(arg)) & (1 << 64) - 1)
        text = arg or ""
        text = text.replace("'", "''") if conv == "q" else text[:1] if conv == "c" else text[: int(prec)] if prec else text
        return text.ljust(int(width or 0)) if "-" in flags else text.rjust(int(width or 0))

    return DIRECTIVE.sub(fill, form)


def _wide(number: str, flags: str, width: str) -> str:
    n = int(width or 0)
    if "-" in flags:
        return number.ljust(n)
    return number.zfill(n) if "0" in flags else number.rjust(n)


def register(spark: SparkSession) -> None:
    """Registers basalt_printf(format, array of arguments as text)."""

    def run(forms: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else formatted(f, list(a)) for f, a in zip(forms, lists)], dtype="object")

    spark.udf.register("basalt_printf", pandas_udf(run, "string"))
