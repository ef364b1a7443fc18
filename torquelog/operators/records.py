"""Row projections and filters that prepare asset records and incident claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torquelog.functions import text


def zero_if_null(name: str) -> Column:
    """A count column as long, null as 0."""
    return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")).alias(name)


def cast_strings(df: DataFrame, names: list[str]) -> DataFrame:
    """Cast the named columns to string; nulls stay null."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def split_description(
    df: DataFrame, source: str, names: tuple[str, str, str] = ("serial", "category", "description")
) -> DataFrame:
    """Split ``serial:category:description`` on its first two colons; the category is trimmed."""
    parts = F.split(F.col(source), ":", 3)
    values = [F.get(parts, F.lit(i)) for i in range(3)]
    values[1] = text.strip(values[1])
    return df.withColumns(dict(zip(names, values, strict=True)))


def reconcile_serials(df: DataFrame, first: str, second: str) -> DataFrame:
    """Keep valid 13-digit serials only, each column filled from the other."""
    a, b = text.valid_serial(F.col(first)), text.valid_serial(F.col(second))
    return df.withColumns({first: F.coalesce(a, b), second: F.coalesce(b, a)})


def asset_head(df: DataFrame, counts: list[str], strings: list[str]) -> DataFrame:
    """Asset record head: counts, casts, description split and serials in one projection."""
    df = df.withColumns({n: zero_if_null(n) for n in counts})
    df = split_description(cast_strings(df, strings), "work_description")
    return reconcile_serials(df, "asset_name", "serial")


def equals_ignore_case(name: str, value: str) -> Column:
    return F.upper(F.col(name)) == value.upper()


def starts_with(name: str, prefix: str) -> Column:
    """Not null and starting with ``prefix``; reaches the Parquet scan."""
    return F.col(name).isNotNull() & F.col(name).startswith(prefix)


def starts_with_none(name: str, prefixes: list[str]) -> Column:
    """True unless the value starts with one of the prefixes; null passes."""
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.col(name).startswith(prefix)
    return ~F.coalesce(hit, F.lit(False))


def claims_head(
    df: DataFrame,
    brand: str,
    line_type: str,
    model_prefix: str,
    excluded: tuple[str, ...] = ("NO CAUSAL PART", "No part"),
    lang: str | None = "en",
) -> DataFrame:
    """Row filters of the incident job. Cheap filters come first, the language test last."""
    kept = df.where(
        equals_ignore_case("brand", brand)
        & (F.col("service_line_type") == line_type)
        & starts_with("model", model_prefix)
        & starts_with_none("part_number", list(excluded))
        & starts_with_none("part_description", list(excluded))
        & text.long_digits(F.col("serial_number"))
    )
    return kept if lang is None else kept.where(text.language(F.col("summary")) == lang)


def drop_blank(df: DataFrame, name: str) -> DataFrame:
    return df.where(~text.blank(F.col(name)))


def normalised(name: str) -> Column:
    """Trimmed and lower-cased; blank becomes null."""
    return F.nullif(F.lower(text.strip(F.col(name))), F.lit(""))


def part_label(number: str, description: str, missing: str = "No part needed / no update") -> Column:
    """``number - description``, or a fixed text when both are blank."""
    parts = [F.nullif(text.strip(F.col(c)), F.lit("")) for c in (number, description)]
    label = F.concat_ws(" - ", *parts)
    return F.when(label == "", missing).otherwise(label)


def words_of_all_columns(df: DataFrame, name: str = "word") -> DataFrame:
    """Distinct alphanumeric lower-case words of every cell in every column."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    tokens = F.flatten(
        F.transform(F.array_compact(cells), lambda cell: text.split_space(F.lower(cell)))
    )
    return (
        df.select(F.explode(tokens).alias(name))
        .where(F.col(name).rlike(r"^[\p{L}\p{N}]+\z"))
        .distinct()
    )
