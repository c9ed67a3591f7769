"""Exact integer arithmetic for sums and squares that outgrow 64 bits, as SQL expression text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def decimal(value: str, digits: int = 38) -> str:
    return f"CAST({value} AS DECIMAL({digits},0))"


def square_limbs(value: str, base: int = 1_000_000) -> dict[str, str]:
    """The three parts of value^2 over ``base`` digits; each sums safely in a bigint for 2^22 rows."""
    high, low = f"({value} div {base})", f"({value} % {base})"
    return {"hh": f"{high} * {high}", "hl": f"{high} * {low}", "ll": f"{low} * {low}"}


def join_limbs(hh: str, hl: str, ll: str, base: int = 1_000_000) -> str:
    """Sum of squares as decimal(38,0) from the summed parts."""
    return decimal(
        f"{decimal(hh, 20)} * {base * base}BD + {decimal(hl, 20)} * {2 * base}BD + {decimal(ll, 20)}"
    )


def add_int_std(df: DataFrame, spreads: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Add floor(sqrt((square_sum - floor(total^2 / n)) / (n - 1))), integer divisions, 0 for n < 2.

    ``spreads`` maps an output column to its (square_sum, total, n) columns: a decimal(38,0) and two
    bigints. total^2 / n is split into quotient and remainder of total / n, so no product leaves 38
    digits. The last division may not fit a bigint, so ``div`` is no use there: divide as decimals,
    floor, and step back where the decimal quotient was rounded up. One projection per step, so
    that no step's expression is copied into the next.
    """
    def whole(total, n):
        return f"{total} div greatest({n}, 1)"

    def spread(square_sum, total, n, name):
        rest = f"{decimal(f'{total} - {name}_q * {n}', 19)} * {decimal(total, 19)}"
        split = f"{decimal(f'{name}_q', 19)} * {decimal(total, 19)}"
        return f"{square_sum} - {decimal(split)} - {decimal(f'({rest}) div {decimal(f'greatest({n}, 1)', 19)}')}"

    def last(name, n):
        return f"{decimal(f'greatest({n} - 1, 1)', 18)}"

    df = df.selectExpr("*", *[f"{whole(t, n)} AS {o}_q" for o, (_, t, n) in spreads.items()])
    df = df.selectExpr("*", *[f"{decimal(spread(s, t, n, o))} AS {o}_d" for o, (s, t, n) in spreads.items()])
    df = df.selectExpr("*", *[
        f"{decimal(f'floor({o}_d / {last(o, n)})')} AS {o}_v" for o, (_, _, n) in spreads.items()])
    return df.selectExpr("*", *[
        f"CASE WHEN {n} > 1 THEN CAST(floor(sqrt(CAST({o}_v - CASE WHEN {o}_v * {last(o, n)} > {o}_d"
        f" THEN 1 ELSE 0 END AS DOUBLE))) AS BIGINT) ELSE 0L END AS {o}"
        for o, (_, _, n) in spreads.items()])
