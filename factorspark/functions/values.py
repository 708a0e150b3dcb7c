"""Column expressions: type coercion, missing values and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange codes and their source-side suffixes.
EXCHANGES = ("SH", "SZ", "BJ")
SOURCE_SUFFIX_TO_EXCHANGE = {"XSHG": "SH", "XSHE": "SZ", "XBEI": "BJ"}

# Fixed value: share of a cash dividend kept after tax.
DIVIDEND_AFTER_TAX_RATIO = 0.9


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """Double value with NaN and the infinities turned into null."""
    number = as_column(value).cast("double")
    return F.when(
        ~F.isnan(number) & (number > F.lit(float("-inf"))) & (number < F.lit(float("inf"))), number
    )


def is_finite(value: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    return finite(value).isNotNull()


def ieee_ratio(above: Column, below: Column) -> Column:
    """Quotient of two doubles; over zero it is infinite, and NaN for zero or NaN over zero."""
    infinite = F.lit(float("inf"))
    over_zero = F.when(F.isnan(above) | (above == 0), F.lit(float("nan"))).when(above > 0, infinite).when(above < 0, -infinite)
    return F.when(below == 0, over_zero).otherwise(F.try_divide(above, below))


def number(value: Column | str) -> Column:
    """Coerce to double; what cannot be read, and NaN, become null."""
    parsed = as_column(value).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def day(value: Column | str) -> Column:
    """Coerce to a date; what cannot be read becomes null."""
    return as_column(value).try_cast("timestamp_ntz").cast("date")


def after_tax_cash(value: Column | str) -> Column:
    return as_column(value).cast("double") * F.lit(DIVIDEND_AFTER_TAX_RATIO)


def payout_ratio(dividend_yield: Column | str, pe: Column | str) -> Column:
    return as_column(dividend_yield) * as_column(pe)


def _parts(value: Column | str, digits: str) -> tuple[Column, Column, Column]:
    text = F.trim(as_column(value).cast("string"))
    prefixed = text.rlike(rf"(?i)^(sh|sz|bj)\.[0-9]{digits}$")
    suffixed = text.rlike(rf"(?i)^[0-9]{digits}\.(sh|sz|bj)$")
    return text, prefixed, suffixed


def security_symbol(value: Column | str, *, long_keys: bool = False) -> Column:
    """``sh.600000`` or ``600000.SH`` to ``600000.SH``; null when unsupported. ``long_keys`` allows more than six digits."""
    text, prefixed, suffixed = _parts(value, "{6,}" if long_keys else "{6}")
    return (
        F.when(prefixed, F.concat(F.substring_index(text, ".", -1), F.lit("."), F.upper(F.substring(text, 1, 2))))
        .when(suffixed, F.upper(text))
    )


def index_code(value: Column | str, *, long_keys: bool = False) -> Column:
    """``h30269`` to ``H30269``; exchange codes to ``sh.000300``; null otherwise.

    ``long_keys`` allows more digits, for codes made of keys that outgrow five or six.
    """
    text, prefixed, suffixed = _parts(value, "{6,}" if long_keys else "{6}")
    return (
        F.when(text.rlike("^[hH][0-9]{5,}$" if long_keys else "^[hH][0-9]{5}$"), F.upper(text))
        .when(prefixed, F.concat(F.lower(F.substring(text, 1, 2)), F.lit("."), F.substring_index(text, ".", -1)))
        .when(suffixed, F.concat(F.lower(F.right(text, F.lit(2))), F.lit("."), F.substring_index(text, ".", 1)))
    )


def _suffix_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])


def symbol_from_source(value: Column | str, *, long_keys: bool = False) -> Column:
    """``600000.XSHG`` to ``600000.SH``; null when unsupported. ``long_keys`` allows more than six digits."""
    text = as_column(value).cast("string")
    code, suffix = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    exchange = F.try_element_at(_suffix_map(SOURCE_SUFFIX_TO_EXCHANGE), suffix)
    return F.when(
        text.rlike(r"^[0-9]{6,}\.[A-Z]+$" if long_keys else r"^[0-9]{6}\.[A-Z]+$") & exchange.isNotNull(), F.concat(code, F.lit("."), exchange)
    )


def symbol_to_source(value: Column | str, *, long_keys: bool = False) -> Column:
    """``600000.SH`` to ``600000.XSHG``; null when unsupported. ``long_keys`` allows more than six digits."""
    text = as_column(value).cast("string")
    code, exchange = F.substring_index(text, ".", 1), F.upper(F.substring_index(text, ".", -1))
    reverse = {exchange: suffix for suffix, exchange in SOURCE_SUFFIX_TO_EXCHANGE.items()}
    suffix = F.try_element_at(_suffix_map(reverse), exchange)
    return F.when(
        text.rlike(r"^[0-9]{6,}\.[A-Za-z]+$" if long_keys else r"^[0-9]{6}\.[A-Za-z]+$") & suffix.isNotNull(), F.concat(code, F.lit("."), suffix)
    )
