"""Numbers: percentages, ratios, prices, locale text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_percentage(part: Column, whole: Column) -> Column:
    """Half-even percentage to two places; 0 where the whole is 0 or null."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.bround(part / whole * 100, 2))


def ratio(part: Column, whole: Column) -> Column:
    """Half-even ratio to four places; 0 where the whole is 0 or null."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.bround(part / whole, 4))


def plain_number(text: Column) -> Column:
    """A number in Polish notation, złoty marks dropped; null for other currencies and for no number."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(text), "[  ]|PLN|ZŁ", ""), ",", ".")
    return bare.try_cast("decimal(18,4)")


def grouped_number(value: Column, places: int = 0) -> Column:
    """Thousands parted by spaces, a decimal comma."""
    return F.translate(F.format_number(value, places), ",.", " ,")


def token_cost(tokens: Column, per_million: Column) -> Column:
    """Price of tokens, to eight places."""
    return F.bround(tokens * per_million / 1_000_000, 8)
