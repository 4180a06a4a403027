"""Cleaning of the two weekly feeds (entity resolution + SKU + sales + dates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date, time_attributes
from ..functions.numeric import finite, impute_sales, try_double, try_long
from ..functions.text import SKU_DIGITS, clean_sku
from .resolve import attach, resolve_spellings

# Similarity cutoffs of the fuzzy tier per entity.
CUTOFF = {"brand": 0.5, "category": 0.5, "retailer": 0.5, "variant": 0.4}

INTERNAL_COLS = {"Reported_Brand": ("brand", "brand"),
                 "Reported_Category": ("category", "category"),
                 "Reported_Retailer": ("retailer", "retailer"),
                 "Reported_Variant": ("variant", "variant")}
COMPETITOR_COLS = {"Reported_Category": ("category", "category"),
                   "Reported_Retailer": ("retailer", "retailer")}


def with_imputed_sales(df: DataFrame, total="Total_Sales", volume="Volume",
                       price="Unit_Price") -> DataFrame:
    total_sales, is_imputed = impute_sales(total, volume, price)
    return df.withColumns({"total_sales": total_sales, "is_imputed": is_imputed})


def _finish_internal(df: DataFrame, sku_digits: int) -> DataFrame:
    # the reported texts keep their own names: column names are not case
    # sensitive, so total_sales / week_start would otherwise replace them
    df = df.withColumnsRenamed({"Total_Sales": "reported_sales", "Week_Start": "reported_week"})
    df = with_imputed_sales(df, total="reported_sales")
    df = df.withColumns({"sku_id": clean_sku("Reported_SKU", sku_digits),
                         "volume": _number(df, "Volume"),
                         "week_start": parse_date("reported_week")})
    return time_attributes(df)


def _number(df: DataFrame, col: str):
    """A feed's number; one that was typed when it was read is not read again."""
    return finite(col) if df.schema[col].dataType.typeName() == "double" else try_double(col)


def _finish_competitor(df: DataFrame) -> DataFrame:
    df = df.withColumnsRenamed({"Week_Start": "reported_week"})
    df = df.withColumns({"competitor_volume": try_long("Competitor_Volume"),
                         "competitor_sales": _number(df, "Competitor_Sales"),
                         "week_start": parse_date("reported_week")})
    return time_attributes(df)


def clean_feeds(internal: DataFrame | None, competitor: DataFrame | None,
                aliases: dict[str, DataFrame], materialize: bool = True,
                tier_cols: bool = False, sku_digits: int = SKU_DIGITS):
    """Clean both raw feeds with one resolution pass over their spellings.

    Returns ``(internal_clean, competitor_clean)`` (``None`` for a missing
    feed).  Internal rows get sku_id, brand, category, retailer, variant,
    volume, total_sales, is_imputed, week_start and its time attributes;
    competitor rows get category, retailer, competitor_volume,
    competitor_sales and the week attributes.  A number that does not fit and
    a date in no known layout become NULL; ``quality_counts`` counts them.
    """
    frames = []
    if internal is not None:
        frames.append((internal, {c: e for c, (e, _) in INTERNAL_COLS.items()}))
    if competitor is not None:
        frames.append((competitor, {c: e for c, (e, _) in COMPETITOR_COLS.items()}))
    used = sorted({e for _, cols in frames for e in cols.values()})
    resolved = resolve_spellings(frames, {e: aliases[e] for e in used},
                                 {e: CUTOFF[e] for e in used}, materialize)
    ci = cc = None
    if internal is not None:
        ci = _finish_internal(attach(internal, resolved, INTERNAL_COLS, tier_cols), sku_digits)
    if competitor is not None:
        cc = _finish_competitor(attach(competitor, resolved, COMPETITOR_COLS, tier_cols))
    return ci, cc


def clean_internal_sales(df: DataFrame, aliases: dict[str, DataFrame],
                         materialize: bool = True) -> DataFrame:
    """Raw internal feed -> cleaned rows."""
    return clean_feeds(df, None, aliases, materialize)[0]


def clean_competitor_market(df: DataFrame, aliases: dict[str, DataFrame],
                            materialize: bool = True) -> DataFrame:
    """Raw competitor feed -> cleaned rows (category, retailer, week)."""
    return clean_feeds(None, df, aliases, materialize)[1]
