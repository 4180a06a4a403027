"""Full rebuild: feeds on disk -> resolved and cleaned feeds -> written star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import SKU_DIGITS
from ..operators import builds
from ..operators.clean import clean_feeds
from ..operators.star import build_star, read_star, write_star
from ..session import stage, together
from ..sources.feeds import accepted, read_alias_csv, read_records, record_counts, refused


def rebuild(spark: SparkSession, internal: DataFrame, competitor: DataFrame,
            aliases: dict[str, DataFrame], out: str,
            sku_digits: int = SKU_DIGITS, keep: int = builds.KEEP) -> dict[str, dict | DataFrame]:
    """Clean both raw feeds, build the star and write it to ``out`` (replacing
    what was there).  Members of the former star keep their ids, weeks that did not
    change are not written again, and ``keep`` builds stay readable.  Returns ``star`` (the written tables) and the cleaned
    feeds ``internal`` and ``competitor``, each written once."""
    ci, cc = clean_feeds(internal, competitor, aliases, sku_digits=sku_digits)
    done = together({"internal": lambda: stage(ci, "clean-internal"),
                     "competitor": lambda: stage(cc, "clean-competitor")})
    ci, cc = done["internal"], done["competitor"]
    base = builds.current(spark, out)
    known = builds.read_keys(spark, out, base) if base else None
    write_star(build_star(ci, cc, known=known), out, base=base, keep=keep)
    return {"star": read_star(spark, out), "internal": ci, "competitor": cc}


def rebuild_star(spark: SparkSession, internal: DataFrame, competitor: DataFrame,
                 aliases: dict[str, DataFrame], out: str,
                 sku_digits: int = SKU_DIGITS) -> dict[str, DataFrame]:
    """:func:`rebuild`, the written tables alone."""
    return rebuild(spark, internal, competitor, aliases, out, sku_digits)["star"]


def rebuild_from_csv(spark: SparkSession, internal_path, competitor_path,
                     alias_paths: dict[str, str], out: str,
                     sku_digits: int = SKU_DIGITS,
                     keep: int = builds.KEEP) -> dict[str, dict | DataFrame]:
    """The rebuild from the feeds' CSV files and one alias CSV per entity
    (``brand``, ``category``, ``retailer``, ``variant``).

    Each feed is cut into records once and written, so that cleaning and the
    record counts read columns instead of CSV.  Adds ``records`` (feed,
    record_state, records) and ``refused``, the texts of the records that are
    in no feed, by feed."""
    aliases = together({k: lambda p=p: read_alias_csv(spark, p) for k, p in alias_paths.items()})
    records = together({kind: lambda k=kind, p=path: stage(read_records(spark, p, k), f"records-{k}")
                        for kind, path in (("internal", internal_path),
                                           ("competitor", competitor_path))})
    built = rebuild(spark, *[accepted(df, kind) for kind, df in records.items()], aliases, out,
                    sku_digits, keep)
    return built | {"records": record_counts(records),
                    "refused": {kind: refused(df) for kind, df in records.items()}}
