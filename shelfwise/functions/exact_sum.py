"""Sums of amounts that lose nothing and do not depend on the order of rows.

An amount that is a decimal of six places (but for the last bit of its double)
counts as that decimal, up to 22 digits before the point: money as written.
Any other finite double is taken exactly, as a whole number of units of
``2 ** scale``, where scales are ``SCALE_STEP`` apart.  Amounts of one scale are
added as DECIMAL, which is exact in any order; the sums of the few scales of a
group (a double has some 260) are added from high to low in two doubles, and
only the end is rounded.

Sums are made in two steps: ``cells`` adds by the wanted keys and the scale,
with partial sums before the shuffle; ``finish`` brings the scales of a group
together.  Cells may be added again by fewer keys before they are finished.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import money

SCALE_STEP = 8          # bits between two scales: 4e12 amounts of one fit a DECIMAL(38,6)
WRITTEN = 5000          # the scale of an amount as written, beyond those of any double
AMOUNT = "decimal(38,6)"
NO_AMOUNT = f"struct<scale: int, amount: {AMOUNT}>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _times_power(x: Column, bits: Column) -> Column:
    """``x * 2 ** bits``, in two steps as 2 ** bits may be no double; exact
    where the result is a normal double."""
    half = F.floor(bits / 2)
    two = F.lit(2.0)
    return x * F.pow(two, half) * F.pow(two, bits - half)


def part(c) -> Column:
    """``struct(scale, amount)`` of a double; NULL for a NULL, NaN or infinite
    one, which has no amount."""
    x = _col(c).cast("double")
    decimal = money(x)
    written = F.abs(x - decimal.cast("double")) <= F.abs(x) * F.lit(2.0 ** -52)
    # low enough that the amount is a whole number of units, below 2 ** 62 of them
    scale = (F.floor((F.floor(F.log2(F.abs(x))) - 54) / SCALE_STEP) * SCALE_STEP).cast("int")
    whole = _times_power(x, -scale).cast("bigint")
    return (F.when(written, F.struct(F.lit(WRITTEN).alias("scale"), decimal.cast(AMOUNT).alias("amount")))
            .when(F.abs(x) < F.lit(float("inf")), F.struct(scale.alias("scale"),
                                                           whole.cast(AMOUNT).alias("amount"))))


def kept_if(condition: Column, p: Column) -> Column:
    """The part where ``condition`` holds, else NULL."""
    return F.when(condition, p)


def no_part() -> Column:
    return F.lit(None).cast(NO_AMOUNT)


def cells(df: DataFrame, by, sums: dict[str, Column], plain: dict[str, Column] | None = None) -> DataFrame:
    """One row a group, sum and scale: ``(by, s, scale, amount, plain)``, where
    ``s`` is the place of the sum and ``plain`` are ordinary sums."""
    plain = plain or {}
    structs = []
    for i, p in enumerate(sums.values()):
        structs.append(F.struct(
            F.lit(i).alias("s"), p["scale"].alias("scale"), p["amount"].alias("amount"),
            *[(c if i == 0 else F.when(F.lit(False), c)).alias(n) for n, c in plain.items()]))
    if len(structs) == 1:
        rows = df.select(*by, structs[0].alias("x"))
    else:
        rows = df.select(*by, F.explode(F.array(*structs)).alias("x"))
    return again(rows.select(*by, "x.*"), by, plain)


def again(rows: DataFrame, by, plain=()) -> DataFrame:
    """Cells added by (fewer) keys."""
    return rows.groupBy(*by, "s", "scale").agg(
        F.sum("amount").alias("amount"), *[F.sum(n).alias(n) for n in plain])


def _total(found: Column) -> Column:
    """The double nearest to the sum of ``array<struct<scale, amount>>``, one
    entry a scale; NULL for none."""
    ten = [F.lit(str(2 ** b)).cast("decimal(25,0)") for b in (40, 80)]

    def pieces(x):      # whole numbers of at most 53 bits, and the places after the point
        amount = x["amount"]
        small = amount % ten[0]
        middle = (amount - small) % ten[1]
        bits = F.when(x["scale"] == WRITTEN, F.lit(0)).otherwise(x["scale"])
        return F.transform(F.array(*[p.cast(AMOUNT) for p in (
            amount - small - middle, middle, small - small % 1, small % 1)]),
            lambda p: _times_power(p.cast("double"), bits))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc, x):   # what the larger sum cannot take is kept beside it
        s = acc["s"] + x
        z = s - acc["s"]
        return F.struct(s.alias("s"), (acc["c"] + ((acc["s"] - (s - z)) + (x - z))).alias("c"))

    high_first = F.array_sort(
        F.flatten(F.transform(found, pieces)),
        lambda a, b: F.when(F.abs(a) > F.abs(b), -1).when(F.abs(a) < F.abs(b), 1).otherwise(0))
    only = F.get(found, F.lit(0))
    return (F.when(F.size(found) == 0, F.lit(None).cast("double"))
            .when((F.size(found) == 1) & (only["scale"] == WRITTEN), only["amount"].cast("double"))
            .otherwise(F.aggregate(high_first, zero, step, lambda acc: acc["s"] + acc["c"])))


def finish(of: DataFrame, by, names, plain=()) -> DataFrame:
    """Cells to ``(by, names as DOUBLE, plain)``, one row a group (one row in
    all without keys)."""
    by = list(by)
    lists = [F.collect_list(F.when((F.col("s") == i) & F.col("amount").isNotNull(),
                                   F.struct("scale", "amount"))).alias(f"__list{i}")
             for i in range(len(names))]
    g = (of.groupBy(*by) if by else of).agg(*lists, *[F.sum(n).alias(n) for n in plain])
    return g.select(*by, *[_bind(F.col(f"__list{i}"), _total).alias(n) for i, n in enumerate(names)],
                    *plain)


def exact_sums(df: DataFrame, by, sums: dict[str, Column],
               plain: dict[str, Column] | None = None) -> DataFrame:
    """``(by, sums as DOUBLE, plain)``: exact sums of parts, and ordinary sums."""
    by = list(by)
    return finish(cells(df, by, sums, plain), by, list(sums), list(plain or {}))


def grouping_sets(of: DataFrame, keys, sets, names, plain=()) -> DataFrame:
    """Cells by ``keys`` finished for each of the sets of keys, NULL for the
    others, with ``level_id``: bit i, the first key's the highest, is 1 where
    key i is summed over.  Each set is added up from the smallest set before it
    that holds all of its keys, so the finest cells are made once."""
    keys, made, out = list(keys), {tuple(keys): of}, []
    types = {f.name: f.dataType for f in of.schema.fields}
    for mine in sets:
        mine = tuple(mine)
        if mine not in made:
            source = min((k for k in made if set(mine) <= set(k)), key=len)
            made[mine] = again(made[source], mine, plain)
        level = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in mine)
        done = finish(made[mine], mine, names, plain)
        out.append(done.select(
            *[F.col(k) if k in mine else F.lit(None).cast(types[k]).alias(k) for k in keys],
            F.lit(level).cast("bigint").alias("level_id"), *names, *plain))
    return reduce(DataFrame.unionByName, out)
