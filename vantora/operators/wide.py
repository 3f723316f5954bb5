"""Reshaping entity-attribute-value rows into one typed row for each entity.

Every entity gets a place for every attribute (the completed grid), filled from its latest values in the
order of the attributes' positions; fixed indices of that array are then projected through casts of the
column's type. The grid is completed inside the entity's own row, so absent cells are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns with a type other than string.
KINDS = {"price": "number", "rating": "number", "stock_count": "number", "in_stock": "boolean", "released_on": "date"}
#: Texts that stand for no value, in any case.
EMPTY = ["", "n/a", "null", "none", "-", "unknown", "?"]
#: Names of currencies that may stand beside a number.
CURRENCIES = "usd|eur|gbp|pln|jpy|chf|rub|cny|inr|cad|aud|sek|nok|dkk|czk|brl|mxn|dollars?|euros?|pounds?|yen|zloty|zł|kr"
#: The first three letters of the months, in order.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: A wide table must have fewer columns than this; the names are the only thing sent to the driver.
MAX_COLUMNS = 5_000
MICRO = "decimal(38,0)"
_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"


def strip(text: Column) -> Column:
    """The text without outer white space of any kind."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def snake_case(name: Column) -> Column:
    """The name in lower snake case; empty if it has no letter or digit."""
    done = name.rlike("^[a-z0-9]+(_[a-z0-9]+)*$")  # most names are in this form already
    parts = F.regexp_replace(strip(name), r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_")
    parts = F.lower(F.regexp_replace(parts, r"[^\p{L}\p{M}\p{N}]+", "_"))
    return F.when(done, name).otherwise(F.regexp_replace(parts, "^_+|_+$", ""))


def as_micro(text: Column) -> Column:
    """The number a text denotes in millionths, null if it denotes none.

    A last ``.`` or ``,`` before one or two final digits is the decimal sign, others only group digits. With an
    exponent the mantissa is in scientific form, so its only sign is the decimal sign. Signs and names of
    currencies, ``pcs`` and ``/5`` are left out. Finer digits than millionths are rounded half up.
    """
    bare = F.regexp_replace(F.lower(text), rf"\p{{Sc}}|(?<!\p{{L}})({CURRENCIES}|pcs)\.?(?!\p{{L}})|{_SPACE}*/{_SPACE}*5$", "")
    bare = strip(bare)
    shape = r"^([+-]?)([0-9][0-9.,]*?)(?:[.,]([0-9]{1,2}))?(?:e([+-]?[0-9]{1,2}))?$"
    science = r"^([+-]?)([0-9]+)[.,]([0-9]+)e([+-]?[0-9]{1,2})$"
    usual = F.when(bare.rlike(shape), F.concat(F.regexp_extract(bare, shape, 1), F.regexp_replace(F.regexp_extract(bare, shape, 2), "[.,]", ""), F.lit("."), F.regexp_extract(bare, shape, 3), F.lit("0e"), _exponent(F.regexp_extract(bare, shape, 4))))
    exact = F.when(bare.rlike(science), F.concat(F.regexp_extract(bare, science, 1), F.regexp_extract(bare, science, 2), F.lit("."), F.regexp_extract(bare, science, 3), F.lit("e"), _exponent(F.regexp_extract(bare, science, 4))))
    plain = F.when(text.rlike(r"^[0-9]{1,17}(\.[0-9]{1,2})?$"), text)  # most numbers are in this form already
    value = F.coalesce(plain, exact, usual).try_cast("decimal(38,10)")
    return F.round(value.try_cast("decimal(27,10)") * F.lit(1_000_000).cast("decimal(7,0)"), 0).try_cast(MICRO)


def _exponent(digits: Column) -> Column:
    return F.when(digits == "", F.lit("0")).otherwise(digits)


def as_boolean(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("true", "yes", "y", "t", "1"), True).when(low.isin("false", "no", "n", "f", "0"), False)


def as_date(text: Column) -> Column:
    """The UTC date a text denotes, null if it denotes none.

    Year first with ``-`` or ``/``, also with a time and zone; with dots the day first; eight digits are year,
    month and day, more are epoch milliseconds; a month may be given by name. A time without zone is in UTC.
    """
    def day(y, m, d):
        return F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")

    def get(shape, i):
        return F.regexp_extract(text, shape, i)

    first = r"^([0-9]{4})([-/])([0-9]{1,2})\2([0-9]{1,2})(?:[T ]([0-9:.,]+) ?(?:[Zz]|UTC|GMT)?)?$"
    zoned = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+ ?[+-][0-9]{2}:?[0-9]{2}$"
    dots = r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$"
    packed = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
    named = r"^([0-9]{1,2})\.? ([A-Za-z]{3,9})\.?,? ([0-9]{4})$"
    leading = r"^([A-Za-z]{3,9})\.? ([0-9]{1,2}),? ([0-9]{4})$"

    def month(name):
        number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
        return F.when(number > 0, number.cast("string"))

    def of_seconds(s):
        return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int"))

    millis = text.try_cast("bigint")
    return (
        F.when(text.rlike(first), day(get(first, 1), get(first, 3), get(first, 4)))
        .when(text.rlike(zoned), of_seconds(F.unix_seconds(text.try_cast("timestamp"))))
        .when(text.rlike(dots), day(get(dots, 3), get(dots, 2), get(dots, 1)))
        .when(text.rlike(packed), day(get(packed, 1), get(packed, 2), get(packed, 3)))
        .when(text.rlike(r"^[0-9]{9,15}$"), of_seconds(millis / 1000))
        .when(text.rlike(named), day(get(named, 3), month(get(named, 2)), get(named, 1)))
        .when(text.rlike(leading), day(get(leading, 3), month(get(leading, 1)), get(leading, 2)))
    )


def latest_values(entries: DataFrame) -> DataFrame:
    """(id, attr, value): the value with the greatest entry_no of each cell, null where that leaves it empty.

    Rows with null id are ignored; keys without letters and digits have the attribute ``''``. Rows with a null entry_no lose; of
    several values under one entry_no the greatest text counts. Values are stripped of outer white space.
    """
    rows = entries.where(F.col("id").isNotNull()).select("id", snake_case(F.col("meta_key")).alias("attr"), "entry_no", "meta_value")
    newest = rows.groupBy("id", "attr").agg(F.max(F.struct("entry_no", "meta_value")).alias("v"))
    value = strip(F.col("v.meta_value"))
    return newest.select("id", "attr", F.when(~F.lower(value).isin(EMPTY), value).alias("value"))


def attribute_names(entries: DataFrame) -> list[str]:
    """All attributes in order; an error where they are too many for the columns of a table."""
    keys = entries.where(F.col("id").isNotNull()).select("meta_key").distinct()
    # the spellings are made distinct first; a filter here would be pushed to every row
    found = keys.select(snake_case(F.col("meta_key")).alias("attr")).distinct().limit(MAX_COLUMNS + 2).collect()
    names = sorted(r[0] for r in found if r[0])
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} attributes; keep such data in rows")
    return names


def typed(value: Column, kind: str | None) -> Column:
    """The cell in its column's type: numbers in millionths, booleans, dates, else strings."""
    return {"number": as_micro, "boolean": as_boolean, "date": as_date}.get(kind, lambda v: v)(value)


def wide_table(entries: DataFrame, names: list[str] | None = None, kinds: dict[str, str] = KINDS) -> DataFrame:
    """One row for each id with a typed column for each attribute, in the order of ``names``.

    An id whose cells are all empty still has its row. An attribute called like the key column ``id`` gets the
    column ``id_``. Numbers are given in millionths. No entries give no rows.
    """
    names = attribute_names(entries) if names is None else names
    place = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]) if names else F.create_map()
    cells = latest_values(entries).select("id", F.try_element_at(place, F.col("attr")).alias("pos"), "value")
    cell = F.when(F.col("pos").isNotNull(), F.struct("pos", "value"))
    rows = cells.groupBy("id").agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.count("pos").alias("n")).where("n > 0")
    filled = F.map_from_entries("cells")
    grid = F.transform(F.sequence(F.lit(0), F.lit(max(len(names) - 1, 0))), lambda i: F.try_element_at(F.col("filled"), i))
    rows = rows.select("id", filled.alias("filled")).select("id", grid.alias("grid"))
    return rows.select("id", *[typed(F.get("grid", F.lit(i)), kinds.get(n)).alias("id_" if n == "id" else n) for i, n in enumerate(names)])


def filled_cells(wide: DataFrame) -> DataFrame:
    """(id, attr, cell) of every filled cell of a wide table, the cell as text."""
    def text(name, kind):
        if kind == "date":
            return F.date_format(F.col(name).cast("timestamp_ntz"), "yyyy-MM-dd")
        return F.col(name).cast("string")

    cells = [F.struct(F.lit("id" if n == "id_" else n).alias("attr"), text(n, k).alias("cell")) for n, k in wide.dtypes if n != "id"]
    if not cells:
        return wide.select("id", F.lit("").alias("attr"), F.lit("").alias("cell")).limit(0)
    return wide.select("id", F.inline(F.array(*cells))).where("cell is not null")
