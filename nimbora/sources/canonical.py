"""From an uploaded table to canonical long rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.operators.ingest import dates
from nimbora.sources.uploads import column

#: Leads that a forecast may have, in days.
LEADS = (1, 10)


@dataclass(frozen=True)
class Measured:
    """A column that holds a variable's values, of a kind (forecast, observed, ..) unless the row says otherwise."""

    source: str
    variable: str
    value_type: str | None = None
    unit: str | None = None


@dataclass(frozen=True)
class Layout:
    """Which columns of a table hold what; names that are None are not there."""

    measured: list[Measured] = field(default_factory=list)
    region: str | None = None
    latitude: str | None = None
    longitude: str | None = None
    valid_date: str | None = None
    init_date: str | None = None
    lead: str | None = None
    member: str | None = None
    value_type: str | None = None
    variable_name: str | None = None


def spaced_header(name: Column) -> Column:
    """A header's words: camel case split, bracketed units left out, lower case, other characters as single spaces."""
    split = F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " ")
    plain = F.regexp_replace(split, r"[(\[{].*?[)\]}]", " ")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def header_fingerprint(headers: Column) -> Column:
    """A digest of an array of headers that does not hang on their order or spelling."""
    return F.sha2(F.array_join(F.array_sort(F.transform(headers, spaced_header)), "|"), 256)


def converted(value: Column, unit: str | None) -> Column:
    """A value in the store's unit."""
    if unit == "kmh_to_ms":
        return value / 3.6
    if unit == "K_to_C":
        return value - 273.15
    if unit == "Pa_to_hPa":
        return value / 100.0
    if unit == "frac_to_pct":
        return value * 100.0
    return value


def lead_in_days(lead: Column) -> Column:
    """A lead in whole days; numbers from 24 on are hours. Halves go to the even day."""
    return F.bround(F.when(lead >= 24, lead / 24).otherwise(lead)).cast("int")


def kind_of(text: Column, kinds: dict[str, list[str]]) -> Column:
    """The first kind one of whose names holds, or is held in, the text's words; null for a null text."""
    plain, found = spaced_header(text), F.lit(None).cast("string")
    for kind, names in reversed(list(kinds.items())):
        fits = F.lit(False)
        for n in names:
            fits = fits | plain.contains(n) | F.lit(n).contains(plain)
        found = F.when(fits, kind).otherwise(found)
    return F.when(text.isNotNull(), found)


def variable_of(text: Column, variables: dict[str, list[str]]) -> Column:
    """The first variable one of whose names has all its words in the text; null where none has."""
    plain, found = spaced_header(text), F.lit(None).cast("string")
    words = F.split(plain, " ")
    for variable, names in reversed(list(variables.items())):
        fits = F.lit(False)
        for n in names:
            fits = fits | (plain == n) | (F.size(F.array_except(F.array(*map(F.lit, n.split())), words)) == 0)
        found = F.when(fits, variable).otherwise(found)
    return F.when(text.isNotNull(), found)


def canonical_rows(rows: DataFrame, layout: Layout, kinds: dict[str, list[str]], variables: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each measured value of ``rows`` (texts), with why it is skipped, if it is, in ``skipped``.

    Columns: variable, value_type, value, source_column, region, lat, lon, init_date, valid_date, lead_time_days, member,
    skipped. A missing one of initial date, valid date and lead is filled in. Values that are no numbers give no row. The
    row's own kind goes before the column's. ``skipped`` is "no valid_date", "no variable" or "no value_type", else null;
    the lead is kept for forecasts within LEADS, the initial date for forecasts.

    With ``layout.variable_name`` the table is long: the variable is told from that column's text by ``variables``.
    """

    def text(name: str | None) -> Column:
        return F.lit(None).cast("string") if name is None else column(name).cast("string")

    def number(name: str | None) -> Column:
        return F.lit(None).cast("double") if name is None else column(name).try_cast("double")

    def day(name: str | None) -> Column:
        return F.lit(None).cast("date") if name is None else column(name).cast("string").try_cast("date")

    init, valid, lead = dates(day(layout.init_date), day(layout.valid_date), lead_in_days(number(layout.lead)))
    named = F.lit(None).cast("string") if layout.variable_name is None else variable_of(text(layout.variable_name), variables or {})
    cells = F.array(
        *[
            F.struct(
                (named if layout.variable_name else F.lit(m.variable)).alias("variable"),
                F.coalesce(kind_of(text(layout.value_type), kinds), F.lit(m.value_type).cast("string")).alias("value_type"),
                converted(number(m.source), m.unit).alias("value"),
                F.lit(m.source).alias("source_column"),
            )
            for m in layout.measured
        ]
    )
    each = rows.select(
        F.explode(cells).alias("c"), F.trim(text(layout.region)).alias("region"), number(layout.latitude).alias("lat"), number(layout.longitude).alias("lon"),
        init.alias("init_date"), valid.alias("valid_date"), lead.alias("lead_time_days"), F.trim(text(layout.member)).alias("member"),
    ).select("c.*", "region", "lat", "lon", "init_date", "valid_date", "lead_time_days", "member")
    forecast = F.col("value_type") == "forecast"
    why = F.when(F.col("valid_date").isNull(), "no valid_date").when(F.col("variable").isNull(), "no variable").when(F.col("value_type").isNull(), "no value_type")
    known = each.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return known.withColumn("skipped", why).withColumns({"lead_time_days": F.when(forecast & F.col("lead_time_days").between(*LEADS), F.col("lead_time_days")), "init_date": F.when(forecast, F.col("init_date"))})
