"""Census ratios per block group, from a table of numerators and denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


HOMES, HOUSEHOLDS, PEOPLE = "H0030001", "P0180001", "P0010001"
OWNED, RENTED = "H0140002", "H0040004"

# Numerator columns and denominator of each ratio.
RATIOS: dict[str, tuple[list[str], str]] = {
    "housing_density": ([HOMES], "area"),
    "rate_occupied_units": (["H0030002"], HOMES),
    "rate_vacant_units": (["H0030003"], HOMES),
    "rate_mortgage_or_loan": (["H0040002"], HOMES),
    "rate_renter_occupied": ([RENTED], HOMES),
    "rate_for_rent": (["H0050002"], HOMES),
    "rate_white_householder": (["H0060002"], HOUSEHOLDS),
    "rate_black_householder": (["H0060003"], HOUSEHOLDS),
    "rate_native_householder": (["H0060004", "H0060006"], HOUSEHOLDS),
    "rate_asian_householder": (["H0060005"], HOUSEHOLDS),
    "rate_other_race_householder": (["H0060007"], HOUSEHOLDS),
    "rate_pop_occupied_units": (["H0100001"], PEOPLE),
    "rate_1_per_household": (["H0130002"], HOUSEHOLDS),
    "rate_2_per_household": (["H0130003"], HOUSEHOLDS),
    "rate_3_per_household": (["H0130004"], HOUSEHOLDS),
    "rate_4_per_household": (["H0130005"], HOUSEHOLDS),
    "rate_5_per_household": (["H0130006"], HOUSEHOLDS),
    "rate_6_per_household": (["H0130007"], HOUSEHOLDS),
    "rate_7_plus_per_household": (["H0130008"], HOUSEHOLDS),
    "rate_owner_occupied": ([OWNED], HOMES),
    "rate_owner_occupied_white": (["H0140003"], OWNED),
    "rate_owner_occupied_black": (["H0140004"], OWNED),
    "rate_owner_occupied_native": (["H0140005", "H0140007"], OWNED),
    "rate_owner_occupied_asian": (["H0140006"], OWNED),
    "rate_owner_occupied_other_race": (["H0140008"], OWNED),
    "rate_renter_occupied_white": (["H0140011"], RENTED),
    "rate_renter_occupied_black": (["H0140012"], RENTED),
    "rate_renter_occupied_native": (["H0140013", "H0140015"], RENTED),
    "rate_renter_occupied_asian": (["H0140014"], RENTED),
    "rate_renter_occupied_other": (["H0140016"], RENTED),
    "rate_owner_occupied_hispanic": (["H0150004"], OWNED),
    "rate_owner_occupied_w_children": (["H0190003"], OWNED),
    "rate_owner_occupied_no_children": (["H0190004"], OWNED),
    "rate_renter_occupied_w_children": (["H0190006"], RENTED),
    "population_density": ([PEOPLE], "area"),
    "rate_white_pop": (["P0030002"], PEOPLE),
    "rate_black_pop": (["P0030003"], PEOPLE),
    "rate_native_pop": (["P0030004", "P0030006"], PEOPLE),
    "rate_asian_pop": (["P0030005"], PEOPLE),
    "rate_other_race_pop": (["P0030007"], PEOPLE),
    "rate_pop_over_18": (["P0110001"], PEOPLE),
    "rate_male_under_18": (["P0120003", "P0120004", "P0120005", "P0120006"], PEOPLE),
    "rate_male_18_35": (["P0120007", "P0120008", "P0120009", "P0120010", "P0120011", "P0120012"], PEOPLE),
    "rate_male_35_50": (["P0120013", "P0120014", "P0120015"], PEOPLE),
    "rate_male_50_75": (["P0120016", "P0120017", "P0120018", "P0120019", "P0120020", "P0120021", "P0120022"], PEOPLE),
    "rate_male_over_75": (["P0120023", "P0120024", "P0120025"], PEOPLE),
    "rate_female_under_18": (["P0120027", "P0120028", "P0120029", "P0120030"], PEOPLE),
    "rate_female_18_35": (["P0120031", "P0120032", "P0120033", "P0120034", "P0120035", "P0120036"], PEOPLE),
    "rate_female_35_50": (["P0120037", "P0120038", "P0120039"], PEOPLE),
    "rate_female_50_75": (["P0120040", "P0120041", "P0120042", "P0120043",
                           "P0120044", "P0120045", "P0120046"], PEOPLE),
    "rate_female_over_75": (["P0120047", "P0120048", "P0120049"], PEOPLE),
    "rate_households": ([HOUSEHOLDS], HOMES),
}

# Sums over a list skip missing columns; these plain sums do not.
_STRICT = {"rate_male_under_18"}


def ratio(parts: list[str], whole: str, strict: bool) -> Column:
    cols = [F.col(c).cast("double") for c in parts]
    if len(cols) > 2 and not strict:
        cols = [F.coalesce(c, F.lit(0.0)) for c in cols]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return F.try_divide(total, F.col(whole).cast("double"))


def ratios(df: DataFrame, keys: list[str], table: dict[str, tuple[list[str], str]] | None = None) -> DataFrame:
    """All ratios of ``table`` (the census table by default) next to the key columns.

    The male and the female share over 75 are both given under their own name.
    """
    table = table or RATIOS
    out = [ratio(parts, whole, name in _STRICT).alias(name) for name, (parts, whole) in table.items()]
    if table is RATIOS:
        out.append((F.lit(1.0) - ratio(["H0190006"], RENTED, True)).alias("rate_renter_occupied_no_children"))
    return df.select(*keys, *out)


def census_features(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    """Ratios per (tract, block_group); ``areas`` brings the area of each group."""
    joined = blocks.join(areas.select("tract", "block_group", "area"), ["tract", "block_group"])
    return ratios(joined, ["tract", "block_group"])


def county_rows(df: DataFrame, column: str, code: str) -> DataFrame:
    return df.where(F.col(column) == code)
