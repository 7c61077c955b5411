"""Cleaning expressions on text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of residential classes used to select data sets.
RESIDENTIAL_CLASSES = [401, 402, 403, 404, 419, 423, 431, 510, 520, 530, 550, 551, 552, 554, 555, 560, 599, 996]

# Use code of a building to the kind of home.
HOME_KINDS = {423: "mixed-use", 510: "single-family", 520: "two-family", 530: "three-family",
              550: "multi-family", 552: "multi-family", 554: "multi-family", 599: "multi-family"}
HOME_DOMAIN = ["single-family", "two-family", "three-family", "multi-family", "mixed-use"]


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def sentinel_to_null(c: Column, sentinels: list[str]) -> Column:
    """Null for the given marker texts (compared without surrounding blanks)."""
    return F.when(~F.trim(c).isin(sentinels), c)


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, null when the text does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


#: A location cell as a whole: city and zip in the first line, coordinates in brackets in the next; each part may be absent.
LOCATION = r"(?s)^(?:(?<city>[^\n]*?)\s(?<zip>\d{5})\b)?[^\n]*(?:\n\(\s*(?<lat>[^,()]*?)\s*,\s*(?<lon>[^,()]*?)\s*\).*)?$"
_LOCATION_PARTS = {"zip": 2, "city": 1, "delivered_latitude": 3, "delivered_longitude": 4}


def split_location(location: Column, city_names: dict[str, str] | None = None) -> dict[str, Column]:
    """Zip, city, latitude and longitude out of ``CITY 12345\\n(lat, lon)`` cells; null for an absent part.

    ``city_names`` maps abbreviated city tags to full names.
    """
    parts = {name: F.nullif(F.regexp_extract(location, LOCATION, i), F.lit("")) for name, i in _LOCATION_PARTS.items()}
    parts["city"] = F.upper(parts["city"])
    if city_names:
        parts["city"] = F.coalesce(mapped(parts["city"], city_names), parts["city"])
    return parts


def or_default(c: Column, default: str) -> Column:
    """Default for missing and empty text."""
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def without_quotes(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def street_part(c: Column, city_tag: str) -> Column:
    """Address before the first ``' - '`` without ``, <city_tag>``."""
    return F.replace(F.substring_index(c, " - ", 1), F.lit(f", {city_tag}"), F.lit(""))


def joined_address(number: Column, direction: Column, name: Column) -> Column:
    """Number, direction and name with missing parts left out."""
    parts = [F.when(p != "", p) for p in (number, direction, name)]
    return F.concat_ws(" ", *parts)


def display_address(number: Column, street: Column, suffix: Column) -> Column:
    """``number street suffix`` with capitalised words; a missing or empty part becomes one blank."""
    words = lambda c: F.initcap(F.trim(F.regexp_replace(c, r"\s+", " ")))
    shown = lambda c: F.coalesce(F.when(c != "", c), F.lit(" "))
    return F.concat_ws(" ", shown(number), shown(words(street)), shown(words(suffix)))


def wide_parcel_id(c: Column) -> Column:
    """``0`` and the id in 11 characters, blank-padded on the left and cut on the right."""
    return F.concat(F.lit("0"), F.lpad(c, 11, " "))


def zero_padded(c: Column, width: int = 12) -> Column:
    """Zeros on the left up to ``width``; longer text stays whole."""
    text = c.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def mapped(c: Column, values: dict) -> Column:
    """Value map; anything else is null."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), c)


def yes_no(c: Column) -> Column:
    return F.when(c == "Y", F.lit(True)).when(c == "N", F.lit(False))


def whole_number(c: Column) -> Column:
    return c.try_cast("double").try_cast("int")


def fee_amount(c: Column) -> Column:
    """Amount after a leading currency sign; null when it is not a number."""
    return F.substr(c, F.lit(2)).try_cast("double")


def taxes_are_paid(c: Column) -> Column:
    """Rows of the yearly tax tables that stay: the paid amount does not begin with a zero; unknown amounts go."""
    return ~c.startswith("0")


def owner_name(line1: Column, line2: Column) -> Column:
    """Two owner lines joined, cut at ``&``, each word capitalised, single blanks."""
    both = F.concat(F.coalesce(line1, F.lit("")), F.lit(" "), F.coalesce(line2, F.lit("")))
    head = F.trim(F.regexp_replace(F.substring_index(both, "&", 1), r"\s+", " "))
    return F.initcap(head)


def composite_key(columns: list[str]) -> Column:
    return F.concat(*[F.col(c).cast("string") for c in columns])


def short_zip(c: Column) -> Column:
    return F.substring(c, 1, 5)


def block_group(block: Column) -> Column:
    return F.substring(block, 1, 1)


def is_residential_class(c: Column) -> Column:
    """Selection rule of the data sets."""
    return c.isin(RESIDENTIAL_CLASSES)


def is_residential_report(c: Column) -> Column:
    """Rule of the reports: mixed use or any 5xx class. Differs from the selection rule."""
    number = c.cast("int")
    return (number == 423) | number.between(500, 599)


def home_dummies(df: DataFrame, use_code: str) -> DataFrame:
    """0/1 per kind of home; other codes are 0 in all."""
    kind = mapped(F.col(use_code), HOME_KINDS)
    return df.withColumns({k: F.coalesce((kind == k).cast("int"), F.lit(0)) for k in HOME_DOMAIN})


# Words that mark an organisation in the default keyword tagger.
ORGANISATION_WORDS = ["Llc", "Inc", "Corp", "Co", "Company", "Trust", "Bank", "Church", "Properties", "Ltd",
                      "Partnership", "Association", "Foundation", "Holdings", "Investments"]


def unify_tags(tags: Column) -> Column:
    """One tag when at least two words are tagged and all tagged words agree; else null."""
    real = F.filter(tags, lambda t: t != "O")
    agreed = (F.size(real) >= 2) & (F.size(F.array_distinct(real)) == 1)
    return F.when(agreed, F.element_at(real, 1))


def keyword_tags(name: Column) -> Column:
    """Default word tags: a name with an organisation word is tagged whole, other names as a person."""
    words = F.split(name, " ")
    org = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ORGANISATION_WORDS]))
    return F.transform(words, lambda w: F.when(org, F.lit("ORGANIZATION")).otherwise(F.lit("PERSON")))


def owner_entities(df: DataFrame, owner: str, known_names: dict[str, str] | None = None,
                   tagger=keyword_tags) -> DataFrame:
    """Add ``entity``: known (government) names first, then the tagger, run once per distinct owner.

    ``tagger`` maps a name column to an array of word tags; a vectorised model
    can be plugged in as a pandas UDF with the same shape.
    """
    names = df.select(owner).where(F.col(owner).isNotNull()).distinct()
    tag = unify_tags(tagger(F.col(owner)))
    known = mapped(F.col(owner), known_names) if known_names else F.lit(None).cast("string")
    resolved = names.withColumn("entity", F.coalesce(known, F.when(tag.isin("ORGANIZATION", "PERSON"), tag)))
    return df.join(resolved, owner, "left").select(*df.columns, "entity")
