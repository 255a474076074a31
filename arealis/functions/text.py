"""Scalar functions over codes, dates and dirty cells. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and numbers, and the accents that are taken off.
MONTHS = {"janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12}
ACCENTED = "àâäáãåçèéêëìíîïñòóôõöùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), key)


def iso_date(text: Column) -> Column:
    """A date from yyyy, yyyy-mm or yyyy-mm-dd; a missing month is June, a missing day the 15th; else null."""
    y, m, d = (F.regexp_extract(text, r"^\s*(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", i) for i in (1, 2, 3))
    return F.try_to_date(F.concat_ws("-", F.nullif(y, F.lit("")), F.lpad(F.coalesce(F.nullif(m, F.lit("")), F.lit("6")), 2, "0"), F.lpad(F.coalesce(F.nullif(d, F.lit("")), F.lit("15")), 2, "0")), "yyyy-MM-dd")


def french_date(text: Column) -> Column:
    """A date from free text such as `5-10 mars 2026`: the last month named, the last day before a year; no day: the 15th."""
    low = F.lower(text)
    year = F.regexp_extract(low, r"((?:19|20)\d{2})", 1)
    month = lookup(MONTHS, F.try_element_at(F.regexp_extract_all(low, F.lit("(" + "|".join(MONTHS) + ")"), F.lit(1)), F.lit(-1)))
    days = F.regexp_extract_all(F.regexp_replace(low, r"(?:19|20)\d{2}", ""), F.lit(r"(?<!\d)(\d{1,2})(?!\d)"), F.lit(1))
    day = F.coalesce(F.try_element_at(days, F.lit(-1)).cast("int"), F.lit(15))
    return F.when((year != "") & month.isNotNull(), F.try_to_date(F.format_string("%s-%02d-%02d", year, month, day), "yyyy-MM-dd"))


def poll_value(text: Column) -> Column:
    """A number from a cell: footnotes, `<`, percent signs and trailing names go, a comma is a point; else null."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\[.*?\]", ""), r"[<%\s ]+", " ")
    return F.regexp_extract(F.translate(F.trim(clean), ",", "."), r"^(\d+(?:\.\d+)?)", 1).try_cast("double")


def poll_value_inline(text: Column) -> Column:
    """The plain variant: what stands before `[`, without `%` and `<`, with a point for a comma."""
    return F.trim(F.translate(F.substring_index(text, "[", 1), ",%<", ".")).try_cast("double")


def poll_header(text: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(text, r"\[.*?\]", "")))


def normalised_name(text: Column) -> Column:
    """Accents off, everything but letters and digits one space, small letters."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[^A-Za-z0-9]+", " ")))


def event_id(text: Column, months: dict[str, int], labels: dict[str, str]) -> tuple[Column, Column]:
    """Date and type from an id such as `2024_legi_t1`: the month of its kind and round, the label of its kind, the round."""
    part = F.split(text, "_")
    kind, turn = F.concat_ws("_", part[1], part[2]), F.upper(part[2])
    month = lookup(months, kind)
    return F.make_date(part[0].try_cast("int"), month, F.lit(1)), F.concat_ws("_", lookup(labels, part[1]), turn)


def event_key(years: Column) -> Column:
    """An exact integer for a date given in years."""
    return F.round(years * 100).cast("int")


def location(area: Column, unit: Column) -> Column:
    return F.concat_ws("_", area, unit)


def parent(loc: Column) -> Column:
    return F.substring_index(loc, "_", 1)


def department(loc: Column) -> Column:
    """The first two characters of a code, three for 97 and 98."""
    return F.when(F.substring(loc, 1, 2).isin("97", "98"), F.substring(loc, 1, 3)).otherwise(F.substring(loc, 1, 2))


def territory(loc: Column) -> Column:
    dep = department(loc)
    return F.when(loc.startswith("ZZ") | loc.startswith("99"), "abroad").when(dep.isin("987", "988", "986", "ZP", "ZN", "ZW"), "polynesia").when(dep.isin("2A", "2B", "20"), "corsica").when(dep.startswith("97") | loc.startswith("Z"), "dom").otherwise("mainland")


def is_mainland(dep: Column) -> Column:
    return ~(dep.startswith("Z") | dep.rlike("^9[789]"))


def rekey_padded(loc: Column, width: int = 4) -> Column:
    """`01001_1` to `01001_0001`."""
    return F.concat_ws("_", parent(loc), F.lpad(F.substring_index(loc, "_", -1), width, "0"))


def city_from_file(path: Column, prefix: str = "") -> Column:
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.initcap(F.translate(F.regexp_replace(name, f"^{prefix}", ""), "_-", "  "))


def expand_group(code: Column, groups: dict[str, list[str]]) -> Column:
    """The code and the codes of its group, sorted."""
    table = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    return F.array_sort(F.array_union(F.array(code), F.coalesce(F.try_element_at(table, code), F.array().cast("array<string>"))))


def coalition_code(text: Column, codes: dict[str, str], inside: dict[str, str] | None = None) -> Column:
    """The code of a coalition's first party; parties of `inside` are known by a part of their name; else UNKNOWN."""
    first = F.trim(F.split(text, "-")[0])
    for part, name in (inside or {}).items():
        first = F.when(first.contains(part), F.lit(name)).otherwise(first)
    return F.coalesce(lookup(codes, first), F.lit("UNKNOWN"))


def round_from_columns(headers: Column, coalition: str = r"[-+/]") -> Column:
    """2 if more than half of the headers name coalitions and there are at most eight, else 1."""
    joint = F.size(F.filter(headers, lambda h: h.rlike(coalition)))
    return F.when((joint > F.size(headers) / 2) & (F.size(headers) <= 8), 2).otherwise(1)


def clip(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def recency(years: Column, rate: float) -> Column:
    return F.exp(-rate * years)


def rounded_rings(rings: Column, digits: int = 5) -> Column:
    """Coordinates of a polygon's rings, rounded."""
    return F.transform(rings, lambda ring: F.transform(ring, lambda point: F.transform(point, lambda x: F.round(x, digits))))
