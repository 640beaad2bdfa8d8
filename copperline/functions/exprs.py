"""Column expressions of the netlist domain. All stay inside the JVM; none is a Python function on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and families of nets, passive prefixes and do-not-stuff markers that classification must know.
GROUND_NAMES = ["GND", "VSS", "AGND", "DGND", "PGND", "SGND", "CGND"]
POWER_FAMILIES = ["VCC", "VDD", "VIN", "VOUT", "VBAT", "VBUS", "VSYS", "PP", "PN", "LD_PP", "LD_PN"]
POWER_NAMED = ["PWR_", "RAIL_"]  # followed by at least one word character
PASSIVE_PREFIXES = ["R", "C", "L", "FR", "FB"]
DNS_WORDS = ["DNS", "DNP", "DNF", "DNI"]
DNS_VERBS = ["STUFF", "POPULATE", "INSTALL"]
NOT_CONNECTED = "NC"
MPN_MISSING_NOTE = "MPN not found in exported netlist data. Tell user to update symbol properties in library, or to point you to the BOM"

#: White space as the netlist formats' tools trim it: all Unicode spaces and the byte order mark.
SPACE = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# The same patterns serve Spark (Java) and DuckDB (RE2): no look-around, \z instead of $.
GROUND_PATTERN = rf"^(?:{'|'.join(GROUND_NAMES)})\z"
POWER_PATTERN = rf"^(?:(?:{'|'.join(POWER_FAMILIES)})\w*|(?:{'|'.join(POWER_NAMED)})\w+|[+-]?\d+V\d*\w*|[+-].+)\z"
PASSIVE_PATTERN = rf"^(?:{'|'.join(PASSIVE_PREFIXES)})"
REFDES_PATTERN = r"^[A-Z][A-Z0-9_]*\z"


def dns_pattern(space: str = SPACE) -> str:
    return rf"\b(?:{'|'.join(DNS_WORDS)})\b|DO{space}*NOT{space}*(?:{'|'.join(DNS_VERBS)})|NOT{space}*POPULATED|NO{space}*POP"


def trimmed(c: Column) -> Column:
    """Without white space of any script at either end. Most texts show by their first and last characters that they have none."""
    plain = lambda at: F.substring(c, at, 1).between("!", "~")
    return F.when(plain(1) & plain(-1), c).otherwise(F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", ""))


def filled(c: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(trimmed(c), F.lit(""))


def is_ground(net: Column) -> Column:
    return net.rlike("(?i)" + GROUND_PATTERN)


def is_power(net: Column) -> Column:
    return net.rlike("(?i)" + POWER_PATTERN)


def is_stop(net: Column) -> Column:
    """Nets at which an extended net ends: ground and power."""
    return is_ground(net) | is_power(net)


def is_passive(refdes: Column) -> Column:
    """Parts that forward an extended net; told by prefix alone, whatever their pins."""
    return F.upper(refdes).rlike(PASSIVE_PATTERN)


def is_refdes(refdes: Column) -> Column:
    return refdes.rlike("(?i)" + REFDES_PATTERN)


def is_dns(mpn: Column, description: Column, comment: Column) -> Column:
    """Marked as not to be stuffed. Missing fields count as empty; the value is not looked at."""
    text = F.concat(F.coalesce(mpn, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")), F.lit(" "), F.coalesce(comment, F.lit("")))
    return text.rlike("(?i)" + dns_pattern())


def has_prefix(refdes: Column, prefix: str | Column) -> Column:
    return F.startswith(F.upper(refdes), F.upper(F.lit(prefix) if isinstance(prefix, str) else prefix))


def refdes_prefix(refdes: Column) -> Column:
    """Leading letters in upper case; the whole name if it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(refdes), "^[A-Z]+", 0), F.lit("")), F.upper(refdes))


def skip_match(refdes: Column, skip_types: list[str]) -> Column:
    """The first of the types that is a prefix of refdes, or null; a blank type that comes first disables skipping."""
    match: Column = F.lit(None).cast("string")
    for kind in reversed([t.strip().upper() for t in skip_types]):
        match = F.when(has_prefix(refdes, kind), F.lit(kind)).otherwise(match)
    return F.nullif(match, F.lit(""))


def natural_key(c: Column) -> Column:
    """Sort key in which numbers inside text order by value: U1, U2, U10."""
    pairs = F.transform(F.regexp_extract_all(c, F.lit(r"\D*\d+"), F.lit(0)), lambda p: F.struct(F.lower(F.regexp_extract(p, r"^\D*", 0)).alias("t"), F.regexp_extract(p, r"\d+\z", 0).cast("double").alias("n")))
    tail = F.array(F.struct(F.lower(F.regexp_extract(c, r"\D*\z", 0)).alias("t"), F.lit(None).cast("double").alias("n")))
    return F.concat(pairs, tail)


def naturally_sorted(values: Column) -> Column:
    """An array of strings in natural order, case variants by code point."""
    return F.transform(F.array_sort(F.transform(values, lambda v: F.struct(natural_key(v).alias("k"), v.alias("v")))), lambda s: s["v"])


def collated(c: Column) -> Column:
    """Sort key of the root collation; use it in sort keys only and never in results."""
    return F.collate(c, "UNICODE")


def map_order(key: Column, inserted: Column) -> Column:
    """Order of a key among those of an object of the source tools: array indexes first, by value, then as inserted."""
    whole = F.when(key.rlike(r"^(?:0|[1-9][0-9]{0,9})\z"), key.cast("bigint"))
    return F.struct(F.when(whole < 4294967295, 0).otherwise(1).alias("c"), F.when(whole < 4294967295, whole).otherwise(inserted).alias("o"))


def pin_name(number: Column, name: Column) -> Column:
    """The trimmed name of a pin if it says more than its number, else null."""
    return F.nullif(filled(name), number)


def connected(net: Column) -> Column:
    """The net of a pin, NC for none."""
    return F.when(net == "", F.lit(NOT_CONNECTED)).otherwise(net)
