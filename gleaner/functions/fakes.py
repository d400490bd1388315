"""Made-up values in the form of their class, from the keyed hash of what they replace: no state, equal everywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names and words made-up values are built of; all invented or too common to name anybody.
FIRST = ["Alva", "Bruno", "Cleo", "Dario", "Edda", "Falk", "Gitta", "Henno", "Imke", "Joris", "Kaja", "Levin", "Maren", "Nilo", "Odette", "Piet"]
LAST = ["Ahrens", "Birk", "Castell", "Dorn", "Ebner", "Falke", "Grahn", "Hollis", "Ivers", "Jansky", "Kolm", "Lindt", "Morell", "Norden", "Ostrow", "Pell"]
CITIES = ["Altmere", "Brookfen", "Corvale", "Dunhollow", "Eastmarsh", "Fernwick", "Glenport", "Harrowby"]
STREETS = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Gorse", "Hazel"]
COUNTRIES = ["Norland", "Sudmark", "Ostria", "Westoria"]
COMPANIES = ["Amberline", "Bluefold", "Copperhill", "Driftwood"]
#: Classes whose vendor's prefix is kept, so that what kind of key it was stays readable.
VENDOR = ("api_key", "vendor_secret", "aws_key", "iban")


def number(mac: Column, at: int, below: int) -> Column:
    """A number below ``below`` from 7 hex digits of the hash."""
    return F.conv(F.substring(mac, at, 7), 16, 10).cast("long") % below


def pick(words: list[str], mac: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (number(mac, at, len(words)) + 1).cast("int"))


def digits(mac: Column, at: int, n: int) -> Column:
    return F.lpad(number(mac, at, 10**n).cast("string"), n, "0")


def scrambled(value: Column, mac: Column) -> Column:
    """every ASCII digit and letter by another of its kind, all else as it is: the same form, another value."""

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(mac, i % 60 + 1, F.lit(4)), 16, 10).cast("int")
        letter = lambda first: F.char(F.lit(ord(first)) + n % 26)
        return F.when(c.rlike("^[0-9]$"), (n % 10).cast("string")).when(c.rlike("^[a-z]$"), letter("a")).when(c.rlike("^[A-Z]$"), letter("A")).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def fake(pattern: Column, value: Column, mac: Column) -> Column:
    """a value of the finding's class that is nobody's: reserved domains and ranges, kept country and vendor prefixes."""
    first, last = pick(FIRST, mac, 1), pick(LAST, mac, 8)
    handle = F.concat(F.lower(first), F.lit("_"), digits(mac, 15, 4))
    prefix = F.regexp_extract(value, r"^(?:\+[0-9]{2}|[A-Za-z]{2,4}[-_]?)", 0)
    rest = F.substring(scrambled(value, mac), F.length(prefix) + 1, F.length(value))
    hexes = F.regexp_replace(F.substring(mac, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    two = lambda at, below, low=0: F.lpad((number(mac, at, below) + low).cast("string"), 2, "0")
    return (
        F.when(pattern == "email", F.concat(F.lower(first), F.lit("."), F.lower(last), digits(mac, 15, 3), F.lit("@example.org")))
        .when(pattern == "phone_us", F.concat(F.lit("555-"), digits(mac, 15, 3), F.lit("-"), digits(mac, 22, 4)))
        .when(pattern.isin("phone_intl", *VENDOR), F.concat(prefix, rest))
        .when(pattern.isin("ssn", "ssn_nodash"), F.concat(F.lit("9"), F.substring(scrambled(value, mac), F.lit(2), F.length(value))))
        .when(pattern == "ipv4", F.concat_ws(".", F.lit("10"), number(mac, 1, 256), number(mac, 8, 256), number(mac, 15, 256)))
        .when(pattern == "ipv6", F.concat(F.lit("fd00"), F.regexp_replace(F.substring(mac, 1, 28), "(.{4})", ":$1")))
        .when(pattern == "mac", F.concat(F.lit("02"), F.regexp_replace(F.substring(mac, 1, 10), "(.{2})", ":$1")))
        .when(pattern == "uuid", hexes)
        .when(pattern == "date", F.concat_ws("-", number(mac, 1, 70) + 1950, two(8, 12, 1), two(15, 28, 1)))
        .when(pattern == "time", F.concat_ws(":", two(1, 24), two(8, 60)))
        .when(pattern.isin("twitter_handle", "social_handle"), F.concat(F.lit("@"), handle))
        .when(pattern == "username", handle)
        .when(pattern.isin("home_dir", "social_url", "unix_path"), F.concat(F.regexp_extract(value, r"^(.*[/\\])[^/\\]", 1), handle))
        .when(pattern == "geocoord", F.concat(digits(mac, 1, 1), F.lit("."), digits(mac, 8, 4), F.lit(", "), digits(mac, 15, 2), F.lit("."), digits(mac, 22, 4)))
        .when(pattern == "person", F.concat_ws(" ", first, last))
        .when(pattern == "first_name", first)
        .when(pattern == "last_name", last)
        .when(pattern == "street_address", F.concat(number(mac, 15, 200) + 1, F.lit(" "), pick(STREETS, mac, 22), F.lit(" Street")))
        .when(pattern == "city", pick(CITIES, mac, 22))
        .when(pattern == "country", pick(COUNTRIES, mac, 22))
        .when(pattern.isin("organization", "company"), pick(COMPANIES, mac, 22))
        .otherwise(scrambled(value, mac))
    )
