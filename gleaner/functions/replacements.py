"""What a finding is replaced by: labels, masks, keyed tokens, case transfer, normal forms, checksums."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, functions as F

from . import patterns as P

# Letters of the normal form that become two.
EXPANSIONS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]
STRIPPED = ("áàâãéèêëíìîïóòôõúùûñç", "aaaaeeeeiiiioooouuunc")


def label(pattern: Column) -> Column:
    """the placeholder of a pattern."""
    out = F
    for text in dict.fromkeys(P.LABELS.values()):
        out = out.when(pattern.isin([n for n, t in P.LABELS.items() if t == text]), text)
    return out.otherwise(P.DEFAULT_LABEL)


def mask(value: Column) -> Column:
    """letters and digits become X, separators stay."""
    return F.regexp_replace(value, r"[\p{L}\p{N}]", "X")


def pads(key: bytes) -> tuple[str, str]:
    """Inner and outer pad of a key in hex."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def hmac_hex(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, in the JVM.  The pads, not the key, are in the plan; keep plans private all the same."""
    inner, outer = pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def hash_token(pattern: Column, value: Column, key: bytes, domain: str = "example.com") -> Column:
    """a token from the first 8 bytes of the keyed hash, in the form of its class."""
    token = F.translate(F.base64(F.unhex(F.substring(hmac_hex(value, key), 1, 16))), "+/=", "-_")
    cut = lambda a, n: F.substring(token, a, n)
    return (
        F.when(pattern == "email", F.concat(F.lit("user_"), cut(1, 6), F.lit("@" + domain)))
        .when(pattern == "phone_us", F.concat(F.lit("555-"), cut(1, 3), F.lit("-"), cut(4, 4)))
        .when(pattern == "ssn", F.concat(F.lit("XXX-XX-"), cut(1, 4)))
        .otherwise(F.concat(F.lit("<"), cut(1, 8), F.lit(">")))
    )


def corpus_placeholder(pattern: Column, value: Column, key: bytes) -> Column:
    """``<CLASS_`` and 12 hex digits of the keyed hash: equal in every file without shared state."""
    return F.concat(F.regexp_replace(label(pattern), ">$", "_"), F.substring(hmac_hex(value, key), 1, 12), F.lit(">"))


def normal_form(value: Column) -> Column:
    """small letters, umlauts written out, accents gone."""
    return F.translate(reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), EXPANSIONS, F.lower(value)), *STRIPPED)


def like_case(original: Column, replacement: Column) -> Column:
    """F8: ``replacement`` in the case of ``original``: capitals, small letters or title; else as it is."""
    letters = F.regexp_replace(original, r"[^\p{L}]", "")
    rest = F.substring(original, F.lit(2), F.length(original))
    title = original.rlike(r"^\p{Lu}") & ~rest.rlike(r"[\p{Lu}\p{Lt}]")
    return (
        F.when((original == "") | (replacement == ""), replacement)
        .when(~letters.rlike(r"[^\p{Lu}]"), F.upper(replacement))
        .when(~letters.rlike(r"[^\p{Ll}]"), F.lower(replacement))
        .when(title, F.concat(F.upper(F.substring(replacement, 1, 1)), F.lower(F.substring(replacement, F.lit(2), F.length(replacement)))))
        .otherwise(replacement)
    )


def key_class(name: Column) -> Column:
    """a class from a key name: camelCase to snake, other characters to ``_``, at most 64."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))
    return F.substring(F.regexp_replace(snake, "^_+|_+$", ""), 1, 64)


def class_label(name: Column) -> Column:
    """the placeholder of a class; null unless it is letters, digits and ``_``."""
    return F.when(name.rlike("^[a-z][a-z0-9_]*$"), F.concat(F.lit("<"), F.upper(name), F.lit(">")))


def opaque_file_name(ordinal: Column, extension: str) -> Column:
    """``f00003.jsonl``."""
    return F.format_string(f"f%05d.{extension}", ordinal)


def length_bin(n: Column) -> Column:
    """the bin of a span's length."""
    return F.when(n <= 4, "1-4").when(n <= 8, "5-8").when(n <= 16, "9-16").when(n <= 32, "17-32").otherwise("33+")


def term_class(term: Column) -> Column:
    """a guess at the class of a listed term."""
    return F.when(term.contains("@"), "email").when(term.contains(" "), "organization").otherwise("username")


def entropy(token: Column) -> Column:
    """Shannon entropy of a token's characters in bits."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def luhn(value: Column) -> Column:
    """The Luhn checksum of the digits of ``value``."""
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))
