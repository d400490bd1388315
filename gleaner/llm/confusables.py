"""Problem 7: visually identical text with different characters.

Confusables skeleton: decompose, replace every character by its prototype from a
look-alike table, decompose again; texts with equal skeletons look the same.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleaner.operators.skew import hot_keys, salted_join
from gleaner.session import cut_lineage

# Characters of other scripts that look like a Latin letter, and the letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "ı": "i", "ɑ": "a", "ɡ": "g", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ո": "n", "Տ": "S", "Օ": "O", "Ս": "U", "ⅼ": "l", "ℓ": "l", "ѡ": "w", "ꞵ": "β", "µ": "μ",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B",
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ⅿ": "m", "Ƽ": "5", "Ƨ": "2", "ǃ": "!", "ᖯ": "b", "ᑌ": "U", "ᒪ": "L", "ᗞ": "D", "ᗪ": "D", "ᐯ": "V", "᙭": "X",
    "‐": "-", "‑": "-", "﹣": "-", "․": ".", "։": ":", "꞉": ":", "∶": ":", ";": ";", "`": "`", "⁄": "/", "∕": "/",
}

#: Kinds of compatibility decomposition that keep the look; others (raised digits, fractions, squared words) change it.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


@lru_cache(maxsize=1 << 16)
def prototype(ch: str) -> str:
    """What ``ch`` looks like: nothing for invisible characters, a blank for any space, else its prototype."""
    if ch in "\n\t":
        return ch
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch == "͏" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    if kind == "Zs":
        return " "
    to = unicodedata.decomposition(ch)
    if to.startswith(SAME_LOOK) or 0xFB00 <= ord(ch) <= 0xFB06:
        return "".join(prototype(c) for c in unicodedata.normalize("NFKD", ch))
    return LOOKALIKES.get(ch, ch)


class _Table(dict):
    def __missing__(self, code: int) -> str:
        self[code] = to = prototype(chr(code))
        return to


_TABLE = _Table()


def skeleton(text: str | None) -> str | None:
    """One form for all texts that look alike.  Case, accents and other punctuation stay; CR LF counts as LF."""
    if text is None:
        return None
    if text.isascii():
        return text.replace("\r\n", "\n")
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_TABLE)).replace("\r\n", "\n")


def skeletons(c: Column) -> Column:
    """Column form of :func:`skeleton`; null stays null, empty stays empty."""
    return F.pandas_udf(lambda s: s.map(skeleton), T.StringType())(c)


_LOCAL = T.StructType([T.StructField("text_skeleton", T.StringType()), T.StructField("value_skeletons", T.ArrayType(T.StringType())), T.StructField("differing", T.ArrayType(T.IntegerType()))])


def _local(texts: pd.Series, annotations: pd.Series) -> pd.DataFrame:
    rows = []
    for text, notes in zip(texts, annotations):
        found, values = [], []
        for k, a in enumerate(notes if notes is not None else ()):
            value = a["value"] if a is not None else None
            values.append(skeleton(value))
            if text is None or not value or pd.isna(a["start_cp"]) or pd.isna(a["end_cp"]):
                continue
            there = text[max(0, int(a["start_cp"])) : max(0, int(a["end_cp"]))]  # numbers beside nulls come as floats
            if there != value and skeleton(there) == values[-1]:
                found.append(k)
        rows.append((skeleton(text), values, found))
    return pd.DataFrame(rows, columns=["text_skeleton", "value_skeletons", "differing"])


def consistent_forms(examples: DataFrame) -> DataFrame:
    """(example_id, text_skeleton, value_skeletons, differing) a row of ``examples(example_id, text, annotations)``.

    ``differing`` has the positions (from 0) of annotations whose value looks the same as the
    text at its offsets but isn't the same characters.  Null text or annotations give null or
    empty results; offsets outside the text match nothing.
    """
    return _with_forms(examples).select("example_id", "_l.*")


def _with_forms(examples: DataFrame) -> DataFrame:
    slim = F.transform("annotations", lambda a: F.when(a.isNotNull(), F.struct(a["value"].alias("value"), a["start_cp"].alias("start_cp"), a["end_cp"].alias("end_cp"))))
    return examples.select("example_id", "text", F.pandas_udf(_local, _LOCAL)("text", slim).alias("_l"))


def look_alikes(examples: DataFrame) -> DataFrame:
    """(example_a, example_b, ann_pos): see TESTDATA, p7_found.

    Texts are grouped by skeleton; only skeletons with at least two different texts go on,
    as one row a text (its digest); links are made between different texts of a skeleton, then
    spread over the rows that hold them.  Rows with the same characters make no pair; null texts
    pair with nothing.
    """
    h = lambda name, c: [F.xxhash64(c).alias(f"{name}1"), F.xxhash64(F.lit(1), c).alias(f"{name}2")]
    local = _with_forms(examples).select("example_id", "text", "_l.differing", F.col("_l.text_skeleton").alias("sk"))
    forms = cut_lineage(local.filter("text is not null").select("example_id", "differing", *h("t", "text"), *h("s", "sk")))
    notes = forms.select(F.col("example_id").alias("example_a"), F.col("example_id").alias("example_b"), F.explode("differing").alias("ann_pos"))
    looks = cut_lineage(forms.groupBy("s1", "s2").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi"), F.count("*").alias("n")).filter("lo != hi"))
    often = hot_keys(looks.groupBy("s1").agg(F.sum("n").alias("n")), "s1", "n", looks.agg(F.sum("n")).first()[0] or 0)
    met = salted_join(forms.select("example_id", "s1", "s2", "t1", "t2"), looks.select("s1", F.col("s2").alias("_s2")), "s1", "example_id", often)
    several = cut_lineage(met.filter("s2 = _s2").drop("_s2"))
    texts = several.select("s1", "s2", "t1", "t2").distinct()
    links = texts.alias("x").join(texts.alias("y"), (F.col("x.s1") == F.col("y.s1")) & (F.col("x.s2") == F.col("y.s2")) & (F.col("x.t1") < F.col("y.t1"))).select(F.col("x.t1").alias("ta"), F.col("y.t1").alias("tb"))
    rows = several.select("example_id", "t1")
    counts = rows.groupBy("t1").agg(F.count("*").alias("n"))
    total = rows.count()
    hot = cut_lineage(hot_keys(counts, "t1", "n", total))
    a = salted_join(rows.select(F.col("t1").alias("ta"), F.col("example_id").alias("a")), links, "ta", "a", hot.withColumnRenamed("t1", "ta"))
    b = salted_join(rows.select(F.col("t1").alias("tb"), F.col("example_id").alias("b")), a, "tb", "b", hot.withColumnRenamed("t1", "tb"))
    pairs = b.select(F.least("a", "b").alias("example_a"), F.greatest("a", "b").alias("example_b"), F.lit(-1).alias("ann_pos"))
    return pairs.union(notes)


def look_classes(examples: DataFrame) -> DataFrame:
    """(example_id, class_id, n_forms): the smallest example whose text looks the same, and how many different texts look like it.

    One row an example with a text, without making pairs.
    """
    forms = _with_forms(examples).filter("text is not null").select("example_id", F.md5(F.col("_l.text_skeleton")).alias("sk"), F.xxhash64("text").alias("t"))
    forms = cut_lineage(forms)
    each = forms.groupBy("sk", "t").agg(F.min("example_id").alias("m"), F.count("*").alias("n"))
    classes = cut_lineage(each.groupBy("sk").agg(F.min("m").alias("class_id"), F.count("*").alias("n_forms"), F.sum("n").alias("n")))
    hot = hot_keys(classes, "sk", "n", classes.agg(F.sum("n")).first()[0] or 0)
    return salted_join(forms.select("example_id", "sk"), classes.select("sk", "class_id", "n_forms"), "sk", "example_id", hot).select("example_id", "class_id", "n_forms")
