"""Replacement of findings, the map of what was replaced, and restoration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.functions import fakes as FAKES, replacements as R
from gleaner.session import cut_lineage

from .extract import spans, spans_of_each
from .skew import hot_keys, running, salted_join
from .units import string_leaves, with_leaves

#: What an alias looks like.
ALIAS = r"<[A-Z][A-Z0-9_]*(?:_[0-9a-f]{12})?>"
STRATEGIES = ("placeholder", "mask", "hash", "numbered", "corpus", "random", "consistent", "fake")


def rendered(text: Column, spans: Column) -> Column:
    """``text`` with ordered, non-overlapping ``spans`` (start_cp, end_cp, replacement) replaced; a fold."""
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = F.aggregate(spans, start, lambda acc, s: F.struct(s["end_cp"].alias("at"), F.concat(acc["out"], piece(acc["at"], s["start_cp"]), s["replacement"]).alias("out")))
    return F.when(F.size(spans) > 0, F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text)))).otherwise(text)


def replacement_of(strategy: str, key: bytes, p: Column | None = None, v: Column | None = None, at: Column | None = None) -> Column:
    """The replacement of a finding by strategy; ``random`` also depends on where the finding starts."""
    p, v = F.col("pattern_name") if p is None else p, F.col("matched_text") if v is None else v
    if strategy == "placeholder":
        return R.label(p)
    if strategy == "mask":
        return R.mask(v)
    if strategy == "hash":
        return R.hash_token(p, v, key)
    if strategy == "corpus":
        return R.corpus_placeholder(p, v, key)
    if strategy == "random":
        return FAKES.scrambled(v, R.hmac_hex(F.concat(v, F.lit("@"), F.col("start_cp") if at is None else at), key))
    if strategy == "consistent":
        return FAKES.scrambled(v, R.hmac_hex(v, key))
    if strategy == "fake":
        return FAKES.fake(p, v, R.hmac_hex(v, key))
    raise ValueError(f"unknown strategy: {strategy}")


def selected(found: Column) -> Column:
    """W1 within a row: the leftmost, then longest findings of an array of SPAN structs that overlap none chosen before; ties by pattern."""
    item = lambda f: F.struct(f["start_cp"].alias("s"), (-f["end_cp"]).alias("ne"), f["pattern_name"].alias("p"), f["matched_text"].alias("v"))
    kind = "array<struct<s:int,ne:int,p:string,v:string>>"
    start = F.struct(F.lit(-1).alias("last"), F.expr(f"cast(array() as {kind})").alias("out"))
    step = lambda a, x: F.when(x["s"] >= a["last"], F.struct((-x["ne"]).alias("last"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    return F.aggregate(F.array_sort(F.transform(found, item)), start, step)["out"]


def _replacements(chosen: Column, strategy: str, secret: bytes) -> Column:
    """The chosen findings as (start_cp, end_cp, replacement)."""

    def one(x: Column) -> Column:
        if strategy == "numbered":
            own = R.label(x["p"])
            same = F.array_distinct(F.transform(F.filter(chosen, lambda y: R.label(y["p"]) == own), lambda y: y["v"]))
            r = F.concat(F.regexp_replace(own, ">$", "_"), F.array_position(same, x["v"]), F.lit(">"))
        else:
            r = replacement_of(strategy, secret, x["p"], x["v"], x["s"])
        return F.struct(x["s"].alias("start_cp"), (-x["ne"]).alias("end_cp"), r.alias("replacement"))

    return F.transform(chosen, one)


def anonymized_text(docs: DataFrame, text: str, strategy: str, secret: bytes = b"", names: list[str] | None = None) -> DataFrame:
    """``docs`` with ``anonymized``: each text with its selected findings replaced, in one projection; for batches and streams.

    ``numbered`` numbers values by first occurrence within the text.  Texts without findings come
    out as they are, null texts as null; repeated rows are replaced alike.
    """
    d = docs.withColumn("_f", spans(text, names)).withColumn("_f", selected(F.col("_f")))
    return d.withColumn("anonymized", rendered(F.col(text), _replacements(F.col("_f"), strategy, secret))).drop("_f")


def anonymized(docs: DataFrame, key: str, text: str, strategy: str, secret: bytes = b"", names: list[str] | None = None) -> DataFrame:
    """(key, anonymized): see :func:`anonymized_text`."""
    return anonymized_text(docs.select(key, text), text, strategy, secret, names).select(key, "anonymized")


def json_anonymized(docs: DataFrame, text: str, strategy: str, secret: bytes = b"", names: list[str] | None = None, compact: bool = False) -> DataFrame:
    """``docs`` with ``anonymized``: JSON with findings in its string values replaced, keys and structure as they were.

    Numbers keep their digits.  ``compact`` gives one line without blanks, else two blanks a level.  A text
    that is no JSON gives null; a null text stays null.
    """
    d = docs.withColumn("_l", string_leaves(F.col(text)))
    d = d.withColumn("_f", spans_of_each("_l", names))
    replaced = F.transform("_f", lambda f: _replacements(selected(f), strategy, secret))
    return d.withColumn("anonymized", with_leaves(F.col(text), replaced, compact)).drop("_l", "_f")


def key_map(found: DataFrame, replacement: Column, order: list[str]) -> DataFrame:
    """(original, replacement, pattern_name): one alias for each exact original, whatever its class; the first class stays."""
    f = found.withColumn("_r", replacement)
    k = F.struct(*order)
    return f.groupBy(F.col("matched_text").alias("original")).agg(F.min_by("_r", k).alias("replacement"), F.min_by("pattern_name", k).alias("pattern_name"))


def merged_maps(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old map, then new pairs for originals it doesn't have."""
    cols = ["original", "replacement", "pattern_name"]
    return old.select(*cols).union(new.join(old, "original", "left_anti").select(*cols)).dropDuplicates(["original", "replacement"])


def ambiguous(keys: DataFrame) -> DataFrame:
    """(side, value, n): originals with several replacements and replacements of several originals; must be empty."""
    one = keys.groupBy(F.col("original").alias("value")).agg(F.count_distinct("replacement").alias("n")).select(F.lit("original").alias("side"), "value", "n")
    two = keys.groupBy(F.col("replacement").alias("value")).agg(F.count_distinct("original").alias("n")).select(F.lit("replacement").alias("side"), "value", "n")
    return one.union(two).filter("n > 1")


def free_aliases(proposed: DataFrame, keys: DataFrame) -> DataFrame:
    """Proposed (original, replacement) whose replacement no earlier map uses."""
    return proposed.join(keys.select("replacement").distinct(), "replacement", "left_anti")


def unique_aliases(df: DataFrame, space: list[str], value: str, base: str) -> DataFrame:
    """aliases made unique within their space: repeats of a base get -2, -3 ... by value."""
    k = F.row_number().over(Window.partitionBy(*space, base).orderBy(value))
    return df.withColumn("alias", F.when(k == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), k)))


def restored(docs: DataFrame, keys: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored): aliases ``<...>`` of ``keys`` turned back into originals in one pass.

    The distinct aliases of each text are looked up, and the text is put together within its row; inserted
    originals are never read again.  Unknown aliases stay; null texts come out as null; repeated keys are
    restored each by its own text.  An alias in many texts is spread over tasks.
    """
    t = docs.select(key, text, F.md5(text).alias("_h"))
    held = t.select("_h", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(ALIAS), F.lit(0)))).alias("_t")).distinct()
    n = held.groupBy("_t").agg(F.count("*").alias("n"))
    n = cut_lineage(n)
    hot = hot_keys(n, "_t", "n", n.agg(F.sum("n")).first()[0] or 0)
    known = salted_join(held, keys.select(F.col("replacement").alias("_t"), F.col("original").alias("_o")).dropDuplicates(["_t"]), "_t", "_h", hot)
    maps = known.groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("_t", "_o"))).alias("_k"))  # the aliases of one text
    found, gaps = F.regexp_extract_all(text, F.lit(ALIAS), F.lit(0)), F.split(text, ALIAS, -1)
    out = t.join(maps, "_h", "left").withColumn("_m", F.transform(found, lambda a: F.coalesce(F.try_element_at("_k", a), a))).withColumn("_g", gaps)
    pieces = F.transform("_g", lambda g, i: F.concat(g, F.coalesce(F.get("_m", i), F.lit(""))))
    return out.select(key, F.array_join(pieces, "").alias("restored"))


def alias_order(aliases: DataFrame, alias: str) -> DataFrame:
    """(alias, ordinal): longer aliases first, equally long ones by text, so that none is hidden by its own beginning."""
    return running(aliases.select(alias).distinct(), [F.char_length(alias).desc(), F.col(alias)]).select(alias, "ordinal")


def linked(values: DataFrame, components: DataFrame, value: str) -> DataFrame:
    """(value, linked): names inside handles, addresses and URLs replaced by the aliases of their components.

    ``components(component, alias)``: aliases of first and last names, found whatever their case; the alias takes the
    case of what it replaces.  Runs of letters that name nobody stay, and so do the characters between.
    """
    runs = r"\p{L}+"
    v = values.select(value).filter(F.col(value).isNotNull()).distinct()
    parts = v.select(value, F.explode(F.array_distinct(F.regexp_extract_all(value, F.lit(runs), F.lit(0)))).alias("_r"))
    known = components.groupBy(F.lower("component").alias("_c")).agg(F.min("alias").alias("_a"))
    hit = parts.join(known, F.lower("_r") == F.col("_c")).groupBy(value).agg(F.map_from_entries(F.collect_list(F.struct("_r", R.like_case(F.col("_r"), F.col("_a"))))).alias("_m"))
    found, gaps = F.regexp_extract_all(value, F.lit(runs), F.lit(0)), F.split(value, runs, -1)
    out = v.join(hit, value, "left").withColumn("_n", F.transform(found, lambda r: F.coalesce(F.try_element_at("_m", r), r))).withColumn("_g", gaps)
    return out.select(value, F.array_join(F.transform("_g", lambda g, i: F.concat(g, F.coalesce(F.get("_n", i), F.lit("")))), "").alias("linked"))


def component_residuals(texts: DataFrame, parts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, n): words of a text that are component aliases: of one original, or of several."""
    known = parts.groupBy(F.lower("alias").alias("_a")).agg(F.count_distinct("original").alias("_n"))
    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("_a"))
    hit = words.groupBy(key, "_a").agg(F.count("*").alias("_c")).join(known, "_a")
    return hit.groupBy(key, F.when(F.col("_n") > 1, "ambiguous").otherwise("component").alias("kind")).agg(F.sum("_c").alias("n"))


def residuals(texts: DataFrame, keys: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, n): aliases still recognisable in restored texts, known or only alias-shaped; strict restoration wants none."""
    hits = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(ALIAS), F.lit(0))).alias("alias"))
    known = keys.select(F.col("replacement").alias("alias")).distinct().withColumn("_k", F.lit("full"))
    return hits.join(known, "alias", "left").groupBy(key, F.coalesce("_k", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))
