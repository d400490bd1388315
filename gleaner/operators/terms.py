"""Vocabulary: terms of texts, their counts, known words, ranking and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[\p{L}\p{N}_][\p{L}\p{N}\p{M}_-]*"
STRUCTURED = [
    r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>`]+|[A-Za-z0-9._%+-]+@[\p{L}\p{N}_.-]+\.[\p{L}]{2,}|(?:[A-Za-z]:[\\/]|~/|/)[^\s\"'<>`]+",
    r"[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+",
]


def phrases(text: Column, longest: int = 3) -> Column:
    """Every word and every phrase of up to ``longest`` words with only blanks between."""
    bound = F.array(F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("m"), F.split(text, WORD, -1).alias("g")))

    def of_length(b: Column, n: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(b["m"]) - n))
        near = F.filter(at, lambda i: (i + n <= F.size(b["m"])) & F.forall(F.slice(b["g"], i + 2, n - 1), lambda s: s.rlike("^ +$")))
        return F.transform(near, lambda i: F.concat(b["m"][i], *(x for k in range(1, n) for x in (b["g"][i + k], b["m"][i + k]))))

    def of(b: Column) -> Column:
        return F.concat(b["m"], *(of_length(b, n) for n in range(2, longest + 1)))

    return F.transform(bound, of)[0]


def structured(text: Column) -> Column:
    """Whole addresses, paths and dotted names, without closing punctuation."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in STRUCTURED))
    return F.transform(found, lambda s: F.regexp_replace(s, r"[.,;)\]}]+$", ""))


def valid(term: Column) -> Column:
    """2 to 120 characters, no control characters, no outer blanks."""
    return F.length(term).between(2, 120) & ~term.rlike(r"\p{Cc}") & (F.trim(term) == term)


def noise_shape(term: Column) -> Column:
    """numbers, digests and versions."""
    digits = term.rlike(r"^[0-9._:/-]*[0-9][0-9._:/-]*$")
    return digits | ((F.octet_length(term) >= 7) & term.rlike("^[0-9A-Fa-f]+$")) | term.rlike(r"^[vV]?[0-9]+(?:\.[0-9]+)+$")


def parts(term: Column) -> Column:
    """a compound split at case changes, ``_ . - '`` and blanks."""
    spaced = F.regexp_replace(term, r"(\p{Ll})(?=\p{Lu})", "$1 ")
    return F.filter(F.split(spaced, r"[\s_.\-']+"), lambda s: s != "")


def counted(texts: DataFrame, text: str, source: str, longest: int = 3, with_structured: bool = False) -> DataFrame:
    """A3: (term, occurrences, distinct_texts, sources): over all texts; equal texts count as one distinct text.

    Copies are counted first, so that a repeated text is cut into terms once a source; then terms are counted by
    source, and those counts by term: no relation is multiplied by the number of distinct counts.
    """
    t = F.col(text)
    terms = F.concat(phrases(t, longest), structured(t)) if with_structured else phrases(t, longest)
    each = texts.filter(t.isNotNull()).groupBy(text, F.col(source).alias("_s")).agg(F.count("*").alias("_c"))
    each = each.withColumn("_first", F.row_number().over(Window.partitionBy(text).orderBy(F.col("_s").asc_nulls_first())) == 1)
    rows = each.select("_s", "_c", "_first", F.explode(terms).alias("term")).filter(valid(F.col("term")))
    inside = rows.withColumn("_one", F.col("_first"))
    # how often a term is in a text, before anything is shuffled: repeats count once for the text
    per = each.select("_s", "_c", "_first", F.explode(F.array_distinct(terms)).alias("term")).filter(valid(F.col("term")))
    by_source = inside.groupBy("term", "_s").agg(F.sum("_c").alias("_o"))
    texts_of = per.filter("_first").groupBy("term").agg(F.count("*").alias("distinct_texts"))
    total = by_source.groupBy("term").agg(F.sum("_o").alias("occurrences"), F.count("_s").alias("sources"))
    return total.join(texts_of, "term").select("term", "occurrences", "distinct_texts", "sources")


def specificity(distinct_texts: Column, sources: Column, all_sources: int) -> Column:
    """ln(1 + texts) * ln((S + 1) / (s + 1)): common in few sources ranks high."""
    spread = F.log((F.lit(float(all_sources)) + 1) / (sources + 1)) if all_sources > 1 else F.lit(1.0)
    return F.log(1.0 + distinct_texts) * spread


def log_lift(terms: DataFrame, background: DataFrame) -> DataFrame:
    """``terms`` with ``score``: smoothed log lift against ``background(term, n)``; a term missing there counts 0."""
    joined = terms.join(background.select("term", F.col("n").alias("_b")), "term", "full")
    sums = joined.agg(F.coalesce(F.sum("distinct_texts"), F.lit(0)).alias("_ft"), F.coalesce(F.sum("_b"), F.lit(0)).alias("_bt"), F.count("*").alias("_v"))
    d = joined.filter("distinct_texts is not null").crossJoin(F.broadcast(sums))  # one row of totals
    fore = (F.col("distinct_texts") + 1.0) / (F.col("_ft") + F.col("_v"))
    back = (F.coalesce("_b", F.lit(0)) + 1.0) / (F.col("_bt") + F.col("_v"))
    return d.withColumn("score", F.log(fore / back) * F.log(1.0 + F.col("distinct_texts"))).drop("_b", "_ft", "_bt", "_v")


def ranked(terms: DataFrame, k: int, min_count: int = 1, demoted: DataFrame | None = None) -> DataFrame:
    """The first ``k`` with ``rank``: not demoted, score, sources, occurrences, term."""
    d = terms.filter(F.col("occurrences") >= min_count)
    d = d.join(demoted.select("term").distinct().withColumn("_d", F.lit(1)), "term", "left") if demoted is not None else d.withColumn("_d", F.lit(None).cast("int"))
    order = [F.coalesce("_d", F.lit(0)), F.desc("score"), F.desc("sources"), F.desc("occurrences"), F.col("term")]
    top = d.orderBy(*order).limit(k)  # a top-k report
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_d")


def known(terms: DataFrame, words: DataFrame) -> DataFrame:
    """``terms`` with ``known``: listed in small letters, or a compound whose parts all are."""
    w = words.select(F.lower("word").alias("_w")).distinct()
    whole = terms.join(w, F.lower("term") == F.col("_w"), "left_semi").select("term").withColumn("_k", F.lit(True))
    split = terms.select("term", parts(F.col("term")).alias("_p")).filter(F.size("_p") > 1)
    hit = split.select("term", F.size("_p").alias("_n"), F.explode("_p").alias("_q")).join(w, F.lower("_q") == F.col("_w"), "left")
    all_known = hit.groupBy("term", "_n").agg(F.count("_w").alias("_c")).filter("_c = _n").select("term").withColumn("_k", F.lit(True))
    marks = whole.union(all_known).distinct()
    return terms.join(marks, "term", "left").withColumn("known", F.coalesce("_k", F.lit(False))).drop("_k")


def case_aware(terms: DataFrame) -> DataFrame:
    """``terms(term, known)`` to keep: unknown ones, and known capitalised ones whose small form was never met."""
    lower = terms.filter(F.col("known") & (F.col("term") == F.lower("term"))).select(F.col("term").alias("_l")).distinct()
    return terms.filter(~F.col("known")).union(terms.filter(F.col("known") & (F.col("term") != F.lower("term"))).join(lower, F.lower("term") == F.col("_l"), "left_anti"))


def examples(texts: DataFrame, key: str, text: str, source: str, terms: DataFrame, k: int = 3) -> DataFrame:
    """A4: (term, source, key): up to ``k`` texts for each term, one a source before a second of any."""
    rows = texts.filter(F.col(text).isNotNull()).select(key, source, F.explode(F.array_distinct(phrases(F.col(text), 1))).alias("term")).join(terms.select("term"), "term", "left_semi")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("term", source).orderBy(key))).filter(F.col("_r") <= k)
    return first.withColumn("_k", F.row_number().over(Window.partitionBy("term").orderBy("_r", source, key))).filter(F.col("_k") <= k).select("term", source, key)


def heavy_terms(texts: DataFrame, text: str, k: int) -> DataFrame:
    """The ``k`` most frequent words, counted exactly; ties by word."""
    words = texts.select(F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def reviewed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approved terms: candidates decided ``sensitive``.  Unknown or repeated ids in ``decisions`` are errors at run time."""
    d = decisions.groupBy("candidate_id").agg(F.count("*").alias("_n"), F.max("choice").alias("choice"))
    j = d.join(candidates.withColumn("_there", F.lit(True)), d.candidate_id == candidates.id, "left")
    j = j.filter(F.assert_true(F.col("_there").isNotNull(), "a decision names no candidate").isNull() & F.assert_true(F.col("_n") == 1, "a candidate is decided twice").isNull())
    return j.filter("choice = 'sensitive'").select("id", "term", "choice")


def fingerprint(texts: DataFrame, cols: list[str]) -> DataFrame:
    """(fingerprint): one digest of a corpus: of the number of rows and of the sums of the parts of its rows' digests.

    A row's digest covers the length and the text of each of ``cols``; put a key among them, and the order counts too.
    Sums go through any number of tasks in fixed memory.
    """
    row = F.sha2(F.concat_ws("|", *(F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols)), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)"))
    sums = [F.coalesce(part(i), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]
    return texts.select(row.alias("h")).agg(F.sha2(F.concat_ws("|", F.count("*"), *sums), 256).alias("fingerprint"))
