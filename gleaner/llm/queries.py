"""The pN_ queries: each operator with its production parameters over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.session import read_table, spread


def _budget(spark: SparkSession, sf_dir: str, name: str):
    return read_table(spark, sf_dir, "size_budgets").filter(F.col("budget") == name).first()  # a fixed table of 4 rows


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunking import piece_spans

    b = _budget(spark, sf_dir, "label_chunk")
    rows = piece_spans(spread(read_table(spark, sf_dir, "label_sessions").select("row_id", "_text"), "row_id"), "_text", b.capacity, b.overlap_len)
    kinds = F.array(F.lit("oversized"), F.when(F.col("no_boundary"), F.lit("no_boundary")))
    return rows.filter(F.size("spans") > 1).select("row_id", F.explode(F.array_compact(kinds)).alias("kind"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunking import split_oversized

    b = _budget(spark, sf_dir, "label_chunk")
    return split_oversized(read_table(spark, sf_dir, "label_sessions"), "row_id", "_text", "chunk_index", b.capacity, b.overlap_len)


def p1_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunking import cut_kinds

    return cut_kinds(p1_pieces(spark, sf_dir), "_text")


def p1_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, n_chars): pieces without their overlap add up to the text, in order, none above the capacity."""
    b = _budget(spark, sf_dir, "label_chunk")
    p = p1_pieces(spark, sf_dir).filter("_text is not null")
    own = F.when(F.col("piece_no") == 0, F.length("_text")).otherwise(F.length("_text") - b.overlap_len)
    return p.groupBy("row_id").agg(F.sum(own).alias("n_chars"), F.min(F.length("_text") <= b.capacity).alias("fits"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .overlap import overlapping_pairs

    return overlapping_pairs(read_table(spark, sf_dir, "gold_ner"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .overlap import linked_records

    return linked_records(read_table(spark, sf_dir, "gold_ner"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .overlap import overlap_report

    return overlap_report(read_table(spark, sf_dir, "gold_ner"))


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, language_segments

    examples = read_table(spark, sf_dir, "training_examples").select("example_id", "text", "language")
    return language_segments(spread(examples, "example_id"), *fit(examples))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import mislabelled

    return mislabelled(_segmented(spark, sf_dir))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).select("example_id", F.explode("segments").alias("s")).select("example_id", "s.*")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_counts(spark, sf_dir).select("item_text")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .heavy import frequent_values

    return frequent_values(read_table(spark, sf_dir, "label_sessions"), "_text", 200).withColumnRenamed("value", "item_text")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .components import record_groups

    return record_groups(read_table(spark, sf_dir, "gold_ner"), read_table(spark, sf_dir, "gold_sources"))


def _personal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from .pii import find_personal, fit, texts_of

    texts = spread(texts_of(read_table(spark, sf_dir, "training_examples"), read_table(spark, sf_dir, "challenge")), "row_key")
    finder, searched = fit(texts)
    return texts, find_personal(searched, finder)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir)[1].select("tab", "row_key", F.explode("spans").alias("s")).select("tab", "row_key", "s.*")


def p5_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import masked

    return masked(*_personal(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .components import group_splits

    return group_splits(_groups(spark, sf_dir))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .components import split_report

    return split_report(p6_splits(spark, sf_dir))


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records come out once, no group is in two splits, and no split is a hundredth off its share."""
    s = p6_splits(spark, sf_dir)
    parted = s.groupBy("group_id").agg(F.count_distinct("split").alias("k"), F.count("*").alias("n"))
    n = lambda x: F.coalesce(F.sum(F.when(F.col("split") == x, 1)), F.lit(0)) / F.count("*")
    sizes = s.agg(((F.abs(n("train") - 0.8) <= 0.01) & (F.abs(n("validation") - 0.1) <= 0.01) & (F.abs(n("test") - 0.1) <= 0.01)).alias("shares_met"))
    return parted.agg(F.sum("n").alias("records"), F.count(F.when(F.col("k") > 1, 1)).alias("parted_groups")).crossJoin(sizes)  # one row each


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .confusables import look_alikes

    return look_alikes(read_table(spark, sf_dir, "training_examples"))


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .confusables import look_classes

    return look_classes(read_table(spark, sf_dir, "training_examples"))


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .confusables import consistent_forms

    return consistent_forms(read_table(spark, sf_dir, "training_examples"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.session import cut_lineage

    from .tokens import n_tokens

    return cut_lineage(spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id").select("doc_id", "source", "lang", n_tokens("text").alias("n_tokens")))


def _packed(spark: SparkSession, sf_dir: str, budget: str) -> DataFrame:
    from .packing import pack

    return pack(_sized(spark, sf_dir), _budget(spark, sf_dir, budget).capacity)


def p8_pack_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "pack_small")


def p8_pack_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "pack_large")


def p8_fill_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import fill_report

    return fill_report(p8_pack_small(spark, sf_dir), _budget(spark, sf_dir, "pack_small").capacity)


def p8_fill_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import fill_report

    return fill_report(p8_pack_large(spark, sf_dir), _budget(spark, sf_dir, "pack_large").capacity)


def _packing_check(spark: SparkSession, sf_dir: str, packed: DataFrame, budget: str) -> DataFrame:
    """Every document with all its tokens, only oversized ones divided, no container overfull, at least 98 % of the room used."""
    from .packing import fill_report

    cap = _budget(spark, sf_dir, budget).capacity
    sized = _sized(spark, sf_dir)
    docs = packed.groupBy("doc_id").agg(F.sum("piece_tokens").alias("t"), F.count("*").alias("k")).join(sized, "doc_id", "full")
    a = docs.agg(
        F.count("*").alias("documents"), F.count(F.when(~F.col("t").eqNullSafe(F.col("n_tokens")), 1)).alias("lost"),
        F.count(F.when((F.col("k") > 1) & (F.col("n_tokens") <= cap), 1)).alias("parted"),
    )
    b = packed.filter("container is not null").groupBy("container").agg(F.sum("piece_tokens").alias("t")).agg(F.count(F.when(F.col("t") > cap, 1)).alias("overfull"))
    return a.crossJoin(b).crossJoin(fill_report(packed, cap).select((F.col("fill") >= 0.98).alias("filled")))  # one row each


def p8_check_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing_check(spark, sf_dir, p8_pack_small(spark, sf_dir), "pack_small")


def p8_check_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing_check(spark, sf_dir, p8_pack_large(spark, sf_dir), "pack_large")


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import share_report

    return share_report(p9_selection(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p9_even_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most tokens of which every source gives exactly its share: as many as the scarcest source allows."""
    from .mixing import mix

    return mix(_sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"), even=True)


def p9_even_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import share_report

    return share_report(p9_even_selection(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source reaches its share of all tokens, or gives all it has as often as it may; no document is used too often; the even selection meets every share."""
    from .mixing import settled_source, share_report

    targets, sized = read_table(spark, sf_dir, "mix_targets"), _sized(spark, sf_dir)
    stock = sized.groupBy(settled_source(F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("stock"))
    r, e = share_report(p9_selection(spark, sf_dir), targets), p9_even_shares(spark, sf_dir).select("source", F.col("share").alias("even"))
    d = r.join(stock, "source", "left").join(e, "source")
    met = (F.col("share") >= F.col("target_share") - 0.01) | (F.col("tokens") == F.coalesce("stock", F.lit(0)) * F.col("max_repeats"))
    return d.select("source", met.alias("share_met"), (F.col("most_times") <= F.col("max_repeats")).alias("repeats_met"), (F.abs(F.col("even") - F.col("target_share")) <= 0.01).alias("even_met"))


def _mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .subjects import document_subjects

    documents = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return document_subjects(documents, read_table(spark, sf_dir, "doc_labels"), read_table(spark, sf_dir, "subject_areas"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .subjects import found_subjects

    return found_subjects(_mixtures(spark, sf_dir))


def p10_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .subjects import corpus_by_subject

    return corpus_by_subject(_mixtures(spark, sf_dir))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
