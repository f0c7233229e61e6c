"""Which pages carry trustworthy text, which are blank or copies, and which need an engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import ranks
from quire.params import Documents, Routing
from quire.shared import written

CLASSES = ("text_layer", "blank", "duplicate", "needs_ocr")


def assessed(pages: DataFrame, layer: str = "embedded_text", rule: Routing = Routing()) -> DataFrame:
    """``pages`` with ``cleaned``, ``word_count``, ``quality``, ``usable`` and ``reason`` of the text layer.

    Null and blank layers carry nothing; too few words, too many replacement characters or too few
    plausible tokens make a layer unusable, in this order.
    """
    df = T.with_normal_form(pages.withColumn("__layer", F.col(layer)), "__layer")
    df = df.withColumn("cleaned", T.clean_layer("__layer")).withColumn("__tokens", T.tokens("cleaned"))
    n = F.size("__tokens").cast("bigint")
    damaged = F.regexp_count("cleaned", F.lit(r"[\x{fffd}\x{fffe}\x{ffff}]")) > F.length("cleaned") * 0.01
    share = F.size(F.filter("__tokens", T.looks_like_language)) / F.size("__tokens")
    df = df.withColumn("word_count", n).withColumn("__few", n < rule.min_words).withColumn("__damaged", damaged)
    df = df.withColumn("quality", F.when(F.col("__few") | F.col("__damaged"), F.lit(0.0)).otherwise(share))
    df = df.withColumn("usable", ~F.col("__few") & ~F.col("__damaged") & (F.col("quality") >= rule.min_quality) & ~T.is_blank(layer))
    count = F.col("word_count").cast("string")
    reason = (
        F.when(T.is_blank(layer), F.lit("the page carries no text layer"))
        .when(F.col("__few"), F.concat(F.lit("the text layer holds only "), count, F.lit(" word(s), too few to be the page")))
        .when(F.col("__damaged"), F.lit("the text layer is full of replacement characters, so its font encoding is broken"))
        .when(~F.col("usable"), F.concat(F.lit("only "), F.bround(F.col("quality") * 100).cast("int").cast("string"), F.lit("% of the text layer reads as language, so it is probably a damaged encoding")))
        .otherwise(F.concat(F.lit("the page carries a usable text layer of "), count, F.lit(" words")))
    )
    return df.withColumn("reason", reason).drop("__layer", "__tokens", "__few", "__damaged")


def fingerprint(image: str | Column) -> Column:
    """Content address of a page: SHA-256 of its bytes (text counts as its UTF-8 bytes)."""
    return F.sha2(T.column(image).cast("binary"), 256)


def _why(first: Column) -> Column:
    return (
        F.when(F.col("page_class") == "text_layer", F.col("reason"))
        .when(F.col("page_class") == "blank", F.concat(F.lit("the page is blank ("), F.format_string("%.3f", F.col("ink") * 100), F.lit("% of it carries ink)")))
        .when(F.col("page_class") == "duplicate", F.concat(F.lit("the page is identical to page "), first.cast("string")))
        .when(F.col("word_count") > 0, F.col("reason"))
        .otherwise(F.lit("the page must be read by an engine"))
    )


def _with_class(df: DataFrame, by_layer: Column, first: Column, rule: Routing) -> DataFrame:
    """``df`` with page_class, route_reason and duplicate_of, given the number of the first page of the same image."""
    blank = F.lit(rule.skip_blank_pages) & ~F.col("usable") & F.coalesce(F.col("ink") < rule.blank_ink, F.lit(False))
    copy = F.lit(rule.detect_duplicates) & (first < F.col("page_number"))
    df = df.withColumn("page_class", F.when(by_layer, "text_layer").when(blank, "blank").when(copy, "duplicate").otherwise("needs_ocr"))
    return df.withColumn("route_reason", _why(first)).withColumn("duplicate_of", F.when(F.col("page_class") == "duplicate", first).cast("bigint"))


def routed(pages: DataFrame, *, image: str = "embedded_text", layer: str = "embedded_text", rule: Routing = Routing()) -> DataFrame:
    """``pages`` with ``page_class``, ``route_reason``, ``fingerprint`` and ``duplicate_of``.

    Needs doc, page_number, ``ink`` (null: not measured) and the image or what stands for it. Pages
    with a usable layer are split off first: they, and their texts, are neither fingerprinted nor
    shuffled. Pages are assessed once. Where no texts are needed, ``classified`` reads the pages once.
    """
    # kept as a table: a filter on what was found would have every page assessed again on its way to the scan, once for each side
    df = written(assessed(pages, layer, rule), "assessed")
    by_layer = F.col("usable") & F.lit(rule.use_text_layer)
    plain = _with_class(df.filter(by_layer).withColumn("fingerprint", F.lit("")), F.lit(True), F.col("page_number"), rule)
    rest = df.filter(~by_layer).withColumn("fingerprint", fingerprint(image))
    rest = rest.withColumn("__first", F.min("page_number").over(Window.partitionBy("doc", "fingerprint")))
    return plain.unionByName(_with_class(rest, F.lit(False), F.col("__first"), rule).drop("__first"))


def classified(pages: DataFrame, *, image: str = "embedded_text", layer: str = "embedded_text", rule: Routing = Routing()) -> DataFrame:
    """The routes of ``routed`` without images and texts: pages are read and assessed once, and what is shuffled is a short row a page."""
    by_layer = F.col("usable") & F.lit(rule.use_text_layer)
    short = assessed(pages, layer, rule).withColumn("by_layer", by_layer)
    short = short.select("doc", "page_number", "ink", "word_count", "quality", "usable", "reason", "by_layer", F.when(F.col("by_layer"), "").otherwise(fingerprint(image)).alias("fingerprint"))
    # pages with a layer have no fingerprint; each is alone
    own = F.when(F.col("by_layer"), F.col("page_number").cast("string")).otherwise(F.col("fingerprint"))
    short = short.withColumn("__first", F.min("page_number").over(Window.partitionBy("doc", "by_layer", own)))
    return _with_class(short, F.col("by_layer"), F.col("__first"), rule).drop("__first", "by_layer")


def routed_or_all(pages: DataFrame, *, image: str = "embedded_text", layer: str = "embedded_text", rule: Routing = Routing()) -> DataFrame | None:
    """``routed``, or None where routing is switched off: then there is no plan, and every engine reads every page."""
    return routed(pages, image=image, layer=layer, rule=rule) if rule.enabled else None


def plan_summary(routes: DataFrame) -> DataFrame:
    """Per document: pages, how many of each class (zeros kept), how many avoid an engine."""
    counts = [F.count_if(F.col("page_class") == c).alias(c) for c in CLASSES]
    return routes.groupBy("doc").agg(F.count("*").alias("pages"), *counts).withColumn("pages_avoided", F.col("pages") - F.col("needs_ocr"))


def headline(summary: DataFrame) -> DataFrame:
    """``summary`` with one sentence per document."""
    part = lambda c, words: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(words)))
    avoided = F.concat_ws(", ", part("text_layer", " from the text layer"), part("duplicate", " duplicate"), part("blank", " blank"))
    total, ocr = F.col("pages").cast("string"), F.col("needs_ocr").cast("string")
    return summary.withColumn(
        "headline",
        F.when(F.col("pages") == 0, F.lit("No pages to route."))
        .when(avoided == "", F.concat(F.lit("All "), total, F.lit(" page(s) need OCR.")))
        .otherwise(F.concat(ocr, F.lit(" of "), total, F.lit(" page(s) need OCR; the rest are covered without a model ("), avoided, F.lit(")."))),
    )


def subset(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages that ``wanted`` (doc, page_number) names."""
    return pages.join(wanted, ["doc", "page_number"], "left_semi")


def page_limited(pages: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` pages of each document, with the ``warning`` that pages were cut; 0 keeps all."""
    if limit <= 0:
        return pages.withColumn("warning", F.lit(None).cast("string"))
    # only names of pages are ranked, by ranges: a document of any number of pages is spread over tasks
    names = pages.select("doc", "page_number")
    total = names.groupBy("doc").agg(F.count("*").alias("__total"))
    first = ranks.numbered(names, ["doc"], [F.col("page_number")], "__n").filter(F.col("__n") <= limit)
    said = F.concat(F.lit(f"Only the first {limit} of "), F.col("__total").cast("string"), F.lit(" pages were processed because of the configured page limit."))
    kept = ranks.joined(first, total, ["doc"]).select("doc", "page_number", F.when(F.col("__total") > limit, said).alias("warning"))
    return ranks.joined(pages, kept, ["doc", "page_number"])


def rendered_size(width_pt: Column, height_pt: Column, rule: Documents = Documents()) -> tuple[Column, Column]:
    """Pixels of a rendered page: points at the resolution, scaled down to the greatest dimension."""
    w, h = (F.bround(x * (rule.render_dpi / 72.0)) for x in (width_pt, height_pt))
    longest = F.greatest(w, h)
    scale = F.lit(float(rule.max_dimension)) / longest
    cut = lambda x: F.when(longest > rule.max_dimension, F.greatest(F.lit(1), F.floor(x * scale))).otherwise(x).cast("bigint")
    return cut(w), cut(h)
