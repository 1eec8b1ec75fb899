"""License scan by diagonal voting, in DataFrame expressions only."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kindred.shared import materialize

#: Phrases that count only where their words stand consecutively, and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Notices that count where at least NOTICE_SHARE of their word pairs vote for neighbouring diagonals; labels of this scan's own.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this work is in the public domain", "public-domain"),
    ("released under the terms of the creative commons attribution license", "cc-notice"),
)
NOTICE_SHARE = 0.75
#: Diagonals at most so far apart are one span: words may be missing or put in.
SLACK = 2
#: Stands behind a text's last word, where its place says how many words there are; no word, as words have no such character.
END = "\0"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none.

    lower() also changes letters beyond A-Z, but only the Kelvin sign into an ASCII one: it is put
    aside first. Other letters beyond ASCII are in no template, so their case can't matter.
    """
    ascii_lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.filter(F.split(ascii_lower, SEPARATORS), lambda w: w != "")


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(g, w1, w2, tpos, template, label, exact, pairs): every rolling pair of template words, and the end of a text; as many rows as templates have words."""
    rows = [(a, b, i, t, label, exact, len(w) - 1) for t, (text, label, exact) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in notices]) for w in [text.split()] for i, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    rows.append((END, END, 0, -1, None, False, 0))
    made = spark.createDataFrame(rows, "w1 string, w2 string, tpos int, template int, label string, exact boolean, pairs int")
    return made.select(F.xxhash64("w1", "w2").alias("g"), "*")


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of ``docs`` (doc_id, text, any more columns).

    Hashes of all rolling word pairs are joined to the templates' positions; each match votes for
    the diagonal text position - template position. Neighbouring diagonals are merged into spans,
    and spans are verified by their words: phrases need all pairs on one diagonal, notices
    NOTICE_SHARE of them within a span not much longer than the template. ``score`` is the largest
    share of a template's pairs in any span, 0 without one; ``spans`` lists verified ones as
    (label, start, end).

    The templates are broadcast: their size is a parameter of the code, not of the data. Null or
    empty texts have no words, null first_word and empty labels. Rows that repeat a
    doc_id with other texts are scanned apart. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), words(F.col("text")).alias("words"))
    placed = base.select("doc_id", "version", "words", F.posexplode(F.concat("words", F.array(F.lit(END)))).alias("pos", "w1")).where(F.col("pos") != F.size("words") - 1)
    after = F.when(F.col("pos") < F.size("words"), F.get("words", F.col("pos") + 1)).otherwise(F.lit(END))
    pairs = placed.select("doc_id", "version", "pos", "w1", after.alias("w2")).withColumn("g", F.xxhash64("w1", "w2"))
    t = F.broadcast(templates(spark, phrases, notices))
    # One pass over the texts: the votes, and one row a text for its end.
    found = materialize(pairs.join(t, (pairs.g == t.g) & (pairs.w1 == t.w1) & (pairs.w2 == t.w2)).select("doc_id", "version", "pos", "tpos", "template", "label", "exact", "pairs"), "votes")
    votes, sizes = found.where("template >= 0"), found.where("template < 0").select("doc_id", "version", F.col("pos").cast("long").alias("n_words"))
    # A text given twice votes twice: distinct pairs count.
    each = votes.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy("doc_id", "version", "template", "label", "exact", "pairs", "diagonal").agg(F.collect_set("tpos").alias("hit"), F.min("pos").alias("start"), F.max("pos").alias("stop"))
    order = Window.partitionBy("doc_id", "version", "template").orderBy("diagonal")
    step = F.when(F.col("exact") | F.lag("diagonal").over(order).isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK), 1).otherwise(0)
    merged = each.withColumn("new", step).withColumn("span", F.sum("new").over(order)).groupBy("doc_id", "version", "template", "label", "exact", "pairs", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("n"), F.min("start").alias("start"), (F.max("stop") + 1).alias("end"))
    whole = F.when(F.col("exact"), F.col("n") == F.col("pairs")).otherwise((F.col("n") >= NOTICE_SHARE * F.col("pairs")) & (F.col("end") - F.col("start") <= 1.5 * F.col("pairs") + 1))
    spans = merged.withColumn("whole", whole).withColumn("base", F.col("whole") & F.col("exact"))
    labels = lambda flag: F.array_join(F.sort_array(F.collect_set(F.when(F.col(flag), F.col("label")))), ",")
    found = spans.groupBy("doc_id", "version").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("whole").alias("labels"),
        F.round(F.max(F.col("n") / F.col("pairs")), 6).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("whole"), F.struct("label", "start", "end")))).alias("spans"),
    )
    found = found.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    out = sizes.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast("array<struct<label:string,start:int,end:int>>")).alias("spans"))
