"""Licence phrases and notices in documents, found by diagonal voting. Only DataFrame functions are used.

Every rolling word gram of a document is joined with the places where the templates hold it. A hit votes for its diagonal,
the document's place minus the template's. A phrase stands where all its grams vote for one diagonal. The hits of a
longer notice, in which words may be inserted, lost or replaced, lie on neighbouring diagonals, which are merged and
verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratawork.llm.text import ascii_lower, stored

#: Words of a gram in templates of LONG words or more, and in shorter ones; a template of one word has itself as its gram.
LONG_GRAM, SHORT_GRAM, LONG = 4, 2, 5
#: Diagonals no further apart are merged.
SLACK = 6
#: A notice is reported if this share of its words is there, and the words that are make up this share of the stretch.
LEAST_SHARE = 0.7
#: Template grams are broadcast up to this number of rows (some 100 bytes each); else they are shuffled.
BROADCAST_ROWS = 200_000

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TEMPLATES = "template int, label string, phrase boolean, text string"

#: Phrases and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Wordings of public licence notices and their labels.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
            "Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def default_templates(spark: SparkSession) -> DataFrame:
    """The fixed phrases and notices: template, label, phrase, text."""
    rows = [(label, True, text) for label, text in PHRASES] + [(label, False, text) for label, text in NOTICES]
    return spark.createDataFrame([(number, *row) for number, row in enumerate(rows)], _TEMPLATES)


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and all that is not ASCII, with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def _doubled(grams: Column, by: int, count: Column) -> Column:
    """Hashes of grams twice as long from those of `by` words; `count` is their number."""
    pairs = F.zip_with(grams, F.slice(grams, by + 1, F.size(grams)), lambda a, b: F.xxhash64(a, b))
    return F.slice(pairs, 1, F.greatest(count, F.lit(0)))


def _with_grams(df: DataFrame) -> DataFrame:
    """Rolling hashes of the column `words`: those of one, two and four words."""
    size = F.size("words")
    df = df.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("two", _doubled(F.col("one"), 1, size - 1))
    return df.withColumn("four", _doubled(F.col("two"), 2, size - 3))


def _template_grams(templates: DataFrame) -> DataFrame:
    """template, k, gram, tpl_at, gram_words: each gram of each template; and its number of words, n_tpl."""
    sized = templates.withColumn("words", words_of(F.col("text"))).filter("size(words) > 0").withColumn("n_tpl", F.size("words"))
    k = F.when(F.col("n_tpl") == 1, 1).when(F.col("n_tpl") < LONG, SHORT_GRAM).otherwise(LONG_GRAM)
    own = F.when(k == 1, F.col("one")).when(k == SHORT_GRAM, F.col("two")).otherwise(F.col("four"))
    grams = _with_grams(sized.withColumn("k", k)).select("template", "n_tpl", "k", "words", F.posexplode_outer(own).alias("tpl_at", "gram"))
    return grams.select("template", "n_tpl", "k", "gram", "tpl_at", F.expr("slice(words, tpl_at + 1, k)").alias("gram_words"))


def template_hits(docs: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (row, doc_id, n_words) and their hits (row, template, n_tpl, k, doc_at, tpl_at), both stored.

    A hit is a gram of the document that a template has at tpl_at, equal in words and not just in hash. row tells
    documents apart that share an id. Each text is read once: a last mark behind its grams stands for the document.
    """
    grams = stored(_template_grams(templates), "template-grams")
    mark = grams.sparkSession.range(1).select(
        F.lit(-1).alias("template"), F.lit(0).alias("n_tpl"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram"),
        F.lit(0).alias("tpl_at"), F.array().cast("array<string>").alias("gram_words"),
    )
    kinds = {r.k for r in grams.select("k").distinct().collect()}
    listed = grams.unionByName(mark)
    if grams.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    parts = [(k, name) for k, name in ((1, "one"), (SHORT_GRAM, "two"), (LONG_GRAM, "four")) if k in kinds]
    every = F.concat(*[F.col(name) for _, name in parts], F.array(F.lit(0).cast("long")))
    # The mark is always there; `outer` spares a filter for empty arrays that would work the grams out once more.
    exploded = _with_grams(texts).select("row", "doc_id", "words", F.posexplode_outer(every).alias("place", "gram"))
    before, doc_at = F.lit(0), F.lit(None).cast("int")
    for k, _ in parts:
        doc_at = F.when(F.col("k") == k, F.col("place") - before).otherwise(doc_at)
        before = before + F.greatest(F.size("words") - (k - 1), F.lit(0))
    is_mark = (F.col("k") == 0) & (F.col("place") == before)
    met = exploded.join(listed, "gram").withColumn("doc_at", doc_at)
    met = met.filter(is_mark | ((F.col("k") > 0) & (F.expr("slice(words, doc_at + 1, k)") == F.col("gram_words"))))
    found = stored(
        met.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "template", "n_tpl", "k", "doc_at", "tpl_at"),
        "template-hits",
    )
    return (
        found.filter("template < 0").select("row", "doc_id", "n_words"),
        found.filter("template >= 0").select("row", "template", "n_tpl", "k", "doc_at", "tpl_at"),
    )


def _phrase_places(hits: DataFrame) -> DataFrame:
    """Diagonals that all grams of a phrase vote for: row, template, first_word, last_word, n_found, n_tpl."""
    votes = hits.groupBy("row", "template", "n_tpl", "k", (F.col("doc_at") - F.col("tpl_at")).alias("first_word")).count()
    return votes.filter("count = n_tpl - k + 1").select(
        "row", "template", "first_word", (F.col("first_word") + F.col("n_tpl") - 1).alias("last_word"),
        F.col("n_tpl").alias("n_found"), "n_tpl",
    )


def _notice_spans(hits: DataFrame) -> DataFrame:
    """Verified stretches of merged neighbouring diagonals: row, template, first_word, last_word, n_found, n_tpl."""
    hits = hits.withColumn("diagonal", F.col("doc_at") - F.col("tpl_at"))
    diagonals = hits.groupBy("row", "template", "diagonal").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    merged = diagonals.withColumn("new", apart.cast("int")).withColumn("group", F.sum("new").over(order)).drop("new", "votes")
    grouped = hits.join(merged, ["row", "template", "diagonal"])
    covered = grouped.select(
        "row", "template", "n_tpl", "group", "doc_at", (F.col("doc_at") + F.col("k") - 1).alias("last"),
        F.explode(F.expr("sequence(tpl_at, tpl_at + k - 1)")).alias("word"),
    )
    words = covered.groupBy("row", "template", "n_tpl", "group", "word").agg(F.min("doc_at").alias("a"), F.max("last").alias("b"))
    spans = words.groupBy("row", "template", "n_tpl", "group").agg(
        F.min("a").alias("first_word"), F.max("b").alias("last_word"), F.count("*").cast("int").alias("n_found")
    )
    long_enough = F.col("n_found") >= LEAST_SHARE * F.col("n_tpl")
    dense = F.col("n_found") >= LEAST_SHARE * (F.col("last_word") - F.col("first_word") + 1)
    return spans.filter(long_enough & dense).select("row", "template", "first_word", "last_word", "n_found", "n_tpl")


def license_spans(docs: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (row, doc_id, n_words) and every verified span of a template in them.

    Spans: row, template, label, phrase, first_word, last_word (words from 0), n_found (words of the template that are
    there), n_tpl (its words). `templates` holds template (a number each), label, phrase and text. Phrases must be there
    word for word, each place is a span; of the others LEAST_SHARE of the words must be, within a stretch that they make
    up to that share. Words are runs of ASCII letters, digits and non-ASCII signs. Null texts are empty, null and
    repeated ids are rows of their own, templates without words match nowhere, other columns are ignored.
    """
    templates = stored(templates.select("template", "label", "phrase", "text"), "templates")
    rows, hits = template_hits(docs, templates)
    kinds = F.broadcast(templates.select("template", "label", "phrase")) if templates.count() <= BROADCAST_ROWS else templates.select(
        "template", "label", "phrase"
    )
    hits = hits.join(kinds.select("template", "phrase"), "template")
    spans = _phrase_places(hits.filter("phrase")).unionByName(_notice_spans(hits.filter("not phrase")))
    return rows, spans.join(kinds, "template").select(
        "row", "template", "label", "phrase", "first_word", "last_word", "n_found", "n_tpl"
    )


def license_report(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of phrases; first_word and last_word are their smallest and largest start (null without
    one). base_labels are the labels of phrases, labels those of notices too; both distinct, in order and joined by
    commas, empty if there are none. score is the largest share of a template's words that a span of the document holds,
    0 without spans. Odd rows are treated as `license_spans` says.
    """
    rows, spans = license_spans(docs, templates)
    start = F.when(F.col("phrase"), F.col("first_word")).cast("long")
    found = spans.groupBy("row").agg(
        F.count_if("phrase").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.col("n_found") / F.col("n_tpl")).alias("score"),
    )
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
