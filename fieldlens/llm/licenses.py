"""Licence scan (2): a positional index of rare licence words. DataFrame functions only.

1. Every text is split into words once; the places of the templates' words are staged, with one closing row a document
   that holds its word count.
2. The document frequency of each licence word over all documents gives its IDF. Each template is indexed by its
   rarest words only (``rare_words``); the index, a few hundred rows, is broadcast.
3. A document looks up all its indexed words, the highest-IDF licence words it holds. A posting's place in its template
   gives the place where the template would begin (the relative position); equal ones meet.
4. Each such alignment is verified word by word against the document's places: a base phrase must stand there whole; a
   notice needs ``MIN_SHARE`` of its IDF weight and its mandatory key phrase whole.

Defined results: a null, empty or wordless text has no words, no places and score 0; no documents give no rows; every row
comes back with the result of its own text, rows that repeat a doc_id and rows without one too; extra columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import let, read_table, stage

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Notices (label, text, key phrase that must stand whole).
NOTICES = (
    ("apache-notice", "licensed under the apache license version 2 0", "apache license"),
    ("gpl-notice", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation", "gnu general public license"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files", "permission is hereby granted"),
    ("bsd-terms", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license"),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ROW = ["own", "text_key"]  # a text of an id: doc_id (the least long for none) and the text's hash
MIN_SHARE = 0.7


def _templates() -> list[dict]:
    out = []
    for label, text, key, base in ([(b, p, p, True) for p, b in BASE] + [(b, p, k, False) for b, p, k in NOTICES]):
        words, k = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(k)] == k)
        out.append({"label": label, "words": words, "key": range(at, at + len(k)), "base": base})
    return out


def rare_words(words: list[str], idf: dict[str, float]) -> list[str]:
    """The words that index a template: half of them at most, four at most, rarest first."""
    distinct = sorted(set(words), key=lambda w: (-idf[w], w))
    return distinct[:min(4, math.ceil(len(distinct) / 2))]


def word_places(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, own, text_key, pos, word) of the vocabulary's words; the row with the empty word holds the word count as
    pos."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                          "abcdefghijklmnopqrstuvwxyz")

    def inner(w):  # without the empty strings before a first and after a last separator
        first = (F.get(w, F.lit(0)) == "").cast("int")
        last = (F.element_at(w, -1) == "").cast("int")
        return F.slice(w, first + 1, F.greatest(F.size(w) - first - last, F.lit(0)))
    words = F.concat(let(F.split(lowered, SEPARATORS), inner), F.array(F.lit("")))
    doc_id = F.col(id_col).cast("long")
    return (docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-1 << 63)).alias("own"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), words.alias("w"))
            .select("doc_id", *ROW, F.posexplode("w").alias("pos", "word"))
            .where(F.col("word").isin(["", *vocabulary])))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    spark = docs.sparkSession
    templates = _templates()
    vocabulary = sorted({w for t in templates for w in t["words"]})
    places = stage(word_places(docs, vocabulary, id_col, text_col), "words")
    ends = places.where("word = ''").select("doc_id", *ROW, F.col("pos").cast("long").alias("n_words"))
    hits = places.where("word <> ''").drop("doc_id")
    if not ends.groupBy(*ROW).count().where("count > 1").limit(1).isEmpty():
        hits = hits.distinct()

    # Document frequencies over all documents: one row per licence word.
    df = hits.select(*ROW, "word").distinct().groupBy("word").count()
    seen = {r["word"]: r["count"] for r in df.collect()}
    n = ends.count()
    idf = {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1 for w in vocabulary}
    postings, expected = [], []
    for number, t in enumerate(templates):
        rare = rare_words(t["words"], idf)
        for k, w in enumerate(t["words"]):
            if w in rare:
                postings.append((w, number, k))
            expected.append((number, k, w, float(idf[w]), k in t["key"]))
    index = spark.createDataFrame(postings, "word string, template int, k int")
    expected = spark.createDataFrame(expected, "template int, k int, word string, idf double, key boolean")
    facts = spark.createDataFrame(
        [(i, t["label"], t["base"], len(t["words"]), len(t["key"]), float(sum(idf[w] for w in t["words"])))
         for i, t in enumerate(templates)],
        "template int, label string, base boolean, n_template int, n_key int, total double")

    aligned = (hits.join(F.broadcast(index), "word")
               .select(*ROW, "template", (F.col("pos") - F.col("k")).alias("start")).where("start >= 0").distinct())
    wanted = (aligned.join(F.broadcast(expected), "template")
              .select(*ROW, "template", "start", (F.col("start") + F.col("k")).alias("pos"), "word", "idf", "key"))
    found = (wanted.join(hits, [*ROW, "pos", "word"]).groupBy(*ROW, "template", "start")
             .agg(F.count("*").alias("matched"), F.sum("idf").alias("weight"), F.sum(F.col("key").cast("int")).alias("keyed"))
             .join(F.broadcast(facts), "template"))
    whole = F.col("matched") == F.col("n_template")
    share = F.when(whole, 1.0).otherwise(F.least(F.lit(1.0), F.col("weight") / F.col("total")))
    found = found.withColumn("share", share).withColumn(
        "named", F.when(F.col("base"), whole).otherwise((F.col("share") >= MIN_SHARE) & (F.col("keyed") == F.col("n_key"))))
    is_base = F.col("base") & F.col("named")
    by_doc = found.groupBy(*ROW).agg(
        F.count(F.when(is_base, 1)).alias("n_base"), F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("named"), F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"))
    return ends.join(by_doc, ROW, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


def op2(spark, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))
