"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined to the places of the same hashes in short
license notices. A hit at document word p and template word q votes for the diagonal p - q; neighbouring
diagonals of one document and template are merged into spans (an inserted or lost word shifts the
diagonal). Each span is then verified word by word; of overlapping ones the closest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm.common import all_equal, ascii_lower, gram_hashes, settle, small, words

# Phrases whose places are counted as they stand, and the label of each.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Customary license notices and the label of each.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the "
            "GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    *((f"cc-{x.lower().replace(' ', '-')}-4.0", f"Licensed under CC {x} 4.0.") for x in ("BY", "BY SA", "BY ND", "BY NC SA", "BY NC ND")),
    *((f"cc-by-{k}-4.0", f"licensed under a Creative Commons Attribution-{x} 4.0 International License") for k, x in (
        ("nc", "NonCommercial"), ("sa", "ShareAlike"), ("nd", "NoDerivatives"), ("nc-sa", "NonCommercial-ShareAlike"),
        ("nc-nd", "NonCommercial-NoDerivatives"))),
    *((f"{k}-3.0", f"This work is licensed under the GNU {x} General Public License, version 3.") for k, x in (("lgpl", "Lesser"), ("agpl", "Affero"))),
    *((k, f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {x} General Public "
          "License as published by the Free Software Foundation")
      for k, what, x in (("lgpl", "program", "Lesser"), ("lgpl", "library", "Lesser"), ("agpl", "program", "Affero"))),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
]


def template_table(spark: SparkSession, templates=None) -> DataFrame:
    """``tid, label, tw`` (the template's words)."""
    rows = [(i, label, text) for i, (label, text) in enumerate(TEMPLATES if templates is None else templates)]
    t = spark.createDataFrame(rows, "tid int, label string, text string")
    return t.select("tid", "label", words(ascii_lower(F.col("text"))).alias("tw")).where(F.size("tw") > 0)


def _places(w: str, phrase: str) -> Column:
    """Start positions of a phrase's words in the array column ``w``."""
    parts = phrase.split(" ")

    def at(x, i):
        hit = x == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit = hit & (F.get(F.col(w), i + k) == p)
        return F.when(hit, i)
    return F.filter(F.transform(w, at), lambda p: p.isNotNull())


def license_scan(docs: DataFrame, templates=None, phrases=None, gram: int = 3, gap: int = 3,
                 min_cover: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places where a phrase's words stand consecutively; ``first_word`` and ``last_word``
    are the smallest and largest of their starts (words from 0; null without places). ``labels`` adds the label
    of every template of which a span covers ``min_cover`` of the words, of the template's or the span's own, whichever are
    more, unless a span that overlaps it covers a larger share; ``score`` is the best such share, 1 with
    a phrase, 0 without either. A template shorter than ``gram`` words is never voted for. A null or empty text
    has no words. Rows with equal id and text get equal results; null ids are kept. Empty tables give empty results.
    """
    spark, phrases = docs.sparkSession, PHRASES if phrases is None else phrases
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    tpl = template_table(spark, templates)
    grams = gram_hashes(tpl.withColumn("h", F.transform("tw", lambda x: F.xxhash64(F.lower(x)))), "h", "g", gram)
    grams = settle(grams.select("tid", F.posexplode_outer("g").alias("q", "gh")).where("gh is not null"))

    sep = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    maybe = "(?i)" + "|".join(p.replace(" ", sep) for p, _ in phrases)
    per_doc = docs.select("doc_id", "th", words(F.col("text")).alias("w"), F.when(
        F.col("text").rlike(maybe), words(ascii_lower(F.col("text")))).alias("wl"))
    places = F.struct(*[F.coalesce(_places("wl", p), F.array().cast("array<int>")).alias(f"p{k}")
                        for k, (p, _) in enumerate(phrases)])
    per_doc = per_doc.select("doc_id", "th", F.size("w").cast("long").alias("n_words"),
                             F.transform("w", lambda x: F.xxhash64(F.lower(x))).alias("h"),
                             F.when(F.col("wl").isNotNull(), places).alias("base"))
    per_doc = gram_hashes(per_doc, "h", "g", gram).select("doc_id", "th", "n_words", "base", F.posexplode_outer("g").alias("p", "gh"))
    votes = per_doc.join(small(grams, 24), "gh", "left").where("tid is not null or p is null or p = 0")
    state = settle(votes.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"), F.max("base").alias("base"),
        F.count_distinct(F.when(F.coalesce("p", F.lit(0)) == 0, F.lit(1))).alias("one"),
        F.collect_set(F.when(F.col("tid").isNotNull(), F.struct("tid", (F.col("p") - F.col("q")).alias("diag"), "p"))).alias("votes")))
    # Vote counts, spans and merging of neighbours, per document and template.
    diag = (state.where(F.size("votes") > 0).select("doc_id", "th", F.explode_outer("votes").alias("v")).select("doc_id", "th", "v.*")
            .groupBy("doc_id", "th", "tid", "diag").agg(F.count("*").alias("n_votes"), F.min("p").alias("lo"), F.max("p").alias("hi")))
    order = Window.partitionBy("doc_id", "th", "tid").orderBy("lo", "diag")
    far = (F.abs(F.col("diag") - F.lag("diag").over(order)) > gap) | (F.col("lo") > F.max("hi").over(
        order.rowsBetween(Window.unboundedPreceding, -1)) + gap + gram)
    spans = (diag.withColumn("new", F.coalesce(far, F.lit(True)).cast("int"))
             .withColumn("span", F.sum("new").over(order))
             .groupBy("doc_id", "th", "tid", "span")
             .agg(F.sum("n_votes").alias("n_votes"), F.collect_set("diag").alias("diags"),
                  F.min("lo").alias("lo"), (F.max("hi") + gram - 1).alias("hi")))
    spans = settle(spans.join(F.broadcast(tpl), "tid").where(F.col("n_votes") + gram - 1 >= min_cover * F.size("tw") - gap * gram))
    keys = spans.select("doc_id", "th").distinct()
    near = docs.join(small(settle(keys), 24), all_equal(docs, keys, "doc_id", "th"), "left_semi").distinct()
    near = near.select("doc_id", "th", words(ascii_lower(F.col("text"))).alias("w"))
    same = F.flatten(F.transform("diags", lambda d: F.filter(F.transform("tw", lambda x, i: F.when(
        F.get(F.col("w"), i + d) == x, i)), lambda i: i.isNotNull())))
    found = F.size(F.array_distinct(same)) / F.greatest(F.size("tw"), F.col("hi") - F.col("lo") + 1)
    checked = (near.join(spans, all_equal(near, spans, "doc_id", "th"))
               .select(near["doc_id"], near["th"], "label", found.alias("cover"), "lo", "hi").where(F.col("cover") >= min_cover))
    order = Window.partitionBy("doc_id", "th").orderBy("lo", "hi")
    apart = F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cluster = (checked.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("cluster", F.sum("new").over(order))
               .groupBy("doc_id", "th", "cluster").agg(F.collect_set(F.struct("label", "cover", "lo", "hi")).alias("c")))
    best = F.filter("c", lambda x: ~F.exists("c", lambda y: (y["cover"] > x["cover"]) & (y["lo"] <= x["hi"]) & (x["lo"] <= y["hi"])))
    checked = cluster.select("doc_id", "th", best.alias("c")).groupBy("doc_id", "th").agg(
        F.array_distinct(F.flatten(F.collect_list("c.label"))).alias("found"), F.max(F.array_max("c.cover")).alias("cover"))
    counts = docs.groupBy("doc_id", "th").agg(F.count("*").alias("copies"))
    s, c, n = state.alias("s"), checked.alias("c"), counts.alias("n")
    out = (s.join(c, F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("s.th") == F.col("c.th")), "left")
           .join(n, F.col("s.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("s.th") == F.col("n.th")), "left"))
    empty = F.array().cast("array<int>")
    parts = [F.coalesce(F.col(f"s.base.p{k}"), empty) for k in range(len(phrases))]
    starts = F.concat(*parts)
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(parts, phrases)]),
                                                  lambda x: x.isNotNull())))
    labels = F.array_sort(F.array_union(base, F.coalesce(F.col("c.found"), F.array().cast("array<string>"))))
    return out.select(
        F.col("s.doc_id").alias("doc_id"), F.col("s.n_words").alias("n_words"), F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("c.cover"), F.lit(0.0))).alias("score"),
        F.explode_outer(F.sequence(F.lit(1), F.col("n.copies").cast("int"))).alias("_copy")).drop("_copy")
