"""License scan by diagonal voting.

All rolling word grams of a text (of two words, and of four) are joined, in Spark, to the positions of the same grams in the
templates; templates of twelve words and more vote with grams of four words, as pairs such as "of the" are too common. A hit
votes for the diagonal (text position minus template position) of its template. The votes of diagonals up to ``drift`` apart, as
inserted or missing words make them, are merged into one span, and a span is verified by the share of the template's words that
it covers. Of merged spans that overlap on diagonals the best covered stays, then the shortest; of spans of all templates that
begin or end at one word the best covered, then the longest template. The join compares the words themselves besides their
hash. Short fixed phrases are templates as well: those need all their words in place on a single diagonal.

Edge cases: null counts as empty text; texts with fewer than two words have no grams. Repeated rows get equal results
each. Only ``doc_id`` and ``text`` are read. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import ascii_lower, stored

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DRIFT, COVER = 3, 0.8

# Phrases counted at every place, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening, grant, condition and warranty wording of well-known licenses, and their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability": "mit",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2.0",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-1.0",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary": "unlicense",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-1.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
}


def template_grams(phrases: dict[str, str], templates: dict[str, str]) -> list[tuple[int, str, bool, int, int, int, str]]:
    """(tid, label, exact, n, k, j, gram): every gram (k words from word j on) of every phrase and template of n words."""
    rows, texts = [], [(*x, True) for x in phrases.items()] + [(*x, False) for x in templates.items()]
    for tid, (text, label, exact) in enumerate(texts):
        w = text.split()
        k = 4 if len(w) >= 12 and not exact else 2
        rows += [(tid, label, exact, len(w), k, j, " ".join(w[j : j + k])) for j in range(len(w) - k + 1)]
    return rows


def gram_hits(spark: SparkSession, words: DataFrame, grams: list[tuple]) -> DataFrame:
    """``words`` (doc_id, rid, w) joined to the template grams: a row for each gram of a text, at word i, and equal gram."""
    table = spark.createDataFrame(grams, "tid int, label string, exact boolean, n int, k int, j int, gram string")
    split = [F.split("gram", " ")[x] for x in range(4)]
    table = table.withColumn("h", F.when(F.col("k") == 2, F.xxhash64(*split[:2])).otherwise(F.xxhash64(*split)))
    from_word = [F.slice("w", x + 1, F.size("w")).alias(c) for x, c in enumerate("abcd")]  # shorter ones are filled up with nulls
    each = words.select("doc_id", "rid", F.posexplode(F.arrays_zip(*from_word)).alias("i", "g")).select("doc_id", "rid", "i", "g.*")
    each = each.withColumn("h", F.explode(F.array(F.xxhash64("a", "b"), F.xxhash64("a", "b", "c", "d"))))
    same = F.when(F.col("k") == 2, F.concat_ws(" ", "a", "b")).otherwise(F.concat_ws(" ", "a", "b", "c", "d")) == F.col("gram")
    return each.join(F.broadcast(table), "h").where(same)


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, cover: float = COVER, drift: int = DRIFT) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: (doc_id, rid, n_words) of each row; (doc_id, rid, tid, label, exact, first, last, score) of each span.

    ``rid`` is the hash of the text. The template table is a constant of this module or of the caller and goes
    to every task; the grams of the texts stay where they are, and only hits are shuffled. ``first`` and ``last`` are
    word positions; ``score`` the share of the template's words found in the span, which is ``drift`` words longer than
    the template at most.
    """
    words = F.filter(F.split(ascii_lower("text"), NON_WORD, -1), lambda w: w != "")
    rows = docs.select("doc_id", F.xxhash64("text").alias("rid"), words.alias("w"))
    size = rows.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"))
    hits = gram_hits(docs.sparkSession, rows, template_grams(phrases or PHRASES, templates or TEMPLATES))
    votes = hits.groupBy("doc_id", "rid", "tid", "label", "exact", "n", "k", (F.col("i") - F.col("j")).alias("diag"))
    votes = stored(votes.agg(F.collect_set("j").alias("js"), F.min("i").alias("lo"), F.max("i").alias("hi")), "votes")
    span = ["doc_id", "rid", "tid", "label", "exact", "first", "last", "score"]
    whole = votes.where("exact and size(js) = n - k + 1").withColumns({"first": F.col("diag"), "last": F.col("diag") + F.col("n") - 1, "score": F.lit(1.0)})

    by_diag = Window.partitionBy("doc_id", "rid", "tid").orderBy("diag")
    merge = by_diag.rangeBetween(0, drift)
    merged = votes.where("not exact").withColumns(
        {"js": F.flatten(F.collect_list("js").over(merge)), "first": F.min("lo").over(merge), "last": F.max("hi").over(merge) + F.col("k") - 1}
    )
    held = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + F.col("k") - 1)))))
    spans = merged.withColumn("score", held / F.col("n")).where(F.col("score") >= cover)
    rank = F.struct("score", F.col("first") - F.col("last"), -F.col("diag"))
    spans = spans.withColumn("top", F.max(rank).over(by_diag.rangeBetween(-drift, drift))).where(rank == F.col("top"))
    at_word = [F.max(F.struct("score", "n")).over(Window.partitionBy("doc_id", "rid", end)) for end in ("first", "last")]
    spans = spans.withColumn("best", F.greatest(*at_word)).where(F.struct("score", "n") == F.col("best"))
    return size, whole.select(span).unionByName(spans.select(span))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    size, spans = scan(docs)
    per = spans.groupBy("doc_id", "rid").agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.count(F.lit(1)).alias("n_spans"),
    )
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0, "n_spans": 0}
    per = per.withColumnsRenamed({"doc_id": "_cz_id", "rid": "_cz_rid"})
    out = size.join(per, size["doc_id"].eqNullSafe(per["_cz_id"]) & (size["rid"] == per["_cz_rid"]), "left")
    return out.drop("rid", "_cz_id", "_cz_rid").fillna(none)
