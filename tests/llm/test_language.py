import math
from collections import Counter

import pytest
from corpus import docs, odd, rows
from pyspark.sql import functions as F

from cadenza.llm import langid
from cadenza.llm.queries import op1_language_id


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = op1_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").where("held_out and lang is not null")
    share = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert share[0] > 0.97 and 0 <= share[1] <= share[2] <= 1
    assert got.where("(crc32(cast(doc_id as string)) % 4 = 2) <> held_out").count() == 0


def test_known_words_first_then_shorter_grams(spark):
    train = docs(spark, ["sun moon star"] * 3, "en").unionByName(docs(spark, ["sol luna astro"] * 3, "es"))
    m = langid.fit(train.withColumn("doc_id", F.monotonically_increasing_id()))
    assert m.langs == ["en", "es"] and m.predict("sun")[0] == "en" and m.predict("luna")[0] == "es"
    assert m.predict("moonless")[0] == "en" and m.predict("lunas")[0] == "es"  # unseen: grams decide
    assert m.back_off("\u4e2d") is None and m.predict("\u4e2d") == ("en", 0.5)
    assert m.predict(None) == m.predict("") == m.predict("12 .") == ("und", 0.0)


def test_odd_rows(spark):
    df, n = odd(spark)
    out = langid.identify(df, langid.fit(df))
    assert out.count() == n and out.columns == [*df.columns, "lang_pred", "score"]
    assert rows(langid.identify(df.select("doc_id", "text"), langid.fit(df)).where("lang_pred = 'und'"), "doc_id") == [(0,), (1,), (7,)]


def test_without_training_rows(spark):
    df = docs(spark, ["some text"])
    assert rows(langid.identify(df, langid.fit(df.limit(0))), "lang_pred", "score") == [("und", 0.0)]
    assert langid.identify(df.limit(0), langid.fit(df)).count() == 0


def test_a_label_with_one_short_document_takes_no_others(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'")
    odd_one = docs(spark, [(-1, " ".join(f"zq{chr(97 + i)}" for i in range(26)))], "xx")
    got = langid.identify(d, langid.fit(d.unionByName(odd_one))).where("lang_pred <> 'und'")
    assert got.count() > 100 and got.where("lang_pred = 'xx'").count() == 0


def brute_fit(rows):
    """Log frequencies as dictionaries: {size: {term: {lang: count}}} and totals."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        for w in langid.words(text):
            for size, term in [(0, w), *[(n, g) for n in range(1, 6) for g in langid.grams(w, n)]]:
                own = counts.setdefault((size, term), Counter())
                own[lang] += 1
                totals[lang, size] += 1
    return counts, totals


def brute_predict(text, counts, totals, langs):
    most = [max(totals[x, n] + 1 for x in langs) for n in range(6)]
    log = lambda size, term, x: math.log(counts[size, term][x] / (totals[x, size] + 1) + 0.1 / most[size])
    sums, n = dict.fromkeys(langs, 0.0), 0
    for w in langid.words(text):
        for size in (0, 5, 4, 3, 2, 1):
            hits = [g for g in ([w] if size == 0 else langid.grams(w, size)) if (size, g) in counts]
            if hits:
                for x in langs:
                    sums[x] += sum(log(size, g, x) for g in hits) / len(hits)
                n += 1
                break
    if not langid.words(text):
        return "und", 0.0
    top = max(sums.values())
    return min(x for x in langs if sums[x] > top - 1e-3), 1 / sum(math.exp((v - top) / max(n, 1)) for v in sums.values())


def test_query_equals_brute_force(spark, small):
    """The query over its whole table against dictionaries over all training texts."""
    d = spark.read.parquet(f"{small}/documents.parquet").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    train = [(r.text, r.lang) for r in d if not r.held_out and r.text is not None and r.lang is not None]
    counts, totals = brute_fit(train)
    langs = sorted({x for _, x in train})
    got = {r.doc_id: r for r in op1_language_id(spark, small).collect()}
    assert len(got) == len(d)
    for r in d:
        lang, score = brute_predict(r.text, counts, totals, langs)
        assert got[r.doc_id].held_out == r.held_out and got[r.doc_id].lang_pred == lang
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-4)


def test_many_labels_cost_what_their_counts_cost(spark):
    """1,000 documents under 4 or under 200 labels: the model's size follows the counts, not terms times labels."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null")
    few = langid.fit(d.withColumn("lang", (F.col("doc_id") % 4).cast("string")))
    many = langid.fit(d.withColumn("lang", (F.col("doc_id") % 200).cast("string")))
    assert len(many.langs) == 200 and len(few.terms) == len(many.terms)
    assert many.nbytes < 10 * few.nbytes and many.nbytes < len(many.terms) * 200  # a dense table has four bytes for each of these
    one = langid.fit(d, docs=8)
    assert 0 < len(one.terms) < len(few.terms) / 2
