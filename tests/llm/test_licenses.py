import re

from corpus import docs, odd, rows

from cadenza.llm import licenses
from cadenza.llm.queries import op4_license_scan

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_base_equals_brute_force(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert rows(op4_license_scan(spark, small), *BASE) == sorted([(r.doc_id, *brute(r.text)) for r in d], key=str)


MIT = next(t for t, x in licenses.TEMPLATES.items() if x == "mit" and len(t.split()) > 10)
TEXTS = ["CC BY cc by,cc-by", "all rights reserved. All Rights\nReserved", "the GNU General Public License", "cc", "", None, "x" * 50, MIT, " ".join(["a", "b", *MIT.split()[:9], "really", *MIT.split()[9:]]),
         " ".join(MIT.split()[:8]), "\u00c9cc by cc by\u00e9", "licensed under cc by 4.0", "all rights all rights reserved reserved"]


def test_crafted(spark):
    out = {r.doc_id: r for r in licenses.report(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        assert (out[i].n_words, out[i].n_base, out[i].first_word, out[i].last_word, out[i].base_labels) == brute(t)
    assert out[7].labels == "mit" and out[7].score == 1.0
    assert out[8].labels == "mit" and 0.8 <= out[8].score <= 1.0  # one more word: two neighbouring diagonals, one span
    assert out[9].labels == "" and out[11].labels == "cc-by,cc-by-4.0"


def test_inserted_and_missing_words(spark):
    body = next(t for t, x in licenses.TEMPLATES.items() if x == "mit" and t.startswith("the software is provided")).split()
    texts = ["released under the terms of the MIT license", "Released under the very nice MIT license", "x released y y y y the MIT license", " ".join(body), " ".join(body[:20] + body[23:]),
             " ".join(body[:15] + ["a", "b", "c"] + body[15:]), " ".join(body[:15] + ["z"] * 4 + body[15:]), "licensed under cc by nc 4.0", "licensed under cc by 4.0 licensed under cc by sa 4.0 licensed under cc by 4.0",
             "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"]
    labels = ["mit", "mit", "", "mit", "mit", "mit", "", "cc-by,cc-by-nc-4.0", "cc-by,cc-by-4.0,cc-by-sa-4.0", "agpl,gpl"]
    out = {r.doc_id: r for r in licenses.report(docs(spark, texts)).collect()}
    assert [out[i].labels for i in range(len(texts))] == labels
    assert out[8].n_spans == 6 and out[3].score == out[5].score == 1.0


def test_odd_rows(spark):
    df, n = odd(spark)
    assert licenses.report(df).count() == n and licenses.report(df.limit(0)).count() == 0
