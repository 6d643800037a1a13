"""Fixtures that the corpus tests share."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; documents may bring them along.
CLASH = {"fp": 1, "key": "k", "digest": "d", "shard": 3, "kept": False, "rid": 9, "node": 5, "start": 0, "lang_pred": "zz", "score": 0.5, "w": 1, "unit": 2, "n": 7, "k": 1, "tok": 4}


def docs(spark, texts, lang="en", source="s"):
    """One document per text, ids from 0; a text may be an (id, text) pair."""
    rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in rows], SCHEMA)


def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, and columns with clashing names."""
    from pyspark.sql import functions as F

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(words[(i * i) % 10] + str(i % 977) for i in range(40_000))
    rows = [(0, None, None, None), (1, "", "en", "a"), (None, "some words here", "en", None), (3, "Same text as another one", "en", "a"), (4, "same TEXT as another one", None, "a"),
            (5, long, "fr", "b"), (5, "an id twice", "fr", "b"), (6, "repeated row", "en", "b"), (6, "repeated row", "en", "b"), (7, "... 123 !!", "en", "c"), (8, "\u00c9t\u00e9 \U0001F600 na\u00efve", "fr", "c")]
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], SCHEMA)
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items()}), len(rows)


#: Ids that differ as longs and not as doubles.
WIDE = (2**53, 2**53 + 1, 2**53 + 2)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
