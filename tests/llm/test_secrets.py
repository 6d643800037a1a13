import hashlib
import re

import pytest
from corpus import docs, odd, rows

from cadenza.llm import secrets
from cadenza.llm.queries import op5_secret_scan

# As the contract words them.
KINDS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 16, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 32, 0),
)


def brute(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p, least, g) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= least]
    shown = ",".join(f"{k}:{a}:{b}" for a, i, b, k in sorted(spans))
    return *(sum(s[3] == k for s in spans) for k, *_ in KINDS), hashlib.sha256(shown.encode()).hexdigest()


def test_base_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = sorted([(r.doc_id, *brute(r.text)) for r in d], key=str)
    assert any(w[1] for w in want) and rows(op5_secret_scan(spark, folder), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want


TEXTS = ["password: hunter2hunter2", "PassWord=short token = 'abcdefgh12'", "token token=abcdefgh", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "xAKIAAKIA" + "B" * 14, "f" * 31, "f" * 32 + "g" + "0" * 33,
         "\U0001F600 secret : \"zzzzzzzz", "apikey=12345678 api_key:abcdefghi", "password\t=\tabcdefgh", None, "", "secret=" + "a" * 40, "passwordpassword=abcdefgh", "passwd=aaaaaaa,secret=bbbbbbbb"]


def test_crafted(spark):
    out = secrets.scan(docs(spark, TEXTS))
    got = {r.doc_id: ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.base) for r in out.collect()}
    for i, t in enumerate(TEXTS):
        assert hashlib.sha256(got[i].encode()).hexdigest() == brute(t)[3], t


def spans_of(spark, text, scope=400):
    return [x.kind for x in secrets.scan(docs(spark, [text]), scope).first().found]


def test_weak_parts_need_complements(spark):
    user, key, host = "user=alice1 ", "Abcdefgh1234567890xyzT ", "10.1.2.3:5432 "
    assert spans_of(spark, user) == spans_of(spark, key) == spans_of(spark, host) == spans_of(spark, user + host) == []
    assert sorted(spans_of(spark, user + key + host)) == ["host", "key", "user"]
    assert spans_of(spark, user + "." * 500 + " " + key + host) == []
    assert sorted(spans_of(spark, user + "password=abcdefgh1 " + host)) == ["assign", "host", "user"]


@pytest.mark.parametrize("scope", [30, 100])
def test_linking_equals_brute_force(spark, scope):
    import random

    rnd = random.Random(4)
    parts = ["user=alice1", "Abcdefgh1234567890xyzT", "10.1.2.3", "password=abcdefgh1", "AKIA" + "Z" * 14, "filler", "more filler"]
    text = " ".join(rnd.choice(parts) for _ in range(120))
    row = secrets.scan(docs(spark, [text]), 10**6).first()
    every = {(x.start, x.kind) for x in row.found}
    want = set()
    for start, kind in every:
        role = secrets.ROLE[kind]
        near = {secrets.ROLE[k] for s, k in every if abs(s - start) <= scope}
        if kind in ("assign", "access", "hex") or {"id", "secret", "end"} - {role} <= near:
            want.add((start, kind))
    assert {(x.start, x.kind) for x in secrets.scan(docs(spark, [text]), scope).first().found} == want


def test_long_parts_are_whole(spark):
    key, url = "Ab1" * 31 + "x", "https://" + "a/" * 150
    got = {x.kind: (x.start, x.end) for x in secrets.scan(docs(spark, [f"user=alice1 {key} {url}"])).first().found}
    assert got == {"user": (0, 11), "key": (12, 106), "host": (107, 107 + len(url))}


def test_many_matches_in_one_text(spark):
    import time

    text = " ".join(f"{i:032x}" for i in range(32_000))
    began = time.perf_counter()
    found = secrets.scan(docs(spark, [text])).first().base
    assert [(x.start, x.end) for x in found] == [(33 * i, 33 * i + 32) for i in range(32_000)] and time.perf_counter() - began < 20


def test_odd_rows(spark):
    df, n = odd(spark)
    out = secrets.scan(df)
    assert out.count() == n and {(tuple(r.base), tuple(r.found)) for r in out.collect()} == {((), ())} and secrets.scan(df.limit(0)).count() == 0
    twice = secrets.scan(docs(spark, [(1, "token=abcdefgh1"), (1, "token=abcdefgh1"), (None, "x token=abcdefgh1"), (1, None)]))
    assert rows(twice.selectExpr("doc_id", "base.start as s"), "doc_id", "s") == sorted([(1, [0]), (1, [0]), (None, [2]), (1, [])], key=str)


def test_no_python_in_the_plan(spark, small):
    plan = op5_secret_scan(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
