import itertools
import random

import pytest
from corpus import CLASH, WIDE, rows
from pyspark.sql import functions as F

from cadenza.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(roles):
    """Least cost over all output sequences: every turn merges or becomes a turn of some role after up to two empty ones."""
    best = {(0,): None}
    costs = {0: 0}
    for r in roles:
        nxt = {}
        for s, c in costs.items():
            if s:
                m = c + chat.MERGE + (0 if chat.LAST[s] == r else chat.RELABEL)
                nxt[s] = min(nxt.get(s, 10**9), m)
            for n in range(3):
                for ins in itertools.product(chat.ROLES, repeat=n):
                    for out in chat.ROLES:
                        at, ok = s, True
                        for x in (*ins, out):
                            ok = ok and x in chat.STEP[at]
                            at = chat.STEP[at].get(x, at)
                        if ok:
                            k = c + chat.INSERT * n + (0 if out == r else chat.RELABEL)
                            nxt[at] = min(nxt.get(at, 10**9), k)
        costs = nxt
    return min(costs.values()), best


def frame(spark, convs):
    return spark.createDataFrame([(c, i, r, f"t{i}") for c, roles in convs.items() for i, r in enumerate(roles)], SCHEMA)


@pytest.fixture(scope="module")
def convs():
    rnd = random.Random(1)
    return {c: [rnd.choice([*chat.ROLES, "tool", None]) for _ in range(rnd.randint(1, 9))] for c in range(60)}


def test_cost_is_least_and_result_legal(spark, convs):
    out = chat.repair(frame(spark, convs)).collect()
    for c, roles in convs.items():
        got = sorted((r for r in out if r.conv_id == c), key=lambda r: r.seq)
        assert [r.role for r in got] == roles and sum(r.cost for r in got) == brute(roles)[0]
        state = 0
        for r in got:
            for x in filter(None, r.inserted.split(",")):
                state = chat.STEP[state][x]
            if r.action == "merge":
                assert chat.LAST[state] == r.role_out
            else:
                state = chat.STEP[state][r.role_out]


def test_ranges_change_no_cost(spark, convs):
    whole, cut = chat.repair(frame(spark, convs)), chat.repair(frame(spark, convs), per_range=7)
    total = lambda df: {r[0]: r[1] for r in df.groupBy("conv_id").agg(F.sum("cost")).collect()}
    assert total(whole) == total(cut)


def test_legal_conversation_is_left_alone(spark):
    df = frame(spark, {1: ["system", "user", "assistant", "user", "assistant"], 2: ["user"]})
    assert {(r.action, r.cost) for r in chat.repair(df).collect()} == {("keep", 0)}
    text = {r.conv_id: r.chat for r in chat.render_chats(chat.repair(df)).collect()}
    assert text[2] == "<|im_start|>user\nt0<|im_end|>\n"
    assert text[1].count("<|im_start|>") == text[1].count("<|im_end|>") == 5


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 1, "?", "x" * 200_000)], SCHEMA).withColumns({c: F.lit(v) for c, v in CLASH.items()})
    got = sorted(((r.conv_id is None, r.conv_id, r.seq, r.role, r.role_out, r.action, len(r.piece)) for r in chat.repair(df).collect()), key=str)
    end, user, assistant = len("<|im_end|>\n"), len("<|im_start|>user\n"), len("<|im_start|>assistant\n")
    assert [x[1:6] for x in got] == [(1, 0, "user", "user", "keep"), (1, 1, "user", "user", "merge"), (2, 0, "?", "system", "relabel"), (None, 0, None, "system", "relabel"), (None, 1, "user", "user", "keep")]
    assert [x[6] for x in got][:2] == [user, 1 + end] and chat.repair(df.limit(0)).count() == 0 and assistant
    texts = {r.conv_id: r.chat for r in chat.render_chats(chat.repair(df)).collect()}
    assert texts[1] == "<|im_start|>user\n\n<|im_end|>\n" and texts[None] == "<|im_start|>system\n<|im_end|>\n<|im_start|>user\na<|im_end|>\n"


def test_ties_do_not_depend_on_the_layout(spark):
    df = spark.createDataFrame([(1, 0, "user", f"text {i}") for i in range(200)], SCHEMA)
    one, other = (chat.repair(x, per_range=9) for x in (df.repartition(1), df.repartition(7)))
    assert rows(one, *one.columns) == rows(other, *one.columns)


def test_wide_ids_beside_nulls_stay_apart(spark):
    turns = [(WIDE[0], 0, "user", "a"), (WIDE[1], 0, "user", "b"), (WIDE[0], 1, "assistant", "c"), (WIDE[1], WIDE[1], "assistant", "d"), (None, 0, "user", "e"), (None, None, "system", "f")]
    df = spark.createDataFrame(turns, SCHEMA).coalesce(1)
    for per_range in (1, 20_000):
        got = chat.repair(df, per_range)
        assert dict(got.dtypes)["conv_id"] == dict(got.dtypes)["turn"] == "bigint"
        assert rows(got.where("conv_id is not null"), "conv_id", "seq", "turn", "action") == sorted([(WIDE[0], 0, 0, "keep"), (WIDE[0], 1, 1, "keep"), (WIDE[1], 0, 0, "keep"), (WIDE[1], 1, WIDE[1], "keep")], key=str)
        assert got.where("conv_id is null").count() == 2
