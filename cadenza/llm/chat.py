"""Chat formatting by minimum-cost role repair.

Legal conversations: an optional system turn, then user and assistant in turn, from the user on. Dynamic programming
over that automaton chooses for each turn: keep it, merge it into the turn before, relabel it, or insert empty turns
before it; the cheapest repair is rendered. Costs: merge 2, relabel 5, insertion 3 each; a turn with an unknown or null
role is always relabelled. Ties go to the earlier of keep, merge, insert, relabel.

A step of the automaton is a (min, +) matrix over its four states and such matrices multiply associatively, so a
conversation of any length is cut into ranges of a fixed number of turns: each range gets its matrix, the ranges' border
states follow from those few matrices, and each range is repaired on its own.

Edge cases: turns are ordered by turn, role, hash of the text and text, nulls first; repeated rows are turns of their own
and thus merged or relabelled. Null text counts as empty. Rows with a null conv_id form one conversation. Only the named
columns are read. Empty tables give empty results. Results do not depend on how rows lie in files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import small_batches, stored

# States (nothing yet, after system, after user, after assistant), roles, legal steps, costs.
STATES = 4
ROLES = ("system", "user", "assistant")
STEP = {0: {"system": 1, "user": 2}, 1: {"user": 2}, 2: {"assistant": 3}, 3: {"user": 2}}
LAST = {1: "system", 2: "user", 3: "assistant"}
MERGE, RELABEL, INSERT = 2, 5, 3
FAR = 1 << 40


@lru_cache(maxsize=64)
def options(state: int, role: str | None) -> tuple[tuple[int, int, str, int, str, tuple[str, ...]], ...]:
    """(cost, tie order, action, next state, output role, inserted roles) for a turn of ``role`` in ``state``."""
    out = []

    def walk(s: int, inserted: tuple[str, ...]) -> None:
        extra = INSERT * len(inserted)
        for r, to in STEP[s].items():
            same = r == role
            action = ("insert" if inserted else "keep") if same else "relabel"
            out.append((extra + (0 if same else RELABEL), ("keep", "merge", "insert", "relabel").index(action), action, to, r, inserted))
            if len(inserted) < 2:
                walk(to, (*inserted, r))

    walk(state, ())
    if state:
        same = LAST[state] == role
        out.append((MERGE + (0 if same else RELABEL), 1 if same else 3, "merge", state, LAST[state], ()))
    best: dict[int, tuple] = {}
    for o in sorted(out, key=lambda o: (o[0], o[1], o[5])):
        best.setdefault(o[3], o)
    return tuple(best.values())


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least cost from each state to each state over a range of turns."""
    steps = {r: np.full((STATES, STATES), FAR, np.int64) for r in set(roles)}
    for r, m in steps.items():
        for s in range(STATES):
            for o in options(s, r):
                m[s, o[3]] = o[0]
    total = np.where(np.eye(STATES, dtype=bool), 0, FAR).astype(np.int64)
    for r in roles:
        total = np.minimum(FAR, (total[:, :, None] + steps[r][None]).min(axis=1))
    return total


def path(roles: list[str | None], entry: int, leave: int | None) -> list[tuple]:
    """The chosen option of each turn, from ``entry`` to ``leave`` (any state: the cheapest, first on ties)."""
    cost, back = [0 if s == entry else FAR for s in range(STATES)], []
    for r in roles:
        nxt, choice = [FAR] * STATES, [None] * STATES
        for s in range(STATES):
            if cost[s] < FAR:
                for o in options(s, r):
                    if cost[s] + o[0] < nxt[o[3]]:
                        nxt[o[3]], choice[o[3]] = cost[s] + o[0], (s, o)
        cost = nxt
        back.append(choice)
    at = leave if leave is not None else min(range(STATES), key=lambda s: (cost[s], s))
    chosen = []
    for choice in reversed(back):
        at, o = choice[at]
        chosen.append(o)
    return chosen[::-1]


def render(role: str, text: str, merged: bool, inserted: tuple[str, ...], first: bool = False, last: bool = False) -> str:
    """A turn's part of the chat: closed turns of ChatML form; a merged turn continues the open one."""
    empties = "".join(f"<|im_end|>\n<|im_start|>{r}\n" for r in inserted)
    piece = f"\n{text}" if merged else f"{empties}<|im_end|>\n<|im_start|>{role}\n{text}"
    return (piece.removeprefix("<|im_end|>\n") if first else piece) + ("<|im_end|>\n" if last else "")


def in_ranges(turns: DataFrame, per_range: int) -> DataFrame:
    """(conv_id, turn, role, text, th, seq, last, rng), stored: turns numbered from 0 in their order; ranges have ``per_range`` turns.

    Spark cuts the order into parts; turns are numbered inside their part and conversation and shifted by the parts
    before, so no task sorts a whole conversation unless it is short.
    """
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    parts = max(1, -(-rows.count() // 20_000))
    cut = stored(rows.repartitionByRange(parts, "conv_id", "turn", "role", "th").withColumn("part", F.spark_partition_id()), "turns")
    sizes = cut.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy("conv_id")
    sizes = sizes.withColumns({"off": F.coalesce(F.sum("k").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("k").over(whole)})
    sizes = stored(sizes.select(F.col("conv_id").alias("id_"), F.col("part").alias("part_"), "off", "all"), "sizes")
    ranked = cut.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "th", "text")))
    out = ranked.join(sizes, ranked["conv_id"].eqNullSafe(sizes["id_"]) & (ranked["part"] == sizes["part_"])).withColumn("seq", F.col("off") + F.col("rn") - 1)
    return stored(out.select("conv_id", "turn", "role", "text", "seq", (F.col("seq") == F.col("all") - 1).alias("last"), F.floor(F.col("seq") / per_range).cast("int").alias("rng")), "turns")


def repair(turns: DataFrame, per_range: int = 20_000) -> DataFrame:
    """(conv_id, seq, turn, role, role_out, action, inserted, cost, piece), one row per input turn.

    The pieces of a conversation by ``seq``, joined, are its rendered text; ``render_chats`` does that.
    """
    small_batches(turns.sparkSession)
    kinds = dict(turns.dtypes)
    cut = in_ranges(turns, per_range)
    cut = cut.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})  # exact in pandas, also beside nulls

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        m = matrix([None if pd.isna(r) else r for r in pdf["role"]])
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "rng": pdf["rng"].iloc[:1], "m": [m.ravel()]})

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rng")
        ms = [np.asarray(m).reshape(STATES, STATES) for m in pdf["m"]]
        cost, back = np.array([0] + [FAR] * (STATES - 1)), []
        for m in ms:
            sums = cost[:, None] + m
            back.append(sums.argmin(axis=0))
            cost = np.minimum(FAR, sums.min(axis=0))
        at, out = int(cost.argmin()), []
        for b in reversed(back):
            out.append((int(b[at]), at))
            at = int(b[at])
        entry, leave = zip(*out[::-1], strict=True)
        return pd.DataFrame({"conv_id": pdf["conv_id"], "rng": pdf["rng"], "entry": entry, "leave": leave})

    spans = cut.select("conv_id", "rng").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("conv_id").alias("long_id"))
    long = cut.join(spans, cut["conv_id"].eqNullSafe(spans["long_id"]), "left_semi")
    sums = long.select("conv_id", "rng", "seq", "role").groupBy("conv_id", "rng").applyInPandas(measure, "conv_id string, rng int, m array<long>")
    ends = stored(sums.groupBy("conv_id").applyInPandas(borders, "conv_id string, rng int, entry int, leave int"), "ends")
    ends = ends.withColumnsRenamed({"conv_id": "end_id", "rng": "end_rng"})
    known = cut.join(ends, cut["conv_id"].eqNullSafe(ends["end_id"]) & (cut["rng"] == ends["end_rng"]), "left").select("conv_id", "turn", "role", "text", "seq", "last", "rng", "entry", "leave")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            pdf = pd.concat(held) if len(held) > 1 else held[0]
            out = []
            for _, g in pdf.groupby(["conv_id", "rng"], dropna=False, sort=False):
                roles = [None if pd.isna(r) else r for r in g["role"]]
                entry, leave = g["entry"].iloc[0], g["leave"].iloc[0]
                chosen = path(roles, 0 if pd.isna(entry) else int(entry), None if pd.isna(leave) else int(leave))
                for o, turn, role, text, conv, seq, last in zip(chosen, g["turn"], roles, g["text"], g["conv_id"], g["seq"], g["last"], strict=True):
                    cost, _, action, _, role_out, inserted = o
                    out.append((conv, seq, turn, role, role_out, action, ",".join(inserted), cost, render(role_out, text, action == "merge", inserted, seq == 0, last)))
            return pd.DataFrame(out, columns=["conv_id", "seq", "turn", "role", "role_out", "action", "inserted", "cost", "piece"])

        for b in batches:  # rows come sorted; the last conversation of a batch may go on in the next
            if held and len(b):
                last, first = held[-1].iloc[-1], b.iloc[0]
                same = (last["conv_id"] == first["conv_id"] or (pd.isna(last["conv_id"]) and pd.isna(first["conv_id"]))) and last["rng"] == first["rng"]
                if not same:
                    yield flush()
                    held = []
            if len(b):
                ids = b["conv_id"].fillna("\0").to_numpy()
                change = np.flatnonzero((ids[1:] != ids[:-1]) | (b["rng"].to_numpy()[1:] != b["rng"].to_numpy()[:-1]))
                if len(change):
                    held.append(b.iloc[: change[-1] + 1])
                    yield flush()
                    held = [b.iloc[change[-1] + 1 :]]
                else:
                    held.append(b)
        if held:
            yield flush()

    dealt = known.repartition(F.col("conv_id"), F.col("rng")).sortWithinPartitions("conv_id", "rng", "seq")
    out = dealt.mapInPandas(choose, "conv_id string, seq long, turn string, role string, role_out string, action string, inserted string, cost int, piece string")
    return out.withColumns({c: F.col(c).cast(kinds[c]) for c in ("conv_id", "turn")})


def render_chats(repaired: DataFrame) -> DataFrame:
    """(conv_id, chat, cost): the rendered text of each conversation, one training sample and so one row each."""
    pieces = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("chat"), F.sum("cost").alias("cost"))
