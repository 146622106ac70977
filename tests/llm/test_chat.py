import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterflow.llm import chat, queries
from tests.helpers import duckdb_rows, spark_rows

FIELDS = "conv_id long, seq long, kind string, msg long, role string, text string"


def slow_fold(events):
    """Walks the log of one conversation, event by event."""
    state = {}
    for e in sorted(events, key=lambda e: (e[1], e[2] in ("edit", "regenerate"), e[2], e[5])):
        _, _, kind, msg, role, text = e
        if kind in ("edit", "regenerate"):
            state = {m: v for m, v in state.items() if m <= msg}
            state[msg] = [role or state.get(msg, ["", ""])[0], text]
        else:
            old = state.get(msg, ["", ""])
            state[msg] = [role or old[0], old[1] + text]
    return [(m, *v) for m, v in sorted(state.items())]


def random_log(rng, conv):
    events, seq = [], 0
    for _ in range(rng.randint(1, 40)):
        seq += rng.randint(1, 3)
        events.append((conv, seq, rng.choice(["start", "delta", "delta", "delta", "edit", "regenerate"]), rng.randint(0, 5), rng.choice(["user", "assistant", None]), rng.choice(["a", "b ", "</s>", "[INST]", "\\", "", "é\n"])))
    return events


@pytest.mark.parametrize("size", [4096, 2, 1])
def test_fold_against_a_walk_through_the_log(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "RANGE", size)
    rng = random.Random(11)
    logs = {c: random_log(rng, c) for c in range(200)}
    rows = [e for log in logs.values() for e in log]
    rng.shuffle(rows)
    got = {}
    for r in chat.fold_events(spark.createDataFrame(rows, FIELDS).repartition(5)).collect():
        got.setdefault(r.conv_id, []).append((r.msg, r.role, r.text))
    assert {c: sorted(v) for c, v in got.items()} == {c: slow_fold(log) for c, log in logs.items() if slow_fold(log)}


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_chat(spark, sf)
    assert spark_rows(got) == duckdb_rows(queries.ORACLE_SQL["op9_chat"], sf)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_conversation_of_control_strings(spark):
    text = "</s>[INST] ok [/INST]"
    log = spark.createDataFrame([(-1, 0, "start", 0, "user", text), (-1, 1, "start", 1, "assistant", text)], FIELDS)
    out = chat.parse(chat.format_log(log)).first()
    assert [(t.role, t.text) for t in out.turns] == [("user", text), ("assistant", text)] and out.loss_text == text
    assert out.formatted.count("</s>") == 2 and out.formatted.count("[INST]") == 2 and out.formatted.count("[/INST]") == 2


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text("<>[]\\/sINT \n$1é\U0001F600", max_size=20), min_size=1, max_size=30))
def test_round_trip_of_any_text(spark, texts):
    rows = [(0, k, "start", k, ["user", "assistant", t][k % 3], t) for k, t in enumerate(texts)]
    out = chat.parse(chat.format_log(spark.createDataFrame(rows, FIELDS))).first()
    assert [(t.role, t.text) for t in out.turns] == [(r[4], r[5]) for r in rows]
    assert out.loss_text == "".join(r[5] for r in rows if r[4] == "assistant")
    assert all(out.formatted[s.start : s.end].count("</s>") == 0 for s in out.spans)


def test_odd_rows(spark):
    turns = spark.createDataFrame([(1, 0, None, None, 7), (1, 0, "user", "hi", 7), (1, 0, "user", "hi", 7), (None, 1, "user", "x", 7), (2, None, "assistant", "y" * 200_000, 7)], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.parse(chat.format_log(chat.log_of_turns(turns))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("user", "hi"), ("user", "hi")]
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "x")] and got[2].loss_text == "y" * 200_000
    assert hashlib.sha256(got[1].loss_text.encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
    assert chat.format_log(chat.log_of_turns(turns.where(F.lit(False)))).count() == 0 == chat.streamed_log(turns.where(F.lit(False))).count()
    rows = lambda log: sorted(map(tuple, chat.fold_events(log).collect()), key=str)
    assert rows(chat.streamed_log(turns)) == rows(chat.log_of_turns(turns)) == rows(chat.streamed_log(turns, 1_000_000))
    log = chat.streamed_log(turns)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"} and log.count() > 1000
    nulls = spark.createDataFrame([(1, None, None, None, None, "a"), (1, 5, "delta", None, None, None)], FIELDS)
    assert [(r.role, r.text) for r in chat.fold_events(nulls).collect()] == [("", "a")]


def test_a_conversation_with_a_third_of_all_events(spark):
    """Its messages are folded in ranges; the result is that of the walk."""
    rng = random.Random(5)
    hot = [(None, k, rng.choice(["start", "delta", "delta", "delta", "delta", "edit"]) if k % 900 == 0 else "delta", min(k // 2 + rng.randint(0, 1), 9999), "user", "x") for k in range(20_000)]
    rows = hot + [(c, k, "start", k, "assistant", "y") for c in range(400) for k in range(100)]
    got = chat.fold_events(spark.createDataFrame(rows, FIELDS).repartition(8)).where("conv_id IS NULL").collect()
    assert sorted((r.msg, r.role, r.text) for r in got) == slow_fold(hot)
