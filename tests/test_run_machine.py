"""Run states against a plain fold."""

import random

import pytest

from leadloom.operators import run_machine


def brute(events, table):
    state, out = {}, {}
    for run, ts, n, status in sorted(events, key=lambda e: (e[0] is not None, e[0], e[1], e[2])):
        at = state.get(run, "")
        ok = status in table[at]
        state[run] = status if ok else at
        out[n] = (ok, state[run])
    return out, state


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_fold_equals_a_loop(spark, block):
    rng = random.Random(block)
    names = [*run_machine.TRANSITIONS, "unknown", None]
    events = [(1 if rng.random() < 0.5 else rng.randrange(2, 30), rng.randrange(200), i, rng.choice(names[1:])) for i in range(1500)]
    df = spark.createDataFrame(events, "run_id long, ts long, id long, status string").repartition(5)
    folded = run_machine.fold(df, block=block)
    want, last = brute(events, run_machine.TRANSITIONS)
    assert {r.id: (r.accepted, r.state) for r in folded.collect()} == want
    got = {r.run_id: r for r in run_machine.last_states(folded).collect()}
    assert {k: r.state for k, r in got.items()} == last
    assert sum(r.accepted + r.refused for r in got.values()) == len(events)


def test_own_table_and_no_events(spark):
    df = spark.createDataFrame([(1, 1, 1, "b"), (1, 2, 2, "a"), (1, 3, 3, "b")], "run_id long, ts long, id long, status string")
    got = run_machine.fold(df, {"": ["a"], "a": ["b"], "b": []}).orderBy("id").collect()
    assert [(r.accepted, r.state) for r in got] == [(False, ""), (True, "a"), (True, "b")]
    assert run_machine.fold(df.limit(0)).count() == 0
