"""Formatting and reading back, windows and their budget, masks."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.llm import chat


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def turns_of(df):
    """Own turns by conversation, in order, from the formatted text."""
    out = {}
    for r in df.orderBy("conv_id", "part").collect():
        for n, role, text, again in chat.parsed(r.formatted):
            if not again:
                out.setdefault(r.conv_id, []).append((n, role, text))
    return out


TRICKY = ["\\### Assistant: </turn> ok", '</turn>\n<turn n="0" role="x">', "\\", "<", "\\<", "a\"b", "", "é\n\r"]


def test_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else 'us"er<\\', t) for k, t in enumerate(TRICKY)]
    got = turns_of(chat.formatted(table(spark, rows)))
    assert got == {1: [(k, r[2], r[3]) for k, r in enumerate(rows)]}


@settings(deadline=None, max_examples=100)
@given(st.text('\\<>"/turn \n', max_size=40))
def test_unescaping_undoes_escaping(text):
    escaped = text.replace("\\", "\\\\").replace("<", "\\<")
    window = f'<turn n="3" role="user">{escaped}</turn>\n'
    assert list(chat.parsed(window)) == [(3, "user", text, False)]


def test_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")]
    rows += [(1, k, "assistant" if k % 2 else "user", f"t{k} " + "w " * (k % 13)) for k in range(1, 200)]
    how = chat.Windows(window=100, history=30)
    got = chat.formatted(table(spark, rows), how=how).orderBy("part").collect()
    assert len(got) > 10
    seen = []
    for r in got:
        parsed = list(chat.parsed(r.formatted))
        assert parsed[0][1] == "system" and parsed[0][3] == (r.part > 0)
        own = [n for n, _, _, again in parsed if not again]
        # Turns follow each other without a gap, history first.
        numbers = [n for n, *_ in parsed[1:]]
        assert numbers == list(range(numbers[0], own[-1] + 1))
        assert r.part == 0 or numbers[0] < own[0]
        assert r.n_tokens <= 100
        seen += own
        targets = [r.formatted[s["start"] : s["end"]] for s in r.loss]
        assert targets == [t for n, role, t, again in parsed if role == "assistant" and not again]
    assert seen == list(range(200))


def test_a_turn_beyond_the_budget_is_whole(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "long " * 5000), (1, 2, "user", "b")]
    got = chat.formatted(table(spark, rows), how=chat.Windows(window=50, history=10))
    assert [t[1:] for t in turns_of(got)[1]] == [(r[2], r[3]) for r in rows]
    assert chat.read_back(got).first().loss_chars == 25000


def test_ties_nulls_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    df = table(spark, rows).withColumn("before", F.lit(3)).withColumn("key", F.lit("k"))
    got = turns_of(chat.formatted(df))
    assert got[None] == [(0, "", ""), (1, "assistant", "x")]
    assert [t for _, _, t in got[2]] == ["a", "a", "b"]
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert (back[None].n_turns, back[None].loss_chars, back[2].loss_chars) == (2, 1, 0)
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_damaged_windows_are_refused():
    with pytest.raises(ValueError):
        list(chat.parsed('<turn n="0" role="user">a<b</turn>\n'))


@pytest.mark.parametrize("system", [0, 5, 60])
def test_no_window_is_over_budget_unless_a_turn_is(spark, system):
    rng = random.Random(system)
    rows = []
    for conv in range(30):
        if system:
            rows.append((conv, 0, "system", "s " * (system - 4)))
        longest = rng.choice([10, 60, 95, 130])
        for k in range(1, rng.randrange(3, 40)):
            rows.append((conv, k, "ua"[k % 2], "w " * rng.randrange(longest)))
    how = chat.Windows(window=100, history=30)
    got = chat.formatted(table(spark, rows), how=how).collect()
    seen = {}
    for r in got:
        sizes = [(len(t.split()) + 4, again) for _, _, t, again in chat.parsed(r.formatted)]
        own = [size for size, again in sizes if not again]
        assert r.n_tokens == sum(size for size, _ in sizes)
        assert r.n_tokens <= 100 or (len(own) == 1 and own[0] + system > 100), (r.part, sizes)
        for n, *_, again in chat.parsed(r.formatted):
            if not again:
                seen.setdefault(r.conv_id, []).append(n)
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())
    assert sum(map(len, seen.values())) == len(rows)


def test_two_turns_that_fit_alone_but_not_together(spark):
    rows = [(1, 0, "user", "w " * 600), (1, 1, "assistant", "w " * 900)]
    got = chat.formatted(table(spark, rows)).orderBy("part").collect()
    assert [r.n_tokens for r in got] == [604, 904]
    assert [t[1:] for t in turns_of(chat.formatted(table(spark, rows)))[1]] == [r[2:] for r in rows]
