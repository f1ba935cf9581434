"""Benchmark items in documents: as they are, with other slots, cut, and mixed up."""

import pytest

from holdfast.llm.decontaminate import Decontaminate, contaminated

ITEM = (
    "A train leaves the old station with 12 boxes of apples and Tom adds 30 more boxes"
    " before the train reaches the market where Tom sells 5 boxes per hour"
)
OTHER = "the quick brown fox jumps over the lazy dog while nobody in the quiet village looks"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, ITEM), (2, OTHER), (3, ""), (4, None), (5, "too short item"), (6, "five plain words right here")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def found(spark, items, texts, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = contaminated(df, items, how=Decontaminate(**how)).collect()
    return sorted((r.doc_id, r.item_id, r.exact) for r in got)


FILL = "some words come first in this text and "


@pytest.mark.parametrize("sent, filter_bytes", [(1_000_000, 1), (0, 1 << 26), (0, 1)])
def test_passages(spark, items, sent, filter_bytes):
    texts = [
        FILL + ITEM + " more follows",
        FILL + ITEM.replace("12", "77").replace("Tom", "Ann").replace("30", "8"),
        FILL + ITEM.replace("with 12", "with 77").replace("and Tom", "and Ann"),
        FILL.replace(" ", "\n") + OTHER.upper() + ".",
        " ".join(ITEM.split()[3:20]),
        " ".join(ITEM.split()[3:12]),
        FILL * 40,
        "say: five plain words right here!",
        None,
        "",
    ]
    got = found(spark, items, texts, sent=sent, filter_bytes=filter_bytes)
    assert (0, 1, True) in got
    assert (1, 1, False) in got
    assert (3, 2, True) in got
    assert (4, 1, True) in got
    assert (7, 6, True) in got
    assert {d for d, _, _ in got} <= {0, 1, 2, 3, 4, 7}


def test_inconsistent_slots_are_no_evidence(spark, items):
    # The same name became two different ones: only windows with the item's own words count.
    mixed = ITEM.replace("and Tom", "and Ann").replace("where Tom", "where Bob")
    mixed = mixed.replace("12", "9").replace("30", "4").replace("5", "6")
    assert found(spark, items, [mixed]) == []


def test_rows_and_columns(spark, items):
    rows = [(1, ITEM, 0), (1, ITEM, 0), (None, ITEM, 0), (2, "x " * 50000 + ITEM, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, place int")
    got = contaminated(df, items).collect()
    assert sorted((r.doc_id or 0, r.n_covered) for r in got) == [(0, 30), (1, 30), (2, 30)]
    assert contaminated(df.limit(0), items).count() == 0
    assert contaminated(df, items.limit(0)).count() == 0


def test_copies_in_other_surroundings(spark):
    items = [
        (1, "What is the capital of France?"),
        (2, "Then Paul and Maria met Peter near Lyon with Clara and later Simon saw Erik and Nina"),
        (3, "Tom has 3 apples. Tom buys 4 pears and eats them. Tom sells 2 plums to the baker."),
    ]
    items = spark.createDataFrame(items, "item_id bigint, text string")
    people = "then paul and maria met peter near lyon\nwith clara and later simon saw erik and nina"
    texts = [
        "Quiz 3) What is the capital of France?",
        'She asked "What is the capital of France" twice',
        people,
        people.upper(),
        "Ann has 7 apples. Ann buys 9 pears and eats them. Ann sells 5 plums to the baker.",
        "Paris is the capital of France and a large city",
        "Ann has 7 apples. Bob buys 9 pears and eats them. Eve sells 5 plums to the baker.",
    ]
    got = found(spark, items, texts)
    assert got == [(0, 1, True), (1, 1, True), (2, 2, True), (3, 2, True), (4, 3, False)]


def test_exact_copies_of_items_that_are_mostly_slots(spark):
    rows = [(1, "12 kg 7 miles 30 dollars 5 hours 9 feet 44 cents"), (2, "Add 3 and 4")]
    rows += [(3, "Convert 5 miles to kilometers")]
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    texts = ["table: " + rows[0][1] + " end", rows[0][1].replace("30", "31"), "1) " + rows[2][1] + "."]
    assert found(spark, items, texts) == [(0, 1, True), (2, 3, True)]


@pytest.mark.parametrize("ids", [(1, 2), (1, 1), (None, None)])
def test_items_with_equal_or_missing_ids_stay_apart(spark, ids):
    words = [f"word{k}" for k in range(60)]
    texts = [" ".join(words[:30]), " ".join(words[30:])]
    items = spark.createDataFrame(list(zip(ids, texts)), "item_id bigint, text string")
    # Parts of two items are neither of them.
    parts = " ".join(words[:9] + ["between"] + words[50:])
    assert found(spark, items, [parts]) == []
    assert len(found(spark, items, [parts, texts[0], texts[1]])) == 2
