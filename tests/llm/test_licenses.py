"""License families on held-out wordings, and texts without licenses."""

import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F

from holdfast.llm.licenses import license_scan

PLAIN = "Reti ndhe thble stha the ofeding a anersh erth as.\nThe inhe iterthorre sted of."


@pytest.fixture(scope="module")
def scanned(spark):
    """Given texts among the documents, which give the plain paragraphs."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    texts = {
        -1: PLAIN + "\nReleased under the MIT License.",
        -2: PLAIN + "\nThis work is licensed under the GNU General Public License, version 3.\n" + PLAIN,
        -3: "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.",
        -4: PLAIN,
        -5: "He lost his driving license and took the bus.",
        -6: "This tool is distributed under the Zebra Software License, version 9.",
        -7: "",
        -8: None,
        -9: "word " * 40000 + "\nLicensed under the Apache License, Version 2.0.",
        -10: "THIS PROGRAM IS RELEASED UNDER THE MIT LICENSE.",
        -11: "Licensed under CC BY-SA 4.0.",
    }
    own = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    every = docs.unionByName(own).unionByName(own.where("doc_id = -1"))
    rows = license_scan(every.withColumn("licenses", F.lit(1)).withColumn("words", F.lit("x")))
    return [r.asDict() for r in rows.collect()]


def test_families(scanned):
    got = {r["doc_id"]: r["licenses"] for r in scanned}
    assert got[-1] == "MIT" and got[-2] == "GPL" and got[-3] == "Apache-2.0,CC-BY-NC"
    assert got[-9] == "Apache-2.0" and got[-10] == "MIT" and got[-11] == "CC-BY-SA"
    assert got[-6] == "unknown"
    assert [got[k] for k in (-4, -5, -7, -8)] == [None] * 4


def test_documents(spark, scanned):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    lines = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "MIT": "Released under the MIT License.",
        "GPL": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    }
    truth = {}
    for r in docs.select("doc_id", "text").collect():
        truth[r.doc_id] = ",".join(sorted(f for f, line in lines.items() if line in r.text)) or None
    got = {r["doc_id"]: r["licenses"] for r in scanned if r["doc_id"] >= 0}
    assert got == truth


def test_rows(scanned):
    assert len(scanned) == 1000 + 12
    assert [r["licenses"] for r in scanned if r["doc_id"] == -1] == ["MIT", "MIT"]


def test_a_notice_in_a_third_of_the_rows_is_found_in_all(spark):
    """Whatever the hash of its line: no common notice is learned as harmless."""
    first = "Redistribution and use in source and binary forms, with or without modification,"
    lines = [first + " are permitted provided that the following conditions are met:"]
    lines.append("If a copy of the MPL was not distributed with this file, You can obtain one at"
                 " http://mozilla.org/MPL/2.0/.")
    for line, family in zip(lines, ("BSD", "MPL-2.0")):
        rows = [(i, f"{PLAIN} {i}\n" + (line if i % 3 == 0 else "the end")) for i in range(900)]
        got = license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert {r.licenses for r in got if r.doc_id % 3 == 0} == {family}
        assert {r.licenses for r in got if r.doc_id % 3} == {None}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert license_scan(empty).count() == 0
