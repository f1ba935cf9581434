"""Parts of urls, rules, and shrunk reputations."""

import pytest
from pyspark.sql import functions as F

from holdfast.llm import urls
from holdfast.llm.queries import RULES


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


CASES = {
    "http://A.Example.COM/x?y#z": ("a.example.com", "/x", "com/", "allow"),
    "https://example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
    "https://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "x://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
    "http://a.net/fr/x://y": ("a.net", "/fr/x://y", "net/fr/", "block"),
    "http://a.net/es": ("a.net", "/es", None, "allow"),
    "http://com": ("com", "", None, "allow"),
    "http://É.com?q": ("É.com", "", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://a.net:80/es/": ("a.net:80", "/es/", None, "allow"),
}


def test_parts_and_rules(spark):
    rows = [(k, u) for k, u in enumerate(CASES)]
    got = urls.judged(pages(spark, rows), labels(spark, []), RULES)
    for r in got.collect():
        expected = CASES[rows[r.page_id][1]]
        assert (r.host, r.path, r.rule, r.verdict) == expected


def test_domains(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("a.b.com",), ("com",), ("",)], "h string")
    got = df.select(urls.domain(df.h), urls.suffix(df.h)).collect()
    assert list(map(tuple, got)) == [("b.co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", "")]


SUFFIXES = ["com", "uk", "co.uk", "io", "github.io", "a.long.jp", "x"]


def test_domains_by_a_table_of_suffixes(spark):
    names = ["a.b.co.uk", "b.co.uk", "co.uk", "uk", "me.github.io", "deep.me.github.io", "github.io"]
    names += ["other.io", "z.a.long.jp", "long.jp", "b.long.jp", "unknown.zone", "", "x", "..com", "a.."]
    df = spark.createDataFrame([(n,) for n in names], "host string")
    rules = spark.createDataFrame([(s,) for s in [*SUFFIXES, "uk", None]], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in urls.registered(df, rules).collect()}
    for name in names:
        labels = name.split(".")
        tails = [".".join(labels[-k:]) for k in range(1, len(labels) + 1)]
        k = max((k for k, t in enumerate(tails, 1) if t in SUFFIXES), default=1)
        assert got[name] == (".".join(labels[-k - 1 :]), tails[k - 1])


def test_hosts_below_a_shared_suffix_are_apart(spark):
    rows = [(k, f"http://{'bad' if k % 2 else 'good'}.github.io/{k}") for k in range(80)]
    said = labels(spark, [(k, int(k % 2 == 0), 0) for k in range(80)])
    rows += [(100, "http://new.bad.github.io/"), (101, "http://new.good.github.io/")]
    rules = spark.createDataFrame([("io",), ("github.io",)], "suffix string")
    got = urls.judged(pages(spark, rows), said, (), suffixes=rules).collect()
    share = {r.host: r.reputation for r in got}
    assert len(got) == 82
    # A new host leans on its own domain, not on all of the shared suffix.
    assert share["new.bad.github.io"] < 0.3 < 0.7 < share["new.good.github.io"]


@pytest.mark.parametrize("salts", [1, 7])
def test_salts_change_nothing(spark, salts):
    rows = [(k, f"http://h{k % 50}.blogs.net/{k}") for k in range(300)]
    said = labels(spark, [(k, int(k % 3 > 0), 0) for k in range(0, 300, 2)])
    how = urls.Reputation(salts=salts)
    got = {r.page_id: r for r in urls.judged(pages(spark, rows), said, (), how=how).collect()}
    plain = urls.judged(pages(spark, rows), said, ()).collect()
    assert len(got) == len(plain) == 300
    for r in plain:
        assert got[r.page_id].reputation == pytest.approx(r.reputation, abs=1e-12)


def test_bad_hosts_are_blocked_and_shares_are_shrunk(spark):
    hosts = {"good.a.org": (60, 55), "bad.b.org": (60, 2), "new.b.org": (0, 0), "once.c.org": (1, 0), "fine.d.org": (40, 36)}
    rows, said, k = [], [], 0
    for host, (n, good) in hosts.items():
        for i in range(max(n, 1)):
            rows.append((k, f"http://{host}/{i}"))
            if i < n:
                said.append((k, int(i < good), 0))
            k += 1
    got = urls.judged(pages(spark, rows), labels(spark, said), ())
    by = {r.host: r for r in got.dropDuplicates(["host"]).collect()}
    assert got.count() == len(rows)
    assert {h for h, r in by.items() if r.verdict == "block"} >= {"bad.b.org"}
    assert by["fine.d.org"].verdict == by["good.a.org"].verdict == "allow"
    # One bad label moves a host less than sixty do.
    assert by["bad.b.org"].bound < by["once.c.org"].bound
    # Shrinkage: the share lies between the host's own and its parents'.
    assert 2 / 60 < by["bad.b.org"].reputation < by["new.b.org"].reputation
    assert by["new.b.org"].reputation < by["good.a.org"].reputation < 55 / 60 + 0.01


def test_edge_cases(spark):
    rows = [(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/"), (2, "http://" + "x" * 100000)]
    df = pages(spark, rows).withColumn("host", F.lit("clash")).withColumn("salt", F.lit(1))
    said = labels(spark, [(1, 1, None), (1, None, 1), (9, 0, 0), (None, 1, 0)])
    assert urls.judged(df, said, RULES).count() == 4
    assert urls.judged(df.limit(0), said, RULES).count() == 0


@pytest.mark.parametrize("path", ["/en/", ""])
def test_no_rules(spark, path):
    assert urls.judged(pages(spark, [(1, "http://a.org" + path)]), labels(spark, []), ()).first().rule is None
