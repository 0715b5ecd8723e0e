from pyspark.sql import functions as F

from quern.llm import urls
from quern.llm.components import components

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def judged(spark, rows, redirects=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r for r in urls.judge(pages, RULES, redirects).collect()}


def test_rules(spark):
    seen = judged(spark, [
        (1, "http://A.Example.ORG/es/1?x#y", ""), (2, "https://example.org/en/12", None), (3, "https://other.org", ""), (4, "http://other.org/x", ""), (5, "http://b.com/fr/a", ""),
        (6, "http://b.com/de", ""), (7, "http://b.com/de/", ""), (8, None, None), (9, "no url", ""), (10, "http://notexample.org/es/", ""), (11, "x://h.net?a/b#c", ""), (12, "", ""),
    ])
    assert (seen[1]["host"], seen[1]["path"], seen[1]["rule"], seen[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert seen[2]["rule"] == "example.org/en/1" and seen[3]["rule"] is None and seen[3]["path"] == "" and seen[4]["verdict"] == "allow" and seen[4]["rule"] == "org/"
    assert seen[5]["verdict"] == "allow" and seen[6]["rule"] is None and seen[7]["verdict"] == "block" and (seen[8]["host"], seen[8]["path"], seen[8]["verdict"]) == ("", "", "allow")
    assert seen[9]["host"] == "" and seen[10]["rule"] == "org/" and (seen[11]["host"], seen[11]["path"]) == ("h.net", "") and seen[12]["verdict"] == "allow"


def test_a_table_of_rules_gives_the_same(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    more = [(1000, "http://A.example.org/en/1", canonical("http://b.com/de/")), (1001, None, None), (1002, "nothing", ""), (1003, "http://org/", ""), (1004, "http://.org/x", "")]
    pages = pages.union(spark.createDataFrame(more, pages.schema))
    rules = (*RULES, ("block", "org/"), ("block", "example.net"), ("allow", "net/en"))
    table = spark.createDataFrame(rules, "verdict string, rule string")
    a, b = (sorted(map(tuple, urls.judge(pages, r).fillna("~").collect()), key=str) for r in (rules, table))
    assert a == b and any(r[4] == "example.net" for r in a)


def canonical(target):
    return f'<html><LINK href="{target}" rel="canonical"></html>'


def test_decisions_spread_over_aliases(spark):
    chain = [(i, f"http://n{i}.net/p", canonical(f"http://n{i + 1}.net/p/")) for i in range(40)]
    rows = [*chain, (100, "http://n40.net/p", canonical("//bad.com/de/x")), (101, "http://solo.net/", ""), (102, "http://n7.net/p?utm_source=z#f", "")]
    seen = judged(spark, rows)
    assert all(seen[i]["verdict"] == "block" for i in range(40)) and seen[100]["verdict"] == "block" and seen[101]["verdict"] == "allow" and seen[102]["verdict"] == "block"


def test_explicit_allow_wins(spark):
    rows = [
        (1, "http://a.net/", canonical("http://x.com/de/1")), (2, "http://b.net/", canonical("http://a.net")),
        (3, "http://c.net/", canonical("http://y.com/de/1")), (4, "http://y.org/ok", canonical("http://c.net/")), (5, "http://y.com/de/1", None),
    ]
    seen = judged(spark, rows)
    assert seen[1]["verdict"] == seen[2]["verdict"] == "block"
    assert seen[3]["verdict"] == "allow" and seen[4]["verdict"] == "allow" and seen[5]["verdict"] == "block"


def test_redirects_refresh_and_relative_links(spark):
    table = spark.createDataFrame([("http://p.net/a", "http://q.com/de/z"), (None, "http://r.net/"), ("bad", None)], "source string, target string")
    rows = [(1, "https://p.net/a/", ""), (2, "http://s.com/x", "<meta http-equiv='refresh' content='0; url=/de/home'>"), (3, "http://t.net/", "")]
    seen = judged(spark, rows, table)
    assert [seen[i]["verdict"] for i in (1, 2, 3)] == ["block", "block", "allow"]


def test_targets_relative_to_the_page(spark):
    blocked = [(90, "http://w.com/de/2", None)]
    links = ["2", "./2", "../de/2", "../../../de/./2", "3", "#x", "mailto:a@w.com", "2?utm_source=a&amp;ref=b", ""]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(links)], "i int, t string")
    found = {r["t"]: r["url"] for r in pages.select("t", urls.absolute(F.col("t"), F.lit("w.com"), F.lit("/de/9")).alias("url")).collect()}
    assert found["2"] == found["./2"] == found["../de/2"] == found["../../../de/./2"] == "http://w.com/de/2" and found["3"] == "http://w.com/de/3"
    assert found["#x"] is None and found["mailto:a@w.com"] is None and found[""] is None and found["2?utm_source=a&amp;ref=b"] == "http://w.com/de/2?utm_source=a&ref=b"
    seen = judged(spark, [(1, "http://v.net/a/b", canonical("c")), (2, "http://v.net/a/c/", canonical("../../x/y")), (3, "http://v.net/x/y", canonical("http://w.com/de/2")), *blocked, (4, "http://v.net/z", canonical("#top"))])
    assert [seen[i]["verdict"] for i in (1, 2, 3, 4)] == ["block", "block", "block", "allow"]


def test_empty_repeated_and_extra_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(none, RULES).count() == 0
    rows = [(1, "http://a.com/de/", ""), (1, "http://a.com/de/", ""), (None, "http://a.com/fr/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit("x"))
    out = urls.judge(pages, RULES)
    assert out.count() == 3 and out.where("page_id is null and verdict = 'allow'").count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3), (7, None), (61, 62), (60, 59)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(1, 61)} == {0} and {found[i] for i in range(101, 140)} == {100} and found[62] == 61 and 200 not in found and 0 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    words = {r["node"]: r["root"] for r in components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()}
    assert words == {"b": "a", "c": "a"}
