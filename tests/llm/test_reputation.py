import duckdb

from tessera.llm import queries, sql
from tessera.llm.reputation import Prior, Rule, judge, reputation

RULES = [Rule("com", "/en/", False), Rule("example.com", "/en/7", True), Rule("net", "/de/", True)]


def test_rules_and_hosts(spark):
    urls = [
        (1, "http://A.Example.COM/en/77?x"), (2, "http://a.example.com/en/1"), (3, "HTTP://badcom/en/1"), (4, "https://x.net/de/#f"), (5, None), (6, "no scheme/en/"), (7, ""), (8, "http://h.org?q=://com/en/"), (9, "a://"),
        (10, "http://a.com"), (1, "http://com/en/"),
    ]
    pages = spark.createDataFrame([(i, u, "x", "y", True) for i, u in urls], "page_id long, url string, host string, rule string, blocked boolean")
    got = [tuple(r) for r in judge(pages, spark.createDataFrame([], "page_id long, bad int"), RULES).collect()]
    want = [
        (1, "a.example.com", "/en/77", "example.com/en/7", "allow"), (2, "a.example.com", "/en/1", "com/en/", "block"), (3, "badcom", "/en/1", None, "allow"), (4, "x.net", "/de/", "net/de/", "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "", "", None, "allow"), (8, "h.org", "", None, "allow"), (9, "", "", None, "allow"), (10, "a.com", "", None, "allow"), (1, "com", "/en/", "com/en/", "block"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert judge(pages.limit(0), spark.createDataFrame([], "page_id long, bad int"), RULES).count() == 0


def test_shrinkage(spark):
    """Few bad pages on a clean domain don't block, many do; a host speaks with its domain's voice."""
    rows = [("good.a.com", 0)] * 60 + [("bad.a.com", 1)] * 40 + [("once.a.com", 1)] + [("x.b.com", 1)] * 30 + [("y.b.com", 1)] * 30 + [("z.b.com", 1)] * 3 + [("n.c.org", None)] + [("m.c.org", 0)] * 20
    got = {r.host: r.bound for r in reputation(spark.createDataFrame(rows, "host string, bad int"), Prior()).collect()}
    assert got["bad.a.com"] > 0.5 > got["once.a.com"] and got["x.b.com"] > 0.5 and got["good.a.com"] < 0.2 and got["m.c.org"] < 0.2 and "n.c.org" not in got
    assert got["z.b.com"] > got["once.a.com"]


def test_a_host_without_labels_speaks_with_the_level_above(spark):
    """Its domain's voice, else its suffix's, else that of all."""
    urls = [(f"h{h}.bad.com", 1) for h in range(20) for _ in range(20)] + [(f"h{h}.good.com", 0) for h in range(20) for _ in range(20)]
    urls += [(f"h{h}.d{h}.evil", int(i > 0)) for h in range(30) for i in range(20)] + [(f"h{h}.d{h}.org", int(i == 0)) for h in range(60) for i in range(20)]
    new = {"new.bad.com": "block", "bad.com": "block", "new.good.com": "allow", "new.unseen.evil": "block", "new.unseen.org": "allow", "new.unseen.net": "allow", "": "allow"}
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, (h, _) in enumerate(urls)] + [(10_000 + i, f"http://{h}/x") for i, h in enumerate(new)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(urls)], "page_id long, bad int")
    got = {r.host: r.verdict for r in judge(pages, outcomes, []).collect()}
    assert {h: got[h] for h in new} == new and got["h3.bad.com"] == "block" and got["h3.d3.evil"] == "block" and got["h3.good.com"] == "allow"
    all_bad = [(h, 1) for h, _ in urls[:800]] + [("x.fine.org", 0)]
    bound = {r.host: r.bound for r in reputation(spark.createDataFrame(all_bad, "host string, bad int"), Prior(), spark.createDataFrame([("a.else.net",)], "host string")).collect()}
    assert bound["a.else.net"] > 0.5


def test_labels_without_spread(spark):
    """All outcomes alike, one label a host, a page with several labels: defined bounds, no division by zero."""
    pages = spark.createDataFrame([(i, f"http://h{i // 3}.d.com/x") for i in range(30)], "page_id long, url string")
    verdicts = lambda rows: {r.verdict for r in judge(pages, spark.createDataFrame(rows, "page_id long, bad int"), []).collect()}
    assert verdicts([(i, 0) for i in range(30)]) == {"allow"} and verdicts([(i, 1) for i in range(30)]) == {"block"}
    assert verdicts([(3 * i, i % 2) for i in range(10)]) == {"allow"} and verdicts([(3 * i, 0) for i in range(10)]) == {"allow"}
    assert verdicts([(0, 1), (0, 1), (0, None), (99, 1)]) == {"block"}


def test_sql_judges_hosts_without_labels_alike(spark, tmp_path):
    """The query beside its SQL where domains, suffixes and all labels speak for hosts that have none."""
    duck = duckdb.connect()
    urls = [(f"h{h}.bad.com", 0) for h in range(20) for _ in range(20)] + [(f"h{h}.d{h}.evil", int(i == 0)) for h in range(30) for i in range(20)] + [(f"h{h}.good.com", 1) for h in range(20) for _ in range(20)]
    new = ["new.bad.com", "bad.com", "new.good.com", "x.y.evil", "alone.net", "evil", ""]
    pages = [(i, f"http://{h}/x") for i, (h, _) in enumerate(urls)] + [(10_000 + i, f"http://{h}/x") for i, h in enumerate(new)] + [(20_000, None)]
    labels = [(i, q, 0) for i, (_, q) in enumerate(urls)]
    for name, rows, schema in (("pages", pages, "page_id long, url string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        [part] = (tmp_path / f"{name}.parquet").glob("part-*.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{part}'")
    want = sorted(map(str, duck.execute(f"SELECT page_id, host, path, rule, verdict FROM ({sql.OP6}) x").fetchall()))
    got = queries.op6_host_reputation(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert {r.host: r.verdict for r in got if r.page_id >= 10_000} | {"new.good.com": "allow"} == {h: "block" if "bad" in h or "evil" in h else "allow" for h in new} | {r.host: r.verdict for r in got if r.host in ("", "alone.net")}
