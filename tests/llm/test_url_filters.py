import duckdb

from quakeloom.llm import url_filters as U

URLS = [
    "http://WWW.Example.com/en/1/5", "https://example.com/en/x", "http://a.b.example.com/en/", "http://example.com/fr/2/3", "ftp://x.net/es/4", "http://X.net/fr/1/4?q#f", "http://notexample.com/en/1", "http://y.net/de/7/7", "http://y.net/de/8/9",
    "no scheme", "", None, "http://host", "http://host?a/b", "http://h#x://y/z", "a://b://c/d", "http:///path", "http://s.co.uk/1/1", "http://t.s.co.uk/1/2", "http://www.example.com/en/", "http://xn.net/es/", "http://É.org/a b\n/c",
]


def test_rules_hosts_and_reputation_against_sql(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(500 + i, f"http://bad.org/p/{i}") for i in range(60)] + [(600 + i, f"http://good.org/p/{100 + i}") for i in range(60)] + [(None, "http://bad.org/p/999"), (3, URLS[3])]
    labels = [(i, int(i % 10 == 0), int(i % 7 == 0)) for i in range(60)] + [(100 + i, 1, 0) for i in range(60)] + [(None, 1, 1), (7, None, None), (3, 0, 1), (3, 1, 0)]
    pages, labs = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS bad"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, U.judge(U.outcomes(pages, labs)).collect()), key=str)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    con.execute("create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", labels)
    assert got == sorted(con.execute(U.ORACLE_SQL["op3_url_filters"]).fetchall(), key=str)
    by = {r[0]: r for r in got}
    assert by[0][1:] == ("www.example.com", "/en/1/5", "www.example.com/en/", "allow") and by[1][3:] == ("example.com/en/", "block") and by[2][3] == "example.com/en/"
    assert by[4][3] == "net/es/" and by[6][3:] == ("com/", "allow") and by[9][1:4] == ("", "", None) == by[11][1:4]
    assert by[500][4] == "block" and by[600][4] == "allow" and by[16][1:3] == ("", "/path")


def test_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, bad int")
    assert U.judge(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c", None)], "page_id long, url string, bad int")
    assert U.judge(one).first().verdict in ("allow", "block")
