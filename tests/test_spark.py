import json
import os

import pytest
from pyspark.sql import functions as F

from pagemill import queries, sql
from pagemill.__main__ import main
from pagemill.functions import columns as C
from pagemill.functions import text
from pagemill.functions.dom import count_words
from pagemill.operators.extract import extract, extract_page
from pagemill.operators.metadata import iso_date
from pagemill.operators.pipeline import Options
from pagemill.operators.standardize import is_unsafe_uri
from pagemill.plans import facts, nodes
from pagemill.sources import files, shared, web
from pagemill.streaming import pages as stream

ARTICLE = "<html lang=en><head><title>T</title><meta property='og:title' content='M'><meta name=keywords content='a,b'></head><body><nav><a href=/x>x</a> y</nav><article><h1>H</h1><div>2024-01-02</div><p>" + "word " * 60 + "</p><img alt=i src=a.png><img alt=i src=bb.png></article></body></html>"
ROWS = [(1, "https://www.Example.com:8080/p", ARTICLE), (2, None, None), (3, "nope", ""), (4, "http://a.org", "<p>x")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string")


def test_extract_is_the_function_on_rows(pages):
    got = {r["page_id"]: r["page"].asDict(True) for r in extract(pages, Options(separate_markdown=True, debug=True)).collect()}
    for i, url, html in ROWS:
        want = extract_page(html, url, Options(separate_markdown=True, debug=True))
        got[i].pop("parse_time_ms"), want.pop("parse_time_ms")
        assert got[i] == want


def test_extract_adds_no_shuffle_and_prunes(pages, tmp_path):
    pages.withColumn("other", F.lit("z")).write.parquet(f"{tmp_path}/p")
    rows = files.read_pages(pages.sparkSession, f"{tmp_path}/p").where("url is not null")
    plan = extract(rows).select("page_id", "page.title")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1] and "other" not in plan.split("== Physical Plan ==")[1]


def test_payloads_are_joined_by_address(spark):
    rows = spark.createDataFrame([(1, "https://wiki.c2.com/?PageName", ""), (2, "https://x.org/", "<p>a</p>")], "page_id long, url string, html string")
    api = spark.createDataFrame([("https://c2.com/wiki/remodel/pages/PageName", '{"text": "hello there"}')], "url string, body string")
    got = {r["page_id"]: r["page"]["extractor_type"] for r in extract(rows, api_payloads=api).collect()}
    assert got == {1: "c2wiki", 2: None}


def test_outputs(spark, pages, tmp_path):
    out = extract(pages)
    row = out.where("page_id = 1").select(files.result_json(F.col("page")).alias("j"), files.result_text(F.col("page")).alias("t"), files.result_markdown(F.col("page")).alias("m")).first()
    data = json.loads(row["j"])
    assert data["title"] == "M" and data["keywords"] == ["a", "b"] and data["schema_org_data"] is None and "author" not in data
    assert "keywords" not in json.loads(out.where("page_id = 4").select(files.result_json(F.col("page"))).first()[0])
    assert row["t"].startswith("H") and row["m"].startswith("<article>")
    files.write_results(out, f"{tmp_path}/o", "html")
    assert spark.read.parquet(f"{tmp_path}/o").count() == 4
    (tmp_path / "a.html").write_text("<p>\nx</p>")
    assert [r["html"] for r in files.read_html_files(spark, str(tmp_path / "a.html")).collect()] == ["<p>\nx</p>"]


def test_native_functions_agree_with_python(spark):
    texts = ["", "a<b>c</b>d>e<f", "日本 go, x\x1fy  z", "  k  l ", "&amp;lt; &copy; &bogus;", "x" * 100, "javascript:a", "data:image/png;base64,x", "data:text/html,x", "p\n\nq"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = rows.select("t", C.strip_tags(t).alias("s"), C.count_words(t).alias("w"), C.is_unsafe_uri(t).alias("u"), C.html_escape(t).alias("h"), C.first_paragraph(t, 5).alias("f"), C.non_empty(t).alias("n"), C.percent_encode(t).alias("e")).collect()
    from pagemill.operators.extractors import percent_encode

    for r in got:
        x = r["t"]
        assert (r["s"], r["w"], r["u"], r["h"], r["n"], r["e"]) == (text.strip_tags(x), count_words(x), is_unsafe_uri(x), text.html_escape(x), text.non_empty(x), percent_encode(x)), x
    dates = ["March 3, 2024", "March 3 2024", "7 May 1999", "2024-02-30", "2024-13-01", "0001-01-01", "x", "May 32, 2000"]
    rows = spark.createDataFrame([(d,) for d in dates], "d string").select("d", C.iso_date(F.col("d")).alias("i")).collect()
    assert [r["i"] for r in rows] == [iso_date(d) for d in dates]
    hosts = spark.createDataFrame([(u,) for u in ("https://u:p@WWW.a.org:443/x", "http://b.c:81?q", "ftp://z", None)], "u string").select(C.url_host(F.col("u")), C.url_origin(F.col("u"))).collect()
    assert [tuple(r) for r in hosts] == [("www.a.org", "https://www.a.org"), ("b.c", "http://b.c:81"), (None, None), (None, None)]


def test_node_table(pages):
    table = nodes.dom_nodes(pages).cache()
    one = table.where("page = 1")
    assert table.where("kind = 'document'").count() == 4
    below = nodes.within(nodes.elements(one, "img"), nodes.elements(one, "article")).count()
    assert below == 2 and nodes.has_below(nodes.elements(one, "article", "nav"), nodes.elements(one, "img")).count() == 1
    assert nodes.not_inside(nodes.elements(one, "a", "img"), nodes.elements(one, "nav")).count() == 2
    assert [r["text"] for r in nodes.text_of(one, nodes.elements(one, "nav")).collect()] == ["x y"]
    assert [r["density"] for r in nodes.link_density(one, nodes.elements(one, "nav")).collect()] == [pytest.approx(1 / 3)]
    assert nodes.best_images(one).select(nodes.attr("src")).collect()[0][0] == "bb.png"
    assert nodes.metadata_blocks(one).count() == 1 and nodes.hidden(one).count() == 0
    counts = nodes.tag_counts(one, nodes.elements(one, "article"), "p", "img").collect()[0]
    assert (counts["p"], counts["img"]) == (1, 2)
    ids = one.where("kind = 'element'").selectExpr("max(end_id) as e", "max(node_id) as n").first()
    assert ids["e"] >= ids["n"]


def test_streamed_segments(spark):
    html = '<div><template id=B:0></template></div><div id=S:0>x</div><script>$RC("B:0","S:0")</script>'
    rows = nodes.dom_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert nodes.streamed_segments(rows).count() == 1


def test_metadata_chains(pages):
    r = {x["page_id"]: x for x in facts.page_metadata(pages).collect()}
    assert (r[1]["meta_title"], r[1]["html_title"], r[1]["keywords"], r[1]["favicon"]) == ("M", "T", ["a", "b"], "https://www.example.com:8080/favicon.ico")
    assert r[2]["html_title"] is None and r[3]["domain"] is None


def test_sql_names(spark, pages):
    sql.register(spark)
    pages.createOrReplaceTempView("test_pages")
    assert spark.sql("select strip_html_tags('<b>a</b>&amp;'), count_html_words('<p>a b'), decode_html_entities('&lt;'), strip_html_tags(null)").first()[:] == (" a &", 2, "<", None)
    assert spark.sql("select extract_content(html, url).title t from test_pages where page_id = 1").first()["t"] == "M"
    assert spark.sql("select count(*) n from test_pages p, lateral dom_nodes(p.html) d where d.tag = 'img'").first()["n"] == 2


def test_stream(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/in")
    rows = stream.extract_stream(stream.read_stream(spark, f"{tmp_path}/in"))
    stream.write_stream(rows.select("page_id", "page.word_count"), f"{tmp_path}/out", f"{tmp_path}/state", True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_web_source_without_a_network(spark):
    spark.dataSource.register(web.WebPages)
    rows = spark.read.format("web_pages").option("urls", "http://127.0.0.1:9/\nbad").load().collect()
    assert len(rows) == 2 and all(r["body"] is None and r["status"] is None and r["error"] for r in rows)
    assert web.fetch_api("http://127.0.0.1:9/") is None


def test_command_line(tmp_path, capsys):
    (tmp_path / "p.html").write_text(ARTICLE)
    assert main([str(tmp_path / "p.html"), "-f", "markdown", "-u", "https://a.org"]) == 0
    assert capsys.readouterr().out.startswith("# H\n")
    assert main([str(tmp_path / "p.html")]) == 0 and json.loads(capsys.readouterr().out)["title"] == "M"
    assert main([str(tmp_path / "none.html")]) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(empty).count() == 0 and nodes.dom_nodes(empty).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    Session.conf = Conf({"spark.master": "spark://host:7077", "spark.checkpoint.dir": "s3a://bucket/x/"})
    path = shared.shared_dir(Session())
    assert path.startswith("s3a://bucket/x/pagemill-")
    shared._made.remove(path)


def test_intermediate_tables_go(spark):
    table = spark.range(5)
    with shared.Scratch(spark) as scratch:
        inner = shared.stored(table)
        kept = scratch.keep(inner.where("id > 1"))
    folder = lambda df: df.__dict__["stored_in"].removeprefix("file://")
    assert not os.path.exists(folder(inner)) and os.path.exists(folder(kept)) and kept.count() == 3
    shared.release(kept)
    assert not os.path.exists(folder(kept))


def test_large_tables_are_not_shuffled(spark, tmp_path):
    spark.range(1000).repartition(32).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert queries._spread(many) is many
    one = spark.range(10).coalesce(1)
    assert queries._spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rows_with_errors(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "<p>fine words here</p>"), (2, None), (3, '<img src=a.png width="' + "9" * 5000 + '">')], "page_id long, html string")
    got = {r["page_id"]: r["page"] for r in extract(rows, url_col=None).collect()}
    assert all(p["error"] is None for p in got.values()) and "fine words" in got[1]["content"]
    monkeypatch.setattr(nodes, "parse_document", lambda html: 1 / 0)
    assert nodes.node_rows("x") == [(0, 0, None, 0, 0, "error", None, None, "ZeroDivisionError: division by zero")]
    monkeypatch.setattr(facts, "parse_document", lambda html: 1 / 0)
    assert facts.facts_row("x") == {"error": "ZeroDivisionError: division by zero"}


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _stored_nodes(spark):
    html = '<body><h1>H</h1><p>2024-01-02</p><template id="B:1"></template><div id="S:1">x</div><a href=y>y</a><script>$RC("B:1","S:1")</script>'
    return shared.stored(nodes.dom_nodes(spark.createDataFrame([(k, html) for k in range(3)], "page_id long, html string")))


def test_metadata_blocks_are_found_without_a_broadcast(spark):
    table = _stored_nodes(spark)
    density, counts = nodes.link_density(table, nodes.elements(table, "body")), nodes.tag_counts(table, nodes.elements(table, "body"), "a", "p")
    below, apart = nodes.has_below(nodes.elements(table, "body"), nodes.elements(table, "a")), nodes.not_inside(nodes.elements(table, "a"), nodes.elements(table, "p"))
    blocks = nodes.text_of(table, nodes.merged(table, nodes.metadata_blocks(table), ["page", "node_id"]))
    assert not [df.columns for df in (blocks, density, counts, below, apart) if "Broadcast" in _physical(df)]
    assert sorted(r["text"] for r in blocks.collect()) == ["2024-01-02"] * 3 and below.count() == apart.count() == 3


def test_streamed_segments_are_joined_without_a_broadcast(spark):
    found = nodes.streamed_segments(_stored_nodes(spark))
    assert "Broadcast" not in _physical(found) and found.count() == 3


def test_days_far_from_today_have_plain_years(spark):
    times = {0: "1970-01-01", -1: "1969-12-31", 951_782_400: "2000-02-29", 253_402_300_799: "9999-12-31", 253_402_300_800: "10000-01-01", 777_590_913_601: "26610-11-16", -62_135_596_800: "0001-01-01", (1 << 63) - 1: "292277026596-12-04"}
    rows = spark.createDataFrame([(k,) for k in times], "s long").select("s", C.unix_day(F.col("s")).alias("day"))
    assert {r["s"]: r["day"] for r in rows.collect()} == times


def test_pages_made_for_metadata_rules_go_to_all_cores(spark, tmp_path):
    spark.createDataFrame([(k, f"n{k}") for k in range(9)], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert queries.QUERIES["rule_metadata"](spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
