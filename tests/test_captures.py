import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from pagesmelt import decode_responses, meaningful_pages, parse_pages, select_captures
from pagesmelt.operators.reports import (
    batch_summary,
    capture_timing,
    failed_captures,
    output_collisions,
)
from pagesmelt.sources.readers import read_html_files, read_pages, read_url_list
from pagesmelt.sources.writers import (
    write_candidates,
    write_decisions,
    write_errors,
    write_markdown,
    write_page_stats,
)

RESPONSES = [
    # content type, encoding, body, html, error
    ("text/html", None, "<meta charset=iso-8859-1>caf\xe9".encode("latin-1"),
     "<meta charset=iso-8859-1>caf\xe9", None),
    ("text/html; charset=utf-8", "GZIP", gzip.compress("圧縮".encode()), "圧縮", None),
    ("Text/HTML ; Charset=\"windows-1252\"", "deflate", zlib.compress(b"x\x93y"), "x“y", None),
    ("application/octet-stream", None, b"x", None,
     "unsupported content type: application/octet-stream"),
    (None, None, b"x", None, "unsupported content type: text/plain"),
    ("text/html; charset=nope", None, b"x", None, "unknown encoding: nope"),
    ("text/html", "gzip", b"broken", None, "cannot decompress gzip body"),
    ("application/xhtml+xml", None, b"a\xff\xe2\x82b\xed\xa0\x80c\xc0\xaf",
     b"a\xff\xe2\x82b\xed\xa0\x80c\xc0\xaf".decode("utf-8", "replace"), None),
    ("text/html; charset=utf-16le", "br", "ab".encode("utf-16le"), "ab", None),
]


def test_decode_responses(spark):
    rows = [(n, f"u{n}", None if n % 2 else f"f{n}", *r[:3]) for n, r in enumerate(RESPONSES)]
    frame = spark.createDataFrame(
        rows, "ord long, url string, final_url string, content_type string, "
              "content_encoding string, body binary")
    for row in decode_responses(frame).collect():
        _, _, _, html, error = RESPONSES[row.ord]
        assert row.html == html
        assert (row.error or "").startswith(error or "") and (row.error is None) == (error is None)
        assert row.final_url == (f"u{row.ord}" if row.ord % 2 else f"f{row.ord}")
        assert row.method == "http"


@pytest.mark.parametrize("html, expected", [
    ("<main>" + "A useful sentence. " * 12 + "</main>", True),
    ("<p>This shop wants you to please\n enable  JAVASCRIPT first.</p><p>Thanks</p>", False),
    ("<p>Kindly ENABLE\n JavaScript</p><p>x</p>", False),
    ("<body><span>One moment</span></body>", False),
    ("<p>a<p>b", True),
    ("<div role=main>" + "word " * 20 + "</div>", True),
    ("<div role=MAIN>" + "word " * 20 + "</div>", False),
    ("<template><p>a</p><p>b</p></template><script>'" + "x " * 200 + "'</script>", False),
])
def test_meaningful(spark, html, expected):
    frame = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert meaningful_pages(frame).first().meaningful is expected


def test_unreadable_pages_are_reported(spark):
    from pagesmelt import to_markdown
    from pagesmelt.operators.nodes import parse_failures
    frame = spark.createDataFrame(
        [(1, "a<![what[x]]>b"), (2, "fine"), (3, None), (4, "after")],
        "page_id long, html string").coalesce(1)
    assert parse_failures(frame).collect() == [(3, "no markup")]
    found = {r.page_id: r.markdown for r in to_markdown(frame).collect()}
    assert found == {1: "ab\n", 2: "fine\n", 3: "\n", 4: "after\n"}


def test_refused_markup_leaves_its_reason_and_no_rows(monkeypatch):
    import pyarrow as pa
    from pagesmelt.operators import tagsoup

    def refuse(self, *_):
        raise AssertionError("cannot go on")

    monkeypatch.setattr(tagsoup._NodeWalker, "parse_bogus_comment", refuse)
    found = tagsoup.walk_pages(pa.array(["<b>x<!-- -->", "y", None, "<p class=a>z<![ w>", "u"])).to_pylist()
    assert [one["error"] for one in found] == [
        None, None, None, "markup cannot be parsed: cannot go on", None]
    assert [one["nodes"] and [node["text"] for node in one["nodes"] if node["text"]]
            for one in found] == [["x"], ["y"], None, None, ["u"]]


def captures(spark, method, strict=False):
    requests = read_url_list(spark, urls=["u", "u", "v", "w"])
    static = spark.createDataFrame(
        [(0, "<p>a<p>b", None, "f"), (1, "<div>", None, None), (2, None, "boom", None)],
        "ord long, html string, error string, final_url string")
    rendered = spark.createDataFrame(
        [(1, "r1", None, True), (2, "r2", None, False)],
        "ord long, html string, error string, nav_timed_out boolean")
    found = select_captures(requests, static, rendered, method=method, strict=strict)
    return found, [(r.url, r.html, r.error, r.final_url, r.method)
                   for r in found.orderBy("ord").collect()]


def test_select_captures(spark):
    first, lost = ("u", "<p>a<p>b", None, "f", "http"), ("w", None, "no rendered capture", None,
                                                         "browser")
    late = ("u", None, "navigation timed out", None, "browser")
    assert captures(spark, "auto")[1] == [
        first, ("u", "r1", None, "u", "browser"), ("v", "r2", None, "v", "browser"), lost]
    assert captures(spark, "auto", strict=True)[1] == [
        first, late, ("v", "r2", None, "v", "browser"), lost]
    assert captures(spark, "http")[1] == [
        first, ("u", "<div>", None, "u", "http"), ("v", None, "boom", None, "http"),
        ("w", None, "no static capture", None, "http")]
    assert captures(spark, "browser")[1][0] == ("u", None, "no rendered capture", None, "browser")


def test_batch_reports(spark, tmp_path):
    found, _ = captures(spark, "auto", strict=True)
    assert tuple(batch_summary(found).first()) == (4, 2, 2, True)
    assert [r.ord for r in failed_captures(found).orderBy("ord").collect()] == [1, 3]
    write_errors(found, str(tmp_path / "errors"))
    assert spark.read.parquet(str(tmp_path / "errors")).count() == 2
    metrics = spark.createDataFrame(
        [("a", 1.0, 2.0), ("b", 3.0, 6.0)],
        "url string, browser_launch_seconds double, navigation_seconds double")
    mean = capture_timing(metrics).where("summary = 'mean'").first()
    assert (mean.browser_launch_seconds, mean.navigation_seconds) == (2.0, 4.0)


def test_url_list(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_bytes("# c\nhttp://a/1 \n\n\xa0 http://a/2\r\n  # x\nhttp://a/1\x85http://a/3".encode())
    rows = read_url_list(spark, str(path), ["http://z"]).orderBy("ord").collect()
    assert [(r.ord, r.url) for r in rows] == list(enumerate(
        ["http://z", "http://a/1", "http://a/2", "http://a/1", "http://a/3"]))


def test_url_list_order_over_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    names = [f"http://h/{n}" for n in range(3000)]
    path.write_text("\n".join(names))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_url_list(spark, str(path)).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.url for r in rows] == names and [r.ord for r in rows] == list(range(3000))


def test_numbering_has_no_window_over_all_rows(spark, monkeypatch):
    from pagesmelt.sources import readers
    for groups in (1, 2, 5, 64):
        monkeypatch.setattr(readers, "GROUPS", groups)
        rows = spark.range(500).selectExpr(
            "int(id % 2) AS source", "concat('f', id % 7) AS file", "id AS pos", "-id AS more")
        found = readers.numbered(rows, "source", "file", within="pos")
        expected = sorted(rows.collect(), key=lambda r: (r.source, r.file, r.pos))
        assert [r[:4] for r in sorted(found.collect(), key=lambda r: r.ord)] == [
            tuple(r[name] for name in found.columns[:4]) for r in expected]
        assert sorted(r.ord for r in found.collect()) == list(range(500))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert groups == 1 or "SinglePartition" not in plan
    assert readers.numbered(rows.limit(0), "source", "file").collect() == []


def test_html_files(spark, tmp_path):
    for name in ("b.html", "a.html", "c.txt"):
        (tmp_path / name).write_text(name)
    rows = read_html_files(
        spark, str(tmp_path / "c.txt"), str(tmp_path), str(tmp_path / "a.html")).collect()
    assert [r.html for r in sorted(rows, key=lambda r: r.ord)] == [
        "c.txt", "a.html", "b.html", "a.html"]
    assert sorted(r.ord for r in rows) == [0, 1, 2, 3]
    assert [r.html for r in read_html_files(spark, str(tmp_path / "c.txt")).collect()] == ["c.txt"]
    with pytest.raises(Exception, match="missing.html"):
        read_html_files(spark, str(tmp_path / "missing.html"))


def test_sinks(spark, tmp_path):
    from pagesmelt import extraction_decisions, markdown_documents
    from pagesmelt.operators.reports import page_stats
    pages = spark.createDataFrame(
        [(1, "http://h/a.html", "<main><p>x <a href=y>z</a></main>"), (2, "http://h/b", "t")],
        "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    pages = read_pages(spark, str(tmp_path / "pages"))
    write_markdown(markdown_documents(pages, "out"), str(tmp_path / "md"))
    rows = {r.output_path: r.markdown for r in spark.read.parquet(str(tmp_path / "md")).collect()}
    assert rows == {"out/a.md": "x [z](http://h/y)\n", "out/b.md": "t\n"}
    decided = extraction_decisions(pages, "dom")
    write_decisions(decided, str(tmp_path / "decisions"))
    write_candidates(decided, str(tmp_path / "candidates"))
    write_page_stats(page_stats(pages), str(tmp_path / "stats"))
    assert spark.read.parquet(str(tmp_path / "decisions")).count() == 2
    assert spark.read.parquet(str(tmp_path / "candidates")).count() == 1
    assert spark.read.json(str(tmp_path / "stats")).agg(F.sum("markdown_links")).first()[0] == 1


def test_collisions_reject_the_batch(spark, tmp_path):
    urls = spark.createDataFrame(
        [("http://a/article",), ("http://b/article?x",), ("http://c/other",)], "url string")
    assert [tuple(r) for r in output_collisions(urls, "out").collect()] == [("out/article.md", 2)]
    for pages in (None, urls):
        with pytest.raises(ValueError, match="1 paths, listed in .*md-collisions"):
            write_markdown(
                urls.withColumn("markdown", F.lit("x")), str(tmp_path / "md"), pages=pages)
    listed = spark.read.parquet(str(tmp_path / "md-collisions"))
    assert [r.output_path for r in listed.collect()] == ["article.md"]


def test_streaming_conversion(spark, tmp_path):
    from pagesmelt.streaming.convert import capture_stream, markdown_stream
    rows = [(n, f"http://h/{n}", None, "text/html", None, f"<p>{n}".encode()) for n in range(3)]
    schema = ("ord long, url string, final_url string, content_type string, "
              "content_encoding string, body binary")
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    pages = capture_stream(arriving).selectExpr("ord AS page_id", "url", "html")
    query = markdown_stream(pages, str(tmp_path / "out"), str(tmp_path / "state")).trigger(
        availableNow=True).start()
    assert query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.markdown for r in found.collect()) == ["0\n", "1\n", "2\n"]


def test_failed_captures_give_no_document(spark):
    frame = spark.createDataFrame(
        [(1, "https://h.test/a", "<p>x", None), (2, "https://h.test/b", None, "refused")],
        "page_id long, url string, html string, error string")
    from pagesmelt.plans.convert import markdown_documents
    assert [(r.page_id, r.markdown) for r in markdown_documents(frame).collect()] == [(1, "x\n")]


def test_a_batch_of_pages_is_parsed_in_portions(spark, monkeypatch):
    """Every page once and in order, whatever the size of the batch; no portion holds it whole."""
    import pyarrow as pa

    from pagesmelt.operators import tagsoup

    texts = [None if k % 7 == 0 else "" if k % 11 == 0 else f"<p>{k}" * (k % 50) for k in range(3_000)]
    texts[1_500] = "<b>x</b>" * (tagsoup.HELD_BYTES // 4)
    held, walk = [], tagsoup.walk_pages
    monkeypatch.setattr(tagsoup, "walk_pages", lambda html: held.append(html) or walk(html))
    found = pa.chunked_array(list(tagsoup.walk_batches(iter([pa.array(texts), pa.array([], pa.string())]))))
    assert found.equals(pa.chunked_array([walk(pa.array(texts))]))
    assert max(map(len, held)) <= tagsoup.HELD_PAGES
    sizes = [sum(len(text or "") for text in part.to_pylist()) for part in held if len(part) > 1]
    assert max(sizes) <= tagsoup.HELD_BYTES

    frame = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1)
    counts = {r.page_id: r.n for r in parse_pages(frame).selectExpr("page_id", "size(nodes) AS n").collect()}
    assert counts == dict(enumerate(None if nodes["nodes"] is None else len(nodes["nodes"])
                                    for nodes in walk(pa.array(texts)).to_pylist()))
