from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagesmelt import extraction_decisions, page_metadata, parse_pages, to_markdown
from pagesmelt.operators.candidates import content_candidates
from pagesmelt.operators.clean import clean_nodes, drop_noise
from pagesmelt.operators.nodes import node_rows
from pagesmelt.operators.reports import extraction_quality, marker_retention, quality_means
from pagesmelt.sources.writers import candidate_lines, decision_lines

LONG = "This paragraph is long enough to count, with a second clause. It also has two sentences."
PAGES = {
    "story": f"<body><main><p>Short one.</p></main><article id=story><h1>S</h1><p>{LONG}</p>"
             f"<p>{LONG}</p></article><footer>foot</footer></body>",
    "short": "<body><div>Top bar</div><main><p>Later.</p></main></body>",
    "links": "<body><p>Context.</p><main>" + "".join(
        f"<a href='/{n}'>A rather long navigation target {n}</a> " for n in range(4))
             + "</main></body>",
    "bare": f"<body><div class='post x'>{LONG}</div></body>",
    "none": f"<body><p>{LONG}</p></body>",
    "twins": f"<body><div class=post><p>{LONG}</p></div><div class=post><p>{LONG}</p><p>{LONG}</p>"
             "</div></body>",
    "technical": f"<body><header>Menu</header><main><h1>Setup</h1><p>{LONG}</p><pre><code "
                 f"class=language-py>run()</code></pre><h2>More</h2><p>{LONG}</p></main>"
                 "<footer>Legal</footer></body>",
}


def table(spark, pages):
    return spark.createDataFrame(
        list(enumerate(pages.values())), "page_id long, html string")


def decisions(spark, mode):
    rows = extraction_decisions(table(spark, PAGES), mode).collect()
    names = list(PAGES)
    return {names[row.page_id]: row for row in rows}


def test_dom_decisions(spark):
    found = decisions(spark, "dom")
    assert {name: (row.selected, row.reason) for name, row in found.items()} == {
        "story": ("article#story", "highest-quality DOM candidate"),
        "short": ("full", "best candidate is too short (6 characters)"),
        "links": ("full", "best candidate has high link density (0.98)"),
        "bare": ("full", "best candidate lacks paragraph and document structure"),
        "none": ("full", "no DOM candidates found"),
        "twins": ("div.post", "highest-quality DOM candidate"),
        "technical": ("main[0]", "highest-quality DOM candidate"),
    }
    best = found["story"].candidates[0]
    assert (best.selector, best.paragraphs, best.structural_elements) == ("article#story", 2, 1)
    assert [c.selector for c in found["story"].candidates] == ["article#story", "main[0]"]
    assert found["none"].candidates == []


def test_repeated_label_takes_the_first_bearer(spark):
    text = to_markdown(table(spark, {"t": PAGES["twins"]}), content="dom").first().markdown
    assert text == LONG + "\n"


def test_readability_decisions(spark):
    found = decisions(spark, "auto")
    assert found["technical"].selected == "readability"
    assert found["story"].selected == "readability"
    assert found["short"].reason == "best candidate is too short (6 characters)"
    assert found["links"].selected == "full"
    text = to_markdown(table(spark, {"t": PAGES["technical"]}), content="readability").first()
    assert "# Setup" in text.markdown and "```py\nrun()" in text.markdown
    assert "Menu" not in text.markdown and "Legal" not in text.markdown


def test_full_decisions(spark):
    rows = extraction_decisions(table(spark, PAGES), "full").collect()
    assert {(row.selected, row.reason, len(row.candidates)) for row in rows} == {
        ("full", "full mode requested", 0)}


def test_candidate_features(spark):
    html = ("<main class='x y'>aa<a href=1>b<a>cc</a></a><p>t. u!</p><article id=q><h1>T</h1>"
            "<a> </a></article></main><div role=MAIN>zz</div><div class=' post '>k<a>l</a></div>")
    rows = content_candidates(clean_nodes(node_rows(parse_pages(
        table(spark, {"c": html}))))).orderBy("cand_ord").collect()
    assert [(r.selector, r.score, r.text_length, r.paragraphs, r.link_density, r.punctuation,
             r.structural_elements) for r in rows] == [
        # a link inside a link counts for both: 4 + 2 of 15 characters
        ("main.x.y", 95.4, 15, 1, 0.4, 2, 1), ("article#q", 41.0, 1, 0, 0.0, 0, 1),
        ('div[role="main"]', 2.0, 2, 0, 0.0, 0, 0), ("div.post", 2.0, 3, 0, 0.333, 0, 0)]


def test_decision_texts(spark):
    rows = extraction_decisions(table(spark, {"s": PAGES["short"]}), "dom")
    assert decision_lines(rows).first().line == (
        "extraction: mode=dom selected=full reason=best candidate is too short (6 characters)")
    assert candidate_lines(rows).first().line == (
        "candidate: selector=main[0] score=98.00 text=6 paragraphs=1 links=0.000 punctuation=1 "
        "structure=0")


def test_cleaning_twice_changes_nothing(spark):
    rows = node_rows(parse_pages(table(spark, PAGES)))
    once = drop_noise(rows)
    assert once.count() == drop_noise(once).count() <= rows.count()


def test_metadata(spark):
    html = ("<html lang=' ja '><title> Fall <b>back</b></title><meta property=og:title content=' '>"
            "<meta name=description content='S #1'><meta property=article:author content=A>"
            "<meta name=datePublished content=2026><link rel='x canonicalish' href='/c'><h1>H</h1>")
    frame = spark.createDataFrame(
        [(1, html, datetime(2026, 8, 29, 13)), (2, "<h1>H <i>2</i></h1>", datetime(
            2026, 8, 29, 13, 0, 0, 50))], "page_id long, html string, at timestamp")
    rows = page_metadata(parse_pages(frame), fetched_at="at").orderBy("page_id").collect()
    assert rows[0].metadata.asDict() == {
        "title": "Fall back", "description": "S #1", "canonical_url": "/c", "author": "A",
        "published_time": "2026", "language": "ja", "fetched_at": "2026-08-29T13:00:00+00:00"}
    assert rows[1].metadata.title == "H 2" and rows[1].metadata.language is None
    assert rows[1].metadata.fetched_at == "2026-08-29T13:00:00.000050+00:00"


def test_quality_reports(spark):
    rows = {(r.page_id, r.extractor): r for r in extraction_quality(
        table(spark, {"t": PAGES["technical"]})).collect()}
    assert rows[0, "full"].text_length > rows[0, "dom"].text_length == rows[
        0, "readability"].text_length
    assert (rows[0, "dom"].headings, rows[0, "dom"].code_blocks) == (2, 2)
    means = quality_means(extraction_quality(table(spark, PAGES), ("full",))).first()
    assert means.pages == len(PAGES)
    outputs = spark.createDataFrame([(1, "a b c")], "case_id long, output string")
    markers = spark.createDataFrame([(1, "a"), (1, "z")], "case_id long, marker string")
    assert marker_retention(outputs, markers).first().marker_retention == pytest.approx(0.5)


def exchanges(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_pages_are_parsed_and_shuffled_once(spark):
    from checks.derived import pages
    source = pages(spark, "/root/testdata/sf0.001").select("page_id", "url", "html")
    rows = clean_nodes(node_rows(parse_pages(source)))
    plan = exchanges(content_candidates(rows).agg(F.count("*")))
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("hashpartitioning(page_id") <= 2  # spreading the input, then the one exchange
    for options in ({"content": "dom"}, {"content": "auto"}, {"front_matter": True},
                    {"content": "auto", "front_matter": True}):
        plan = exchanges(to_markdown(source, **options))
        assert plan.count("ArrowEvalPython") == 1
        # Node rows are never dealt out again above the exchange of whole pages.
        assert "ENSURE_REQUIREMENTS" not in plan
    timed = source.withColumn("at", F.lit(datetime(2026, 8, 29)))
    plan = exchanges(to_markdown(timed, content="dom", front_matter=True, fetched_at="at"))
    assert plan.count("ArrowEvalPython") == 1


def test_many_roots_keep_their_order_and_nothing_else(spark):
    from pagesmelt.plans.convert import root_rows
    html = "<body><p>a</p><div><p>b</p><p>c</p></div><p>d</p><p>e</p></body>"
    rows = clean_nodes(node_rows(parse_pages(table(spark, {"x": html, "full": html}))))
    texts = {r.text: r.pre for r in rows.where("kind = 'text' AND page_id = 0").collect()}
    pres = [texts["b"] - 2, texts["b"] - 1, texts["e"] - 1]  # the div, a root inside it, a paragraph
    chosen = spark.createDataFrame([(0, pres), (1, None)], "page_id long, roots array<int>")
    kept = root_rows(rows, chosen).where("kind = 'text'").orderBy("page_id", "pre").collect()
    assert [(r.page_id, r.text) for r in kept] == [
        (0, "b"), (0, "c"), (0, "e"), *((1, t) for t in "abcde")]
