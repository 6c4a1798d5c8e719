"""Landed files and payloads → canonical rows."""

from __future__ import annotations

import hashlib
import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from confluo.operators import joins, merge
from confluo.sources import boards, feeds, html_pages, lists, threads


def payloads(spark, *docs):
    rows = [("acme", json.dumps(d) if not isinstance(d, str) else d) for d in docs]
    return spark.createDataFrame(rows, "slug string, payload string")


def test_greenhouse(spark):
    first = {
        "id": 7, "title": "Eng", "location": {"name": "Remote US"}, "content": " <p>x ", "departments": [{"name": "R&D"}],
        "metadata": [{"name": "APPLY url", "value": "https://apply"}], "absolute_url": "https://abs",
    }
    second = {"id": 8, "title": "PM", "location": "Paris", "metadata": None}
    rows = boards.src_board_greenhouse(payloads(spark, {"jobs": [first, second]}, [second], "{bad", {"x": 1})).collect()
    assert len(rows) == 3
    a = next(r for r in rows if r.source_id == "7")
    assert (a.url, a.company, a.location, a.is_remote, a.description, a.department) == (
        "https://apply", "acme", "Remote US", True, "<p>x", "R&D",
    )
    b = next(r for r in rows if r.source_id == "8")
    assert (b.url, b.location, b.is_remote, b.description) == (
        "https://boards.greenhouse.io/acme/jobs/8", "Paris", False, "PM",
    )


def test_lever(spark):
    listed = {
        "id": "a", "text": "Eng", "categories": {"location": ["Oslo", "Remote"], "team": "X", "commitment": "Part-time"},
        "description": [{"content": "one"}, "two"], "hostedUrl": "https://h", "createdAt": 5,
    }
    plain = {"id": "b", "text": "PM", "categories": {"team": "Core"}, "description": "whole text", "applyUrl": "https://a"}
    a, b = boards.src_board_lever(payloads(spark, [listed, plain])).orderBy("source_id").collect()
    assert (a.location, a.is_remote, a.description, a.job_type, a.url) == ("Oslo, Remote", True, "one\ntwo", "part_time", "https://h")
    assert (b.location, b.description, b.url, b.department) == ("Core", "whole text", "https://a", "Core")


def test_ashby_and_router(spark):
    entry = {"id": "x", "title": "E", "location": "SF", "locationType": "Remote", "isRemote": False, "compensation": {"min": 1, "max": 2.5}}
    row = boards.src_board_ashby(payloads(spark, {"jobs": [entry]})).collect()[0]
    assert (row.location, row.is_remote, row.salary_min, row.salary_max, row.url) == ("SF, Remote", False, 1.0, 2.5, "")
    routed = spark.createDataFrame(
        [("Ashby", "Big Co", None, json.dumps({"jobs": [entry]})), ("other", "y", "y", "[]")],
        "platform string, name string, slug string, payload string",
    )
    assert [(r.source, r.company) for r in boards.src_board_router(routed).collect()] == [("ashby", "bigco")]


def test_rss(spark, tmp_path):
    body = (
        "&lt;p&gt;Acme — Senior GTM Engineer — https://boards.greenhouse.io/acme/jobs/123.&lt;/p&gt;"
        "&lt;li&gt;[Beta — Remote Lead](https://x.example/1)&lt;/li&gt;&lt;br&gt;Gamma | Eng https://jobs.lever.co/g/1&lt;br/&gt;"
        "again https://jobs.lever.co/g/1&lt;br&gt;https://twitter.com/x&lt;img src=\"https://i/1.png\"&gt;"
    )
    (tmp_path / "feed.xml").write_text(
        '<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'
        f"<item><link>https://p/1</link><title>T</title><content:encoded>{body}</content:encoded></item>"
        "<item><link>https://p/2</link><description>none</description></item><item><title>no link</title></item>"
        "</channel></rss>"
    )
    posts = feeds.src_rss_posts(feeds.read_rss(spark, str(tmp_path)))
    assert {r.post_url: r.image_urls for r in posts.collect()} == {"https://p/1": ["https://i/1.png"], "https://p/2": []}
    got = {(r.company, r.title, r.url, r.is_remote) for r in feeds.src_rss_text_postings(posts).collect()}
    assert got == {
        ("Acme", "Senior GTM Engineer", "https://boards.greenhouse.io/acme/jobs/123", None),
        ("Beta", "Remote Lead", "https://x.example/1", True),
        ("Gamma", "Eng", "https://jobs.lever.co/g/1", None),
    }
    key = hashlib.sha256(b"https://i/1.png").hexdigest()[:16]
    for text, n in (('[{"company":"Z","title":null,"url":""},{"company":" "}]', 1), ('{"company":"Z"}', 0), ("garbage", 0)):
        landed = spark.createDataFrame([(key, text)], "image_hash string, extraction string")
        rows = feeds.src_rss_image_postings(posts, landed).collect()
        assert len(rows) == n
        if rows:
            assert (rows[0].title, rows[0].url) == ("(untitled)", "https://p/1")


PAGE = """<html><script type="application/ld+json">[{"@type":"JobPosting","title":"GTM","url":"https://w/jobs/12-x",
"hiringOrganization":{"name":"Acme"},"jobLocation":{"address":{"addressLocality":"SF"}},"jobLocationType":"TELECOMMUTE",
"employmentType":"FULL_TIME"},{"@type":"Event"}]</script><script type='application/ld+json'>{bad</script>
<a href="/jobs/99-eng"><b>Remote</b> Eng</a> Foo Bar</html>"""


def test_link_windows_are_those_of_the_whole_page(spark):
    """Windows cut out of pieces equal windows cut out of the page, over piece and run edges."""
    import re

    text = "".join(f"é{'x' * (i % 700)}🎉 <a href=\"/jobs/{i}-r\">Role {i}</a> ACME Oslo{'<b>' * (i % 3)}" for i in range(600))
    pattern = r'href="(/jobs/(\d+)-[^"]*)"'
    got = spark.createDataFrame([(text,), ("",), ("no link",)], "html string").select(html_pages.link_windows(F.col("html"), pattern).alias("w")).collect()
    want = [(m.group(0), text[max(0, m.start() - 50) : m.end() + 600]) for m in re.finditer(pattern, text)]
    assert [(w.link, w.window) for w in got[0].w] == want and got[1].w == got[2].w == []


def test_pages_with_many_links_take_time_in_proportion(spark):
    def seconds(n):
        page = spark.createDataFrame([("<p>" + "".join(f'<a href="/jobs/{i}-r">R</a> A B C ' for i in range(n)),)], "html string").selectExpr("1L AS page_id", "html")
        start = time.time()
        assert html_pages.src_html_link_cards(page).selectExpr("count(*)", "count(DISTINCT url)", "max(pos)").first()[:] == (n, n, n - 1)
        return time.time() - start

    seconds(100)
    assert seconds(100_000) < 60


def test_pages_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, PAGE), (2, "x")], "page_id bigint, html string").write.parquet(str(tmp_path / "pages"))
    plan = html_pages.src_html_first_nonempty(spark.read.parquet(str(tmp_path / "pages")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_html(spark):
    plain = '<div><a href="/jobs/5-pm">Lead PM</a> <span>Beta</span> Oslo</div>'
    pages = spark.createDataFrame([(1, PAGE), (2, plain), (3, PAGE), (4, "")], "page_id bigint, html string")
    row = html_pages.src_html_jsonld(pages).filter("page_id = 1").collect()
    assert [(r.source_id, r.company, r.location, r.is_remote, r.job_type) for r in row] == [("12", "Acme", "SF", True, "full_time")]
    cards = html_pages.src_html_link_cards(pages).orderBy("page_id").collect()
    assert [(c.page_id, c.source_id, c.title) for c in cards] == [(1, "99", "Remote Eng"), (2, "5", "Lead PM"), (3, "99", "Remote Eng")]
    assert (cards[1].company, cards[1].location) == ("PM", "Beta")
    got = html_pages.src_html_first_nonempty(pages).orderBy("page_id").collect()
    assert [(r.page_id, r.url) for r in got] == [(1, "https://w/jobs/12-x"), (2, "https://wellfound.com/jobs/5-pm")]


def test_comments_and_threads(spark):
    texts = [
        "<p>Acme Corp | San Francisco / Remote | <p>We&#x27;re hiring a Founding GTM Engineer now <a href=\"https://acme.com/jobs/gtm\">",
        "Acme Corp | SF | x<p>We&#x27;re hiring a Founding GTM Engineer now, again",
        "no pipes, Sales Engineer", "Beta | Berlin | Sales Engineer", "Gamma | SF | nurse", "",
    ]
    comments = spark.createDataFrame(list(enumerate(texts)), "arrival bigint, comment_text string")
    assert len(threads.src_comment_postings(comments).collect()) == 2  # whole titles differ
    rows = threads.src_comment_postings(comments, title_chars=30).collect()
    assert [(r.company, r.title, r.is_remote, r.url) for r in rows] == [
        ("Acme Corp", "We're hiring a Founding GTM Engineer now", True, "https://acme.com/jobs/gtm")
    ]
    stories = spark.createDataFrame(
        [(1, "Ask: Who is hiring? 2024", datetime(2024, 1, 2)), (2, "Ask: Who is hiring? 2023", datetime(2023, 12, 3)), (3, "Who is hiring 2023", datetime(2023, 11, 3))],
        "id bigint, title string, created_at timestamp",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    picked = threads.src_thread_select(stories, now=datetime(2024, 1, 5), months_back=1)
    assert {r.month: r.id for r in picked.collect()} == {"2024-01": 1, "2023-12": 2}


def test_reference_list(spark, tmp_path):
    doc = {"_meta": {}, "companies": [{"name": "A", "ats_slug_verified": True}, {"name": "B"}]}
    path = tmp_path / "list.json"
    path.write_text(json.dumps(doc, indent=2))
    assert [r.name for r in lists.src_reference_list(spark, str(path)).collect()] == ["A", "B"]
    assert [r.name for r in lists.src_reference_list(spark, str(path), verified_only=True).collect()] == ["A"]
    path.write_text("{broken")
    assert lists.src_reference_list(spark, str(path)).count() == 0
    assert lists.src_reference_list(spark, str(tmp_path / "missing.json")).count() == 0


LIST_A = "position int, name string, website string, ats_platform string, ats_slug string, ats_slug_verified boolean, job_count bigint, industry string, is_dream_company boolean, notes string"
LIST_B = (
    "position int, name string, url string, why_i_love_this string, attraction_types array<string>, priority string, status string, "
    "added string, notes string, discovery_path string, active_role string, active_role_url string"
)


def test_merge_two_lists(spark):
    a = spark.createDataFrame(
        [
            (0, "Stripe", "", "greenhouse", "s", True, 3, "Fin", False, None), (1, "stripe ", "x", "lever", "s2", None, None, "x", False, "n"),
            (2, "STRIPE", "y", "lever", "s3", None, 1, "x", False, "n"), (3, "PostHog", "https://ph", "ashby", "p", True, 1, "Dev", True, "keep"),
        ],
        LIST_A,
    )
    b = spark.createDataFrame(
        [
            (0, "posthog", "https://other", "w", ["craft", "tools"], "tier_1", "researching", "d", "b", None, None, None),
            (1, "Suno", "https://suno", "m", ["music", "craft"], "tier_2", None, "d", "s", None, None, None),
        ],
        LIST_B,
    )
    rows = {r.canonical_name: r for r in merge.merge_two_lists(a, b).collect()}
    assert set(rows) == {"stripe", "posthog", "suno"}
    assert [e.platform for e in rows["stripe"].ats_info] == ["greenhouse", "lever"] and rows["stripe"].ats_info[1].slug == "s2"
    assert (rows["stripe"].source, rows["posthog"].source, rows["suno"].source) == ("yc_seed", "both", "dream_list")
    assert (rows["posthog"].website, rows["posthog"].notes, rows["posthog"].priority) == ("https://ph", "keep", "tier_1")
    merged = merge.merge_two_lists(a, b)
    bridge = merge.attraction_bridge(merged)
    assert bridge.count() == 4 and merge.attraction_bridge(merged, bridge).count() == 0
    assert merge.insert_missing_dim(merged, merged).count() == 0


def test_probe_order(spark):
    boards_ = spark.createDataFrame(
        [("lever", "scaleai", 4), ("greenhouse", "scale", 2), ("greenhouse", "scaleai", 0), ("ashby", "x", 9)],
        "platform string, slug string, n_jobs int",
    )
    companies = spark.createDataFrame([("Scale AI", "https://scale.com"), ("None", "")], "name string, website string")
    row = joins.probe_first_hit(companies, boards_).collect()
    assert [(r.name, r.ats_platform, r.ats_slug, r.job_count) for r in row] == [("Scale AI", "greenhouse", "scale", 2)]


@pytest.mark.parametrize("value", [None, "", "x"])
def test_rows_export(spark, value):
    df = spark.createDataFrame([("Indeed", value, None)], "site string, job_url string, is_remote boolean")
    row = boards.src_board_rows(df).collect()[0]
    assert (row.source, row.url, row.is_remote, row.title, row.salary_currency) == ("indeed", value or "", False, "", "USD")
