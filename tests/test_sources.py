import datetime as dt
import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioscope.operators import briefing, library, reconcile, textjobs
from folioscope.sources import feeds, pages, papers, sitemaps, store


def test_sitemaps(spark):
    listing = "<sitemap><loc>https://x.org/sitemap/posts/2024/posts-2024-01-30.xml</loc>\n<lastmod>b</lastmod></sitemap>" \
              "<sitemap><loc>https://x.org/sitemap/posts/2024/posts-2024-01-02.xml</loc><lastmod>b</lastmod></sitemap>" \
              "<sitemap><loc>https://x.org/sitemap/posts/2030/posts-2030-01-02.xml</loc><lastmod>b</lastmod></sitemap>"
    led = spark.createDataFrame([(dt.date(2024, 1, 30), "a"), (dt.date(2024, 1, 2), "a")], "day date, lastmod string")
    rows = sitemaps.sitemap_listing(spark.createDataFrame([(listing,)], "text string"))
    assert [str(r.day) for r in sitemaps.sitemap_pending(rows, led, "2024-01-31").collect()] == ["2024-01-30"]
    xml = "<urlset><url><loc>https://medium.com/@a/two-words-0123abcd4567</loc><priority>0.8</priority></url>" \
          "<url><loc>https://medium.com/@a/thanks-0123abcd4567</loc></url><url><loc>https://medium.com/@b/bad-prio-0123abcd4567</loc><priority>1.0.0</priority></url></urlset>"
    raw = spark.createDataFrame([(dt.date(2024, 1, 30), "b", xml), (dt.date(2024, 1, 29), "b", xml)], "day date, lastmod string, text string")
    known = spark.createDataFrame([("https://medium.com/@b/bad-prio-0123abcd4567",)], "url string")
    got = sitemaps.sitemap_ingest(raw, known).collect()
    assert [(r.title, r.author, r.prio, str(r.day)) for r in got] == [("Two words", "@a", 0.8, "2024-01-30")]
    assert {r.posts for r in sitemaps.ledger_rows(raw).collect()} == {2}


def test_news_window_is_closed_and_plain(spark):
    def item(title, link, date):
        return f"<item><title>{title}</title><link>{link}</link><source>Pub</source><pubDate>{date}</pubDate></item>"

    xml = "<rss><channel>" + "".join([
        item("Edge - Pub", "https://a.org/1", "Wed, 31 Jan 2024 00:00:00 GMT"), item("Start", "https://a.org/2", "Sun, 28 Jan 2024 01:00:00 +0100"),
        item("Old", "https://a.org/3", "Sat, 27 Jan 2024 23:59:59 GMT"), item("Future", "https://a.org/4", "Wed, 31 Jan 2024 00:00:01 GMT"),
        item("Undated", "https://a.org/5", "soon"), item("Scheme", "ftp://a.org/6", "Tue, 30 Jan 2024 00:00:00 GMT"),
        item("Login", "https://me:x@a.org/7", "Tue, 30 Jan 2024 00:00:00 GMT"), item("Host", "https:///8", "Tue, 30 Jan 2024 00:00:00 GMT")]) + "</channel></rss>"
    raw = spark.createDataFrame([("e", "AI", "edge models", xml)], "edition string, category string, query string, text string")
    got = {r.title: r.score for r in feeds.news_feed_items(raw, "2024-01-28 00:00:00", "2024-01-31 00:00:00").collect()}
    assert set(got) == {"Edge", "Start"} and abs(got["Edge"] - (4 + 2 * 0.5 + 1)) < 1e-9


def test_merge_keeps_best_and_unites_topics(spark):
    rows = [("e", 1, "Chip plant opens", "u1", "P", "AI", ["a"], 1.0, 1), ("e", 2, "Chip plant opens", "u2", "Q", "AI", ["b"], 2.0, 2),
            ("e", 3, "Other thing", "u1", "P", "AI", ["c"], 0.5, 3)]
    df = spark.createDataFrame(rows, "edition string, item_id int, title string, url string, publisher string, category string, topics array<string>, score double, arrival int")
    df = df.withColumn("published", F.lit("2024-01-30").cast("timestamp"))
    got = briefing.merge(df).collect()
    assert [(r.item_id, r.topics) for r in got] == [(2, ["a", "b", "c"])]


def state(posts):
    users = {"User:1": {"name": "Ada"}, "Tag:ml": {"id": "machine-learning"}}
    return "<html><script>window.__APOLLO_STATE__ = " + json.dumps({**users, **posts}) + "</script></html>"


def test_page_metadata(spark):
    post = {"title": " T ", "clapCount": 12, "readingTime": 6.6, "detectedLanguage": "en", "isLocked": True, "firstPublishedAt": 1700000000000,
            "creator": {"__ref": "User:1"}, "tags": [{"__ref": "Tag:ml"}, {"__ref": "Tag:rust"}], "previewImage": {"id": "i.png"},
            "extendedPreviewContent": {"subtitle": "Sub"}, "content({})": {"bodyModel": {"paragraphs": [{"__ref": "P:0"}, {"__ref": "P:1"}]}}}
    dirty = dict(post, clapCount=float("inf"), readingTime=float("nan"), firstPublishedAt=-1, tags="x", creator={"__ref": "User:9"})
    body = {"P:0": {"type": "H3", "text": "t!"}, "P:1": {"type": "P", "text": "Subway rides"}}
    rows = [("https://x.org/a-ab12", state({"Post:ab12": post, **body})), ("https://x.org/b-ab12", state({"Post:ab12": dirty})),
            ("https://x.org/c-zz", state({"Post:1": post, "Post:2": post})), ("https://x.org/d", "<html/>"), ("https://x.org/e", '<script>window.__APOLLO_STATE__ = {"a":</script>')]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r.url[-6]: r for r in pages.page_metadata(df).withColumn("url", F.rpad("url", 20, "-")).collect()}
    rows = {r.url: r for r in pages.page_metadata(df).collect()}
    a, b = rows["https://x.org/a-ab12"], rows["https://x.org/b-ab12"]
    assert (a.title, a.author, a.claps, a.reading_time, a.locked, a.tags, str(a.published)) == ("T", "Ada", 12, 7, True, ["machine-learning", "rust"], "2023-11-14 22:13:20")
    assert (b.claps, b.reading_time, b.published, b.tags, b.author) == (0, 0, None, [], "")
    assert not any(rows[u].readable for u in ("https://x.org/c-zz", "https://x.org/d", "https://x.org/e")) and got
    blocks = pages.body_blocks(df.filter("url like '%a-ab12'"))
    meta = pages.page_metadata(df)
    assert [r.text for r in pages.drop_repeated_heading(blocks, meta).collect()] == ["Subway rides"]
    assert pages.shown_subtitle(blocks, meta.filter("url like '%a-ab12'")).first().subtitle == ""


def test_readable_extract(spark):
    long = "word " * 100
    page = f"<nav><p>menu</p></nav><p>outside</p><article><h1>Title</h1><p>{long}</p><ul><li>one</li><li>two</li></ul><p>mid</p><li>three</li>" \
           + "<img src='/a.png'>" * 14 + "<script>var x = '<p>no</p>'</script></article>"
    df = spark.createDataFrame([(1, page), (2, "<p>thin</p>"), (3, f"<p>{long}</p><article><p>short</p></article>")], "page_id bigint, html string")
    rows = pages.readable_extract(pages.page_blocks(df)).orderBy("page_id", "pos").collect()
    one = [(r.tag, r.list_no) for r in rows if r.page_id == 1 and r.tag != "img"]
    assert one == [("h2", None), ("p", None), ("li", 1), ("li", 1), ("p", None), ("li", 2)]
    assert sum(r.tag == "img" for r in rows) == 12 and {r.page_id for r in rows} == {1, 3}
    assert len([r for r in rows if r.page_id == 3]) == 2


def test_papers(spark, tmp_path):
    works = [{"DOI": "10.1/A", "title": ["A &amp;amp; B"], "author": [{"given": "Ada", "family": "L"}, {"name": "Org"}], "abstract": "<jats:p>Hi</jats:p>",
              "issued": {"date-parts": [[None]]}, "published": {"date-parts": [[2020, 3]]}, "type": "journal-article"},
             {"DOI": "10.1/a", "title": []}, {"title": ["none"]}]
    path = tmp_path / "w.json"
    path.write_text("\n".join(json.dumps(w) for w in works))
    got = papers.paper_records(papers.read_works(spark, str(path))).orderBy("doi").collect()
    assert len(got) == 2 and got[0].id == got[1].id
    a = got[0]
    assert (a.title, a.authors, a.abstract, a.published, a.year, a.type) == ("A & B", ["Ada L", "Org"], "Hi", "2020-03", 2020, "journal article")
    assert got[1].title == "Untitled" and got[1].url == "https://doi.org/10.1/a"


def test_store_round_trip(spark, tmp_path):
    one = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)], "id string, v string, seq int")
    first = store.latest_rows(one.limit(0), one, "id", "seq")
    first.write.parquet(str(tmp_path / "t1"))
    more = spark.createDataFrame([("b", "3", 3), ("c", "3", 3)], "id string, v string, seq int")
    both = store.latest_rows(spark.read.parquet(str(tmp_path / "t1")), more, "id", "seq")
    assert sorted((r.id, r.v) for r in both.collect()) == [("a", "2"), ("b", "3"), ("c", "3")]
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "aa.json").write_text(json.dumps({"notes": "x", "highlights": [{"id": "h", "quote": "q"}]}))
    n = store.load_notes(spark, str(tmp_path / "notes"))
    assert [(r.article_id, r.summary, r.n) for r in n.select("article_id", "summary", library.notes_count().alias("n")).collect()] == [("aa", "", 2)]
    (tmp_path / "lib.json").write_text('{"id":"1","url":"u","claps":3}\n{"id":"2"}\nbroken\n')
    assert [(r.id, r.source) for r in store.load_library(spark, str(tmp_path / "lib.json")).collect()] == [("1", "auto")]


def test_manifest_reuse(spark, tmp_path):
    folder = tmp_path / "files"
    (folder / "d").mkdir(parents=True)
    (folder / "d" / "a.txt").write_text("one")
    (folder / "b.txt").write_text("two")
    first = reconcile.hash_files(spark, str(folder), reconcile.list_files(spark, str(folder)).withColumn("sha256", F.lit(None).cast("string")))
    first = spark.createDataFrame(first.collect(), first.schema)
    assert {r.path for r in first.collect()} == {"d/a.txt", "b.txt"} and first.filter("sha256 is null").count() == 0
    (folder / "b.txt").write_text("three!")
    again = reconcile.reuse_digests(reconcile.list_files(spark, str(folder)), first)
    assert [r.path for r in again.filter("sha256 is null").collect()] == ["b.txt"]


def test_overlay_keeps_only_changes(spark):
    base = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, v string")
    none = spark.createDataFrame([], "id string, v string, deleted boolean")
    now = spark.createDataFrame([("1", "a"), ("2", "B"), ("9", "n")], "id string, v string")
    over = reconcile.diff_overlay(now, base, none)
    assert sorted((r.id, r.v, r.deleted) for r in over.collect()) == [("2", "B", False), ("3", None, True), ("9", "n", False)]
    back = reconcile.apply_overlay(base, over)
    assert sorted((r.id, r.v, r.is_new) for r in back.collect()) == [("1", "a", False), ("2", "B", False), ("9", "n", True)]
    assert sorted(r.id for r in reconcile.diff_overlay(now, base, over).collect()) == ["2", "3", "9"]


def test_quotes_move_with_the_text(spark):
    docs = spark.createDataFrame([(1, "aa bb aa bb aa"), (2, "nothing")], "doc_id bigint, text string")
    rows = [("same", 1, "bb", 3, "", ""), ("moved", 1, "aa", 1, "bb ", ""), ("gone", 2, "aa", 0, "", ""), ("overlap", 1, "a bb a", 0, "", "a bb")]
    q = spark.createDataFrame(rows, "quote_id string, doc_id bigint, quote string, start int, prefix string, suffix string")
    got = {r.quote_id: (r.start, r.orphan) for r in textjobs.anchor_quotes(q, docs).collect()}
    assert got == {"same": (3, False), "moved": (6, False), "gone": (None, True), "overlap": (1, False)}


def test_mail_dates(spark):
    rows = [("Mon, 05 Feb 2024 10:00:00 EST", "2024-02-05 15:00:00"), ("5 Feb 2024 1:00:00 GMT", "2024-02-05 01:00:00"), ("5 Feb 2024 10:00 +0200", "2024-02-05 08:00:00"),
            ("5 Feb 2024 10:00:00", "2024-02-05 10:00:00"), ("5 Feb 2024 10:00:00 pdt", "2024-02-05 17:00:00"), ("no date", None)]
    got = spark.createDataFrame(rows, "c string, want string").select(feeds.mail_date(F.col("c")).cast("string").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_values_that_are_no_numbers(spark):
    html = '<script>window.__APOLLO_STATE__ = {"Post:ab12":{"title":"Guide to: NaN \\\\"x: Infinity\\\\" handling","clapCount":NaN,"readingTime":-Infinity}};</script>'
    r = pages.page_metadata(spark.createDataFrame([("https://x.org/a-ab12", html.replace("\\\\", "\\"))], "url string, html string")).first()
    assert r.title == 'Guide to: NaN "x: Infinity" handling' and r.claps == 0 and r.reading_time == 0


def test_image_links_are_absolute(spark):
    long = "word " * 100
    html = f"<article><p>{long}</p><img src='/a.png'><img data-src='b.png'><img src='//c.org/d.png'><img src='data:x'></article>"
    rows = pages.page_blocks(spark.createDataFrame([(1, "https://x.org/p/q", html)], "page_id bigint, url string, html string")).filter("tag = 'img'").orderBy("pos").collect()
    assert [r.value for r in rows] == ["https://x.org/a.png", "https://x.org/p/b.png", "https://c.org/d.png"]


def test_paper_search_without_limit(spark, tmp_path):
    docs = [(i, f"Title {i}", "en", "src1", 9) for i in range(1, 151)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    rows = entry.queries()["paper_search"](spark, str(tmp_path)).collect()
    assert sorted(r.place for r in rows) == [i for i in range(1, 151) if i % 11]  # every work that has a DOI
    works = spark.createDataFrame([("q", i, f"10.1/{i}") for i in range(130)], "query_id string, place long, DOI string")
    works = works.select("*", F.from_json(F.lit("{}"), papers.WORK_SCHEMA.replace("DOI string, ", "")).alias("w")).select("query_id", "place", "DOI", "w.*")
    assert [papers.paper_search(works, rows=n).count() for n in (1, 120, None)] == [1, 120, 130]


def test_tokens_of_few_pages_are_held_at_once(spark):
    html = "<p>" + "<b>x</b> " * 20 + "</p>"
    df = spark.createDataFrame([(i if i else None, html if i % 5 else None) for i in range(300)], "page_id long, html string").coalesce(1)
    rows = pages.page_tokens(df)
    got = {r.page_id: (r.n, r.least, r.most) for r in rows.groupBy("page_id").agg(F.count("*").alias("n"), F.min("n").alias("least"), F.max("n").alias("most")).collect()}
    assert len(got) == 240 and set(got.values()) == {(82, 0, 81)}
    assert pages.PAGES_AT_ONCE <= 64 and "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
