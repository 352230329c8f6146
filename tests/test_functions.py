from pyspark.sql import functions as F

from folioscope.functions import scoring, text, urls
from folioscope.operators import classify, textjobs

NOW = "2024-01-31 00:00:00"


def values(spark, rows, *cols):
    schema = ", ".join(f"c{i} string" for i in range(len(rows[0])))
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_words_and_stems(spark):
    got = values(spark, [("Café running_fast, C3PO!",)], text.words("c0"))
    assert got == [(["cafe", "running", "fast", "c3po"],)]
    want = {"companies": "company", "studied": "study", "running": "run", "stopped": "stop", "filling": "fill", "class": "class",
            "status": "status", "analysis": "analysis", "cats": "cat", "nationalization": "national", "is": "is", "the": "the", "kindness": "kind"}
    got = dict(values(spark, [(w,) for w in want], F.col("c0"), text.stem("c0")))
    assert got == want


def test_match_level(spark):
    rows = [("rust", "rust"), ("transformers", "transformer"), ("kubernete", "kubernetes"), ("cat", "catalog"), ("日本", "日本語"), ("a", "b")]
    assert [r[0] for r in values(spark, rows, text.match_level("c0", "c1"))] == [2, 1, 1, 0, 1, 0]


def test_signature_and_jaccard(spark):
    rows = [("How to build the Maps", "building a map"), ("The", "the")]
    got = values(spark, rows, text.headline_signature("c0"), text.headline_signature("c1"), F.round(text.jaccard(F.split("c0", " "), F.split("c1", " ")), 3))
    assert got[0][0] == got[0][1] == "build map" and got[1][:2] == ("the", "the")


def test_urls(spark):
    rows = [("HTTPS://me:pw@Example.COM/a/b/?q=1#x",), ("example.com/a/",), ("ftp://example.com/a",), ("not a url",), ("file:///etc/passwd",), ("http://localhost/x",)]
    got = [r[0] for r in values(spark, rows, urls.normalize_url("c0"))]
    assert got == ["https://example.com/a/b", "https://example.com/a", None, None, None, None]
    rows = [("https://medium.com/@ada/my-first-post-0123abcd4567",), ("https://blog.example.com/p/Some-Title-deadbeef99",), ("https://medium.com/p/0123abcd4567",)]
    got = values(spark, rows, urls.slug_title("c0"), urls.author_of("c0"), urls.guess_title("c0"), urls.title_from_url("c0"))
    assert got[0] == ("My first post", "@ada", "My first post", "My first post")
    assert got[1][:2] == ("Some Title", "blog") and got[1][3] == "Some title"
    assert got[2][1] == ""


def test_doi_and_redirects(spark):
    rows = [("https://doi.org/10.1145/3292500.3330701).",), ("nothing",), ("DOI:10.1000/ABC;",)]
    assert [r[0] for r in values(spark, rows, urls.normalize_doi("c0"))] == ["10.1145/3292500.3330701", None, "10.1000/abc"]
    import base64
    seg = base64.urlsafe_b64encode(b"\x08\x13\x22https://news.google.com/x\x01https://pub.example.com/story\x02").decode().rstrip("=")
    rows = [("https://news.google.com/rss/articles/" + seg + "?oc=5",), ("https://news.google.com/rss/articles/!!",), ("https://pub.example.com/a",)]
    got = [r[0] for r in values(spark, rows, urls.resolve_redirect("c0"))]
    assert got == ["https://pub.example.com/story", rows[1][0], rows[2][0]]


def test_dates_and_scores(spark):
    rows = [("2024-01-31",), ("2023-06-05",), (None,), ("someday",), ("2030-01-01",)]
    got = values(spark, rows, F.round(scoring.freshness("c0", NOW), 4), F.round(scoring.trend_score(F.lit(100), "c0", NOW), 4))
    assert [g[0] for g in got] == [1.0, 0.5, 0.0, 0.0, 1.0]
    assert got[2][1] == got[3][1] == round(100 / 33**0.8, 4) and got[0][1] == got[4][1] == round(100 / 3**0.8, 4)
    rows = [("30d",), ("6W",), ("2 m",), ("1y",), ("2023",), ("2023-05",), ("2023-05-06",), ("soon",), ("9999999999d",)]
    got = [str(r[0]) for r in values(spark, rows, scoring.relative_day("c0", NOW))]
    assert got == ["2024-01-01", "2023-12-20", "2023-12-02", "2023-01-31", "2023-01-01", "2023-05-01", "2023-05-06", "None", "None"]


def test_hardened_casts(spark):
    rows = [("6.6",), ("Infinity",), ("NaN",), ("many",), ("1e300",), ("-7",), (None,)]
    assert [r[0] for r in values(spark, rows, scoring.whole("c0"))] == [7, 0, 0, 0, 0, -7, 0]
    rows = [("1700000000000",), ("-5",), ("1e30",), ("0",)]
    got = [str(r[0]) for r in values(spark, rows, scoring.moment("c0"))]
    assert got == ["2023-11-14 22:13:20", "None", "None", "None"]


def test_cleaning(spark):
    rows = [("<jats:p>A &amp;amp; B</jats:p> <b>c</b>",), ("&eacute;t&eacute; &lt;x&gt;",)]
    assert values(spark, rows, text.strip_jats("c0"))[0][0] == "A & B c"
    assert values(spark, rows, text.strip_jats("c0"))[1][0] == "été <x>"
    assert [r[0] for r in values(spark, [("a",), ("b",)], text.display_count(F.when(F.col("c0") == "a", 12_345).otherwise(1_250)))] == ["12k", "1,250"]


def test_numeric_entities(spark):
    rows = [("It&#8217;s", "It’s"), ("&#x1F600;&#233;", "😀é"), ("&#0;&#xD800;&#99999999;", "���"), ("&amp;#8217;", "&#8217;"), ("&#8217", "’"), (None, None)]
    got = spark.createDataFrame(rows, "c string, want string").select(text.unescape("c").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_references_match_the_standard(spark):
    """Every name, names without semicolon, longest beginnings, and numbers of all kinds, against the standard library."""
    import html
    import random
    from html.entities import html5

    rnd = random.Random(0)
    rows = [f"x&{n}y &{n[:-1] if n.endswith(';') else n};z" for n in html5]
    rows += [f"&#{n};a&#x{n:x}b" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**12, 233, 8364]]
    rows += ["&", "&&amp;", "&;", "&#;", "&#x;", "&notit; &notin; &copyright &COPY2 &amplified;", "&eacute;&euro;&EURO;", "a & b", "&\n&lt"]
    rows += ["".join(rnd.choice(["&", "am", "p", ";", "#", "x", "12", "lt", "no", "t", " ", "é"]) for _ in range(12)) for _ in range(500)]
    got = spark.createDataFrame([(r,) for r in rows], "c string").select("c", text.unescape("c").alias("got")).collect()
    assert [(r.c, r.got) for r in got if r.got != html.unescape(r.c)] == []


def test_words_of_all_scripts(spark):
    import random
    import re
    import unicodedata

    rnd = random.Random(1)
    chars = [chr(c) for c in range(0x20, 0x3100) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    chars += [chr(c) for r in ((0xAC00, 0xAC80), (0xD770, 0xD7A4), (0xF900, 0xFB10), (0xFF00, 0xFFE0), (0x1D400, 0x1D480), (0x2F800, 0x2F820)) for c in range(*r) if unicodedata.category(chr(c)) != "Cn"]
    rnd.shuffle(chars)
    rows = ["".join(c + rnd.choice(["", "a", " "]) for c in chars[i : i + 40]) for i in range(0, len(chars), 40)]
    rows += ["Ångström ﬁne ½ ①", "Ελλάς άλφα", "Ёлка Й", "한글 각", "ｆｕｌｌ", "𝐀bc", "e\u0301a"]

    def plain(t):
        t = unicodedata.normalize("NFKD", t.lower())
        return "".join(c for c in t if not unicodedata.combining(c))

    got = spark.createDataFrame([(r,) for r in rows], "c string").select("c", text.fold("c").alias("got"), text.words("c").alias("w")).collect()
    # the JVM and Python may know different versions of Unicode, and lower a final sigma alike
    bad = [(r.c, r.got, plain(r.c)) for r in got if r.got != plain(r.c)]
    assert len(bad) <= 2, bad[:3]
    by = {r.c: r.w for r in got}
    assert by["한글 각"] == [unicodedata.normalize("NFKD", w) for w in ("한글", "각")] and by["Ёлка Й"] == ["елка", "и"] and by["Ångström ﬁne ½ ①"][:2] == ["angstrom", "fine"]
    assert all(re.fullmatch(r"[^\W_]+", w) for ws in by.values() for w in ws if w.isascii())


def test_quotes_without_letters(spark):
    docs = spark.createDataFrame([(1, "wait --- what?"), (2, "plain words"), (3, "a -- b")], "doc_id int, text string")
    quotes = spark.createDataFrame([("q", "---"), ("r", "--"), ("s", ""), ("t", "lain w")], "quote_id string, quote string")
    got = {(r.quote_id, r.doc_id) for r in textjobs.contained_quotes(quotes, docs).collect()}
    assert got == {("q", 1), ("r", 1), ("r", 3), ("t", 2)}


def test_rules_of_any_length(spark):
    tree = spark.createDataFrame([("x", "s", ["one-two-three-four-five-six-seven"])], "topic string, subtopic string, tags array<string>")
    posts = spark.createDataFrame([(1, "zero one two three four five six seven eight"), (2, "one two three four five six")], "post_id int, title string")
    assert [r.post_id for r in classify.match_titles(posts, classify.build_rules(tree)).collect()] == [1]


def test_stems_are_compared_only_for_words_that_begin_alike(spark):
    words = ["", "a", "an", "as", "run", "running", "runs", "rune", "stop", "stopped", "parties", "party", "tried", "try", "class", "classes", "bus", "buses", "größe", "größer"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    same = df.select((text.stem("a") == text.stem("b")).alias("s"), text.match_level("a", "b").alias("l"), (F.col("a") == F.col("b")).alias("e")).collect()
    assert all(r.l == 2 if r.e else r.l == 1 if r.s else r.l in (0, 1) for r in same) and sum(r.s and not r.e for r in same) > 10
    plan = df.select(text.match_level("a", "b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(substring(a#" in plan and plan.index("(substring(a#") < plan.index("regexp_extract")
