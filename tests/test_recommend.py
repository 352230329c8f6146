import datetime as dt
import math
import random

from pyspark.sql import functions as F

import models
from folioscope.functions import fixed
from folioscope.operators import recommend, search, taste

NOW = "2024-01-31 00:00:00"
TODAY = dt.date(2024, 1, 31)
SHORT = dict(zip("abcdefgh", ["rust", "chip", "grid", "moon", "bank", "cell", "wave", "port"]))


def fixture(seed):
    rnd = random.Random(seed)
    words = list(SHORT.values())
    posts = []
    for i in range(70):
        cached = rnd.random() < 0.6
        tags = rnd.sample(["t1", "t2", "t3", "t4", "ai"], rnd.randint(0, 3)) if cached else []
        home = rnd.choice([None, ("x", "s1"), ("x", "s2")]) if cached else ("x", rnd.choice(["s1", "s2", "s3"]))
        posts.append({
            "url": f"u{i:02d}", "title": " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))), "author": rnd.choice(["A", "B", "C", ""]),
            "published": TODAY - dt.timedelta(days=rnd.randint(0, 300)), "claps": rnd.randint(0, 900) if cached else None,
            "prio": rnd.choice([0.2, 0.5, 0.8]), "cached": cached, "home": home,
            "labels": sorted(set(tags) | ({"/".join(home)} if home else set()))})
    readers = {}
    for r in range(4):
        readers[r] = {
            "label": {k: rnd.uniform(0.1, 3) for k in rnd.sample(["t1", "t2", "ai", "x/s1", "x/s2", "zz"], rnd.randint(0, 4))},
            "word": {k: rnd.uniform(0.1, 3) for k in rnd.sample(words, rnd.randint(1, 3))},
            "author": {k: rnd.uniform(0.1, 3) for k in rnd.sample("AB", rnd.randint(0, 2))},
            "dislike": {k: 1.0 for k in rnd.sample(["t3", "t4"], rnd.randint(0, 2))},
            "known": {f"u{i:02d}" for i in rnd.sample(range(70), rnd.randint(0, 12))}}
    return posts, readers


def cosine(a, b):
    na, nb = (math.sqrt(sum(v * v for v in x.values())) for x in (a, b))
    return sum(v * b[k] for k, v in a.items() if k in b) / (na * nb) if na and nb else 0.0


def brute(posts, me):
    n = len(posts)
    df = {}
    for p in posts:
        for l in p["labels"]:
            df[l] = df.get(l, 0) + 1
    idf = {l: math.log((n + 1) / (c + 1)) + 1 for l, c in df.items()}

    def trend(p):
        return (p["claps"] or 0) / ((TODAY - p["published"]).days + 3) ** 0.8

    top = max(math.log1p(trend(p)) for p in posts if p["cached"])
    liked = {k: v * idf.get(k, 1.0) for k, v in me["label"].items()}
    out = []
    for p in posts:
        if p["url"] in me["known"]:
            continue
        lvec = {l: idf[l] for l in p["labels"]}
        tf = {}
        for w in p["title"].split():
            tf[w] = tf.get(w, 0) + 1
        label, word = cosine(liked, lvec), cosine(me["word"], tf)
        author = me["author"].get(p["author"], 0) / max(me["author"].values(), default=1)
        quality = math.log1p(trend(p)) / top if p["cached"] else 0.6 * (p["prio"] - 0.1) / 0.9
        fresh = 0.5 ** ((TODAY - p["published"]).days / 240)
        bad = cosine({k: v * idf.get(k, 1.0) for k, v in me["dislike"].items()}, lvec)
        score = label + 0.7 * word + 0.25 * author + 0.35 * min(1, quality) + 0.3 * fresh + (0.05 if p["cached"] else 0) - 0.8 * bad
        shared = (set(p["labels"]) & set(liked)) - set(fixed.GENERIC_LABELS)
        out.append(dict(p, score=round(score, 4), affinity=max(label, word), tags=[l for l in shared if "/" not in l]))
    return sorted(out, key=lambda p: (-p["score"], p["url"]))


def shaped(scored, limit):
    def vary(rows, group):
        marks = [(i, group(p), " ".join(sorted(set(p["title"].split())))) for i, p in enumerate(rows)]
        keep = set()
        for n in range(len(marks)):  # the only set of the first n + 1 rows that is diverse, with or without the last
            keep = next(k for k in ({*keep, n}, keep) if models.is_diverse(marks[: n + 1], k, 2))
        return [p for i, p in enumerate(rows) if i in keep] + [p for i, p in enumerate(rows) if i not in keep]

    edge = [p for p in scored if p["cached"] and p["home"] and not p["tags"]][: limit // 7]
    spent = {p["url"] for p in edge}
    rest = vary([p for p in scored if p["affinity"] > 0 and p["url"] not in spent], lambda p: p["author"])
    fresh = vary([p for p in rest if not p["cached"]], lambda p: p["home"] and p["home"][1])
    return models.page([p["url"] for p in rest if p["cached"]], [p["url"] for p in fresh], [p["url"] for p in edge], limit)


def test_scores_and_pages_match_brute_force(spark):
    for seed in (1, 2):
        posts, readers = fixture(seed)
        pool = spark.createDataFrame(
            [(p["url"], p["title"], p["author"], p["published"], p["claps"], p["prio"], p["cached"], p["labels"], *(p["home"] or (None, None))) for p in posts],
            "url string, title string, author string, published date, claps bigint, prio double, cached boolean, labels array<string>, home_topic string, home_subtopic string")
        weights = spark.createDataFrame([(r, k, key, w) for r, me in readers.items() for k in ("label", "word", "author", "dislike") for key, w in me[k].items()],
                                        "reader int, kind string, key string, weight double")
        known = spark.createDataFrame([(r, u) for r, me in readers.items() for u in me["known"]], "reader int, url string")
        who = spark.createDataFrame([(r,) for r in readers], "reader int")
        scored = recommend.score_pairs(weights, pool, NOW, known=known)
        got = {(r.reader, r.url): r.score for r in scored.collect()}
        want = {r: brute(posts, me) for r, me in readers.items()}
        for r, rows in want.items():
            for p in rows:
                if (r, p["url"]) in got:
                    assert abs(got[(r, p["url"])] - p["score"]) < 2e-4
                else:
                    assert p["affinity"] == 0
        for k in (1, 4, 20):
            best = recommend.best_pairs(weights, pool, NOW, k, known=known, strong=2)
            want_best = recommend.top_per_key(scored, ["reader"], [F.desc("score"), F.asc("url")], k)
            assert {(x.reader, x.url, x.score, x["rank"]) for x in best.collect()} == {(x.reader, x.url, x.score, x["rank"]) for x in want_best.collect()}
        limit = 28
        page = {}
        for x in recommend.shape(scored, pool, who, NOW, limit=limit, known=known).orderBy("reader", "slot").collect():
            page.setdefault(x.reader, []).append(x.url)
        for r, rows in want.items():
            assert page.get(r, []) == shaped(rows, limit), (seed, r)


def test_best_pairs_leave_long_lists_alone(spark, monkeypatch):
    """Common keys can't lift a post into the best few: most pairs that share something are never built."""
    rnd = random.Random(9)
    posts = []
    for i in range(3000):
        rare = f"rare{rnd.randrange(300)}"
        posts.append((f"u{i:04d}", f"{rare} common {rnd.choice(['usual', 'plain'])}", f"a{i % 40}", TODAY - dt.timedelta(days=rnd.randint(0, 40)),
                      rnd.randint(0, 50), 0.5, True, [rare, "everywhere"], None, None))
    pool = spark.createDataFrame(posts, "url string, title string, author string, published date, claps bigint, prio double, cached boolean, labels array<string>, home_topic string, home_subtopic string")
    rows = [(r, kind, key, w) for r in range(20) for kind, key, w in (
        [("label", f"rare{(r * 7 + j) % 300}", 2.0) for j in range(4)] + [("word", f"rare{(r * 7 + j) % 300}", 2.0) for j in range(4)]
        + [("label", "everywhere", 0.3), ("word", "common", 0.3), ("author", f"a{r}", 1.0)])]
    weights = spark.createDataFrame(rows, "reader int, kind string, key string, weight double")
    sizes, real = [], recommend.stage

    def counted(df, name="stage"):
        out = real(df, name)
        if name == "candidates":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(recommend, "stage", counted)
    got = recommend.best_pairs(weights, pool, NOW, 10).select("reader", "url", "score", "rank").collect()
    every = recommend.score_pairs(weights, pool, NOW)
    assert every.count() == 20 * 3000
    want = recommend.top_per_key(every, ["reader"], [F.desc("score"), F.asc("url")], 10).select("reader", "url", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(sizes) < 20 * 3000 / 10


def test_cold_reader_gets_the_tree(spark):
    engaged = spark.createDataFrame([(1, 7, "u", "Rust rules", "Ada", "x", "s", ["rust"], 1.5)],
                                    "reader int, doc_id int, url string, title string, author string, topic string, subtopic string, tags array<string>, weight double")
    dismissed = spark.createDataFrame([(1, "v", "Rust again", ["crypto"])], "reader int, url string, title string, tags array<string>")
    tree = spark.createDataFrame([("x", "s", ["rust", "Go Lang"])], "topic string, subtopic string, tags array<string>")
    p = taste.profile(engaged, dismissed, tree)
    got = {(r.kind, r.key): round(r.weight, 3) for r in p.weights.collect()}
    assert got == {("label", "rust"): 2.0, ("label", "go-lang"): 0.5, ("label", "x/s"): 2.0, ("word", "rust"): 1.1, ("word", "rul"): 1.5,
                   ("author", "Ada"): 1.5, ("dislike", "crypto"): 1.0}
    assert p.readers.first().cold


def test_search_prefers_the_readers_words(spark):
    posts = spark.createDataFrame(
        [(1, "https://a.org/1", "python snakes in the wild", "z", dt.date(2024, 1, 1), 0.5), (2, "https://a.org/2", "python code in the cloud", "y", dt.date(2024, 1, 1), 0.5),
         (3, "https://a.org/3", "gardens", "x", dt.date(2024, 1, 1), 0.5)], "post_id int, url string, title string, author string, day date, prio double")
    none = "array<string>"
    q = spark.createDataFrame([("q", ["python"], [], [], [], None, None, None)],
                              f"query_id string, terms {none}, soft {none}, phrases array<{none}>, exclude {none}, author string, since date, before date")
    ix = search.build_index(posts)
    plain = [r.post_id for r in search.search(q, ix, NOW).orderBy("position").collect()]
    assert sorted(plain) == [1, 2]
    for stem, first in (("snak", 1), ("code", 2)):
        prior = spark.createDataFrame([("q", stem, 2.0)], "query_id string, word string, weight double")
        rows = search.search(q, ix, NOW, prior=prior).orderBy("position").collect()
        assert rows[0].post_id == first and rows[0].yours


def test_readers_meet_posts_by_blocks(spark, monkeypatch):
    """Pairs are scored where the block is and never shuffled; the same as pair by pair, whatever the number of blocks and lanes."""
    posts, readers = fixture(3)
    pool = spark.createDataFrame(
        [(p["url"], p["title"], p["author"], p["published"], p["claps"], p["prio"], p["cached"], p["labels"], *(p["home"] or (None, None))) for p in posts],
        "url string, title string, author string, published date, claps bigint, prio double, cached boolean, labels array<string>, home_topic string, home_subtopic string")
    weights = spark.createDataFrame([(r, k, key, w) for r, me in readers.items() for k in ("label", "word", "author", "dislike") for key, w in me[k].items()],
                                    "reader int, kind string, key string, weight double")
    known = spark.createDataFrame([(r, u) for r, me in readers.items() for u in me["known"]], "reader int, url string")
    monkeypatch.setattr(recommend.blocks, "POSTS", 20)
    monkeypatch.setattr(recommend.blocks, "PAIRS", 30)
    met = recommend.score_pairs(weights, pool, NOW, known=known, columns=[*recommend.COLUMNS, "n_tags", "because_words"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
    got = {(x.reader, x.url): x for x in met.collect()}
    every = weights.select("reader").distinct().crossJoin(pool.select("url"))
    single = recommend.score_pairs(weights, pool, NOW, known=known, only=every)
    want = {(x.reader, x.url): x for x in single.collect()}
    assert got.keys() == want.keys() and len(want) > 100
    for at, x in want.items():
        y = got[at]
        assert all(x[c] == y[c] for c in ("title", "author", "cached", "home_topic", "home_subtopic", "shared", "tags_shared")) and y.n_tags == len(x.tags_shared)
        assert all(abs(x[c] - y[c]) < 2e-4 for c in ("base", "label_sim", "word_sim", "author_share", "dislike", "score", "affinity"))
    bare = single.filter(F.size("tags_shared") == 0).select("reader", "url", "title")
    why = {(x.reader, x.url): x.because_words for x in recommend.why_words(bare, weights, ["reader", "url"]).collect()}
    assert why and why == {at: x.because_words for at, x in got.items() if x.because_words}


def test_pages_are_made_from_few_pairs(spark, monkeypatch):
    """The pages of ``page_pairs`` are those of all pairs, also where lists are cut too early at first; pairs are few."""
    rnd = random.Random(4)
    names = [f"w{a}{b}" for a in "bcdfg" for b in "klmnp"]
    posts = []
    for i in range(500):
        cached = rnd.random() < 0.6
        home = rnd.choice([(None, None), ("x", "s1"), ("x", "s2")]) if cached else rnd.choice([(None, None), ("x", "s1"), ("x", "s3")])
        labels = rnd.sample(["t1", "t2", "t3", "ai"], rnd.randint(0, 3)) if cached else []
        posts.append((f"u{i:03d}", " ".join(rnd.choice(names[:rnd.choice([3, 25])]) for _ in range(rnd.randint(1, 3))), rnd.choice(["A", "B", "C", "D", None if i % 9 == 0 else "E"]),
                      TODAY - dt.timedelta(days=rnd.randint(0, 3)), rnd.randint(0, 9) if cached else None, 0.5, cached, labels + (["/".join(home)] if home[0] else []), *home))
    pool = spark.createDataFrame(posts, "url string, title string, author string, published date, claps bigint, prio double, cached boolean, labels array<string>, home_topic string, home_subtopic string")
    rows = [(r, kind, key, float(rnd.randint(1, 3))) for r in range(6) for kind, keys, n in (("label", ["t1", "t2", "x/s1"], r % 3), ("word", names, 3 + 2 * r), ("author", "AB", 1), ("dislike", ["t3"], r % 2))
            for key in rnd.sample(keys, n)]
    weights = spark.createDataFrame(rows, "reader int, kind string, key string, weight double")
    known = spark.createDataFrame([(r, f"u{i:03d}") for r in range(6) for i in rnd.sample(range(500), 40)], "reader int, url string")
    who = spark.createDataFrame([(r,) for r in range(8)], "reader int")
    monkeypatch.setattr(recommend.blocks, "POSTS", 250)
    monkeypatch.setattr(recommend.blocks, "READERS", 3)
    scored = recommend.score_pairs(weights, pool, NOW, known=known)
    depths, real = [], recommend._met
    monkeypatch.setattr(recommend, "DEPTH", 1)
    monkeypatch.setattr(recommend, "_met", lambda *a, **k: depths.append(k["page"][1]) or real(*a, **k))
    few = recommend.page_pairs(weights, pool, who, NOW, limit=28, known=known)
    assert len(depths) > 1
    monkeypatch.setattr(recommend, "_met", real)
    scored = recommend.score_pairs(weights, pool, NOW, known=known)
    got, want = (
        sorted(map(tuple, recommend.shape(rows, pool, who, NOW, limit=28, known=known).select("reader", "slot", "url", "kind", "score").collect()))
        for rows in (few, scored))
    assert got == want and len({r[0] for r in want}) == 8
    assert few.count() < scored.count()
