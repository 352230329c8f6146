import random

from pyspark.sql import functions as F

import models
from folioscope.operators import briefing, curate, ranking, recommend


def test_full_rank_of_hot_and_small_keys(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", rnd.randrange(50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {(r.k, r.i): r.rank for r in ranking.full_rank(df, ["k"], ["-v", "i"], parts=5).collect()}
    for key in {k for k, _, _ in rows}:
        order = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[(key, r[2])] for r in order] == list(range(1, len(order) + 1))


def test_top_per_key_with_large_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    got = ranking.top_per_key(df, ["k"], [F.desc("id")], 1200)
    assert got.count() == 2400 and got.agg(F.min("id")).first()[0] == 5000 - 2400


def test_diversify_is_diverse(spark):
    rnd = random.Random(7)
    lists = {}
    for n in range(60):
        size = rnd.randint(1, 40)
        lists[n] = [(r, rnd.choice(["", "a", "b", "c", "d"]), rnd.choice("uvwxyz")) for r in range(1, size + 1)]
    rows = [(n, *r) for n, rs in lists.items() for r in rs]
    df = spark.createDataFrame(rows, "l int, rank int, g string, s string")
    for fn in (ranking.diversify, ranking.diversify_bounded):
        kept = {}
        for r in fn(df, "l", "rank", "g", "s", 2).filter("kept").collect():
            kept.setdefault(r.l, set()).add(r["rank"])
        for n, rs in lists.items():
            assert models.is_diverse(rs, kept.get(n, set()), 2), (fn.__name__, n)


def test_leader_cluster_matches_the_walk(spark):
    rnd = random.Random(3)
    vocab = [f"w{i:02d}" for i in range(30)]
    titles = {}
    for e in range(12):
        base = [rnd.sample(vocab, rnd.randint(1, 12)) for _ in range(6)]
        rows = []
        for _ in range(40):
            words = list(rnd.choice(base))
            if rnd.random() < 0.7 and len(words) > 2:
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append(set(words))
        rows.append(set())
        titles[e] = rows
    df = spark.createDataFrame(
        [(e, i, " ".join(sorted(w))) for e, rows in titles.items() for i, w in enumerate(rows, 1)], "edition int, rank int, title string")
    got = {(r.edition, r["rank"]): r.leader for r in briefing.leader_cluster(df).collect()}
    for e, rows in titles.items():
        want = models.cluster(rows, 0.55)
        assert {r: got[(e, r)] for r in want} == want


def test_leader_cluster_of_long_word_lists(spark):
    rnd = random.Random(5)
    vocab = [f"x{i:03d}" for i in range(400)]
    rows = []
    for n in (18, 30, 45, 60, 90):
        base = rnd.sample(vocab, n)
        for drop in range(0, n, max(1, n // 6)):
            rows.append(set(base[drop:]) | set(rnd.sample(vocab, drop // 3)))
    rnd.shuffle(rows)
    df = spark.createDataFrame([(0, i, " ".join(sorted(w))) for i, w in enumerate(rows, 1)], "edition int, rank int, title string")
    got = {r["rank"]: r.leader for r in briefing.leader_cluster(df).collect()}
    assert got == models.cluster(rows, 0.55)


def test_long_chains_need_few_rounds(spark, monkeypatch):
    """A chain in which each headline is close to the next alone: rounds are bounded, the rest is walked once."""
    chain = [" ".join(f"w{i + j:03d}" for j in range(8)) for i in range(0, 80, 2)]  # neighbours share six of ten words
    rows = [(0, i, t) for i, t in enumerate(chain, 1)] + [(1, i, t) for i, t in enumerate(reversed(chain), 1)] + [(2, 1, "alone here"), (3, 1, "")]
    df = spark.createDataFrame(rows, "edition int, rank int, title string")
    stages, real = [], briefing.stage
    monkeypatch.setattr(briefing, "stage", lambda d, name="stage": (stages.append(name), real(d, name))[1])
    got = {(r.edition, r["rank"]): r.leader for r in briefing.leader_cluster(df, rounds=3).collect()}
    assert stages.count("open") == 3
    for e, titles in ((0, chain), (1, chain[::-1])):
        want = models.cluster([set(t.split()) for t in titles], 0.55)
        assert len(set(want.values())) == 20 and {r: got[(e, r)] for r in want} == want
    assert got[(2, 1)] == 1 and got[(3, 1)] == 1


def test_diversify_walks_what_waits_long(spark):
    """One owner after another blocks the next signature: a chain longer than the rounds."""
    rnd = random.Random(6)
    rows = []
    for lst in range(3):
        for i in range(60):
            rows += [(lst, 2 * i + 1, f"o{i}", f"s{i}"), (lst, 2 * i + 2, f"o{i}", f"s{i + 1}")]
    rows += [(7, i, rnd.choice(["a", "b", "", None]), rnd.choice("xyzuvw")) for i in range(200)]
    df = spark.createDataFrame(rows, "lst int, rank int, grp string, sig string")
    for fn in (ranking.diversify, ranking.diversify_bounded):
        got = {(r.lst, r["rank"]) for r in fn(df, "lst", "rank", "grp", "sig", 1).filter("kept").collect()}
        for lst in (0, 7):
            own = sorted((r, g or "", s) for x, r, g, s in rows if x == lst)
            assert models.is_diverse(own, {r for x, r in got if x == lst}, 1)


def test_diverse_pick_matches_the_walk(spark):
    rnd = random.Random(11)
    items = []
    for e in range(15):
        for r in range(1, rnd.randint(3, 60)):
            items.append({"edition": e, "rank": r, "score": round(10 - r * 0.07 - rnd.random() / 50, 4), "category": rnd.choice("abc"),
                          "publisher": rnd.choice(["P", "p", "Q", "R", "S"]), "leader": rnd.randint(1, 25)})
    df = spark.createDataFrame(items, "edition int, rank int, score double, category string, publisher string, leader int")
    got = {}
    for r in briefing.diverse_pick(df).orderBy("edition", "pick").collect():
        got.setdefault(r.edition, []).append(r["rank"])
    for e in range(15):
        mine = sorted((i for i in items if i["edition"] == e), key=lambda i: i["rank"])
        assert got.get(e, []) == models.picks(mine, 10), e


def test_page_slots(spark):
    rnd = random.Random(2)
    sets, rows = {}, {"k": [], "f": [], "x": []}
    for reader in range(60):
        sets[reader] = {k: [f"{k}{i}" for i in range(rnd.randint(0, n))] for k, n in (("k", 70), ("f", 25), ("x", 9))}
        for k, urls in sets[reader].items():
            rows[k] += [(reader, u, 0.0, i) for i, u in enumerate(urls)]
    limit = 60
    keep = {"k": limit, "f": int(limit * 0.3), "x": limit // 7}
    df = {k: spark.createDataFrame([r for r in v if r[3] < keep[k]], "reader int, url string, score double, i bigint") for k, v in rows.items()}
    got = {}
    for r in recommend.place_slots(df["k"], df["f"], df["x"], limit).orderBy("reader", "slot").collect():
        got.setdefault(r.reader, []).append(r.url)
    for reader, s in sets.items():
        want = models.page(s["k"], s["f"][: keep["f"]], s["x"][: keep["x"]], limit)
        assert got.get(reader, []) == want, reader


def test_rotation_counts(spark):
    rnd = random.Random(4)
    good, old, caps, want = [], [], [], {}
    for n in range(40):
        key = ("t", f"s{n:02d}")
        cands = sorted((rnd.randint(1, 4000) for _ in range(rnd.randint(0, 12))), reverse=True)
        res = [rnd.randint(1, 4000) for _ in range(rnd.randint(0, 8))]
        filling, cap = rnd.random() < 0.5, len(res) + rnd.randint(0, 4)
        good += [(*key, f"c{n}-{i}", float(c)) for i, c in enumerate(cands)]
        old += [(*key, f"r{n}-{i}", f"o{n}-{i}", "auto", None, c * 40, None) for i, c in enumerate(res)]
        caps.append((*key, len(res), cap, filling))
        want[key] = ([float(c) for c in cands], [c * 40 / 33**0.8 for c in res], cap - len(res), filling)
    good_df = spark.createDataFrame(good, "topic string, subtopic string, url string, trend double")
    old_df = spark.createDataFrame(old, "topic string, subtopic string, id string, url string, source string, pdf string, claps bigint, published date")
    caps_df = spark.createDataFrame(caps, "topic string, subtopic string, n bigint, cap bigint, filling boolean")
    plan = curate.curate_plan(good_df, old_df, caps_df, "2024-01-31 00:00:00")
    got = {(r.topic, r.subtopic): (r.a, r.s) for r in plan.groupBy("topic", "subtopic").agg(
        F.count_if(F.col("action") == "add").alias("a"), F.count_if(F.col("action") == "rotate in").alias("s")).collect()}
    for key, given in want.items():
        assert models.fits_rotation(*given, *got.get(key, (0, 0))), key


def test_fair_share_counts(spark):
    rows = [("big" if i % 3 else f"k{i % 5}", i % 11, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = ranking.fair_share(df, "k", ["-v", "i"], 120)
    assert got.count() == 120
    per_key = dict(got.filter("phase = 'share'").groupBy("k").count().collect())
    assert set(per_key.values()) == {120 // len({r[0] for r in rows})}
    try:
        ranking.fair_share(df, "k", ["-v", "i"], 601)
        raise AssertionError("a request beyond the rows must fail")
    except ValueError:
        pass
