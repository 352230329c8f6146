"""Quality rules, personal data, chat formats, licenses and decontamination."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioscope.llm import op2_pii as pii
from folioscope.llm import op3_quality as quality
from folioscope.llm import op6_decontaminate as bench
from folioscope.llm import op8_chat as chat
from folioscope.llm import op10_licenses as lic

SF = "/root/testdata/sf0.001"


def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def counts(t):
    w, t = split(t), t or ""
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(wins)
    hit = {i + k for i, x in enumerate(wins) if many[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, docs, odd):
    more = [(-1, "a b c a b c a b c d e f d e f"), (-2, "a\na\n\nb\na")]
    both = docs([*texts(spark), *more]).unionByName(odd)
    for r in quality.judge(both).collect():
        want = counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
        assert r["kept"] == (r["failed_rule"] is None)


def test_quality_order_does_not_change_verdict(spark, docs):
    rows = quality.measured(docs(texts(spark)))
    one = rows.withColumn("f", quality.cascade(quality.RULES)).withColumn("g", quality.cascade(quality.RULES[::-1]))
    assert one.filter(F.col("f").isNull() != F.col("g").isNull()).count() == 0
    assert quality.order_rules(docs([]))[0][1] == 0
    assert quality.judge(docs([])).collect() == []


def test_quality_rules_reject_junk(docs):
    prose = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} stands" for i in range(60))
    rows = [(1, prose), (2, prose.upper()), (3, " | ".join(prose.split())), (4, "!! ".join(prose.split())), (5, " ".join(f"{i} {i}a" for i in range(80)))]
    kept = {r["doc_id"]: r["failed_rule"] for r in quality.judge(docs(rows)).collect()}
    assert kept[1] is None and kept[2] == "capitals" and kept[4] == "marks" and all(kept[k] for k in (3, 5))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for no, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


TRICKY = [
    "a@b.cd@e.fg x_a@b.c_x@d.e ü@ä.de é a@b.c", "1.2.3.4.5 0256.1.1.1 00001.2.3.4 300.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112",
    "+1 (513) 555-8655 +49 30 123456 +1+2 555 123 4567 +123456789012345678", "x+1.1.1.1 1 2 3 +", "😀 mail me: joe@x.org 😀 +1 555 555 5555", "4111 1111  1111 1111", "@@ . + - 1",
]


def test_pii_base_equals_regex(spark, docs, odd):
    rows = [*texts(spark), *[(-i - 1, t) for i, t in enumerate(TRICKY)]]
    both = docs(rows).unionByName(odd.filter("doc_id NOT IN (1000009, 1000010) OR doc_id IS NULL"))
    source = {r["doc_id"]: r["text"] for r in both.collect()}
    out = pii.find(both).collect()
    assert len(out) == both.count()
    for r in out:
        if r["doc_id"] is not None:
            assert [(s["start"], s["kind_no"] - 1, s["end"], s["kind"]) for s in r["spans"] if s["base"]] == base_spans(source[r["doc_id"]])


def test_pii_long_runs(docs):
    rows = [(1, "9" * 50_000), (2, "x" * 60_000), (3, "1." * 30_000), (4, "a@" * 20_000), (5, "+1 " * 20_000), (6, "1 " * 30_000)]
    assert len(pii.find(docs(rows)).collect()) == 6


def test_pii_adds_spans_and_redacts(docs):
    rows = [(i, f"please call +1 ({200 + i}) 555-{1000 + i} today, ref {10_000_000_000 + i} v 2024-01-{10 + i % 20} id{i}x") for i in range(300)]
    rows += [(i, f"card {4111111111111111 + i} at ip 10.0.{i}.1") for i in range(300, 600)]
    rows += [(1000, "please call (513) 555-8655 today"), (1001, "nothing here"), (1002, None)]
    out = {r["doc_id"]: r for r in pii.find(docs(rows)).collect()}
    assert [s["kind"] for s in out[1000]["spans"]] == ["phone"] and not out[1000]["spans"][0]["base"]
    assert out[1001]["spans"] == [] and all(len(out[i]["spans"]) == 1 for i in range(300))
    clean = {r["doc_id"]: r for r in pii.redact(docs(rows)).collect()}
    assert clean[1000]["text"] == "please call [PHONE] today" and clean[1002]["text"] is None and clean[1001]["text"] == "nothing here"
    assert clean[5]["text"] == "please call [PHONE] today, ref 10000000005 v 2024-01-15 id5x" and clean[5]["row"] == "x"


def test_pii_finds_numbers_beside_other_digits(docs):
    rows = [(i, f"please call +1 ({200 + i}) 555-{1000 + i} today, ref {10_000_000_000 + i} v 2024-01-{10 + i % 20} id{i}x") for i in range(300)]
    rows += [(i, f"card {4111111111111111 + i} at ip 10.0.{i}.1") for i in range(300, 600)]
    own = ["call 555-123-4567 555-987-6543 now", "card 4111 1111 1111 1111 12/25 ok", "phone +1 513 555 8655 2024-01-12 ok"]
    rows += list(enumerate(own, 1000))
    out = {r["doc_id"]: [(own[r["doc_id"] - 1000][s["start"] : s["end"]], s["kind"]) for s in r["spans"]] for r in pii.find(docs(rows)).collect() if r["doc_id"] >= 1000}
    assert out[1000] == [("555-123-4567", "phone"), ("555-987-6543", "phone")]
    assert out[1001] == [("4111 1111 1111 1111", "card")]
    assert out[1002] == [("+1 513 555 8655", "phone")]


def test_pii_parts_equal_brute_force(docs):
    texts = ["a 12-34 (56) 78.90/12 34 x", "(513) 555-8655", "+1 513 555 8655 2024-01-12", "12345678 1 22 333 4444", "no", "1 " * 60, "9" * 40 + " 1234567", "7. 8-9"]
    got = {}
    for r in pii.spans_of(pii.candidates(docs(list(enumerate(texts))))).filter("source = 'part'").collect():
        t = texts[r["doc_id"]]
        assert t[r["start"] : r["end"]] == r["match"] and r["label"] is None
        assert t[: r["start"]].endswith(r["before"]) and t[r["end"] :].startswith(r["after"])
        got.setdefault(r["doc_id"], set()).add((r["start"], r["end"]))
    for i, t in enumerate(texts):
        want = set()
        for run in re.finditer(r"[+(]?[0-9](?:[ ()./-]{0,2}[0-9])+", t):
            groups = [(m.start() + run.start(), m.end() + run.start()) for m in re.finditer("[0-9]+", run[0])]
            for a, x in enumerate(groups):
                for y in groups[a:]:
                    start = run.start() if a == 0 else x[0] - (t[x[0] - 1] == "(")
                    if 7 <= len(re.sub("[^0-9]", "", t[start : y[1]])) <= 19 and (start, y[1]) != run.span():
                        want.add((start, y[1]))
        assert got.get(i, set()) == want, t


def test_pii_empty(docs):
    assert pii.find(docs([])).collect() == []
    assert pii.redact(docs([])).collect() == []


def test_chat_round_trip(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "a\\<|b", "\\", "<\\|", "\\\\<|", "", None, "line\nfeed\n", "<|im_next|>", "ünï 😀"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant"] * 5, tricky))]
    rows += [(2, 1, "assistant", "b"), (2, 0, "assistant", "a"), (2, 2, "user", "c"), (2, 2, "assistant", "c"), (2, 2, "user", "c")]
    rows += [(3, 0, None, "x"), (3, None, "a\nb\\n", "y"), (None, 0, "assistant", "n"), (4, 0, "<|im_end|>\n", "z")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, nth string")
    out = chat.format_chats(turns).select(
        "*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    first = lambda x: (x is not None, x)
    for r in out:
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (first(x[1]), x[2] or "", x[3] or ""))
        assert [(b["role"], b["text"]) for b in r["back"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert {r["conv_id"]: r["formatted"] for r in out}[2] == (
        "<|im_start|>assistant\na<|im_next|>b<|im_next|>c<|im_end|>\n<|im_start|>user\nc<|im_next|>c<|im_end|>\n")
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_chat_long_conversation(spark):
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("hi <|").alias("text"))
    r = chat.format_chats(turns).select(F.size(chat.read_turns(F.col("formatted"))).alias("n")).first()
    assert r["n"] == 20_000


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_license_base(spark, docs, odd):
    more = [(-1, "MIT License MIT license, mit-license CC BY CC BY"), (-2, "the GNU General Public License v3"), (-3, "gnu general license"),
            (-4, "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files.")]
    both = docs([*texts(spark), *more]).unionByName(odd)
    out = lic.scan(both).collect()
    assert len(out) == both.count()
    source = {r["doc_id"]: r["text"] for r in both.collect()}
    for r in out:
        if r["doc_id"] is None:
            continue
        w = words(source[r["doc_id"]])
        at = [(i, label) for p, label in lic.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in out}
    assert by[-4]["labels"] == "mit-text" and by[-1]["n_base"] == 5
    assert lic.scan(docs([])).collect() == []


def test_decontaminate_equals_brute_force(spark, docs, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    own = [(r["item_id"], r["text"]) for r in items.collect()] + [(1001, "Short item here"), (1002, None), (1003, "..."), (1004, "plain words stand here")]
    first = own[0][1]
    more = [(-1, f"before, {first} after {first}"), (-2, "a short, item HERE and short item here"), (-3, " ".join(words(first)[:9])), (-4, " ".join(words(first)[3:14]))]
    both = docs([*texts(spark), *more]).unionByName(odd)
    table = spark.createDataFrame([(i, t, 1) for i, t in own], "item_id long, text string, doc_id long")
    out = bench.decontaminate(both, table).collect()
    assert len(out) == both.count()
    source = {r["doc_id"]: r["text"] for r in both.collect()}
    wins = {}
    for i, t in own:
        w = words(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    for r in out:
        if r["doc_id"] is None:
            continue
        w, hit, names = words(source[r["doc_id"]]), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if found := wins.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    names |= found
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(names), bool(hit))
    assert bench.decontaminate(docs([]), table).collect() == []
    assert bench.decontaminate(docs([(1, "a b")]), table.limit(0)).first()["contaminated"] is False


def test_decontaminate_near(docs, spark):
    item = "one two three four five six seven eight nine ten"
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (2, item.replace("five", "five and")), (3, "ten one"), (4, item.replace("five ", ""))]
    out = {r["doc_id"]: r for r in bench.decontaminate(docs(rows), table, slack=2).collect()}
    assert out[1]["contaminated"] and not out[2]["contaminated"]
    assert out[2]["near_items"] == ["1"] and out[3]["near_items"] == [] and out[4]["near_items"] == []


def test_items_meet_documents_that_hold_an_anchor_of_theirs(docs, spark):
    """A rarest term alone, or next to another item's word, is no reason to match an item's windows."""
    table = spark.createDataFrame([("a", "red fox runs"), ("b", "blue owl sleeps"), ("c", "alone")], "item_id string, text string")
    rows = docs([(1, "red fox runs and blue"), (2, "owl blue sleeps red fox runs"), (3, "alone blue fox"), (None, "blue owl sleeps"), (4, "sleeps owl red runs blue")])
    ordered, kept, postings = bench.prepared(rows, table)
    met = {(r["doc_id"], r["item_id"]): [x["start"] for x in r["starts"]] for r in bench.matches(postings, ordered, kept).collect()}
    assert met == {(1, "a"): [0], (2, "a"): [3], (3, "c"): [0], (None, "b"): [0]}


def near_by_brute_force(text, item, slack, counts, k=10):
    at = {}
    for i, w in enumerate(words(text)):
        at.setdefault(w, []).append(i)
    w = words(item)
    for a in range(max(len(w) - k, 0) + 1):
        win = [(t, off) for off, t in enumerate(w[a : a + k])]
        rare = min(win, key=lambda x: (counts[x[0]], x[0], x[1]))
        for p in at.get(rare[0], []):
            if all(any(abs((q - off) - (p - rare[1])) <= slack for q in at.get(t, [])) for t, off in win):
                return True
    return False


def test_registered_query_finds_near_windows(spark, docs, tmp_path):
    items = [("1", "one two three four five six seven eight nine ten"), ("2", "red red blue green"), ("3", "alone"), ("4", "ten nine alone")]
    full = items[0][1].split()
    rows = [" ".join(full), "red blue green", "green blue red red", "alone", "alone ten nine", "nothing"]
    rows += [" ".join(full[:i] + ["odd"] * n + full[i:]) for i in range(1, 10) for n in (1, 2, 3)]  # inserted words
    rows += [" ".join([w for w in full if w != full[i]][:j] + [full[i]] + [w for w in full if w != full[i]][j:]) for i in range(10) for j in range(10)]  # a moved word
    rows = list(enumerate(rows))
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in entry.queries()["op6_positional_index_near"](spark, str(tmp_path)).collect()}
    exact = {r["doc_id"]: r for r in entry.queries()["op6_positional_index"](spark, str(tmp_path)).collect()}
    seen = Counter(w for _, t in rows for w in words(t))
    near = {i: sorted(name for name, item in items if near_by_brute_force(t, item, 2, seen)) for i, t in rows}
    for i, _ in rows:
        assert got[i]["n_near_items"] == len(near[i]) and got[i]["near_items_sha256"] == hashlib.sha256(",".join(near[i]).encode()).hexdigest(), i
        assert {k: got[i][k] for k in exact[i].asDict()} == exact[i].asDict()
    assert sum(bool(near[i]) and not got[i]["contaminated"] for i, _ in rows) > 20


def test_items_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_quality_short_texts(docs, n):
    r = quality.judge(docs([(1, " ".join("abc"[:n]))])).first()
    assert r["n_words"] == n and r["n_repeat_words"] == 0


def test_items_without_ids(spark, docs):
    """A null item_id still marks words; it has no name to be listed by."""
    words = " ".join(f"t{i}" for i in range(12))
    items = spark.createDataFrame([(None, words), ("b", "q1 q2 q3")], "item_id string, text string")
    out = {r["doc_id"]: r for r in bench.decontaminate(docs([(1, f"a {words} z"), (2, "x q1 q2 q3"), (3, "nothing")]), items, slack=2).collect()}
    assert (out[1]["n_hit"], out[1]["items"], out[1]["contaminated"]) == (12, [], True)
    assert (out[2]["n_hit"], out[2]["items"], out[2]["near_items"]) == (3, ["b"], ["b"]) and not out[3]["contaminated"]


def runs_by_hand(ws, template, k, drift, share):
    """Best alignments of a template, found by trying every start: (start, end, score) of those that are kept."""
    grams = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    own, t = grams(ws), grams(template)
    votes = [(i, j) for i, g in enumerate(own) for j, h in enumerate(t) if g == h]
    most, ends = len(template) + len(template) // 2, {}
    for x, (i, j) in enumerate(votes):
        ends[x] = max([(1, i)] + [(n + 1, s) for y, (n, s) in ends.items() if votes[y][0] < i and votes[y][1] < j and votes[y][0] >= i - most
                                  and abs((i - j) - (votes[y][0] - votes[y][1])) <= drift and i + k - s <= most])
    kept, out = [(s, votes[x][0] + k, n / len(t)) for x, (n, s) in sorted(ends.items()) if n >= share * len(t)], []
    for c in kept:
        if out and c[0] < out[-1][1]:
            out[-1] = max(out[-1], c, key=lambda o: (o[2], -o[1]))
        else:
            out.append(c)
    return out


def test_license_spans_are_verified(spark, docs):
    """Edited copies are found with their ends; the same words scattered or out of order are not a copy."""
    import random

    rng = random.Random(4)
    notice, label = lic.NOTICES[1]
    ws = notice.split()
    fill = lambda n: [rng.choice("alpha beta gamma delta".split()) for _ in range(n)]
    edited = fill(5) + ws[:6] + ["extra"] + ws[6:12] + ws[13:] + fill(4)
    scattered = [w for i in range(0, len(ws) - 2, 3) for w in ws[i : i + 3] + fill(60)]
    backward = [w for i in range(len(ws) - 5, -1, -5) for w in ws[i : i + 5]]
    twice = ws + fill(30) + ws
    repeated = ws[:4] * 12
    whole = lic.words(lic.TEXTS[0][0].encode())
    cases = {1: edited, 2: scattered, 3: backward, 4: twice, 5: repeated, 6: fill(9) + [w.decode() for w in whole]}
    _, hits = lic.votes(docs([(i, " ".join(w)) for i, w in cases.items()]))
    got = {}
    for r in lic.spans(hits).filter("NOT exact").collect():
        got.setdefault(r["doc_id"], []).append((r["label"], r["start"], r["end"], r["score"]))
    for i, w in cases.items():
        want = []
        for text, name in lic.NOTICES + lic.TEXTS:
            t = [x.decode() for x in lic.words(text.encode())]
            want += [(name, *s) for s in runs_by_hand(w, t, min(3, len(t)), 2, 0.7)]
        assert sorted(got.get(i, [])) == sorted(want), i
    assert got[1][0][:3] == (label, 5, 5 + len(ws)) and got[1][0][3] > 0.7
    assert 2 not in got and 3 not in got and 5 not in got and len(got[4]) == 2
    assert {x[0] for x in got[6]} == {"mit-whole", "mit-text"}


def test_rules_are_ordered_by_cost(spark, docs):
    """Of two rules that reject the same documents the cheaper one comes first, however long a job takes."""
    d = docs([(i, " ".join(f"word{i}x{j}" for j in range(150)) + (" END" if i % 2 else "")) for i in range(60)])
    cheap = quality.Rule("cheap", lambda c: c("n_words") == 151)
    dear = quality.Rule("dear", lambda c: F.regexp_count(F.regexp_replace(c("text"), r"(w)(o)(r)(d)", "$4$3$2$1"), F.lit(r"(?i)[a-z]+\\s*end\\b")) + F.regexp_count(c("text"), F.lit("END$")) > 0)
    for rules in ([dear, cheap], [cheap, dear]):
        ordered = quality.order_rules(d, rules)
        assert [r.name for r, _, _ in ordered] == ["cheap", "dear"] and all(abs(share - 0.5) < 1e-9 for _, share, _ in ordered)
