"""Lexical search, structure repair and URL filters against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserine.llm import lexical_search, structure_repair, url_filter

# --- lexical search

ITEMS, DOCS = "item_id long, text string, doc_id long", "doc_id long, text string, score long"


def terms(text):
    return [w.decode() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]


def lower(word):
    return "".join(c.lower() if c.isascii() else c for c in word)


def ranked(docs, items, k):
    counted = [(d, Counter(map(lower, terms(t)))) for d, t, _ in docs]
    big_n, big_l = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    wanted = {}
    for item, text, _ in items:
        if item is not None:
            wanted.setdefault(item, set()).update(map(lower, terms(text)))
    out = []
    for item, words in wanted.items():
        scores = []
        for doc, held in counted:
            if doc is None or not held:
                continue
            n, score = sum(held.values()), 0
            m = 100 - 50 + (50 * n * big_n) // big_l
            for w in words & held.keys():
                df = sum(w in c for _, c in counted)
                score += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df + 1))) * ((10**9 * held[w]) // (1000 * held[w] + 20 * m))
            if score > 0:
                scores.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_lexical_search_equals_brute_force(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    words = ["a", "B", "b", "Éa", "éa", "x1", "日本", "long" * 30, "the", "THE", "q-r", "İ"]
    docs = [(rnd.choice([k, k, k, None, k // 2]), " ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 40]))), k) for k in range(80)] + [(900, None, 0), (901, "", 0), (902, "... --", 0), (903, "the " * 3000, 0)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 5]))), 7) for k in range(12)] + [(3, "the extra", 7), (None, "the", 7), (50, None, 7), (51, "nowhere", 7)]
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 700)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", rnd.choice([3, 100]))
    found = lexical_search.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k=5)
    assert sorted(tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()) == ranked(docs, items, 5)


def test_lexical_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical_search.search(docs, items).collect() == []
    assert lexical_search.search(docs, spark.createDataFrame([(1, "a", 1)], ITEMS)).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, "a", 1)], DOCS), items).collect() == []


# --- structure repair

SENTENCE = re.compile(r"(s?(ua)+)?")
COSTS = {"K": 0, "R": 2, "I": 2, "D": 3}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edit sequences of few turns, insertions included: the cheapest (cost, audit, texts)."""
    marks, best = faults(rows), None
    for edits in itertools.product("KRrD", repeat=len(rows)):
        if any(m in ("blank", "duplicate") and e != "D" for m, e in zip(marks, edits, strict=True)):
            continue
        kept = [(e, k) for k, e in enumerate(edits)]
        for inserts in itertools.product(["", "I", "i", "Ii", "iI"], repeat=len(rows) + 1):
            steps, cost = [], 0
            for k in range(len(rows) + 1):
                steps += [(c, None) for c in inserts[k]] + ([kept[k]] if k < len(rows) else [])
            roles, texts, audit = "", [], ""
            for e, k in steps:
                audit += e.upper()
                cost += COSTS[e.upper()] + (k is not None and e != "D" and marks[k] == "truncated")
                if e != "D":
                    role = rows[k][0] if e == "K" else "user" if e in "RI" else "assistant"
                    roles += role[:1]
                    texts.append(f"{role}:{rows[k][1] if k is not None else ''}")
            if SENTENCE.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, texts
    return best


def test_cheapest_repairs_of_few_turns():
    chart = structure_repair.Chart()
    rnd = random.Random(5)
    roles = ["system", "user", "assistant", "tool"]
    for n in (0, 1, 2, 3):
        for _ in range(1 if n == 0 else 40):
            rows = [(rnd.choice(roles), rnd.choice(["a.", "b", " ", "c!"])) for _ in range(n)]
            tokens = [(r[:1], m in ("blank", "duplicate"), m == "truncated") for (r, _), m in zip(rows, faults(rows), strict=True)]
            cost, pieces = structure_repair.cheapest(tokens, chart)
            want = cheapest(rows)
            assert (cost, "".join(pieces).upper()) == want[:2], rows
    assert len(chart._columns) < 200


def stepwise(rows):
    """The same by states from turn to turn, for longer conversations."""
    big = (10**9, "", ())
    z, y, u, p = (0, "", ()), big, (2, "I", ("user:",)), (4, "II", ("user:", "assistant:"))

    def more(x, cost, letter, *said):
        return (x[0] + cost, x[1] + letter, x[2] + said)

    for (role, text), m in zip(rows, faults(rows), strict=True):
        must, e, i = m in ("blank", "duplicate"), int(m == "truncated"), role[:1]
        z1, ys, us, ps = more(z, 3, "D"), [more(y, 3, "D")], [more(u, 3, "D")], [more(p, 3, "D")]
        if not must:
            own = f"{role}:{text}"
            ys += [more(z, e, "K", own)] * (i == "s")
            us += [more(x, e, "K", own) for x in (z, y, p) if i == "u"] + [more(x, 2 + e, "R", f"user:{text}") for x in (z, y, p)]
            ps += [more(u, e, "K", own)] * (i == "a") + [more(u, 2 + e, "R", f"assistant:{text}")]
        z, y, u, p = z1, min(ys), min(us), min(ps)
        u = min(u, *(more(x, 2, "I", "user:") for x in (z, y, p)))
        p = min(p, more(u, 2, "I", "assistant:"))
    return min(z, p)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f:
            out += [(conv, turn, "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text)] * (2 if f == 3 else 1)
    return out


def whole_report(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        said = [(r[2], r[3]) for r in mine]
        turns = [r[1] for r in mine if r[1] is not None]
        marks = Counter(faults(said))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        cost, audit, texts = stepwise(said)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks["blank"], marks["duplicate"], marks["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, n long, fault string, digest string"


@pytest.mark.parametrize("fold", [5, 4096])
def test_reports_equal_brute_force(spark, monkeypatch, fold):
    monkeypatch.setattr(structure_repair, "FOLD_TURNS", fold)
    rnd = random.Random(11)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "and", None, "", "\u0085", "x? \n", "long " * 500 + ".", "a.b", "é"]
    rows = [(rnd.choice([0, 1, 2, 3, None]), rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(120)]
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t // 3}.") for t in range(1500)]  # a long one
    rows += [(k, 0, "user", "Hi.") for k in range(100, 160)]  # single turns, some of which are dropped
    turns = spark.createDataFrame([(*r, 5, "x", "y") for r in rows], TURNS)
    got = structure_repair.report(turns, structure_repair.damage(turns))
    assert sorted((tuple(r) for r in got.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str) == whole_report(rows)


def test_repaired_turns_are_legal_and_empty_tables(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hello.", 0, "", ""), (1, 1, "user", "Why", 0, "", ""), (1, 1, "user", "Why", 0, "", "")], TURNS)
    rows = structure_repair.repair(structure_repair.marked(turns)).collect()
    cost, audit, said = stepwise([("assistant", "Hello."), ("user", "Why"), ("user", "Why")])
    assert ("".join(r["edit"] for r in rows), sum(r["cost"] for r in rows)) == (audit, cost)
    assert [f"{r['role']}:{r['text']}" for r in rows if r["edit"] != "D"] == list(said)
    assert SENTENCE.fullmatch("".join(r["role"][0] for r in rows if r["edit"] != "D"))
    empty = turns.limit(0)
    assert structure_repair.report(empty, empty).collect() == []


# --- URL filters

PAGES, RULES = "page_id long, url string, host string, n long, verdict string", "host string, path string, verdict string"


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def judged(pages, rules):
    out = []
    known = {}
    for host, path, verdict in rules:
        if host and verdict in ("allow", "block") and (not path or path.startswith("/")):
            key = "".join(c.lower() if c.isascii() else c for c in host), path or ""
            known[key] = max(known.get(key, ""), verdict)
    for page, url, *_ in pages:
        host, path = split_url(url)
        fit = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in known.items() if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        out.append((page, host, path, best[2], best[3]))
    return sorted(out, key=str)


@pytest.mark.parametrize("shuffled", [False, True])
def test_url_rules_equal_brute_force(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    rnd = random.Random(3)
    names, folders = ["a", "b", "co", "uk", "xn--é", ""], ["x", "y", "", "x y", "é"]

    def host():
        return ".".join(rnd.choices(names, k=rnd.randrange(1, 4)))

    def path():
        return "".join("/" + rnd.choice(folders) for _ in range(rnd.randrange(4))) + rnd.choice(["", "/"])

    rules = [(host(), path(), rnd.choice(["allow", "block"])) for _ in range(120)] + [(None, "/", "block"), ("a", None, "block"), ("A", "/x", "allow"), ("b", "x", "block"), ("b", "/", "perhaps"), ("", "/", "block")]
    pages = [(k, f"{rnd.choice(['http', '', 'a?b#'])}://{host().upper() if k % 5 == 0 else host()}{path()}{rnd.choice(['', '?q=/x/', '#/x', '?'])}", "h", 1, "v") for k in range(300)]
    pages += pages[:5] + [(None, "http://a/x/", "h", 1, "v")] * 3 + [(900, None, "h", 1, "v"), (901, "", "h", 1, "v"), (902, "no scheme", "h", 1, "v"), (903, "://", "h", 1, "v"), (904, "http://" + "a." * 5000 + "co" + "/x" * 5000, "h", 1, "v"), (905, "http://a\nb/x\ny", "h", 1, "v")]
    found = url_filter.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, RULES))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == judged(pages, rules)


def test_url_filters_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/", "h", 1, "v")], PAGES)
    assert [tuple(r) for r in url_filter.judge(pages, spark.createDataFrame([], RULES)).collect()] == [(1, "a", "/", None, "allow")]
    assert url_filter.judge(pages.limit(0), spark.createDataFrame([("a", "/", "block")], RULES)).collect() == []


def test_hot_expressions_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://one.net/"), F.col("id").cast("string")).alias("url"))
    rules = spark.createDataFrame([("net", "/", "block"), ("one.net", "/77", "allow")], RULES)
    assert {(r["verdict"], r["count"]) for r in url_filter.judge(pages, rules).groupBy("verdict").count().collect()} == {("block", 5000 - 11), ("allow", 11)}


# --- labels that differ


def test_documents_with_differing_labels_teach_nothing(spark):
    from tesserine.llm import toxicity

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k in range(1, 9) for t in ((0, 1) if k % 2 else (1, 1))] + [(2, None), (None, 1)], "doc_id long, toxic int")
    kept = {r["text"]: r["toxic"] for r in toxicity.training_rows(docs, labels).collect()}
    held_out = {r["doc_id"] for r in docs.where(toxicity.in_fold()).collect()}
    assert kept == {f"text {k}": 1 for k in range(2, 9, 2) if k not in held_out}
    assert "SortMergeJoin" not in toxicity.training_rows(docs, labels)._jdf.queryExecution().executedPlan().toString()
