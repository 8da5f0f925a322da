"""Ranked search, structure repair and decontamination against brute force."""

import functools
import hashlib
import math
import random
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from recallgrid.llm import decontaminate, queryset, repair, search

ODD = [None, "", " ", "a", "The the THE\n\n\tend  ", "naïve 漢字 😀 é İ", "x" * 3000, "it's we'll 123 45\x1c\x85end\r\n", "word " * 500, "\x00nul \x01 mark", "_under_score-dash"]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Few words, so that documents and items share many; passages of items in documents; copies, repeated rows, null ids."""
    random.seed(3)
    words = [random.choice(["the", "of", "Ab", "cd", "é", "12", "z"]) + str(i % 40) for i in range(60)]
    text = lambda n: random.choice([" ", ", ", "\n"]).join(random.choice(words) for _ in range(n))
    items = [text(random.randint(1, 40)) for _ in range(30)] + [None, "", "é12", "The", "word word word", text(2000)]
    items = [(i, t, "x") for i, t in enumerate(items)] + [(3, items[3], "x"), (4, text(12), "x"), (None, text(11), "x")]
    docs = [*ODD]
    for i in range(150):
        t = text(random.randint(1, 90))
        if i % 3 == 0:
            own = (random.choice(items)[1] or "").split(" ")
            a = random.randint(0, len(own))
            t = f"{t} {' '.join(own[a : a + random.randint(8, 30)])} {text(4)}"
        docs.append(t)
    docs += [docs[20], docs[30], docs[31].upper()] + [docs[40]] * 30
    rows = [(i, t, i) for i, t in enumerate(docs)] + [(5, docs[5], 0), (50, docs[50], 0), (None, docs[60], 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, rid long").repartition(3).write.parquet(f"{path}/docs")
    spark.createDataFrame(items, "item_id long, text string, term string").write.parquet(f"{path}/items")
    return spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/items")


def lowered(text):
    return regex.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def items_by_rule(items, pattern):
    out = {}
    for i, t in sorted({(r["item_id"], r["text"]) for r in items.collect()}, key=key):
        out.setdefault(i, []).append(regex.findall(pattern, lowered(t)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 600])
@pytest.mark.parametrize("postings, splits", [(400_000, 24), (500, 2)])
def test_search_equals_scoring_everything(tables, block, postings, splits):
    docs, items = tables
    words = [(r["doc_id"], regex.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(r["text"]))) for r in docs.collect()]
    words = [(i, w) for i, w in words if w]
    big_n, big_l = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    expected = []
    for item, texts in items_by_rule(items, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").items():
        scored = []
        for i, w in words:
            m = 100 - 75 + 75 * len(w) * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for x in texts for t in x if t in df)
            if s > 0:
                scored.append((-s, i is None, i))
        expected += [(item, n, i, -s) for n, (s, _, i) in enumerate(sorted(scored)[:10], 1)]
    got = [tuple(r) for r in search.top_documents(docs, items, block=block, postings=postings, splits=splits).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_search_leaves_most_documents_out(spark, tmp_path):
    """Where documents differ, bounds leave most of them unscored, and later blocks more than the first."""
    random.seed(8)
    texts = [" ".join(f"w{int(random.paretovariate(0.6)) % 3000}" for _ in range(random.randint(5, 60))) for _ in range(4000)]
    asked = search.items_of([(0, [" ".join(f"w{i}" for i in (11, 57, 303, 900, 1200))])])
    n, sizes, term, tf = [], [], [], []
    for t in texts:
        w = [asked.terms[x] for x in t.encode().split() if x in asked.terms]
        n.append(len(t.split()))
        sizes.append(len(set(w)))
        term += sorted(set(w))
        tf += [w.count(x) for x in sorted(set(w))]
    np = pytest.importorskip("numpy")
    df = np.bincount(term, minlength=len(asked.terms))
    corpus = search.Corpus(len(texts), sum(n), search.weights(len(texts), df))
    one = search.Search(asked, corpus, 10, 8)
    places = np.cumsum([0, *sizes])
    for a in (0, 2000):
        before = one.scored
        span = slice(places[a], places[a + 2000])
        one.add(search.Block(np.arange(a, a + 2000), np.array(n[a : a + 2000]), np.array(sizes[a : a + 2000]), np.array(term[span]), np.array(tf[span]), corpus))
    assert one.scored < sum(s > 0 for s in sizes) / 2 and one.scored - before < before


def test_search_on_empty_tables(tables):
    docs, items = tables
    assert search.top_documents(docs.limit(0), items).count() == 0
    assert search.top_documents(docs, items.limit(0)).count() == 0


def spans_by_rule(text, items, window):
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    hit, found = [False] * len(words), set()
    for item, texts in items.items():
        for x in texts:
            k = min(window, len(x))
            for w in {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if x else ():
                for i in range(len(words) - k + 1):
                    if tuple(words[i : i + k]) == w:
                        hit[i : i + k] = [True] * k
                        found.add(item)
    return words, hit, found


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_decontamination_equals_all_windows(tables, block):
    docs, items = tables
    own = items_by_rule(items, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected = []
    for r in docs.collect():
        words, hit, found = spans_by_rule(r["text"], own, 10)
        names = ",".join(sorted("" if i is None else str(i) for i in found))
        expected.append((r["doc_id"], len(words), sum(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), any(hit)))
    got = [tuple(r) for r in decontaminate.digests(decontaminate.contaminated_spans(docs, items, block=block)).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert sum(x[2] > 0 for x in expected) > 50
    assert decontaminate.contaminated_spans(docs.limit(0), items).count() == 0
    assert decontaminate.digests(decontaminate.contaminated_spans(docs, items.limit(0))).where("contaminated").isEmpty()


def test_shared_passages_are_cut_and_covered_documents_go(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(0, f"Start. {passage}; the rest of it " + "w " * 40, 1), (1, passage, 1), (2, "clean text", 1), (3, None, 1), (4, " ".join(passage.split()[:9]), 1)]
    spark.createDataFrame(rows, "doc_id long, text string, n int").write.parquet(f"{tmp_path}/docs")
    items = spark.createDataFrame([(7, passage.upper())], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_benchmark(spark.read.parquet(f"{tmp_path}/docs"), items).collect()}
    assert got == {0: "Start. ; the rest of it " + "w " * 40, 2: "clean text", 3: None, 4: rows[4][1]}


def test_words_of_very_long_texts_are_cut_between_words():
    texts = ["ab " * 50, "", "x" * 90 + " y", "Z\x01z"]
    pieces = list(queryset.batch_words(texts, 16))
    assert len(pieces) > 5 and [w for p in pieces for w in p] == [w for t in texts for w in [*queryset.words_of(t), queryset.MARK]]


def repaired_by_rule(rows):
    """rows in order, after damage: (turn, role, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        stripped = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, at, insertions=2):  # a third insertion in a row never helps
        options = [(0, "", ())] if i == len(rows) and at in ("", "a") else [(10**6, "", ())]
        if i < len(rows):
            cost, audit, out = best(i + 1, at)
            options.append((cost + 4, "D" + audit, out))
        if i < len(rows) and faults[i] not in ("blank", "duplicate"):
            extra = 3 * (faults[i] == "truncated")
            for letter, role, price in (("K", rows[i][1], 0), ("R", "user", 3), ("R", "assistant", 3)):
                if to := step.get((at, role[:1])):
                    cost, audit, out = best(i + 1, to)
                    options.append((cost + price + extra, letter + audit, (f"{role}:{rows[i][2]}", *out)))
        for role in ("user", "assistant") if insertions else ():
            if to := step.get((at, role[0])):
                cost, audit, out = best(i, to, insertions - 1)
                options.append((cost + 3, "I" + audit, (f"{role}:", *out)))
        return min(options)

    cost, audit, out = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged_by_rule(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else regex.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))  # ties are equal rows here


@pytest.mark.parametrize("segment", [64, 3])
def test_repair_equals_all_edits(spark, tmp_path, segment):
    random.seed(segment)
    texts = ["Hello there.", "what? \n", "cut off", "", " \t", "Yes!", "a.b", None, "é.", "..", "long " * 200 + "end."]
    conversations = {}
    for conv in [None, *range(150)]:
        n = random.choice([1, 2, 4, 8, 30])
        roles = ["system"] * random.randint(0, 2) + ["user", "assistant"] * n
        rows = [(t, random.choice(["tool", "", None, "User", *roles]) if random.random() < 0.3 else r, random.choice(texts) if random.random() < 0.5 else f"text {t}.") for t, r in enumerate(roles[:n])]
        rows = [(None if conv == 7 else t * (1 + (random.random() < 0.1)) if conv != 8 else t, r, x) for t, r, x in rows]
        rows = [r for i, r in enumerate(rows) if r[0] not in [q[0] for q in rows[:i]]] if conv != 9 else [rows[0]] * 20
        conversations[conv] = rows
    flat = [(c, *r, "x") for c, rows in conversations.items() for r in rows]
    random.shuffle(flat)
    spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, at string").repartition(3).write.parquet(f"{tmp_path}/c")
    table = spark.read.parquet(f"{tmp_path}/c")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.with_all(repair.repair(repair.damaged(table), segment=segment), table).collect()}
    expected = {c: repaired_by_rule(damaged_by_rule(c, rows)) for c, rows in conversations.items()}
    assert got == expected
    assert repair.with_all(repair.repair(repair.damaged(table.limit(0))), table.limit(0)).count() == 0


def test_crossing_costs_add_up():
    """The auction over a whole conversation costs what the best way over its segments' edges costs."""
    random.seed(6)
    for _ in range(200):
        codes = bytes(random.choices(range(12), k=random.randint(1, 30)))
        whole = repair.paths(codes, repair._closing_costs(), [repair.E])[0][2]
        for size in (1, 4, 9):
            exits = repair._closing_costs()
            for a in reversed(range(0, len(codes), size)):
                costs = repair.crossing_costs(codes[a : a + size])
                exits = [min(costs[4 * q + r] + exits[r] for r in range(4)) for q in range(4)]
            assert exits[repair.E] == whole
