"""The ten operators against brute force, round trips and held-out labels, with nulls, empties, ties and repeats."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recallgrid.llm import ann, bpe, common, components, minhash, packing, quality, simhash, suffix_dedup, suffix_lm, token_counts, toxicity

ODD = [None, "", " ", "a", "The the THE\n\n\tend  ", "naïve 漢字 😀 é", "<|endoftext|> x<|endoftext|>", "x" * 3000, "it's we'll 123 45\x1c\x85end\r\n", "word " * 2000, "\x00nul"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Odd texts, random texts, copies and near copies; repeated rows, a null id, clashing extra columns."""
    random.seed(5)
    words = ["".join(random.choice("abcdefgh é") for _ in range(random.randint(1, 7))).strip() or "z" for _ in range(300)]
    passage = " ".join(random.choice(words) for _ in range(60))
    texts = [*ODD]
    for i in range(80):
        text = " ".join(random.choice(words) for _ in range(random.randint(1, 120)))
        texts.append(f"{text} {passage} {text[:20]}" if i % 9 == 0 else text)
    texts += [texts[20], texts[20] + " more", texts[30].upper(), texts[11]]
    rows = [(i, t, i, i, "x") for i, t in enumerate(texts)] + [(5, texts[5], 0, 0, "x"), (None, "no id here", 0, 0, "x")]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, "doc_id long, text string, rid long, score long, base string").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, x) for x in row)


def test_bpe_equals_the_library_and_comes_back(docs, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    codec = bpe.byte_bpe(path, P.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_documents(docs, path, P.PATTERN).collect()), key=key)
    assert got == sorted(((i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t in pairs(docs)), key=key)
    assert bpe.encode_documents(empty, path, P.PATTERN).count() == 0


def test_bpe_on_random_strings():
    codec = bpe.byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})
    random.seed(1)
    pieces = [*"abcthe THE \n\t  '123éßñ中😀  \x1c\x85.,!?", "'s", "'ll", " the", "ing", "\r\n"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in codec.encode_all(texts)] == plain.encode_ordinary_batch(texts)


def test_token_counts_equal_the_library(docs, empty):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, path, P.PATTERN, limit=50).collect()), key=key)
    n = {x: len(t.encode(x or "", add_special_tokens=False).ids) for _, x in pairs(docs)}
    assert got == sorted(((i, len((x or "").encode()), n[x], n[x] > 50) for i, x in pairs(docs)), key=key)
    assert token_counts.count_tokens(empty, path, P.PATTERN).count() == 0


def test_word_bpe_equals_the_library():
    own, t = packing.word_bpe(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    random.seed(2)
    pieces = [*"abcdefgtheTHEéßÀÿµ'.,!?-<|>0123_ \n\xa0\x85\x1c\xad", "'s", "'ll", "the", "tion", "你", "ﬁ", "Σ", "İ", "<|endoftext|>"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 30))) for _ in range(4000)] + [x or "" for x in ODD]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in own.encode_all(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_places_every_piece(docs, empty):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=64).collect()
    expected = []
    for i, text in pairs(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        expected += [(i, n, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], dtype="<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 64))]
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(expected, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack_documents(empty, path).count() == 0


def test_plan_reaches_the_optimum_on_small_instances():
    from functools import cache

    def optimum(items, capacity):
        @cache
        def best(left, room):
            if not left:
                return 0
            return min((0 if x <= room else 1) + best(left[:i] + left[i + 1 :], room - x if x <= room else capacity - x) for i, x in enumerate(left))

        return best(tuple(sorted(items)), 0)

    random.seed(4)
    worse = 0
    for _ in range(60):
        items = [random.randint(1, 12) for _ in range(random.randint(1, 8))]
        counts = {x: items.count(x) for x in items}
        plan = packing.Plan(counts, 12)
        assert sum(last - first + 1 for _, first, last, _, _ in plan.rows) == len(items)
        worse += plan.sequences - optimum(items, 12)
    assert worse <= 1


def fingerprint_by_rule(text, n):
    found = regex.findall(r"[^\x20\x09-\x0D]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))] if found else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(values, most):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_simhash_groups(docs, empty):
    got = simhash.near_duplicates(docs, words=4).collect()
    print_of = {t: fingerprint_by_rule(t, 4) for _, t in pairs(docs)}
    group = linked(sorted(set(print_of.values())), 4)
    least = {}
    for i, t in pairs(docs):
        if i is not None:
            g = group[print_of[t]]
            least[g] = min(i, least.get(g, i))
    expected = [(i, print_of[t], least.get(group[print_of[t]])) for i, t in pairs(docs)]
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=key) == sorted(expected, key=key)
    kept = simhash.keep_first(docs, words=4)
    assert kept.columns == docs.columns
    assert kept.count() == len({group[print_of[t]] for _, t in pairs(docs)})
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("split", [4096, 20])
def test_links_lose_nothing(spark, split):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**64, 150, dtype=np.uint64)
    flipped = [seeds]
    for n in range(1, 5):
        x = seeds.copy()
        for _ in range(n):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        flipped.append(x)
    values = np.unique(np.concatenate([*flipped, seeds[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    edges = simhash.link_fingerprints(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long"), split=split)
    got = {r["u"]: r["v"] for r in components.components(edges).collect()}
    signed = {int(v): int(np.uint64(v).view(np.int64)) for v in values}
    group = linked([int(v) for v in values], 4)
    least = {}
    for v, g in group.items():
        least[g] = min(signed[v], least.get(g, signed[v]))
    assert {signed[v]: got.get(signed[v], signed[v]) for v in group} == {signed[v]: least[g] for v, g in group.items()}


def test_homes_of_a_hot_anchor_meet_across_parts(spark):
    """Pairs equal in block 0 and 2 + 2 bits apart in the others: all are homes of one anchor, dealt over 20 parts."""
    rng = np.random.default_rng(8)
    first = np.unique(rng.integers(0, 2**43, 200, dtype=np.uint64)) << np.uint64(21)
    flips = [sum(1 << int(b) for at, width in simhash.BLOCKS[1:] for b in at + rng.choice(width, 2, replace=False)) for _ in first]
    values = np.concatenate([first, first ^ np.array(flips, dtype=np.uint64)])
    edges = simhash.link_fingerprints(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long"), split=20)
    got = {r["u"]: r["v"] for r in components.components(edges).collect()}
    root = [got.get(int(v), int(v)) for v in values.view(np.int64)]
    assert root[: len(first)] == root[len(first) :]


def test_links_reach_over_batches_and_parts(spark):
    """6,000 fingerprints at home at one anchor, in triples a, b, c where only a-b and b-c are within 4 bits."""
    rng = np.random.default_rng(9)
    a = np.unique(rng.integers(0, 2**43, 2000, dtype=np.uint64)) << np.uint64(21)
    bits = np.stack([21 + rng.choice(43, 6, replace=False) for _ in a]).astype(np.uint64)
    step = lambda k: np.bitwise_or.reduce(np.uint64(1) << bits[:, k : k + 3], axis=1)
    b = a ^ step(0)
    c = b ^ step(3)
    values = np.concatenate([a, b, c])
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    assert simhash.anchors(values[:10])[2].sum() == 30
    for split, batch in ((4096, "10000"), (4096, "500"), (20, "10000"), (100_000, "700")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r["u"]: r["v"] for r in components.components(simhash.link_fingerprints(frame, split=split)).collect()}
        root = np.array([got.get(int(v), int(v)) for v in values.view(np.int64)]).reshape(3, -1)
        assert (root[0] == root[1]).all() and (root[1] == root[2]).all()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_row_ids_do_not_depend_on_splits(spark, tmp_path):
    spark.range(5000).selectExpr("id doc_id", "repeat(cast(id as string), 9) text").repartition(4).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    before = {r["rid"]: r["doc_id"] for r in common.with_row_id(docs, "doc_id").collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    after = {r["__rid"]: r["doc_id"] for r in common.row_id(docs.where("doc_id % 2 = 0")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(before) == 5000 and all(before[k] == v for k, v in after.items())


def test_suffix_lm_base_and_scores(docs, empty):
    rows = suffix_lm.score_documents(docs).collect()
    words = lambda t: (t or "").encode().translate(suffix_lm.LOWER_ASCII).split() + [b"\n"]
    held = lambda i: suffix_lm.fold(i, 7) == 2
    counts = {}
    for i, t in pairs(docs):
        for w in words(t) if not held(i) else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((i, held(i), len(words(t)), sum(w in counts for w in words(t)), n, round(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in pairs(docs)), key=key)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=key) == expected
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert suffix_lm.score_documents(empty).count() == 0


def scores_by_rule(docs, cost, depth):
    """Log10 probabilities by a tree in plain dictionaries, and the distribution of every retained context."""
    texts = [(i, [b"<"] + (t or "").encode().translate(suffix_lm.LOWER_ASCII).split() + [b"\n"]) for i, t in docs]
    taught = [s for i, s in texts if suffix_lm.fold(i, 7) != 2]
    one, tree = {}, {}
    for s in taught:
        for k in range(1, len(s)):
            one[s[k]] = one.get(s[k], 0) + 1
            for context in (tuple(s[k - n : k]) for n in range(1, min(k, depth) + 1)):
                tree.setdefault(context, {}).setdefault(s[k], 0)
                tree[context][s[k]] += 1
    total, kinds = sum(one.values()), len(one)
    bar = cost * 0.5 * np.log(max(total, 2))
    retained = set()

    def p(context, w):
        while context and context not in retained:
            context = context[1:]
        return raw(context, w)

    def raw(context, w):
        if not context:
            return (one.get(w, 0) + 1) / (total + kinds + 1)
        seen = tree[context]
        once = sum(n for n in seen.values() if n < 2)
        return ((seen.get(w, 0) if seen.get(w, 0) >= 2 else 0) + (once + 1) * p(context[1:], w)) / (sum(seen.values()) + 1)

    for length in range(1, depth + 1):
        for context, seen in tree.items():
            kept = sum(n >= 2 for n in seen.values())
            if len(context) == length and kept and sum(n * np.log(raw(context, w) / p(context[1:], w)) for w, n in seen.items()) > bar * kept:
                retained.add(context)
    sums = [sum(p(c, w) for w in one) + p(c, b"unheard of") for c in retained]
    return [(i, sum(np.log10(p(tuple(s[max(0, k - depth) : k]), s[k])) for k in range(1, len(s)))) for i, s in texts], sums, retained


@pytest.mark.parametrize(("bucket", "hot", "depth"), [(10**6, 10**6, 3), (300, 10**6, 2), (150, 12, 3), (50, 2, 3), (400, 40, 5)])
def test_suffix_tree_equals_plain_dictionaries(docs, bucket, hot, depth):
    expected, sums, retained = scores_by_rule(pairs(docs), 0.3, depth)
    assert np.allclose(sums, 1) and {len(c) for c in retained} >= {1, 2}
    got = suffix_lm.score_documents(docs, bucket=bucket, hot=hot, depth=depth).collect()
    got, expected = (sorted(x, key=key) for x in ([(r["doc_id"], r["score"]) for r in got], expected))
    assert [i for i, _ in got] == [i for i, _ in expected] and np.allclose([x for _, x in got], [x for _, x in expected], rtol=1e-6, atol=1e-4)


def test_long_contexts_are_retained(spark):
    """What follows depends on the third word before: only a context of three words tells it."""
    random.seed(2)
    rows = [(i, " ".join(f"{a} x y {a}z" for a in random.choices("abcdefgh", k=40))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    three, two = (np.mean([r["score"] for r in suffix_lm.score_documents(docs, depth=d).where("held_out").collect()]) for d in (3, 2))
    assert three > two + 25


def test_words_outside_the_dictionary_count_in_the_base(docs):
    key_of = lambda r: (r["doc_id"] is None, r["doc_id"], r["base_score"])
    whole, small = (sorted(suffix_lm.score_documents(docs, vocabulary=n, hot=30, bucket=200).collect(), key=key_of) for n in (10**6, 15))
    for a, b in zip(whole, small):
        assert (a["doc_id"], a["n_tokens"], a["n_known"], a["train_tokens"]) == (b["doc_id"], b["n_tokens"], b["n_known"], b["train_tokens"])
        assert np.isclose(a["base_score"], b["base_score"])


def test_suffix_tree_grows_with_its_text(spark):
    """Twice the text in new words: twice the retained contexts, so a copy of a taught text scores far above its base."""
    rows = [(i, " ".join(f"w{i // 2}x{(k * k) % 53}" for k in range(60))) for i in range(200)]
    for n in (100, 200):
        got = suffix_lm.score_documents(spark.createDataFrame(rows[:n], "doc_id long, text string")).where("NOT held_out").collect()
        assert np.mean([r["score"] - r["base_score"] > 20 for r in got]) > 0.6


def removed_by_rule(docs, length):
    seen, out = set(), {}
    for i, t in docs:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - length + 1):
            if (w := data[p : p + length]) in seen:
                gone[p : p + length] = True
            else:
                seen.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize(("length", "most_runs"), [(100, 32_000), (48, 32_000), (48, 2)])
def test_suffix_dedup_equals_brute_force(spark, docs, empty, length, most_runs, tmp_path):
    docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    got = {r["doc_id"]: tuple(r[1:]) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(one, length=length, most_runs=most_runs)).collect()}
    assert got == removed_by_rule(sorted(pairs(one)), length)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(docs, length=length).count() == docs.count()


def test_nearest_finds_the_exact_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5020, [1.0] * 3), (None, x[0].tolist()), (3, x[3].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, every=50, block=400).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 1500, 50):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -np.round(s, 9)))[:10].tolist()) & set(found[q]))
    assert sorted(found) == list(range(0, 1500, 50))
    assert hits >= 0.95 * 300
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_minhash_estimates_similarity(spark, docs, empty):
    rows = minhash.edited_pairs(docs).collect()
    order = sorted(pairs(docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [[x for x in regex.split(r"[\x20\x09-\x0D]+", t) if x]] for i in range(max(1, len(w) - 4))}
    jaccard = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    expected = {}
    for place, (i, t) in enumerate(order):
        t, after = t or "", order[(place + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        expected.setdefault((i, len(t), edited), []).append((jaccard(t, edited), jaccard(t, after)))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited"]) for r in rows), key=key) == sorted((k for k, v in expected.items() for _ in v), key=key)
    errors = [abs(r["near_edited"] - expected[r["doc_id"], r["n_chars"], r["edited"]][0][0]) for r in rows]
    assert np.mean(errors) < 0.04 and max(errors) < 0.2
    assert minhash.edited_pairs(empty).count() == 0
    ends = minhash.edited_pairs(spark.createDataFrame([(-(2**63), "least"), (2**63 - 1, "most"), (0, "none")], "doc_id long, text string"))
    assert {r["edited"] for r in ends.select("edited").collect()} == {"mosn", "nonl", "leasm"}


def test_classifiers_hold_out(spark, tmp_path):
    random.seed(6)
    names = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [random.choice(names) for _ in range(random.randint(5, 80))]
        bad, toxic = i % 6 == 0, i % 5 == 0
        if toxic:
            text[random.randrange(len(text))] = text[0] = "scumface"
        if bad:
            text = [t + "!!%%" for t in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(None, None), (9000, "")]
    labels += [(None, 1, 1), (1, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs, given = spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels if q is not None}
    for module, at in ((quality, 0), (toxicity, 1)):
        got = module.score_all(docs, given).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        held = [(truth[r["doc_id"]][at], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
        assert np.mean([y == p for y, p in held]) > 0.95
        nothing = module.score_all(docs, given.where("doc_id < 0")).collect()
        assert len({r["score"] for r in nothing}) == 1


def test_swaps_are_penalised():
    x, y = np.array([[1, 0, 1.0], [0, 1, 1], [0, 0, 1], [0, 0, 1]]), np.array([1.0, 0, 0, 0])
    model = lambda: toxicity.Model({}, np.zeros(0))
    before, after = np.array([[1, 0, 1.0]]), np.array([[0, 1, 1.0]])
    d = before - after
    free = toxicity.fit(model(), x, y, None, penalty=1.0, decay=1e-4).weights
    held = toxicity.fit(model(), x, y, d.T @ d, penalty=10.0, decay=1e-4).weights
    assert abs((before - after) @ held) < 0.2 * abs((before - after) @ free)
    assert toxicity.swapped(["the", "women", "sing"])[0] == ["the", "men", "sing"]


def test_neutral_mentions_of_groups_are_not_toxic(spark, empty):
    """Group words stand in all toxic and few clean labelled texts; a penalty on swaps keeps the word alone from counting."""
    random.seed(11)
    names = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(500):
        text = [random.choice(names) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic:
            text[2:4] = ["muslims", "scumface"]
        rows.append((i, " ".join(text) + ".", 0.5, 7))
        labels.append((i, int(toxic)))
    rows += [(4, rows[4][1], None, 1), (9001, " ".join(names[:9] + ["muslims"]), None, None), (9002, " ".join(names[:9] + ["christians"]), None, None)]
    docs, given = spark.createDataFrame(rows, "doc_id long, text string, score double, label int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    gap = {}
    for penalty in (0.0, 20.0):
        model = toxicity.train(docs, given, penalty=penalty)
        got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
        gap[penalty] = abs(np.log(got[9001] / (1 - got[9001])) - np.log(got[9002] / (1 - got[9002])))
        assert got[0] > 0.5 > got[1]
    assert gap[20.0] < 0.2 * gap[0.0]
    assert toxicity.score_all(empty, given).count() == 0
    assert {r["predicted"] for r in toxicity.score_all(docs, given.limit(0)).collect()} == {0}


def test_quality_of_repeated_rows_and_empty_tables(spark, empty):
    rows = [(i, "word " * (i % 7 + 3) if i % 3 else "%% !! ## " * 5, "x", 3) for i in range(200)]
    rows += [(1, "another text of the same id", "x", 3), (1, None, None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, x int")
    given = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    first, second = quality.train(docs, given), quality.train(docs.repartition(7), given)
    assert np.allclose(first.weights, second.weights) and len(first.weights) > 1
    assert quality.score_documents(docs, first).columns == ["doc_id", "text", "x", "score", "predicted"]
    assert quality.score_all(empty, given).count() == 0


def test_minhash_cuts_stay_short_and_exact(spark):
    cuts = sorted(random.Random(7).sample(range(-9000, 9000), 30))
    assert len(str(minhash._below(cuts))) < 2_000  # grew with the square of the cuts
    ids = [*cuts, *(c + 1 for c in cuts), -(2**63), 2**63 - 1]
    got = dict(spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", minhash._below(cuts).alias("n")).collect())
    assert got == {i: sum(c < i for c in cuts) for i in ids}


def test_minhash_next_over_buckets(spark):
    rows = [(i if i % 7 else None, f"t{i * 5 % 90} x") for i in range(90)] + [(4, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.array(F.lit(0)))
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in minhash.with_next(docs, per_bucket=6).collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(got, key=repr) == sorted(((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order)), key=repr)
