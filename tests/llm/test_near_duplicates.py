"""SimHash, passages and weighted sampling against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from attestry.llm import common, components, shingles, simhash, substrings, weighted_sampling


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "one", "One  TWO", "a b c", "É é x y z W", "a b a b a b a b"])
def test_fingerprints(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text)) == slow_fingerprint(text)


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = words(random.Random(4), 500)
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert simhash.fingerprint(simhash.shingle_hashes(text)) == slow_fingerprint(text)


def test_components_of_near_fingerprints(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ m for b in base for m in [0, *(sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3))) for _ in range(15))]})
    fps += [base[0] ^ ((1 << k) - 1) for k in range(2, 60, 2)]  # a chain of links
    fps = sorted({f & (2**64 - 1) for f in fps})
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    roots = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))).collect()}
    groups = collections.defaultdict(set)
    for i, x in enumerate(signed):
        groups[roots.get(x, x)].add(find(i))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(i) for i in range(len(fps))})


def near_docs(spark):
    rng = random.Random(5)
    a, b = words(rng, 400), words(rng, 300)
    texts = {3: a, 7: a.upper(), 9: a, 1: b, 12: None, 14: "", 15: " ", 20: words(rng, 50)}
    return spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(None, b, 1), (20, texts[20], 1)], "doc_id bigint, text string, fp int")


def test_near_duplicates(spark):
    got = simhash.near_duplicates(near_docs(spark)).collect()
    assert len(got) == 10
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (7, 3), (9, 3), (1, 1), (None, 1), (12, 12), (14, 12), (15, 12), (20, 20)}
    kept = simhash.keep_one(near_docs(spark))
    assert kept.columns == ["doc_id", "text", "fp"] and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 12), (False, 20), (True, 0)]
    assert simhash.near_duplicates(near_docs(spark).limit(0)).count() == 0


def tree(h, left, right, t):
    """The nodes (l, c, r) of the Cartesian tree with at least t places, one by one."""
    if right - left + 1 < t:
        return []
    c = min(range(left, right + 1), key=lambda i: (h[i], i))
    return [(left, c, right), *tree(h, left, c - 1, t), *tree(h, c + 1, right, t)]


def test_compact_windows_are_those_of_the_cartesian_tree():
    rng, t = np.random.default_rng(1), 10
    for values in (rng.integers(0, 1 << 63, 60), rng.permutation(60), np.arange(60)):
        docs = [values[:25], values[:0], values[25:30], values[25:], values[3:13]]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        starts, row = substrings.run_starts(offsets, t)
        h = np.concatenate(docs).astype(np.uint64)
        key, a, z = substrings.compact_windows(h, starts, row, t)
        got = {(int(row[i]), int(k), int(starts[i] - offsets[row[i]]), int(starts[j] - offsets[row[j]])) for k, i, j in zip(key, a, z)}
        assert got == {(n, int(d[c]), max(left, c - t + 1), min(c, right - t + 1)) for n, d in enumerate(docs) for left, c, right in tree(d.tolist(), 0, len(d) - 1, t)}


def test_equal_least_tokens_have_one_window():
    rng, t = np.random.default_rng(2), 10
    for h in (np.zeros(500, np.uint64), rng.integers(0, 4, 300).astype(np.uint64)):
        starts, row = substrings.run_starts(np.array([0, len(h)]), t)
        key, a, z = substrings.compact_windows(h, starts, row, t)
        assert a[0] == 0 and z[-1] == len(starts) - 1 and (a[1:] == z[:-1] + 1).all() and (key[1:] != key[:-1]).all()
        assert all(h[i : i + t].min() == k for k, s, e in zip(key, a, z) for i in range(s, e + 1))


@pytest.mark.parametrize("text", ["", " \n", "one", "a b c d e", " A b\tC \x0bd\x0c e\rf  É é ", "x " * 30])
def test_tokens_are_those_of_words(text):
    words = "".join(c.lower() if c.isascii() else c for c in text)
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    got, offsets = shingles.tokens_of(["q w e r t y", text, ""], 5)
    assert np.diff(offsets).tolist() == [2, max(0, len(words) - 4), 0]
    alone = [shingles.tokens_of([" ".join(words[i : i + 5])], 5)[0].tolist() for i in range(max(0, len(words) - 4))]
    assert [[x] for x in got[2:].tolist()] == alone
    texts = [text, "one", "one two", "two one", "one two three four", "", "a b c d e f", "One"]
    got, offsets = shingles.tokens_of(texts, 5, whole=True)
    assert np.diff(offsets).tolist() == [max(min(1, len(words)), len(words) - 4), 1, 1, 1, 1, 0, 2, 1]
    short = got[offsets[1] : offsets[5]].tolist()
    assert len(set(short)) == 4 and got[-1] == short[0]


def test_repeated_passages(spark):
    rng = random.Random(7)
    shared, short = words(rng, 70).split(), words(rng, 30).split()
    near = shared[:35] + ["changed"] + shared[36:]
    body = lambda n: words(rng, n).split()
    docs = {10: body(100) + shared + body(40), 20: body(5) + near + body(30), 30: body(60) + shared, 40: body(200) + short, 50: short + body(90), 60: body(120), 70: [], 80: body(10), 90: ["same"] * 500, 95: ["same"] * 300}
    rows = [(i, " ".join(w), "x", 1) for i, w in docs.items()] + [(99, None, "x", 1), (None, " ".join(docs[10]), "x", 1), (60, " ".join(docs[60]), "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, l int").repartition(3)
    got = substrings.repeated_passages(df).collect()
    spans = collections.defaultdict(set)
    for r in got:
        assert r.source_id < r.doc_id
        spans[r.doc_id].update(range(r.first_word, r.end_word))
    assert set(spans) == {20, 30, 95}
    assert spans[30] == set(range(60, 130)) and spans[20] >= set(range(10, 70)) and spans[20] <= set(range(5, 75))
    kept = substrings.drop_repeats(df, length_col=None)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == df.columns and texts[30].split() == docs[30][:60] and texts[10].split() == docs[10] and 95 not in texts and 99 in texts
    assert substrings.repeated_passages(df.limit(0)).count() == 0


def slow_good(a, b, t, least):
    """Starts of runs of a of which least tokens are in one stretch of b."""
    reach = int(t / substrings.SIMILARITY + 8) + 1
    stretches = [set(b[j : j + reach]) for j in range(len(b))]
    return [i for i in range(len(a) - t + 1) if any(sum(x in s for x in a[i : i + t]) >= least for s in stretches)]


def test_sources_that_repeat_part_of_a_passage(monkeypatch):
    rng = random.Random(11)
    passage = words(rng, 52).split()
    body = lambda n: words(rng, n).split()
    edited = passage[:10] + ["x"] + passage[11:30] + ["y"] + passage[31:]
    sources = [passage[20:27] + body(200) + passage, edited + body(300) + passage + body(9), body(5) + passage[:30] + body(150) + passage[10:] + body(150) + passage]
    hashes = lambda w: shingles.tokens_of([" ".join(w)], 5)[0]
    for b in sources:
        assert substrings.passages_within(hashes(body(70) + passage + body(70)), hashes(b), 46) == [(70, 118)]
    for at_once in (50, 1 << 21):
        monkeypatch.setattr(substrings, "AT_ONCE", at_once)
        for n in (3, 20, 60, 200):
            t, least = 12, substrings.enough(12, 0.8)
            a, b = (np.array([rng.randrange(n) for _ in range(80)], np.uint64) for _ in range(2))
            b[50:70], a[30:50] = a[10:30], a[5:25]
            order = np.argsort(b, kind="stable")
            at = order[np.minimum(np.searchsorted(b[order], a), len(b) - 1)]
            starts = np.flatnonzero(np.convolve(b[at] == a, np.ones(t, int), "valid") >= least)
            got = starts[substrings._near(a, b, order, at, b[at] == a, starts, t, least)].tolist()
            assert got == slow_good(a.tolist(), b.tolist(), t, least)


@pytest.mark.parametrize("parts", [1, 4])
def test_a_similar_document_hides_no_repeat(spark, parts):
    rng = random.Random(12)
    body = lambda n: words(rng, n).split()
    rows = []
    for i in range(40):
        passage = body(55)
        similar = passage[:18] + ["x"] + passage[19:36] + ["y"] + passage[37:]
        rows += [(k * 1000 + i, " ".join(body(30) + w + body(30))) for k, w in ((1, similar), (2, passage), (3, passage))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    got = {(r.doc_id, r.source_id): (r.first_word, r.end_word) for r in substrings.repeated_passages(df).collect()}
    assert got == {(3000 + i, 2000 + i): (30, 85) for i in range(40)}


@pytest.fixture(scope="module")
def corpus():
    """Documents with common passages of 50 words or more, some edited, and what a comparison of all pairs of runs finds."""
    rng = random.Random(14)
    passages = [words(rng, rng.randint(50, 90)).split() for _ in range(12)]
    texts = {}
    for i in range(90):
        w = words(rng, rng.randint(0, 60)).split()
        for p in rng.sample(passages, rng.choice([0, 0, 1, 1, 2])):
            p = list(p)
            for at in rng.sample(range(len(p)), rng.choice([0, 0, 0, 1, 2])):
                p[at] = "edited"
            cut = rng.choice([0, 0, 0, 30])
            w += p[cut:] + words(rng, rng.randint(5, 60)).split()
        texts[10 * i] = " ".join(w)
    t, least = 46, substrings.enough(46, 0.8)
    tokens = {i: shingles.tokens_of([x], 5)[0].tolist() for i, x in texts.items()}
    good = {i: set() for i in texts}
    for i, a in tokens.items():
        for j, b in tokens.items():
            if j < i and len(set(a) & set(b)) >= least:
                good[i].update(slow_good(a, b, t, least))
    return texts, good


def covered(rows):
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].update(range(r.first_word, r.end_word))
    return got


def hidden_behind_a_crowd(rng, holders):
    """Documents that hold looser versions of a passage, with one word in twelve edited; then the passage, and last a repeat of it with one word edited."""
    passage = words(rng, 60).split()
    texts = {}
    for i in range(holders):
        looser = [w if (j + i) % 12 else words(rng, 1) for j, w in enumerate(passage)]
        texts[i] = " ".join([words(rng, 80), *looser, words(rng, 80)])
    edited = list(passage)
    edited[30] = "edited"
    texts[holders] = " ".join([words(rng, 80), *passage, words(rng, 80)])
    texts[holders + 1] = " ".join([words(rng, 80), *edited, words(rng, 80)])
    return texts


def test_large_groups_hide_no_edited_repeat(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FEW", 3)
    rng, found, n = random.Random(31), 0, 12
    texts = {}
    for k in range(n):
        texts |= {1000 * k + i: t for i, t in hidden_behind_a_crowd(rng, 30).items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    rows = substrings.repeated_passages(df).collect()
    got = covered(rows)
    assert all(set(range(85, 135)) <= got[1000 * k + 31] for k in range(n))
    assert {(r.doc_id, r.source_id) for r in rows if r.doc_id % 1000 == 31} >= {(1000 * k + 31, 1000 * k + 30) for k in range(n)}


def test_rarest_tokens_lead_to_each_source():
    rng = np.random.default_rng(17)
    t, least = 46, substrings.enough(46, substrings.SIMILARITY)
    place, n = np.arange(46), rng.integers(2, 1000, 46)
    led = substrings.rarest_tokens(place, n, [(0, 0)], [], t)
    for _ in range(200):  # whichever tokens a source lacks, it holds one of those
        lacks = rng.choice(46, 46 - least, replace=False)
        assert set(led.tolist()) - set(lacks.tolist())
    assert len(substrings.rarest_tokens(place[: least - 1], n[: least - 1], [(0, 0)], [], t)) == 0
    assert len(substrings.rarest_tokens(place, n, [(0, 0)], [(3, 46)], t)) == 0


def test_leading_tokens_are_in_each_source():
    rng, t, few = random.Random(23), 46, 3
    least = substrings.enough(t, substrings.SIMILARITY)
    kinds = set()
    for k in range(400):
        # Stretches of one token or of many, some of which earlier documents don't hold.
        run = []
        while len(run) < t:
            run += [rng.randrange(1000) + 1000] if rng.random() < 0.5 * (k % 3) else [rng.randrange(8)] * rng.randint(1, 30)
        run = np.array(run[:t], np.int64)
        place = np.array(sorted(rng.sample(range(t), t - rng.randint(0, 4))), np.int64)
        token = run[place]
        n = np.array([(hash((int(x), k)) % 50) + (0 if k % 2 else few) + 1 for x in token], np.int64)
        led = substrings.leading_tokens(place, token, n, [(0, 0)], [], t, few)
        kinds |= {len(set(x)) for x in led}
        for _ in range(20):  # whichever tokens a source lacks, it holds all of one key
            lacks, spare = set(), len(place) - least
            for x in rng.sample(sorted(set(token.tolist())), len(set(token.tolist()))):
                if (token == x).sum() <= spare:
                    lacks.add(x)
                    spare -= (token == x).sum()
            held = set(token.tolist()) - lacks
            assert any(set(x) <= held for x in led)
    assert kinds == {1, 2, 3}


def test_near_sets_are_those_of_all_places():
    rng, reach = random.Random(29), 7
    for _ in range(100):
        place = sorted(rng.sample(range(60), 30))
        token = [rng.randrange(6) for _ in place] if rng.random() < 0.5 else sorted(rng.randrange(6) for _ in place)
        for size in (2, 3):
            want = set()
            for some in itertools.combinations(range(30), size):
                if place[some[-1]] - place[some[0]] < reach and len({token[i] for i in some}) == size:
                    x = sorted(token[i] for i in some)
                    want.add((x[0], x[1], x[-1]))
            assert substrings.near_sets(place, token, reach, size) == want


def test_frequent_lines_do_not_lead_to_all_their_documents(spark, monkeypatch):
    """Each document holds the line and a word over and over; an earlier one holds the word, none holds both."""
    monkeypatch.setattr(substrings, "FEW", 3)
    rng, n, met, stage = random.Random(37), 60, [], substrings.stage
    line, over = words(rng, 14), [words(rng, 1) for _ in range(n)]
    rows = [(i, " ".join([words(rng, 20), *[w] * 40, words(rng, 20)])) for i, w in enumerate(over)]
    rows += [(n + i, " ".join([words(rng, 20), line, *[w] * 40, words(rng, 20)])) for i, w in enumerate(over)]

    def counted(df, label):
        out = stage(df, label)
        if label == "passages-crowded":
            met.append(out.count())
        return out

    monkeypatch.setattr(substrings, "stage", counted)
    assert substrings.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).count() == 0
    assert sum(met) <= 3 * n  # each with each other: n * (n - 1) / 2 = 1770


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_passages_of_all_pairs(spark, corpus, parts):
    texts, good = corpus
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(parts)
    got = covered(substrings.repeated_passages(df).collect())
    runs = [(i, s) for i, starts in good.items() for s in starts]
    # The ends of a run that have no counterpart are left out, so its middle tells.
    found = sum(set(range(s + 10, s + 40)) <= got[i] for i, s in runs)
    assert len(runs) > 100 and found >= 0.97 * len(runs)
    assert all(good[i] for i, spans in got.items() if spans)


def test_what_is_found_does_not_depend_on_partitions(spark, corpus):
    df = spark.createDataFrame(list(corpus[0].items()), "doc_id bigint, text string")
    runs = [sorted(map(tuple, substrings.repeated_passages(df.repartition(n)).collect())) for n in (1, 3, 11)]
    assert runs[0] and runs[0] == runs[1] == runs[2]


def test_joins_by_exchange_give_the_same(spark, corpus, monkeypatch):
    df = spark.createDataFrame(list(corpus[0].items()), "doc_id bigint, text string")
    want = sorted(map(tuple, substrings.repeated_passages(df).collect())), sorted(map(tuple, substrings.drop_repeats(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert want == (sorted(map(tuple, substrings.repeated_passages(df).collect())), sorted(map(tuple, substrings.drop_repeats(df).collect())))


def test_a_passage_that_begins_twice_in_its_source(spark):
    rng = random.Random(16)
    passage = words(rng, 70).split()
    rows = [(1, " ".join(passage[:35] + words(rng, 300).split() + passage)), (2, " ".join(words(rng, 40).split() + passage + words(rng, 40).split()))]
    assert [tuple(r) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()] == [(2, 40, 110, 1)]


def test_passages_in_odd_tables(spark):
    rng = random.Random(15)
    passage, long = words(rng, 80), words(rng, 60_000)
    rows = [(1, passage, 1, "a"), (2, long + " " + passage, 2, "b"), (3, None, 3, "c"), (4, "", 4, "d"), (None, passage, 5, "e"), (5, passage, 6, "f"), (5, passage, 6, "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans int, Span_ID string")
    got = covered(substrings.repeated_passages(df.withColumn("key", F.lit(1)).withColumn("source", F.lit("s"))).collect())
    assert got == {2: set(range(60_000, 60_080)), 5: set(range(80))}
    kept = substrings.drop_repeats(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.spans, r.Span_ID, len(r.text or "")) for r in kept.collect()) == [(0, 5, "e", 479), (1, 1, "a", 479), (2, 2, "b", 360_000), (3, 3, "c", 0), (4, 4, "d", 0)]
    assert substrings.drop_repeats(df.limit(0)).count() == 0


def test_passages_as_similar_as_required_meet():
    rng = np.random.default_rng(13)
    missed = 0
    for _ in range(3000):
        x = rng.integers(0, 1 << 63, 51).astype(np.uint64)  # 41 of 46 are common: a similarity of 0.8
        missed += sum(substrings.orders(x[:46], k).min() == substrings.orders(x[5:], k).min() for k in range(substrings.HASHES)) < 2
    assert missed / 3000 < 0.005


def test_repeated_ids_are_not_repeats(spark):
    rng = random.Random(8)
    t, u = words(rng, 90), words(rng, 90)
    df = spark.createDataFrame([(5, t), (5, t), (6, u), (9, t), (9, t)], "doc_id bigint, text string")
    assert {(r.doc_id, r.source_id) for r in substrings.repeated_passages(df).collect()} == {(9, 5)}


def test_cutting():
    assert substrings.without("a b\nc  d e", [(1, 3)]) == "a d e"
    assert substrings.without("a b c", [(0, 2), (1, 3)]) == "" and substrings.without("a b", []) == "a b"


def weights(t):
    for c in "\n\r\t":
        t = t.replace(c, " ")
    return collections.Counter([w for w in t.split(" ") if w] or [""])


def jaccard(a, b):
    a, b = weights(a), weights(b)
    return sum((a & b).values()) / sum((a | b).values())


def test_weighted_sampling(spark):
    rng = random.Random(9)
    texts = {i: " ".join(rng.choice("the of and to in wort que der".split()) if rng.random() < 0.5 else words(rng, 1) for _ in range(rng.randint(20, 200))) for i in range(120)}
    texts |= {200: None, 201: "", 202: "  \n ", 203: texts[3], 204: texts[3], 205: "éa" * 33}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id bigint, text string, slot int")
    got = {r.doc_id: r for r in weighted_sampling.edited_report(df, samples=64).collect()}
    order = sorted(texts, reverse=True)
    error = []
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        same = sum(r.fingerprint[j : j + 8] == got[order[(k + 1) % len(order)]].fingerprint[j : j + 8] for j in range(0, 512, 8)) / 64
        assert r.near_next == pytest.approx(same)
        error.append(r.near_edited - jaccard(t, edited))
    assert abs(np.mean(error)) < 0.02 and np.sqrt(np.mean(np.square(error))) < 0.08
    assert got[203].fingerprint == got[204].fingerprint == got[3].fingerprint and got[203].near_next == got[200].near_edited == 1.0 or got[204].near_next == 1.0
    one = weighted_sampling.edited_report(df.where("doc_id = 5")).first()
    assert one.near_next == 1.0
    assert weighted_sampling.edited_report(df.limit(0)).count() == 0


def test_weighted_sampling_as_the_query_does_it(spark):
    rng = random.Random(10)
    texts = {i: " ".join(rng.choice("the of and to in wort que der".split()) if rng.random() < 0.5 else words(rng, 1) for _ in range(rng.randint(20, 200))) for i in range(150)}
    texts |= {300: "One\vtwo\fTHREE \u00c9", 301: "one two three \u00e9"}
    got = {r.doc_id: r for r in weighted_sampling.edited_report(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert len(got[0].fingerprint) >= 8 * 32 and got[300].fingerprint == got[301].fingerprint
    order, error = sorted(texts, reverse=True), []
    for k, i in enumerate(order):
        nxt, half = texts[order[(k + 1) % len(order)]], len(texts[i]) // 2
        if i < 300:
            error.append(got[i].near_edited - jaccard(texts[i], texts[i][: len(texts[i]) - half] + nxt[:half]))
    # One likeness of 32 samples has a standard error of 0.09 at most; documents share terms and so errors.
    assert abs(np.mean(error)) < 0.03 and np.sqrt(np.mean(np.square(error))) < 0.11
