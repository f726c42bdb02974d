"""Ranked search, source divergence and substring dedup against brute force on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from livetables.llm import dual_tree_search, source_divergence, substring_dedup
from livetables.llm.base import ready
from tests.conftest import rows
from tests.llm.test_operators import docs_of, empty, hard, prose  # noqa: F401  (fixtures)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    return ready(spark)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats_by_hand(records, window):
    key = lambda d: math.inf if d is None else d
    least = {}
    for d, t in records:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            least[g] = min(least.get(g, math.inf), key(d))
    out = []
    for d, t in records:
        w = words_of(t)
        gone = {i + j for i in range(len(w) - window + 1) if least[tuple(w[i:i + window])] < key(d) for j in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,bucket", [(50, 4 << 20), (7, 1 << 12)])
def test_substring_dedup_is_brute_force(spark, hard, empty, window, bucket, monkeypatch):  # noqa: F811
    """Passages at any offset, in chains of documents, at ends, within one document only, around the least length; also with many buckets."""
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    rnd = random.Random(window)
    passage = prose(rnd, 140, 10**6).split()
    records = []
    for i in range(60):
        a = rnd.randrange(90)
        part = passage[a:a + rnd.choice([window - 1, window, window + 1, 2 * window, 140])]
        between = rnd.choice([" ", "\n", " \t "])
        records.append((300 + rnd.randrange(40), prose(rnd, rnd.randrange(60), 10**6) + between + between.join(part) + rnd.choice(["", " " + prose(rnd, rnd.randrange(30), 10**6)]), "s"))
    own = prose(rnd, 60, 10**6)
    records += [(400, own + " x " + own, "s"), (401, " ".join(["a"] * 300), "s"), (402, " ".join(["a"] * 200) + " b", "s"), (403, "É" + " é" * 120, "s"), (404, "é" * 3 + " é" * 119, "s"), (405, "".join(passage), "s")]
    docs = hard.unionByName(docs_of(spark, records))
    got = substring_dedup.remove_repeats(docs, window=window)
    want = repeats_by_hand([(r.doc_id, r.text) for r in docs.collect()], window)
    found = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=repr) == want
    assert any(n for _, _, n, _ in want) and all(sum(s.last - s.first for s in r.spans) == r.n_removed for r in found)
    assert all(s.last < t.first for r in found for s, t in zip(r.spans, r.spans[1:]))
    if window == 50:
        assert substring_dedup.remove_repeats(empty).count() == 0


def test_pointer_sort():
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"ab\xc3") for _ in range(rnd.choice([1, 2, 7, 8, 9, 16, 17, 30]))) for _ in range(3000)] + [b"a" * 24] * 500
    rnd.shuffle(words)
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    pointers = source_divergence.Pointers(data, end - np.array([len(w) for w in words]), end)
    for small in (1 << 15, 40):
        source_divergence.SMALL, before = small, source_divergence.SMALL
        order, first = pointers.sort()
        source_divergence.SMALL = before
        assert order.tolist() == sorted(range(len(words)), key=lambda i: (words[i], i))
        assert first.tolist() == [i == 0 or words[order[i]] != words[order[i - 1]] for i in range(len(words))]


def audit_by_hand(records, min_docs, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, t in records:
        lang, source, w = lang or "", source or "", terms(t)
        groups[lang].add(source)
        docs[lang].update(set(w))
        count[lang, source].update(w)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        share = {}
        for s in [*sources, None]:
            c = sum((count[lang, x] for x in sources), Counter()) if s is None else count[lang, s]
            n = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(f(share[s][t], share[None][t]), t) for t in kept if count[lang, s][t] and share[s][t] > share[None][t]]
            for part, items in (("pair", pairs), ("term", own)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out, key=repr)


def test_source_divergence_is_brute_force(spark, empty):  # noqa: F811
    """Nulls in every column, sources without terms, languages without kept terms, lone sources, clashing column names, several shards."""
    rnd = random.Random(7)
    records = [(rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "é", None, "zz"]), prose(rnd, rnd.randrange(60), 40).replace("w", rnd.choice("wWÄé"))) for _ in range(150)]
    records += [("en", "blank", None), ("en", "blank2", " 123 "), ("xx", "one", "alone here"), ("yy", "p", "few"), ("yy", "q", "few terms"), (None, None, None), ("en", "a", "x" * 40_000)]
    docs = spark.createDataFrame([(l, s, t, 1, "x", 2, 3) for l, s, t in records], "lang string, source string, text string, doc_id long, term string, n int, rank int").repartition(3)
    got = source_divergence.audit(docs, min_docs=5, top=4)
    assert rows(got, "lang", "source", "part", "item", "value", "rank") == audit_by_hand(records, 5, 4)
    assert source_divergence.audit(empty).count() == 0


def test_pair_sums_in_slices(monkeypatch):
    """A term with many sources is worked on in slices."""
    rnd = random.Random(4)
    cells = [[{"g": g, "p": rnd.randrange(1, 10**6), "z": 5 + g} for g in sorted(rnd.sample(range(30), rnd.randrange(1, 30)))] for _ in range(50)]
    batch = pa.record_batch({"cells": pa.array(cells, pa.list_(pa.struct([("g", pa.int64()), ("p", pa.int64()), ("z", pa.int64())])))})
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = Counter()
    for term in cells:
        for i, x in enumerate(term):
            for y in term[i + 1:]:
                want[x["g"], y["g"]] += f(x["p"], y["p"]) - f(x["p"], y["z"]) - f(x["z"], y["p"]) + f(x["z"], y["z"])
    for most in (1 << 21, 40, 3):
        monkeypatch.setattr(source_divergence, "PAIRS", most)
        got = Counter()
        for out in source_divergence._pair_sums(iter([batch.slice(0, 20), batch.slice(20)])):
            for r in out.to_pylist():
                got[r["a"], r["b"]] += r["value"]
        assert got == want


def ranked_by_hand(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counts = [(d, Counter(cut(t))) for d, t in docs if cut(t)]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for d, c in counts:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def test_ranked_search_is_brute_force(spark, hard, empty, monkeypatch):  # noqa: F811
    """Ties by doc_id, repeated rows and items, nulls, items without terms or results, several blocks, and node sizes that prune at every level."""
    rnd = random.Random(3)
    records = [(500 + i, prose(rnd, rnd.choice([3, 20, 80]), 30 if i % 2 else 3000), "s") for i in range(400)] + [(2000 - i, "Tie w1 w2", "s") for i in range(30)] + [(None, "tie w1 w2", "s")]
    docs = hard.unionByName(docs_of(spark, records)).repartition(3)
    items = [(i, prose(rnd, rnd.randrange(1, 12), 60)) for i in range(40)] + [(100, "TIE"), (100, "TIE"), (101, None), (102, " ... "), (103, "nowhere"), (None, "w1 w3"), (104, "W1 tie É"), (104, "w5")]
    item_table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    want = ranked_by_hand([(r.doc_id, r.text) for r in docs.collect()], items, 10)
    assert rows(dual_tree_search.search(docs, item_table), "item_id", "rank", "doc_id", "score") == want
    assert rows(dual_tree_search.search(docs, item_table, k=10, block_items=12), "item_id", "rank", "doc_id", "score") == want
    assert dual_tree_search.search(empty, item_table).count() == 0 and dual_tree_search.search(docs, item_table.limit(0)).count() == 0


def test_dual_tree_prunes():
    """Most pairs of a batch go in whole nodes once the best are known, and what stays holds the best."""
    rnd = np.random.default_rng(1)
    n, terms = 2048, 400
    weight = rnd.integers(1, 9000, terms)
    node = np.repeat(np.arange(n), 12)
    term = np.sort(np.concatenate([rnd.choice(terms, 12, replace=False) for _ in range(n)]).reshape(n, 12), axis=1)
    term = term[np.argsort(term[:, 0], kind="stable")].ravel()
    value = rnd.integers(1, 10**6, len(term))
    lists = [np.sort(rnd.choice(terms, 4, replace=False)) for _ in range(64)]
    items = dual_tree_search.Items(np.arange(64), np.arange(0, 257, 4), np.concatenate(lists), weight)
    docs = dual_tree_search.Level(node, term, value, n)
    best = dual_tree_search.Best(64, 10)
    dual_tree_search.search_batch(items, best, docs, np.arange(n), np.zeros(n, bool))
    scored = dual_tree_search.search_batch(items, best, docs, np.arange(n) + n, np.zeros(n, bool))
    assert scored < 64 * n / 2
    for i, mine in enumerate(lists):
        exact = np.zeros(n, np.int64)
        some = np.isin(term, mine)
        np.add.at(exact, node[some], (value * weight[term])[some])
        assert sorted(best.score[i].tolist()) == sorted(np.repeat(exact[exact > 0], 2).tolist())[-10:]
