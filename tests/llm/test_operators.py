"""The text operators on small tables: brute force, hard cases, and their own promises."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from livetables.llm import decontamination, license_scan, mixing, near_dedup, pii, quality_classifier, quality_rules, repeated_passages, toxicity, url_filter
from livetables.llm import queries as q
from livetables.llm.base import ready
from tests.check import compare, duck
from tests.conftest import rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, row_key int, copy int"


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    return ready(spark)


def docs_of(spark, records):
    """(doc_id, text, source) records with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 0.5, "x", 7, 9) for i, t, s in records], DOCS)


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, copies and near copies."""
    rnd = random.Random(5)
    base = prose(rnd, 120)
    words = base.split()
    near = [" ".join(words[:k] + [f"x{i}"] + words[k + 1:]) for i, k in enumerate(rnd.sample(range(120), 12))]
    far = [" ".join("y" + str(i * 9 + j) if (j * 13 + i) % 6 == 0 else w for j, w in enumerate(words)) for i in range(4)]
    records = [(1, base, "a"), (1, base, "a"), (2, base, None), (3, None, "a"), (None, None, None), (None, base, "b"), (4, "", "b"), (5, " \n\t ", "b"),
               (6, prose(rnd, 40_000), "c"), (7, "one", "c"), (8, "one", "c"), (9, "Ü" * 700, "c"), (10, "ab" * 900, "c")]
    records += [(20 + i, t, "a") for i, t in enumerate(near)] + [(40 + i, t, "d") for i, t in enumerate(far)]
    return docs_of(spark, records)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, []).limit(0)


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components_of(records, size, percent):
    sets = [shingles(t, size) for _, t in records]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(records):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(records)]


@pytest.mark.parametrize("size,cap,star", [(4, 64, 3), (4, 2, 1), (5, 3, 0)])
def test_near_dedup_is_brute_force(spark, hard, size, cap, star, monkeypatch):
    """Also with every list a long one, and with no stars, so that all links come from the full sets."""
    monkeypatch.setattr(near_dedup, "STAR", max(star, 1))
    records = [(r.doc_id, r.text) for r in hard.collect()]
    got = near_dedup.near_duplicates(hard, shingle=size, list_cap=cap)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(components_of(records, size, 80), key=repr)


def test_near_dedup_keeps_one_row_of_each_group(spark, hard, empty):
    kept = near_dedup.without_near_copies(hard)
    assert kept.columns == hard.columns
    ids = Counter(r.doc_id for r in kept.collect())
    groups = {c for _, n, c in components_of([(r.doc_id, r.text) for r in hard.collect()], 5, 80) if n}
    assert ids == Counter(groups) + Counter([3, None, 4, 5])
    assert near_dedup.without_near_copies(empty).count() == 0 and near_dedup.near_duplicates(empty).count() == 0


def hits_by_hand(docs, items, window):
    cut = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))]
    patterns = {(i, tuple(w[k:k + min(window, len(w))])) for i, t in items for w in [cut(t)] if w for k in range(len(w) - min(window, len(w)) + 1)}
    out = []
    for d, t in docs:
        w, hit, ids = cut(t), set(), set()
        for i, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    ids.add(i)
        out.append((d, len(w), len(hit), len(ids), sorted(x for x in ids if x)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [10_000, 7])
def test_decontamination_is_brute_force(spark, hard, empty, most):
    rnd = random.Random(2)
    known = prose(rnd, 30, 50)
    items = [(1, known), (1, known), (2, "One!"), (3, None), (4, ""), (None, "two words"), (5, known[:60]), (6, "Ünï-cødé w7")]
    records = [(100, f"A b {known} c"), (101, known[10:]), (102, "two, WORDS"), (103, "x " * 100 + "one"), (104, "ünï cødé w7"), (None, known), (100, f"A b {known} c")]
    docs = docs_of(spark, [(d, t, "s") for d, t in records]).unionByName(hard.filter("doc_id <> 6"))
    got = decontamination.find_hits(docs, spark.createDataFrame(items, "item_id long, text string"), window=13, max_patterns=most)
    want = hits_by_hand([(r.doc_id, r.text) for r in docs.collect()], [(None if i is None else str(i), t) for i, t in items], 13)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "item_ids") == want
    clean = decontamination.without_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), max_patterns=most)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((d for d, n, h, _, _ in want if not (h and 20 * h >= n)), key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_hits(hard, none).filter("n_hit > 0").count() == 0
    assert decontamination.find_hits(empty, none).count() == 0


def test_url_globs_and_rules(spark):
    machine = url_filter.Automaton(["*.a.b/x**", "*spam*/**", "**end", "*" + "q" * 200 + "*"])
    texts = [b".a.b/x", b".z.a.b/xyz/1", b".za.b/x", b".x/.a.b/x", b".spam.c/", b".c/spam/", b".c/the/end", b"", b"q" * 200, b"." + b"q" * 300]
    assert machine.match(texts).astype(int).tolist() == [
        [1, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [0, 0, 0, 1], [0, 0, 0, 1]]
    urls = [(1, "https://WWW.Example.org/en/12?x=/es/", "example.org/en/1", "block"), (2, "http://example.org/de/", "org/", "allow"), (3, "x://a.com/fr/#t", "com/fr/", "allow"),
            (4, "x://com/de/", "com/de/", "block"), (5, "x://acom/de/", None, "allow"), (6, "no scheme/org/", None, "allow"), (7, None, None, "allow"), (None, "", None, "allow"),
            (8, "x://m.free-bets.net", None, "block"), (9, "x://a.net/p://b.org/", None, "allow"), (10, "x://b.org?a", None, "allow"), (11, "x://a.net/" + "y" * 9000, None, "allow")]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u, _, _ in urls], "page_id long, url string, host string, verdict string")
    assert rows(url_filter.judge(pages), "page_id", "rule", "verdict") == sorted([(i, r, v) for i, _, r, v in urls], key=repr)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_quality_classifier(spark, hard, empty):
    rnd = random.Random(1)
    records = [(i, prose(rnd, 80) if i % 4 else "&&& ### " * 40, "s") for i in range(300)]
    docs = docs_of(spark, records)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), None) for i, _, _ in records] + [(1, None, 1), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 != 0) for i, _, _ in records)
    again = {r.doc_id: r.score for r in quality_classifier.score(docs, quality_classifier.learn(docs, labels)).collect()}
    assert again == got
    assert quality_classifier.score(hard, model).filter("score BETWEEN 0 AND 1").count() == hard.count()
    assert quality_classifier.learn(docs, labels.limit(0)) is None and quality_classifier.score(empty, None).count() == 0
    points = quality_classifier.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 0, 1]))
    assert (np.diff(points, axis=0) >= 0).all()


def test_toxicity(spark, hard, empty):
    assert toxicity.fold("1d10t! ІDІОТ $cum$ Ünï tr@sh 2024 &&&") == ["idiot", "idiot", "cum", "uni", "trash"]
    lexicon = toxicity.Lexicon({" trash ": 5.0, " clow": 4.0}, {"trash can"})
    assert [t for _, t, _ in lexicon.hits(toxicity.fold("the trash can and a CL0WN, trash trashed"))] == [" clow", " trash "]
    accents = toxicity.Lexicon({" réeux": 2.0, " clow": 4.0})
    words = toxicity.accented("Réeuxpa reeuxpa CLÓWN clown re\u0301euxa")
    assert [(i, t) for i, t, _ in accents.hits(words)] == [(0, " réeux"), (2, " clow"), (3, " clow"), (4, " réeux")]
    assert {" réeu", " reeu"} <= toxicity.features(words)
    rnd = random.Random(4)
    bad = lambda: " ".join(rnd.choice(["zorgle", "zorglon"]) if rnd.random() < 0.1 else w for w in prose(rnd, 60).split()) + " zorgle"
    records = [(i, bad() if i % 5 == 0 else prose(rnd, 60), "s") for i in range(600)]
    docs = docs_of(spark, records)
    labels = spark.createDataFrame([(i, None, int(i % 5 == 0)) for i, _, _ in records] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    learned = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, learned).collect()}
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i, _, _ in records)
    kept = toxicity.without_toxic(docs.unionByName(hard), learned)
    assert kept.columns == docs.columns and kept.count() == 480 + hard.count()
    plain = toxicity.learn(docs, labels.limit(0))
    assert plain.score(["you", "idiot"]) > 0.7 > plain.score(["you"]) and toxicity.score(empty, plain).count() == 0


def test_pii_base_spans_are_the_patterns(spark):
    def by_hand(t):
        out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
        return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    rnd = random.Random(3)
    for _ in range(20_000):
        t = "".join(rnd.choice("ab1234567890..@@-+ ()%_\né") for _ in range(rnd.randrange(40)))
        assert pii.base_spans(t) == by_hand(t)
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]


def test_pii_bootstraps_from_contexts(spark, hard, empty):
    rnd = random.Random(6)
    records = [(i, f"{prose(rnd, 5)} my number is +1 (555) 010-{1000 + i} {prose(rnd, 5)}", "s") for i in range(30)]
    records += [(100, "call, my number is 555-0199-22 thanks", "s"), (101, "the order 555-0199-23 was late", "s"), (None, None, None), (102, "my number is 555-0199-22", "s")]
    found = {r.doc_id: [(s.kind, s.first, s.last) for s in r.added] for r in pii.find(docs_of(spark, records)).collect()}
    assert found[100] == [("phone", 19, 30)] and found[102] == [("phone", 13, 24)] and found[101] == [] and found[None] == []
    clean = {r.doc_id: r.text for r in pii.redact(docs_of(spark, records)).collect()}
    assert clean[100] == "call, my number is [PHONE] thanks" and "[PHONE]" in clean[3] and clean[101].endswith("late") and clean[None] is None
    same = pii.redact(hard)
    assert same.columns == hard.columns and rows(same, "doc_id", "text") == rows(hard, "doc_id", "text")
    assert pii.redact(empty).count() == 0 and pii.find(empty).count() == 0


def passages_by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_repeated_passages_are_brute_force(spark, hard, empty):
    rnd = random.Random(8)
    passage = prose(rnd, 60)
    records = [(200 + i, prose(rnd, rnd.randrange(60)) + " " + passage[rnd.randrange(20):len(passage) - rnd.randrange(20)] + " é" + prose(rnd, rnd.randrange(40)), "s") for i in range(12)]
    docs = hard.filter("doc_id IS NULL OR doc_id <> 6").unionByName(docs_of(spark, records))
    texts = docs.select("doc_id", "text").collect()
    got = repeated_passages.remove_repeats(docs, length=200).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha"))
    assert rows(got) == sorted([(r.doc_id, *w) for r, w in zip(texts, passages_by_hand([r.text for r in texts], 200))], key=repr)
    short = repeated_passages.remove_repeats(docs, length=50, seed=16, block=4).select("doc_id", "n_removed")
    assert rows(short) == sorted([(r.doc_id, w[1]) for r, w in zip(texts, passages_by_hand([r.text for r in texts], 50))], key=repr)
    assert repeated_passages.remove_repeats(empty).count() == 0


def test_mixing(spark, hard, empty):
    got = mixing.allocate(hard).collect()
    assert len(got) == hard.count()
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies) and all(0 <= c.position <= 1 for c in r.copies)
        by.setdefault(r.source, []).append(r)
    assert abs(sum(v[0].target for v in by.values()) - sum(r.size for r in got)) < 1e-6
    assert all(sum(r.taken for r in v) == int(v[0].target + 0.5) for v in by.values())
    mixed = mixing.mix(hard)
    assert mixed.columns[:len(hard.columns)] == hard.columns and sum(r.words for r in mixed.collect()) == sum(r.taken for r in got)
    order = [r.position for r in mixed.collect()]
    assert order == sorted(order)
    assert mixing.mix(empty).count() == 0 and mixing.allocate(empty).count() == 0
    schedule = [(0.0, 0.5), (0.4, 1.0), (1.0, 2.0)]
    times = [spark.range(1).select(mixing.time_of(F.lit(u), schedule).alias("t")).first().t for u in (0.0, 0.2, 0.7, 1.0)]
    done = lambda t: sum((min(t, b) - a) * (ra + ra + (rb - ra) * (min(t, b) - a) / (b - a)) / 2 for (a, ra), (b, rb) in zip(schedule, schedule[1:]) if t > a)
    assert all(abs(done(t) / done(1.0) - u) < 1e-9 for t, u in zip(times, (0.0, 0.2, 0.7, 1.0)))


def test_license_scan(spark, hard, empty):
    rnd = random.Random(9)
    texts = [(i, prose(rnd, 30) + "\n" + prose(rnd, 12), "s") for i in range(60)]
    texts += [(100, prose(rnd, 20) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(rnd, 9), "s"), (101, "released under the MIT license", "s"),
              (102, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "s"), (103, "the committee licensed the public version of work 3", "s")]
    got = {r.doc_id: (r.n_licence, r.families) for r in license_scan.licences(docs_of(spark, texts)).collect()}
    assert got[100] == (1, "Apache-2.0") and got[101] == (1, "MIT") and got[102] == (2, "CC-BY-NC-4.0,GPL-3.0") and got[103] == (0, "")
    assert all(got[i] == (0, "") for i in range(60))
    model, threshold = license_scan.learn(docs_of(spark, texts))
    assert license_scan.scan(hard, model, threshold).filter("confirmed").count() == 0
    assert license_scan.licences(hard).count() == hard.count() and license_scan.licences(empty).count() == 0


def test_quality_rules(spark, hard, empty):
    entries = quality_rules.ledger(hard)
    for r, t in zip(entries.collect(), [r.text or "" for r in hard.collect()]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        count = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars) == (len(w), len(covered), len(lines) - len(set(lines)), sum(map(len, w)))
    for policy in quality_rules.POLICIES:
        kept = quality_rules.apply_policy(entries, policy).filter("kept").count()
        table = quality_rules.ablations(entries, policy).collect()
        assert {r.rule for r in table} == set(quality_rules.POLICIES[policy]) and all(r.kept == kept and r.kept_without == kept + r.failed_alone for r in table)
    assert quality_rules.ledger(empty).count() == 0 and all(r.kept == 0 for r in quality_rules.ablations(quality_rules.ledger(empty), "v2").collect())
    assert quality_rules.rule_overlap(entries, "n_lines").count() > 0


def test_pipeline_stages(spark, hard, empty, sf):
    """Each stage against what it says it does, on its own input."""
    docs = hard
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[:len(docs.columns)] == docs.columns
        if name != "mixing":
            assert out.columns == docs.columns
        none = stage(spark, empty, sf)
        assert none.count() == 0
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert {r.doc_id for r in docs.collect()} <= {1, 6, 7, 9, 10, 40, 41, 42, 43}


@pytest.mark.parametrize("name,label,size", [("op3_quality_classifier", "quality", "sf0.01"), ("op5_toxicity", "toxic", "sf0.1")])
def test_held_out_accuracy(spark, name, label, size):
    """Over whole tables: a held-out row of label 1 scores above one of label 0 in at least 90 % of all such pairs.

    sf0.01 has too few toxic rows for the insults of each language to be significant (0.89 there).
    """
    sf = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(F.col(label).isNotNull()).select("doc_id", label)
    got = q.QUERIES[name](spark, sf).filter("held_out").join(labels, "doc_id").select("score", label).collect()
    high, low = [r.score for r in got if r[label]], [r.score for r in got if not r[label]]
    assert len(high) > 5 and len(low) > 5
    assert sum((x > y) + (x == y) / 2 for x in high for y in low) >= 0.9 * len(high) * len(low)


def test_repeated_passages_query_is_brute_force(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = q.QUERIES["op7_repeated_passages"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(got) == sorted([(r.doc_id, *w) for r, w in zip(texts, passages_by_hand([r.text for r in texts], 200))], key=repr)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_queries(spark, sf, name):
    got = q.QUERIES[name](spark, sf)
    if name in q.ORACLES:
        assert compare(name, got, duck(sf), q.ORACLES[name]) is None
    else:
        assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
