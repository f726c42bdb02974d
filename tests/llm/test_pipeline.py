"""The whole pipeline against plain Python, and ablations over a whole table."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from livetables.llm import quality_rules, toxicity
from livetables.llm.base import ready
from livetables.session import workdir
from tests.llm.test_operators import components_of, docs_of, hits_by_hand, prose


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    return ready(spark)


def redacted(text):
    if text is None:
        return None
    spans = [("[EMAIL]", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("[IP]", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for mark, (a, b) in sorted(spans, key=lambda s: -s[1][0]):
        text = text[:a] + mark + text[b:]
    return text


def words_taken(records):
    """Of (doc_id, text, source) the words the mix takes of each document."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in records}
    sources = sorted({s for _, _, s in records}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d, _, x in records if x == s) for s in sources}
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    target, open_, rest = {}, set(sources), sum(total.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 3 * total[s] for s in full}
        rest -= sum(3 * total[s] for s in full)
        open_ -= full
    taken = {}
    for s in sources:
        before, quota = 0, int(target[s] + 0.5)
        for d in sorted((d for d, _, x in records if x == s), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d)):
            taken[d] = sum(min(max(quota - before - k * total[s], 0), size[d]) for k in range(3))
            before += size[d]
    return taken


def test_pipeline_is_its_stages_in_plain_python(spark):
    rnd = random.Random(12)
    base, item = prose(rnd, 100), prose(rnd, 40, 10**6)
    words = base.split()
    records = [(i, prose(rnd, rnd.randrange(5, 90), 10**5), rnd.choice(["a", "b", "c", None])) for i in range(40)]
    records += [(100 + i, prose(rnd, 20, 10**5) + " you idiot, stupid moron, you worthless scum", "a") for i in range(4)]                   # toxic
    records += [(200 + i, " ".join(words[:7 * i] + [f"x{i}"] + words[7 * i + 1:]), "b") for i in range(8)] + [(210, base, "c"), (211, base, "a")]   # near copies
    records += [(300, prose(rnd, 30, 10**5) + " " + item[:200], "c"), (301, item, "a"), (302, prose(rnd, 800, 10**5) + " " + " ".join(item.split()[:14]), "b")]
    records += [(400, prose(rnd, 30, 10**5) + " write to ann@mail.test or 10.1.2.3 now", "b"), (401, None, "a"), (402, "", "b"), (403, " \n", None)]
    root = workdir(spark, "tables")
    docs_of(spark, records).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")

    lexicon = toxicity.Lexicon({f" {t} ": toxicity.BASE_WEIGHT for t in toxicity.BASE_TERMS}, set(toxicity.BASE_EXCEPTIONS))
    kept = [r for r in records if lexicon.score(toxicity.accented(r[1])) < toxicity.THRESHOLD]
    assert {r[0] for r in records} - {r[0] for r in kept} == {100, 101, 102, 103}
    groups = components_of([r[:2] for r in kept], 5, 80)
    kept = [r for r, (d, n, c) in zip(kept, groups) if not n or c == d]
    hit = {d: (n, h) for d, n, h, _, _ in hits_by_hand([r[:2] for r in kept], [("1", item)], 13)}
    kept = [r for r in kept if not (hit[r[0]][1] and 20 * hit[r[0]][1] >= hit[r[0]][0])]
    assert {200, 302, 400} <= {r[0] for r in kept} and not {201, 210, 300, 301} & {r[0] for r in kept}
    kept = [(d, redacted(t), s) for d, t, s in kept]
    want = {d: (t, n) for (d, t, _), n in ((r, words_taken(kept)[r[0]]) for r in kept) if n}

    got, texts = Counter(), {}
    for r in corpus_pipeline.run(spark, root).collect():
        got[r.doc_id] += r.words
        texts[r.doc_id] = r.text
    assert {d: (texts[d], n) for d, n in got.items()} == want and "[EMAIL]" in want[400][0]


def test_ablations_of_a_whole_table(spark, sf):
    entries = quality_rules.ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    masks = [r.failures for r in entries.select("failures").collect()]
    names = [n for n, _ in quality_rules.RULES]
    for policy in quality_rules.POLICIES:
        m = quality_rules.mask(policy)
        for r in quality_rules.ablations(entries, policy).collect():
            bit = 1 << names.index(r.rule)
            assert (r.failed, r.failed_alone, r.kept, r.kept_without) == (
                sum(x & bit > 0 for x in masks), sum(x & m == bit for x in masks), sum(x & m == 0 for x in masks), sum(x & m & ~bit == 0 for x in masks))
