"""Parts of the job that a shorter way would leave out."""

import random

import numpy as np
import pytest

from livetables.llm import license_scan, near_dedup, pii, toxicity
from livetables.llm.base import ready
from tests.llm.test_operators import docs_of, prose


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    return ready(spark)


def card(number):
    digits = f"4111 1111 {number:04d} 111"
    return next(f"{digits}{i}" for i in range(10) if pii.luhn(f"{digits}{i}".replace(" ", "")))


def test_pii_discovers_the_loose_shapes_of_each_kind(spark):
    rnd = random.Random(6)
    seeds = [("my number is", lambda i: f"+1 (555) 010-{1000 + i}"), ("mail me at", lambda i: f"a{i}@b.org"), ("host is", lambda i: f"10.0.0.{i}"), ("the card was", card)]
    records = [(i, f"{prose(rnd, 5)} {context} {seed(i)} {prose(rnd, 5)}", "s") for context, seed in seeds for i in range(30)]
    wrong = next(f"4111 1111 1111 111{i}" for i in range(10) if not pii.luhn(f"411111111111111{i}"))
    long = "x" * 80 + "@localhost"
    hidden = [("my number is", "555 019 2288", "phone"), ("my number is", "(555) 010-1234", "phone"), ("mail me at", "bob@localhost", "email"), ("mail me at", long, "email"),
              ("host is", "fe80::1", "ip"), ("the card was", wrong, "card")]
    records += [(1000 + i, f"so {context} {what}, thanks", "s") for i, (context, what, _) in enumerate(hidden)]
    records += [(2000 + i, f"so we saw {what}, thanks", "s") for i, (_, what, _) in enumerate(hidden)]
    docs = docs_of(spark, records)
    found = {r.doc_id: [(s.kind, s.first, s.last) for s in r.added] for r in pii.find(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, (context, what, kind) in enumerate(hidden):
        assert found[1000 + i] == [(kind, 4 + len(context), 4 + len(context) + len(what))]
        assert clean[1000 + i] == f"so {context} [{kind.upper()}], thanks"
        assert found[2000 + i] == []


def test_toxicity_learns_beside_many_near_copies(spark):
    """Near copies of a long toxic text have more significant terms than any list of the most significant ones; so have texts with many phrases around a term."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    long, other = [word() for _ in range(700)], [word() for _ in range(1200)]
    toxic = [" ".join([*long, word()]) for _ in range(200)] + [f"{word()} {word()} zorgle {word()}" for _ in range(60)]
    clean = [" ".join(word() for _ in range(20)) for _ in range(1000)] + [" ".join(["zorgle " + w for w in other] + [word()]) for _ in range(6)]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(toxic + clean)])
    labels = spark.createDataFrame([(i, None, int(i < len(toxic))) for i in range(len(toxic + clean))], "doc_id long, quality int, toxic int")
    learned = toxicity.learn(docs, labels)
    assert " zorgle " in learned.weights and len(learned.weights) < 20
    assert {f"zorgle {w}" for w in other} | {f"{w} zorgle" for w in other[:-1]} <= learned.exceptions


def test_toxicity_without_a_significant_term(spark):
    """Labels of both kinds, but too few for any term to say something: the fixed lexicon decides, and a doc_id with many texts counts once."""
    rnd = random.Random(5)
    records = [(i, prose(rnd, 40) + (" you idiot" if i % 10 == 0 else ""), "s") for i in range(20)] + [(1, prose(rnd, 40), "s") for _ in range(30)]
    docs = docs_of(spark, records)
    labels = spark.createDataFrame([(i, None, int(i % 10 == 0)) for i in range(20)], "doc_id long, quality int, toxic int")
    learned = toxicity.learn(docs, labels)
    assert set(learned.weights) == {f" {t} " for t in toxicity.BASE_TERMS}
    assert toxicity.score(docs, learned).count() == 50 == toxicity.without_toxic(docs, learned).count() + docs.join(toxicity.score(docs, learned).filter("score >= 0.7"), "doc_id", "left_semi").count()
    assert toxicity.labelled_sample(docs, labels, "toxic", 1000).count() == labels.filter(~toxicity.held_out()).count()


def test_near_dedup_makes_pairs_in_proportion(spark, monkeypatch):
    """Texts of ten slots with ten variants each share long lists everywhere, but no two are similar: the joins must not make their pairs."""
    rnd = random.Random(11)
    variants = [[prose(rnd, 12, 10**6) for _ in range(10)] for _ in range(10)]
    made = []
    keep = near_dedup.Steps.keep

    def counted(self, df, label):
        out = keep(self, df, label)
        if label in ("candidates", "pairs"):
            made[-1] += out.count()
        return out
    monkeypatch.setattr(near_dedup.Steps, "keep", counted)
    for n in (400, 1600):
        seen = set()
        while len(seen) < n:
            t = tuple(rnd.randrange(10) for _ in range(10))
            if all(sum(x == y for x, y in zip(t, u)) < 8 for u in seen):
                seen.add(t)
        docs = docs_of(spark, [(i, " ".join(variants[k][v] for k, v in enumerate(t)), "s") for i, t in enumerate(sorted(seen))])
        made.append(0)
        got = near_dedup.near_duplicates(docs, shingle=4, list_cap=8)
        assert got.filter("kept").count() == n
    assert made[1] <= 8 * max(made[0], 200)


def test_toxicity_cover_is_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        names = [f" {'ab' * rnd.randrange(1, 3)}{i}{rnd.choice(['', ' '])}" for i in range(rnd.randrange(1, 40))]
        terms = {t: (rnd.randrange(1, 60), rnd.randrange(3)) for t in names}
        found = [np.array(sorted(rnd.sample(range(len(names)), rnd.randrange(min(6, len(names) + 1)))), np.int32) for _ in range(100)]
        left, want = {t: {d for d, f in enumerate(found) if i in f} for i, t in enumerate(names)}, []
        left = {t: d for t, d in left.items() if d}
        while left:
            best = max(left, key=lambda t: (len(left[t]) * toxicity._log_ratio(*terms[t], 100, 900), t.endswith(" "), len(t), t))
            new = left.pop(best)
            if len(new) * np.log(10) * 2 < toxicity.SIGNIFICANT:
                break
            want.append(best)
            left = {t: d - new for t, d in left.items() if d - new}
        assert toxicity._cover(found, terms, 100, 900) == want


HELD_OUT = [      # wordings that are no notice of the module, wrapped as in source files
    ("Apache-2.0", "/*\n * Licensed under the Apache License,\n * Version 2.0 (the \"License\"); you may not use this file\n * except in compliance with the License.\n */"),
    ("Apache-2.0", "# Licensed under the Apache License, Version\n# 2.0. You may not use this file except in\n# compliance with the License."),
    ("Apache-2.0", "The code is released under the Apache License 2.0."),
    ("GPL-3.0", "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n"
                "    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version."),
    ("GPL-3.0", "// Distributed under the GNU General Public\n// License, version 3 or later."),
    ("GPL-2.0", " * This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n"
                " * version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    ("LGPL-2.1", ";; This library is free software; you can redistribute it and/or\n;; modify it under the terms of the GNU Lesser General Public\n"
                 ";; License as published by the Free Software Foundation; either\n;; version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "<!-- You can redistribute it and/or modify it under the terms\n of the GNU Affero General Public License as published by the\n Free Software Foundation, version 3. -->"),
    ("MIT", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction."),
    ("MIT", "This package is released under the MIT license."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
                     "1. Redistributions of source code must retain the above copyright notice,\n   this list of conditions and the following disclaimer.\n"
                     "2. Redistributions in binary form must reproduce the above copyright\n   notice, this list of conditions and the following disclaimer in the\n   documentation."),
    ("BSD-2-Clause", "-- SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice appears in all copies."),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla\n * Public License, v. 2.0. */"),
    ("CC-BY-3.0", "The text is licensed under a Creative Commons\nAttribution 3.0 License."),
    ("CC-BY-SA-4.0", "This article is licensed under the Creative\nCommons Attribution-ShareAlike 4.0 License."),
]
FRESH = [      # written when the module was finished, and judged once
    ("Apache-2.0", "This file is part of the project and is provided to you under the\nApache License, Version 2.0."),
    ("Apache-2.0", "You may use this work under the Apache 2.0 licence."),
    ("MIT", "# This source code is licensed under the MIT license found in the\n# LICENSE file in the root directory of this source tree."),
    ("MIT", "License: MIT"),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License,\nversion 3, along with this program."),
    ("GPL-3.0", "The tool is free software, covered by the GNU GPL v3."),
    ("GPL-2.0", "dnl This file is free software; it is distributed under the\ndnl terms of the GNU General Public License version 2."),
    ("LGPL-3.0", "You can use the library under the terms of the GNU Lesser\nGeneral Public License, version 3 or later."),
    ("AGPL-3.0", "The server is available under the AGPL v3."),
    ("BSD-3-Clause", "All code here is under the 3-clause BSD license."),
    ("MPL-2.0", "Subject to the Mozilla Public\nLicense, version 2.0."),
    ("CC-BY-4.0", "Photos are published under the Creative Commons Attribution 4.0 licence."),
    ("CC-BY-NC-4.0", "You may share the text under CC BY-NC 4.0."),
    ("CC0-1.0", "The data are released into the public domain under CC0 1.0 Universal."),
]


def test_license_scan_finds_wrapped_notices_and_confirms_no_sibling_of_a_family(spark):
    rnd = random.Random(9)
    siblings = [("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
                ("GPL-2.0", license_scan.NOTICES[8][1].replace("version 3", "version 2")), ("AGPL-3.0", license_scan.NOTICES[8][1].replace("General", "Affero General")),
                ("CC-BY-3.0", "Licensed under CC BY 3.0."), ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
                ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."), ("", "Licensed under the Apache License, Version 1.1.")]
    strangers = [*license_scan.SIBLINGS, "This work is licensed under the GNU General Public License, version 1.", "Licensed under CC BY 2.5.", "Licensed under the Apache License,\nVersion 1.0.",
                 "SPDX-License-Identifier: BSD-4-Clause", "The library opens at 3 and the public is licensed to read there."]
    texts = [(i, prose(rnd, 30) + ".\n" + prose(rnd, 12), "s") for i in range(60)] + [(100 + i, t, "s") for i, (_, t) in enumerate(siblings)]
    texts += [(200 + i, t, "s") for i, (_, t) in enumerate(license_scan.NOTICES)]
    around = lambda t: prose(rnd, 20) + ".\n\n" + t + "\n\n" + prose(rnd, 20)
    texts += [(1000 + i, around(t), "s") for i, (_, t) in enumerate(HELD_OUT)] + [(1500 + i, around(t), "s") for i, (_, t) in enumerate(FRESH)]
    texts += [(2000 + i, around(t), "s") for i, t in enumerate(strangers)]
    got = {r.doc_id: (r.n_licence, r.families) for r in license_scan.licences(docs_of(spark, texts)).collect()}
    assert [got[100 + i] for i in range(len(siblings))] == [(int(f != ""), f) for f, _ in siblings]
    assert [got[200 + i] for i in range(len(license_scan.NOTICES))] == [(1, f) for f, _ in license_scan.NOTICES]
    assert [got[2000 + i] for i in range(len(strangers))] == [(0, "")] * len(strangers)
    for first, held_out, share in ((1000, HELD_OUT, 0.9), (1500, FRESH, 0.5)):
        wrong = [(f, t, got[first + i]) for i, (f, t) in enumerate(held_out) if got[first + i] != (1, f)]
        assert all(w == (0, "") for *_, w in wrong) and len(wrong) <= (1 - share) * len(held_out), wrong


def test_paragraphs_of_a_text(spark):
    text = "One line.\n * wrapped\n * header, v.\n * 2.0 of it\n *\n# Next\nno stop\r\n\n---\nLast: \nend -->"
    got = [(r["at"], r.part, " ".join(r.paragraph.split())) for r in license_scan.paragraphs(docs_of(spark, [(1, text, "s"), (2, None, "s"), (3, "", "s"), (4, " \n--\n", "s")])).collect()]
    # the line after the first one starts with a small letter, so it goes on
    assert got == [(0, 0, "One line. wrapped header, v. 2.0 of it"), (0, 1, "One line."), (0, 2, "wrapped"), (0, 3, "header, v."), (0, 4, "2.0 of it"),
                   (1, 0, "Next no stop"), (1, 1, "Next"), (1, 2, "no stop"), (2, 0, "Last: end"), (2, 1, "Last:"), (2, 2, "end")]


@pytest.mark.parametrize("n_seeds, n_hidden", [(150, 6), (40, 15)])
def test_pii_discovers_hidden_identifiers_in_contexts_of_seeds(spark, n_seeds, n_hidden):
    """Recall and precision of discovery: identifiers that miss the strict form, in contexts that seeds have, and look-alikes elsewhere. They are 7 % and 43 % of
    the places of their contexts."""
    rnd = random.Random(12)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    number = lambda: rnd.randrange(1, 255)
    seeds = {"email": lambda: f"user{digits(4)}@mail.example.org", "ip": lambda: f"10.{number()}.{number()}.{number()}",
             "card": lambda: next(c for c in iter(lambda: digits(16), None) if pii.luhn(c)), "phone": lambda: f"+1 555 {digits(3)} {digits(4)}"}
    unseen_card = lambda: next(c for c in iter(lambda: digits(16), None) if not pii.luhn(c))
    hidden = {"email": [lambda: f"user{digits(4)}@localhost", lambda: f"name{digits(2)}@intranet"], "ip": [lambda: f"fe80::{digits(2)}a{digits(1)}", lambda: f"10.{100 + number() % 150}.{100 + number() % 150}.{300 + number()}"],
              "card": [lambda: " ".join(unseen_card()[i:i + 4] for i in range(0, 16, 4)), unseen_card], "phone": [lambda: f"555 {digits(3)} {digits(4)}", lambda: f"(555) {digits(3)}-{digits(4)}"]}
    contexts = {"email": ["write me at {} any day", "my address is {} for news"], "ip": ["the host is {} right now", "login came from {} last night"],
                "card": ["charge my card {} for this", "paid with visa {} on file"], "phone": ["my number is {} call me", "dial the desk {} before noon"]}
    records, planted = [], {}
    for kind, forms in contexts.items():
        for form in forms:
            records += [(len(records) + i, f"{prose(rnd, 6)} {form.format(seeds[kind]())} {prose(rnd, 6)}", "s") for i in range(n_seeds)]
            for shape in hidden[kind]:
                for _ in range(n_hidden):
                    value = shape()
                    text = f"{prose(rnd, 6)} {form.format(value)} {prose(rnd, 6)}"
                    planted[len(records)] = (kind, text.index(value), text.index(value) + len(value))
                    records.append((len(records), text, "s"))
    clean = range(len(records), len(records) + 100)
    records += [(i, f"{prose(rnd, 6)} {rnd.choice(['order', 'part', 'isbn', 'invoice'])} {digits(3)}-{digits(3)}-{digits(4)} {prose(rnd, 6)}", "s") for i in clean]
    found = {r.doc_id: [(s.kind, s.first, s.last) for s in r.added] for r in pii.find(docs_of(spark, records)).collect()}
    caught = {k: sum(found[i] == [p] for i, p in planted.items() if p[0] == k) / sum(p[0] == k for p in planted.values()) for k in pii.KINDS}
    assert min(caught.values()) >= 0.9, (caught, [(found[i], p, records[i][1]) for i, p in planted.items() if found[i] != [p]][:8])
    assert sum(len(s) for i, s in found.items() if i not in planted) == 0


def test_pii_partial_addresses_long_words_and_later_rounds(spark):
    """Addresses of few digits count in trusted contexts only; a long neighbouring word is a context; an instance found in one context makes another one trusted, as
    often as needed; a context with a few chance seeds among many look-alikes is not trusted."""
    rnd = random.Random(9)
    long = "q" * 200
    address = lambda i: f"10.1.{i // 200}.{i % 200}"
    texts = [f"{prose(rnd, 5)} host is {address(i)} {prose(rnd, 5)}" for i in range(40)] + [f"{prose(rnd, 5)} {long} {address(i)}" for i in range(40)]
    texts += ["so host is 10.0.1 thanks", f"so {long} 10.0.2", "so version was 10.0.3 thanks"]
    chain = ["host is", "login from", "seen at", "trace to", "peer of"]      # the instances of each context are met again in the next
    for k, (here, after) in enumerate(zip(chain, chain[1:])):
        texts += [f"{prose(rnd, 5)} {context} 7.{k}.{i} {prose(rnd, 5)}" for i in range(8) for context in (here, after)]
    texts += [f"{prose(rnd, 5)} order no {seed} {prose(rnd, 5)}" for seed in [f"+1 555 010 {1000 + i}" for i in range(6)] + [f"555-010-{1000 + i}" for i in range(60)]]
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.first:s.last]) for s in r.added] for r in pii.find(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [found[i] for i in (80, 81, 82)] == [[("ip", "10.0.1")], [("ip", "10.0.2")], []]
    assert all(found[i] == [("ip", t.split()[-6])] for i, t in enumerate(texts) if 83 <= i < 83 + 64), [(found[i], texts[i]) for i in range(83, 147)]
    assert not any(found[i] for i in range(147, len(texts)))


def test_license_threshold_counts_every_part(spark):
    """Look-alikes that the sample of unknown parts does not hold are still counted by the threshold."""
    rnd = random.Random(3)
    texts = [(i, prose(rnd, 25), "s") for i in range(200)]
    like = lambda i: f"the {prose(rnd, 2)} license version of the software {prose(rnd, 1)} public permission under {prose(rnd, 2)} terms licensed copyright {prose(rnd, 1)}"
    texts += [(1000 + i, like(i), "s") for i in range(40)] + [(2000, "Released under the MIT license.", "s")]
    docs = docs_of(spark, texts)
    _, least = license_scan.fit(docs, max_unknown=5)
    model, threshold = license_scan.learn(docs, max_unknown=5)
    p = sorted(r.known for r in license_scan.score(docs.filter("doc_id < 2000"), model).collect())
    assert sum(x > least for x in p) > 0 and sum(x > threshold for x in p) == 0
