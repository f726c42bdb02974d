"""Licence scans: a trained paragraph classifier over sparse word n-grams, confirmed by comparison with templates.

A paragraph ends at a blank line, a record separator, and at the end of a line that closes a sentence (a full stop, at most 16 signs after it), unless the next line goes on with a small letter or a
number. Comment signs at the ends of lines are blanks, so a wrapped header in a comment is one paragraph. A paragraph of several lines is
judged as a whole, and each of its lines alone: a notice may stand between lines without full stops. These are its ``parts``; a paragraph
counts once. A notice that is wrapped amid other words of one unbroken paragraph may be too thin in it to be found.

Each part becomes its words and pairs of neighbouring words, hashed into a sparse vector; multinomial logistic regression tells the licence
families and an unknown class apart. It is fitted on the notices below, each in ``VARIANTS`` versions with some words left out. The unknown
class has the notices of licences that are no family (``SIBLINGS``), in versions too, and a bounded sample of the corpus' own distinct
parts (``max_unknown`` parts of ``max_unknown`` different texts, in the order of a hash) that share little with any notice (what shares more may be a fragment of one). The
unknown class is calibrated: a family, the likeliest, counts only where all families together are above the probability that all but ``FALSE_SHARE`` of all parts of the corpus
stay below (those that share much with a notice aside; counted in the pass that scores them, not in a sample), and all but ``SIBLING_SHARE`` of the siblings' versions held back, which the marks refuse in any case.
Last, the word pairs are compared with the notices of the family: ``CONFIRM`` of the pairs of the shorter one must be in both
(a line of several must itself hold so much of a notice: it may be a fragment that other licences share), and the part must have what tells the family from its siblings, and nothing that belongs to one of those (``MARKS``).

Everything runs as built-in functions and Spark's own ML estimators; nothing is collected but the threshold. Documents are
exploded into parts where they are read and only parts with a family are grouped, so hot sources cost nothing extra.

Null and empty texts have no paragraphs and no licence. Repeated rows get a row each. Without documents the result is empty. Columns
beyond the two named are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from livetables.llm.base import Steps, row_key
from livetables.llm.quality_rules import _let

UNKNOWN = "unknown"
# fixed values: notices of licence families
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "This project is available under the terms of the Apache 2.0 license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
            "in all copies or substantial portions of the Software."),
    ("MIT", "Distributed under the terms of the MIT license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "Released under the GPLv2."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "Released under the GPLv3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
                 "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
                 "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
                     "and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Released under the Simplified BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
                     "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."),
    ("ISC", "Released under the ISC License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
                "https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
]
# fixed values: notices of licences that are no family
SIBLINGS = [
    "Licensed under the Apache License, Version 1.1.",
    "SPDX-License-Identifier: MIT-0",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 1.",
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the EUPL, Version 1.2 or later; you may not use this work except in compliance with the Licence.",
    "This work is licensed under a Creative Commons Attribution 2.5 Generic License.",
    "Licensed under CC BY 2.0.",
    "Use of this software is governed by the Business Source License included in the LICENSE file.",
    "Licensed under the Boost Software License, Version 1.0.",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement.",
    "Copyright, all rights reserved. No part of this work may be reproduced or distributed without written permission.",
    "A license is required to drive a car on public roads.",
]
FAMILIES = [UNKNOWN, *sorted({f for f, _ in NOTICES})]
_attribution = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
# fixed values: names of the families, those of Creative Commons by rule, and of licences that are no family
NAMES = {
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0"],
    "MIT": ["MIT License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
} | {f: [f"Creative Commons {'-'.join(_attribution[t] for t in f.split('-')[1:-1])} {f[-3:]} License", f"CC {f[3:-4]} {f[-3:]}"] for f in FAMILIES if f.startswith("CC-")}
OTHER_NAMES = ["Apache License, Version 1.1", "GNU General Public License, version 1", "Eclipse Public License 2.0", "Mozilla Public License 1.1", "Artistic License 2.0",
               "Boost Software License 1.0", "European Union Public Licence 1.2", "Creative Commons Attribution 2.5 License", "BSD 4-Clause License", "Open Font License 1.1"]
WORDINGS = ["Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "This work is licensed under the {}."]
NOTICES += [(f, w.format(n)) for f, names in NAMES.items() for n in names for w in WORDINGS]
SIBLINGS += [w.format(n) for n in OTHER_NAMES for w in WORDINGS]
NOTICES += [(f, f"SPDX-License-Identifier: {f}{end}") for f in FAMILIES[1:] for end in (("", "-only", "-or-later") if "GPL" in f else ("",))]
NOTICES = list(dict.fromkeys(NOTICES))
VARIANTS = 30
FEATURES = 1 << 14
MAX_UNKNOWN = 5_000
FALSE_SHARE = 0.001
SIBLING_SHARE = 0.1
CONFIRM = 0.6
_two, _four = r"(?<![\d.])2(?:\.0)?(?!\.?\d)", r"(?<![\d.])4\.0(?!\.?\d)"
_version = r"(?:\bversion|\bv\.?|gplv|gpl-?|licen[sc]e,?)\s*{}(?!\.?\d)"
_v2, _v21, _v3 = _version.format(r"2(?:\.0)?"), _version.format(r"2\.1"), _version.format(r"3(?:\.0)?")
_other_gpl = r"affero|lesser|library general|\b[al]gpl"
# fixed values: per family, patterns that a lower-cased part must all have, and one that it must not have
MARKS = {
    "Apache-2.0": (["apache", _two], None),
    "MIT": ([r"\bmit\b|permission is hereby granted"], r"\bmit-0\b"),
    "GPL-2.0": ([_v2, r"gpl|general public"], f"{_v3}|{_other_gpl}"),
    "GPL-3.0": ([_v3, r"gpl|general public"], f"{_v2}|{_other_gpl}"),
    "LGPL-2.1": ([_v21, r"lesser|\blgpl"], f"affero|{_v2}|{_v3}"),
    "LGPL-3.0": ([_v3, r"lesser|\blgpl"], f"affero|{_v2}|{_v21}"),
    "AGPL-3.0": ([_v3, r"affero|\bagpl"], r"lesser|\blgpl"),
    "BSD-2-Clause": ([r"\b(?:2|two)-clause|\bbsd-2|simplified bsd|reproduce the above"], r"neither the name|all advertising|\b(?:[134]|one|three|four)-clause|\bbsd-[134]|\b0bsd"),
    "BSD-3-Clause": ([r"\bbsd\b|redistribution"], r"all advertising|\b(?:[124]|one|two|four)-clause|\bbsd-[124]|\b0bsd|simplified bsd|^(?=[\s\S]*reproduce the above)(?![\s\S]*neither the name)"),
    "ISC": ([r"\bisc\b|permission to use, copy, modify, and(?:/or)? distribute"], None),
    "MPL-2.0": ([_two, r"mozilla|\bmpl"], None),
    "CC0-1.0": ([r"cc0|commons zero|public domain|waived all copyright"], None),
}
_terms = {"SA": r"\bsa\b|share-?alike", "NC": r"\bnc\b|non-?commercial", "ND": r"\bnd\b|no-?deriv"}
for _name in FAMILIES:
    if _name.startswith("CC-BY-"):
        _number = _four if _name.endswith("4.0") else _four.replace("4", "3", 1)
        MARKS[_name] = ([_number, *(p for t, p in _terms.items() if f"-{t}-" in _name)], "|".join(p for t, p in _terms.items() if f"-{t}-" not in _name) or None)
_telling = r"[0-9-]|^(?:apache|mit|bsd|isc|affero|lesser|[al]?gpl|mozilla|mpl|eclipse|eupl|boost|business|artistic|font|european|creative|attribution|cc0|advertising|reserved|simplified)"
# signs of comments at the starts and ends of lines, and the end of a line that closes a sentence; each begins with a plain character, so that few places are tried
_starts = r"\n[ \t]*+(?:/\*++|\*++/?|//++!?|#++|--++|;++|%++|<!--|\.\.(?=\s)|dnl\b|(?i:rem)\b)?[ \t]*+"
_ends = r"[*-]++[/>][ \t]*+(?=\n|\z)"
_closed = r"\n(?:\n++|(?<=[.!?:。！？][^\p{L}\p{N}\n]{0,16}\n)(?![\p{Ll}\p{N}]))"


def words_of(paragraph: Column) -> Column:
    """Lower-cased words; signs within a word that tell licences apart stay (``by-nc``, ``4.0``)."""
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"[\p{L}\p{N}](?:[\p{L}\p{N}.+-]*[\p{L}\p{N}])?"), F.lit(0))


def _neighbours(words: Column) -> Column:
    others = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, others), F.slice(words, 2, others), lambda a, b: F.concat(a, F.lit(" "), b))


def pairs_of(paragraph: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    return F.array_distinct(_let(words_of(paragraph), _neighbours))


def grams_of(paragraph: Column) -> Column:
    """Words and pairs of neighbouring words."""
    return _let(words_of(paragraph), lambda w: F.concat(w, _neighbours(w)))


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(NOTICES)], "notice int, family string, text string")


def _notice_pairs(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """The word pairs of each of the notices above."""
    return [(r.family, list(r.pairs)) for r in notices(spark).select("family", pairs_of(F.col("text")).alias("pairs")).collect()]


def likeness(pairs: Column, known: list[tuple[str, list[str]]], family: Column | None = None, holds: Column | None = None) -> Column:
    """Largest share of word pairs in common with a notice (of the family), by the shorter of the two, or by the notice if it must be held whole (``holds``)."""
    literal = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, p)).alias("pairs")) for f, p in known])
    shorter = lambda p, n: F.least(F.size(p), F.size(n))
    size = shorter if holds is None else lambda p, n: F.when(holds, F.size(n)).otherwise(shorter(p, n))
    share = lambda p, n: F.size(F.array_intersect(p, n["pairs"])) / F.greatest(size(p, n["pairs"]), F.lit(1))
    of_family = lambda n, x: x if family is None else F.when(n["family"] == family, x).otherwise(0.0)
    # bound once: the pairs would otherwise be worked out again for each notice
    return _let(pairs, lambda p: F.array_max(F.transform(literal, lambda n: of_family(n, share(p, n)))))


def has_marks(paragraph: Column, family: Column) -> Column:
    """The paragraph has all that the family must have to be told from its siblings, and nothing of theirs."""
    text, out = F.lower(paragraph), F.lit(False)
    for name, (must, never) in MARKS.items():
        here = F.lit(True) if never is None else ~text.rlike(never)
        for pattern in must:
            here = here & text.rlike(pattern)
        out = F.when(family == name, here).otherwise(out)
    return out


def _split(text: Column) -> Column:
    """The paragraphs of a text that have a word, their lines without comment signs."""
    unix = F.concat(F.lit("\n"), F.replace(text, F.lit("\r\n"), F.lit("\n")))
    begun = F.regexp_replace(unix, _starts, "\n")
    ended = _let(begun, lambda t: F.when(F.contains(t, F.lit("*/")) | F.contains(t, F.lit("-->")), F.regexp_replace(t, _ends, "")).otherwise(t))
    return F.filter(F.split(F.regexp_replace(ended, _closed, "\x1e"), "\x1e"), lambda p: p.rlike(r"[\p{L}\p{N}]"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row_key, at, part, paragraph): paragraphs by their place, whole (part 0), and the lines of those that have several."""
    whole = docs.select(row_key("doc_id", "text").alias("row_key"), F.posexplode(_split(F.col("text"))).alias("at", "p")) \
        .withColumn("p", F.btrim("p", F.lit("\n")))
    lines = F.split("p", "\n")
    parts = F.when(F.contains("p", F.lit("\n")), F.concat(F.array(F.translate("p", "\n", " ")), lines)).otherwise(F.array("p"))
    return whole.select("row_key", "at", F.posexplode(parts).alias("part", "paragraph")).filter(F.col("paragraph").rlike(r"[\p{L}\p{N}]"))


def _examples(steps: Steps, docs: DataFrame, known: list, max_unknown: int) -> DataFrame:
    """(family, grams, held, sibling): training examples, and those held back to calibrate."""
    spark = docs.sparkSession
    named = notices(spark).unionByName(spark.createDataFrame([(-1 - i, UNKNOWN, t) for i, t in enumerate(SIBLINGS)], "notice int, family string, text string"))
    versions = named.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(VARIANTS - 1).cast("long"))))
    # a version without the word that tells its licence from the siblings would be an example of both
    left_out = lambda w: F.filter(w, lambda x, i: (F.col("id") == 0) | x.rlike(_telling) | (F.pmod(F.xxhash64(F.col("notice"), F.col("id"), i), F.lit(10)) >= 2))
    known_rows = versions.select("family", F.array_join(left_out(words_of(F.col("text"))), " ").alias("text"), (F.col("id") % 5 == 4).alias("held"), (F.col("family") == UNKNOWN).alias("sibling"))
    # only hashes are shuffled to choose the sample; its bound makes the list of them small enough to broadcast
    of_text = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).filter("text IS NOT NULL")
    chosen = steps.keep(of_text.select("t").distinct().orderBy("t").limit(max_unknown), "chosen")
    own = paragraphs(of_text.join(F.broadcast(chosen), "t", "left_semi").dropDuplicates(["t"])).select("paragraph", F.xxhash64("paragraph").alias("h")).distinct()
    own = steps.keep(own.orderBy("h").limit(max_unknown), "own")
    own = own.select(F.lit(UNKNOWN).alias("family"), F.col("paragraph").alias("text"), (F.pmod("h", F.lit(5)) == 4).alias("held"), F.lit(False).alias("sibling")) \
        .filter(likeness(pairs_of(F.col("text")), known) < 0.3)
    rows = known_rows.unionByName(own)
    return steps.keep(rows.select("family", "held", "sibling", grams_of(F.col("text")).alias("grams")), "examples")


def _hashing() -> HashingTF:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES)


def _named() -> Column:
    """The probabilities of the families, without that of the unknown class."""
    return F.slice(vector_to_array(F.col("probability")), 2, len(FAMILIES) - 1)


def _known() -> Column:
    """The probability that it is any of the families: siblings may share it."""
    return 1.0 - F.get(vector_to_array(F.col("probability")), F.lit(0))


def fit(docs: DataFrame, max_unknown: int = MAX_UNKNOWN) -> tuple[LogisticRegressionModel, float]:
    """The classifier, and the probability that the families must reach together to leave the siblings' held versions behind."""
    spark = docs.sparkSession
    steps = Steps(spark, "license-scan")
    examples = _examples(steps, docs, _notice_pairs(spark), max_unknown)
    number = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
    rows = _hashing().transform(examples.withColumn("label", number))
    model = LogisticRegression(maxIter=60, regParam=1e-4, family="multinomial").fit(rows.filter("NOT held"))
    held = model.transform(rows.filter("held AND sibling")).select(_known().alias("p"))
    floor = held.agg(F.percentile_approx("p", F.lit(1 - SIBLING_SHARE), F.lit(100_000))).first()[0]
    return model, max(0.5, float(floor or 0.0))


def score(docs: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """(row_key, at, part, paragraph, named, known) of all parts."""
    rows = paragraphs(docs).withColumn("grams", grams_of(F.col("paragraph")))
    return model.transform(_hashing().transform(rows)).select("row_key", "at", "part", "paragraph", _named().alias("named"), _known().alias("known"))


def keep_above(steps: Steps, scored: DataFrame, least: float) -> tuple[DataFrame, int]:
    """The parts above a probability, written in one pass, and how many there are in all: the others are written as nulls, which take no room, to be counted."""
    rows = steps.keep(scored.select(F.when(F.col("known") > least, F.struct(*scored.columns)).alias("above")), "scored")
    return rows.filter("above IS NOT NULL").select("above.*"), rows.count()


def limit(scored: DataFrame, parts: int, least: float) -> float:
    """The probability above which at most ``FALSE_SHARE`` of all parts share little with any notice, at least that from which the parts were scored."""
    known = _notice_pairs(scored.sparkSession)
    strangers = scored.filter(likeness(pairs_of(F.col("paragraph")), known) < 0.3)
    n, allowed = strangers.count(), int(FALSE_SHARE * parts)
    if n <= allowed:
        return least
    return float(strangers.agg(F.percentile_approx("known", F.lit((n - allowed) / n), F.lit(100_000))).first()[0])


def learn(docs: DataFrame, max_unknown: int = MAX_UNKNOWN) -> tuple[LogisticRegressionModel, float]:
    """The classifier, and the probability that the families must reach together."""
    model, least = fit(docs, max_unknown)
    return model, limit(*keep_above(Steps(docs.sparkSession, "license-scan"), score(docs, model), least), least)


def scan(docs: DataFrame, model: LogisticRegressionModel, threshold: float) -> DataFrame:
    """(row_key, at, part, paragraph, family, probability, likeness, confirmed) of the parts that are given a family."""
    return judge(score(docs, model).filter(F.col("known") > threshold))


def judge(scored: DataFrame) -> DataFrame:
    """The family of scored parts, and whether it is confirmed."""
    known = _notice_pairs(scored.sparkSession)
    family = F.get(F.array(*map(F.lit, FAMILIES[1:])), (F.array_position("named", F.array_max("named")) - 1).cast("int"))
    judged = scored.select("row_key", "at", "part", "paragraph", F.array_max("named").alias("probability"), family.alias("family"))
    found = judged.withColumn("likeness", likeness(pairs_of(F.col("paragraph")), known, F.col("family"), F.col("part") > 0))
    return found.select("row_key", "at", "part", "paragraph", "family", "probability", "likeness", ((F.col("likeness") >= CONFIRM) & has_marks(F.col("paragraph"), F.col("family"))).alias("confirmed"))


def licences(docs: DataFrame, max_unknown: int = MAX_UNKNOWN) -> DataFrame:
    """Per row of (doc_id, text): n_paragraphs, n_licence (paragraphs with a confirmed part), n_unconfirmed (others with a family), families (confirmed, sorted,
    joined by commas), probability (highest of the confirmed)."""
    model, least = fit(docs, max_unknown)
    steps = Steps(docs.sparkSession, "license-scan")
    # one pass over the corpus: the parts above the least probability are few, and the threshold is among them
    scored, parts = keep_above(steps, score(docs, model), least)
    threshold = limit(scored, parts, least)
    found = steps.keep(judge(scored.filter(F.col("known") > threshold)), "found").groupBy("row_key", "at").agg(
        F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("families"), F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"))
    per_row = found.groupBy("row_key").agg(
        F.count_if(F.size("families") > 0).alias("n_licence"), F.count_if(F.size("families") == 0).alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("families"), F.max("probability").alias("probability"))
    n = F.size(_split(F.coalesce("text", F.lit(""))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row_key"), n.cast("long").alias("n_paragraphs"))
    return rows.join(per_row, "row_key", "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_licence", F.lit(0)).cast("long").alias("n_licence"), F.coalesce("n_unconfirmed", F.lit(0)).cast("long").alias("n_unconfirmed"),
        F.coalesce("families", F.lit("")).alias("families"), "probability")
