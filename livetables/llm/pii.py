"""Personal data by bootstrapped contextual extraction.

1. Seeds: e-mail addresses, IP addresses, card and phone numbers, by their shape (``base_spans``).
2. Candidates, by the loose shape of each kind and where no seed is: tokens with the digits of a phone number at least, or an @; numbers with
   two dots or more; digit groups joined by blanks, brackets, dots or dashes; hex groups with colons. Seeds and candidates alike have contexts: the
   word before, the two words before, the two words after, as lexical patterns (lower-cased, digits as 0; a word of more than ``PIECE`` code points is taken in
   pieces of that size, counted from the place). A candidate within another one counts only if the outer one is too long for a phone number.
3. Graph: patterns and instances (digests of the texts of seeds and candidates) are joined by the places where they meet. Rounds over
   that graph, all joins and sums: a pattern scores, per kind, the share of its places that are instances believed so far; a place with a
   candidate that could be of the kind, but is not believed yet, neither confirms nor refutes and weighs a tenth, any other one weighs whole. An instance is
   believed as far as its best pattern is. Scores and beliefs are whole thousandths that only grow, so the rounds end, when none has changed.
4. Patterns with ``min_support`` different believed instances and a score of ``confidence`` discover: a candidate in such a context, with
   the shape that the kind allows, becomes a span of that kind.

Scores are kept per (pattern, kind), so a frequent word with a third of all places is one sum with partial sums before it. Texts are
read once; what follows are the places found, written to the shared folder. Nothing of the graph is collected or broadcast by hint.

Offsets are code points, end exclusive. A null text is empty; empty texts have no spans. Repeated rows get a row each and their places count
each. Equal scores are resolved by the order of ``KINDS``. An empty table gives an empty result. Columns beyond those named
are ignored, or kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from livetables.llm.base import Steps, column, free_name, row_key

KINDS = ["email", "ip", "card", "phone"]
MIN_SUPPORT = 5
CONFIDENCE = 0.9
FULL = 1000              # scores and beliefs: whole thousandths
MIN_DIGITS = 6           # of a phone number; a card has more
PHONE_DIGITS, CARD_DIGITS = 15, 19      # at most
PIECE = 64               # code points of a word in a context

# fixed values: the shapes of the seeds
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digits = re.compile(r"[0-9]+")
_space = re.compile(r"\s")
_edges = "\"'`.,;:!?()[]{}<>*%&$#|="
# the shapes of the candidates
_start = re.compile(r"[0-9]+|@")
_dotted = re.compile(r"[0-9]++(?:\.[0-9]++){2,}+")
_groups = re.compile(rf"(?<![^\s{re.escape(_edges)}])(?<![0-9][:.,])[+(]{{0,2}}[0-9]++(?:[ ().+/-]+[0-9]++)*+\)?")
_glued = re.compile(rf"[:.,]?[0-9]|[^\s\w{re.escape(_edges)}]*\w")
_colons = re.compile(r":[0-9A-Fa-f]{0,4}:")
_run = re.compile(r"[\w:]*")
_hex = re.compile(r"(?:\w*[^\W0-9A-Fa-f]\w*:)?((?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*+)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*+)?|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){2,}+):?")

SPAN = "struct<kind:string,first:int,last:int>"
PLACE = "struct<first:int,last:int,shape:string,instance:string,kind:string,contexts:array<string>>"
SCANNED = f"doc_id long, row_key string, spans array<{SPAN}>, places array<{PLACE}>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _local:
            first -= 1
        m = _domain.match(text, at) if first < at else None
        if m:
            yield first, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the seeds, by kind and place."""
    out = [("email", *s) for s in _emails(text)]
    if _digits.search(text):
        out += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _card.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in _phone.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens between whitespace, stripped at the ends, with enough digits, an @, or two dots between digits."""
    done = 0
    for m in _start.finditer(text):
        if m.start() < done:
            continue
        first = m.start()
        while first > done and not text[first - 1].isspace():
            first -= 1
        end = _space.search(text, m.end())
        last = done = end.start() if end else len(text)
        while first < last and text[first] in _edges:
            first += 1
        while last > first and text[last - 1] in _edges:
            last -= 1
        token = text[first:last]
        if _digit_count(token) >= MIN_DIGITS or "@" in token and any(map(str.isalnum, token)) or _dotted.fullmatch(token):
            yield first, last


def _digit_count(token: str) -> int:
    return sum(map(len, _digits.findall(token)))


def _digit_groups(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Digit groups joined by blanks, brackets, dots or dashes. Of more digits than any kind has, as many as a phone or a card has from either end."""
    for m in _groups.finditer(text, start, stop):
        first, last = m.span()
        if _glued.match(text, last):
            last = max(text.rfind(" ", first, last), first)
        body = text[first:last].rstrip(" .+/-(")
        last = first + len(body)
        if body.endswith(")") and ("(" not in body or body.startswith("(") and body.count("(") == body.count(")") == 1):
            last -= 1
            if body.startswith("("):
                first += 1
        elif "(" in body[:2] and ")" not in body:
            first += body.index("(") + 1
        body = text[first:last]
        n = _digit_count(body)
        if n <= CARD_DIGITS:
            if n >= MIN_DIGITS:
                yield first, last
            continue
        words = [(first + w.start(), first + w.end()) for w in re.finditer("[^ ]+", body)]
        for most in (PHONE_DIGITS, CARD_DIGITS):
            for part in (words, words[::-1]):
                n = used = 0
                for a, z in part:
                    n += _digit_count(text[a:z])
                    if n > most:
                        n -= _digit_count(text[a:z])
                        break
                    used += 1
                if used and n >= MIN_DIGITS:
                    yield min(part[0][0], part[used - 1][0]), max(part[0][1], part[used - 1][1])


def _hex_groups(text: str) -> Iterator[tuple[int, int]]:
    """Hex groups with two colons or more, also after a name with a colon."""
    done = 0
    for m in _colons.finditer(text):
        first = m.start()
        if first < done:
            continue
        while first > done and (text[first - 1].isalnum() or text[first - 1] in "_:"):
            first -= 1
        done = _run.match(text, m.end()).end()
        found = _hex.fullmatch(text, first, done)
        if found and any(map(str.isalnum, found[1])):
            yield found.span(1)


def _candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Places that may be identifiers and that no span touches."""
    covered = sorted((a, z) for _, a, z in spans)
    found = set(_hex_groups(text)) if ":" in text else set()
    if _start.search(text):
        found.update(_tokens(text))
        at = 0
        for a, z in [*covered, (len(text), len(text))]:
            if a > at:
                found.update(_digit_groups(text, at, a))
            at = max(at, z)
    out, i, reach = [], 0, 0      # reach: the end of an outer candidate that is short enough to hold no other
    for first, last in sorted(found, key=lambda s: (s[0], -s[1])):
        while i < len(covered) and covered[i][1] <= first:
            i += 1
        if last > reach and not (i < len(covered) and covered[i][0] < last):
            out.append((first, last))
            if _digit_count(text[first:last]) <= PHONE_DIGITS:
                reach = last
    return out


def _shape(token: str) -> str:
    """Letters as a, one for neighbouring ones, and digits as 0, at most one more than any kind has."""
    return re.sub(r"[^\W\d_]+", "a", _digits.sub(lambda m: "0" * min(len(m.group()), CARD_DIGITS + 1), token))


def _word(text: str, at: int, step: int) -> tuple[str, int]:
    """The word next to a place, or its nearest ``PIECE`` code points, going left (-1) or right (1), and where that ends."""
    n = len(text)
    inside = lambda i: 0 <= (i - 1 if step < 0 else i) < n
    char = lambda i: text[i - 1 if step < 0 else i]
    while inside(at) and char(at).isspace():
        at += step
    end = at
    while inside(end) and abs(end - at) < PIECE and not char(end).isspace():
        end += step
    return text[min(at, end):max(at, end)], end


def _contexts(text: str, first: int, last: int) -> list[str]:
    """Lexical patterns around a place: the word before, the two words before, the two after; lower-cased, digits as 0."""
    near, at = _word(text, first, -1)
    far = _word(text, at, -1)[0] if near else ""
    after, at = _word(text, last, 1)
    later = _word(text, at, 1)[0] if after else ""
    found = [f"<{near}"] * bool(near) + [f"<{far} {near}"] * bool(far) + [f">{after} {later}"] * bool(later)
    return [_digits.sub("0", c.lower()) for c in found]


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
    place = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("shape", pa.string()), ("instance", pa.string()), ("kind", pa.string()), ("contexts", pa.list_(pa.string()))])
    for batch in batches:
        spans, places = [], []
        for text in column(batch, "text").to_pylist():
            text = text or ""
            found = base_spans(text)
            spans.append([{"kind": k, "first": a, "last": z} for k, a, z in found])
            here = [(k, a, z) for k, a, z in found] + [(None, a, z) for a, z in _candidates(text, found)]
            places.append([{"first": a, "last": z, "shape": _shape(text[a:z]), "instance": hashlib.sha256(text[a:z].encode("utf-8", "replace")).hexdigest(), "kind": k, "contexts": _contexts(text, a, z)} for k, a, z in here])
        yield pa.record_batch({"doc_id": column(batch, "doc_id"), "row_key": column(batch, "row_key"), "spans": pa.array(spans, pa.list_(span)),
                               "places": pa.array(places, pa.list_(place))})


def _fits(kind: str, s: Column) -> Column:
    """A candidate of this shape (letters a, digits 0) can be an identifier of the kind that failed the strict form."""
    digits = F.char_length(s) - F.char_length(F.translate(s, "0", ""))
    return {"card": s.rlike(r"^[0 -]+$") & digits.between(12, 19), "phone": s.rlike(r"^[0 ().+/-]+$") & digits.between(MIN_DIGITS, PHONE_DIGITS),
            "ip": s.rlike(r"^[0a:.]+$") & s.rlike("[:.]"), "email": s.contains("@")}[kind]


def _kinds(shape: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_fits(k, shape), F.lit(k)) for k in KINDS]))


def bootstrap(steps: Steps, scanned: DataFrame, min_support: int = MIN_SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, score, support) of the patterns that discover; scores in thousandths."""
    places = scanned.select(F.explode("places").alias("p"))
    graph = steps.keep(places.select(F.explode("p.contexts").alias("pattern"), "p.instance", "p.shape", "p.kind")
                       .groupBy("pattern", "instance", "shape", "kind").agg(F.count("*").alias("n")), "graph")
    total = graph.groupBy("pattern").agg(F.sum("n").alias("total"), F.countDistinct("instance").alias("instances")).filter(F.col("instances") >= min_support)
    # an edge per kind that the place is, or may be
    kinds = F.when(F.col("kind").isNull(), _kinds(F.col("shape"))).otherwise(F.array("kind"))
    edges = graph.select("pattern", "instance", F.col("kind").isNull().alias("open"), F.explode(kinds).alias("kind"), "n")
    edges = steps.keep(edges.join(total.select("pattern"), "pattern", "left_semi"), "edges")
    sizes = edges.groupBy("pattern", "kind").agg(F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).alias("unseen"))
    sizes = steps.keep(sizes.join(total.select("pattern", "total"), "pattern"), "sizes")
    steps.drop(graph)
    seeds = edges.filter(~F.col("open")).select("instance", "kind", F.lit(FULL).cast("long").alias("belief")).distinct()
    believed, before, patterns = steps.keep(seeds, "believed"), None, None
    while True:
        mass = F.col("n") * F.col("belief")
        hits = edges.join(believed, ["instance", "kind"]).groupBy("pattern", "kind").agg(
            F.sum(mass).alias("good"), F.sum(F.when(F.col("open"), mass).otherwise(0)).alias("found"), F.countDistinct("instance").alias("support"))
        # the weight of all places: whole ones, what is believed of the candidates, and a tenth of what is not
        weight = f"{10 * FULL} * (total - unseen) + 9 * found + {FULL} * unseen"
        found = hits.filter(F.col("support") >= min_support).join(sizes, ["pattern", "kind"]) \
            .select("pattern", "kind", F.expr(f"{10 * FULL} * good div ({weight})").alias("score"), "support").filter(F.col("score") >= round(FULL * confidence))
        found = steps.keep(found, "patterns")
        if patterns is not None:
            steps.drop(patterns)
        patterns = found
        now = patterns.agg(F.count("*"), F.sum("score"), F.sum("support")).first()
        if now == before:
            steps.drop(believed, edges, sizes)
            return patterns
        old, before = believed, now
        new = edges.filter("open").join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("score").alias("belief"))
        believed = steps.keep(old.unionByName(new).groupBy("instance", "kind").agg(F.max("belief").alias("belief")), "believed")
        steps.drop(old)


def find(docs: DataFrame, min_support: int = MIN_SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row of (doc_id, text): row_key, ``spans`` of the seeds and ``added`` spans."""
    steps = Steps(docs.sparkSession, "pii")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row_key"), "text")
    scanned = steps.keep(rows.mapInArrow(scan, SCANNED), "scanned")
    patterns = bootstrap(steps, scanned, min_support, confidence)
    open_ = scanned.select("row_key", F.explode("places").alias("p")).filter("p.kind IS NULL") \
        .select("row_key", "p.first", "p.last", F.explode(_kinds(F.col("p.shape"))).alias("kind"), F.col("p.contexts").alias("contexts")) \
        .select("row_key", "first", "last", "kind", F.explode("contexts").alias("pattern"))
    ranked = F.struct(F.col("score"), (-F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))).alias("order"), F.col("kind"))
    best = open_.join(patterns, ["pattern", "kind"]).groupBy("row_key", "first", "last").agg(F.max(ranked).alias("b"))
    # of candidates within each other the outer one
    before = Window.partitionBy("row_key").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("reach", F.max("last").over(before)).filter("reach IS NULL OR last > reach")
    added = best.groupBy(F.col("row_key").alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col("b.kind").alias("kind"), "first", "last"))).alias("added"))
    added = steps.keep(added, "added")
    out = scanned.join(added, F.col("row_key") == F.col("_k"), "left")
    return out.select("doc_id", "row_key", "spans", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"))


def spans_text(spans):
    """kind:start:end by kind as listed, then start, joined by commas."""
    number = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(number(s).alias("o"), s["first"].alias("first"), s["last"].alias("last"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")


def _redacted(batches: Iterator[pa.RecordBatch], text: str, added: str, chars: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new = []
        for t, more in zip(column(batch, text).to_pylist(), column(batch, added).to_pylist()):
            if not t:
                new.append(t)
                continue
            spans = sorted(base_spans(t) + [(s["kind"], s["first"], s["last"]) for s in more or []], key=lambda s: (s[1], -s[2]))
            parts, done = [], 0
            for kind, a, z in spans:
                if a >= done:
                    parts += [t[done:a], f"[{kind.upper()}]"]
                done = max(done, z)
            new.append("".join(parts) + t[done:] if spans else t)
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != added}
        columns[text] = pa.array(new, pa.string())
        if chars:
            columns[chars] = pa.array([None if t is None else len(t) for t in new], pa.int64())
        yield pa.record_batch(columns)


def redact(docs: DataFrame, chars: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with all its columns; each span becomes its kind in brackets, overlapping ones one, and ``chars`` (if there) the new length."""
    added, key = free_name(docs.columns, "added"), free_name(docs.columns, "row_key")
    steps = Steps(docs.sparkSession, "pii")
    more = find(docs, **options).filter(F.size("added") > 0).select(F.col("row_key").alias(key), F.col("added").alias(added)).dropDuplicates([key])
    more = steps.keep(more, "added")
    chars = chars if chars in docs.columns else None
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {'bigint' if c == chars else types[c]}" for c in docs.columns)
    if more.isEmpty():
        joined = docs.withColumn(added, F.array().cast(f"array<{SPAN}>"))
    else:
        joined = docs.withColumn(key, row_key("doc_id", "text")).join(more, key, "left").drop(key)
    return joined.select(*docs.columns, added).mapInArrow(lambda it: _redacted(it, "text", added, chars), schema)
