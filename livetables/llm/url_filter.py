"""URL filters: glob rules simulated side by side as a bit-parallel automaton over canonical URLs.

A canonical URL is "." + host + path. The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
with A-Z lower-cased; the path follows up to ``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host
and an empty path.

A glob is matched against the whole canonical URL: ``*`` stands for any run without ``/``, ``**`` for any run, every
other character for itself. All globs are packed one after the other into the bits of a row of 64-bit words: bit j of a
glob is "the first j characters are matched". One step of Shift-And per character moves all of them at once:

    state = (((state and not last) << 1, carried over words) and may_move[c]) or (state and may_stay[c])

``may_stay`` holds the bits with a star. URLs of a batch are simulated together, and drop out as they end.

A rule is (action, host suffix, path prefix) and becomes the globs for the host itself and its subdomains; of those that
fit, the longest (host and path together) decides, equal lengths by their order in the list. Where no rule fits, the
verdict is "block" if a block glob matches, otherwise "allow".

Every row gets a verdict, repeated rows one each; an empty table gives an empty result; columns beyond the two named are
ignored. Rules and globs are few by nature and are part of the job's arguments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetables.llm.base import Bytes, column

# fixed values: (action, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
# fixed values: words that mark the hosts of gambling, adult or spam sites
BLOCK_GLOBS = [g for name in ("spam", "adult", "bets", "casino") for g in (f"*{name}*", f"*{name}*/**")]

JUDGED = "page_id long, host string, path string, rule string, verdict string"


def rule_glob(host: str, path: str) -> str:
    return f"*.{host}{path}**"


class Automaton:
    """Shift-And masks for a list of globs."""

    def __init__(self, globs: list[str]):
        parsed = []
        for g in globs:
            tokens, stars, i = [], {}, 0
            while i < len(g):
                if g[i] == "*":
                    both = g[i:i + 2] == "**"
                    stars[len(tokens)] = both or stars.get(len(tokens), False)
                    i += 1 + both
                else:
                    tokens += list(g[i].encode())
                    i += 1
            parsed.append((tokens, stars))
        bits = sum(len(t) + 1 for t, _ in parsed)
        self.words = max(1, -(-bits // 64))
        self.move = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.not_last = np.full(self.words, ~np.uint64(0))
        self.final = []
        at = 0
        for tokens, stars in parsed:
            self._set(self.begin, at)
            for j, c in enumerate(tokens):
                self._set(self.move[c], at + j + 1)
            for j, any_byte in stars.items():
                for c in range(256):
                    if any_byte or c != 0x2F:
                        self._set(self.stay[c], at + j)
            end = at + len(tokens)
            self.not_last[end // 64] &= ~(np.uint64(1) << np.uint64(end % 64))
            self.final.append(end)
            at = end + 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """For each text and glob, whether the glob matches the whole text."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        state = np.tile(self.begin, (len(texts), 1))
        live = len(texts)
        for step in range(int(lengths[0]) if len(texts) else 0):
            live = int(np.searchsorted(-lengths[:live], -step, "left"))   # texts longer than step stand first
            c = data[offsets[:live] + step]
            old = state[:live]
            up = old & self.not_last
            shifted = up << np.uint64(1)
            shifted[:, 1:] |= up[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.move[c]) | (old & self.stay[c])
        out = np.zeros((len(texts), len(self.final)), bool)
        for g, end in enumerate(self.final):
            out[order, g] = (state[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) == 1
        return out


def host_and_path():
    """Columns host and path of ``url``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, block_globs: list[str] = BLOCK_GLOBS) -> DataFrame:
    """Verdict on each row of (page_id, url)."""
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    ranked = [rules[i] for i in ranked]
    machine = Automaton([rule_glob(h, p) for _, h, p in ranked] + list(block_globs))
    names = [h + p for _, h, p in ranked]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            canonical = pc.binary_join_element_wise(".", column(batch, "host"), column(batch, "path"), "")
            b = Bytes(pc.cast(canonical, pa.string()))
            raw = b.data.tobytes()
            fits = machine.match([raw[s:e] for s, e in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist())])
            by_rule = fits[:, :len(ranked)]
            which = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), -1).tolist()
            blocked = fits[:, len(ranked):].any(axis=1).tolist()
            yield pa.record_batch({
                "page_id": column(batch, "page_id"), "host": column(batch, "host"), "path": column(batch, "path"),
                "rule": pa.array([names[i] if i >= 0 else None for i in which], pa.string()),
                "verdict": pa.array([ranked[i][0] if i >= 0 else "block" if x else "allow" for i, x in zip(which, blocked)], pa.string())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), *host_and_path()).mapInArrow(run, JUDGED)
