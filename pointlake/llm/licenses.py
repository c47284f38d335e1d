"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds every substring of every template. A text streams through it: at each
token it knows the longest match that ends there and where in which templates it
occurs. Matches of ``MIN_MATCH`` tokens or more that can't be extended are anchors; anchors
in the same order in text and template, at most ``GAP`` tokens apart in both, are chained by
dynamic programming into covered spans of a template.

Only runs of tokens whose ``MIN_MATCH``-grams all occur in templates are streamed. A match
of that length lies within one such run, so nothing is missed, and runs are found in
whole arrays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Words, c, documents, mix, text_chunks
from .license_texts import TEMPLATES

MIN_MATCH, GAP = 4, 16
#: A span counts that covers this share of its template, or so many tokens of it.
COVERED, TOKENS = 0.8, 40


class Automaton:
    """Suffix automaton of several token sequences, or one of ``parts`` made before."""

    def __init__(self, sequences: list[list[int]], parts: tuple | None = None):
        if parts is not None:
            self.next, self.link, self.length, self.ends = parts
            return
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for s, seq in enumerate(sequences):
            last = 0
            for k, t in enumerate(seq):
                last = self._extend(last, t)
                while len(ends) < len(self.next):
                    ends.append([])
                ends[last].append((s, k + 1))
        order = sorted(range(1, len(self.next)), key=lambda v: -self.length[v])
        found = [set(x) for x in ends]
        for v in order:
            if self.link[v] > 0:
                found[self.link[v]] |= found[v]
        self.ends = [sorted(x) for x in found]

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, t: int) -> int:
        if t in self.next[last]:  # another sequence has been here
            return self._split(last, t, self.next[last][t])
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, t, self.next[p][t])
        return cur

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each token."""
        v = n = 0
        for t in tokens:
            while v and t not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if t in self.next[v]:
                v, n = self.next[v][t], n + 1
            yield v, n


def anchors(sam: Automaton, tokens: list[int], at: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(template, start in text, start in template, length) of the matches that can't be extended."""
    stats = list(sam.statistics(tokens))
    for i, (v, n) in enumerate(stats):
        if n >= MIN_MATCH and (i + 1 == len(stats) or stats[i + 1][1] != n + 1):
            for s, end in sam.ends[v]:
                yield s, at + i + 1 - n, end - n, n


def chains(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first token, token after the last, tokens matched) of the best chains of anchors (start in text,
    start in template, length) of one template. No anchor serves two chains."""
    found = sorted(found)
    best, back = [n for _, _, n in found], [-1] * len(found)
    low = 0
    longest = max((n for _, _, n in found), default=0)
    for j, (x, y, n) in enumerate(found):
        while found[low][0] + longest + GAP < x:
            low += 1
        for i in range(low, j):
            a, b, m = found[i]
            over = max(0, a + m - x, b + m - y)  # tokens that both would match
            if a < x and b < y and over < n and x - a - m <= GAP and y - b - m <= GAP and best[i] + n - over > best[j]:
                best[j], back[j] = best[i] + n - over, i
    out, used = [], set()
    for j in sorted(range(len(found)), key=lambda j: (-best[j], found[j])):
        path, k = [], j
        while k >= 0 and k not in used:
            path.append(k)
            k = back[k]
        if k >= 0 or not path:
            continue
        used.update(path)
        out.append((found[path[-1]][0], found[j][0] + found[j][2], best[j]))
    return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, state: tuple | None = None):
        self.words = Words()
        if state is not None:
            self.names, self.sizes, self.grams, parts = state
            self.sam = Automaton([], parts)
            return
        self.names = [x for x, _ in templates]
        data = [np.frombuffer(t.encode(), np.uint8) for _, t in templates]
        seqs = [self.words(d, np.array([0, len(d)]))[0] for d in data]
        self.sizes = [len(s) for s in seqs]
        self.sam = Automaton([s.tolist() for s in seqs])
        self.grams = np.unique(np.concatenate([self._grams(s) for s in seqs]))

    def state(self) -> tuple:
        """All of it in plain lists and arrays, for a worker that may not have this package."""
        return self.names, self.sizes, self.grams, (self.sam.next, self.sam.link, self.sam.length, self.sam.ends)

    @staticmethod
    def _grams(h: np.ndarray) -> np.ndarray:
        acc = np.zeros(max(0, len(h) - MIN_MATCH + 1), np.uint64)
        for j in range(MIN_MATCH):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(acc)])
        return acc

    def spans(self, found: dict[int, list[tuple[int, int, int]]]) -> list[tuple[str, int, int, int, float]]:
        """(identifier, first token, token after the last, matched, share of the template), the best of those that
        overlap by half."""
        out = []
        for s, a in found.items():
            for lo, hi, n in chains(list(set(a))):
                if n >= min(TOKENS, COVERED * self.sizes[s]):
                    out.append((-n, -n / self.sizes[s], lo, hi, self.names[s]))
        kept: list[tuple[str, int, int, int, float]] = []
        for n, share, lo, hi, name in sorted(out):
            if all(2 * (min(hi, b) - max(lo, a)) < hi - lo for _, a, b, _, _ in kept):
                kept.append((name, lo, hi, -n, -share))
        return sorted(kept, key=lambda x: (x[1], x[0]))

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, list]]:
        """(text, its spans) of the texts that have any."""
        h, _, _, at = self.words(data, offs)
        g = self._grams(h)
        if not len(g):
            return
        place = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        ok = self.grams[place] == g
        cut = at[1:-1]
        for j in range(1, MIN_MATCH):  # grams that reach into the next text
            reach = cut - j
            ok[reach[(reach >= 0) & (reach < len(ok))]] = False
        hits = np.flatnonzero(ok)
        if not len(hits):
            return
        lo = hits[np.append(True, np.diff(hits) > 1)]
        hi = hits[np.append(np.diff(hits) > 1, True)] + MIN_MATCH
        doc = np.searchsorted(at, lo, "right") - 1
        by: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for i, j, d in zip(lo.tolist(), hi.tolist(), doc.tolist()):
            for s, x, y, n in anchors(self.sam, h[i:j].tolist(), i - int(at[d])):
                by[d][s].append((x, y, n))
        for d, found in by.items():
            if spans := self.spans(found):
                yield d, spans


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(state=sent.value)
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(0)):
                rows = [(lo + d, *s) for d, spans in scan(data, offs) for s in spans]
                if rows:
                    row, name, first, end, n, share = zip(*rows)
                    ids = b.column(1).take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(name), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "license", "first_token", "end_token", "matched", "coverage"])

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, license, first_token, end_token, matched, coverage): each covered span of a licence
    template in the texts of ``docs``; no shuffle.

    Tokens are runs of letters and digits in lower case; ``end_token`` is the one after the last. A
    span counts if it covers ``COVERED`` of its template, or ``TOKENS`` tokens of it. Of
    spans that overlap by half the one with more tokens stays, then the more complete, the
    earlier, the first by name. Texts of any length are scanned whole. Null, empty and wordless texts have no
    span; repeated rows give repeated spans; ids may be null. An empty table gives an empty
    one; further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, license string, first_token bigint, end_token bigint, matched bigint, coverage double"
    # the automaton is as large as the templates make it, at any size of the input
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates).state())
    return docs.select(c("text"), c("doc_id")).mapInArrow(_scan(sent), shape)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
