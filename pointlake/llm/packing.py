"""Best-fit packing of documents into sequences by bin completion (Korf, 2002).

A document longer than a sequence is cut into full sequences, each a bin of its own,
and a rest. Rests and shorter documents are dealt by hash into groups of about ``GROUP``
pieces, so the work of a task has one size whatever the size of the table. A group is
packed by branch and bound: a node takes the largest piece left and branches over the
undominated fillings of its bin; waste bounds prune; best-fit decreasing gives the
first incumbent, bins filled one by one with least slack the second, and further ones come from the nodes visited.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, c, documents, materialise, text_chunks

CAPACITY = 4096
GROUP = 2048
#: Steps of search in a group, after which its best solution so far is taken.
STEPS = 20_000


def best_fit(sizes: list[int], order: list[int], capacity: int) -> list[list[int]]:
    """Best-fit over ``order``, as lists of positions in ``sizes``."""
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    bins: list[list[int]] = []
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        if left:
            insort(room, (left, b))
    return bins


def waste_bound(sizes: list[int], capacity: int) -> int:
    """Least number of bins: the best over k of Martello and Toth's L2, where pieces
    over ``capacity - k`` have a bin alone and those under ``k`` fill what room is left."""
    s = np.sort(np.asarray(sizes, np.int64))
    if not len(s):
        return 0
    total = np.concatenate([[0], np.cumsum(s)])
    best = -(-int(total[-1]) // capacity)
    for k in np.unique(s[s <= capacity // 2]):
        alone = len(s) - np.searchsorted(s, capacity - k, "right")
        half, top = np.searchsorted(s, capacity // 2, "right"), len(s) - alone
        n2 = max(0, top - half)
        low = np.searchsorted(s, k)
        over = int(total[half] - total[low]) - (n2 * capacity - int(total[top] - total[half] if n2 else 0))
        best = max(best, int(alone) + n2 + max(0, -(-over // capacity)))
    return best


def fullest(sizes: list[int], left: list[int], room: int) -> list[int]:
    """The subset of ``left`` (positions, by falling size) that leaves least of ``room``, larger pieces first: sums
    that can be reached are bits of one number, kept for each distinct size."""
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    k = 0
    while k < len(left):
        x, end = sizes[left[k]], k
        while end < len(left) and sizes[left[end]] == x:
            end += 1
        if x <= room:
            before = bits
            for _ in range(min(end - k, room // x)):
                more = bits | (bits << x) & mask
                if more == bits:
                    break
                bits = more
            steps.append((x, k, end, before))
            if bits >> room & 1:
                break
        k = end
    want, out = bits.bit_length() - 1, []
    for x, lo, hi, before in reversed(steps):  # as few of the small ones as will do
        n = 0
        while not before >> want & 1:
            want -= x
            out.append(left[lo + n])
            n += 1
    return out[::-1]


def least_slack(sizes: list[int], order: list[int], capacity: int) -> list[list[int]]:
    """One bin after the other, each with the largest piece left and the fullest completion."""
    bins, left = [], order
    while left:
        fill = fullest(sizes, left[1:], capacity - sizes[left[0]])
        bins.append([left[0], *fill])
        gone = set(bins[-1])
        left = [i for i in left if i not in gone]
    return bins


def fillings(sizes: list[int], left: list[int], room: int, most_waste: int, spend) -> Iterator[list[int]]:
    """Undominated subsets of ``left`` (positions, by falling size) that fit ``room`` with no
    more waste than allowed. A subset is dominated if a piece left out fits what room
    remains, or fits in place of a smaller one, or fills the place of two exactly."""
    after = [0] * (len(left) + 1)
    for k in range(len(left) - 1, -1, -1):
        after[k] = after[k + 1] + sizes[left[k]]
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack:
        k, r, chosen = stack.pop()
        if not spend():
            return
        while k < len(left) and sizes[left[k]] > r:
            k += 1
        if r - after[k] > most_waste:
            continue
        if k == len(left):
            taken = set(chosen)
            out = [sizes[i] for i in left if i not in taken]
            have = [sizes[i] for i in chosen]
            sums = {have[a] + have[b] for a in range(len(have)) for b in range(a)}
            if not any(x <= r or any(y < x <= y + r for y in have) or x in sums for x in out):
                yield list(chosen)
            continue
        same = k + 1
        while same < len(left) and sizes[left[same]] == sizes[left[k]]:
            same += 1
        stack.append((same, r, chosen))  # without any of this size
        for n in range(1, same - k + 1):  # the most of it is tried first
            if n * sizes[left[k]] > r:
                break
            stack.append((same, r - n * sizes[left[k]], chosen + tuple(left[k : k + n])))


def pack(sizes: list[int], capacity: int = CAPACITY, steps: int = STEPS) -> list[list[int]]:
    """Bins as lists of positions; as few as the bound or ``steps`` of search permit."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    best = best_fit(sizes, order, capacity)
    bound, total, budget = waste_bound(sizes, capacity), sum(sizes), [steps]
    if len(best) > bound:
        best = min(best, least_slack(sizes, order, capacity), key=len)

    def spend() -> bool:
        budget[0] -= 1
        return budget[0] >= 0

    def node(left: list[int], bins: list[list[int]], waste: int):
        allowed = (len(best) - 1) * capacity - total - waste
        room = capacity - sizes[left[0]]
        for fill in fillings(sizes, left[1:], room, allowed, spend):
            if waste + room - sum(sizes[i] for i in fill) <= (len(best) - 1) * capacity - total:
                yield fill

    if len(best) == bound or not sizes:
        return best
    stack = [(order, [], 0, node(order, [], 0))]
    while stack and budget[0] > 0:
        left, bins, waste, it = stack[-1]
        fill = next(it, None)
        if fill is None:
            stack.pop()
            continue
        gone = {left[0], *fill}
        rest = [i for i in left if i not in gone]
        now = [*bins, [left[0], *fill]]
        budget[0] -= len(rest) // 16
        whole = now + best_fit(sizes, rest, capacity)
        if len(whole) < len(best):
            best = whole
            if len(best) == bound:
                break
        if rest and len(now) + waste_bound([sizes[i] for i in rest], capacity) < len(best):
            w = waste + capacity - sum(sizes[i] for i in now[-1])
            stack.append((rest, now, w, node(rest, now, w)))
    return best


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words(whitespace_only=True)
    for b in batches:
        for lo, hi, data, offs in text_chunks(b.column(1)):
            n = np.diff(words(data, offs)[3])
            ids = b.column(0).slice(lo, hi - lo)
            ok = n > 0
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), pa.array(n[ok].astype(np.int64))], names=["doc_id", "n_tokens"])


#: Equal rows that stay together when they are dealt to groups.
TOGETHER = 64


def _packed(capacity: int, steps: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending")])
        t = t.take(pa.array(np.repeat(np.arange(t.num_rows), t["copies"].to_numpy())))
        group, n = t["grp"][0].as_py(), t["n_tokens"].to_numpy()
        full, rest = n // capacity, n % capacity
        row = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        pieces = np.flatnonzero(rest)
        bins = pack(rest[pieces].tolist(), capacity, steps)
        inside = np.array([i for b in bins for i in b], np.int64)
        where = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        held = np.array([int(rest[pieces[b]].sum()) for b in bins], np.int64)
        last = pieces[inside]
        number = np.concatenate([where, len(bins) + np.arange(len(row))])
        return pa.table(
            {
                "bin_id": (group << 32) + number,
                "doc_id": t["doc_id"].take(pa.array(np.concatenate([last, row]).astype(np.int64))),
                "first_token": np.concatenate([full[last], nth]).astype(np.int64) * capacity,
                "tokens": np.concatenate([rest[last], np.full(len(row), capacity)]).astype(np.int64),
                "bin_tokens": np.concatenate([held[where], np.full(len(row), capacity)]).astype(np.int64),
            }
        )

    return run


def pack_documents(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP, steps: int = STEPS) -> DataFrame:
    """One row for each piece: its bin, document, first token, tokens, and the bin's tokens.

    Tokens are the words between white space. Every token of every row is in exactly one
    piece, and no bin holds more than ``capacity``. Rows without tokens (null, empty,
    blank) have no piece; repeated rows are packed as often as they come; a null id stays
    null. Ties in size go by id, of whatever type that is sorted; the result doesn't depend on how the table
    is split into files. Texts of any length are cut. An empty table gives an empty one; further columns are
    ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    n = docs.select(c(key), c(text)).mapInArrow(_lengths, f"doc_id {kind}, n_tokens bigint")
    # equal rows become one with their number before they are shuffled, however many they are
    n = materialise(spark, n.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("n")), "lengths")
    groups = max(1, -(-int(n.agg(F.sum("n")).first()[0] or 0) // group))
    dealt = n.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {TOGETHER}"))).alias("part"))
    dealt = dealt.select("doc_id", "n_tokens", F.least(F.lit(TOGETHER), F.col("n") - TOGETHER * F.col("part")).alias("copies"), F.pmod(F.xxhash64("doc_id", "n_tokens", "part"), F.lit(groups)).cast("bigint").alias("grp"))
    return dealt.groupBy("grp").applyInArrow(_packed(capacity, steps), f"bin_id bigint, doc_id {kind}, first_token bigint, tokens bigint, bin_tokens bigint")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, documents(spark, sf_dir))
