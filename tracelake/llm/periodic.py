"""Periodic runs in the words of documents by partition refinement.

The positions of equal factors of one length form a class. Classes are refined from length l to l + 1: two positions stay together
if the positions after them do. Of the children that a class was split into, all but the largest are enough to tell what must
be split next (the smaller-half strategy), so every position is moved a logarithmic number of times. Each class keeps its
positions in order as a linked list. Where neighbours of a class lie exactly l apart at length l, the text holds a square with
a primitive root of l words; squares of one period at consecutive places are one run.

A pair of neighbours is looked at when it is parted: it was a square if its distance lies between the lengths at which it came
about and at which it was parted. So no queue of distances is needed. Words of all documents of a batch are refined together
(ids differ between documents), vectorised while many positions move, one by one while few do.

Defined cases: null and empty texts have no words, no runs and the digest of nothing; a null doc_id is never edited;
repeated rows give repeated results; other columns are ignored. A document is worked on whole in one task, at some 200 bytes
a word.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import table, unused, with_text_columns

#: A run has at least this many words, and two periods.
LEAST_WORDS = 12
BATCH_CHARS = 4_000_000
#: Fewer positions than this are moved one by one.
FEW = 48


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those of the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


class Classes:
    """Positions 0 to n - 1 by the factor that begins at each; n itself stands for no position."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) != 0)))
        count = np.diff(np.append(first, n))
        self.n, self.used, self.level = n, len(first), 1
        self.of = np.empty(n + 1, np.int64)
        self.of[order] = np.repeat(np.arange(self.used), count)
        self.size, self.start = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.size[: self.used], self.start[: self.used] = count, first
        self.members, self.place = order.copy(), np.empty(n + 1, np.int64)
        self.place[order] = np.arange(n)
        self.after, self.before = np.full(n + 1, n), np.full(n + 1, n)
        linked = np.ones(n, bool)
        linked[first] = False
        at = np.flatnonzero(linked)
        self.after[order[at - 1]], self.before[order[at]] = order[at], order[at - 1]
        self.born = np.ones(n + 1, np.int64)
        self.moved = np.zeros(n + 1, bool)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []
        self.few_at: list[int] = []
        self.few_period: list[int] = []
        self.views = {k: memoryview(getattr(self, k)) for k in ("of", "size", "start", "members", "place", "after", "before", "born")}
        largest = np.argmax(count)
        self.small = self.members[np.concatenate((np.arange(first[largest]), np.arange(first[largest] + count[largest], n)))]

    def part(self, at: np.ndarray) -> None:
        """Pairs (at, after[at]) end: those that were squares at the length that equals their distance are noted."""
        at = at[self.after[at] < self.n]
        apart = self.after[at] - at
        square = (self.born[at] <= apart) & (apart <= self.level)
        if square.any():
            self.squares.append((at[square], apart[square]))

    def refine(self) -> None:
        """From classes of factors of `level` words to those of one more."""
        at = self.small
        at = at[at > 0]
        at = at[self.size[self.of[at - 1]] > 1]
        if not len(at) or len(at) < FEW:
            self.small = np.array(self._refine_few(at.tolist()), np.int64)
        else:
            self._refine_many(at)
        self.level += 1

    def _refine_many(self, at: np.ndarray) -> None:
        n, moved = self.n, at - 1
        key = self.of[moved] * (n + 1) + self.of[at]
        order = np.lexsort((moved, key))
        moved, key = moved[order], key[order]
        first = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
        count, parent = np.diff(np.append(first, len(moved))), key[first] // (n + 1)
        # Where all of a class would move, its largest group stays.
        p_first = np.flatnonzero(np.concatenate(([True], np.diff(parent) != 0)))
        p_groups = np.diff(np.append(p_first, len(parent)))
        whole = np.add.reduceat(count, p_first) == self.size[parent[p_first]]
        ranked = np.lexsort((count, parent))  # the last of each parent is its largest
        largest = ranked[p_first + p_groups - 1]
        gone = np.ones(len(parent), bool)
        gone[largest[whole]] = False
        moved, count, parent = moved[np.repeat(gone, count)], count[gone], parent[gone]
        if not len(moved):
            self.small = moved
            return
        first = np.cumsum(count) - count
        p_first = np.flatnonzero(np.concatenate(([True], np.diff(parent) != 0)))
        p_groups = np.diff(np.append(p_first, len(parent)))
        own, taken = parent[p_first], np.add.reduceat(count, p_first)
        rest = self.size[own] - taken
        # Members: the moved ones go to the end of their class's stretch, group by group.
        slots = _ranges(self.start[own] + rest, taken)
        self.moved[moved] = True
        sitting = self.members[slots]
        sitting = sitting[~self.moved[sitting]]
        left = self.place[moved]
        left = left[left < np.repeat(self.start[own] + rest, taken)]
        self.members[left], self.place[sitting] = sitting, left
        self.members[slots], self.place[moved] = moved, slots
        self.moved[moved] = False
        # Lists: chains of moved neighbours are cut out of the class's list, then linked anew group by group.
        chain = moved[np.lexsort((moved, np.repeat(parent, count)))]
        joined = self.after[chain[:-1]] == chain[1:]
        before, after = self.before[chain[np.concatenate(([True], ~joined))]], self.after[chain[np.concatenate((~joined, [True]))]]
        self.part(before[before < n])
        self.part(moved)
        self.after[before], self.before[after], self.born[before] = after, before, self.level + 1
        within = np.ones(len(moved), bool)
        within[first] = False
        self.before[moved] = np.where(within, np.roll(moved, 1), n)
        self.after[moved] = np.where(np.roll(within, -1), np.roll(moved, -1), n)
        self.born[moved] = self.level + 1
        # Classes, and the smaller children.
        made = self.used + np.arange(len(count))
        self.used += len(count)
        self.of[moved] = np.repeat(made, count)
        self.size[made], self.start[made], self.size[own] = count, slots[first], rest
        ranked = np.lexsort((count, parent))
        top = ranked[p_first + p_groups - 1]
        beaten = rest < count[top]
        small = np.ones(len(count), bool)
        small[top[beaten]] = False
        self.small = np.concatenate((moved[np.repeat(small, count)], self.members[_ranges(self.start[own[beaten]], rest[beaten])]))

    def _refine_few(self, at: list[int]) -> list[int]:
        of, size, start, members, place, after, before, born = self.views.values()
        n, level, parents = self.n, self.level, {}
        for j in sorted(at):
            parents.setdefault(of[j - 1], {}).setdefault(of[j], []).append(j - 1)
        small: list[int] = []

        def end(i):
            apart = after[i] - i
            if born[i] <= apart <= level and after[i] < n:
                self.few_at.append(i)
                self.few_period.append(apart)
            born[i] = level + 1

        for parent, split in parents.items():
            groups = sorted(split.values(), key=len)
            rest = size[parent] - sum(map(len, groups))
            if rest == 0:
                rest = len(groups.pop())
            if not groups:
                continue
            for group in groups:
                last = n
                slot = start[parent] + size[parent]
                for i in group:
                    slot -= 1
                    other = members[slot]
                    members[place[i]], place[other] = other, place[i]
                    members[slot], place[i] = i, slot
                    l, r = before[i], after[i]
                    end(i)
                    if l < n:
                        end(l)
                    after[l], before[r] = r, l
                    before[i], after[i], of[i] = last, n, self.used
                    after[last] = i
                    last = i
                size[parent] -= len(group)
                start[self.used], size[self.used] = slot, len(group)
                self.used += 1
            if rest < len(groups[-1]):
                groups.pop()
                small += members[start[parent] : start[parent] + rest].tolist()
            for group in groups:
                small += group
        return small


def squares(ids: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a square with a primitive root begins, and the length of the root. Each document's ids end with one of its own;
    longest: how long a root can be at each position (half its document)."""
    c = Classes(ids)
    top = int(longest.max(initial=0))
    while len(c.small) and c.level < top:
        c.small = c.small[longest[c.small] > c.level]
        c.refine()
    c.part(np.arange(c.n))
    c.squares.append((np.array(c.few_at, np.int64), np.array(c.few_period, np.int64)))
    at, period = (np.concatenate([s[k] for s in c.squares]) for k in (0, 1))
    fits = period <= longest[at]  # beyond that the document was refined no further
    return at[fits], period[fits]


def runs(ids: np.ndarray, longest: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of every maximal run, by start and period."""
    at, period = squares(ids, longest)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(period) != 0)))) if len(at) else at
    length = np.diff(np.append(first, len(at))) - 1 + 2 * period[first]
    start, period = at[first], period[first]
    kept = length >= least
    start, length, period = start[kept], length[kept], period[kept]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def edited(words: list[bytes], doc_id: str | int | None) -> list[bytes]:
    """The words of every tenth id (by its crc32) are made periodic from some place on, as the query's contract says."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def with_runs(texts: list[list[bytes]], least: int = LEAST_WORDS) -> tuple[list[list[tuple[int, int, int]]], list[list[bytes]]]:
    """For the words of each text: its runs (start, length, period), and the words that no run repeats."""
    sizes = np.array([len(w) for w in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids, base = np.empty(offsets[-1], np.int64), 0
    for words, at in zip(texts, offsets.tolist()):
        own = {w: i for i, w in enumerate(dict.fromkeys(words), base)}
        ids[at : at + len(words)] = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
        base += len(own) + 1
        ids[at + len(words)] = base - 1
    if not len(ids):
        return found, texts
    start, length, period = runs(ids, np.repeat(sizes // 2, sizes + 1), least)
    row = np.searchsorted(offsets, start, "right") - 1
    for r, *run in zip(row.tolist(), (start - offsets[row]).tolist(), length.tolist(), period.tolist()):
        found[r].append(tuple(run))
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.subtract.at(covered, start + length, 1)
    dropped = np.cumsum(covered) > 0
    kept = []
    for words, at, own in zip(texts, offsets.tolist(), found):
        kept.append([w for w, d in zip(words, dropped[at : at + len(words)].tolist()) if not d] if own else words)
    return found, kept


def periodic_runs(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST_WORDS, edit: str | None = None, keep_text: bool = True) -> DataFrame:
    """One row per row of docs: the columns in keep, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256,
    collapsed_sha256, and if keep_text runs (all of them) and collapsed (the text without repeats, words joined by a blank).
    edit names an id column by which edited() changes the words first."""
    from pyspark.sql import functions as F

    docs = docs if edit is None else docs.select("*", F.concat(F.coalesce(F.col(f"`{edit}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(unused(docs, "edit")))
    columns = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    columns += ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * keep_text

    def make():
        def compute(texts: list[str | None]) -> list[list]:
            if edit is None:
                words = [(t or "").encode().split() for t in texts]
            else:
                words = [edited(t.encode().split(), i or None) for i, _, t in (x.partition(":") for x in texts)]
            found, kept = with_runs(words, least)
            out: list[list] = [[] for _ in range(7 + 2 * keep_text)]
            for own, left in zip(found, kept):
                best = min(own, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
                text = b" ".join(left)
                row = [len(own), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join("%d,%d,%d\n" % x for x in own).encode()).hexdigest(), hashlib.sha256(text).hexdigest()]
                if keep_text:
                    row += [[dict(zip(("start", "length", "period"), x)) for x in own], text.decode()]
                for column, v in zip(out, row):
                    column.append(v)
            return out

        return compute

    return with_text_columns(docs, list(keep), make, columns, text="text" if edit is None else docs.columns[-1], most_chars=BATCH_CHARS)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), edit="doc_id", keep_text=False)
