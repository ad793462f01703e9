"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: 64 majority bits over the XXH64 values of all word shingles, repeats included.

Links: two fingerprints link at `radius` or fewer differing bits. Bit i carries a non-zero vector m(i) of radius+1 bits;
table v (one for every non-zero v) keeps the bits with <m(i), v> odd. For any `radius` differing bits some v is orthogonal
to all their vectors, so the pair agrees on every bit that table keeps: each pair within the radius meets in some table,
none is missed. Candidates of a table are compared exactly.

Skew: equal fingerprints are merged before any table is made. A (table, key) group above `hot` members is not compared;
its members are dealt again by all tables of the next level, whose vectors are another arrangement, inside their group.
Each level fixes half of the bits still free, and members are distinct, so at the fourth level a group has some sixteen
members: no cap is needed and none is set. A compared group gives a spanning forest of its links, not all pairs.

Components: repeated hooking to the least neighbour with pointer jumping, all in DataFrames, stored every round.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and link like any other; a text of
fewer words than a shingle is one shingle; rows with a null doc_id get a fingerprint and a null component unless others
share their component; repeated doc_ids keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import ensure_shared, give_back, nothing_broadcast, remove, stored, table, unused, with_text_columns

SHINGLE, RADIUS, HOT = 3, 3, 512
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _hashes(text: str | None, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, repeats included, in arrays of bounded length; none if there is no word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # at \x20 and \x09-\x0D
    if not words:
        return
    joined, n, h64 = b" ".join(words), max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    starts = [0, *accumulate(map(len, words), lambda a, b: a + b + 1)]  # starts[i] = the words before i, a blank after each
    starts[1:] = [x + 1 for x in starts[1:]]
    for at in range(0, n, 65536):
        m = min(n, at + 65536)
        ends = starts[at + shingle : m + shingle] if len(words) >= shingle else starts[-1:]
        yield np.array([h64(joined[a : b - 1], seed) for a, b in zip(starts[at:m], ends)], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for some in _hashes(text, shingle):
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(some)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """The columns in keep and fp (the 64 bits as a long)."""

    def make():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return with_text_columns(docs, list(keep), make, "fp long")


def masks(radius: int = RADIUS, level: int = 0) -> list[int]:
    """The kept bits of every table, as signed longs. Levels permute the vectors."""
    n = 2 ** (radius + 1) - 1
    bits = np.arange(64) if not level else np.random.default_rng(level).permutation(64)
    vector = bits % n + 1
    out = []
    for v in range(1, n + 1):
        kept = sum(1 << i for i in range(64) if bin(int(vector[i]) & v).count("1") % 2)
        out.append(kept - (1 << 64) if kept >= 1 << 63 else kept)
    return out


def dealt(members: DataFrame, radius: int, level: int) -> DataFrame:
    """(group, fp) -> one row per table. The group of a level folds in the groups above it."""
    m = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(x).alias("m")) for t, x in enumerate(masks(radius, level))])
    each = members.withColumn("x", F.explode(m))
    key = F.xxhash64("grp", "x.t", F.col("fp").bitwiseAND(F.col("x.m")))
    return each.select(key.alias("grp"), "fp")


def _forest(grp: np.ndarray, fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that span the components inside each group; rows sorted by group."""
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    u = fp.view(np.uint64)
    a_out, b_out = [], []
    for s in range(1, len(fp)):
        same = np.flatnonzero(grp[s:] == grp[:-s])
        if not len(same):
            break
        near = same[np.bitwise_count(u[same + s] ^ u[same]) <= radius]
        for i in near.tolist():
            a, b = root(i), root(i + s)
            if a != b:
                parent[b] = a
                a_out.append(int(fp[i]))
                b_out.append(int(fp[i + s]))
    return a_out, b_out


def compared(groups: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of the groups; each group has a bounded number of members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"grp": np.array([], np.int64), "fp": np.array([], np.int64)})
        for b in batches:
            b = pd.concat([held, b], ignore_index=True)
            last = b["grp"].values == b["grp"].values[-1]  # the group that may go on in the next batch
            held, b = b[last], b[~last]
            if len(b):
                a, c = _forest(b["grp"].values, b["fp"].values, radius)
                yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(c, np.int64)})
        if len(held):
            a, c = _forest(held["grp"].values, held["fp"].values, radius)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(c, np.int64)})

    return groups.select("grp", "fp").mapInPandas(run, "a long, b long")


def links(members: DataFrame, radius: int = RADIUS, hot: int = HOT, levels: int = 4) -> DataFrame:
    """Links (a, b) that connect what links at `radius` or fewer bits connect inside each grp. members: (grp, fp), distinct."""
    ensure_shared(members.sparkSession)
    out = None
    for level in range(levels):
        groups = dealt(members, radius, level).repartition("grp")  # the only shuffle of a level: counts and join keep it
        if level:
            groups = groups.distinct()
        sizes = groups.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
        met = groups.join(sizes, "grp").checkpoint()
        last = level == levels - 1
        found = compared((met if last else met.where(F.col("n") <= hot)).repartition("grp").sortWithinPartitions("grp"), radius)
        out = found if out is None else out.unionByName(found)
        if last:
            break
        members = met.where(F.col("n") > hot).select("grp", "fp")
        if members.isEmpty():
            break
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that can be reached, for every node of an edge but the roots. Alternates large-star and small-star.
    Both sides of a join are tables of their own, so that the neighbours of a hub, under one key, are split over tasks. Each
    round stores its edges, so that the estimate of their size begins anew."""
    spark = edges.sparkSession
    ensure_shared(spark)
    e, at = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    digest = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, (e, at) = at, stored(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        remove(spark, last)
        after = digest(e)
        if before == after:
            break
        before = after
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).checkpoint()
    remove(spark, at)
    return out


def rooted(edges: DataFrame) -> DataFrame:
    """components() with a row for the roots too."""
    c = components(edges)
    return c.union(c.select("root", "root").distinct())


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id of the connected component), one row per row of docs."""
    ensure_shared(docs.sparkSession)
    fps = fingerprints(docs, shingle=shingle).checkpoint()
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(distinct.select(F.lit(0).cast("long").alias("grp"), "fp"), radius, hot))
    named = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = named.checkpoint()
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(best, "root").select(F.col("fp").alias("k"), "component_id")
    return fps.join(by_fp, fps["fp"] == by_fp["k"], "left").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes, as longs; a text without words has the one of the empty text."""
    import xxhash

    parts = [*_hashes(text, shingle)] or [np.array([xxhash.xxh64_intdigest(b"", 42)], "<u8")]
    return np.unique(np.concatenate(parts)).view(np.int64)


def _least(n: int, similarity: float) -> int:
    """Of two sets of Jaccard index `similarity` or more, ordered alike, the first so many members of each share one."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def frequent_shingles(docs: DataFrame, shingle: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that some `sample` documents, chosen by a hash, repeat (ascending), and in how many. They only order the
    shingles: whatever the order, no similar pair is missed. At most 100,000, so 1.6 MB."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, -(-docs.count() // sample)))) == 0)
    each = with_text_columns(some.select("text").distinct(), [], lambda: lambda t: [[shingle_hashes(x, shingle) for x in t]], "sh array<long>")
    often = each.select(F.explode("sh").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 2")
    got = sorted((r["s"], r["n"]) for r in often.orderBy(F.desc("n"), "s").limit(100_000).collect())
    return np.array([x[0] for x in got], np.int64), np.array([x[1] for x in got], np.int64)


#: Shingles posted beyond those that any order needs, in parts of a text's: similar texts then share some such part of them.
MORE = 0.05


def _posts_of(n, similarity: float):
    """How many first shingles a text of n posts."""
    return np.minimum(n, n - np.ceil(similarity * n - 1e-9) + 1 + np.ceil(MORE * n)).astype(np.int64)


def _needed(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """How many posted shingles two texts of n and m shingles share at least if they are similar: for any m, 1 + MORE * n at
    least (or all that n posts)."""
    both = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    return np.maximum(both - np.maximum(n - _posts_of(n, similarity), m - _posts_of(m, similarity)), 1).astype(np.int32)


def _posted(shingle: int, similarity: float, hot: int, often, seen_most: int = 1_000_000):
    """Rows (node, text) -> (s, node, n): the first shingles of every text, n of them in all. A text that the task has
    posted already is left out. Where more than `hot` texts of a batch have an s, s is common: each of them has it as (node, s,
    -n), dealt out by node, and one row (s, node, 0) tells where s goes, so that no task gathers all that have s."""

    def run(batches):
        import pyarrow as pa

        known, count = often.value
        seen: set[int] = set()
        for b in batches:
            nodes, texts = b.column(0).to_pylist(), b.column(1)
            firsts, owners, sizes = [], [], []
            for i, node in enumerate(nodes):
                if node in seen:
                    continue
                if len(seen) >= seen_most:
                    seen.clear()
                seen.add(node)
                h = shingle_hashes(texts[i].as_py(), shingle)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                times = np.where(known[at] == h, count[at], 0) if len(known) else np.zeros(len(h), np.int64)
                firsts.append(h[np.lexsort((h, times))[: int(_posts_of(len(h), similarity))]])
                owners.append(node)
                sizes.append(len(h))
            if not owners:
                continue
            length = [len(f) for f in firsts]
            s, node, n = np.concatenate(firsts), np.repeat(np.array(owners, np.int64), length), np.repeat(np.array(sizes, np.int64), length)
            o = np.lexsort((node, s))
            s, node, n = s[o], node[o], n[o]
            begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[begin, len(s)])
            if (size > hot).any():
                many, mark = np.repeat(size > hot, size), begin[size > hot]
                s, node, n = np.r_[s[~many], node[many], s[mark]], np.r_[node[~many], s[many], node[mark]], np.r_[n[~many], -n[many], np.zeros(len(mark), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(node), pa.array(n.astype(np.int32))], names=["s", "node", "n"])
            del b, texts, firsts, s, node, n, o
        seen.clear()
        give_back()

    return run


def _met(similarity: float, hot: int):
    """Rows (s, node, n), sorted by s and node -> (a, b, need, n): a pair of nodes for each s that at most `hot` nodes share and
    whose sizes allow it, need being _needed(); of an s that more share, or that is told to be common, (node, s, 0, n) each."""

    def run(batches):
        import pyarrow as pa

        def out(a, b, need, n):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need.astype(np.int32)), pa.array(n.astype(np.int32))], names=["a", "b", "need", "n"])

        held = [np.array([], np.int64)] * 3
        common = None  # an s beyond `hot` that may go on in the next batch
        for b in _and_end(batches):
            s, node, n = held
            if b is not None:
                s, node, n = (np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, x in enumerate(held))
            if (has := n < 0).any():
                yield out(s[has], node[has], np.zeros(int(has.sum())), -n[has])
                s, node, n = s[~has], node[~has], n[~has]
            if common is not None and (more := s == common).any():
                own = more & (n > 0)
                yield out(node[own], s[own], np.zeros(int(own.sum())), n[own])
                s, node, n = s[~more], node[~more], n[~more]
            held = [s[:0], node[:0], n[:0]]
            if not len(s):
                continue
            told = np.unique(s[n == 0])
            begin = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (node[1:] != node[:-1])])  # of equal (s, node) one stays
            s, node, n = s[begin], node[begin], np.maximum.reduceat(n, begin)
            begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[begin, len(s)])
            many = (size > hot) | np.isin(s[begin], told)
            if b is not None:  # the last s may go on
                if many[-1]:
                    common = int(s[-1])
                else:
                    last = begin[-1]
                    held = [s[last:], node[last:], n[last:]]
                    s, node, n, size, many = s[:last], node[:last], n[:last], size[:-1], many[:-1]
            of = np.repeat(many, size)
            if (own := of & (n > 0)).any():
                yield out(node[own], s[own], np.zeros(int(own.sum())), n[own])
            keep = ~of & np.repeat(size > 1, size)
            s, node, n = s[keep], node[keep], n[keep]
            for k in range(1, min(hot, len(s))):
                i = np.flatnonzero(s[k:] == s[:-k])
                if not len(i):
                    break
                i = i[np.minimum(n[i], n[i + k]) >= similarity * np.maximum(n[i], n[i + k])]
                if len(i):
                    yield out(node[i], node[i + k], _needed(n[i], n[i + k], similarity), np.zeros(len(i)))

    return run


def _and_end(batches):
    yield from batches
    yield None


def candidate_groups(posts: DataFrame, similarity: float, hot: int, linked: DataFrame | None = None) -> DataFrame:
    """(node, grp) of the nodes that are candidates, connected by all pairs of Jaccard index `similarity` or more, but for
    pairs that are linked already: linked has (node, root) of nodes that are connected with another, their root.

    Similar texts share a known number of posted shingles (_needed()). Pairs are counted over the shingles that at most `hot`
    nodes post. Of the others, the common ones, no pairs are made: a node's number of them is what they could add at most
    to a count. Where that alone could be enough, as in large groups of copies but not in texts that merely have some passage
    in common, the nodes that share one are linked through the least of them."""
    met = posts.repartition("s").sortWithinPartitions("s", "node").mapInArrow(_met(similarity, hot), "a long, b long, need int, n int")
    met = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.max("need").alias("need"), F.max("n").alias("n")).checkpoint()
    has = met.where("need = 0").select(F.col("a").alias("node"), F.col("b").alias("s"), "n")
    of = has.groupBy("node").agg(F.count("*").alias("h"), F.max("n").alias("n")).checkpoint()
    pairs = met.where("need > 0").select("a", "b", "k", "need")
    about = of.withColumn("root", F.col("node")) if linked is None else of.join(linked, "node", "full").checkpoint()
    for c in ("a", "b"):
        pairs = pairs.join(about.select(F.col("node").alias(c), F.col("h").alias(f"h{c}"), F.col("root").alias(f"root{c}")), c, "left")
    apart = F.coalesce("roota", "a") != F.coalesce("rootb", "b")
    pairs = pairs.where(apart & (F.col("k") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= F.col("need"))).select("a", "b")
    enough = of.where(F.col("h") >= F.least(1 + F.ceil(MORE * F.col("n")), F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1)).select("node")
    heavy = has.join(enough, "node").select("s", "node").checkpoint()
    least = heavy.groupBy("s").agg(F.min("node").alias("least"), F.count("*").alias("m")).where("m > 1").select("s", "least").checkpoint()
    links_ = heavy.join(least, "s").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return rooted(pairs.union(links_).distinct().checkpoint()).select("node", F.col("root").alias("grp"))


def _spanning(ids: list[int], sides: np.ndarray, sets: list[np.ndarray], similarity: float, classes: list[int] | None = None) -> list[tuple[int, int]]:
    """(id, least id of its component) of the similar pairs of sets of different sides (side -1: of any two). What has one
    class is connected already."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))  # rarest first, so that common shingles give no candidates
    at = rank[at]
    order = np.lexsort((at, owner))
    at = at[order]
    starts = np.concatenate([[0], np.cumsum(size)])
    own = [at[starts[i] : starts[i + 1]] for i in range(len(sets))]

    def posting(ranks: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o = np.argsort(ranks, kind="stable")
        return who[o], np.searchsorted(ranks[o], np.arange(len(rank) + 1))

    first = [x[: _least(len(x), similarity)] for x in own]
    few, few_at = posting(np.concatenate(first), np.repeat(np.arange(len(sets)), [len(x) for x in first]))
    all_, all_at = posting(at, owner)
    label = np.arange(len(sets)) if classes is None else np.unique(classes, return_inverse=True)[1]
    for i in range(len(sets)):
        c = np.concatenate([few[few_at[r] : few_at[r + 1]] for r in first[i].tolist()])
        c = c[(c < i) & (label[c] != label[i])]
        c = np.unique(c[(sides[c] != sides[i]) | (sides[c] < 0)])
        c = c[np.minimum(size[c], size[i]) >= similarity * np.maximum(size[c], size[i])]
        if len(c) > 32:
            common = np.bincount(np.concatenate([all_[all_at[r] : all_at[r + 1]] for r in own[i].tolist()]), minlength=len(sets))[c]
        else:
            common = np.array([len(np.intersect1d(own[i], own[j], assume_unique=True)) for j in c.tolist()], np.int64)
        for j in c[common / (size[c] + size[i] - common) >= similarity].tolist():
            if label[i] != label[j]:
                label[label == label[i]] = label[j]
    least: dict[int, int] = {}
    for x, k in zip(ids, label.tolist()):
        least[k] = min(x, least.get(k, x))
    return [(x, least[k]) for x, k in zip(ids, label.tolist()) if x != least[k]]


def tiled(members: DataFrame, texts, similarity: float, shingle: int, *, most: int = 2048, chars: int = 6_000_000) -> DataFrame:
    """Links (a, b) that connect what the similar pairs inside each grp connect. members: grp, node, root (nodes of one root
    are connected already), size (of the text); texts(members) adds the texts.

    A grp is cut into tiles of some `most` rows and `chars` characters; every two tiles meet in a task of their own, so
    no task grows with a grp.
    """
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("size") / chars)).alias("t"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("grp", "t").checkpoint()
    each = members.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("t")))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(i == j, -1).otherwise((F.col("own") == i).cast("int"))
    each = texts(each.withColumns({"i": i, "j": j, "side": side}).drop("own", "other", "t", "size"))
    placed = each.select("grp", "i", "j", "side", "node", "text", "root").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")

    def run(batches):
        import pyarrow as pa

        at, ids, sides, sets, roots = None, [], [], [], []

        def done():
            found = _spanning(ids, np.array(sides), sets, similarity, roots) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6)]
            for r in range(b.num_rows):
                if (group := (cols[0][r], cols[1][r], cols[2][r])) != at:
                    yield done()
                    at, ids, sides, sets, roots = group, [], [], [], []
                ids.append(cols[4][r])
                sides.append(cols[3][r])
                roots.append(cols[5][r])
                sets.append(shingle_hashes(b.column(5)[r].as_py(), shingle))
        yield done()
        at, ids, sides, sets, roots = None, [], [], [], []
        give_back()

    return placed.mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, sample: int = 4096, hot: int = 64) -> DataFrame:
    """The rows of docs without near-duplicates: of each group, the row of least doc_id stays (null ids last; of equal ids
    the one whose text and then whose columns have the least hash; of rows equal in all columns one). Two texts are
    near-duplicates if the Jaccard index of their word shingles is at least `similarity`; a group is a connected component.

    1. Texts with the same words (A-Z lower-cased) are copies and one node, named by 64 bits of a hash of the words.
    2. near_duplicates() gives the nodes' components by SimHash and covering tables, with op5's shingles and radius; tiled()
       compares the texts of each exactly. The links that hold are found.
    3. What they leave apart: each node posts its first shingles; candidate_groups() connects all that may be similar and
       misses no similar pair but those linked already. tiled() compares the texts of each group exactly, but for those.
    4. Of each component of both kinds of links one row stays, as in op5: a text that goes still links its neighbours.

    Step 3 is there since texts of Jaccard index 0.8 differ in some ten bits of 64 and often in twenty: tables that miss none
    would be 2^21.
    """
    spark = docs.sparkSession
    ensure_shared(spark)
    key, node, row = unused(docs, "key"), unused(docs, "node"), unused(docs, "row")
    words = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    d = docs.select("*", F.unhex(F.md5(words.cast("binary"))).alias(key)).withColumns({node: F.xxhash64(key), row: F.xxhash64(*plain)})
    often = spark.sparkContext.broadcast(frequent_shingles(docs, shingle, sample))
    with nothing_broadcast(spark):
        posts = d.select(F.col(node).alias("node"), "text").mapInArrow(_posted(shingle, similarity, hot, often), "s long, node long, n int")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("t"), F.col(row).alias("r"))
        nodes = d.groupBy(F.col(key).alias("key"), F.col(node).alias("node")).agg(F.min(order).alias("o"), F.max(F.length("text")).alias("size")).checkpoint()
        of = nodes.select("node", F.col("o.doc_id").alias("keep"), F.col("o.r").alias("r"), F.coalesce("size", F.lit(0)).alias("size"))

        def texts(members: DataFrame) -> DataFrame:
            some = d.select(F.col(node).alias("k"), F.col("doc_id").alias("k2"), F.col(row).alias("k3"), "text")
            return members.join(some, (F.col("node") == F.col("k")) & F.col("keep").eqNullSafe(F.col("k2")) & (F.col("r") == F.col("k3"))).dropDuplicates(["grp", "i", "j", "node"])

        near = near_duplicates(d.select(F.col(node).alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), F.col("component_id").alias("grp")).distinct()
        found = tiled(near.join(of, "node").withColumn("root", F.col("node")).checkpoint(), texts, similarity, shingle).distinct().checkpoint()
        linked = found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).checkpoint()  # a group of one tile whole, others in part
        give_back()
        groups = candidate_groups(posts, similarity, hot, linked).join(of, "node").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")).checkpoint()
        comp = components(found.union(tiled(groups, texts, similarity, shingle)).distinct())
        named = nodes.join(comp, "node", "left").select("key", "o", F.coalesce("root", "node").alias("comp"))
        kept = named.groupBy("comp").agg(F.min(F.struct("o", "key")).alias("k")).select(F.col("k.key").alias("k1"), F.col("k.o.doc_id").alias("k2"), F.col("k.o.r").alias("k3")).checkpoint()
    kept = kept.toDF(*[unused(docs, f"kept{i}") for i in range(3)])
    a, b, c = kept.columns
    out = d.join(kept, (F.col(key) == F.col(a)) & F.col("doc_id").eqNullSafe(F.col(b)) & (F.col(row) == F.col(c))).dropDuplicates([a, b, c])
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
