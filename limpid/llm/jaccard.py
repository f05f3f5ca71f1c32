"""N-gram Jaccard join by T-occurrence search.

A document is the set of its word shingles. Equal sets are one class. Two classes can only link if they share one of
the few shingles that come first in a global order, so a class is filed under these alone: they are its short inverted
lists, and shingles that many documents hold come last in the order. Classes that meet on a short list form blocks. In
a block, DivideSkip answers each set as a query: the short lists are merged, counting occurrences, and the long lists
are binary-probed for the candidates that can still reach the required overlap. Sets already connected are not probed
again, so a group of copies costs about one probe for each member; links are then joined to components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.arrow import expand, stream
from limpid.llm.graph import components
from limpid.llm.spark import NO_ID, discard, id_key, materialise, partitions_for, shuffle_partitions
from limpid.llm.words import FOLDED, slices

HEAVY = np.uint64(1 << 63)
#: A shingle that this share of the documents holds is heavy: it comes last in the order. There are at most
#: (mean set size / HEAVY_SHARE) of them, whatever the corpus.
HEAVY_SHARE = 0.005
#: Bins of a histogram.
BINS = 256
#: Sets in one block; larger blocks are split by size, then into pieces, which some hubs connect first.
BLOCK = 1024
HUBS = 8
#: Documents for each task of a shuffle, about.
PER_TASK = 20_000

L, D = T.LongType(), T.ArrayType(T.LongType())
SETS = T.StructType([T.StructField("doc", L), T.StructField("n", L), T.StructField("sig", L), T.StructField("sig2", L), T.StructField("bins", T.BinaryType()), T.StructField("heavy", D), T.StructField("heavy_n", D)])
TOKENS = T.StructType([T.StructField("token", L), T.StructField("late", T.BooleanType()), T.StructField("sig", L)])


def need(total: np.ndarray | int, percent: int):
    """The least overlap with which two sets of `total` elements together link: 100 * both >= percent * (total - both)."""
    return -(-(percent * total) // (100 + percent))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles (63 bits)."""
    for w in slices(column, FOLDED):
        at, first = w.starts_of(width)
        h = w.runs(at, width) >> np.uint64(1)
        counts = w.counts
        for d in range(w.hi - w.lo):
            if counts[d] >= width:
                yield np.unique(h[first[d] : first[d + 1]])
            elif counts[d]:
                yield w.runs(w.first[d : d + 1], int(counts[d])) >> np.uint64(1)
            else:
                yield h[:0]


def signature(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (d & (2**64 - 1)) - 2**63, (d >> 64) - 2**63


def histogram(tokens: np.ndarray) -> bytes:
    """How many tokens have each value of 8 of their bits, 255 at most."""
    return np.minimum(np.bincount((tokens & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Each document's set size and signature; the first row of a batch also carries shingles frequent in that batch."""

    def make(b: pa.RecordBatch):
        doc, n, sig, sig2, bins, every = b.column(0), [], [], [], [], []
        for s in shingle_sets(b.column(1), width):
            n.append(len(s))
            a, c = signature(s)
            sig.append(a)
            sig2.append(c)
            bins.append(histogram(s))
            every.append(s)
        if n:
            tokens, count = np.unique(np.concatenate(every), return_counts=True)
            often = count >= max(4, HEAVY_SHARE * len(n))
            none = [[]] * (len(n) - 1)
            yield {"doc": doc, "n": n, "sig": sig, "sig2": sig2, "bins": bins, "heavy": [tokens[often].astype(np.int64), *none], "heavy_n": [count[often], *none]}

    return expand(docs.select("doc", "text"), SETS, make)


def prefix_tokens(docs: DataFrame, width: int, percent: int, heavy) -> DataFrame:
    """Short inverted lists: the first shingles of each set in the global order (light before heavy, then by hash).

    late: the shingle lies beyond the prefix that a set needs against sets of its own size or more.
    """

    def make(b: pa.RecordBatch):
        token, late, sig, seen = [], [], [], set()
        for s in shingle_sets(b.column(1), width):
            n = len(s)
            a = signature(s)
            if not n or a in seen:  # copies in a batch are filed once
                continue
            seen.add(a)
            i = np.searchsorted(heavy.value, s)
            i[i == len(heavy.value)] = 0
            key = np.sort(np.where(heavy.value[i] == s, s | HEAVY, s)) if len(heavy.value) else s
            p = n - -(-(percent * n) // 100) + 1
            token.append(key[:p])
            late.append(np.arange(p) > n - need(2 * n, percent))
            sig.append(np.full(p, a[0]))
        if token:
            yield {"token": np.concatenate(token).view(np.int64), "late": np.concatenate(late), "sig": np.concatenate(sig)}

    return expand(docs.select("doc", "text"), TOKENS, make)


def meet(tokens: DataFrame, tasks: int) -> DataFrame:
    """(block, sig): the sets that meet on a list, under the first of them. Lists are sorted and streamed."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, anchor, told = None, None, False
        for b in batches:
            t, late, s = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            if not len(t):
                continue
            begin = np.r_[token is None or t[0] != token, t[1:] != t[:-1]]
            run = np.cumsum(begin) - 1 + (not begin[0])  # 0: goes on from the batch before
            firsts = np.flatnonzero(begin)
            anchors = np.r_[[anchor] if anchor is not None else [0], s[firsts]]
            usable = np.r_[[anchor is not None], ~late[firsts]]
            ids = run if not begin[0] else run + 1
            a = anchors[ids].astype(np.int64)
            keep = usable[ids] & (s != a)
            pairs = np.unique(np.stack([a[keep], s[keep]]), axis=1)
            own = np.unique(pairs[0])
            token = t[-1]
            anchor = int(a[-1]) if usable[ids[-1]] else None
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[pairs[0], own]), pa.array(np.r_[pairs[1], own])], ["block", "sig"])

    return stream(tokens.repartition(tasks, "token").sortWithinPartitions("token", "late", "sig"), step, "block long, sig long").distinct()


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def merge(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least `least` of some sorted lists, and of how many: a heap merge, or a sort if the lists are long."""
    if sum(map(len, lists)) <= 200:
        got = [(k, n) for k, g in groupby(heapq.merge(*(x.tolist() for x in lists))) if (n := sum(1 for _ in g)) >= least]
        return np.array([k for k, _ in got], np.int64), np.array([n for _, n in got], np.int64)
    member, n = np.unique(np.concatenate(lists), return_counts=True)
    return member[n >= least], n[n >= least]


def divide_skip(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links between sets, as many as it takes to connect all that are connected by links."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    owner = np.repeat(np.arange(len(order)), size)
    tokens, code = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    by = np.argsort(code, kind="stable")
    posting, lo = owner[by], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(tokens)))])
    off, forest = np.concatenate([[0], np.cumsum(size)]), Forest(len(order))
    for x in range(1, len(order)):
        n = int(size[x])
        smallest = int(np.searchsorted(size, -(-percent * n // 100)))  # shorter sets can't reach the overlap
        if smallest >= x:
            continue
        least = int(need(n + int(size[smallest]), percent))
        mine = code[off[x] : off[x + 1]]
        length = lo[mine + 1] - lo[mine]
        rank = np.argsort(length, kind="stable")
        long = least - 1 if length[rank[-1]] < 64 else max(0, min(least - 1, int(least / (0.0085 * np.log2(length[rank[-1]]) + 1))))
        short, probed = mine[rank[: n - long]], mine[rank[n - long :]]
        member, count = merge([p[np.searchsorted(p, smallest) : np.searchsorted(p, x)] for p in (posting[lo[c] : lo[c + 1]] for c in short.tolist())], least - long)
        for y, c in zip(member.tolist(), count.tolist(), strict=True):
            if forest.find(x) == forest.find(y):
                continue
            other, want = code[off[y] : off[y + 1]], int(need(n + int(size[y]), percent))
            i = np.minimum(np.searchsorted(other, probed), len(other) - 1)  # codes follow the order of tokens, so they are sorted
            if c + int((other[i] == probed).sum()) >= want and forest.join(x, y):
                yield order[x], order[y]


def sieve(size: np.ndarray, bins: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Groups of two or more sets outside of which, by sizes and histograms, no set of a group can have a link."""
    left = np.arange(len(size))
    while len(left) > 1:
        group, edge, left = [left[:1]], [int(left[0])], left[1:]
        while edge and len(left):
            x = edge.pop()
            apart = np.abs(bins[left] - bins[x]).sum(1)
            total = size[left] + size[x]
            near = (apart <= total - 2 * need(total, percent)) & (100 * np.minimum(size[left], size[x]) >= percent * np.maximum(size[left], size[x]))
            if near.any():
                group.append(left[near])
                edge += left[near].tolist()
                left = left[~near]
        if len(group) > 1:
            yield np.concatenate(group)


def sieved(rows: DataFrame, percent: int, tasks: int) -> DataFrame:
    """rows (block, part, node, n, bins) -> (block, node): groups of each part that may hold links, named by a hash of
    their members, as many blocks hold the same ones."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, told = None, [], set()

        def close():
            nodes, size = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
            bins = np.frombuffer(b"".join([x[2] for x in held]), np.uint8).reshape(len(held), -1).astype(np.int16)
            for own in sieve(size, bins, percent):
                own = np.sort(nodes[own])
                name = xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63
                if name not in told:
                    told.add(name)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), name)), pa.array(own)], ["block", "node"])

        for b in batches:
            for block, part, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, part) != key:
                    if len(held) > 1:
                        yield from close()
                    key, held = (block, part), []
                held.append(x)
        if len(held) > 1:
            yield from close()

    return stream(rows.repartition(tasks, "block", "part").sortWithinPartitions("block", "part"), step, "block long, node long").distinct()


def block_links(rows: DataFrame, width: int, percent: int, tasks: int) -> DataFrame:
    """rows (block, node, text), all of a block in one partition and in order -> links (a, b)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def close():
            got = [(nodes[a], nodes[b]) for a, b in divide_skip(sets, percent)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for block, node, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2), width), strict=True):
                if block != key:
                    if len(sets) > 1:
                        yield close()
                    key, nodes, sets = block, [], []
                nodes.append(node)
                sets.append(tokens)
        if len(sets) > 1:
            yield close()

    return stream(rows.repartition(tasks, "block").sortWithinPartitions("block"), step, "a long, b long")


PART = ("block", "part", "node", "n", "bins")


def parted(filed: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(block, part, node, n, bins) of blocks that one task can take, and (block, band, i, k, node, n, bins) of those with
    more than `block` sets, in k pieces.

    A larger block is split by sizes first: linked sets lie in the same or in neighbouring bands, a band ending at
    100 / percent times its beginning, so a part of two neighbouring bands has each set twice.
    """
    # Written, as are the classes, so that Spark can split a block that very many sets are in.
    large = materialise(filed.groupBy("block").agg(F.count("*").alias("m")).filter(F.col("m") > block).select("block", F.lit(True).alias("large")), "large")
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) * (1 - 1e-9)) if percent < 100 else F.col("n")
    own = filed.join(large, "block", "left").withColumn("band", F.explode(F.when(F.col("large"), F.array(band, band + 1)).otherwise(F.array(F.lit(0).cast("long")))))
    pieces = materialise(own.filter("large").groupBy("block", "band").agg(F.ceil(F.count("*") / block).alias("k")).filter("k > 1"), "pieces")
    split = own.join(pieces, ["block", "band"], "left")
    small = split.filter("k is null").select("block", F.xxhash64("band").alias("part"), "node", "n", "bins")
    return small, split.filter("k is not null").select("block", "band", F.pmod(F.xxhash64("node"), "k").alias("i"), "k", "node", "n", "bins")


def hubbed(large: DataFrame) -> DataFrame:
    """Each piece of a large block with a few of the block's sets, its hubs, beside its own."""
    first = Window.partitionBy("block", "band").orderBy(F.xxhash64("node", F.lit(1)), "node")
    hubs = large.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= HUBS).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).filter("to <> i")
    every = large.withColumn("to", F.col("i")).unionByName(hubs.drop("r"))
    return every.select("block", F.xxhash64("band", "to", F.lit("hub")).alias("part"), "node", "n", "bins")


def crossed(large: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """What pieces and hubs leave open in a large block: its sets outside of its largest component meet all of its sets.
    As nearly all sets of a large group of copies link with a hub, these are few."""
    tagged = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = tagged.groupBy("block", "band", "component").agg(F.count("*").alias("m"))
    main = materialise(sizes.groupBy("block", "band").agg(F.max(F.struct("m", "component"))["component"].alias("main"), (F.sum("m") - F.max("m")).alias("rest")).filter("rest > 0"), "main")
    open_ = tagged.join(main, ["block", "band"]).withColumn("u", F.ceil(F.col("rest") / block))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    rows = open_.withColumn("j", to(F.col("u")))
    asked = open_.filter("component <> main").withColumn("j", F.pmod(F.xxhash64("node", F.lit(2)), "u")).withColumn("i", to(F.col("k")))
    cells = rows.unionByName(asked).withColumn("part", F.xxhash64("band", "i", "j", F.lit("cross")))
    return cells.select(*PART).dropDuplicates(["block", "part", "node"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id) for each row: the set's size and the smallest id reachable by links.

    Two documents link when their sets of `width`-word shingles have 100 * both >= percent * either. A text with fewer
    words is one shingle; one without words, or null, has none and links with nothing. Ids are whole numbers. Rows of the same id are one
    document with the links of all its rows. Rows without an id count as one document whose id is smaller than any.
    """
    own = docs.select(id_key(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    sets = materialise(describe(own, width), "sets")
    total = sets.count()
    tasks = max(shuffle_partitions(spark), partitions_for(total, PER_TASK))
    often = sets.filter(F.size("heavy") > 0).select(F.explode(F.arrays_zip("heavy", "heavy_n")).alias("x")).groupBy("x.heavy").agg(F.sum("x.heavy_n").alias("n")).filter(F.col("n") >= max(4, HEAVY_SHARE * total))
    heavy = spark.sparkContext.broadcast(np.sort(np.array([r.heavy for r in often.select("heavy").collect()], np.int64).astype(np.uint64)))

    # A class is known by its first document; two sets with the same first 64 bits of signature would only share blocks.
    # Written, so that joins to it have an exchange of their own on both sides and Spark can split a set that very many
    # documents have.
    classes = sets.filter("n > 0").groupBy("sig", "sig2").agg(F.min(F.struct("doc", "n", "bins")).alias("x")).select("sig", "sig2", F.col("x.doc").alias("node"), "x.n", "x.bins")
    classes = materialise(classes, "classes")
    members = materialise(meet(prefix_tokens(own, width, percent, heavy), tasks), "blocks")
    small, large = parted(materialise(members.join(classes, "sig").select("block", "node", "n", "bins"), "filed"), percent, block)
    repeated = has_repeated_ids(sets)

    def true_rows(b: pa.RecordBatch):
        at = {c: b.column(b.schema.names.index(c)) for c in b.schema.names}
        good = [i for i, (s, x, y) in enumerate(zip(shingle_sets(at["text"], width), at["sig"].to_pylist(), at["sig2"].to_pylist(), strict=True)) if signature(s) == (x, y)]
        yield {c: at[c].take(pa.array(good, pa.int64())) for c in ("node", "text", "blocks")}

    def links_in(parts: DataFrame) -> DataFrame:
        groups = materialise(sieved(parts, percent, tasks), "groups")
        wanted = groups.groupBy("node").agg(F.collect_list("block").alias("blocks")).join(classes.select("node", "sig", "sig2"), "node").select(F.col("node").alias("doc"), "node", "sig", "sig2", "blocks")
        texts = own.join(wanted.hint("shuffle_hash"), "doc").filter(F.col("text") != "")
        kinds = {f.name: f for f in texts.schema}
        rows = expand(texts, T.StructType([kinds["node"], kinds["text"], kinds["blocks"]]), true_rows) if repeated else texts
        links = materialise(block_links(rows.select(F.explode("blocks").alias("block"), "node", "text"), width, percent, tasks), "links")
        discard(spark, groups)
        return links

    same = sets.filter("n > 0").join(classes.select("sig", "sig2", "node"), ["sig", "sig2"]).groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("all")).filter("a <> b").select("a", F.explode("all").alias("b"))
    is_large = bool(large.head(1))
    links = links_in(small.unionByName(hubbed(large)) if is_large else small)
    found = components(links.union(same))
    if is_large:
        more = links_in(crossed(large, found, block))
        found = components(links.union(same).union(more)) if more.head(1) else found
    discard(spark, members)
    named = sets.select("doc", "n", "sig", "sig2").join(classes.select("sig", "sig2", "node"), ["sig", "sig2"], "left").join(found, "node", "left")
    null_id = F.lit(None).cast("long")
    show = lambda c: F.when(c == NO_ID, null_id).otherwise(c)
    return named.select(show(F.col("doc")).alias(id_col), F.col("n").alias("n_shingles"), show(F.coalesce("component", "node", "doc")).alias("component_id"))


def has_repeated_ids(sets: DataFrame) -> bool:
    """Whether an id has more than one set, so that its rows must be told apart by signature."""
    return bool(sets.groupBy("doc").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).filter("a <> b").head(1))
