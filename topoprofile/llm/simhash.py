"""SimHash near-duplicates: fingerprints, and a binary-trie self-join under a Hamming budget.

A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are runs of
``width`` words joined by a space, repeats included (a shorter text: all its
words as one shingle; no word: fingerprint 0). A bit of the fingerprint is 1 if
it is set in over half of the shingles' XXH64 hashes (UTF-8, seed 42).

Links are pairs of fingerprints with at most ``budget`` differing bits. The 64
bits are cut into ``budget + agree`` blocks; a linked pair agrees on ``agree``
whole blocks at least, so for each choice of so many blocks the distinct
fingerprints are dealt by their values, the top of a trie over the bits in that
order. Below it node pairs are
traversed together: each step splits both nodes by the next bit, adds one to the
differing bits where the branches part, and drops the pair once the budget is
exceeded. Buckets over ``BUCKET`` fingerprints are cut into slices, and every
pair of slices becomes a task of its own, so no task grows with a bucket. A task
hands on spanning forests of its links, never all pairs; components follow from
those by star contraction.

``keep_one`` (the corpus filter) takes five-word shingles and a budget of eight
bits in any of ``SEEDS`` independent fingerprints (texts that share 0.8 of their
shingles differ in about ten bits of one), and keeps only links whose texts do
share 0.8 of their shingles, so chance neighbours stay apart. Forests only tell
which texts may be linked at all: within those groups every pair is tested, in
tasks of two slices, and a task's forest is of links that passed. Only rows of
equal lower-cased words are taken as one untested; equal fingerprints are not.

Defined cases. Null text: no words. Equal fingerprints link, fingerprint 0 too.
Null document ids take part, and are named only if a component has no other id
(then null). Repeated rows are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoprofile.llm.files import small_batches
from topoprofile.llm.joins import BROADCAST_ROWS, join_lookup
from topoprofile.operators.components import connected_components
from topoprofile.runtime import materialize

SEED = 42
WIDTH = 4
BUDGET = 4
#: Fingerprints of a text in ``keep_one``: of the same shingle hashes, mixed anew for each.
SEEDS = 4
#: Fingerprints of a bucket that one task takes.
BUCKET = 50_000
#: Slices of one bucket have 16 bits in a task's number; beyond, slices grow instead.
MOST_SLICES = (1 << 16) - 1
#: Rows a task joins at once, and node pairs it holds at once.
ROWS_AT_ONCE = 100_000
PAIRS_AT_ONCE = 150_000
#: A node pair with at most so many leaf pairs is compared leaf by leaf.
LEAVES = 64
#: Shingles of a group that one slice takes in ``keep_one``; those of over 1/COMMON of a task's texts are compared as bits.
SHINGLES = 500_000
COMMON = 32

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[:-width] if width < len(ends) else ends[:0]).tolist()
    starts.insert(0, 0)
    stops = (ends[width - 1 :] - 1).tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def _majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits).view(">u8")[0])


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same shingles; seed 0: the hashes themselves."""
    if not seed:
        return hashes
    out = hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ out >> np.uint64(shift)) * np.uint64(factor)
    return out ^ out >> np.uint64(31)


def fingerprint_of(text: str | None, width: int = WIDTH) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return _majority(_shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long."""

    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, width) for t in texts], np.uint64).view(np.int64))

    small_batches(docs.sparkSession)
    return docs.withColumn("fp", F.pandas_udf(hashed, "long")(F.col(text)))


def _digest(text: str | None) -> int:
    """64 bits of BLAKE2b over the lower-cased words: two of 15 million texts collide with a chance of 6e-6."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "big")


def several_fingerprints(docs: DataFrame, width: int, seeds: int = SEEDS) -> DataFrame:
    """``doc_id, _row, id`` (of the lower-cased words) and ``fp``, ``fp1`` ...: a text's fingerprint, and those of its shingles' mixed hashes."""
    names = ["id", "fp", *(f"fp{k}" for k in range(1, seeds))]

    def hashed(texts: pd.Series) -> pd.DataFrame:
        out = np.empty((len(texts), 1 + seeds), np.uint64)
        for k, text in enumerate(texts):
            hashes = _shingle_hashes(text, width)
            out[k] = [_digest(text), *(_majority(_mixed(hashes, seed)) for seed in range(seeds))]
        return pd.DataFrame(out.view(np.int64), columns=names)

    small_batches(docs.sparkSession)
    made = docs.select("doc_id", "_row", F.pandas_udf(hashed, ", ".join(f"{n} long" for n in names))("text").alias("f"))
    return made.select("doc_id", "_row", "f.*")


def _stars(n: int, i: np.ndarray, j: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links (i, j), and from each to its ``known`` one."""
    label = np.arange(n) if known is None else known.copy()
    while True:
        low = np.minimum(label[i], label[j])
        if np.array_equal(low, label[i]) and np.array_equal(low, label[j]):
            return label
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def _forests(n: int, i: np.ndarray, j: np.ndarray, forests: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``forests`` edge-disjoint spanning forests of the links (i, j); nodes of one ``known`` label count as joined."""
    left, chosen = np.arange(len(i)), []
    for _ in range(forests):
        label, taken = np.arange(n) if known is None else known, np.zeros(len(i), bool)
        while len(cross := left[label[i[left]] != label[j[left]]]):
            # each component takes its first link that leaves it
            pick = np.full(n, len(i))
            np.minimum.at(pick, label[i[cross]], cross)
            np.minimum.at(pick, label[j[cross]], cross)
            taken[pick[pick < len(i)]] = True
            label = _stars(n, i[taken], j[taken], known)
        chosen.append(np.flatnonzero(taken))
        left = left[~taken[left]]
    chosen = np.concatenate(chosen)
    return i[chosen], j[chosen]


def _leaf_pairs(bits: np.ndarray, node: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    alo, ahi, blo, bhi = node[:, :4].T
    sizes = (ahi - alo) * (bhi - blo)
    which = np.repeat(np.arange(len(node)), sizes)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = (bhi - blo)[which]
    i, j = alo[which] + nth // wide, blo[which] + nth % wide
    near = (i < j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget)
    return i[near], j[near]


def trie_links(group: np.ndarray, bits: np.ndarray, budget: int, depth: int, forests: int = 1, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Self-join of the tries of each group: links (row, row) of spanning forests.

    Rows are sorted by (group, bits) and distinct; ``bits`` agree within a group
    on the first ``depth`` bits. A node is a range of rows; a node pair is (lo,
    hi) of either node and the differing bits so far. ``known`` names for each
    row the first of those it is already joined to.
    """
    n = len(bits)
    label = np.arange(n) if known is None else known
    starts = np.flatnonzero(np.r_[n > 0, group[1:] != group[:-1]])
    stops = np.r_[starts[1:], n]
    several = stops - starts > 1
    roots = np.stack([starts, stops, starts, stops, np.zeros_like(starts)], axis=1)[several]
    ones: dict[int, np.ndarray] = {}
    links = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    held = chosen = 0
    stack = [(depth, roots)] if len(roots) else []
    while stack:
        at, pairs = stack.pop()
        if len(pairs) > PAIRS_AT_ONCE:
            stack += [(at, part) for part in np.array_split(pairs, -(-len(pairs) // PAIRS_AT_ONCE))]
            continue
        if (chosen or known is not None) and forests == 1:  # two nodes that are wholly in one component have nothing to add
            change = np.r_[0, np.cumsum(label[1:] != label[:-1])]
            a, b = pairs[:, 0], pairs[:, 2]
            done = (change[pairs[:, 1] - 1] == change[a]) & (change[pairs[:, 3] - 1] == change[b]) & (label[a] == label[b])
            pairs = pairs[~done]
        few = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAVES
        if at >= 64:
            few[:] = True
        i, j = _leaf_pairs(bits, pairs[few], budget)
        if len(i):
            links.append((i, j))
            held += len(i)
            if held > PAIRS_AT_ONCE + chosen:
                links = [_forests(n, *(np.concatenate(x) for x in zip(*links, strict=True)), forests, known)]
                held = chosen = len(links[0][0])
                label = _stars(n, *links[0], known)
        pairs = pairs[~few]
        if not len(pairs):
            continue
        if at not in ones:
            ones[at] = np.r_[0, np.cumsum((bits >> np.uint64(63 - at)) & np.uint64(1))].astype(np.int64)
        upto = ones[at]
        alo, ahi, blo, bhi, differ = pairs.T
        amid, bmid = ahi - (upto[ahi] - upto[alo]), bhi - (upto[bhi] - upto[blo])
        apart = differ + 1
        same = alo == blo
        branches = [
            np.stack([alo, amid, blo, bmid, differ], axis=1),
            np.stack([amid, ahi, bmid, bhi, differ], axis=1),
            np.stack([alo, amid, bmid, bhi, apart], axis=1),
            np.stack([amid, ahi, blo, bmid, apart], axis=1)[~same],
        ]
        below = np.concatenate(branches)
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        own = (below[:, 0] == below[:, 2]) & (below[:, 1] - below[:, 0] < 2)
        if len(below := below[~own]):
            stack.append((at + 1, below))
    return _forests(n, *(np.concatenate(x) for x in zip(*links, strict=True)), forests, known)


def _tables(budget: int, agree: int, disjoint: bool = False) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of ``agree`` blocks: their width, and all blocks (offset from the top, width) with those first.

    ``disjoint``: only choices that share no block.
    """
    count = budget + agree
    edges = [round(64 * k / count) for k in range(count + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    choices = zip(*[iter(blocks)] * agree, strict=False) if disjoint else combinations(blocks, agree)
    return [(sum(w for _, w in first), [*first, *(b for b in blocks if b not in first)]) for first in choices]


def _permuted(fps: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros(len(fps), np.uint64), 0
    for offset, width in blocks:
        part = (fps << np.uint64(offset)) >> np.uint64(64 - width)
        at += width
        out |= part << np.uint64(64 - at)
    return out


def _restored(bits: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints from their permuted bits."""
    out, at = np.zeros(len(bits), np.uint64), 0
    for offset, width in blocks:
        out |= (bits << np.uint64(at)) >> np.uint64(64 - width) << np.uint64(64 - offset - width)
        at += width
    return out


def blocks_to_agree(count: int, budget: int = BUDGET) -> int:
    """Blocks that name a bucket for so many fingerprints: one (13 bits of 64 under four bits' budget) while buckets of evenly
    spread ones stay far below ``BUCKET``, else two (21 bits, and more tables). All links are found either way."""
    return 1 if count <= (BUCKET >> 2) << (64 // (budget + 1)) else 2


def _large_blocks(fps: DataFrame, budget: int, agree: int, bucket: int) -> bool:
    """Whether some block value alone holds over ``bucket`` fingerprints: else no bucket, which fixes a block at least, does."""
    count = budget + agree
    edges = [round(64 * k / count) for k in range(count + 1)]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                values = (fp << np.uint64(a)) >> np.uint64(64 - b + a)
                found, n = np.unique((seed.astype(np.uint64) << np.uint64(32)) | values, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["block", "value", "n"])

    counted = fps.mapInArrow(tally, "block int, value long, n long").groupBy("block", "value").agg(F.sum("n").alias("n"))
    return (counted.agg(F.max("n")).first()[0] or 0) > bucket


def hamming_links(fps: DataFrame, budget: int = BUDGET, bucket: int = BUCKET, agree: int = 1, forests: int = 1, disjoint: bool = False) -> DataFrame:
    """``seed, src, dst``: linked pairs of the distinct ``fp`` of each ``seed`` (if there is none: 0), spanning forests of each task's links.

    Fingerprints with one ``known`` number (if there is that column; 0: none) are
    joined already: only links that lead out of such a set are found, and name it
    by that number. ``disjoint`` finds a part of the links, in few tables.
    """
    tables = _tables(budget, agree, disjoint)
    least = min(w for w, _ in tables)
    part = lambda name: F.col(name) if name in fps.columns else F.lit(0)
    fps = fps.select(part("seed").cast("int").alias("seed"), "fp", part("known").cast("long").alias("known"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed, fp, known = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2)
            for k, (width, blocks) in enumerate(tables):
                bits = _permuted(fp, blocks)
                columns = [seed * np.int32(len(tables)) + np.int32(k), (bits >> np.uint64(64 - width)).astype(np.int32), bits.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), known], names=["block", "value", "bits", "known"])

    dealt = fps.mapInArrow(deal, "block int, value int, bits long, known long")
    if _large_blocks(fps, budget, agree, bucket):
        # at most sum(2**width) buckets: a bound that does not grow with the data
        large = dealt.groupBy("block", "value").count().where(F.col("count") > bucket)
        large = materialize(large.select("block", "value", F.least(F.ceil(F.col("count") / bucket), F.lit(MOST_SLICES)).cast("int").alias("slices")), "buckets")
        sliced = dealt.join(F.broadcast(large), ["block", "value"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        sliced = sliced.withColumn("slice", F.pmod(F.xxhash64("bits"), F.col("slices")).cast("int"))
        tasks = sliced.withColumn("other", F.explode(F.expr("sequence(0, slices - 1)")))
        # slices alone make a task only where there is one slice: each pair of slices joins its own rows too
        tasks = tasks.where("slices = 1 OR other != slice").withColumn("lo", F.least("slice", "other")).withColumn("hi", F.greatest("slice", "other"))
    else:
        tasks = dealt.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
    task = F.expr("(cast(block AS bigint) << 56) | (cast(value AS bigint) << 32) | (cast(lo AS bigint) << 16) | hi")
    dealt = tasks.select(task.alias("task"), "bits", "known").repartition("task")
    dealt = dealt.sortWithinPartitions("task", F.expr("bits ^ -9223372036854775808L"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(task, bits, known):
            joined, first = np.arange(len(task)), None
            if (some := np.flatnonzero(known)).size:
                sets = np.stack([task[some], known[some]], axis=1)
                _, at, which = np.unique(sets, axis=0, return_index=True, return_inverse=True)
                joined[some] = some[at][which.ravel()]
                first = joined
            i, j = trie_links(task, bits.view(np.uint64), budget, least, forests, first)
            block = (task[i].view(np.uint64) >> np.uint64(56)).astype(np.int64)
            src, dst = np.empty(len(i), np.uint64), np.empty(len(i), np.uint64)
            for k in np.unique(block).tolist():
                mine, blocks = block == k, tables[k % len(tables)][1]
                src[mine] = _restored(bits[i[mine]].view(np.uint64), blocks)
                dst[mine] = _restored(bits[j[mine]].view(np.uint64), blocks)
            src, dst = (np.where(known[at] != 0, known[at].view(np.uint64), fp) for at, fp in ((i, src), (j, dst)))
            seed = (block // len(tables)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(seed), pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["seed", "src", "dst"])

        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) >= ROWS_AT_ONCE and (cut := int(np.searchsorted(held[0], held[0][-1]))):  # whole tasks only
                yield linked(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        yield linked(*held)

    return dealt.mapInArrow(join, "seed int, src long, dst long")


def candidate_groups(classes: DataFrame, budget: int, seeds: int = SEEDS) -> DataFrame:
    """``(id, component)`` of the classes (``id, fp, fp1`` ...) with another one within ``budget`` bits in any fingerprint.

    Fingerprints and ids are nodes of one graph, so equal numbers may only make a
    group larger. Links of the first fingerprint in few tables come first and join
    most of each large group; all tables of all fingerprints then add only links
    between those parts, named by the part, so the links grow with the members
    and not with members times tables.
    """
    own = F.posexplode(F.array("fp", *(f"fp{k}" for k in range(1, seeds)))).alias("seed", "own")
    long = materialize(classes.select("id", own), "long")
    named = materialize(long.groupBy("seed", "own").agg(F.count("*").alias("n")), "named")
    prints = named.select("seed", F.col("own").alias("fp"))

    def members(links: DataFrame) -> DataFrame:
        linked = links.select(F.col("src").alias("own")).unionByName(links.select(F.col("dst").alias("own")))
        linked = linked.unionByName(named.where("n > 1").select("own")).distinct()
        return long.join(linked, "own").select(F.col("id").alias("src"), F.col("own").alias("dst"))

    few = materialize(hamming_links(prints.where("seed = 0"), budget, agree=2, disjoint=True).select("src", "dst").distinct(), "few")
    parts = materialize(connected_components(few.unionByName(members(few))).join(classes.select("id"), "id"), "parts")
    known = long.join(parts, "id").groupBy("seed", F.col("own").alias("fp")).agg(F.min("component").alias("known"))
    known = prints.join(known, ["seed", "fp"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
    found = materialize(hamming_links(materialize(known, "known"), budget, agree=2).select("src", "dst").distinct(), "found")
    joined = parts.select(F.col("id").alias("src"), F.col("component").alias("dst"))
    return connected_components(found.unionByName(members(found)).unionByName(joined)).join(classes.select("id"), "id")


def components_of(docs_fp: DataFrame, links: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs_fp`` with ``component_id``; ``classes``: ``fp, least, count``, the smallest id and rows of each fingerprint."""
    labels = connected_components(links)
    rooted = classes.join(labels.select(F.col("id").alias("fp"), F.col("component").alias("root")), "fp", "left")
    rooted = materialize(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_fp"))
    per_root = rooted.join(least.where("n_fp > 1"), "root", "left")
    per_fp = per_root.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return join_lookup(docs_fp, per_fp, "fp", classes.select("fp", "count"), docs_fp.count())


def _shingle_set(text: str | None, width: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[k : k + width]), SEED) for k in range(max(1, len(words) - width + 1))} if words else set()
    return np.fromiter(found, np.uint64, len(found)).view(np.int64)


def _similar_pairs(fps: np.ndarray, sizes: np.ndarray, values: np.ndarray, budget: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows that are near in some column of ``fps`` and share ``least`` of their shingles.

    ``values`` are the rows' shingles, one row's after the other's. Those of many
    rows are bits, compared at once; those of few are looked up by their rows.
    """
    n = len(sizes)
    _, codes, often = np.unique(values, return_inverse=True, return_counts=True)
    rows, often = np.repeat(np.arange(n), sizes), often[codes]
    many = (often > 1) & (often * COMMON > n)
    few = (often > 1) & ~many
    _, places = np.unique(codes[many], return_inverse=True)
    table = np.zeros((n, -(-(int(places.max(initial=-1)) + 1) // 64) * 64), bool)
    table[rows[many], places] = True
    table = np.packbits(table, axis=1).view(np.uint64)
    order = np.argsort(codes[few], kind="stable")
    by_code, codes = rows[few][order], codes[few]
    first, last = np.searchsorted(codes[order], codes), np.searchsorted(codes[order], codes, "right")
    own = np.searchsorted(rows[few], np.arange(n + 1))
    label, links = np.arange(n), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for i in range(n - 1):
        small, large = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        near = (label[i + 1 :] != label[i]) & (small >= least * large)
        j = i + 1 + np.flatnonzero(near)
        j = j[(np.bitwise_count(fps[j] ^ fps[i]) <= budget).any(axis=1)]
        if not len(j):
            continue
        shared = np.bitwise_count(table[j] & table[i]).sum(axis=1, dtype=np.int64)
        if own[i] < own[i + 1]:
            ranges = zip(first[own[i] : own[i + 1]].tolist(), last[own[i] : own[i + 1]].tolist(), strict=True)
            shared += np.bincount(np.concatenate([by_code[a:b] for a, b in ranges]), minlength=n)[j]
        j = j[shared >= least * (sizes[i] + sizes[j] - shared)]
        if not len(j):
            continue
        joined, at = np.unique(label[j], return_index=True)
        links.append((np.full(len(at), i), j[at]))
        joined = np.r_[joined, label[i]]
        label[np.isin(label, joined)] = joined.min()
    i, j = (np.concatenate(x) for x in zip(*links, strict=True))
    return i, j


def similar_links(docs: DataFrame, groups: DataFrame, classes: DataFrame, width: int, budget: int, least: float) -> DataFrame:
    """``(src, dst)``: spanning forests of the classes' links, by their documents (``classes.one``, a ``_row`` of ``docs``).

    Every pair of a group is tested, so no link depends on another. Groups of
    over ``SHINGLES`` are cut into slices, and a task takes a pair of slices.
    """
    names = ["fp", *(f"fp{k}" for k in range(1, SEEDS))]
    shingles = SHINGLES

    def shingled(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingle_set(t, width) for t in texts])

    wanted = materialize(groups.join(classes, "id").select("id", "component", *names, F.col("one").alias("_row")), "linked")
    wanted = F.broadcast(wanted) if wanted.count() <= 10 * BROADCAST_ROWS else wanted
    sets = docs.select("_row", "text").join(wanted, "_row").select("id", "component", *names, F.pandas_udf(shingled, "array<long>")("text").alias("set"))
    sets = materialize(sets.dropDuplicates(["id"]), "shingles")
    # fewer than one for each so many shingles of the corpus
    large = sets.groupBy("component").agg(F.sum(F.size("set")).alias("n")).where(F.col("n") > shingles)
    large = materialize(large.select("component", F.ceil(F.col("n") / shingles).cast("int").alias("slices")), "groups")
    sliced = sets.join(F.broadcast(large), "component", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    sliced = sliced.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    tasks = sliced.withColumn("other", F.explode(F.expr("sequence(0, slices - 1)"))).where("slices = 1 OR other != slice")
    tasks = tasks.select("component", F.least("slice", "other").alias("lo"), F.greatest("slice", "other").alias("hi"), "id", *names, "set")
    dealt = tasks.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")

    def verified(rows: pa.Table, starts: list[int]) -> pa.RecordBatch:
        ids, lists = rows["id"].to_numpy(), rows["set"].combine_chunks()
        fps = np.stack([rows[c].to_numpy() for c in names], axis=1).view(np.uint64)
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            if b - a > 1:
                i, j = _similar_pairs(fps[a:b], np.diff(ends[a : b + 1]).astype(np.int64), values[ends[a] : ends[b]], budget, least)
                src.append(ids[a + i])
                dst.append(ids[a + j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    def starts_of(rows: pa.Table) -> list[int]:
        keys = np.stack([rows[c].to_numpy() for c in ("component", "lo", "hi")], axis=1)
        return [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= 8 * shingles:
                rows = pa.Table.from_batches(held)
                starts = starts_of(rows)
                if cut := starts[-1]:  # whole tasks only
                    yield verified(rows.slice(0, cut), starts[:-1])
                    held = rows.slice(cut).combine_chunks().to_batches()
                size = 0
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield verified(rows, starts_of(rows))

    return dealt.mapInArrow(verify, "src long, dst long")


def keep_one(docs: DataFrame, width: int = 5, budget: int = 8, least: float = 0.8) -> DataFrame:
    """``docs`` without all but one row of each component: the one with the smallest id (of several, the smallest text hash; null ids last)."""
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text", row.alias("_row"))
    seen = materialize(several_fingerprints(keyed.select("doc_id", "text", "_row"), width), "fingerprints")
    prints = (F.min(c).alias(c) for c in ("fp", *(f"fp{k}" for k in range(1, SEEDS))))  # of one text: all equal
    classes = seen.groupBy("id").agg(F.count("*").alias("count"), F.min("_row").alias("one"), *prints)
    classes = materialize(classes, "classes")
    groups = materialize(candidate_groups(classes, budget), "groups")
    links = materialize(similar_links(keyed, groups, classes, width, budget, least), "similar")
    labels = connected_components(links).select("id", "component")
    joined = join_lookup(seen.select("doc_id", "id", "_row"), labels, "id", classes.select("id", "count"), seen.count())
    joined = joined.select("_row", "doc_id", F.coalesce("component", "id").alias("root"))
    # the rows to drop are the fewer: all but each component's first, and repeats of that
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")).alias("first")
    kept = materialize(joined.groupBy("root").agg(first).select("first._row"), "kept")
    dropped = materialize(joined.select("_row").join(kept, "_row", "left_anti").distinct(), "dropped")
    stay = keyed.join(F.broadcast(dropped) if dropped.count() <= 10 * BROADCAST_ROWS else dropped, "_row", "left_anti")
    repeated = seen.groupBy("_row").count().where("count > 1").select("_row")
    repeated = materialize(repeated.join(kept, "_row", "left_semi"), "repeated")
    if repeated.isEmpty():
        return stay.select("_doc.*")
    again = stay.join(repeated, "_row", "left_semi").dropDuplicates(["_row"])
    return stay.join(repeated, "_row", "left_anti").unionByName(again).select("_doc.*")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    seen = materialize(fingerprints(docs).select("doc_id", "fp"), "fingerprints")
    classes = materialize(seen.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("count")), "classes")
    links = hamming_links(classes, agree=blocks_to_agree(classes.count())).select("src", "dst")
    joined = components_of(seen, materialize(links, "links"), classes)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
