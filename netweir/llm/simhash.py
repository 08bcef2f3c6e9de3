"""SimHash fingerprints and their near-duplicate links by a self-join of a binary trie.

The fingerprints form a binary trie. The join starts from the pair (root, root), descends both nodes of a
pair together, adds a difference whenever the two branch apart, and drops a pair whose differences exceed
the budget. Two things make this a distributed job. First, a pair within `budget` differences agrees in one
of budget + 1 bit blocks, so the trie is joined once for each block below the nodes that agree there: the
wide pairs of short prefixes at the top never come up. Second, a node that holds more than `limit`
fingerprints is not one task: its rows are dealt to the pairs of its children (only pairs within the
budget), again and again, until the subtrees fit; see `_split`. Each subtree pair is then walked in numpy.

A task returns a spanning forest of the links it finds, nearest first: the links between the members of a
component may number its square, while the forest has one row a member at most and joins the same
members.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from netweir.llm.common import Bitmap, WordHashes, checkpointed, map_texts, mix64, one_row_each, raw, row_count, shingle_hashes, slices, small_side, staged, staging, text_key

CHUNK = 1 << 16


def majority(parts) -> int:
    """The 64-bit value with a bit set where over half of the hashes have it; no hashes: zero."""
    total, n = np.zeros(64, np.int64), 0
    for h in parts:
        if len(h):
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]) if n else 0


def simhash_text(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """SimHash over word shingles, repeats included, of a text with A-Z lower-cased."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return majority([np.array([digest(line, seed)], np.uint64)])
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in found)]
    starts = [0, *(e + 1 for e in ends)]
    pairs = list(zip(starts, ends[words - 1:]))
    return majority(np.fromiter((digest(line[a:b], seed) for a, b in pairs[i:i + CHUNK]), np.uint64,
                                min(CHUNK, len(pairs) - i)) for i in range(0, len(pairs), CHUNK))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """The key columns and `fp`, the SimHash as a long. Null and blank texts have fingerprint zero."""
    rows = docs.select(*keys, F.col(text).alias("__text"))
    schema = rows.select(*keys, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in slices(batches, len(keys)):
            found = np.array([simhash_text(t, words, seed) for t in raw(batch.column(len(keys)))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))],
                                             [*keys, "fp"])

    return map_texts(rows, run, schema)


# --- the trie join -----------------------------------------------------------------------------------

COMBINATIONS = 1 << 18  # compared at once


def _within(fps: np.ndarray, la, ha, lb, hb, budget: int):
    """Cross pairs of index ranges [la, ha) x [lb, hb) within the budget, equal ranges once, in pieces."""
    wide = hb - lb
    count = (ha - la) * wide
    piece = np.cumsum(count) // COMBINATIONS
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(count)]
    for i, j in zip(cuts, cuts[1:]):
        n = count[i:j]
        at = np.repeat(np.arange(i, j), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = la[at] + inner // wide[at], lb[at] + inner % wide[at]
        use = (la[at] != lb[at]) | (a < b)
        a, b = a[use], b[use]
        d = np.bitwise_count(fps[a] ^ fps[b])
        near = d <= budget
        yield a[near], b[near], d[near]


def trie_pairs(left: np.ndarray, right: np.ndarray | None, budget: int, leaf: int = 64):
    """Pieces (a, b, distance) of index pairs of fingerprints within the budget.

    left, right: sorted distinct uint64; right None joins left with itself, else indexes of right follow those
    of left. Node pairs of the trie are walked from bit 63 down; a node is a range of the sorted values. A
    pair of nodes of at most `leaf` combinations is compared value by value.
    """
    fps = left if right is None else np.concatenate([left, right])
    n, z = len(left), np.zeros(1, np.int64)
    la, ha = z, z + n
    lb, hb = (la, ha) if right is None else (z + n, z + len(fps))
    err = z
    for bit in range(63, -2, -1):
        small = (ha - la) * (hb - lb) <= leaf if bit >= 0 else np.ones(len(la), bool)
        if small.any():
            yield from _within(fps, la[small], ha[small], lb[small], hb[small], budget)
        la, ha, lb, hb, err = (x[~small] for x in (la, ha, lb, hb, err))
        if not len(la):
            return
        ones = np.concatenate([z, np.cumsum((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        ma, mb = ha - (ones[ha] - ones[la]), hb - (ones[hb] - ones[lb])
        own = la == lb
        nodes = [np.stack(x) for x in ((la, ma, lb, mb, err), (ma, ha, mb, hb, err), (la, ma, mb, hb, err + 1),
                                       tuple(v[~own] for v in (ma, ha, lb, mb, err + 1)))]
        la, ha, lb, hb, err = np.concatenate(nodes, axis=1)
        live = (ha > la) & (hb > lb) & (err <= budget)
        la, ha, lb, hb, err = (x[live] for x in (la, ha, lb, hb, err))


def forest(n: int, pieces) -> tuple[list[int], list[int]]:
    """Links that join the same members as all links of the pieces do; in a piece the nearest come first."""
    label, members = np.arange(n), {i: [i] for i in range(n)}
    kept_a, kept_b = [], []
    for a, b, distance in pieces:
        apart = np.flatnonzero(label[a] != label[b])
        for i in apart[np.argsort(distance[apart], kind="stable")].tolist():
            x, y = int(label[a[i]]), int(label[b[i]])
            if x != y:
                if len(members[x]) < len(members[y]):
                    x, y = y, x
                label[members[y]] = x
                members[x] += members.pop(y)
                kept_a.append(int(a[i]))
                kept_b.append(int(b[i]))
    return kept_a, kept_b


def _blocks(budget: int) -> list[tuple[int, int]]:
    """budget + 1 bit ranges (low bit, width) that cover 64 bits."""
    edges = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


# A row of the join is (key, meta, fp): key names the node pair, meta holds what the rows of a pair share and
# the row's side of it: space * 65536 + side * 4096 + err * 64 + the bit at which the next split starts.
SAME, LEFT, RIGHT = 0, 1, 2


def _field(name: str):
    return F.expr({"side": "(meta >> 12) & 15", "err": "(meta >> 6) & 63", "start": "meta & 63"}[name])


def _split(rows: DataFrame, bits: int, budget: int) -> DataFrame:
    """Deals the rows of too large node pairs to the pairs of their children, `bits` levels down.

    A child pair whose differences exceed the budget is not made. The children of a node paired with itself
    and of two nodes are named by hashing the parent's key with the two paths.
    """
    masks = sorted((sum(1 << i for i in c) for r in range(budget + 1) for c in combinations(range(bits), r)), key=int.bit_count)
    wanted = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("e")) for m in masks]))
    own = F.expr(f"((fp >>> (meta & 63)) | (fp << (64 - (meta & 63)))) & {(1 << bits) - 1}")
    dealt = rows.withColumns({"own": own, "mask": wanted}).where(_field("err") + F.col("mask.e") <= budget)
    dealt = dealt.withColumn("other", F.col("own").bitwiseXOR(F.col("mask.m")))
    same, left = _field("side") == SAME, _field("side") == LEFT
    first = F.when(same, F.least("own", "other")).when(left, F.col("own")).otherwise(F.col("other"))
    second = F.when(same, F.greatest("own", "other")).when(left, F.col("other")).otherwise(F.col("own"))
    side = F.when(~same, _field("side")).when(F.col("other") == F.col("own"), SAME).when(F.col("own") < F.col("other"), LEFT).otherwise(RIGHT)
    meta = (F.expr("(meta >> 16) << 16") + side * 4096 + (_field("err") + F.col("mask.e")) * 64 + (_field("start") + bits) % 64)
    return dealt.select(F.xxhash64("key", first, second).alias("key"), meta.cast("int").alias("meta"), "fp")


def trie_links(fps: DataFrame, budget: int = 2, limit: int = 4096, stage=checkpointed) -> DataFrame:
    """Links (space, a, b) between distinct fingerprints of a space that are at most `budget` bits apart.

    fps: distinct rows (space, fp), a small integer and a long; spaces are separate tries. Links are a
    spanning forest within each subtree pair, so they have the connected components of all links. An empty
    table has no links. `stage` writes what later steps read again.
    """
    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.lit((low + width) % 64).alias("start"),
                                          F.lit(low).alias("low"), F.lit((1 << width) - 1).alias("mask"))
                                 for i, (low, width) in enumerate(_blocks(budget))]))
    pending = fps.withColumn("b", blocks).select(
        F.xxhash64("space", "b.block", F.expr("shiftrightunsigned(fp, b.low) & b.mask")).alias("key"),
        (F.col("space") * 65536 + F.col("b.start")).cast("int").alias("meta"), "fp")
    found = None
    for step in range(9):
        sizes = pending.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(_field("side") != RIGHT).alias("na"),
                                           F.count_if(_field("side") != LEFT).alias("nb"))
        sizes = stage(sizes.where("n > 1 AND na > 0 AND nb > 0").select("key", "n"))
        fits = sizes.where(F.col("n") <= limit) if step < 8 else sizes
        here = _walk(pending.join(fits.select("key"), "key"), budget)
        found = here if found is None else found.unionByName(here)
        large = sizes.where(F.col("n") > limit).select("key")
        if step == 8 or large.isEmpty():
            return found
        pending = stage(_split(pending.join(large, "key"), 6, budget))


def _walk(rows: DataFrame, budget: int) -> DataFrame:
    """The links inside each node pair."""
    groups = rows.groupBy("key").agg(F.expr("first(meta) >> 16").alias("space"),
                                     F.collect_list(F.when(_field("side") != RIGHT, F.col("fp"))).alias("left"),
                                     F.collect_list(F.when(_field("side") == RIGHT, F.col("fp"))).alias("right"))

    def run(batches):
        for batch in batches:
            found = []
            lists = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column(1), batch.column(2))]
            (lefts, at), (rights, bt) = lists
            for i, space in enumerate(batch.column(0).to_pylist()):
                left, right = np.unique(lefts[at[i]:at[i + 1]]), rights[bt[i]:bt[i + 1]]
                if len(left) == 2 and not len(right):
                    a, b = left[:1], left[1:]
                    if int(a[0] ^ b[0]).bit_count() <= budget:
                        found.append((np.array([space]), a, b))
                    continue
                right = np.unique(right)
                fps = np.concatenate([left, right])
                a, b = forest(len(fps), trie_pairs(left, right if len(right) else None, budget))
                if a:
                    found.append((np.full(len(a), space), fps[a], fps[b]))
            if found:
                space, a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(space.astype(np.int32)), pa.array(a.view(np.int64)),
                                                  pa.array(b.view(np.int64))], ["space", "a", "b"])

    return map_texts(groups.select("space", "left", "right"), run, "space int, a long, b long")


# --- components --------------------------------------------------------------------------------------

def components(links: DataFrame, stage=checkpointed) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b); nodes without a link are absent.

    Rounds of the large-star and small-star steps; each round is written to the checkpoint folder by `stage`,
    and the driver sees one count and one checksum of it, taken as it is written.
    """
    marks = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("check")

    def marked(frame):
        seen = Observation()
        edges = stage(frame.observe(seen, *marks))
        return edges, seen.get or edges.agg(*marks).first().asDict()

    edges, before = marked(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                           .distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges, after = marked(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42,
                    budget: int = 2) -> DataFrame:
    """One row per document: id, fp (long), component_id, the smallest id among all documents it reaches
    over links of at most `budget` differing bits.

    Null and blank texts have fingerprint zero and link like any other. Rows with a null id take part; a
    component of null ids only has a null component_id. Repeated rows and repeated ids stay as they are.
    Other columns of the input, whatever their names, are not read. An empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__body")), ["__id"],
                                     "__body", words, seed))
    first = rows.groupBy("fp").agg(F.min("__id").alias("first"))
    roots = components(trie_links(first.select(F.lit(0).alias("space"), "fp"), budget))
    named = first.join(roots, first.fp == roots.node).select("fp", "root", "first")
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component")), "root").select("fp", "component")
    merged = staged(first.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id")))
    return rows.join(merged, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")


# --- near copies by word sets, checked by five-word shingles ----------------------------------------

SAMPLE, COMMON = 16, 1 << 16  # one text in SAMPLE is looked at for common shingles, at most COMMON are named


def common_shingles(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles met in many texts of a sample, sorted, and how many texts have each."""
    k1, _ = text_key(F.col(text))
    rows = docs.select(k1, F.col(text).alias("body")).where(F.pmod("k1", F.lit(SAMPLE)) == 0).dropDuplicates(["k1"]).select("body")

    def run(batches):
        memo = WordHashes()
        for batch in slices(batches, 0):
            sets = [np.unique(shingle_hashes(memo.of((t or b"").lower().split()), words)) for t in raw(batch.column(0))]
            hashes, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    found = map_texts(rows, run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n >= 4")
    found = found.orderBy(F.desc("n"), "hash").limit(COMMON).collect()
    hashes = np.array([r.hash for r in found], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r.n for r in found], np.int64)[order]


def prefix(once: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingle hashes of a text, one of which any text of the similarity has among its own first.

    once: distinct, sorted. All texts order their shingles alike: those not known as common by their hash,
    then the common ones, rarest first. A partner shares at least ceil(similarity * n) of n shingles, so it
    can't do without all of the first n - ceil(similarity * n) + 1. Texts without a shingle share the hash 0.
    """
    if not len(once):
        return np.zeros(1, np.uint64)
    rank, (hashes, n) = np.zeros(len(once), np.int64), common
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, once), len(hashes) - 1)
        rank = np.where(hashes[at] == once, n[at], 0)
    size = len(once) - math.ceil(similarity * len(once) - 1e-6) + 1
    return once[np.argsort(rank, kind="stable")[:size]]


BINS = 32


def sketch(once: np.ndarray) -> np.ndarray:
    """The least of the sorted hashes in each of BINS equal ranges, by its upper 31 bits; -1 where there is none."""
    starts = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    if not len(once):
        return np.full(BINS, -1, np.int32)
    at = np.searchsorted(once, starts)
    least = once[np.minimum(at, len(once) - 1)]
    own = (at < len(once)) & (least >> np.uint64(64 - BINS.bit_length() + 1) == np.arange(BINS, dtype=np.uint64))
    return np.where(own, (least >> np.uint64(33)).astype(np.int64), -1).astype(np.int32)


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in half of the bins that either fills; pairs of the similarity mostly do.

    Only for candidates that need not be complete.
    """
    both = pairs.join(sketches.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a").join(
        sketches.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: (x == y) & (x >= 0)), lambda z: z))
    used = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: (x >= 0) | (y >= 0)), lambda z: z))
    return both.where(2 * same >= used).select("a", "b")


def word_set_prints(docs: DataFrame, text: str, prints: int, words: int, similarity: float) -> DataFrame:
    """(k1, k2, fps, n, prefix, sketch): SimHashes of each text's set of words under several seeds, the number
    of its distinct shingles, the first of them, see prefix(), and a sketch of them."""
    rows = docs.select(*text_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    seeds = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1) for i in range(prints)]
    common = common_shingles(docs, text, words)

    def run(batches):
        memo = WordHashes()
        for batch in slices(batches, 2):
            fps, sizes, firsts, sketches = [], [], [], []
            for body in raw(batch.column(2)):
                found = memo.of(body.lower().split())
                once, own = np.unique(found), np.unique(shingle_hashes(found, words))
                fps.append(np.array([majority([mix64(once ^ s)]) for s in seeds], np.uint64).view(np.int64))
                sizes.append(len(own))
                firsts.append(prefix(own, common, similarity).view(np.int64))
                sketches.append(sketch(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.list_(pa.int64())), pa.array(sizes, pa.int32()),
                                              pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int32()))],
                                             ["k1", "k2", "fps", "n", "prefix", "sketch"])

    return map_texts(rows, run, "k1 long, k2 long, fps array<long>, n int, prefix array<long>, sketch array<int>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, text: str, words: int) -> DataFrame:
    """(k1, k2, shingles): distinct 32-bit hashes of the word shingles of the texts named by nodes (k1, k2).

    Texts stay where they are: a bitmap of the wanted keys passes those and a few others, of which only the
    sets move. A task gives each text once, however many copies it holds.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(Bitmap(nodes.select(F.col("k1").alias("hash")), row_count(nodes)))
    rows = docs.select(*text_key(F.col(text)), F.col(text).alias("body"))

    def run(batches):
        memo, seen = WordHashes(), set()
        for batch in slices(batches, 2):
            kept = []
            for i in np.flatnonzero(wanted.value.of(batch.column(0).to_numpy().view(np.uint64))).tolist():
                key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if key not in seen:
                    seen.add(key)
                    kept.append(i)
            part = batch.take(pa.array(kept, pa.int64()))
            sets = [np.unique(shingle_hashes(memo.of((t or b"").lower().split()), words) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    for t in raw(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int32()))], ["k1", "k2", "shingles"])

    found = map_texts(rows, run, "k1 long, k2 long, shingles array<int>")
    return found.join(small_side(nodes, 32), ["k1", "k2"]).dropDuplicates(["k1", "k2"])


def confirmed(docs: DataFrame, pairs: DataFrame, text: str, words: int, similarity: float, keep, spanning: bool = False) -> DataFrame:
    """The pairs (a, b) of texts, given as structs of their keys, whose word shingles have the similarity.

    pairs: a written table. `keep` writes the result; the sets and what else is written on the way are removed.
    `spanning` is for pairs many of which join the same texts: of each text one pair comes first, then those
    whose texts are still apart. The pairs left out join no more, so the components are those of all pairs.
    """
    with staging(docs.sparkSession) as stage:
        ends = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct())
        nodes = stage(ends.distinct().select("node.*"))
        sets = stage(shingle_sets(docs, nodes, text, words).select(F.struct("k1", "k2").alias("node"), "shingles"))

        def similar(some: DataFrame) -> DataFrame:
            both = some.join(sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a").join(
                sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
            shared = F.size(F.array_intersect("sa", "sb"))
            return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")

        if not spanning:
            return keep(similar(pairs))
        first = stage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        links = stage(similar(first))
        rest = stage(still_apart(pairs.join(first, ["a", "b"], "left_anti"), links, stage))
        return keep(links.unionByName(similar(rest)))


def still_apart(pairs: DataFrame, links: DataFrame, stage) -> DataFrame:
    """The pairs (a, b) that the links leave in different components."""
    roots = small_side(stage(components(links, stage)), 80)
    for end in ("a", "b"):
        pairs = pairs.join(roots.withColumnsRenamed({"node": end, "root": f"root_{end}"}), end, "left").withColumn(
            f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.where("root_a <> root_b").select("a", "b")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _labelled(rows: DataFrame, roots: DataFrame, stage) -> DataFrame:
    """rows (node, ...) with `comp`, a hash of the root of the node's component."""
    return rows.join(small_side(stage(roots), 80), "node", "left").withColumn("comp", F.xxhash64(F.coalesce("root", "node"))).drop("root")


def apart_points(texts: DataFrame, stage) -> DataFrame:
    """(node, comp, n, place, hash) for each prefix shingle that texts of different components have.

    texts: node, comp, n, prefix. Most shingles are of one component; they are left out by a bitmap of the
    others before the texts' keys are attached, and the few that it lets pass by a join.
    """
    hashes = stage(texts.select(F.explode("prefix").alias("hash"), "comp").groupBy("hash").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("hash"))
    shared = texts.sparkSession.sparkContext.broadcast(Bitmap(hashes))

    def run(batches):
        for batch in batches:
            firsts, starts = batch.column(4).flatten().to_numpy(), batch.column(4).value_lengths().to_numpy()
            at = np.repeat(np.arange(len(starts)), starts)
            place = np.arange(len(firsts)) - np.repeat(np.cumsum(starts) - starts, starts)
            kept = np.flatnonzero(shared.value.of(firsts.view(np.uint64)))
            keys = batch.select(["k1", "k2", "comp", "n"]).take(pa.array(at[kept]))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(place[kept].astype(np.int32)), pa.array(firsts[kept])],
                                             ["k1", "k2", "comp", "n", "place", "hash"])

    found = map_texts(texts.select("node.*", "comp", "n", "prefix"), run, "k1 long, k2 long, comp long, n int, place int, hash long")
    return found.join(small_side(hashes, 16), "hash").select(F.struct("k1", "k2").alias("node"), "comp", "n", "place", "hash")


def _apart(points: DataFrame, stage) -> DataFrame:
    """The points (hash, comp, ...) of hashes that more than one component has."""
    several = points.groupBy("hash").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return points.join(stage(several.select("hash")), "hash")


def star_pairs(points: DataFrame, stage) -> DataFrame:
    """Each text with the least text of every shingle in its prefix, where their components differ."""
    least = stage(points.groupBy("hash").agg(F.min(F.struct("node", "comp")).alias("x")))
    return points.join(least, "hash").where("comp <> x.comp").select(*_pair("node", "x.node")).distinct()


def open_pairs(points: DataFrame, similarity: float, stage) -> DataFrame:
    """All pairs of texts in different components that can have the similarity.

    They share a shingle of both prefixes, their sizes allow it, and so do the shingles from the shared one
    on, which holds for the first that they share. The texts of a shingle's largest component are not
    paired with each other: one side of each pair is from another component.
    """
    sizes = stage(points.groupBy("hash", "comp").agg(F.count(F.lit(1)).alias("texts")))
    points = points.join(stage(sizes.groupBy("hash").agg(F.max_by("comp", F.struct("texts", "comp")).alias("most"))), "hash")
    few = points.where("comp <> most").select("hash", *[F.col(c).alias(f"__{c}") for c in ("comp", "node", "n", "place")])
    rest = F.least(F.col("n") - F.col("place"), F.col("__n") - F.col("__place"))
    near = (F.least("n", "__n") >= similarity * F.greatest("n", "__n") - 1e-6) & (
        rest >= similarity / (1 + similarity) * (F.col("n") + F.col("__n")) - 1e-6)
    found = few.join(points.drop("most"), "hash").where((F.col("comp") != F.col("__comp")) & near)
    return found.select(*_pair("node", "__node")).distinct()


def similar_texts(docs: DataFrame, text: str = "text", words: int = 5, similarity: float = 0.8, prints: int = 8, budget: int = 3) -> DataFrame:
    """Links (a, b) between texts, given as structs of their keys, whose word shingles have at least the similarity.

    The links have the connected components of all such pairs. Most come from tries. A SimHash of five-word
    shingles changes in ten bits where the similarity is 0.8, too many for a trie; that of the set of words
    changes in four or five. So each text has `prints` SimHashes of its words under different seeds, each in
    a trie of its own, and a pair is a candidate if one of them is within the budget. Texts of one
    fingerprint meet their least text, and tries give spanning forests, nearest first, so that a large group
    has as many candidates as members. Candidates whose sketches agree are confirmed by the Jaccard
    similarity of their distinct shingles.

    What the tries leave comes from a prefix-filter join, which misses no pair: texts of different components
    that share one of their rarest shingles, first each with the least text of the shingle, then, in the
    components that this leaves, all pairs.
    """
    how = text, words, similarity
    with staging(docs.sparkSession) as stage:
        printed = stage(word_set_prints(docs, text, prints, words, similarity).dropDuplicates(["k1", "k2"]))
        sketches = printed.select(F.struct("k1", "k2").alias("node"), "sketch")
        with staging(docs.sparkSession) as passing:
            pairs = stage(likely(trie_candidates(printed, budget, passing), sketches))
        links = confirmed(docs, pairs, *how, stage, spanning=True)

        texts = printed.select(F.struct("k1", "k2").alias("node"), "n", "prefix")
        with staging(docs.sparkSession) as passing:
            left = stage(apart_points(_labelled(texts, components(links, passing), passing), passing))
            pairs = stage(likely(star_pairs(left, passing), sketches))
        links = links.unionByName(confirmed(docs, pairs, *how, stage))
        with staging(docs.sparkSession) as passing:
            left = passing(_apart(_labelled(left.drop("comp"), components(links, passing), passing), passing))
            pairs = stage(open_pairs(left, similarity, passing))
        return staged(links.unionByName(confirmed(docs, pairs, *how, stage)))


def trie_candidates(printed: DataFrame, budget: int, stage) -> DataFrame:
    """Pairs (a, b) of texts with a fingerprint within the budget, as a spanning forest of each trie."""
    points = printed.select(F.struct("k1", "k2").alias("node"), F.posexplode("fps").alias("space", "fp"))
    classes = stage(points.groupBy("space", "fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")))
    links = trie_links(classes.select("space", "fp"), budget, stage=stage)
    ends = classes.select("space", "fp", "rep")
    across = links.join(ends.withColumnsRenamed({"fp": "a", "rep": "x"}), ["space", "a"]).join(
        ends.withColumnsRenamed({"fp": "b", "rep": "y"}), ["space", "b"]).select("x", "y")
    inside = points.join(classes.where("n > 1").drop("n"), ["space", "fp"]).select(F.col("node").alias("x"), F.col("rep").alias("y"))
    return stage(across.unionByName(inside).where("x <> y").select(*_pair("x", "y")).distinct())


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs, all columns, with one row of each group of equal or similar texts: the one with the least id.

    Groups are the connected components of similar_texts. Blank texts are one group; null is blank. Rows
    with a null id come after those with one; of repeated rows one stays. An empty table stays empty.
    """
    k1, k2 = text_key(F.col(text))
    node = F.struct("k1", "k2").alias("node")
    roots = staged(components(similar_texts(docs, text, **how)))
    rows = docs.select(*text_key(F.col(text)), F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col), F.lit(-1)).alias("id"))
    rows = rows.groupBy("k1", "k2", "none", "id").agg(F.count(F.lit(1)).alias("rows")).withColumn("node", node)
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = rooted.groupBy("root").agg(F.min(F.struct("none", "id", "k1", "k2", "rows")).alias("w")).select("w.*")
    chosen = staged(chosen.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("none").alias("__none"),
                                        F.col("id").alias("__id"), "rows").withColumnRenamed("rows", "__rows"))
    keyed = docs.select("*", k1.alias("__k1"), k2.alias("__k2"), F.col(id_col).isNull().alias("__none"), F.coalesce(F.col(id_col), F.lit(-1)).alias("__id"))
    return one_row_each(keyed, chosen, ["__k1", "__k2", "__none", "__id"]).select(*docs.columns)
