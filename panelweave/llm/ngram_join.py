"""Jaccard join of word n-gram sets with adaptive multi-match prefixes, up to connected components.

Equal sets are one node, so copies are never paired. A count-min sketch of all shingles orders each
set from rare to frequent; any order is right, this one makes prefixes selective. If sets of nu and nv
shingles reach the threshold, they share o = ceil(percent (nu + nv) / (100 + percent)) of them, and k
of these lie at places n - o + k - 1 or before in either order. So the prefix of a set ends
there, for the smallest partner it may have. Each document takes the k, up to `MOST_MATCHES`, of the
least cost that the sketch lets it expect, of rows and candidates (see matches_for), and a pair has to share as many tokens, at
such places, as the shorter lengthening of the two says, before its sets are compared.

1. Tokens in the prefix of one node only go: one count per token, combined before the shuffle.
2. Peeling: a token's leader is the node that has it at the earliest place, and so the fewest
   rare shingles: what a group of near copies has in common is what its leader consists of. All others
   are compared with the leader: pairs linear in the rows. Links make components; the rows outside of
   the leader's component go to the next round, until a round finds no link.
3. The join itself, for pairs in different components. A token that one component alone has
   makes no pairs, so a group of thousands of near copies makes none. Tokens that more than `MANY` rows have aren't joined: their
   nodes, all near copies of one text often, are joined on what they differ in from an anchor (see anchored).

Pairs that qualify are bounded by counts in 128 buckets, and compared on whole sets if that leaves the threshold in reach. No cap is set on partners or candidates, and rounds of
peeling only spare comparisons: step 3 finds whatever they leave.

Defined results: null, empty and blank texts have no shingles and link with nothing; rows with equal
sets, repeated rows too, share a component; a null id is named by the least other id of its
component, if any; other columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_table, materialize, small_batches, texts

#: Places of the sketch, 4 bytes each in a task and 1 byte in the broadcast.
SKETCH_BITS = 22
SEGMENT = 1 << 16
#: Bits of a segment of the Bloom filter.
SEGMENT_BITS = SEGMENT * 8
MOST_MATCHES = 4
#: By the upper bits of a shingle; a power of two.
BUCKETS = 128
#: What a candidate costs, in rows of the join on tokens: it brings two arrays of BUCKETS counts from two texts.
VERIFY = 32.0
#: Rows of a token that are paired; the nodes of a token with more meet by their differences from an anchor.
MANY = 64
#: Parts of the nodes that have one anchor.
SPREAD = 32
ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[1]
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles, A-Z in lower case; a shorter text is one shingle."""
    parts = text.lower().split()
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=1)] if parts else [], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    out = h[: len(h) - words + 1]
    for k in range(1, words):
        out = mixed(out) * ODD[0] + h[k : len(h) - words + 1 + k]
    return np.unique(mixed(out))


def matches_for(levels: np.ndarray, probe: int, mean: float) -> int:
    """The matches to ask for, by the least expected cost, of a set whose rarest tokens have these levels, in order.

    Asking for k matches takes a prefix of probe + k - 1 tokens. It costs a row for each other document that the sketch expects to have one
    of them, and VERIFY for each candidate. Tokens of one level may come from one passage or group of copies, where who
    has one has all: such a run promises its documents once, as long as k isn't above its length. A shorter run's documents need
    matches elsewhere too, so k matches leave them a share of length / k.
    """
    docs = np.maximum(2.0 ** (levels / 8) - 2 - 2 * mean, 0)
    starts = np.concatenate([[True], np.diff(levels.astype(int)) > 0])
    best, least = 1, np.inf
    for k in range(1, MOST_MATCHES + 1):
        n = probe + k - 1
        if n > len(levels) or not docs[n - 1]:
            break
        at = np.flatnonzero(starts[:n])
        share = np.minimum(1.0, np.diff(np.append(at, n)) / k)
        cost = float(docs[:n].sum() + VERIFY * (np.maximum.reduceat(docs[:n], at) * share).sum())
        if cost < least:
            best, least = k, cost
    return best


def fingerprint(s: np.ndarray) -> int:
    """Of a set; signed 64 bits."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _cells(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _segments(sketch: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The parts of a task's sketch that hold counts."""
    for k in range(0, len(sketch), SEGMENT):
        part = sketch[k : k + SEGMENT]
        if part.any():
            yield k // SEGMENT, zlib.compress(part.tobytes(), 1)


def _read(docs: DataFrame, words: int) -> DataFrame:
    """A row per document (k null), and rows of the task's sketch (doc_id and fp null)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "fp", "n", "k", "counts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        ids = None
        for batch in small_batches(batches):
            ids = batch.column("doc_id")
            sets = [shingles(t, words) for t in texts(batch.column("text"))]
            for s in sets:
                # a set has each shingle once, but two may fall into one place
                np.add.at(sketch, _cells(s), np.uint32(1))
            n = len(sets)
            yield pa.RecordBatch.from_arrays([ids, pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        for k, part in _segments(sketch) if ids is not None else ():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([part], pa.binary())], names=names)

    return materialize(docs.mapInArrow(run, f"doc_id {id_type}, fp bigint, n bigint, k int, counts binary"), "shingled")


def _levels(read: DataFrame) -> tuple[np.ndarray, float]:
    """8 * log2(1 + documents) of each place of the sketch, in a byte: 4 MB whatever the corpus; their mean count."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in small_batches(batches):
            for k, part in zip(batch.column("k").to_pylist(), batch.column("counts"), strict=True):
                counts = own.setdefault(k, np.zeros(SEGMENT, dtype=np.uint64))
                counts += np.frombuffer(zlib.decompress(part.as_buffer()), np.uint32)
        for k, counts in own.items():
            level = np.minimum(8 * np.log2(1 + counts.astype(float)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([level.tobytes()]), pa.array([int(counts.sum())])], names=["k", "level", "n"])

    # the parts move as they are, compressed, and not through workers of another kind, which would stay beside these
    parts = read.where("k is not null").select("k", "counts").repartition("k")
    levels, total = np.zeros(1 << SKETCH_BITS, dtype=np.uint8), 0
    for r in parts.mapInArrow(merge, "k bigint, level binary, n bigint").collect():
        levels[r["k"] * SEGMENT : (r["k"] + 1) * SEGMENT] = np.frombuffer(r["level"], np.uint8)
        total += r["n"]
    return levels, total / len(levels)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for all ends of edges (u, v).

    Labels spread to neighbours and jump to their label's label, so chains shorten by half or more each
    round; each round is a written table.
    """
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        step = materialize(step, "step")
        up = step.select(F.col("node").alias("__up"), F.col("comp").alias("__top"))
        jumped = step.join(up, step["comp"] == up["__up"], "left").select("node", "was", F.least("comp", F.coalesce("__top", "comp")).alias("comp"))
        jumped = materialize(jumped, "labels")
        drop_table(step)
        drop_table(labels)
        labels = jumped
        if not labels.where("comp <> was").head(1):
            drop_table(both)
            return labels.select("node", "comp")


def _with_comp(rows: DataFrame, comps: DataFrame | None, fp: str, comp: str) -> DataFrame:
    if comps is None:
        return rows.withColumn(comp, F.col(fp))
    named = comps.select(F.col("node").alias("__node"), F.col("comp").alias("__comp"))
    return rows.join(named, rows[fp] == named["__node"], "left").withColumn(comp, F.coalesce("__comp", fp)).drop("__node", "__comp")


def _merge(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after links between components (cu, cv)."""
    found = components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    if comps is None:
        return found
    up = found.select(F.col("node").alias("__node"), F.col("comp").alias("__comp"))
    old = comps.join(up, comps["comp"] == up["__node"], "left").select("node", F.coalesce("__comp", "comp").alias("comp"))
    fresh = found.join(comps.select(F.col("node").alias("__old")), found["node"] == F.col("__old"), "left_anti").select("node", "comp")
    return materialize(old.unionByName(fresh), "comps")


class Join:
    """The join over one table; see components_of()."""

    def __init__(self, docs: DataFrame, words: int, percent: int, peelings: int) -> None:
        self.docs, self.words, self.percent, self.peelings = docs, words, percent, peelings
        self.spark = docs.sparkSession
        bound_batches(self.spark)
        self.read = _read(docs, words)
        self.rows = self.read.where("k is null").select("doc_id", "fp", "n")
        # the first document of each node stands for it
        self.nodes = materialize(self.rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("doc_id").alias("known")), "nodes")

    def overlap(self, a: str, b: str) -> Column:
        """What sets of a and b shingles share if they reach the threshold, at least."""
        return F.expr(f"({self.percent} * ({a} + {b}) + {99 + self.percent}) div {100 + self.percent}")

    def close(self, small: str, large: str) -> Column:
        return F.col(small) * 100 >= F.col(large) * self.percent

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """Texts of these nodes (id, known), and perhaps of a few more."""
        known = nodes.where("known > 0").select("id")
        rows = self.docs.select("doc_id", "text")
        filter_ = bloom(known.select(F.xxhash64("id").alias("h")))
        if filter_ is None:
            return rows.join(known, rows["doc_id"] == known["id"], "left_semi").select("text").unionByName(rows.where("doc_id is null").select("text"))
        shared = self.spark.sparkContext.broadcast(filter_)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                passed = in_bloom(shared.value, batch.column("h").to_numpy()) | batch.column("no_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column("text").filter(pa.array(passed))], names=["text"])

        return rows.select("text", F.xxhash64("doc_id").alias("h"), F.col("doc_id").isNull().alias("no_id")).mapInArrow(run, "text string")

    def prefixes(self) -> DataFrame:
        """token, fp, n, pos, k: the prefix of each node, each token's place in its order, and the matches it may be asked for."""
        levels = self.spark.sparkContext.broadcast(_levels(self.read))
        words, percent = self.words, self.percent

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level, mean = levels.value
            for batch in small_batches(batches):
                out: list[tuple[np.ndarray, ...]] = []
                for t in texts(batch.column("text")):
                    s = shingles(t, words)
                    n = len(s)
                    if not n:
                        continue
                    own = level[_cells(s)]
                    probe = n + (-percent * n // 100) + 1
                    order = np.argsort(own, kind="stable")[: probe + MOST_MATCHES - 1]
                    matches = matches_for(own[order], probe, mean)
                    pos = np.arange(min(n, probe + matches - 1))
                    # a place that one document alone has counted belongs to no other
                    pos = pos[own[order[pos]] > 8]
                    if len(pos):
                        out.append((s[order[pos]], np.full(len(pos), fingerprint(s)), np.full(len(pos), n), pos, np.full(len(pos), matches)))
                if out:
                    token, fp, n, pos, k = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(pos, pa.int64()), pa.array(k, pa.int64())], names=["token", "fp", "n", "pos", "k"])

        return materialize(self.texts_of(self.nodes).mapInArrow(run, "token bigint, fp bigint, n bigint, pos bigint, k bigint"), "prefixes")

    def shared(self, prefixes: DataFrame) -> DataFrame:
        """The rows of prefixes whose token two rows or more have."""
        often = materialize(prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("token").alias("__token")), "often")
        rows, filter_ = prefixes, bloom(often.select(F.col("__token").alias("h")))
        if filter_ is not None:
            shared = self.spark.sparkContext.broadcast(filter_)

            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.filter(pa.array(in_bloom(shared.value, batch.column("token").to_numpy())))

            rows = prefixes.mapInArrow(run, prefixes.schema)
        found = materialize(rows.join(often, rows["token"] == often["__token"], "left_semi"), "shared")
        drop_table(often)
        return found

    def per_node(self, pairs: DataFrame, make: Callable[[np.ndarray], np.ndarray], kind: str, spread: int = 1) -> DataFrame:
        """pairs with su and sv: an array that `make` gives from each side's set. u may be in many pairs: it meets rows that hold v's
        array already, which a skewed join can split by their size, or `spread` copies of u's array meet a part of its pairs each."""
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
        wanted = materialize(self.nodes.join(wanted, "fp", "left_semi"), "wanted")
        words = self.words

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                sets = [shingles(t, words) for t in texts(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([make(s) for s in sets])], names=["fp", "s"])

        arrays = self.texts_of(wanted).mapInArrow(run, f"fp bigint, s array<{kind}>")
        a, b = (arrays.select(F.col("fp").alias(f"__{k}"), F.col("s").alias(f"s{k}")) for k in "uv")
        a = a.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))) if spread > 1 else a.withColumn("__part", F.lit(0))
        part = F.pmod(F.xxhash64("v"), F.lit(spread)).cast("int") if spread > 1 else F.lit(0)
        return pairs.join(b, pairs["v"] == b["__v"]).withColumn("__of", part).join(a, (F.col("u") == a["__u"]) & (F.col("__of") == a["__part"])).drop("__of", "__part")

    def linked(self, pairs: DataFrame) -> DataFrame | None:
        """Those of pairs (u, v, cu, cv) whose sets reach the threshold: cu, cv. First their shingles are counted in BUCKETS by hash:
        two sets share no more in a bucket than either has there. Whole sets are compared only where that bound allows a link."""
        if not pairs.head(1):
            return None
        counted = self.per_node(pairs, lambda s: np.bincount((s >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), minlength=BUCKETS).astype(np.int32), "int")
        total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b)
        most = total(F.zip_with("su", "sv", lambda a, b: F.least(a, b)))
        left = counted.where(most * 100 >= (total(F.col("su")) + total(F.col("sv")) - most) * self.percent)
        left = materialize(left.select("u", "v", "cu", "cv").distinct(), "bounded")
        if not left.head(1):
            drop_table(left)
            return None
        both = self.per_node(left, signed, "bigint")
        common = F.size(F.array_intersect("su", "sv"))
        union = F.size("su") + F.size("sv") - common
        links = materialize(both.where(common * 100 >= union * self.percent).select("cu", "cv").distinct(), "links")
        drop_table(left)
        if links.head(1):
            return links
        drop_table(links)
        return None

    def merged(self, comps: DataFrame | None, pairs: DataFrame) -> DataFrame | None:
        """Components after the links among pairs; None if there are none."""
        links = self.linked(pairs)
        if links is None:
            return None
        out = _merge(comps, links)
        drop_table(links)
        return out

    def reach(self, a: str, b: str, k: Column) -> Column:
        """Places after its size up to which a set of a shingles has k of those that it must share with one of b; negative."""
        return k - self.overlap(a, b) - 1

    def peel(self, rows: DataFrame, comps: DataFrame | None) -> tuple[DataFrame | None, list[DataFrame]]:
        """Components after each token's nodes have met the token's leaders, and the pairs compared: u, v, unordered."""
        columns, left, tried = rows.columns, _with_comp(rows, comps, "fp", "comp"), []
        for _ in range(self.peelings):
            lead = left.groupBy("token").agg(F.min(F.struct("pos", "fp", "n", "comp")).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
            lead = lead.select(F.col("token").alias("__token"), *(F.col(f"l.{c}").alias(f"l{c}") for c in ("pos", "fp", "n", "comp")))
            rest = materialize(left.join(lead, left["token"] == lead["__token"]).where("comp <> lcomp").drop("__token"), "rest")
            # one match is enough here: a leader meets each node once, whatever the prefixes' lengths
            reach = self.reach("n", "ln", F.lit(1))
            may = self.close("n", "ln") & self.close("ln", "n") & (F.col("pos") <= F.col("n") + reach) & (F.col("lpos") <= F.col("ln") + reach)
            pairs = materialize(rest.where(may).select(F.col("lfp").alias("u"), F.col("fp").alias("v"), F.col("lcomp").alias("cu"), F.col("comp").alias("cv")).distinct(), "pairs")
            tried.append(pairs)
            found = self.merged(comps, pairs)
            if found is None:
                drop_table(rest)
                break
            comps = found
            left = _with_comp(_with_comp(rest.select(*columns, "lfp"), comps, "fp", "comp"), comps, "lfp", "lcomp").where("comp <> lcomp").select(*columns, "comp")
        return comps, tried

    def differences(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What each of members (u, cu, nu, v, cv, n, cls) differs in from its class's anchor u, d shingles, rarest in the class first:
        key, v, n, cv, d, pos of the prefix; and those that link with u: u, v, cu, cv."""
        percent, names = self.percent, ["u", "v", "cu", "cv", "n", "e", "k", "counts"]
        both = self.per_node(members, signed, "bigint", SPREAD).withColumn("e", F.concat(F.array_except("su", "sv"), F.array_except("sv", "su")))
        links = (F.size("e") * (100 + percent) <= (F.col("n") + F.col("nu")) * (100 - percent)) & (F.col("cu") != F.col("cv"))
        both = both.select(F.when(links, F.col("u")).alias("u"), "v", "cu", "cv", "n", "e", "cls")

        def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sketch, rows = np.zeros(1 << SKETCH_BITS, dtype=np.uint32), 0
            for batch in small_batches(batches):
                n, out = batch.num_rows, []
                for cls, e in zip(batch.column("cls").to_numpy(), batch.column("e"), strict=True):
                    out.append(np.sort(mixed((e.values.to_numpy() ^ cls).view(np.uint64))))
                    np.add.at(sketch, _cells(out[-1]), np.uint32(1))
                rows += n
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array([signed(x) for x in out], pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            for k, part in _segments(sketch) if rows else ():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.list_(pa.int64())), pa.array([k], pa.int32()), pa.array([part], pa.binary())], names=names)

        read = materialize(both.mapInArrow(keys, "u bigint, v bigint, cu bigint, cv bigint, n bigint, e array<bigint>, k int, counts binary"), "differences")
        levels = self.spark.sparkContext.broadcast(_levels(read)[0])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                out: list[tuple[np.ndarray, ...]] = []
                for v, n, cv, e in zip(*(batch.column(c).to_numpy() for c in ("v", "n", "cv")), batch.column("e"), strict=True):
                    s = e.values.to_numpy().view(np.uint64)
                    own = levels.value[_cells(s)]
                    # sets that link differ in that many shingles at most
                    order = np.argsort(own, kind="stable")[: n * (100 - percent) // percent + 1]
                    # a place that one node alone has counted belongs to no other
                    pos = np.flatnonzero(own[order] > 8)
                    out.append((signed(s[order[pos]]), *(np.full(len(pos), x) for x in (v, n, cv, len(s))), pos))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["key", "v", "n", "cv", "d", "pos"])

        found = read.where("k is null").select("v", "n", "cv", "e").mapInArrow(run, "key bigint, v bigint, n bigint, cv bigint, d bigint, pos bigint")
        found, linked = materialize(found, "differing"), materialize(read.where("u is not null").select("u", "v", "cu", "cv"), "anchors")
        drop_table(read)
        return found, linked

    def anchored(self, rows: DataFrame) -> DataFrame | None:
        """Pairs (u, v, cu, cv) that may link, of nodes that share a token of these rows; None if there are no rows.

        Two nodes u and v with an anchor a differ where just one of them differs from a. With du and dv shingles that differ from a's, and
        h the most that linking sets of their sizes differ in, they share t = (du + dv - h) / 2 of these, at least. If that is below 1,
        both link with a, by the triangle inequality; else they meet at a place of du - t or before in u's order and dv - t in v's. So the
        edits that two near copies have between them count, not what all copies share. Nodes that hang together by such tokens
        and are of like size are a class. Each is in two, so that any two close sizes have a class in common, and none is far from its
        anchor's size. Any node may be the anchor; the one that leads most rows is near the middle.
        """
        if not rows.head(1):
            return None
        lead = rows.groupBy("token").agg(F.min("fp").alias("l"))
        groups = components(rows.join(lead, "token").where("fp <> l").select(F.col("fp").alias("u"), F.col("l").alias("v")).distinct())
        band = F.floor(F.log("n") / max(1.0001 * math.log(100 / self.percent), 1e-9))
        members = rows.join(groups.select("node", F.col("comp").alias("g")), rows["fp"] == F.col("node"))
        members = members.withColumn("band", F.explode(F.array(band, band + 1))).select(F.xxhash64("g", "band").alias("cls"), "token", "pos", "fp", "n", "comp")
        members = materialize(members, "members")
        led = members.groupBy("cls", "token").agg(F.min(F.struct("pos", "fp", "n", "comp")).alias("l"), F.count(F.lit(1)).alias("c"))
        led = led.groupBy("cls", *(F.col(f"l.{c}").alias(c) for c in ("fp", "n", "comp"))).agg(F.sum("c").alias("c"))
        anchors = led.groupBy("cls").agg(F.max(F.struct("c", "fp", "n", "comp")).alias("a"))
        several = members.groupBy("cls").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("cls")
        # a row per class, of which there are fewer than tokens with MANY rows by far
        anchors = F.broadcast(materialize(anchors.join(several, "cls").select("cls", F.col("a.fp").alias("u"), F.col("a.comp").alias("cu"), F.col("a.n").alias("nu")), "classes"))
        each = members.select("cls", F.col("fp").alias("v"), "n", F.col("comp").alias("cv")).distinct().join(anchors, "cls")
        each = materialize(each, "each")
        drop_table(members)
        met, links = self.differences(each)
        drop_table(each)
        pairs = materialize(self.differing_alike(met).select("u", "v", "cu", "cv").distinct().unionByName(links), "alike")
        drop_table(met)
        return pairs

    def differing_alike(self, rows: DataFrame) -> DataFrame:
        """u, v, cu, cv of nodes in different components that share a difference at places that allow a link, a row per difference."""
        rows = rows.distinct()
        # what the best partner could do for a row
        most, rest = F.expr(f"n * {100 - self.percent} div {self.percent}"), F.col("d") - 2 * F.col("pos")
        best = rows.groupBy("key").agg(F.min("cv").alias("lo"), F.max("cv").alias("hi"), F.min("d").alias("least"), F.max(rest).alias("last")).where("lo <> hi").select("key", "least", "last")
        rows = rows.join(best, "key").where((F.col("least") <= rest + most) & (F.col("last") >= F.col("d") - most)).drop("least", "last")
        several = rows.groupBy("key").agg(F.min("cv").alias("lo"), F.max("cv").alias("hi")).where("lo <> hi").select("key")
        rows = materialize(rows.join(several, "key", "left_semi"), "alike")
        x, y = (rows.select("key", *(F.col(c).alias(f"{c[0]}{i}") for c in ("n", "d", "pos")), F.col("v").alias(i), F.col("cv").alias(f"c{i}")) for i in "uv")
        h = F.expr(f"((nu + nv) * {100 - self.percent}) div {100 + self.percent}")
        gap = F.col("du") - F.col("dv")
        may = (F.col("u") < F.col("v")) & self.close("nu", "nv") & self.close("nv", "nu") & (F.col("cu") != F.col("cv")) & (2 * F.col("pu") <= h + gap) & (2 * F.col("pv") <= h - gap)
        return x.join(y, "key").where(may).select("u", "v", "cu", "cv")

    def prefix_pairs(self, rows: DataFrame, comps: DataFrame | None, tried: list[DataFrame]) -> DataFrame:
        """Pairs in different components that share as many tokens of their prefixes as they must, without those tried."""
        rows = _with_comp(rows, comps, "fp", "comp")
        several = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), (F.count(F.lit(1)) > MANY).alias("many")).where("lo <> hi").select("token", "many")
        rows = materialize(rows.join(several, "token"), "several")
        # who shares a token that many have is compared there, whatever other tokens they share
        near = self.anchored(rows.where("many"))
        few = rows.where("not many")
        x, y = (few.select("token", F.col("fp").alias(i), *(F.col(c).alias(f"{c[0]}{i}") for c in ("n", "pos", "k", "comp"))) for i in "uv")
        # the smaller set's place: its partner is no smaller than itself
        y = y.where(F.col("pv") <= F.col("nv") + self.reach("nv", "nv", F.col("kv")))
        larger = (F.col("nv") < F.col("nu")) | ((F.col("nv") == F.col("nu")) & (F.col("v") < F.col("u")))
        k = F.least("ku", "kv", self.overlap("nu", "nv"))
        reach = self.reach("nu", "nv", k)
        met = x.join(y, "token").where(larger & self.close("nv", "nu") & (F.col("cu") != F.col("cv")) & (F.col("pu") <= F.col("nu") + reach) & (F.col("pv") <= F.col("nv") + reach))
        pairs = met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"), F.min(k).alias("k"), F.min("cu").alias("cu"), F.min("cv").alias("cv")).where("shared >= k").select("u", "v", "cu", "cv")
        if near is not None:
            pairs = pairs.unionByName(near).distinct()
        for t in tried:
            t = t.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("t")).select(F.col("t.u").alias("__u"), F.col("t.v").alias("__v"))
            pairs = pairs.join(t, (F.col("u") == F.col("__u")) & (F.col("v") == F.col("__v")), "left_anti")
        pairs = materialize(pairs.select("u", "v", "cu", "cv"), "pairs")
        for t in [rows, *tried, *([] if near is None else [near])]:
            drop_table(t)
        return pairs

    def run(self) -> DataFrame:
        prefixes = self.prefixes()
        rows = self.shared(prefixes)
        drop_table(prefixes)
        comps, tried = self.peel(rows, None)
        found = self.merged(comps, self.prefix_pairs(rows, comps, tried))
        comps = comps if found is None else found
        named = _with_comp(self.nodes.select("fp", "id"), comps, "fp", "comp")
        least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
        names = named.select("fp", "comp").join(least, "comp").select(F.col("fp").alias("__fp"), "component_id")
        rows = self.rows.join(names, self.rows["fp"] == names["__fp"], "left")
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def bloom(hashes: DataFrame, most_bits: int = 1 << 27) -> np.ndarray | None:
    """Bits, in bytes, of distinct 64-bit hashes (column h), a segment built by one task; None if it would need more than most_bits, 16 MB."""
    keys = hashes.count()
    if 8 * keys > most_bits:
        return None
    segments = 1 << max(0, (10 * keys // SEGMENT_BITS).bit_length())
    segments = min(segments, most_bits // SEGMENT_BITS)

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            h, k = batch.column("h").to_numpy(), batch.column("k").to_numpy()
            for segment in np.unique(k).tolist():
                bits = own.setdefault(segment, np.zeros(SEGMENT, dtype=np.uint8))
                for at in _places(h[k == segment]):
                    np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        for segment, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([bits.tobytes()])], names=["k", "b"])

    out = np.zeros(segments * SEGMENT, dtype=np.uint8)
    dealt = hashes.withColumn("k", F.col("h").bitwiseAND(F.lit(segments - 1))).repartition("k")
    for r in dealt.mapInArrow(fill, "k bigint, b binary").collect():  # most_bits at most, in one job
        out[r["k"] * SEGMENT : (r["k"] + 1) * SEGMENT] = np.frombuffer(r["b"], np.uint8)
    return out


def _places(h: np.ndarray) -> list[np.ndarray]:
    """Three places within a segment."""
    m = mixed(h.astype(np.int64).view(np.uint64))
    return [((m >> np.uint64(s)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64) for s in (0, 19, 38)]


def in_bloom(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    base = (h & (len(filter_) // SEGMENT - 1)) * SEGMENT
    for at in _places(h):
        out &= ((filter_[base + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
    return out


def components_of(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", peelings: int = 4) -> DataFrame:
    """doc_id, n_shingles and component_id, the least id that links lead to, of each row of docs.

    Two documents link if the intersection of their shingle sets has `percent` per cent of the union, or more.
    """
    return Join(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words, percent, peelings).run()


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one of each component: the one of the least id; of rows that share it, any one.

    Only rows of one component remove each other: where ids are null or shared, rows are told apart by numbers of their own.
    """
    if not docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).head(1):
        found = materialize(components_of(docs, words, percent, id_col, text_col), "found")
        gone = found.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
        return without(docs, id_col, gone)
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = components_of(rows, words, percent, "__row", text_col).where("n_shingles > 0").select(F.col("doc_id").alias("__n"), "component_id")
    found = materialize(found, "found")
    ids = rows.select("__row", F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "__row").alias("order"))
    kept = found.join(ids, found["__n"] == ids["__row"]).groupBy("component_id").agg(F.min("order").alias("least")).select(F.col("least.__row").alias("__kept"))
    gone = found.join(kept, found["__n"] == kept["__kept"], "left_anti").select(F.col("__n").alias("__gone"))
    return without(rows, "__row", gone).select(*docs.columns)


def without(docs: DataFrame, id_col: str, gone: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """docs without the rows whose id is in gone (column __gone).

    Only rows that pass a Bloom filter of these ids are joined: a join of all would move every text as soon as the ids are too many to
    be broadcast. Beyond most_bits all are joined, with the same result.
    """
    filter_ = bloom(gone.select(F.xxhash64("__gone").alias("h")), most_bits)
    if filter_ is None:
        return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    @F.arrow_udf("boolean")
    def passes(h: pa.Array) -> pa.Array:
        return pa.array(in_bloom(shared.value, h.to_numpy()))

    passed = passes(F.xxhash64(id_col))
    met = docs.where(passed)
    return docs.where(~passed).unionByName(met.join(gone, met[id_col] == gone["__gone"], "left_anti"))
