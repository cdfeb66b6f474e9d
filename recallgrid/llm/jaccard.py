"""Exact Jaccard join of documents on word shingles, as a metric-space join.

Jaccard distance is a metric. Over all documents it is concentrated at 1: a pivot's region would hold its near copies
only, and a triangle-inequality window would replicate every other document to every pivot. So the first level of
regions comes from a lossless split of the shingle universe, and pivots work where distances tell something.

1. Equal sets become one. Sizes are split into classes such that linked sets lie in one class or in neighbours. For a
   class whose smaller linked set has at most r shingles, linked sets differ in at most r / 9 shingles (at 0.9), so of
   that many parts of the hashed universe and some spare ones, at least as many are equal in both as are spare: all but
   a ninth of the smaller set's own size. That is more than the parts that are empty by chance, so empty parts count
   only where a set has that many of them, and then all but so many. Sets of the class before meet each other in their
   own class, so a part counts only where a set of its class has it.
   Sets with an equal part are compared by their counts in ``BUCKETS`` hash buckets: the sum of
   the smaller counts is at least the intersection, so the distance that it gives is at most the true one, and a pair
   that it keeps apart can't link. What it connects lies in one region; regions are connected components.
2. Within a region, pivots: a pivot's distances to all members are computed exactly; members within the threshold
   link to it. A member needs no more checks when no member of another component lies in its windows, that is within
   the threshold of its distance to every pivot so far (triangle inequality). Otherwise it becomes a pivot itself.
3. Regions of more than ``REGION_TOKENS`` shingles are first worked on where they lie: a bounded number of pivots is
   sent out, members go to the Voronoi cell of their nearest pivot, members in the windows are replicated to other
   cells, and cells are joined recursively. Cells that don't get smaller are joined block by block.

A signature that more than ``HOT_SETS`` sets share isn't looked at in one task: its sets' counts, as sets of (bucket,
repetition), are regions of their own and go through 2. and 3., where cells and blocks bound what one task holds.

Links are exact: a pair is linked if and only if its exact overlap says so. Sets are told apart by 128 bits and numbered
in a written table. Null, empty and blank texts have an empty set, no links and themselves as component. Repeated rows
have equal sets and share a component; rows without a doc_id link and bridge as others do but give no component its
number (a component without any doc_id has null). An empty table gives an empty result; texts of any length are read
whole, and a set larger than a region's bound is a region of its own. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard, lower_ascii, mix, shingles, utf8, word_hashes

#: Shingles (8 bytes each) of a region that one task joins.
REGION_TOKENS = 6_000_000
#: Pivots sent out for a large region at each level, their shingles at most, and levels.
PIVOTS, PIVOT_TOKENS, LEVELS = 32, 2_000_000, 4
#: More parts than differences, so that parts that are empty by chance aren't needed: this many, and a share of all.
SPARE = 2
#: Buckets of a set's counts: at least and at most, for about four shingles in each.
BUCKETS, MOST_BUCKETS = 128, 8192
#: Distinct groups of sets with an equal part whose signatures are sent to all executors (8 bytes each); more are joined by a shuffle.
SENT_GROUPS = 1_000_000
#: Sets with one signature that one task compares by their counts.
HOT_SETS = 2_000


class Rule:
    """Sets link when den * intersection >= num * union."""

    def __init__(self, num: int, den: int, words: int) -> None:
        self.num, self.den, self.words = num, den, words
        self.radius = 1 - num / den
        # classes: [low, high] with the next low above high / threshold's inverse
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(self.lows[-1] * den // num + 1)

    def linked(self, both: np.ndarray, n: np.ndarray, m) -> np.ndarray:
        return self.den * both >= self.num * (n + m - both)

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def differ(self, n: int) -> int:
        """Most shingles that only one of two linked sets has, if the smaller one has n."""
        return (self.den - self.num) * n // self.num

    def parts(self, c: int) -> tuple[int, int]:
        """Parts for pairs whose larger set is in class c, so whose smaller one is at most the class's high, and how many of them are spare.

        The spare parts are 1.5 times the empty ones to be expected of a set at the class's high, and two; a smaller set
        has more of both.
        """
        high = self.lows[c + 1] - 1
        differ = self.differ(high)
        spare = SPARE
        for _ in range(12):
            spare = SPARE + int(1.5 * (differ + spare) * math.exp(-high / (differ + spare)))
            spare = min(spare, SPARE + differ // 2)
        return differ + spare, spare

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Part hashes of a sorted set for its own class and the next; the last bit is that of the class's number.

        Two linked sets have at least m less ``differ`` of the smaller one parts in common. Where all of these may be
        empty, both leave out one less than their own such bound, from the last empty part on, so one of them stays in both.
        """
        c, out = self.size_class(len(s)), []
        for k in (c, c + 1):
            m, _ = self.parts(k)
            equal = m - self.differ(len(s))
            part = (mix(s + np.uint64(0x51ED27)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            place = part[order]
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            own = mix(np.add.reduceat(mix(s[order]), first))
            which = place[first]
            if m - len(first) >= equal:  # so many empty parts that the equal ones may all be empty
                empty = np.setdiff1d(np.arange(m), which)[: m - len(first) - equal + 1]
                which, own = np.concatenate([which, empty]), np.concatenate([own, np.zeros(len(empty), np.uint64)])
            x = mix(own + mix(which.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(k)))
            out.append(x & ~np.uint64(1) | np.uint64(k & 1))
        return np.concatenate(out)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(lower_ascii(text))[0], words))


def bucket_counts(s: np.ndarray) -> bytes:
    """Members of a set by the first bits of their hash: a byte with the bits of a count, 4 if no count needs more, and the counts.

    Adjacent buckets of more bits add up to those of fewer.
    """
    b = BUCKETS
    while b < MOST_BUCKETS and 4 * b < len(s):
        b *= 2
    n = np.bincount((s >> np.uint64(65 - b.bit_length())).astype(np.int64), minlength=b)
    if n.max() < 16:
        return b"\4" + (n[::2] << 4 | n[1::2]).astype(np.uint8).tobytes()
    return b"\x08" + n.astype(np.uint8).tobytes() if n.max() < 256 else b" " + n.astype("<u4").tobytes()


def read_counts(raw: bytes) -> np.ndarray:
    if raw[0] == 4:
        x = np.frombuffer(raw, np.uint8, offset=1)
        return np.column_stack([x >> 4, x & 15]).ravel().astype(np.int64)
    return np.frombuffer(raw, np.uint8 if raw[0] == 8 else "<u4", offset=1).astype(np.int64)


def _folded(n: np.ndarray, wide: int) -> np.ndarray:
    return n.reshape(wide, -1).sum(1)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def describe(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null for an empty one) and a hash of the text for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                sets = [shingle_set(t, rule.words) for t in utf8(piece)]
                yield pa.record_batch({
                    "doc_id": piece.column(0), "n_shingles": pa.array(list(map(len, sets)), pa.int64()),
                    "digest": pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), "text_hash": piece.column(2),
                })

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {key}, n_shingles long, digest binary, text_hash long")


def _signed(docs: DataFrame, rule: Rule) -> DataFrame:
    """digest, n, the last bit of its class, signatures and bucket counts of every set that isn't empty; a task hands on most repeated ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = {}
                for t in utf8(batch.slice(at, 500)):
                    s = shingle_set(t, rule.words)
                    if len(s) and (d := _digest(s)) not in seen:
                        seen.add(d)
                        sets[d] = s
                sigs = [rule.signatures(s).view(np.int64) for s in sets.values()]
                if len(seen) > 1 << 18:  # what is seen again later is dropped behind the shuffle
                    seen.clear()
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sigs])])
                yield pa.record_batch({
                    "digest": pa.array(list(sets), pa.binary()), "n": pa.array([len(s) for s in sets.values()], pa.int64()),
                    "odd": pa.array([rule.size_class(len(s)) & 1 for s in sets.values()], pa.int64()),
                    "sigs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*sigs, np.zeros(0, np.int64)]), pa.int64())),
                    "counts": pa.array([bucket_counts(s) for s in sets.values()], pa.binary()),
                })

    return docs.select("text").mapInArrow(run, "digest binary, n long, odd long, sigs array<long>, counts binary")


def _close(rule: Rule) -> Callable:
    """From rows (sig, set_id, n, counts) in order of sig: a star (a, b) over what the counts connect in each group."""

    def group(ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int]]:
        comp = np.arange(len(ids))
        for p in range(len(ids)):
            near = np.flatnonzero((comp != comp[p]) & (rule.den * np.minimum(sizes, sizes[p]) >= rule.num * np.maximum(sizes, sizes[p])))
            for at in range(0, len(near), 8192):
                part = near[at : at + 8192]
                both = np.minimum(counts[part], counts[p]).sum(1, dtype=np.int64)
                for i in part[rule.linked(both, sizes[part], sizes[p])]:
                    if comp[i] != comp[p]:
                        yield int(ids[p]), int(ids[i])
                        a, b = sorted((comp[i], comp[p]))
                        comp[comp == b] = a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def edges(t: pa.Table) -> pa.RecordBatch:
            sig, ids, sizes = (t.column(i).to_numpy() for i in range(3))
            own = [read_counts(x) for x in t.column(3).to_pylist()]
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            out = []
            for a, b in zip(first, np.append(first[1:], len(sig))):
                if b - a > 1:
                    wide = min(map(len, own[a:b]))
                    counts = np.array([_folded(x, wide) for x in own[a:b]])
                    out += group(ids[a:b], sizes[a:b], counts)
            return pa.record_batch({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            sig = t.column(0).to_numpy()
            if len(sig):
                last = int(np.searchsorted(sig, sig[-1]))  # the last group may go on in the next batch
                if last:
                    yield edges(t.slice(0, last))
                rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield edges(rest)

    return run


def _hot_regions(rows: DataFrame, rule: Rule) -> DataFrame:
    """Regions (region, set_id, n, s) of signatures that very many sets have: counts as sorted sets of bucket and repetition.

    The Jaccard index of such sets is that of the counts. Linked sets' sizes, so their numbers of buckets, differ by a
    bounded factor: each set goes to its own number's region and, folded, to those of the smaller numbers within it.
    """
    fewer = range(math.ceil(math.log2(rule.den / rule.num)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions, ids, sizes, tokens = [], [], [], []
            for sig, sid, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = read_counts(raw)
                for wide in {max(BUCKETS, len(n) >> k) for k in fewer}:
                    x = _folded(n, wide)
                    first = np.repeat(np.cumsum(x) - x, x)
                    s = np.repeat(np.arange(wide, dtype=np.uint64) << np.uint64(32), x) + (np.arange(len(first)) - first).astype(np.uint64)
                    regions.append(_cell(sig, wide)), ids.append(sid), sizes.append(len(s)), tokens.append(s.tobytes())
            yield pa.record_batch({"region": pa.array(regions, pa.int64()), "set_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "s": pa.array(tokens, pa.binary())})

    return rows.select("sig", "set_id", "counts").mapInArrow(run, "region long, set_id long, n long, s binary")


def overlaps(tokens: np.ndarray, first: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Intersection sizes of a pivot (sorted) with sets that lie one after another in tokens."""
    at = np.searchsorted(pivot, tokens)
    at[at == len(pivot)] = 0
    return np.add.reduceat((pivot[at] == tokens).astype(np.int64), first)


def join_region(sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links between places in sets that connect all that are linked, by pivots and triangle-inequality windows."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens, first = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    comp = np.arange(n)
    dist = np.zeros((0, n))
    out = []
    slack = rule.radius + 1e-9
    for p in np.argsort(-sizes, kind="stable"):
        # members of other components that may link to p: by size, and by distance to each pivot
        near = (comp != comp[p]) & (rule.den * np.minimum(sizes, sizes[p]) >= rule.num * np.maximum(sizes, sizes[p]))
        if not near.any():
            continue
        near &= (np.abs(dist - dist[:, [p]]) <= slack).all(0)
        if not near.any():
            continue
        if len(dist) < 64:
            members = np.arange(n)
            both = overlaps(tokens, first, sets[p])
            dist = np.vstack([dist, 1 - both / (sizes + sizes[p] - both)])
        else:
            members = np.flatnonzero(near)
            part = [sets[i] for i in members]
            both = overlaps(np.concatenate(part), np.concatenate([[0], np.cumsum(sizes[members])[:-1]]), sets[p])
        for i in members[rule.linked(both, sizes[members], sizes[p])]:
            if comp[i] != comp[p]:
                out.append((int(p), int(i)))
                a, b = sorted((comp[i], comp[p]))
                comp[comp == b] = a
    return out


def _leaf(rule: Rule) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["s"]]
        ids = pdf["set_id"].to_numpy()
        links = join_region(sets, rule)
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    return run


def _with_sets(docs: DataFrame, rule: Rule, members: DataFrame) -> DataFrame:
    """region, set_id, n and the set of each member; members: region, set_id, digest and the doc_id and text hash of one row with that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                sets = [shingle_set(t, rule.words) for t in utf8(piece)]
                # another text with the same id and hash isn't the member's
                own = [k for k, (s, d) in enumerate(zip(sets, piece.column(3).to_pylist())) if _digest(s) == d]
                kept = piece.take(pa.array(own, pa.int64()))
                yield pa.record_batch({
                    "region": kept.column(0), "set_id": kept.column(1), "n": pa.array([len(sets[k]) for k in own], pa.int64()),
                    "s": pa.array([sets[k].tobytes() for k in own], pa.binary()),
                })

    own = members.select("region", "set_id", "digest", F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = rows.join(own, rows["doc_id"].eqNullSafe(own["own_id"]) & (rows["text_hash"] == own["own_hash"]))
    # repeated rows bring a set twice
    return rows.select("region", "set_id", "text", "digest").mapInArrow(run, "region long, set_id long, n long, s binary").dropDuplicates(["region", "set_id"])


def _cell(region: int, pivot: int) -> int:
    """A cell's number, from its region's and its pivot's."""
    return int.from_bytes(hashlib.blake2b(b"%d %d" % (region, pivot), digest_size=8).digest(), "little", signed=True)


def _pivot_level(large: DataFrame, rule: Rule, level: int) -> tuple[DataFrame, DataFrame]:
    """Links to pivots, and the cells with the members that still need a join."""
    spark = large.sparkSession
    order = F.xxhash64("set_id", F.lit(level))
    regions = [r["region"] for r in large.groupBy("region").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(PIVOTS).select("region").collect()]
    each = max(2, PIVOTS // len(regions))
    parts = [large.where(F.col("region") == r).orderBy(order, "set_id").limit(each) for r in regions]
    took = parts[0]
    for p in parts[1:]:
        took = took.unionAll(p)
    pivots, total = [], 0
    for r in took.collect():
        total += r["n"]
        if total <= PIVOT_TOKENS or not any(p[0] == r["region"] for p in pivots):
            pivots.append((r["region"], r["set_id"], np.frombuffer(bytes(r["s"]), np.uint64)))
    sent = spark.sparkContext.broadcast(pivots)
    slack = rule.radius + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for region, sid, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s = np.frombuffer(raw, np.uint64)
                own = [(k, p) for k, (r, _, p) in enumerate(pivots) if r == region]
                if not own:
                    rows[0].append(region), rows[1].append(sid), rows[2].append(n), rows[3].append(raw), rows[4].append(None), rows[5].append(False)
                    continue
                both = np.array([np.isin(s, p, assume_unique=True).sum() for _, p in own])
                size = np.array([len(p) for _, p in own])
                d = 1 - both / (n + size - both)
                link = rule.linked(both, n, size)
                best = int(np.argmin(d))
                for i, (k, _) in enumerate(own):
                    if link[i] or i == best or d[i] <= d[best] + 2 * slack:
                        rows[0].append(_cell(region, pivots[k][1])), rows[1].append(sid), rows[2].append(n), rows[3].append(raw)
                        rows[4].append(pivots[k][1] if link[i] else None), rows[5].append(i != best)
            yield pa.record_batch({
                "region": pa.array(rows[0], pa.int64()), "set_id": pa.array(rows[1], pa.int64()), "n": pa.array(rows[2], pa.int64()),
                "s": pa.array(rows[3], pa.binary()), "pivot": pa.array(rows[4], pa.int64()), "window": pa.array(rows[5], pa.bool_()),
            })

    cells = cut(large.select("region", "set_id", "n", "s").mapInArrow(run, "region long, set_id long, n long, s binary, pivot long, window boolean"), "cells")
    links = cells.where("pivot is not null and pivot <> set_id").select(F.col("pivot").alias("a"), F.col("set_id").alias("b"))
    # a cell whose members all link to its pivot is one component and needs no join
    open_cells = cells.groupBy("region").agg(F.count("*").alias("all"), F.count("pivot").alias("linked")).where("linked < `all`").select("region")
    return links, cells.join(open_cells, "region", "left_semi").select("region", "set_id", "n", "s")


def _block_join(large: DataFrame, rule: Rule, sizes: DataFrame) -> DataFrame:
    """Every pair of blocks of a region, each in a task of its own: exact for regions that no pivot makes smaller."""
    half = max(1, REGION_TOKENS // 2)
    counted = sizes.select("region", (F.floor(F.col("tokens") / half) + 2).cast("long").alias("blocks"))
    dealt = large.join(counted, "region").withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(5)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = dealt.withColumn("o", other).select("region", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "set_id", "n", "s")
    return pairs.groupBy("region", "x", "y").applyInPandas(_leaf(rule), "a long, b long")


def links_within(members: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) of set ids that connect all linked members of each region."""
    found, now = [], members
    for level in range(LEVELS + 1):
        sizes = cut(now.groupBy("region").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets")).where("sets > 1"), "sizes")
        small, large = sizes.where(F.col("tokens") <= REGION_TOKENS), sizes.where(F.col("tokens") > REGION_TOKENS)
        # many small regions share a task
        leaf = now.join(small.select("region"), "region", "left_semi")
        found.append(leaf.groupBy("region").applyInPandas(_leaf(rule), "a long, b long"))
        if large.isEmpty():
            break
        rest = now.join(large.select("region"), "region", "left_semi")
        if level == LEVELS:
            found.append(_block_join(rest, rule, large))
            break
        links, now = _pivot_level(rest, rule, level)
        found.append(links)
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def set_components(docs: DataFrame, num: int = 90, den: int = 100, words: int = 3) -> tuple[DataFrame, DataFrame]:
    """Written tables of all rows (doc_id, n_shingles, digest, text_hash) and of the different sets that aren't empty.

    Sets: digest, root (the set's component), and the doc_id and text_hash of one row with that set, the least one with a doc_id.
    """
    rule = Rule(num, den, words)
    base = cut(describe(docs, rule), "rows")
    # one row for each different set; copies are combined before the shuffle
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    reps = base.where("digest is not null").groupBy("digest").agg(F.min(row).alias("r")).select("digest", "r.doc_id", "r.text_hash")
    reps = cut(reps.withColumn("set_id", F.monotonically_increasing_id()), "sets")
    own = _signed(docs, rule).join(reps.select("digest", "set_id"), "digest").dropDuplicates(["digest"])
    own = cut(own.select("set_id", "n", "odd", "sigs", "counts"), "signatures")
    # signatures that several sets have, one of them in its own class; those with the same sets need one look only
    rows = own.select("set_id", "odd", F.explode("sigs").alias("sig"))
    mine = F.max(F.col("sig").bitwiseAND(1) == F.col("odd")).alias("mine")
    shared = rows.groupBy("sig").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("set_id")).alias("h"), mine).where("c > 1 and mine")
    rows = rows.drop("odd")
    groups = cut(shared.groupBy("c", "h").agg(F.min("sig").alias("sig")).select("sig", "c"), "groups")
    few = groups.count() <= SENT_GROUPS
    pairs = cut(rows.join(F.broadcast(groups) if few else groups, "sig"), "pairs")
    close = pairs.join(own.select("set_id", "n", "counts"), "set_id")
    usual = close.where(F.col("c") <= HOT_SETS).select("sig", "set_id", "n", "counts").repartition("sig").sortWithinPartitions("sig")
    star = cut(usual.mapInArrow(_close(rule), "a long, b long").distinct(), "close")
    if groups.where(F.col("c") > HOT_SETS).isEmpty():
        edges = star
    else:
        hot = cut(_hot_regions(close.where(F.col("c") > HOT_SETS), rule), "hot")
        edges = star.unionAll(cut(links_within(hot, rule), "hot_links"))
        discard(hot)
    discard(own, pairs, groups)
    regions = components(edges)
    members = regions.select(F.col("node").alias("set_id"), F.col("component").alias("region")).join(reps, "set_id")
    sets = cut(_with_sets(docs, rule, members), "members")
    links = cut(links_within(sets, rule), "links")
    discard(sets, regions, star)
    group = components(links)
    named = reps.join(group.select(F.col("node").alias("set_id"), F.col("component").alias("root")), "set_id", "left")
    named = cut(named.select("digest", F.coalesce("root", "set_id").alias("root"), "doc_id", "text_hash"), "named")
    discard(reps, links, group)
    return base, named


def jaccard_components(docs: DataFrame, num: int = 90, den: int = 100, words: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row."""
    base, named = set_components(docs, num, den, words)
    low = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    sets = named.join(low, "root").select("digest", "component_id", F.lit(True).alias("known"))
    out = base.join(sets, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, num: int = 80, den: int = 100, words: int = 5) -> DataFrame:
    """docs with one row of each component: the one with the least doc_id, of several such the one with the least hash of its text.

    Rows are judged by their own text, so two texts with one doc_id are two documents. Rows without words stay, repeated
    ones once. All columns are kept.
    """
    base, named = set_components(docs, num, den, words)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = named.groupBy("root").agg(F.min(row).alias("r")).select(F.col("r.doc_id").alias("own_id"), F.col("r.text_hash").alias("own_hash"))
    blank = base.where("digest is null").select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"))
    keep = cut(first.unionAll(blank).distinct(), "keep")
    discard(base, named)
    key = "_text_hash"
    while key in docs.columns:
        key += "_"
    rows = docs.withColumn(key, F.xxhash64("text"))
    kept = rows.join(keep, rows["doc_id"].eqNullSafe(keep["own_id"]) & (rows[key] == keep["own_hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key)
