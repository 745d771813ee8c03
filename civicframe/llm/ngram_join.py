"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles; two link when their sets' Jaccard similarity reaches the
threshold. Equal sets collapse to one representative. Representatives that could link share a
shingle among their first n - ceil(t n) + 1 in one global order (hash order, but shingles that are
frequent in a bounded sample come last; any order is exact, this one keeps common passages apart).
Shingles that are too rare for the sample and still crowd a block are counted over all documents and
go last as well; documents that had one of them among their first are signed anew.
The representatives of such a shingle form a block, named by the smallest of them, its hub; shingles
with the same hub share a block. In a block a signature tree holds, at every node, the OR of the
bitmaps below, the range of set sizes and the largest number of shingles that share a bit; a dual
traversal prunes node pairs whose sizes or largest possible overlap rule a link out, or whose
documents are all linked already. What survives is compared in full by a join of the whole sets.
The first traversal is the hub against its tree, which links groups of copies without listing their
pairs; the second is the tree against itself, for pairs that the first has not joined.
A block above NODE documents is cut into nodes by size class and min-hash. Each node is summed up
where its documents are; pairs of these summaries are pruned first, and documents go only to tasks of
pairs that are left. Links give components by alternating stars.

Null, empty and white-space texts have no shingles and link with nothing; their component is their
own identifier. A text with fewer than k words is one shingle. Rows with the same identifier are one
document with several sets, linked through it. Equal rows get equal results. Texts of any length are
read whole. An empty table gives an empty table. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from civicframe.llm.common import BROADCAST_ROWS, bounded_sample, free_name, table, written
from civicframe.llm.components import connected_components
from civicframe.llm.shingles import by_bytes, shingle_sets

#: Documents of a node that is traversed in a task; leaves and fan-out of the trees within.
NODE, LEAF = 4096, 8
#: Members of small blocks that share a task, on average.
BUNDLE = 1000
#: Sampled documents, in how many of them a shingle counts as frequent, and bound on these shingles.
HOT_SAMPLE, HOT_COUNT, HOT_MOST = 4000, 12, 200_000
#: Times that crowded shingles are looked for; each moves more of them to the end of the order.
PASSES = 3
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit per shingle in 256 to 32768 bits, two to four for each; a shorter one is the longer one's fold."""
    bits = _bits_of(len(shingles))
    flags = np.zeros(bits, np.uint8)
    flags[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(maps: np.ndarray) -> np.ndarray:
    """Bitmaps (rows) of half the length."""
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


def shingled_docs(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, shingles (sorted as unsigned numbers)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(shingle_sets(b.column(1), k))], ["id", "shingles"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, shingles array<long>")


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, k: int) -> np.ndarray:
    """Shingles of at least HOT_COUNT of at most HOT_SAMPLE documents, the most frequent HOT_MOST of them: they go last in the order."""
    chosen = bounded_sample(docs.select(F.col(id_col).alias("sample_id")), "sample_id", HOT_SAMPLE)
    some = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("sample_id"), "left_semi")
    rows = (
        shingled_docs(some, id_col, text_col, k).select(F.explode("shingles").alias("s"))
        .groupBy("s").count().filter(F.col("count") >= HOT_COUNT).orderBy(F.desc("count"), "s").limit(HOT_MOST).select("s").collect()
    )
    return np.sort(np.array([r.s for r in rows], np.int64).view(np.uint64))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    """id, n, c1, c2 (with n: which set it is), prefix (the shingles of which linked sets share one), lead (smallest shingle), map (bitmap)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot = shared.value
        for whole in batches:
            for b in by_bytes(whole, 1):
                sets = shingle_sets(b.column(1), k)
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                ends = np.cumsum(np.append(0, n))
                sums = np.append(np.uint64(0), np.cumsum(flat))
                other = (flat ^ (flat >> np.uint64(27))) * _SECOND
                others = np.append(np.uint64(0), np.cumsum(other ^ (other >> np.uint64(31))))
                prefixes, maps = [], [bitmap(s) for s in sets]
                lead = np.array([s[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                for s in sets:
                    p = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    if len(hot) and len(s):
                        at = np.searchsorted(hot, s)
                        common = hot[np.minimum(at, len(hot) - 1)] == s
                        s = np.concatenate([s[~common], s[common]]) if common.any() else s
                    prefixes.append(s[:p])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n), pa.array((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)), pa.array((others[ends[1:]] - others[ends[:-1]]).view(np.int64)), _lists(prefixes), pa.array(lead), _lists(maps)],
                    ["id", "n", "c1", "c2", "prefix", "lead", "map"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, c1 long, c2 long, prefix array<long>, lead long, map array<long>")


def token_groups(prefixes: DataFrame) -> DataFrame:
    """(token, hub, far, c): shingles that several prefixes share, with the smallest and largest representative and their count."""
    tokens = prefixes.select("rep", F.explode("prefix").alias("token"))
    groups = tokens.groupBy("token").agg(F.min("rep").alias("hub"), F.max("rep").alias("far"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    return written(groups, "groups")


def crowded_shingles(groups: DataFrame, hot: np.ndarray) -> np.ndarray:
    """Shingles of more than NODE prefixes that are not last in the order yet, the most frequent first; as many as HOT_MOST leaves room for.

    Fewer than one of NODE prefix shingles can be crowded.
    """
    room = HOT_MOST - len(hot)
    if room <= 0:
        return np.zeros(0, np.uint64)
    # known ones may fill the first rows, so as many more are read
    rows = groups.filter(F.col("c") > NODE).orderBy(F.desc("c"), "token").limit(HOT_MOST).select("token").collect()
    found = np.array([r.token for r in rows], np.int64).view(np.uint64)
    return found[~np.isin(found, hot)][:room]


def prefix_groups(docs: DataFrame, signed: DataFrame, reps_of, hot: np.ndarray, id_col: str, text_col: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rep, n, prefix) and their token_groups, in an order in which few shingles are crowded.

    A prefix without a shingle that moves to the end stays what it is in the new order, so only the others are made again.
    """
    spark = docs.sparkSession
    prefixes = reps_of(signed).select("rep", "n", "prefix")
    groups = token_groups(prefixes)
    for _ in range(PASSES):
        crowded = crowded_shingles(groups, hot)
        if not len(crowded):
            break
        hot = np.sort(np.concatenate([hot, crowded]))
        # HOT_MOST rows at most
        moved = F.broadcast(spark.createDataFrame([(x,) for x in crowded.view(np.int64).tolist()], "token long"))
        met = prefixes.select("rep", F.explode("prefix").alias("token")).join(moved, "token", "left_semi")
        changed = written(met.select(F.col("rep").alias("changed")).distinct(), "changed")
        if changed.count() <= BROADCAST_ROWS:
            changed = F.broadcast(changed)
        own = docs.join(changed, F.col(id_col) == F.col("changed"), "left_semi")
        again = reps_of(signatures(own, id_col, text_col, k, num, den, hot)).select("rep", "n", "prefix")
        rest = prefixes.join(changed, F.col("rep") == F.col("changed"), "left_anti")
        prefixes = written(rest.union(again), "prefixes")
        groups = token_groups(prefixes)
    return prefixes, groups


def block_members(prefixes: DataFrame, groups: DataFrame) -> DataFrame:
    """(hub, hub_n, rep, n): representatives that share a prefix shingle, under the smallest of the shingle's."""
    pairs = groups.filter("c = 2").select("hub", F.col("far").alias("rep"))
    many = groups.filter("c > 2").select("token", "hub")
    stars = prefixes.select("rep", F.explode("prefix").alias("token")).join(many, "token").select("hub", "rep")
    found = pairs.union(stars).filter("hub <> rep").distinct()
    sizes = prefixes.select("rep", "n")
    return found.join(sizes.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n")), "hub").join(sizes, "rep").select("hub", "hub_n", "rep", "n")


def in_reach(members: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Of block members (hub, hub_n, rep, n) those with another of near size and other label (a component) in their block.

    Gives hub, rep, n, label, class (of size), block_n (members of the block), cuts (nodes by class). What is known of a
    block is written before it is joined, so that AQE can split a block's members.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    both = members.select("hub", "rep", "n").union(members.select("hub", "hub", "hub_n").distinct())
    label = F.coalesce("component", "rep").alias("label")
    named = both.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("hub", "rep", "n", label, size_class.alias("class"))
    named = written(named, "named")
    kinds = named.groupBy("hub", "class").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("c"))
    kinds = written(kinds, "kinds")
    reach = (
        kinds.select("hub", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), "low", "high")
        .groupBy("hub", "class").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("hub", "class")
    )
    # two members are hub and other, which the first traversal has compared
    cuts = F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("c") / NODE).cast("int"))))
    more = kinds.groupBy("hub").agg(F.sum("c").alias("block_n"), cuts.alias("cuts")).filter("block_n > 2")
    known = written(reach.join(more, "hub"), "reach")
    return named.join(known, ["hub", "class"])


class Forest:
    """Union-find over a task's documents; those with equal labels are one from the start."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


class SignatureTree:
    """Levels of nodes over documents in min-hash order; level 0 are leaves of LEAF documents.

    maps: bitmaps of one length (rows); own: which documents have this length themselves (pairs of
    documents that have not are another tree's); side: with two of them only pairs across are asked for.
    """

    def __init__(self, n: np.ndarray, lead: np.ndarray, maps: np.ndarray, labels: list, own: np.ndarray, side: np.ndarray):
        order = np.lexsort((n, lead, side))
        self.ids, self.n, self.maps, self.own, self.side = order, n[order], maps[order], own[order], side[order]
        self.across = len(np.unique(side)) > 1
        self.ones = np.bitwise_count(self.maps).sum(1).astype(np.int64)
        self.forest = Forest([labels[i] for i in order])
        self.levels, self.one = [], set()
        up, low, high, extra = self.maps, self.n, self.n, self.n - self.ones
        one, two = self.side, self.side
        self.sides = []
        while True:
            at = np.arange(0, len(up), LEAF)
            one, two = np.minimum.reduceat(one, at), np.maximum.reduceat(two, at)
            self.sides.append((one, two))
            up, low, high, extra = np.bitwise_or.reduceat(up, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)
            self.levels.append((up, low, high, extra))
            if len(up) == 1:
                break

    def below(self, level: int, i: int) -> range:
        size = len(self.levels[level - 1][0]) if level else len(self.n)
        return range(i * LEAF, min(size, (i + 1) * LEAF))

    def single(self, level: int, i: int) -> bool:
        """Whether all documents of a node are linked already."""
        if (level, i) in self.one:
            return True
        find = self.forest.find
        if level == 0:
            done = len({find(j) for j in self.below(0, i)}) == 1
        else:
            done = all(self.single(level - 1, j) for j in self.below(level, i)) and len({find(j * LEAF**level) for j in self.below(level, i)}) == 1
        if done:
            self.one.add((level, i))
        return done

    def from_one(self, who: int, num: int, den: int) -> list[int]:
        """Documents that may link with document who (an index of the input)."""
        (me,) = np.flatnonzero(self.ids == who)
        out, stack = [], [(len(self.levels) - 1, 0)]
        while stack:
            level, i = stack.pop()
            maps, low, high, extra = self.levels[level]
            if num * low[i] > den * self.n[me] or num * self.n[me] > den * high[i]:
                continue
            most = int(np.bitwise_count(maps[i] & self.maps[me]).sum()) + min(int(extra[i]), int(self.n[me] - self.ones[me]))
            if most * (num + den) < num * int(low[i] + self.n[me]):
                continue
            if level:
                stack += [(level - 1, j) for j in self.below(level, i)]
            else:
                out += [x for x, y in self._leaves(self.below(0, i), range(me, me + 1), num, den) if x != me]
        return [int(self.ids[x]) for x in out]

    def pairs(self, num: int, den: int) -> list[tuple[int, int]]:
        """Pairs that may link and are not linked already."""
        find, out = self.forest.find, []
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            maps, low, high, extra = self.levels[level]
            if self.across and self._beside(level, i, j):
                continue
            if i != j:
                if num * low[i] > den * high[j] or num * low[j] > den * high[i]:
                    continue
                # overlap is at most the common bits and what shares bits
                most = int(np.bitwise_count(maps[i] & maps[j]).sum()) + int(min(extra[i], extra[j]))
                if most * (num + den) < num * int(low[i] + low[j]):
                    continue
            if self.single(level, i) and (i == j or self.single(level, j) and find(i * LEAF ** (level + 1)) == find(j * LEAF ** (level + 1))):
                continue
            if level:
                stack += [(level - 1, a, b) for a in self.below(level, i) for b in self.below(level, j) if i != j or a <= b]
            else:
                out += [(x, y) for x, y in self._leaves(self.below(0, i), self.below(0, j), num, den) if (i != j or x < y) and find(x) != find(y)]
        if self.across:
            out = [(x, y) for x, y in out if self.side[x] != self.side[y]]
        return [(int(self.ids[a]), int(self.ids[b])) for a, b in out]

    def _beside(self, level: int, i: int, j: int) -> bool:
        """Whether all documents of two nodes are on one side."""
        one, two = self.sides[level]
        return bool(one[i] == two[i] == one[j] == two[j])

    def _leaves(self, left: range, right: range, num: int, den: int) -> list[tuple[int, int]]:
        a, b = slice(left.start, left.stop), slice(right.start, right.stop)
        both = np.bitwise_count(self.maps[a][:, None] & self.maps[b][None]).sum(2).astype(np.int64)
        na, nb = self.n[a][:, None], self.n[b][None]
        most = np.minimum(na - (self.ones[a][:, None] - both), nb - (self.ones[b][None] - both))
        may = (most * (num + den) >= num * (na + nb)) & (self.own[a][:, None] | self.own[b][None])
        return [(left.start + int(x), right.start + int(y)) for x, y in zip(*np.nonzero(may))]


def trees_of(n: np.ndarray, lead: np.ndarray, maps: list, labels: list, side: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, SignatureTree]]:
    """One tree for each bitmap length, with the documents of the next length that are near enough in size, folded."""
    size = np.array([len(m) for m in maps])
    for bits in np.unique(size):
        at = np.flatnonzero((size == bits) | (size == 2 * bits) & (num * n <= den * n[size == bits].max()))
        rows = np.stack([maps[i] if size[i] == bits else folded(np.asarray(maps[i])[None])[0] for i in at])
        yield at, SignatureTree(n[at], lead[at], rows, [labels[i] for i in at], size[at] == bits, side[at])


def hub_candidates(members: DataFrame, maps: DataFrame, num: int, den: int, bundles: int) -> DataFrame:
    """Distinct pairs (u, v) of hub and member that the hub's way down its block's tree lets through."""
    near = members.filter(F.expr(f"{num} * n <= {den} * hub_n AND {num} * hub_n <= {den} * n"))
    counts = near.groupBy("hub").agg(F.ceil((F.count(F.lit(1)) + 1) / NODE).cast("int").alias("cuts"))
    counts = written(counts, "counts")
    salt = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("cuts").cast("long")).cast("int")
    cut = near.join(counts, "hub").select("hub", "rep", "n", F.lit(False).alias("is_hub"), salt.alias("part"), "cuts")
    # a large block's members go to several tasks, and the hub to each
    hubs = near.select("hub", "hub_n").distinct().join(counts, "hub")
    hubs = hubs.select("hub", F.col("hub").alias("rep"), F.col("hub_n").alias("n"), F.lit(True).alias("is_hub"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"), "cuts")
    dealt = cut.union(hubs).withColumn("task", _task("cuts", "part", bundles)).join(maps, ["rep", "n"])
    dealt = dealt.select("hub", "rep", "is_hub", "part", "n", "lead", "map", "task")

    def traverse(frame: pd.DataFrame) -> pd.DataFrame:
        out: set = set()
        for (hub, _), block in frame.groupby(["hub", "part"], sort=False):
            block = block.reset_index(drop=True)
            reps, own = block.rep.tolist(), np.flatnonzero(block.is_hub.to_numpy())
            for at, tree in _trees(block, list(range(len(reps))), np.zeros(len(reps), int), num, den):
                for where in np.flatnonzero(np.isin(at, own)):
                    out.update((hub, reps[at[b]]) for b in tree.from_one(int(where), num, den) if reps[at[b]] != hub)
        return pd.DataFrame(sorted(out), columns=["u", "v"])

    kind = members.schema["rep"].dataType.simpleString()
    return dealt.groupBy("task").applyInPandas(traverse, f"u {kind}, v {kind}").distinct()


def node_members(members: DataFrame, maps: DataFrame) -> DataFrame:
    """Members of large blocks with their node: a range of min-hashes within a size class, cut further where equal ones are many."""
    x = (F.col("lead").cast("double") + F.when(F.col("lead") < 0, F.lit(2.0**64)).otherwise(F.lit(0.0))) / F.lit(2.0**64)
    cuts = F.try_element_at("cuts", F.col("class"))
    place = F.least(cuts - 1, F.floor(cuts * (1 - F.exp(-F.col("n") * x))).cast("int"))  # the least of n hashes, made uniform
    placed = written(members.join(maps, ["rep", "n"]).select("hub", "rep", "label", "n", "class", "lead", "map", place.alias("place")), "placed")
    sizes = placed.groupBy("hub", "class", "place").agg(F.ceil(F.count(F.lit(1)) / NODE).cast("long").alias("parts"))
    node = F.concat_ws(",", "place", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")))
    return placed.join(written(sizes, "sizes"), ["hub", "class", "place"]).withColumn("node", node).drop("place", "parts")


def _bits_of(n: int) -> int:
    """Length of a bitmap of n shingles."""
    return 1 << min(15, max(8, (2 * n - 1).bit_length()))


def node_pairs(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, class, node, part, side) for both nodes of every pair that may hold links: the tree's uppermost traversal.

    A node is one row: OR of its bitmaps, range of sizes, most shingles that share a bit, range of labels. The bitmaps
    are as long as those of the smallest size of the class, and once more as those of the class below.
    """

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        kind, n, out = int(frame["class"].iloc[0]), frame.n.to_numpy(), []
        for below in (0, 1):
            bits = _bits_of(max(1, math.floor((den / num) ** (kind - below) * (1 - 1e-9))))
            total, extra = np.zeros(bits // 64, np.uint64), 0
            for size, m in zip(n, frame["map"]):
                m = np.asarray(m, np.int64).view(np.uint64)[None]
                while m.shape[1] * 64 > bits:
                    m = folded(m)
                total |= m[0]
                extra = max(extra, int(size) - int(np.bitwise_count(m).sum()))
            out += [total.view(np.int64).tolist(), extra]
        row = (frame.hub.iloc[0], kind, frame.node.iloc[0], int(n.min()), int(n.max()), frame.label.min(), frame.label.max(), *out)
        return pd.DataFrame([row], columns=["hub", "class", "node", "low", "high", "first", "last", "map", "extra", "map_below", "extra_below"])

    kind = nodes.schema["label"].dataType.simpleString()
    schema = f"hub {nodes.schema['hub'].dataType.simpleString()}, class int, node string, low long, high long, first {kind}, last {kind}, map array<long>, extra long, map_below array<long>, extra_below long"
    sums = written(nodes.groupBy("hub", "class", "node").applyInPandas(summed, schema), "node-sums")
    a = sums.select("hub", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("b_class"), F.struct("class", "node", "low", "high", "first", "last", "map", "extra").alias("a"))
    b = sums.select("hub", F.col("class").alias("b_class"), F.struct("class", "node", "low", "high", "first", "last", "map", "extra", "map_below", "extra_below").alias("b"))
    pairs = a.join(b, ["hub", "b_class"]).filter("a.class < b.class OR a.node <= b.node")
    overlap = "aggregate(zip_with(a.map, IF(a.class = b.class, b.map, b.map_below), (x, y) -> CAST(bit_count(x & y) AS BIGINT)), 0L, (s, x) -> s + x)"
    most = f"{overlap} + least(a.extra, IF(a.class = b.class, b.extra, b.extra_below))"
    left = pairs.filter(
        F.expr(f"{num} * a.low <= {den} * b.high AND {num} * b.low <= {den} * a.high")
        & F.expr("NOT (a.first = a.last AND b.first = b.last AND a.first = b.first)")
        & F.expr(f"(a.class = b.class AND a.node = b.node) OR ({most}) * {num + den} >= {num} * (a.low + b.low)")
    )
    part = F.concat_ws("|", "a.class", "a.node", "b.class", "b.node").alias("part")
    both = left.select("hub", part, F.array(F.struct("a.class", "a.node", F.lit(0).alias("side")), F.struct("b.class", "b.node", F.lit(1).alias("side"))).alias("nodes"))
    return both.select("hub", "part", F.explode(F.array_distinct(F.expr("IF(nodes[0].class = nodes[1].class AND nodes[0].node = nodes[1].node, slice(nodes, 1, 1), nodes)"))).alias("x")).select("hub", "part", "x.*")


def pair_candidates(members: DataFrame, maps: DataFrame, num: int, den: int, bundles: int) -> DataFrame:
    """Distinct pairs (u, v) of members, not linked yet, that their block's tree against itself lets through."""
    members = written(members, "open-members")
    small = members.filter(F.col("block_n") <= NODE).join(maps, ["rep", "n"]).select("hub", "rep", "label", F.lit("").alias("part"), F.lit(0).alias("side"), "n", "lead", "map", F.lit(1).alias("cuts"))
    # a larger block: its nodes in pairs
    nodes = written(node_members(members.filter(F.col("block_n") > NODE), maps), "nodes")
    pairs = written(node_pairs(nodes, num, den), "node-pairs")
    large = nodes.join(pairs, ["hub", "class", "node"]).select("hub", "rep", "label", "part", "side", "n", "lead", "map", F.lit(2).alias("cuts"))
    dealt = small.union(large).withColumn("task", _task("cuts", "part", bundles))

    def traverse(frame: pd.DataFrame) -> pd.DataFrame:
        out: set = set()
        for _, block in frame.groupby(["hub", "part"], sort=False):
            reps, labels = block.rep.tolist(), block.label.tolist()
            if len(set(labels)) > 1:
                for at, tree in _trees(block, labels, block.side.to_numpy(), num, den):
                    out.update(tuple(sorted((reps[at[a]], reps[at[b]]))) for a, b in tree.pairs(num, den))
        return pd.DataFrame(sorted(out), columns=["u", "v"])

    kind = members.schema["rep"].dataType.simpleString()
    return dealt.groupBy("task").applyInPandas(traverse, f"u {kind}, v {kind}").distinct()


def _task(cuts: str, part: str, bundles: int):
    """Small blocks share so many tasks; a part of a large block is a task of its own."""
    return F.when(F.col(cuts) == 1, F.pmod(F.xxhash64("hub"), F.lit(bundles))).otherwise(F.xxhash64("hub", part))


def _trees(block: pd.DataFrame, labels: list, side: np.ndarray, num: int, den: int):
    maps = [np.asarray(m, np.int64).view(np.uint64) for m in block["map"]]
    return trees_of(block.n.to_numpy(), block.lead.to_numpy(), maps, labels, side, num, den)


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose whole sets link."""
    pairs = written(pairs, "pairs")
    needed = pairs.select(F.col("u").alias("needed")).union(pairs.select("v")).distinct()
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    own = docs.join(needed, F.col(id_col) == F.col("needed"), "left_semi")
    sets = written(shingled_docs(own, id_col, text_col, k), "sets")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    common = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("total"))
    return written(common.filter(F.expr(f"{den} * common >= {num} * (total - common)")).select("u", "v").distinct(), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id; two sets link when den * |both| >= num * |either|."""
    docs = docs.select(id_col, text_col)
    hot = frequent_shingles(docs, id_col, text_col, k)
    signed = written(signatures(docs, id_col, text_col, k, num, den, hot), "signatures")
    which = ["n", "c1", "c2"]
    sets = signed.filter("n > 0 AND id IS NOT NULL").select("id", *which)
    classes = written(sets.groupBy(*which).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")), "classes")
    later = sets.join(classes.filter("c > 1").select(*which, "rep"), which).filter("id <> rep").select("id", *which).distinct()
    if later.count() <= BROADCAST_ROWS:
        later = F.broadcast(later)

    def reps_of(rows: DataFrame) -> DataFrame:
        return rows.filter("n > 0 AND id IS NOT NULL").join(later, ["id", *which], "left_anti").withColumnRenamed("id", "rep")

    maps = reps_of(signed).select("rep", "n", "lead", "map")
    # an identifier with several sets joins their classes
    several = sets.groupBy("id").agg(F.min(F.struct(*which)).alias("a"), F.max(F.struct(*which)).alias("b")).filter("a <> b").select("id")
    through = written(sets.join(several, "id", "left_semi").join(classes, which).filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct(), "through")
    members = written(block_members(*prefix_groups(docs, signed, reps_of, hot, id_col, text_col, k, num, den)), "members")
    bundles = max(16, members.count() // BUNDLE)
    first = verified(hub_candidates(members, maps, num, den, bundles), docs, id_col, text_col, k, num, den).union(through)
    second = verified(pair_candidates(in_reach(members, connected_components(first), num, den), maps, num, den, bundles), docs, id_col, text_col, k, num, den)
    names = connected_components(first.union(second))
    named = classes.join(names, F.col("rep") == F.col("node"), "left").select(*which, F.coalesce("component", "rep").alias("component_id"))
    return signed.join(named, which, "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the smallest identifier, with all its columns.

    Texts without words and rows without an identifier stay; so do all rows of the identifier that stays.
    """
    groups = jaccard_components(docs.select(id_col, text_col), id_col, text_col, k, num, den)
    (gone,) = free_name(docs, "gone")
    drop = groups.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(gone)).distinct()
    if drop.count() <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    return docs.join(drop, F.col(id_col) == F.col(gone), "left_anti")
