"""Substring dedup with compact windows.

A text is the sequence of its shingles of K words (A-Z folded). For each of HASHES hash functions the
Cartesian tree over the shingles' hashes gives the compact windows: (l, c, r) stands for all
subsequences within [l, r] that hold c, whose min-hash all is that of c. Only nodes that span WORDS
words are kept, two for every WORDS words of text; a sliding minimum finds them and the tree over
them alone gives their spans. Windows of different documents with equal min-hashes meet under the
group's first document, its hub, so a group of any size costs one link for each member. For each
document and hub an interval join collects the aligned windows; where ENOUGH hash functions agree the
stretches are cut from both texts, trimmed to the part that matches, and compared in full: a passage
has at least WORDS words and its shingle set a Jaccard similarity of at least SIMILARITY.

A window over which its hub gave no passage is open, as is its whole group (of the first OPEN hash
functions): there the hub may share too little of what others share. Open groups meet once more under
the first documents that also agree on what stands a little after or before, and, for the first
function, under the first document of every run of WORDS words through the window: all equal passages
share such a run, so none is lost, and a group costs at most one link for each run of its members.
Exact copies of a whole text are joined by the text first and appear with their whole text.

One row per passage: id, start_word, n_words, rep_id, rep_start_word, similarity; the hub's own
passages are rows too (rep_id = id). Documents without a repeated passage have no row. Null, empty and
shorter texts have no passage. A passage that only repeats within one document is none. Rows that
share an identifier are one document. Of equal documents and places the smallest is the hub. Texts of
any length are read whole; an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from civicframe.llm.common import BROADCAST_ROWS, WORD, table, written
from civicframe.llm.shingles import by_bytes, mix, shingled, word_hashes

K, WORDS, HASHES, ENOUGH, OPEN, SIMILARITY = 5, 50, 4, 2, 2, 0.8
#: Shingles of WORDS words, and the multiple to which the stretches that are asked for are widened.
LEAST, STEP = WORDS - K + 1, 32
#: Shingles by which the context of an open window is away from it.
AWAY = 11
#: Candidates of two stretches that are compared one by one.
TRIES = 40
#: Weight of a mismatch when a passage must have none.
STRICT = 1 << 40
#: Offsets between two texts that count as one alignment.
BAND = 64
_SALTS = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64)) for i in range(HASHES)]


def minima(hashes: np.ndarray, bounds: np.ndarray, width: int, bits: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values in order of size, end of each place's text, places that are smallest among some width places of a text).

    Each of these places has a compact window of at least width places, and no other has. Of equal hashes the first counts
    as smaller; hashes that differ in their last bits alone (as many as places need, bits at least) count as equal.
    """
    n = len(hashes)
    places = np.uint64((1 << max(bits, n.bit_length())) - 1)
    low = (hashes & ~places) | np.arange(n, dtype=np.uint64)
    text_end = np.repeat(bounds[1:], np.diff(bounds))
    if n < width:
        return low, text_end, np.zeros(0, np.int64)
    size, least = 1, low
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: n - width + 1], least[width - size : n - size + 1])
    least = least[: n - width + 1]
    whole = np.arange(n - width + 1) + width <= text_end[: n - width + 1]
    return low, text_end, np.unique((least[whole] & places).astype(np.int64))


def compact_windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least width places; bounds are the offsets of the texts."""
    low, text_end, at = minima(hashes, bounds, width)
    if not len(at):
        return at, at, at
    ends = text_end[at]
    starts = np.repeat(bounds[:-1], np.diff(bounds))[at]
    left, right = starts.copy(), ends - 1
    stack: list[int] = []
    value, where, first = low[at].tolist(), at.tolist(), starts.tolist()
    text = -1
    for i, v in enumerate(value):
        if first[i] != text:
            text = first[i]
            stack.clear()
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = where[i] - 1
        if stack:
            left[i] = where[stack[-1]] + 1
        stack.append(i)
    return left, at, right


def _sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts in order and the offsets of each text's (texts of fewer than K words have none)."""
    words, at = word_hashes(texts)
    grams = shingled(words, K)
    sizes = np.maximum(np.diff(at) - K + 1, 0)
    ends = np.cumsum(np.append(0, sizes))
    places = np.repeat(at[:-1] - ends[:-1], sizes) + np.arange(ends[-1])
    return grams[places], ends


def window_rows(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> id, key (min-hash of one of the functions), fn, l, c, r in shingle places of the text, and the shingles AWAY on and back."""
    kind = docs.schema["id"].dataType.simpleString()
    fields = f"id {kind}, key long, fn byte, l int, c int, r int, after int, before int"

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole, 1):
                grams, bounds = _sequences(b.column(1))
                for fn in range(HASHES):
                    h = mix(grams ^ _SALTS[fn])
                    left, c, right = compact_windows(h, bounds, LEAST)
                    of = np.searchsorted(bounds, c, "right") - 1
                    begin, end = bounds[of], bounds[of + 1] - 1
                    columns = [b.column(0).take(pa.array(of)), pa.array(h[c].view(np.int64)), pa.array(np.full(len(c), fn, np.int8))]
                    columns += [pa.array((x - begin).astype(np.int32)) for x in (left, c, right)]
                    columns += [pa.array(_short(grams[x])) for x in (np.minimum(c + AWAY, end), np.maximum(c - AWAY, begin))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "key", "fn", "l", "c", "r", "after", "before"])

    return docs.mapInArrow(run, fields)


def _short(grams: np.ndarray) -> np.ndarray:
    """32 bits of each shingle."""
    return (grams >> np.uint64(32)).astype(np.uint32).view(np.int32)


def hubs_of(windows: DataFrame, *by: str) -> DataFrame:
    """by, h (id, l, c, r of the first document) of the groups of several documents."""
    first = windows.groupBy(*by).agg(F.min(F.struct("id", "l", "c", "r")).alias("h"), F.max("id").alias("high"))
    return written(first.filter("h.id <> high").drop("high"), "firsts")


def shared_windows(docs: DataFrame) -> DataFrame:
    """The windows whose min-hash several documents have, with h, that of the first of these."""
    # both sides of the join are a plain shuffle and a table, so that AQE can split a key that many documents share
    # (a hash join: its build side has one row for each key)
    hubs = hubs_of(window_rows(docs).select("id", "key", "l", "c", "r"), "key")
    return written(window_rows(docs).join(hubs.hint("shuffle_hash"), "key"), "windows")


def spans_of(linked: DataFrame, enough: int) -> DataFrame:
    """Linked windows (id, fn, l, c, r, h) -> (id, hub, begin, end, hub_begin, hub_end): stretches of two documents on which enough functions agree."""
    back, on = F.least(F.col("c") - F.col("l"), F.expr("h.c - h.l")), F.least(F.col("r") - F.col("c"), F.expr("h.r - h.c"))
    places = linked.select(
        "id", F.col("h.id").alias("hub"), F.floor((F.col("c") - F.col("h.c")) / BAND).cast("int").alias("band"), F.expr("shiftleft(1, fn)").alias("functions"),
        (F.col("c") - back).alias("begin"), (F.col("c") + on).alias("end"), (F.col("h.c") - back).alias("hub_begin"), (F.col("h.c") + on).alias("hub_end"),
    )

    def together(rows: DataFrame) -> DataFrame:
        ends = (F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("hub_begin").alias("hub_begin"), F.max("hub_end").alias("hub_end"))
        return rows.groupBy("id", "hub", "band").agg(F.bit_or("functions").alias("functions"), *ends)

    # an alignment may lie on the border of two bands
    found = together(together(places).withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))))
    return found.filter((F.bit_count("functions") >= enough) & (F.col("end") - F.col("begin") + 1 >= LEAST)).select("id", "hub", "begin", "end", "hub_begin", "hub_end").distinct()


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (id, text) whose id is in the column id of ids, so that a later join moves these texts alone."""
    ids = ids.select("id").distinct()
    return docs.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= BROADCAST_ROWS else docs


def stretches(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct asked (id, begin, end) -> (id, begin, end, shingles): the stretches' shingles, as 32 bits each."""
    kind = docs.schema["id"].dataType.simpleString()
    wanted = asked.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("asked"))
    rows = only(docs, asked).join(wanted.hint("shuffle_hash"), "id").select("text", "asked", "id")

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole, 0):
                grams, ends = _sequences(b.column(0))
                small, lists = _short(grams), b.column(1)
                of = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                begin, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                first = np.minimum(ends[of] + begin, ends[of + 1])
                sizes = np.maximum(np.minimum(ends[of] + end, ends[of + 1]) - first, 0)
                for a, z in _runs_of(sizes, 1 << 20):
                    offsets = np.cumsum(np.append(0, sizes[a:z])).astype(np.int32)
                    parts = [small[x : x + n] for x, n in zip(first[a:z], sizes[a:z])]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(2).take(pa.array(of[a:z])), pa.array(begin[a:z].astype(np.int32)), pa.array(end[a:z].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))],
                        ["id", "begin", "end", "shingles"],
                    )

    return rows.mapInArrow(run, f"id {kind}, begin int, end int, shingles array<int>")


def _runs_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of elements whose sizes sum up to about so many."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def compared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (id, hub, begin, end, hub_begin, hub_end) -> passages: id, start_word, n_words, rep_id, rep_start_word, rep_n_words, similarity.

    Stretches are asked for with a margin, as a window may end short of the passage, and in steps, so that those of a
    hub are few and each is cut once, however many documents meet there.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def widened(begin: str, end: str) -> tuple:
        return F.greatest(F.lit(0), F.floor((F.col(begin) - WORDS) / STEP) * STEP).cast("int"), (F.ceil((F.col(end) + WORDS + 1) / STEP) * STEP).cast("int")

    (a0, a1), (b0, b1) = widened("begin", "end"), widened("hub_begin", "hub_end")
    pairs = written(pairs.select("id", a0.alias("a0"), a1.alias("a1"), "hub", b0.alias("b0"), b1.alias("b1")).distinct(), "alignments")
    asked = pairs.select("id", F.col("a0").alias("begin"), F.col("a1").alias("end")).union(pairs.select("hub", "b0", "b1")).distinct()
    parts = written(stretches(docs, written(asked, "asked")), "stretches")
    own = parts.select("id", F.col("begin").alias("a0"), F.col("end").alias("a1"), F.col("shingles").alias("a"))
    hubs = parts.select(F.col("id").alias("hub"), F.col("begin").alias("b0"), F.col("end").alias("b1"), F.col("shingles").alias("b"))
    both = pairs.join(own.hint("shuffle_hash"), ["id", "a0", "a1"]).join(hubs.hint("shuffle_hash"), ["hub", "b0", "b1"]).select("id", "hub", "a0", "a", "b0", "b")

    def compare(batches):
        for batch in batches:
            a, b = batch.column(3), batch.column(5)
            at, bt = a.offsets.to_numpy(), b.offsets.to_numpy()
            av, bv = a.values.to_numpy(), b.values.to_numpy()
            begins, hub_begins = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            who, out = [], []
            for i in range(batch.num_rows):
                for x, y, u, v, s in matching_parts(av[at[i] : at[i + 1]], bv[bt[i] : bt[i + 1]]):
                    who.append(i)
                    out.append((begins[i] + x, y - x + K - 1, hub_begins[i] + u, v - u + K - 1, s))
            who = pa.array(who, pa.int64())
            n = [pa.array([r[j] for r in out], pa.int64()) for j in range(4)]
            columns = [batch.column(0).take(who), n[0], n[1], batch.column(1).take(who), n[2], n[3], pa.array([r[4] for r in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start_word", "n_words", "rep_id", "rep_start_word", "rep_n_words", "similarity"])

    schema = f"id {kind}, start_word long, n_words long, rep_id {kind}, rep_start_word long, rep_n_words long, similarity double"
    return written(both.mapInArrow(compare, schema), "passages")


def open_pairs(docs: DataFrame, shared: DataFrame, found: DataFrame) -> DataFrame:
    """Stretches that windows share in groups whose hub gave no passage over one of them."""
    covered = found.select(F.col("id").alias("f_id"), F.col("rep_id").alias("f_hub"), F.col("start_word").alias("f_begin"), (F.col("start_word") + F.col("n_words") - K).alias("f_end"))
    some = shared.filter(F.col("fn") < OPEN).withColumn("hub", F.col("h.id")).drop("h")
    left = some.filter("id <> hub").select("key", "hub", "id", "c").join(covered, (F.col("id") == F.col("f_id")) & (F.col("hub") == F.col("f_hub")) & F.col("c").between(F.col("f_begin"), F.col("f_end")), "left_anti")
    keys = written(left.select("key").distinct(), "open-keys")
    windows = written(some.join(keys.hint("shuffle_hash"), "key", "left_semi"), "open")
    near = None
    for by in ("after", "before"):
        # the group's first document has been compared
        linked = windows.join(hubs_of(windows, "key", by).hint("shuffle_hash"), ["key", by]).filter("id <> h.id AND h.id <> hub").select("id", "fn", "l", "c", "r", "h")
        near = linked if near is None else near.union(linked)
    return spans_of(near.distinct(), 1).union(run_pairs(docs, windows.filter("fn = 0"), covered))


def run_pairs(docs: DataFrame, windows: DataFrame, covered: DataFrame) -> DataFrame:
    """(id, hub, begin, end, hub_begin, hub_end): runs of WORDS words through the windows that documents share with the run's first document."""
    kind = docs.schema["id"].dataType.simpleString()
    asked = written(windows.groupBy("id").agg(F.collect_list(F.struct("l", "c", "r")).alias("windows")), "run-windows")
    rows = only(docs, asked).join(asked.hint("shuffle_hash"), "id").select("text", "windows", "id")

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole, 0):
                grams, ends = _sequences(b.column(0))
                keys = _run_keys(grams)
                lists = b.column(1)
                of = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                left, c, right = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                first, last = ends[of] + np.maximum(left, c - LEAST + 1), ends[of] + np.minimum(c, right - LEAST + 1)
                n = np.maximum(last - first + 1, 0)
                at = np.unique(np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
                own = np.searchsorted(ends, at, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(own)), pa.array(keys[at].view(np.int64)), pa.array((at - ends[own]).astype(np.int32))], ["id", "run", "at"])

    runs = written(rows.mapInArrow(run, f"id {kind}, run long, at int"), "runs")
    firsts = runs.groupBy("run").agg(F.min(F.struct("id", "at")).alias("h"), F.max("id").alias("high")).filter("h.id <> high").drop("high")
    linked = runs.join(written(firsts, "run-firsts").hint("shuffle_hash"), "run").filter("id <> h.id").select("id", "at", F.col("h.id").alias("hub"), F.col("h.at").alias("hub_at"))
    new = linked.join(covered, (F.col("id") == F.col("f_id")) & (F.col("hub") == F.col("f_hub")) & (F.col("at") >= F.col("f_begin")) & (F.col("at") + (LEAST - 1) <= F.col("f_end")), "left_anti")
    return new.groupBy("id", "hub", (F.col("at") - F.col("hub_at")).alias("offset")).agg(F.min("at").alias("begin"), (F.max("at") + LEAST - 1).alias("end"), F.min("hub_at").alias("hub_begin"), (F.max("hub_at") + LEAST - 1).alias("hub_end")).select("id", "hub", "begin", "end", "hub_begin", "hub_end")


def _run_keys(grams: np.ndarray) -> np.ndarray:
    """Hash of the LEAST shingles from each place on (places within LEAST of the end have none of use)."""
    n, size, key = len(grams), 1, grams
    while size * 2 <= LEAST:
        key = mix(key[: max(0, len(key) - size)] * np.uint64(3) + key[size:])
        size *= 2
    if size < LEAST:
        key = mix(key[: max(0, n - LEAST + 1)] * np.uint64(5) + key[LEAST - size : max(LEAST - size, n - size + 1)])
    return key


def matching_parts(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(begin and end in a, begin and end in b, similarity) of the parts of two stretches that match."""
    here = _within(a, b)
    most = np.flatnonzero(here)
    if len(most) < SIMILARITY * LEAST:
        return []
    x, y = int(most[0]), int(most[-1]) + 1
    if y - x == len(most) >= LEAST:  # one run, often the same in both
        for u in np.flatnonzero(b == a[x]).tolist():
            if u + y - x <= len(b) and (b[u : u + y - x] == a[x:y]).all():
                return [(x, y, u, u + y - x, 1.0)]
    out = _bridged(a, b, here)
    # what matches without an order, left and right of them
    ends = [0, *[e for part in out for e in part[:2]], len(a)]
    spans = [(lo, hi, 8) for lo, hi in zip(ends[::2], ends[1::2])]
    while spans:
        lo, hi, weight = spans.pop()
        if hi - lo < LEAST or here[lo:hi].sum() < SIMILARITY * LEAST:
            continue
        got = _densest(here[lo:hi], weight)
        if got is None:
            continue
        x, y = lo + got[0], lo + got[1]
        spans += [(lo, x, weight), (y, hi, weight)]
        if y - x < LEAST:
            continue
        other = _densest(_within(b, a[x:y]), weight)
        similarity = 0.0
        if other is not None and other[1] - other[0] >= LEAST:
            similarity = _similarity(a[x:y], b[other[0] : other[1]])
        if similarity >= SIMILARITY:
            out.append((x, y, *other, similarity))
        elif weight < STRICT:  # no passage as a whole; runs without any difference within it may be
            spans.append((x, y, STRICT))
    return out


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    one, two = set(a.tolist()), set(b.tolist())
    common = len(one & two)
    return common / (len(one) + len(two) - common)


def _runs(a: np.ndarray, b: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins in a, begins in b, lengths) of the heaviest chain of runs that match in one order. Of several equal places in b the one nearest to the commonest offset counts."""
    at = np.flatnonzero(here)
    values, rank = np.unique(b, return_inverse=True)
    order = np.sort(rank.astype(np.int64) * (len(b) + 1) + np.arange(len(b)))
    of = np.searchsorted(values, a[at]) * (len(b) + 1)
    first = order[np.searchsorted(order, of)] - of
    offsets, times = np.unique(first - at, return_counts=True)
    aim = np.clip(at + offsets[times.argmax()], 0, len(b) - 1)
    k = np.searchsorted(order, of + aim)
    up, down = order[np.minimum(k, len(order) - 1)] - of, order[np.maximum(k - 1, 0)] - of
    far = len(b) + 1
    up_by, down_by = (np.where((x >= 0) & (x < far - 1), np.abs(x - aim), far) for x in (up, down))
    place = np.where(up_by <= down_by, up, down)
    new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(place) != 1)))
    x, u, n = at[new], place[new], np.diff(np.append(new, len(at)))
    if len(x) > 1 and (u[1:] < (u + n)[:-1]).any():
        chain = _heaviest(u.tolist(), n.tolist())
        x, u, n = x[chain], u[chain], n[chain]
    return x, u, n


def _heaviest(begins: list[int], sizes: list[int]) -> list[int]:
    """The chain of runs, in their order, of which each begins where or after the one before ends, with the largest sum of sizes."""
    ends, weights, last, came = [], [], [], [-1] * len(begins)  # of the best chains by where they end, weights rising
    for i, (u, n) in enumerate(zip(begins, sizes)):
        at = bisect_right(ends, u) - 1
        if at >= 0:
            came[i] = last[at]
        weight, to = (weights[at] if at >= 0 else 0) + n, bisect_right(ends, u + n)
        if to and weights[to - 1] >= weight:
            continue
        if to and ends[to - 1] == u + n:
            to -= 1
        stop = to
        while stop < len(ends) and weights[stop] <= weight:
            stop += 1
        ends[to:stop], weights[to:stop], last[to:stop] = [u + n], [weight], [i]
    chain, i = [], last[-1]
    while i >= 0:
        chain.append(i)
        i = came[i]
    return chain[::-1]


def _bridged(a: np.ndarray, b: np.ndarray, here: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """The longest similar part from the begin of a run to the end of one, then those left and right of it, in order."""
    x, u, n = _runs(a, b, here)
    y, v = x + n, u + n
    if y[-1] - x[0] >= LEAST and v[-1] - u[0] >= LEAST and (whole := _similarity(a[x[0] : y[-1]], b[u[0] : v[-1]])) >= SIMILARITY:
        return [(int(x[0]), int(y[-1]), int(u[0]), int(v[-1]), whole)]
    if len(x) == 1:
        return []
    # from all candidates that may be similar (by what is common at most and differs at least) the longest first
    hits, mine, theirs = (np.append(0, np.cumsum(c)) for c in (here, _firsts(a), _firsts(b)))
    lengths, left, right = [], [], []
    for p in range(len(x)):
        common = hits[y[p:]] - hits[x[p]]
        able = SIMILARITY * (np.maximum(mine[y[p:]] - mine[x[p]], common) + np.maximum(theirs[v[p:]] - theirs[u[p]], common) - common) <= common
        q = np.flatnonzero(able & (y[p:] - x[p] >= LEAST) & (v[p:] - u[p] >= LEAST)) + p
        lengths.append(y[q] - x[p])
        left.append(np.full(len(q), p))
        right.append(q)
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((right, left, -np.concatenate(lengths)))
    left, right = left[order], right[order]
    taken, failed, at = [], 0, 0
    while at < len(left):
        p, q = int(left[at]), int(right[at])
        similarity = _similarity(a[x[p] : y[q]], b[u[p] : v[q]])
        at += 1
        if similarity >= SIMILARITY:
            taken.append((p, q, similarity))
            apart = (right[at:] < p) | (left[at:] > q)
            left, right, at = left[at:][apart], right[at:][apart], 0
        else:
            failed += 1
            if failed == TRIES:  # many repetitions: those of one begin together
                sure = _sure(a, b, x, y, u, v, left[at:], right[at:])
                left, right, at = left[at:][sure], right[at:][sure], 0
    return [(int(x[p]), int(y[q]), int(u[p]), int(v[q]), s) for p, q, s in sorted(taken)]


def _firsts(a: np.ndarray) -> np.ndarray:
    """Which elements are there for the first time."""
    first = np.zeros(len(a), bool)
    first[np.unique(a, return_index=True)[1]] = True
    return first


def _sure(a, b, x, y, u, v, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which candidates are similar."""
    sure = np.zeros(len(left), bool)
    for p in np.unique(left).tolist():
        of = np.flatnonzero(left == p)
        of = of[np.argsort(right[of])]
        q = right[of]
        sure[of] = _similarities(a[x[p] : y[q[-1]]], b[u[p] : v[q[-1]]], y[q] - x[p], v[q] - u[p]) >= SIMILARITY
    return sure


def _similarities(a: np.ndarray, b: np.ndarray, ends: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the sets a[:end], b[:other end] for all (rising) pairs of ends."""
    one, i = np.unique(a, return_index=True)
    two, j = np.unique(b, return_index=True)
    _, at, other = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    since = np.maximum(np.searchsorted(ends, i[at], "right"), np.searchsorted(other_ends, j[other], "right"))
    common = np.cumsum(np.bincount(since, minlength=len(ends))[: len(ends)])
    return common / (np.searchsorted(np.sort(i), ends) + np.searchsorted(np.sort(j), other_ends) - common)


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of a are in b."""
    return np.fromiter(map(set(b.tolist()).__contains__, a.tolist()), bool, len(a))


def _densest(match: np.ndarray, weight: int) -> tuple[int, int] | None:
    """The part with the largest surplus of matches over mismatches, of which one outweighs weight matches."""
    total = np.cumsum(np.where(match, 1, -weight))
    before = np.append(0, total[:-1])
    least = np.minimum.accumulate(before)
    surplus = total - least
    end = int(surplus.argmax())
    if surplus[end] <= 0:
        return None
    return int(np.flatnonzero(before[: end + 1] == least[end])[-1]), end + 1


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage that repeats in another document, see the module's text."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    keys = written(docs.select("id", F.sha2("text", 256).alias("sha")), "keys")
    firsts = written(keys.groupBy("sha").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("c")).filter("c > 1").drop("c"), "firsts")
    few = firsts.select("rep")
    if few.count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    long = docs.join(few, F.col("id") == F.col("rep")).select("rep", F.regexp_count("text", F.lit(WORD)).alias("n")).filter(F.col("n") >= WORDS)
    copies = written(keys.distinct().join(firsts, "sha").join(long.groupBy("rep").agg(F.max("n").alias("n")), "rep").select("id", "rep", "n"), "copies")
    later = copies.filter("id <> rep").select(F.col("id").alias("later")).distinct()
    if later.count() <= BROADCAST_ROWS:
        later = F.broadcast(later)
    single = docs.join(later, F.col("id") == F.col("later"), "left_anti")
    shared = shared_windows(single)
    found = compared(single, spans_of(shared.filter("id <> h.id"), ENOUGH))
    found = found.union(compared(single, open_pairs(single, shared, found)))
    zero = F.lit(0).cast("long")
    whole = copies.select("id", zero.alias("start_word"), F.col("n").cast("long").alias("n_words"), F.col("rep").alias("rep_id"), zero.alias("rep_start_word"), F.lit(1.0).alias("similarity"))
    own = found.select(F.col("rep_id").alias("id"), F.col("rep_start_word").alias("start_word"), F.col("rep_n_words").alias("n_words"), "rep_id", "rep_start_word", F.lit(1.0).alias("similarity"))
    rows = found.drop("rep_n_words").union(own).union(whole)
    by = ["id", "start_word", "n_words", "rep_id", "rep_start_word"]
    return rows.groupBy(*by).agg(F.max("similarity").alias("similarity")).withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
