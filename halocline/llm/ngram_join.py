"""N-gram Jaccard join by a count-vector R-tree.

A document is its set of distinct shingles. Hashing shingles into groups gives a point: how many of the set fall into
each group. Two sets share at most the sum, over groups, of the smaller count, and what a set shares with any set below
a tree node is bounded likewise by the node's largest counts; sets whose bound reaches what the threshold asks for are
verified shingle by shingle. Pairs that links found already connect need no verifying.

Which sets meet in a tree:

1. Documents of equal sets become one: the 64-bit hash of a whole set is its name from here on.
2. Any order of shingles serves a prefix filter: two sets within the threshold t share one of the n - ceil(t n) + 1
   first of each. With the rarest first, a set of so many shingles that no other set has is linked with none, which
   settles most documents. Shingles are counted over all sets for this: tasks send sorted blocks of (first bits of the
   shingle, place of its set in the block) to ranges of the hash, each of a bounded number of entries, and of a range
   only the places of shingles that stand there once go back to their block, which adds them up. Steps from shingle to
   shingle and places take about 5 bytes an entry together, however many ranges there are. Where bits or equal sets
   of two blocks hide that a shingle is a set's own, the set is left, and the next steps, which are exact, settle it.
3. The sets left are counted once more among themselves, and each is listed under the first of its shingles that others
   have too. Documents that share a common passage but no more are not listed together. This loses no pair. Listings
   are combined before they are shuffled, so a key that very many sets have sends one row from each task, and a star
   of edges stands for the sets listed together.
4. Sets listed together form clusters (connected components, a superset of the linked ones). A cluster is cut into
   pages of a bounded number of shingles; small clusters share a page. Each page, with some pivots
   from its whole cluster, is one tree. As copies of one text link to a pivot, links within pages nearly always join
   what pages hold apart.
5. In clusters of several pages, sets that are still outside their cluster's main component meet, page by page, the
   sets of other components that are listed under a key of theirs, so no link is lost, whatever the cluster looks like.

Cases: null and empty texts and texts of white space have an empty set and are linked with nothing. Texts of fewer
words than a shingle have one of the whole sequence. Rows that repeat an id are one document if their sets agree; if
they don't, ``join`` links them through the id (``classes`` does not). An empty set's component is its own id. Rows
without an id have n_shingles but no component in ``join``. Very long texts are read whole; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import discard, lean, slices, table, written
from .components import components


@dataclass(frozen=True)
class JoinParameters:
    words: int = 5
    percent: int = 80  # of the union that the intersection must reach
    page_shingles: int = 1_000_000
    pivots: int = 24
    fan_out: int = 16
    range_entries: int = 3_000_000  # entries of sets that a task counts shingles of at once
    block_entries: int = 1_000_000  # entries that a task sorts into blocks at once
    filter_bits: int = 26  # logarithm of the size of the filter that spares a shuffle of settled documents' texts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    count = max(1, len(h) - n + 1)
    with np.errstate(over="ignore"):
        total = np.full(count, min(n, len(h)), np.uint64)
        for k in range(min(n, len(h))):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + count])
    return np.unique(total)


def name_of(s: np.ndarray) -> int:
    """The name of a set: 64 bits of a hash of its shingles."""
    return int.from_bytes(blake2b(s, digest_size=8).digest(), "little", signed=True)


def needed(a, b, percent: int):
    """Shingles that sets of sizes a and b share at least, if they are linked."""
    return -(-(a + b) * percent // (100 + percent))


def packed_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of points in which near ones are neighbours: cut in halves along the coordinate that varies most."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        own = points[rows]
        varies = np.einsum("ij,ij->j", own, own, dtype=np.float64) / len(own) - (own.sum(0) / len(own)) ** 2
        rows = rows[np.argsort(own[:, varies.argmax()], kind="stable")]
        half = -(-len(rows) // (2 * leaf)) * leaf
        todo += [rows[half:], rows[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class CountTree:
    """An R-tree over group counts, packed so that near points share nodes; levels hold nodes' largest counts and sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan_out: int):
        self.fan_out, self.order = fan_out, packed_order(points, fan_out)
        points, sizes = points[self.order], sizes[self.order]
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > fan_out:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), fan_out)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def candidates(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose bound on the shared shingles is as large as needed."""
        top = self.levels[-1]
        alive = np.arange(len(top[0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            counts, low, high = self.levels[depth]
            fits = (100 * high[alive] >= percent * size) & (100 * size >= percent * low[alive])
            alive = alive[fits]
            bound = np.minimum(counts[alive], point).sum(1, dtype=np.int64)
            alive = alive[bound >= needed(low[alive], size, percent)]
            if depth:
                alive = (alive[:, None] * self.fan_out + np.arange(self.fan_out)).ravel()
                alive = alive[alive < len(self.levels[depth - 1][0])]
        return self.order[alive]


def linked(sets: list[np.ndarray], group: np.ndarray, labels: np.ndarray, asking: np.ndarray, p: JoinParameters) -> list[tuple[int, int]]:
    """Links (pairs of places) that, with the labels given, connect all linked sets of one group.

    asking: places that are compared with all others of their group. Others are not compared with one another.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    order = np.lexsort((np.array([len(s) for s in sets]), group))
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    for own in np.split(order, cuts):
        sizes = np.array([len(sets[i]) for i in own])
        if len(own) < 2 or not asking[own].any():
            continue
        width = 1 << min(12, max(4, int(sizes.max() // 8).bit_length()))
        points = np.zeros((len(own), width), np.int32)
        for row, i in enumerate(own):
            points[row] = np.bincount((sets[i] & np.uint64(width - 1)).astype(np.int64), minlength=width)
        tree = CountTree(points, sizes, p.fan_out)
        for row in np.flatnonzero(asking[own]):
            i = own[row]
            for other in tree.candidates(points[row], int(sizes[row]), p.percent):
                j = own[other]
                if j == i or (asking[j] and other > row):  # that pair comes when j asks
                    continue
                a, b = root(int(labels[i])), root(int(labels[j]))
                if a == b:
                    continue
                small, large = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if 100 * shared >= p.percent * (len(small) + len(large) - shared):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(i), int(j)))
    return out


def _signed(docs: DataFrame, p: JoinParameters) -> DataFrame:
    """id, h (the text's hash), n, set: a row for each of docs."""

    def run(batches):
        for part, texts in slices(batches, "text"):
            sets = [shingles(t, p.words) for t in texts]
            columns = [part.column("id"), part.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([name_of(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "n", "set"])

    return docs.mapInArrow(lean(run), "id long, h long, n long, set long")


def _filled(docs: DataFrame, p: JoinParameters, cut, schema: str) -> DataFrame:
    """What cut yields of blocks [(name, set)] of a bounded number of entries and fewer than 65535 distinct sets."""

    def run(batches):
        held, size, seen = [], 0, set()
        for _, texts in slices(batches, "text"):
            for t in texts:
                s = shingles(t, p.words)
                name = name_of(s)
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                held.append((name, s))
                size += len(s)
                if size >= p.block_entries or len(held) == 0xFFFE:
                    yield from cut(held)
                    held, size, seen = [], 0, set()
        if held:
            yield from cut(held)

    return docs.select("text").mapInArrow(lean(run), schema)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest needs, byte by byte, as upper bytes compress; the first byte tells how many."""
    size = max(1, -(-int(x.max()).bit_length() // 8))
    return bytes([size]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unpacked(data: np.ndarray) -> np.ndarray:
    size = int(data[0])
    out = np.zeros(((len(data) - 1) // size, 8), np.uint8)
    out[:, :size] = data[1:].reshape(size, -1).T
    return out.view("<u8").ravel().astype(np.int64)


def _buffers(column: pa.ChunkedArray) -> list[np.ndarray | None]:
    return [None if x.as_buffer() is None else np.frombuffer(x.as_buffer(), np.uint8) for x in column.combine_chunks()]


def _steps(docs: DataFrame, ranges: int, bits: int, p: JoinParameters) -> DataFrame:
    """range, block, entries of that range: the step from one shingle (its first bits) to the next, above shift bits of its set's place in the block.

    A shingle that several of a block's sets have is there once, at a place that no set has. One row of each block has
    the names of its sets. The block's own name comes from theirs, so other rows of a task that ran again don't match it.
    """
    bounds = np.array([-(-(i << bits) // ranges) for i in range(ranges)], np.uint64)

    def cut(held):
        keys = [np.unique(s >> np.uint64(64 - bits)) for _, s in held]
        entries = np.sort(np.concatenate([k << np.uint64(16) | np.uint64(i) for i, k in enumerate(keys)]))
        key, place = entries >> np.uint64(16), entries & np.uint64(0xFFFF)
        place[_several(key)] = len(held)
        first = np.diff(key, prepend=key[0] + np.uint64(1)) != 0
        key, place = key[first], place[first]
        cuts = np.append(np.searchsorted(key, bounds), len(key))
        some = np.flatnonzero(np.diff(cuts))
        step = np.diff(key, prepend=np.uint64(0))
        step[cuts[some]] = key[cuts[some]] - bounds[some]
        shift = len(held).bit_length()
        step = step << np.uint64(shift) | place
        names = np.array([name for name, _ in held], np.int64)
        block = name_of(names)
        told = some[block % len(some)]
        for at in range(0, len(some), 256):
            own = some[at : at + 256]
            columns = [own.astype(np.int32), np.full(len(own), block), np.full(len(own), shift, np.int32), [_packed(step[cuts[r] : cuts[r + 1]]) for r in own], [names.tobytes() if r == told else None for r in own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["range", "block", "shift", "entries", "sets"])

    return _filled(docs, p, cut, "range int, block long, shift int, entries binary, sets binary")


def _own(docs: DataFrame, total: int, p: JoinParameters) -> DataFrame:
    """set, own: how many shingles each set has that no other set has; without a row it has none, or they were not told apart.

    total: how many shingles all the sets of docs have. Of a shingle so many bits count that few of different ones agree
    in them, and a set that stands in several blocks shares all with itself: both make shingles too few, never too many.
    """
    bits = min(48, max(32, int(total).bit_length() + 6))

    def count(_, rows):
        parts = [_unpacked(x) for x in _buffers(rows.column("entries"))]
        shifts = rows.column("shift").to_pylist()
        keys = np.concatenate([np.cumsum(x >> n) for x, n in zip(parts, shifts, strict=True)])
        order = np.argsort(keys)
        alone = np.empty(len(keys), bool)
        alone[order] = ~_several(keys[order])
        alone = np.split(alone, np.cumsum([len(x) for x in parts])[:-1])
        places = [np.sort((x & ((1 << n) - 1))[use]) for x, n, use in zip(parts, shifts, alone, strict=True)]
        own = [_packed(np.diff(x, prepend=0)) if len(x) else None for x in places]
        return pa.table({"block": rows.column("block"), "own": pa.array(own, pa.binary()), "sets": rows.column("sets")})

    def add(_, rows):
        names = next((x.view(np.int64) for x in _buffers(rows.column("sets")) if x is not None), np.zeros(0, np.int64))
        own = np.zeros(len(names) + 1, np.int64)
        for x in _buffers(rows.column("own")):
            if x is not None:
                own += np.bincount(np.minimum(np.cumsum(_unpacked(x)), len(names)), minlength=len(own))
        use = np.flatnonzero(own[:-1])
        return pa.table({"set": names[use], "own": own[use]})

    counted = _steps(docs, _ranges(total, p), bits, p).groupBy("range").applyInArrow(count, "block long, own binary, sets binary")
    return counted.where("own is not null or sets is not null").groupBy("block").applyInArrow(add, "set long, own long")


def _ranges(volume: int, p: JoinParameters) -> int:
    return max(8, math.ceil(volume / p.range_entries))


def _blocks(docs: DataFrame, ranges: int, p: JoinParameters) -> DataFrame:
    """range, and entries (48 bits of a shingle, place of its set) of that range, with the names and sizes of the sets."""
    bounds = np.array([-(-(i << 48) // ranges) << 16 for i in range(1, ranges)], np.uint64)

    def cut(held):
        names = np.array([name for name, _ in held], np.int64)
        sizes = np.array([len(s) for _, s in held], np.uint32)
        keys = [np.unique(s >> np.uint64(16)) << np.uint64(16) for _, s in held]
        entries = np.sort(np.concatenate([k | np.uint64(i) for i, k in enumerate(keys)]))
        kinds = np.array([len(k) for k in keys], np.uint32)
        parts = np.split(entries, np.searchsorted(entries, bounds))
        for at in range(0, ranges, 256):
            rows = []
            for number, own in enumerate(parts[at : at + 256], at):
                if len(own):
                    sets, place = np.unique((own & np.uint64(0xFFFF)).astype(np.int64), return_inverse=True)
                    # byte by byte, as the upper bytes of sorted entries compress
                    key = (own >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()
                    rows.append((number, key, place.astype(np.uint16).tobytes(), names[sets].tobytes(), sizes[sets].tobytes(), kinds[sets].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], names=["range", "keys", "places", "sets", "sizes", "kinds"])

    return _filled(docs, p, cut, "range int, keys binary, places binary, sets binary, sizes binary, kinds binary")


def _several(k: np.ndarray) -> np.ndarray:
    """Of sorted keys, those that stand there more than once."""
    same = k[1:] == k[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(k) else np.zeros(0, bool)


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, names and (size, kinds) of a range's sets, in order of keys and, under one that has several, of names."""
    parts = [x for batch in rows.select(["keys", "places", "sets", "sizes", "kinds"]).to_batches() for x in zip(*(batch.column(c) for c in range(5)), strict=True)]
    places = [np.frombuffer(x[1].as_buffer(), np.uint16) for x in parts]
    ends = np.cumsum([len(p) for p in places])
    keys, sets = np.zeros(ends[-1], np.int64), np.empty(ends[-1], np.int64)
    sizes = np.empty((ends[-1], 2), np.uint32)
    wide = keys.view(np.uint8).reshape(-1, 8)
    for (k, _, names, n, kinds), place, end in zip(parts, places, ends, strict=True):
        at = slice(end - len(place), end)
        wide[at, :6] = np.frombuffer(k.as_buffer(), np.uint8).reshape(6, -1).T
        sets[at] = np.frombuffer(names.as_buffer(), np.int64)[place]
        sizes[at] = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in (n, kinds)], 1)[place]
    order = np.argsort(keys)
    again = np.flatnonzero(_several(keys[order]))
    if len(again):
        part = order[again]
        order[again] = part[np.lexsort((sets[part], keys[part]))]
        k, s = keys[order], sets[order]
        order = order[np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])]  # equal sets of several tasks
    return keys[order], sets[order], sizes[order]


def _shared(blocks: DataFrame) -> DataFrame:
    """set, size, kinds, key, df: the entries whose key several sets have."""

    def count(_, rows):
        keys, sets, sizes = _entries(rows)
        use = _several(keys)
        keys, sets, sizes = keys[use], sets[use], sizes[use].astype(np.int64)
        _, place, df = np.unique(keys, return_inverse=True, return_counts=True)
        return pa.table({"set": sets, "size": sizes[:, 0], "kinds": sizes[:, 1], "key": keys, "df": df[place].astype(np.int64)})

    return blocks.groupBy("range").applyInArrow(count, "set long, size long, kinds long, key long, df long")


def _listed(shared: DataFrame, p: JoinParameters) -> DataFrame:
    """key, set: each set under the keys of its first shingles, the rarest first, that other sets have too."""
    own = shared.groupBy("set", "size", "kinds").agg(F.collect_list(F.struct("df", "key")).alias("k"))  # as many as the set has
    first = F.col("size") - F.ceil(F.col("size") * p.percent / F.lit(100)) + 1
    take = (first - (F.col("kinds") - F.size("k"))).cast("int")
    return own.where(take > 0).select("set", F.explode(F.slice(F.sort_array("k"), 1, F.greatest(take, F.lit(1)))).alias("e")).select("e.key", "set")


def _listed_together(listed: DataFrame) -> DataFrame:
    """Edges a, b that connect all sets that are listed under one key."""

    def combined(keys, ids):
        """One row (key, smallest set) for each key, and edges to it (with a target) from other sets that have it."""
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = ids[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        other = np.unique(np.stack([first[~new], ids[~new]]), axis=1)
        other = other[:, other[0] != other[1]]
        count = int(new.sum())
        spread = _mixed(other.view(np.uint64)).sum(0, dtype=np.uint64).view(np.int64) if other.shape[1] else np.zeros(0, np.int64)
        return pa.RecordBatch.from_pydict({
            "key": np.concatenate([keys[new], spread]),
            "id": np.concatenate([ids[new], other[1]]),
            "to": pa.array(np.concatenate([np.zeros(count, np.int64), other[0]]), mask=np.arange(count + other.shape[1]) < count),
        })

    def combine(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column("key").to_numpy(), batch.column("set").to_numpy()))
            size += batch.num_rows
            if size >= 2_000_000:
                yield combined(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield combined(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def star(batches):
        last, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, to = (batch.column(c) for c in ("key", "id", "to"))
            done = to.is_valid().to_numpy(zero_copy_only=False)
            pairs = [np.stack([to.drop_null().to_numpy(), ids.to_numpy()[done]])]
            k, i = key.to_numpy()[~done], ids.to_numpy()[~done]
            if len(k):
                new = np.concatenate([[last is None or k[0] != last], k[1:] != k[:-1]])
                spot = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
                first = np.where(spot >= 0, i[np.maximum(spot, 0)], head if head is not None else 0)
                last, head = k[-1], first[-1]
                pairs.append(np.stack([first[first != i], i[first != i]]))
            a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    rows = listed.mapInArrow(combine, "key long, id long, to long")
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(lean(star), "a long, b long")


def _paged(members: DataFrame, texts: DataFrame, spread: int, p: JoinParameters) -> DataFrame:
    """Links a, b from pages: members has set, page, bin, label, asks; pages of one bin are handled in one go."""

    def run(pages):
        pages = pages.drop_duplicates(["page", "set"])
        sets = [shingles(t, p.words) for t in pages["text"]]
        group, _ = pd.factorize(pages["page"])
        names = pages["set"].to_numpy()
        labels, _ = pd.factorize(pages["label"])
        pairs = linked(sets, group, labels, pages["asks"].to_numpy(), p)
        return pd.DataFrame({"a": [names[i] for i, _ in pairs], "b": [names[j] for _, j in pairs]}, dtype="int64")

    with_text = members.join(texts, "set").select("bin", "page", "set", "label", "asks", "text")
    return with_text.repartition(int(max(8, min(spread, 20_000))), "bin").groupBy("bin").applyInPandas(run, "a long, b long")


def classes(docs: DataFrame, p: JoinParameters | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h, n, set, root: each row's set and the smallest set that links reach from it (null for empty sets).

    h is xxhash64 of the text; id and h together tell the rows apart, apart from repeated ones. A written table.
    """
    p = p or JoinParameters()
    known, links = _known(docs, p, key, text)
    return written(_rooted(known, components(links)), "rooted")


def _known(docs: DataFrame, p: JoinParameters, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Written tables of rows (id, h, n, set) and of links a, b that connect all sets within the threshold."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    known = written(_signed(rows, p), "signatures")
    none = spark.createDataFrame([], "a long, b long")
    total = known.agg(F.sum("n")).first()[0]
    if not total:
        return known, none
    # where a set's text is to be found: null ids are as good as others
    id_or_none = F.coalesce("id", F.lit(-1 << 63))
    place = F.min(F.struct(id_or_none.alias("id"), "h"))
    of = known.where("n > 0").groupBy("set").agg(F.max("n").alias("n"), place.alias("w")).select("set", "n", "w.id", "w.h")
    own = _own(rows, total, p)
    first = F.col("n") - F.ceil(F.col("n") * p.percent / F.lit(100)) + 1
    left = written(of.join(own, "set", "left").where(F.coalesce("own", F.lit(0)) < first).select("set", "n", "id", "h"), "left")
    volume = left.agg(F.sum("n")).first()[0]
    if not volume:
        return known, none
    wanted = left.select("id", "h", "set")
    texts = _passed(rows.select(id_or_none.alias("id"), "h", "text"), wanted, p).join(wanted, ["id", "h"]).select("set", "text")
    texts = written(texts, "texts")
    listed = written(_listed(_shared(_blocks(texts, _ranges(volume, p), p)), p), "listed")
    clusters = components(_listed_together(listed)).withColumnsRenamed({"node": "set", "component": "cluster"})
    sized = written(clusters.join(left.select("set", "n"), "set"), "clusters")
    links = _links(spark, sized, listed, texts, p)
    discard(left, texts, listed, sized)
    return known, links


def _passed(rows: DataFrame, wanted: DataFrame, p: JoinParameters) -> DataFrame:
    """Of rows (id, h, text), those that wanted (id, h) may have; a join has to follow.

    Bits at hashes of what is wanted, of which the parameters fix the number, are gathered and broadcast, so the texts
    of most documents stay where they are. Where more is wanted than the bits tell apart, more texts pass.
    """
    place = F.xxhash64("id", "h").bitwiseAND((1 << p.filter_bits) - 1)
    set_bits = wanted.select(place.alias("place")).groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(bigint(1), int(place & 63)))").alias("bits"))
    found = set_bits.toArrow()  # a row for each word of the filter at most
    words = np.zeros(1 << max(p.filter_bits - 6, 0), np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        words = shared.value
        for batch in batches:
            at = batch.column("place").to_numpy()
            use = (words[at >> 6] >> (at & 63)) & 1
            if use.any():
                yield batch.filter(pa.array(use.astype(bool))).select(["id", "h", "text"])

    return rows.withColumn("place", place).mapInArrow(lean(run), "id long, h long, text string")


def _rooted(known: DataFrame, found: DataFrame) -> DataFrame:
    """known with root, of found (node, component)."""
    # the large side of a join on a set that very many rows have is split
    out = known.join(found.withColumnsRenamed({"node": "set", "component": "root"}), "set", "left")
    return out.select("id", "h", "n", "set", F.when(F.col("n") > 0, F.coalesce("root", "set")).alias("root"))


def join(docs: DataFrame, p: JoinParameters | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (the smallest id of an equal set) for each row of docs."""
    known, links = _known(docs, p or JoinParameters(), key, text)
    # rows of one id with unequal sets
    full = known.where("n > 0 and id is not null")
    mixed = full.groupBy("id").agg(F.min("set").alias("a"), F.max("set").alias("z")).where("a <> z").select("id", "a")
    through = full.join(mixed, "id").select("a", F.col("set").alias("b"))
    rooted = written(_rooted(known, components(links.unionByName(through))), "rooted")
    # an equal set's smallest id stands for all of them, and a component's smallest for all of it
    sets = rooted.where("n > 0 and id is not null").groupBy("root", "set").agg(F.min("id").alias("class_id"))
    named = sets.join(sets.groupBy("root").agg(F.min("class_id").alias("low")), "root").select(F.col("set").alias("s"), "class_id", "low")
    out = rooted.join(named, (F.col("set") == F.col("s")) & (F.col("n") > 0), "left")
    own = lambda c: F.when(F.col("id").isNotNull(), F.coalesce(c, "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own("low").alias("component_id"), own("class_id").alias("class_id"))


def _links(spark: SparkSession, sized: DataFrame, listed: DataFrame, texts: DataFrame, p: JoinParameters) -> DataFrame:
    """Links a, b within clusters (set, cluster, n); a written table."""
    volume = sized.groupBy("cluster").agg(F.sum("n").alias("volume"), F.count("*").alias("members"))
    volume = written(volume.withColumn("pages", F.least(F.greatest(F.lit(1).cast("long"), F.ceil(F.col("volume") / p.page_shingles)), F.col("members"))), "volumes")
    total, most = volume.agg(F.sum("volume"), F.max("pages")).first()
    if not total:
        return spark.createDataFrame([], "a long, b long")
    bins = max(1, math.ceil(2 * total / p.page_shingles))
    placed = sized.join(volume.select("cluster", "pages"), "cluster")
    one = placed.where("pages = 1")
    small = one.select("set", F.concat_ws(":", F.lit("s"), "cluster").alias("page"), F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("string")).alias("bin"), F.col("set").alias("label"), F.lit(True).alias("asks"))
    if most <= 1:
        return written(_paged(small, texts, bins, p), "links")
    many = written(placed.where("pages > 1").select("set", "cluster", F.pmod(F.xxhash64("set"), F.col("pages")).cast("int").alias("page_no")), "paged")
    # pivots: a bounded number of sets of each cluster, by the smallest hashes of theirs; names of sets are hashes
    order = Window.partitionBy("cluster").orderBy("share")
    share = many.select("cluster", "set", F.xxhash64(F.lit(17), "set").alias("share"))
    sampled = share.withColumn("place", F.row_number().over(order)).where(F.col("place") <= p.pivots).select("cluster", "set")
    pivot_rows = many.select("cluster", "page_no").distinct().join(sampled, "cluster").select("set", "cluster", "page_no")
    with_pivots = many.unionByName(pivot_rows).distinct()
    name = F.concat_ws(":", F.lit("l"), "cluster", "page_no")
    large = with_pivots.select("set", name.alias("page"), name.alias("bin"), F.col("set").alias("label"), F.lit(True).alias("asks"))
    links = written(_paged(small.unionByName(large), texts, bins + most, p), "links")
    known = components(links).withColumnsRenamed({"node": "set", "component": "label"})
    labelled = written(many.join(known, "set", "left").select("set", "cluster", "page_no", F.coalesce("label", "set").alias("label")), "labelled")
    weight = labelled.groupBy("cluster", "label").agg(F.count("*").alias("m"))
    main = weight.groupBy("cluster").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    outside = written(labelled.join(main, "cluster").where("label <> main").select("set", "cluster", "page_no", "label"), "outside")
    if outside.isEmpty():
        return links
    # under each key, the pages of sets outside and the pages that hold another component
    asking = listed.join(outside, "set").groupBy("key", "cluster", F.col("page_no").alias("p")).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    holding = listed.join(labelled, "set")
    pages = holding.groupBy("key", F.col("page_no").alias("q")).agg(F.min("label").alias("least"), F.max("label").alias("most"))
    met = written(asking.join(pages, "key").where("p <> q and (low <> high or least <> most or low <> least)").select("key", "cluster", "p", "q"), "met")
    page = F.concat_ws(":", F.lit("x"), "cluster", "p", "q")

    def meeting(rows: DataFrame, side: str, asks: bool) -> DataFrame:
        own = listed.join(rows.select("set", "label", F.col("page_no").alias(side)), "set").join(met, ["key", side])
        return own.select("set", page.alias("page"), page.alias("bin"), "label", F.lit(asks).alias("asks")).distinct()

    second = meeting(outside, "p", True).unionByName(meeting(labelled, "q", False))
    more = written(_paged(second, texts, bins + most, p), "links")
    return links.unionByName(more)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles of three words and its component of links of 90 percent."""
    found = join(table(spark, sf_dir, "documents"), JoinParameters(words=3, percent=90))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")
