"""N-gram Jaccard join with multiple global orders.

A document's set holds its distinct shingles of `n` words; two documents link
when 100 * |intersection| >= percent * |union|.  Documents with equal sets form
one class, so copies cost one row.  Then:

1. Order 1 ranks shingles by how often their bucket occurs in all documents
   (262,144 counts, a table of fixed size), rare ones first.  A set's first
   |s| - ceil(percent * |s| / 100) + 1 shingles are its prefix; linked sets
   share a shingle of their prefixes, in this and in every other order.  With
   l - 1 shingles more, they share l: a set that has fewer shingles in common
   with others than any partner would need drops out. A shingle counts only if
   another set has it whose size allows a link, and at places in both prefixes
   where a linked pair's first l shared shingles can lie: the share of shingles
   that unrelated sets have in common grows with the table, and would in the
   end let every set through.
2. Sets that share a shingle of the prefix form a group.  Sets with a shingle
   that more than `block` sets share are grouped by their prefixes in order 2
   as well, and where those are shared by as many, in order 3: linked sets meet
   in each order, so a pair whose shared shingles are all frequent in one order
   meets in the next.  Only sets whose shared shingles are frequent in all three
   are dealt into blocks, by their frequent shingles in order 1, which has
   fewest; those that nearly the same sets share count as one.  Groups that overlap are brought together under one label while they
   stay small, so that a set travels about once.
3. In a task, a pair is verified only if its prefixes meet in all three
   orders; pairs that other links already connect need no verification.
4. For shingles dealt into blocks, every set outside the shingle's largest
   component is then held against all its other blocks.

So the links span exactly the components of the full link graph, without all
pairs of a group ever being rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import discard, keep, unused
from .words import SPACED_LOWER, Words, mix, shards, windows

BUCKET_BITS = 18
CHUNK = 1024
FILTER_BITS = 26
#: Parts among which the rows of a shingle in a heavy bucket are dealt before they are counted.
SALTS = 64
#: A bucket is heavy above so many counts, and so many times the mean.
HEAVY, HEAVY_MEAN = 1024, 16
#: Salts of the orders 2 and 3, permutations of all 64-bit numbers.
ORDERS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Orders of sets by which groups whose label holds too many are brought together.
ROUNDS = (101, 102, 103)
#: Sets that differ but share a key; one in 2**64 pairs does.
COLLISIONS = 100_000


def class_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a sorted set."""
    size = np.uint64(len(shingles))
    totals = [np.add.reduce(mix(shingles ^ np.uint64(salt)), dtype=np.uint64, keepdims=True) for salt in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)]
    return tuple(int(mix(t + size).view(np.int64)[0]) for t in totals)


def class_key(shingles: np.ndarray, collided: frozenset) -> int:
    """The key of a sorted set; the second one, if the first is shared by different sets."""
    one, two = class_keys(shingles)
    return two if one in collided else one


def sets_of(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each text."""
    for at, to, data, offsets in shards(column):
        words = Words(data, offsets, SPACED_LOWER)
        shingles = windows(words.hash, n)
        for i in range(to - at):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= n:
                found = np.sort(shingles[a : b - n + 1])
                if len(found) > 1:
                    found = found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif b > a:  # fewer words than n: the whole sequence is the one shingle
                found = windows(words.hash[a:b], int(b - a)) ^ np.uint64(b - a)
            else:
                found = np.zeros(0, np.uint64)
            yield at + i, found


def prefix_length(size, percent: int):
    return size - (percent * size + 99) // 100 + 1


def shared_least(size, percent: int):
    """Shingles that a set of this size shares with a linked set of the same size or larger, if both prefixes are longer by that many less one."""
    return 1 + prefix_length(size, percent) // 3


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def permuted_prefix(found: np.ndarray, p: int, salt: int) -> np.ndarray:
    """The first p shingles of a set in the order of a permutation."""
    return found[np.argpartition(mix(found ^ np.uint64(salt)), p - 1)[:p]] if p < len(found) else found


def prefixes(found: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefixes of a set in the three orders: by count, and by two permutations of all 64-bit numbers."""
    p = prefix_length(len(found), percent)
    one = found[np.lexsort((found, counts[bucket(found)]))[:p]]
    return one, *[permuted_prefix(found, p, salt) for salt in ORDERS]


def _batch(fields: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[k for k, _ in fields])


def scan(n: int):
    """First pass: a row per document, and the counts of the task's buckets (once for each set that it meets)."""
    fields = [("doc_id", pa.int64()), ("key", pa.int64()), ("second", pa.int64()), ("size", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met = np.zeros(1 << BUCKET_BITS, np.int64), set()
        for batch in batches:
            sizes, keys = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows), np.int64)
            for row, found in sets_of(batch.column(1), n):
                sizes[row] = len(found)
                if len(found):
                    keys[:, row] = both = class_keys(found)
                    if both not in met:
                        met.add(both)
                        np.add.at(counts, bucket(found), 1)
            none = pa.nulls(batch.num_rows)
            yield _batch(fields, [batch.column(0), *[pa.array(k, mask=sizes == 0) for k in keys], sizes, none.cast(pa.int32()), none.cast(pa.binary())])
        if met:
            parts = counts.reshape(-1, CHUNK)
            none = pa.nulls(len(parts), pa.int64())
            yield _batch(fields, [none, none, none, none, np.arange(len(parts), dtype=np.int32), [x.tobytes() for x in parts]])

    return run, "doc_id long, key long, second long, size long, chunk int, counts binary"


def _sum_counts(part: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for x in part.column("counts"):
        total += np.frombuffer(x.as_py(), np.int64)
    return pa.table({"chunk": part.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _postings(n: int, percent: int, counts: np.ndarray, collided: frozenset):
    """Second pass: the longer order-1 prefix of each set, once in a task. spot: the set's size times 2**32, plus the shingle's place in the prefix; salt: a part of the rows of a shingle that may be frequent, else 0."""
    fields = [("token", pa.int64()), ("salt", pa.int32()), ("key", pa.int64()), ("spot", pa.int64())]
    heavy = counts > max(HEAVY, HEAVY_MEAN * counts.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            out: list[tuple] = []
            for _, found in sets_of(batch.column(0), n):
                if len(found) and (key := class_key(found, collided)) not in met:
                    met.add(key)
                    size = len(found)
                    longer = prefix_length(size, percent) + shared_least(size, percent) - 1
                    one = found[np.lexsort((found, counts[bucket(found)]))[:longer]]
                    salt = heavy[bucket(one)] * np.int32(1 + key % SALTS)
                    out.append((one.view(np.int64), salt.astype(np.int32), np.full(len(one), key, np.int64), (size << 32) + np.arange(len(one))))
            if out:
                yield _batch(fields, [np.concatenate([x[k] for x in out]) for k in range(4)])

    return run, "token long, salt int, key long, spot long"


def _ordered(percent: int, salt: int):
    """The shingles of the prefix of each set (key, shingles) in the order of a permutation."""
    fields = [("token", pa.int64()), ("key", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(1)]
            found = [permuted_prefix(x, prefix_length(len(x), percent), salt) for x in sets]
            if found:
                yield _batch(fields, [np.concatenate(found).view(np.int64), np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])])

    return run, "token long, key long"


def _filter_bit(key: int, doc_id: int | None) -> int:
    return (key ^ (-1 if doc_id is None else doc_id) * 0x9E3779B1) & ((1 << FILTER_BITS) - 1)


def _wanted_sets(n: int, bits: np.ndarray, collided: frozenset):
    """Third pass: the sets of the documents whose bit is set, once in a task."""
    fields = [("key", pa.int64()), ("shingles", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keys, found_sets, held = [], [], 0
            for row, found in sets_of(batch.column(1), n):
                if not len(found) or (key := class_key(found, collided)) in met:
                    continue
                at = _filter_bit(key, ids[row])
                if bits[at >> 3] >> (at & 7) & 1:
                    met.add(key)
                    keys.append(key)
                    found_sets.append(found.tobytes())
                    held += len(found_sets[-1])
                    if held > 8 << 20:
                        yield _batch(fields, [keys, found_sets])
                        keys, found_sets, held = [], [], 0
            if keys:
                yield _batch(fields, [keys, found_sets])

    return run, "key long, shingles binary"


def _bits(part: pa.Table) -> pa.Table:
    """The bits of one chunk of the filter."""
    size = 1 << 16
    out = np.zeros(size >> 3, np.uint8)
    at = part.column("at").to_numpy()
    np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return pa.table({"chunk": part.column("chunk").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)


def links_within(sets: list[np.ndarray], counts: np.ndarray, percent: int, sides: list[int] | None = None, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the given sets; with sides, only pairs of different sides count. Equal labels are components known already."""
    sizes = [len(s) for s in sets]
    forest, links = Forest(len(sets)), []
    if labels is not None:
        seen: dict[int, int] = {}
        for i, x in enumerate(labels):
            forest.join(i, seen.setdefault(x, i))
    orders: list[dict[int, list[int]]] = [defaultdict(list), defaultdict(list), defaultdict(list)]
    for y in sorted(range(len(sets)), key=lambda i: (sizes[i], i)):
        least = (percent * sizes[y] + 99) // 100
        meet: set[int] | None = None
        for order, prefix in zip(orders, prefixes(sets[y], counts, percent), strict=True):
            here: set[int] = set()
            for token in prefix.tolist():
                if there := order.get(token):
                    here.update(there)
                order[token].append(y)
            meet = here if meet is None else meet & here
        for x in sorted(meet or (), reverse=True):
            if sizes[x] < least or (sides is not None and sides[x] == sides[y]) or forest.root(x) == forest.root(y):
                continue
            small, large = (sets[x], sets[y]) if sizes[x] <= sizes[y] else (sets[y], sets[x])
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int(np.count_nonzero(large[at] == small))
            if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                forest.join(x, y)
                links.append((x, y))
    return links


def _verify(counts: np.ndarray, percent: int):
    def run(part: pa.Table) -> pa.Table:
        keys = part.column("key").to_pylist()
        sides, labels = part.column("side").to_pylist(), part.column("label").to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in part.column("shingles")]
        across = any(s is not None for s in sides)
        links = links_within(sets, counts, percent, sides if across else None, labels if across else None)
        return pa.table({"a": pa.array([keys[x] for x, _ in links], pa.int64()), "b": pa.array([keys[y] for _, y in links], pa.int64())})

    return run, "a long, b long"


def components(links: DataFrame) -> DataFrame:
    """(key, label): the smallest key that links reach, for each key of (a, b). Alternates large-star and small-star; every round is written to the shared folder."""
    edges = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    total = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        old, edges = edges, keep(small, "edges")
        discard(old)
        # no change once every key has one edge, to a key that has none; the sum of edges is fixed then
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == total:
            break
        total = tuple(state)
    own = edges.select(F.col("b").alias("key"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("key"), F.col("b").alias("label")).union(own)


def ngram_jaccard_join(documents: DataFrame, n: int = 4, percent: int = 85, block: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_key, component_id (the smallest doc_id that links reach, itself included).

    Null and blank texts have no shingles, a null class_key and link with nothing: component_id is their own doc_id. Rows with
    the same or no doc_id stay rows; a component whose ids are all null has a null component_id. Other columns are not read.
    An empty table gives an empty result. Shingles are compared as 64-bit hashes, whole sets as 128-bit ones.
    """
    docs = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("text"))
    texts = docs.select("text").where("text IS NOT NULL")
    run, schema = scan(n)
    first = keep(docs.mapInArrow(run, schema), "scan")
    rows, classes, collided = _classes(first.where("chunk IS NULL").select("doc_id", "key", "second", "size"))
    counts = np.zeros((1 << BUCKET_BITS) // CHUNK * CHUNK, np.int64).reshape(-1, CHUNK)
    summed = first.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInArrow(_sum_counts, "chunk int, counts binary")
    for x in summed.collect():  # 256 rows at any size of input
        counts[x.chunk] = np.frombuffer(x.counts, np.int64)
    counts = np.minimum(counts.reshape(-1), 2**31 - 1).astype(np.int32)

    run, schema = _postings(n, percent, counts, collided)
    postings = keep(_shared_only(texts.mapInArrow(run, schema), percent), "shared")
    # a set that shares too little goes, and then shingles that nobody else has any more
    for _ in range(2):
        enough = postings.groupBy("key").agg(F.count("*").alias("n"), F.max(F.shiftright("code", 1)).alias("need")).where("n >= need").select("key")
        postings = _replaced(postings, keep(postings.join(enough, "key", "left_semi").select("token", "key", "code"), "enough"))
        postings = _replaced(postings, _counted(postings))
    postings = _replaced(postings, keep(postings.where("code % 2 = 1").select("token", "key"), "proper"))
    postings = _replaced(postings, _counted(postings))

    bits = _key_filter(postings.select("key").distinct().join(classes.select("key", "least"), "key"))
    run, schema = _wanted_sets(n, bits, collided)
    sets = docs.where("text IS NOT NULL").mapInArrow(run, schema).groupBy("key").agg(F.first("shingles").alias("shingles"))
    sets = keep(sets, "sets")
    groups = [_labelled(postings.where(F.col("members") <= block), block)]
    frequent = hot = postings.where(F.col("members") > block)
    for salt in ORDERS:
        if hot.isEmpty():
            break
        run, schema = _ordered(percent, salt)
        there = keep(sets.join(hot.select("key").distinct(), "key", "left_semi").mapInArrow(run, schema), "order")
        there = _replaced(there, _counted(there))
        groups.append(_labelled(there.where(F.col("members") <= block), block))
        hot = there.where(F.col("members") > block)
    if some := not hot.isEmpty():
        # what is left meets in order 1, whose frequent shingles are fewest
        left = keep(frequent.join(hot.select("key").distinct(), "key", "left_semi"), "left")
        hot = _replaced(left, _counted(left))
        for salt in ROUNDS[:2]:
            hot = _replaced(hot, _families(hot, salt))
        deals = F.ceil(F.col("members") / F.lit(block)).cast("long")
        groups.append(_labelled(hot.withColumn("deal", F.pmod(F.xxhash64("key", F.lit(11)), deals)), block))
    every = groups[0]
    for x in groups[1:]:
        every = every.union(x)
    run, schema = _verify(counts, percent)
    none = F.lit(None).cast("long")
    links = keep(every.join(sets, "key").select("task", "key", "shingles", none.alias("side"), none.alias("label")).groupBy("task").applyInArrow(run, schema), "links")
    labels = components(links)
    if some:
        links = keep(links.union(_across(hot, labels, sets, counts, percent, block)), "links")
        labels = components(links)
    labels = keep(labels, "labels")
    by_class = classes.join(labels, "key", "left").select("key", "least", F.coalesce("label", "key").alias("label"))
    by_label = by_class.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = keep(by_class.join(by_label, "label").select("key", "component_id"), "classes")
    discard(sets)
    found = rows.where("key IS NOT NULL").join(by_class, "key").select("doc_id", F.col("size").alias("n_shingles"), F.col("key").alias("class_key"), "component_id")
    return found.unionByName(rows.where("key IS NULL").select("doc_id", F.col("size").alias("n_shingles"), F.col("key").alias("class_key"), F.col("doc_id").alias("component_id")))


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    discard(old)
    return new


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, frozenset]:
    """(rows with their class's key, (key, least doc_id) of each class, first keys that different sets share, whose second key counts)."""

    def by_key(rows: DataFrame) -> DataFrame:
        return keep(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("second").alias("low"), F.max("second").alias("high")), "least")

    classes = by_key(rows)
    met = classes.where("low <> high").select("key").limit(COLLISIONS + 1).collect()
    if len(met) > COLLISIONS:
        raise ValueError("more sets share a 64-bit key than chance explains")
    collided = frozenset(r.key for r in met)
    if collided:
        rows = rows.withColumn("key", F.when(F.col("key").isin(sorted(collided)), F.col("second")).otherwise(F.col("key")))
        classes = by_key(rows)
    return rows, classes, collided


def _counted(postings: DataFrame) -> DataFrame:
    """With members, the number of sets of a shingle, for shingles that two sets or more have. Sums meet, not rows; sums and join are written, each alone, so that a hot shingle's rows can be split."""
    members = keep(postings.groupBy("token").agg(F.count("*").alias("members")).where("members > 1"), "members")
    out = keep(postings.drop("members").join(members, "token"), "counted")
    discard(members)
    return out


def _shared_only(postings: DataFrame, percent: int) -> DataFrame:
    """(token, key, code) of the shingles that a linked set may share, in one exchange. code: twice the shingles that the set must share, plus 1 in the prefix proper.

    Rows of a shingle are in the order of their sets' sizes, so a row whose next but one is too large has one possible partner above it, which is tested;
    below it likewise. The rows of shingles that may be frequent are dealt by their salt, and go later.
    """
    once = postings.repartition("token", "salt").groupBy("token", "salt", "key").agg(F.max("spot").alias("spot"))
    by_size = Window.partitionBy("token", "salt").orderBy("spot")
    near = {f"{kind}{k}": f("spot", k).over(by_size) for kind, f in (("below", F.lag), ("above", F.lead)) for k in (1, 2)}
    size, place = (lambda spot: f"shiftright({spot}, 32)"), (lambda spot: f"({spot} & 4294967295L)")
    close = lambda a, b: f"100 * {size(a)} >= {percent} * {size(b)}"
    prefix = lambda n: f"({n} - ({percent} * {n} + 99) div 100 + 1)"
    least = lambda n: f"(1 + {prefix(n)} div 3)"  # noqa: E731  as in shared_least

    def meets(a: str, b: str) -> str:
        """Whether linked sets, b no smaller, may have one of their first shared shingles here: so many others follow it in both."""
        after = f"(({percent} * ({size(a)} + {size(b)}) + {99 + percent}) div {100 + percent} - {least(size(a))})"
        return f"({close(a, b)} AND {place(a)} < {size(a)} - {after} AND {place(b)} < {size(b)} - {after})"

    kept = f"salt > 0 OR {meets('below1', 'spot')} OR {meets('spot', 'above1')} OR {close('below2', 'spot')} OR {close('spot', 'above2')}"
    need = least(f"(({percent} * {size('spot')} + 99) div 100)")
    code = f"CAST(2 * {need} + CAST({place('spot')} < {prefix(size('spot'))} AS INT) AS INT)"
    return once.withColumns(near).where(kept).select("token", "key", F.expr(code).alias("code"))


def _families(hot: DataFrame, salt: int) -> DataFrame:
    """`hot` (token, key, members) with one token for those that have the same least set, in an order by `salt`, if together they have at most half as many sets again as the largest of them.

    A large cluster of near copies shares most of a prefix, so its sets would be dealt, and held against its blocks, once for each of these shingles; so once for nearly all.
    """
    sums = keep(hot.groupBy("token").agg(F.min(F.xxhash64("key", F.lit(salt))).alias("center"), F.max("members").alias("members")), "centers")
    rows = keep(hot.drop("members").join(sums, "token"), "centered")
    union = rows.select("center", "key").distinct().groupBy("center").agg(F.count("*").alias("all"))
    near = union.join(sums.groupBy("center").agg(F.max("members").alias("most")), "center").where("2 * all <= 3 * most").select("center", "all")
    near = keep(near, "near")
    alone = rows.join(near, "center", "left_anti").select("token", "key", "members")
    together = rows.select("center", "key").distinct().join(near, "center").select(F.col("center").alias("token"), "key", F.col("all").alias("members"))
    out = keep(alone.union(together), "families")
    for x in (sums, rows, near):
        discard(x)
    return out


def _labelled(dealt: DataFrame, block: int) -> DataFrame:
    """(task, key): every group of `dealt` (token, key, and deal if it is dealt) lies within a task, of at most twice `block` sets, if a group is no larger itself.

    What a label brings together beyond `block` is brought together anew, by one of each group's sets (the least in an order of its own, in each of the
    rounds), up to twice `block`; groups that no round could place meet with those of exactly the same sets. So a set doesn't travel once for each of its shingles where groups
    hang together by a few, as more and more do in larger tables.
    """
    part = F.xxhash64("token", "deal") if "deal" in dealt.columns else F.xxhash64("token")
    dealt = dealt.select(part.alias("part"), "key")
    # two steps of the smallest key: a group's smallest, then the smallest over a set's groups
    least = dealt.groupBy("part").agg(F.min("key").alias("least"))
    label = dealt.join(least, "part").groupBy("key").agg(F.min("least").alias("label"))
    # a group goes where its smallest label says
    home = dealt.join(label, "key").groupBy("part").agg(F.min("label").alias("task"))
    placed = keep(dealt.join(home, "part").select("part", "task", "key"), "placed")
    out, over = _fitting(placed, block, 1)
    for salt in ROUNDS:
        if over is None:
            return out
        home = over.groupBy("part").agg(F.min(F.xxhash64("key", F.lit(salt))).alias("task"))
        placed = _replaced(over, keep(over.join(home, "part").select("part", "task", "key"), "placed"))
        fits, over = _fitting(placed, 2 * block, salt)
        out = out.union(fits)
    if over is None:
        return out
    same = F.xxhash64(F.count("*"), *[F.bit_xor(F.xxhash64("key", F.lit(salt))) for salt in (3, 5)])
    home = over.groupBy("part").agg(same.alias("task"))
    return out.union(_replaced(over, keep(over.join(home, "part").select("task", "key").distinct(), "tasks")))


def _fitting(placed: DataFrame, block: int, salt: int) -> tuple[DataFrame, DataFrame | None]:
    """(task, key) of the tasks of at most `block` sets, and (part, key) of the others, if there are any. `placed` goes."""
    rows = keep(placed.select("task", "key").distinct(), "rows")
    large = keep(rows.groupBy("task").agg(F.count("*").alias("n")).where(F.col("n") > block).select("task"), "large")
    fits = keep(rows.join(large, "task", "left_anti").select(F.xxhash64("task", F.lit(salt)).alias("task"), "key"), "tasks")
    over = None if large.isEmpty() else keep(placed.join(large, "task", "left_semi").select("part", "key"), "over")
    for x in (rows, large, placed):
        discard(x)
    return fits, over


def _key_filter(wanted: DataFrame) -> np.ndarray:
    """A bit for each wanted (key, least doc_id) modulo 2**26, 8 MB at any size of input; it may let a set pass that no task wants, never the other way."""
    scaled = (F.coalesce("least", F.lit(-1)).cast("decimal(20,0)") * F.lit(0x9E3779B1)) % F.lit(1 << 32)  # as in _filter_bit, without overflow
    at = F.col("key").bitwiseXOR(scaled.cast("long")).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    chunks = wanted.select(F.shiftright(at, 16).cast("int").alias("chunk"), at.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("at")).distinct().groupBy("chunk").applyInArrow(_bits, "chunk int, bits binary")
    out = np.zeros((1 << FILTER_BITS) >> 3, np.uint8).reshape(-1, (1 << 16) >> 3)
    for x in chunks.collect():
        out[x.chunk] = np.frombuffer(x.bits, np.uint8)
    return out.reshape(-1)


def _across(hot: DataFrame, labels: DataFrame, sets: DataFrame, counts: np.ndarray, percent: int, block: int) -> DataFrame:
    """Links between the blocks of hot shingles: sets outside a shingle's largest component, against all its sets."""
    known = keep(hot.where(F.col("members") > block).join(labels, "key", "left").select("token", "key", F.coalesce("label", "key").alias("label")), "known")
    most = known.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.sum("n").alias("members"), F.max("n").alias("n"))
    most = most.where("n < members").withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("chunks", F.ceil((F.col("members") - F.col("n")) / block).cast("int"))
    # each shingle's sums meet its rows in SALTS parts
    salted = most.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = keep(known.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(17)), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"]), "across")
    deal = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("token", "key", "label", deal("blocks", 11).alias("i"), every("chunks").alias("j"), F.lit(0).cast("long").alias("side"))
    strays = rows.where("label <> most").select("token", "key", "label", every("blocks").alias("i"), deal("chunks", 13).alias("j"), F.lit(1).cast("long").alias("side"))
    run, schema = _verify(counts, percent)
    tasks = members.union(strays).select(F.xxhash64("token", "i", "j").alias("task"), "key", "side", "label")
    return tasks.join(sets, "key").select("task", "key", "shingles", "side", "label").groupBy("task").applyInArrow(run, schema)


def keep_one(documents: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of `documents` (doc_id, text, ...) whose doc_id is the smallest of its component; of rows that repeat such a doc_id and its text, one. Rows without a doc_id stay, since no other row can be told to stand for them."""
    chosen = joined.where("component_id IS NOT NULL").select(F.col("component_id").alias("doc_id")).distinct()
    place = unused(documents, "__place")
    once = Window.partitionBy("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(7), "text")).orderBy("doc_id")
    kept = documents.join(chosen, "doc_id", "left_semi").withColumn(place, F.row_number().over(once)).where(F.col(place) == 1).drop(place)
    return kept.unionByName(documents.where("doc_id IS NULL"))
