"""N-gram Jaccard join by signature trees.

Texts equal but for the case of A-Z form a class and are handled once. The join is exact and
narrows in steps, none of which loses a link:

1. Every class's shingles go, as packed blocks, to buckets by hash. A link needs three quarters
   of a set shared, so classes with fewer shared shingles have no links. (Shingles travel as
   46-bit numbers here; a chance match only lets a class through to the next step.)
2. Of linked sets, the prefixes (the rarest quarter of the shingles, plus one) meet. Classes with
   a common prefix shingle form clusters, found as connected components.
3. Within a cluster, signature trees: leaves hold sets sorted by size, nodes the OR and AND of
   their token bitmaps and the range of sizes. A dual traversal drops a pair of nodes when the
   largest overlap they allow is too small, or when all below is linked already; the rest are
   compared exactly. A large cluster is dealt into chunks and joined by pairs of chunks, one task
   for each, so no task holds more than two chunks.

Links between different texts are all found or implied (both ends known to be in one component).
Shingles are compared as 64-bit hashes.

Defined cases: null, empty and blank texts have no shingles, are linked with nothing and are
their own component; fewer than five words are one shingle; repeated rows share a component; a
null id is never the smallest; rows that share an id but not the text are linked each by its own;
very long texts are read whole; an empty table gives an empty result; only id and text are read,
and ``keep_one`` passes other columns through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bucket_count, fresh, give_back, partition_count, small_batches, stage
from .components import connected_components
from .substring import _mix, _rolled

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
FLUSH = 1_000_000  # shingles packed at a time: about 100 MB with all that packing takes
BUCKET_BYTES, PARTITION_BYTES = 6 << 20, 16 << 20
CHUNK_TOKENS = 1_500_000
BROADCAST_ROWS = 1_000_000  # two longs a row: 16 MB
FAN, BITS = 8, 4096
BLOCKS = "bucket int, cls long, size int, block binary"
BLOCKS_ARROW = pa.schema([("bucket", pa.int32()), ("cls", pa.int64()), ("size", pa.int32()), ("block", pa.binary())])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_known = _Hashes()


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams; of fewer words, the one of them all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > 400_000:
        _known.clear()
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        return _mix(_rolled(h, len(h)) + np.uint64(len(h)))
    return np.unique(_rolled(h, n))


def _pack(sets: list[tuple[int, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks by bucket: class keys and counts, and the rest of each hash in five bytes."""
    sizes = np.array([len(s) for _, s in sets], np.int64)
    keys = np.array([k for k, _ in sets], np.int64)
    rows: list[tuple] = [(-1 - i % 64, int(k), int(n), None) for i, (k, n) in enumerate(zip(keys, sizes, strict=True))]
    if sizes.sum():
        h = np.concatenate([s for _, s in sets])
        who = np.repeat(np.arange(len(sets)), sizes)
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rest = ((h << np.uint64(bits)) >> np.uint64(24))[order]
        packed = np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        who = who[order].astype(np.int32)
        for b in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[b], cuts[b + 1]
            docs, counts = np.unique(who[i:j], return_counts=True)
            block = np.int64(len(docs)).tobytes() + keys[docs].tobytes() + counts.astype("<i4").tobytes() + packed[i:j].tobytes()
            rows.append((int(b), None, None, block))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCKS_ARROW, strict=True)], schema=BLOCKS_ARROW)


def _blocks(bits: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            for key, text in zip(batch["cls"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if key not in held:
                    held[key] = found = shingles(text)
                    n += len(found) + 8
                if n >= FLUSH:
                    yield from _pack(list(held.items()), bits)
                    held, n = {}, 0
        if held:
            yield from _pack(list(held.items()), bits)
        held = {}
        _forget()

    return blocks


def _forget() -> None:
    """The end of a task: the words' hashes go, and freed memory with them."""
    _known.clear()
    give_back()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By class, how many of a bucket's shingles another class has too; one bucket is held at a time."""
    now, held = -1, []
    for batch in batches:
        sizes = batch.filter(pa.compute.less(batch["bucket"], 0))
        yield pa.RecordBatch.from_arrays([sizes["cls"], sizes["size"], pa.array(np.zeros(sizes.num_rows, np.int64))], names=["cls", "size", "shared"])
        for bucket, block in zip(batch["bucket"].to_pylist(), batch["block"], strict=True):
            if bucket < 0:
                continue
            if bucket != now and held:
                yield _count_shared(held)
                held = []
            now = bucket
            held.append(block.as_py())
    if held:
        yield _count_shared(held)
    held = []
    give_back()


def _count_shared(blocks: list[bytes]) -> pa.RecordBatch:
    keys, who, tokens = [], [], []
    n_keys = 0
    for block in blocks:
        n = int(np.frombuffer(block, np.int64, 1)[0])
        keys.append(np.frombuffer(block, np.int64, n, 8))
        who.append(np.repeat(np.arange(n_keys, n_keys + n), np.frombuffer(block, "<i4", n, 8 + 8 * n)))
        n_keys += n
        raw = np.frombuffer(block, np.uint8, offset=8 + 12 * n).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        tokens.append(wide.view("<u8").reshape(-1))
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    owner, token = back[np.concatenate(who)], np.concatenate(tokens)
    # a shingle alone in its cell of a table of hashes is alone in the corpus, and is not sorted
    cell = (token * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - max(8, len(token).bit_length() + 2))
    number = np.arange(len(token), dtype=np.int32)
    last = np.zeros(int(cell.max()) + 1, np.int32)
    last[cell] = number
    many = np.zeros(len(last), bool)
    many[cell[last[cell] != number]] = True
    pick = many[cell]
    token, owner = token[pick], owner[pick]
    if len(unique) < 1 << 24:
        pairs = np.unique((token << np.uint64(24)) | owner.astype(np.uint64))
        token, owner = pairs >> np.uint64(24), (pairs & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.r_[True, (np.diff(owner) != 0) | (token[1:] != token[:-1])][: len(token)]
        token, owner = token[new], owner[new]
    same = token[1:] == token[:-1]
    many = (np.r_[False, same] | np.r_[same, False])[: len(token)]
    counts = np.bincount(owner[many], minlength=len(unique))
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(unique[at]), pa.array(np.zeros(len(at), np.int32)), pa.array(counts[at].astype(np.int64))], names=["cls", "size", "shared"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch["text"].to_pylist()]
        sizes = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["cls"], sizes, pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "size", "tokens"])
    _forget()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(raw, np.int64) for raw in batch["tokens"].to_pylist()]
        owner = np.repeat(batch["cls"].to_numpy(), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets])), pa.array(owner, pa.int64())], names=["token", "cls"])


def _candidates(sets: DataFrame) -> DataFrame:
    """(u, v): each class with the least class of every shingle in its prefix.

    The prefix is the rarest quarter of a set's shingles, plus one: of linked sets, the prefixes
    share a shingle. Rare first, so that passages common to many texts tie nothing together."""
    tokens = sets.select("cls", "tokens").mapInArrow(_tokens, "token long, cls long")
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("cls").alias("head"), F.max("cls").alias("last"))
    shared = tokens.join(common.where("head <> last").drop("last"), "token")
    packed = shared.groupBy("cls").agg(F.sort_array(F.collect_set(F.struct("df", "token", "head"))).alias("x"))
    sizes = sets.select("cls", "size").distinct()
    prefix = F.col("size") - F.ceil(F.col("size") * NUMERATOR / DENOMINATOR) + 1 - (F.col("size") - F.size("x"))
    heads = F.array_distinct(F.transform(F.slice("x", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int")), lambda t: t["head"]))
    return packed.join(sizes, "cls").select(F.col("cls").alias("u"), F.explode(heads).alias("v")).where("u <> v")


class Node:
    """A subtree: OR and AND of its members' bitmaps, its range of sizes, and its members or children."""

    __slots__ = ("any", "all", "low", "high", "members", "children", "one")

    def __init__(self, parts: list, leaf: bool, bitmaps: list[int], sizes: list[int]) -> None:
        ors, ands = ([bitmaps[i] for i in parts],) * 2 if leaf else ([c.any for c in parts], [c.all for c in parts])
        self.any, self.all = 0, -1
        for o, a in zip(ors, ands, strict=True):
            self.any |= o
            self.all &= a
        self.low = min(sizes[i] if leaf else i.low for i in parts)
        self.high = max(sizes[i] if leaf else i.high for i in parts)
        self.members, self.children, self.one = (parts, None, None) if leaf else (None, parts, None)


def _reach(low_a: int, high_a: int, low_b: int, high_b: int, miss_a: int, miss_b: int) -> bool:
    """Whether sets of these sizes can link when so many of their members are surely not in the other."""
    most = min(high_a - miss_a, high_b - miss_b)
    return DENOMINATOR * most >= NUMERATOR * max(low_a, low_b, low_a + low_b - most)


def tree_links(sets: list[np.ndarray], side: list[int] | None = None) -> np.ndarray:
    """Roots of a forest over the sets that joins exactly those connected by links. With ``side``
    (0 or 1 for each), links within a side are still looked for."""
    n = len(sets)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    bitmaps = []
    for s in sets:
        bits = np.zeros(BITS, np.uint8)
        bits[(s % np.uint64(BITS)).astype(np.int64)] = 1
        bitmaps.append(int.from_bytes(np.packbits(bits).tobytes(), "big"))
    sizes = [len(s) for s in sets]
    order = sorted(range(n), key=lambda i: (int(sets[i][0]) if sizes[i] else 0, sizes[i]))
    # leaves gather sets alike in their least hash; the levels above keep ranges of sizes apart
    level = [Node(order[i : i + FAN], True, bitmaps, sizes) for i in range(0, n, FAN)]
    while len(level) > 1:
        level.sort(key=lambda x: x.low)
        level = [Node(level[i : i + FAN], False, bitmaps, sizes) for i in range(0, len(level), FAN)]

    def only(node: Node) -> int | None:
        """The one component that holds all of the node, if there is one."""
        if node.one is None:
            parts = [find(i) for i in node.members] if node.members is not None else [only(c) for c in node.children]
            if parts[0] is None or any(p is None or find(p) != find(parts[0]) for p in parts):
                return None
            node.one = parts[0]
        return find(node.one)

    todo = [(level[0], level[0])] if level else []
    while todo:
        a, b = todo.pop()
        if not _reach(a.low, a.high, b.low, b.high, (a.all & ~b.any).bit_count(), (b.all & ~a.any).bit_count()):
            continue
        if (one := only(a)) is not None and one == only(b):
            continue
        if a.members is None:
            for i, x in enumerate(a.children):
                todo += [(x, y) for y in (a.children[i:] if a is b else b.children if b.members is None else [b])]
            continue
        if b.members is None:
            todo += [(a, y) for y in b.children]
            continue
        for at, i in enumerate(a.members):
            for j in a.members[at + 1 :] if a is b else b.members:
                if find(i) == find(j):
                    continue
                x, y = bitmaps[i], bitmaps[j]
                if not _reach(sizes[i], sizes[i], sizes[j], sizes[j], (x & ~y).bit_count(), (y & ~x).bit_count()):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both and DENOMINATOR * both >= NUMERATOR * (sizes[i] + sizes[j] - both):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    return np.array([find(i) for i in range(n)], np.int64)


def _join(group: pa.Table) -> pa.Table:
    """Links of the pairs of chunks in one group, as (u, v) with v the first member of u's component."""
    out_u, out_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    keys = [group[c].to_numpy() for c in ("cluster", "a", "b")]
    order = np.lexsort(keys[::-1])
    stacked = np.stack([k[order] for k in keys], 1)
    cuts = np.flatnonzero((np.diff(stacked, axis=0) != 0).any(1)) + 1
    cls, tokens = group["cls"].to_numpy(), group["tokens"].combine_chunks()
    for part in np.split(order, cuts) if len(order) else ():
        mine, first = np.unique(cls[part], return_index=True)
        sets = [np.frombuffer(tokens[int(i)].as_buffer(), np.uint64) for i in part[first]]
        roots = tree_links(sets)
        at = np.flatnonzero(roots != np.arange(len(roots)))
        out_u.append(mine[at])
        out_v.append(mine[roots[at]])
    return pa.table({"u": np.concatenate(out_u), "v": np.concatenate(out_v)})


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _components(docs).drop("cls")


def _text_class(text: Column) -> Column:
    """Key of the texts equal but for the case of A-Z."""
    return F.xxhash64(ascii_lower(text))


def _components(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_class(F.col("text")).alias("cls"), "text")
    ids = stage(keyed.select("doc_id", "cls"), "join-ids")
    bits = bucket_count(docs, BUCKET_BYTES, least=64).bit_length()
    dealt = keyed.select("cls", "text").mapInArrow(_blocks(bits), BLOCKS).repartition(partition_count(docs, PARTITION_BYTES), "bucket").sortWithinPartitions("bucket")
    counted = dealt.mapInArrow(_shared, "cls long, size int, shared long")
    classes = stage(counted.groupBy("cls").agg(F.max("size").cast("long").alias("n_shingles"), F.sum("shared").alias("shared")), "join-classes")
    firsts = stage(ids.groupBy("cls").agg(F.min("doc_id").alias("first")), "join-firsts")
    likely = classes.where(f"n_shingles > 0 and {DENOMINATOR} * shared >= {NUMERATOR} * n_shingles").select("cls")
    likely = stage(likely.join(firsts, "cls"), "join-likely").select(F.col("cls").alias("c2"), "first")
    small = F.broadcast(likely) if likely.count() <= BROADCAST_ROWS else likely
    texts = keyed.join(small, (F.col("cls") == F.col("c2")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    sets = stage(texts.select("cls", "text").mapInArrow(_sets, "cls long, size long, tokens binary"), "join-sets")

    clusters = stage(connected_components(_candidates(sets)).select(F.col("node").alias("cls"), F.col("root").alias("cluster")), "join-clusters")

    member = sets.join(clusters, "cls").dropDuplicates(["cls"])
    weights = stage(sets.select("cls", "size").join(clusters, "cls").groupBy("cluster").agg(F.sum("size").alias("w")), "join-weights")
    weights = weights.select("cluster", F.ceil(F.col("w") / CHUNK_TOKENS).alias("m"))
    c, i = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("m")), F.col("i")
    dealt = member.join(weights, "cluster").withColumn("c", c).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    dealt = dealt.select("cluster", F.least("c", i).alias("a"), F.greatest("c", i).alias("b"), "cls", "tokens", "m")
    groups = max(64, input_tokens(sets) // CHUNK_TOKENS)
    # pairs of chunks of large clusters stay alone; small clusters share groups
    spot = F.when(F.col("m") > 1, -1 - F.pmod(F.xxhash64("cluster", "a", "b"), F.lit(1 << 40))).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(groups)))
    links = dealt.withColumn("g", spot).groupBy("g").applyInArrow(_join, "u long, v long")
    found = connected_components(stage(links, "join-links"))

    joined = found.join(firsts, found["node"] == firsts["cls"]).select("node", "root", "first")
    component = joined.groupBy("root").agg(F.min("first").alias("least")).join(joined.select("node", "root"), "root").select(F.col("node").alias("cls"), "least")
    table = classes.select("cls", "n_shingles").join(firsts, "cls").join(component, "cls", "left")
    table = table.select("cls", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "first")).alias("component_id"))
    return ids.join(table, "cls").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "cls")


def input_tokens(sets: DataFrame) -> int:
    return int(sets.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id; columns unchanged."""
    key, cls = fresh(docs, "kept_id"), fresh(docs, "kept_cls")
    kept = _components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key), F.col("cls").alias(cls)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col(key)) & (_text_class(docs["text"]) == F.col(cls)), "left_semi")
