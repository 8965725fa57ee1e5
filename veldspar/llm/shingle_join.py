"""N-gram Jaccard join with signature trees.

Texts with one shingle set form a class. The search descends a tree whose nodes hold the OR of
their sets' token bitmaps. Its root, the bitmap of all tokens, is spread over the cluster: of
each class it tells which tokens any other class has. A link needs most of a set, so a class
with too many tokens of its own is left at once, whatever boilerplate it shares. The others
take routes down: one for each shared token that a link could have first, in one order of all
tokens, rare ones first, so what many texts share connects few. Classes that routes connect meet in blocks of bounded size by size range, where two
signature trees are traversed together: a node holds its members' bitmap, their size range and
their largest excess of tokens over bits, and a pair of nodes is left as soon as the common
bits cannot hold the overlap that a link needs, or all its members are linked already.
Surviving pairs are verified on their tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import blocks_of, combine, mix
from .common import SPACES, materialise, release
from .components import LEAST, SHARE, connected_components

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Classes in a block of a large cluster, on average.
BLOCK_CLASSES = 512
LEAF = 8
_LOWER_SPLIT = bytes(32 if b in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles_of(text: str, n: int = SHINGLE) -> np.ndarray:
    """The sorted set of the text's shingles, each as a 64-bit hash."""
    words = [w for w in text.encode("utf-8", "surrogatepass").translate(_LOWER_SPLIT).split(b" ") if w]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return np.unique(combine(h, min(n, len(h)), 3 + min(n, len(h)))) if len(h) else h


class Forest:
    """Union-find of a block pair's members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


class Node:
    __slots__ = ("bits", "excess", "high", "kids", "low", "members")

    def __init__(self, members: list[int], kids: list[Node], bits: int, low: int, high: int, excess: int):
        self.members, self.kids, self.bits, self.low, self.high, self.excess = members, kids, bits, low, high, excess


def signature(s: np.ndarray, n_bits: int) -> int:
    bits = np.zeros(n_bits, dtype=bool)
    bits[(s % np.uint64(n_bits)).astype(np.int64)] = True
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def build_tree(members: list[int], sets: list[np.ndarray], sizes: list[int], signatures: dict[int, int]) -> Node:
    """A tree over the members, neighbours by size and least hash. sizes: of the whole sets, of
    which `sets` holds the tokens that any other set has."""
    order = sorted(members, key=lambda k: (sizes[k], int(sets[k][0]) if len(sets[k]) else 0))
    level = []
    for k in range(0, len(order), LEAF):
        m = order[k : k + LEAF]
        bits = 0
        for x in m:
            bits |= signatures[x]
        level.append(Node(m, [], bits, min(sizes[x] for x in m), max(sizes[x] for x in m), max(len(sets[x]) - signatures[x].bit_count() for x in m)))
    while len(level) > 1:
        above = []
        for k in range(0, len(level), LEAF):
            kids = level[k : k + LEAF]
            bits = 0
            for x in kids:
                bits |= x.bits
            above.append(Node([y for x in kids for y in x.members], kids, bits, min(x.low for x in kids), max(x.high for x in kids), max(x.excess for x in kids)))
        level = above
    return level[0]


def possible(a: Node, b: Node, percent: int = PERCENT) -> bool:
    """Whether a member of a and one of b can overlap enough: shared tokens lie on common
    bits, and a set has at most its excess of tokens more than bits."""
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    most = (a.bits & b.bits).bit_count() + min(a.excess, b.excess)
    return (100 + percent) * most >= percent * (a.low + b.low)


def linked(a: np.ndarray, b: np.ndarray, na: int, nb: int, percent: int = PERCENT) -> bool:
    """a, b: what other sets have of two sets of na and nb tokens."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return 100 * both >= percent * (na + nb - both)


def dual_join(left: Node, right: Node, sets: list[np.ndarray], sizes: list[int], signatures: dict[int, int], forest: Forest, percent: int = PERCENT) -> None:
    """Join all linked pairs of the two trees in the forest; the trees may be the same."""
    stack = [(left, right)]
    while stack:
        a, b = stack.pop()
        if not possible(a, b, percent):
            continue
        if len({forest.root(x) for x in a.members} | {forest.root(x) for x in b.members}) == 1:
            continue
        if a.kids or b.kids:
            if a is b:
                stack += [(x, y) for k, x in enumerate(a.kids) for y in a.kids[k:]]
            else:
                stack += [(x, y) for x in a.kids or [a] for y in b.kids or [b]]
            continue
        for k, x in enumerate(a.members):
            for y in a.members[k + 1 :] if a is b else b.members:
                if forest.root(x) == forest.root(y):
                    continue
                most = min(len(sets[x]) - (signatures[x] & ~signatures[y]).bit_count(), len(sets[y]) - (signatures[y] & ~signatures[x]).bit_count())
                if (100 + percent) * most >= percent * (sizes[x] + sizes[y]) and linked(sets[x], sets[y], sizes[x], sizes[y], percent):
                    forest.join(x, y)


def tree_join(sets: list[np.ndarray], sizes: list[int], percent: int = PERCENT) -> Forest:
    """The linked pairs of the sets, united.

    Sets are taken by size range, as only those of one range or of neighbouring ones can link,
    and each two ranges get bitmaps of the length that their sets ask for: a bitmap is never
    longer than a few times its own set.
    """
    forest = Forest(len(sets))
    step = np.log(100 / percent)
    ranges: dict[int, list[int]] = {}
    for k, n in enumerate(sizes):
        ranges.setdefault(int(np.log(n) / step + 1e-9), []).append(k)
    for r in sorted(ranges):
        for other in (r, r + 1):
            if other not in ranges:
                continue
            members = ranges[r] + (ranges[other] if other != r else [])
            n_bits = 1 << int(4 * max(sizes[k] for k in members)).bit_length()
            signs = {k: signature(sets[k], n_bits) for k in members}
            left = build_tree(ranges[r], sets, sizes, signs)
            dual_join(left, left if other == r else build_tree(ranges[other], sets, sizes, signs), sets, sizes, signs, forest, percent)
    return forest


def described(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(id, n_shingles, class_key) of every row; a row without shingles has no class."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys = [], []
            for t in b.column(1):
                s = shingles_of(t.as_py() or "", n)
                sizes.append(len(s))
                keys.append(class_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], ["id", "n_shingles", "class_key"])
        release()

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(describe, "id long, n_shingles long, class_key binary")


def class_of(s: np.ndarray) -> bytes:
    return hashlib.sha256(s.tobytes()).digest()[:16]


def class_name(key: bytes) -> int:
    """The first half of a class's key, as a signed number."""
    return int.from_bytes(key[:8], "big", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Two sets that link share one of the first so many tokens of either, in any one order of all tokens."""
    return n - -(-percent * n // 100) + 1


def marks_of(names: list[int]) -> np.ndarray:
    """32 bits of each class's name, made different within the block: a class that several blocks
    hold has one mark, but for the few that had to give way."""
    marks: dict[int, None] = {}
    for x in names:
        x &= 0xFFFFFFFF
        while x in marks:
            x = (x + 1) & 0xFFFFFFFF
        marks[x] = None
    return np.array(list(marks), dtype=np.uint32).view(np.int32)


def in_two(owners: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, two) of (owner, token) entries: their order by token and owner, where a
    token begins in it, and whether its entries are of two owners at least."""
    order = np.lexsort((owners, tokens))
    t, c = tokens[order], owners[order]
    start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))[: len(t)]
    stop = np.concatenate((start[1:], [len(t)])).astype(np.int64)
    return order, start, c[start] != c[stop - 1] if len(t) else np.zeros(0, dtype=bool)


#: What a row of a block of texts holds: tokens that it asks for, tokens known to be shared, or
#: the block's classes.
ASKED, SHARED, CLASSES = 0, 1, 2
ENTRIES = "place int, kind int, block long, owners array<int>, tokens array<long>, counts array<int>, names array<long>, sizes array<long>"


def _rows(kind: int, place: np.ndarray, block: np.ndarray, owners: np.ndarray, tokens: np.ndarray, counts: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries as a row for each place and block: the owners' numbers in the block, the tokens,
    and how often each was asked for, if that is known."""
    order = np.lexsort((block, place))
    place, block, owners, tokens = place[order], block[order], owners[order], tokens[order]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (block[1:] != block[:-1]))))[: len(place)]
    ends = pa.array(np.concatenate((first, [len(place)])), pa.int32())
    none = pa.array([None] * len(first), pa.list_(pa.int64()))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (owners.astype(np.int32), tokens.view(np.int64))]
    lists.append(none.cast(pa.list_(pa.int32())) if counts is None else pa.ListArray.from_arrays(ends, pa.array(counts[order].astype(np.int32))))
    return pa.RecordBatch.from_arrays([pa.array(place[first].astype(np.int32)), pa.array(np.full(len(first), kind, dtype=np.int32)), pa.array(block[first]), *lists, none, none], [x.split()[0] for x in ENTRIES.split(", ")])


def _entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, owner, token) of all entries of the rows."""
    lists = [t.column(c).combine_chunks() for c in ("owners", "tokens")]
    block = np.repeat(t.column("block").to_numpy(), np.diff(np.asarray(lists[1].offsets)))
    return block, np.asarray(lists[0].flatten()), np.asarray(lists[1].flatten()).view(np.uint64)


#: Tokens that one part of the token space holds on average.
PART_TOKENS = 1 << 20


def rarest_first(block: np.ndarray, owners: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, owner, token) entries, each once, by block and owner and there the least asked for
    token first. counts: how often a token was asked for, or 0 where another entry of the token
    and block has it."""
    order = np.lexsort((tokens, block))
    b, t = block[order], tokens[order]
    first = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (t[1:] != t[:-1]))))[: len(b)]
    if len(first):
        most = np.maximum.reduceat(counts[order], first)
        counts = np.empty(len(b), dtype=counts.dtype)
        counts[order] = np.repeat(most, np.diff(np.append(first, len(b))))
    order = np.lexsort((tokens, counts, owners, block))
    block, owners, tokens = block[order], owners[order], tokens[order]
    new = np.concatenate(([True], (block[1:] != block[:-1]) | (owners[1:] != owners[:-1]) | (tokens[1:] != tokens[:-1])))[: len(block)]
    return block[new], owners[new], tokens[new]


def survivors(docs: DataFrame, text: str, n: int, percent: int, total: int) -> DataFrame:
    """(name, n, tokens, routes) of every class that the root of the tree does not rule out: its
    size, those of its tokens that other classes have, too, and the routes to take.

    The root's bitmap, of a bit for each token there is, lies spread over parts by token. A
    block of texts asks the parts for its tokens; what two classes have, by their marks, is
    shared. Tokens that the block holds in two classes are known at once, and only
    two entries of each go to their part, so a very common token does not gather. What the
    parts answer comes back to the block, with the number of entries that asked. Tokens that
    no other class has come first in the order of tokens, so a class whose whole prefix is such
    tokens links with nothing; the others follow by that number, the same in all blocks. Common
    phrases come last, and the classes that routes connect are hardly more than those that link.
    """
    parts = max(1, -(-total // PART_TOKENS))

    def part_of(x: np.ndarray) -> np.ndarray:
        return ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    def home_of(block: np.ndarray) -> np.ndarray:
        return part_of(mix(block.view(np.uint64)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: set[bytes] = set()
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in blocks_of(texts, lambda t: len(t or "")):
                sets, own = [], []
                for t in texts[part]:
                    s = shingles_of(t or "", n)
                    if len(s) and (key := class_of(s)) not in seen:
                        seen.add(key)
                        sets.append(s)
                        own.append(class_name(key))
                if len(seen) > 1 << 20:
                    seen.clear()
                if not sets:
                    continue
                number += 1
                many, marks = [len(s) for s in sets], marks_of(own)
                owners, tokens = np.repeat(marks, many), np.concatenate(sets)
                order, start, two = in_two(owners, tokens)
                stop = np.concatenate((start[1:], [len(order)]))
                known = np.repeat(two, stop - start)
                asked = np.concatenate((order[~known], order[start[two]], order[stop[two] - 1]))
                block, home = np.full(len(tokens), number, dtype=np.int64), home_of(np.array([number], dtype=np.int64))
                yield _rows(ASKED, part_of(tokens[asked]), block[asked], owners[asked], tokens[asked])
                if known.any():
                    told = order[known]
                    yield _rows(SHARED, np.repeat(home, len(told)), block[told], owners[told], tokens[told])
                told = [pa.array([marks.tolist()], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int64())), pa.array([None], pa.list_(pa.int32())), *(pa.array([x], pa.list_(pa.int64())) for x in (own, many))]
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array([CLASSES], pa.int32()), pa.array(block[:1]), *told], [x.split()[0] for x in ENTRIES.split(", ")])
        release()

    def answer(t: pa.Table) -> pa.Table:
        """The asked tokens of a part that two classes have, by block; other rows as they are."""
        kind = t.column("kind").to_numpy()
        others = t.filter(pa.array(kind != ASKED))
        block, owners, tokens = _entries(t.filter(pa.array(kind == ASKED)).combine_chunks())
        order, start, two = in_two(owners, tokens)
        many = np.diff(np.concatenate((start, [len(order)])))
        at = order[np.repeat(two, many)]
        out = _rows(SHARED, home_of(block[at]), block[at], owners[at], tokens[at], np.repeat(many[two], many[two]))
        del t, block, owners, tokens, order, start, two, at
        release()
        return pa.concat_tables([others, pa.Table.from_batches([out], others.schema)])

    def route(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        held = t.filter(pa.array(kind == CLASSES))
        rows = zip(*(held.column(c).to_pylist() for c in ("block", "owners", "names", "sizes")), strict=True)
        told = {b: {m: (x, y) for m, x, y in zip(*lists, strict=True)} for b, *lists in rows}
        # Rows with counts, and those of tokens known in the block, whose counts are among them.
        shared = t.filter(pa.array(kind == SHARED))
        counted, known = (shared.filter(f(shared.column("counts"))) for f in (pc.is_valid, pc.is_null))
        both = [_entries(x) for x in (counted, known)]
        counts = np.concatenate((np.asarray(counted.column("counts").combine_chunks().flatten()), np.zeros(len(both[1][0]), dtype=np.int32)))
        block, owners, tokens = rarest_first(*map(np.concatenate, zip(*both, strict=True)), counts)
        own = np.concatenate(([True], (block[1:] != block[:-1]) | (owners[1:] != owners[:-1])))[: len(block)]
        first = np.flatnonzero(own)
        out = []
        for b, k, x, y in zip(block[first].tolist(), owners[first].tolist(), first.tolist(), np.append(first, len(block))[1:].tolist(), strict=True):
            s, (name, size) = tokens[x:y], told[b][k]
            routes = prefix_length(size, percent) - (size - len(s))
            if routes > 0:
                out.append((name, size, np.sort(s).tobytes(), s[:routes].view(np.int64)))
        cols = list(zip(*out, strict=True)) or [()] * 4
        del shared, counted, known, both, counts, block, owners, tokens, out
        release()
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("name", "n", "tokens", "routes"), cols, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)})

    asked = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(ask, ENTRIES)
    found = asked.groupBy("place").applyInArrow(answer, ENTRIES).groupBy("place").applyInArrow(route, "name long, n long, tokens binary, routes array<long>")
    # A class that several blocks hold is told by each, with the same tokens.
    return found.groupBy("name").agg(F.min(F.struct("n", "tokens", "routes")).alias("x")).select("name", "x.*")


def stars_of(routes: DataFrame) -> DataFrame:
    """(node, hub) links that connect what (node, route) does: each node with its route's least.
    Routes that many nodes take are few, and their hub is broadcast."""
    hubs = materialise(routes.groupBy("route").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count(F.lit(1)).alias("d")).filter("hub < top"), "routes")
    limit = max(LEAST, (hubs.agg(F.sum("d")).first()[0] or 0) // SHARE)
    hot = hubs.filter(F.col("d") > limit).select("route", F.col("hub").alias("hot"))
    tried = routes.join(F.broadcast(hot), "route", "left")
    rest = tried.filter("hot is null").select("node", "route").join(hubs.filter(F.col("d") <= limit).select("route", "hub"), "route")
    both = tried.filter("hot is not null").select("node", F.col("hot").alias("hub")).unionByName(rest.select("node", "hub"))
    return both.filter("node > hub").distinct()


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    A null text or one without words has no shingles and links with nothing: its component
    is its own id. A text of fewer than n words is one shingle. Equal sets link. A row with a
    null id takes part and its component is the smallest id there is in it, or null. A very
    long text is one set, as long as its text. An empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    rows = materialise(described(docs, key, text, n), "shingles")
    # A class is known by its smallest id; if it has none, by a negative number of its key.
    classes = rows.filter("class_key is not null").groupBy("class_key").agg(
        F.min("id").alias("owner"), F.max("n_shingles").alias("n"), F.coalesce(F.min("id"), -F.abs(F.xxhash64("class_key")) - 1).alias("node")
    )
    name = F.conv(F.hex(F.substring("class_key", 1, 8)), 16, -10).cast("long")
    classes = materialise(classes.withColumn("name", name), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0

    met = survivors(docs, text, n, percent, total).join(classes.select("node", "name"), "name").select("node", "n", "tokens", "routes")
    left = materialise(met, "routed")
    # Classes on one route may link; only those that routes connect meet.
    stars = stars_of(left.select("node", F.explode("routes").alias("route")))
    clusters = materialise(connected_components(stars, "node", "hub").withColumnRenamed("component", "cluster"), "clusters")
    # Blocks: a size band (neighbouring bands can link, others cannot) and a salt.
    step = float(np.log(100 / percent))
    sized = clusters.join(left.select("node", "n"), "node").withColumn("band", F.floor(F.log("n") / F.lit(step) + F.lit(1e-9)).cast("int"))
    salts = sized.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_CLASSES)).cast("int").alias("salts"))
    above = salts.select("cluster", (F.col("band") - 1).alias("band"), F.col("salts").alias("above"))
    below = salts.select("cluster", (F.col("band") + 1).alias("band"), F.col("salts").alias("below"))
    laid = sized.join(salts.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left"), ["cluster", "band"])
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    # Block pairs of a class: with its own band's blocks, and with the next band's up and down.
    # A cluster of few classes is one block whatever its bands.
    pairs = F.expr(
        "concat(transform(sequence(0, salts - 1), s -> struct(band as lo, least(s, salt) as i, band as hi, greatest(s, salt) as j)),"
        " if(above is null, array(), transform(sequence(0, above - 1), s -> struct(band as lo, salt as i, band + 1 as hi, s as j))),"
        " if(below is null, array(), transform(sequence(0, below - 1), s -> struct(band - 1 as lo, s as i, band as hi, salt as j))))"
    )
    totals = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    one = F.expr("array(struct(0 as lo, 0 as i, 0 as hi, 0 as j))")
    laid = laid.join(totals, "cluster").withColumn("salt", salt).withColumn("pairs", F.when(F.col("members") <= BLOCK_CLASSES, one).otherwise(pairs))
    dealt = laid.select("node", "cluster", F.explode("pairs").alias("p")).join(left.select("node", "n", "tokens"), "node")

    def join_blocks(t: pa.Table) -> pa.Table:
        nodes, sizes = t.column("node").to_pylist(), t.column("n").to_pylist()
        forest = tree_join([np.frombuffer(x, dtype=np.uint64) for x in t.column("tokens").to_pylist()], sizes, percent)
        out = [(nodes[k], nodes[r]) for k in range(len(nodes)) if (r := forest.root(k)) != k]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    links = dealt.groupBy("cluster", "p").applyInArrow(join_blocks, "a long, b long")
    components = connected_components(links)
    told = classes.join(components, "node", "left").select("class_key", F.coalesce("component", "node").alias("component"), "owner")
    named = told.groupBy("component").agg(F.min("owner").alias("least"))
    told = told.join(named, "component").select(F.col("class_key").alias("k2"), "least")
    out = rows.join(told, F.col("class_key") == F.col("k2"), "left")
    return out.select("id", "n_shingles", F.when(F.col("class_key").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked at a Jaccard similarity of 0.8 of their 5-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def distinct_by_shingles(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id is their component's smallest, with their columns.

    Rows without shingles, and rows of a component without any id, all stay; an empty table
    stays empty; columns may have any names.
    """
    gone = jaccard_components(docs, key, text, n, percent).filter("not (id <=> component_id)").select("id").distinct()
    # Not the kept ones but the dropped ones are looked up: they are few, and no text is shuffled twice.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("own"))
    return own.join(gone.hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("id")), "left_anti").select("row.*")
