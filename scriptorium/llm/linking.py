"""Links within shards, found in BK-trees, and the components they make.

A shard's rows stand in one tree of a bounded size, or are dealt by hash to several. A tree's task reports a forest of links,
which connects whatever all its matching pairs connect, and not the pairs themselves: a component of BIG rows gets a tree of
its own, in which a row's search ends at its first match, so that a large group of near copies costs a search or two a row.

Shards of several trees take two rounds. In the first each tree's task also holds the shard's first tree, which connects
what has a like in it. In the second only rows outside the shard's largest component are searched, in blocks, against each
tree that they haven't met: two rows of one component need no link. No pair of different components is passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MASK = (1 << 64) - 1
#: Rows of a component from which it has its own tree.
BIG = 24

Match = Callable[[tuple, tuple], bool]


class Entry:
    """A row in a tree: its number, name and payload. Kept in the list of its node, or moved to another tree."""

    __slots__ = ("name", "payload", "value")

    def __init__(self, value: int, name: int, payload=None):
        self.value, self.name, self.payload = value, name, payload


class Tree:
    """A BK-tree of unsigned 64-bit numbers under the Hamming distance; a node holds the entries of its number."""

    def __init__(self) -> None:
        self.root: tuple[int, dict, list[Entry]] | None = None

    def add(self, entry: Entry) -> list[Entry]:
        """Returns the node's list, which the entry now is in."""
        x = entry.value
        if self.root is None:
            self.root = (x, {}, [entry])
            return self.root[2]
        node = self.root
        while d := (node[0] ^ x).bit_count():
            child = node[1].get(d)
            if child is None:
                child = node[1][d] = (x, {}, [entry])
                return child[2]
            node = child
        node[2].append(entry)
        return node[2]

    def within(self, x: int, radius: int) -> Iterator[Entry]:
        """All entries within the radius, those along the nearest edges first."""
        stack = [self.root] if self.root else []
        while stack:
            value, children, own = stack.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                yield from own
            if children:
                for e in range(radius, -1, -1):
                    if child := children.get(d - e):
                        stack.append(child)
                    if e and (child := children.get(d + e)):
                        stack.append(child)


class Forest:
    """The trees of one shard's rows and which of the rows are connected."""

    def __init__(self, radius: int, match: Match | None = None, big: int = BIG):
        self.radius, self.match, self.big = radius, match, big
        self.common, self.own = Tree(), {}  # own: by the root of a large component, its tree
        self.above: dict[int, int] = {}
        self.members: dict[int, list[tuple[Entry, list[Entry]]]] = {}

    def _root(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = above[x]
        return x

    def meet(self, value: int, name: int, payload=None, add: bool = True) -> list[int]:
        """Names that this row links to, one of each component that it matches and isn't in already; then the row is added."""
        found, radius, match = [], self.radius, self.match
        mine = self._root(name)
        for root, tree in self.own.items():
            if self._root(root) != mine:
                for e in tree.within(value, radius):
                    if match is None or match(payload, e.payload):
                        found.append(e.name)
                        break
        met = {self._root(x) for x in found} | {mine}
        for e in self.common.within(value, radius):
            if (r := self._root(e.name)) not in met and (match is None or match(payload, e.payload)):
                met.add(r)
                found.append(e.name)
        if add:
            entry = Entry(value, name, payload)
            target = mine if mine in self.own else next((r for r in met if r in self.own), None) if mine not in self.members else None
            if target is None:
                self.members.setdefault(mine, []).append((entry, self.common.add(entry)))
            else:
                if target != mine:
                    self.above[mine] = target
                self.members[target].append((entry, []))
                self.own[target].add(entry)
        for x in found:
            self._join(x, name)
        return found

    def _join(self, x: int, y: int) -> None:
        x, y = self._root(x), self._root(y)
        if x == y:
            return
        a, b = self.members.get(x, []), self.members.get(y, [])
        if len(a) < len(b) or len(a) == len(b) and y in self.own:
            x, y, a, b = y, x, b, a
        self.above[y] = x
        self.members.pop(y, None)
        tree = self.own.get(x)
        if tree is None and len(a) + len(b) >= self.big:
            tree = self.own[x] = Tree()
            for entry, place in a:
                place.remove(entry)
                tree.add(entry)
            a = [(entry, []) for entry, _ in a]
        if tree is not None:
            gone = self.own.pop(y, None) is not None
            for entry, place in b:
                if not gone:
                    place.remove(entry)
                tree.add(entry)
            b = [(entry, []) for entry, _ in b]
        a.extend(b)
        self.members[x] = a


def _dealt_links(rows: DataFrame, by: list[str], make: Callable, read: Callable) -> DataFrame:
    """a, b of rows by, _role, _print, _node, _payload. Role 0 is added and searched without a report, 1 with one, 2 only searched."""
    n = len(by)
    dealt = rows.select(*by, "_role", "_print", "_node", "_payload").repartition(*by).sortWithinPartitions(*by, "_role", "_print", "_node")

    def search(batches):
        import pyarrow as pa

        last, forest = None, make()
        for batch in batches:
            a, b = [], []
            for *at, role, x, name, payload in zip(*(batch.column(i).to_pylist() for i in range(n + 4)), strict=True):
                if at != last:
                    last, forest = at, make()
                for other in forest.meet(x & MASK, name, read(payload), role < 2):
                    if role:
                        a.append(name)
                        b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(search, "a long, b long")


def links(rows: DataFrame, radius: int, cap: int, scratch: Scratch, name: str, match: Match | None = None, read: Callable = lambda x: x, make: Callable | None = None) -> DataFrame:
    """a, b: links between nodes that connect what all matching pairs within shards connect. Names may recur between shards.

    rows: _shard, _node (longs), _print (a signed long), _size (what a row counts towards cap) and _payload, written.
    Rows match if their prints differ in radius bits at most and match(read(payload), read(payload)) holds. make, if given,
    makes something else that meets rows as a Forest does, by its own rule.
    """
    make = make or partial(Forest, radius, match)
    counts = rows.groupBy("_shard").agg(F.count("*").alias("n"), F.sum("_size").alias("size")).filter("n > 1")
    counts = scratch.keep(counts.select("_shard", F.greatest(F.ceil(F.col("size") / cap), F.lit(1)).cast("int").alias("_trees")), f"{name}_counts")
    own = F.pmod(F.xxhash64("_node"), F.col("_trees")).cast("int")
    rows = rows.join(counts, "_shard").withColumn("_tree", own)
    several = counts.filter("_trees > 1").limit(1).count() > 0
    if several:
        rows = scratch.keep(rows, f"{name}_rows")
        at = F.when(F.col("_tree") == 0, F.sequence(F.lit(0), F.col("_trees") - 1)).otherwise(F.array("_tree"))
        first = rows.withColumn("_at", F.explode(at)).withColumn("_role", F.when(F.col("_tree") == F.col("_at"), 1).otherwise(0))
        first = first.drop("_tree").withColumnRenamed("_at", "_tree")
    else:
        first = rows.withColumn("_role", F.lit(1))
    found = scratch.keep(_dealt_links(first, ["_shard", "_tree"], make, read), f"{name}_links")
    if not several:
        return found
    hot = rows.filter("_trees > 1")
    roots = components(found, scratch, f"{name}_roots")
    hot = hot.join(roots, hot["_node"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "_node")).drop("node", "root")
    hot = scratch.keep(hot, f"{name}_hot")
    sizes = hot.groupBy("_shard", "_root").agg(F.count("*").alias("n"))
    largest = scratch.keep(sizes.groupBy("_shard").agg(F.max_by("_root", F.struct("n", "_root")).alias("_largest")), f"{name}_largest")
    rest = hot.join(largest, "_shard").filter("_root != _largest").drop("_largest", "_root")
    rest = scratch.keep(rest, f"{name}_rest")
    rest = rest.filter("_tree > 0")  # the first tree's rows have met every tree
    blocks = rest.groupBy("_shard").agg(F.ceil(F.sum("_size") / cap).cast("int").alias("_blocks"))
    blocks = scratch.keep(blocks.withColumn("_blocks", F.greatest("_blocks", F.lit(1))), f"{name}_blocks")
    inside = hot.drop("_root").join(blocks, "_shard").filter("_tree > 0").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_role", F.lit(0))
    asked = rest.join(blocks, "_shard").withColumn("_block", F.pmod(F.xxhash64("_node", F.lit(1)), F.col("_blocks")).cast("int")).withColumn("_role", F.lit(2))
    asked = asked.withColumn("_at", F.explode(F.filter(F.sequence(F.lit(1), F.col("_trees") - 1), lambda t: t != F.col("_tree")))).drop("_tree").withColumnRenamed("_at", "_tree")
    second = inside.unionByName(asked)
    more = scratch.keep(_dealt_links(second, ["_shard", "_tree", "_block"], make, read), f"{name}_more")
    return found.unionAll(more)


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, root of every node of the edges (a, b): the smallest node it is connected with.

    Large-star and small-star rounds: each node's neighbours are linked to the smallest of them, until nothing changes.
    Minima are aggregated before they are joined, and joined by the inverted node, for which they are dealt anew: so a node
    with many links is neither a group in memory nor one task's join, as adaptive execution can split what a join alone
    deals. Rounds end when the number of edges and the sum of their hashes stay.
    """
    edges, turn = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0
    edges = scratch.keep(edges, "star0")
    state = lambda t: t.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    def joined(rows: DataFrame, minima: DataFrame) -> DataFrame:
        return rows.withColumn("_k", F.bitwise_not("a")).join(minima.select(F.bitwise_not("a").alias("_k"), "m"), "_k").drop("_k")

    before = state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = joined(both.filter("b > a"), both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = scratch.keep(large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), f"large{turn}")
        small = joined(large, large.groupBy("a").agg(F.min("b").alias("m")))
        small = small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()
        small = scratch.keep(small, f"star{turn + 1}")
        scratch.drop(f"large{turn}")
        scratch.drop(f"star{turn}")
        edges, turn, after = small, turn + 1, state(small)
        if after == before:
            break
        before = after
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out = scratch.keep(out, name)
    scratch.drop(f"star{turn}")
    return out
