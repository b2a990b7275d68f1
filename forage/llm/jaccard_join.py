"""Exact Jaccard join of word shingle sets, as a join in a metric space.

1 - Jaccard is a metric.  Documents become sets of five-word shingles, named by
64-bit hashes; equal sets are one *node*.  Nodes are linked when their
similarity is at least ``SIMILARITY``, and links make components.

Coarse regions.  Most sets share nothing, and there a pivot tells nothing: all
distances are 1.  So nodes first meet by rare shingles: two sets within the
distance must share one of the first ``first_tokens`` shingles of either, in
any fixed order of all shingles (here: frequent ones last, others by hash).
Pairs that share too few of them for the similarity are not near; the rest
connect nodes to coarse regions that no link leaves.

Fine regions.  A coarse region that fits one task is joined there.  A larger
one gets pivots: a node within ``CORE`` of a pivot belongs to the Voronoi
region of its nearest one.  By the triangle inequality, whatever is near a node
of the region lies within ``CORE`` and the threshold of the pivot, so nodes in
that window are copied into the region and joined there.  Nodes far from all
pivots are joined among themselves at the next level with new pivots.  A region
that stays too large is split into blocks that are joined pairwise.

Every step is exact; the result does not depend on which pivots were drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forage.llm import scan
from forage.llm.components import components
from forage.llm.frames import set_aside
from forage.session import cut

WIDTH = 5
#: Linked from 75 shared shingles in 100 of the union.
SIMILARITY = 0.75
#: A shingle in more nodes is ordered last.
FREQUENT = 32
#: Shingles kept beyond the needed ones, to make up for frequent ones among them.
SPARE = 24
#: Nodes that one task joins; more are spread by pivots.
REGION = 2048
PIVOTS = 16
#: A node within this distance of its nearest pivot belongs to that pivot's region.
CORE = 0.5
ALL = 1 << 30


def first_tokens(n):
    """Shingles of a set of n of which a near set must share one."""
    return n - (3 * n + 3) // 4 + 1


def _slice_sets(part: scan.Slice) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text; a text of one to four words is one shingle."""
    starts, ends, bounds = part.spans(scan.NON_BLANK[part.data])
    words = part.hashes(part.prefix(True), starts, ends)
    keys, at = scan.shingle_hashes(words, bounds, WIDTH)
    edge = np.searchsorted(at, bounds)
    for i in range(len(bounds) - 1):
        size = bounds[i + 1] - bounds[i]
        if 0 < size < WIDTH:
            value = scan.shingle_hashes(words[bounds[i] : bounds[i + 1]], np.array([0, size]), int(size))[0]
            yield scan.mix(value + np.uint64(size))
        else:
            yield np.unique(keys[edge[i] : edge[i + 1]])


def _node(tokens: np.ndarray) -> int:
    """A name of the set that does not depend on the order in which it is read."""
    with np.errstate(over="ignore"):
        total = scan.mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens)) * np.uint64(0x9E3779B97F4A7C15)
    return int(scan.mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


_LONGS = pa.list_(pa.int64())


def sets(docs: DataFrame, spare: int, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, node, n and the ``n_kept`` smallest shingles: the needed ones and ``spare`` more.

    A task gives the shingles of a node once; further copies have null there.
    With ``wanted`` (node), only those nodes come back, once per task.  Which
    texts may be wanted is first asked of a table of fixed size.
    """
    maybe = None
    if wanted is not None:
        maybe = np.zeros(_CELLS, dtype=bool)
        cells = wanted.select(F.shiftrightunsigned("node", 64 - _CELL_BITS).alias("cell")).distinct().toPandas()["cell"].to_numpy()
        maybe[cells.astype(np.int64)] = True
        maybe = docs.sparkSession.sparkContext.broadcast(np.packbits(maybe))

    def run(batches):
        seen = set()
        cells = None if maybe is None else np.unpackbits(maybe.value).astype(bool)
        for batch in batches:
            ids = batch.column("doc_id")
            for part in scan.slices(batch.column("text")):
                rows = []
                for row, tokens in enumerate(_slice_sets(part), part.first):
                    node = _node(tokens) if len(tokens) else None
                    fresh = node is not None and node not in seen
                    if cells is not None and (not fresh or not cells[(node & (2**64 - 1)) >> (64 - _CELL_BITS)]):
                        continue
                    seen.add(node)
                    keep = min(len(tokens), first_tokens(len(tokens)) + spare)
                    rows.append((row, node, len(tokens), tokens[:keep].view(np.int64) if fresh else None))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], _LONGS),
                ], ["doc_id", "node", "n", "tokens"])

    kind = docs.schema["doc_id"]
    schema = T.StructType([kind, T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])
    found = docs.select("doc_id", "text").mapInArrow(run, schema)
    if wanted is None:
        return found
    once = found.join(wanted.select("node").distinct(), "node", "left_semi")
    return once.groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


_CELL_BITS = 20
_CELLS = 1 << _CELL_BITS


def _enough(shared: str, a: str, b: str):
    """Can sets of these sizes be near, sharing so many of their first shingles?"""
    need = F.ceil((F.col(a) + F.col(b)) * 3 / 7)
    most = F.greatest(a, b)
    near_size = 4 * F.least(a, b) >= 3 * most
    return near_size & (F.col(shared) >= need - F.ceil(most * 3 / 4) + 1)


def _pairs(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
    """Pairs of nodes that meet in shingles, and in how many; ``ordered``: both sides are the same table."""
    right = right.withColumnsRenamed({c: f"{c}_b" for c in right.columns if c != "token"})
    condition = F.col("node") < F.col("node_b") if ordered else F.col("node") != F.col("node_b")
    carried = [c for c in left.columns if c not in ("token", "node")]
    keys = ["node", "node_b", *carried, *[f"{c}_b" for c in carried]]
    return left.join(right, "token").filter(condition).groupBy(*keys).agg(F.count("*").alias("shared")).withColumnsRenamed({"node": "a", "node_b": "b"})


def candidates(docs: DataFrame, base: DataFrame) -> DataFrame:
    """Edges a, b of the coarse regions."""
    nodes = base.filter("tokens is not null").select("node", "n", "tokens")
    spread = nodes.select("node", "n", F.explode("tokens").alias("token"))
    counts = spread.groupBy("token").agg(F.count("*").alias("n_rows"), F.min("node").alias("low"), F.max("node").alias("high"))
    shared = cut(counts.filter("low != high").select("token", "n_rows"), "shared")
    frequent = shared.filter(F.col("n_rows") > FREQUENT).select("token")

    # Nodes that keep too few shingles apart from frequent ones need all of theirs.
    lost = spread.join(frequent, "token", "left_semi").select("node", "token").distinct().groupBy("node").agg(F.count("*").alias("lost"))
    sizes = nodes.select("node", "n", F.size("tokens").alias("kept")).distinct()
    n = F.col("n")
    needed = n - F.ceil(n * 3 / 4) + 1
    short = cut(sizes.join(lost, "node").filter(F.col("kept") - F.col("lost") < needed).select("node"), "short")
    full = cut(sets(docs, ALL, short), "full").select("node", "n", F.explode("tokens").alias("token"))

    usable = shared.select("token").union(full.select("token")).distinct().join(frequent, "token", "left_anti")
    plain = spread.join(short, "node", "left_anti").join(usable, "token", "left_semi").distinct()
    plain = cut(plain, "plain")
    rare = full.join(frequent, "token", "left_anti")
    among = _pairs(plain, plain, True).filter(_enough("shared", "n", "n_b"))
    between = _pairs(plain, rare, False).filter(_enough("shared", "n", "n_b"))
    found = among.select("a", "b").union(between.select("a", "b"))

    # Nodes made of frequent shingles have an order of their own, the rarest among them first.
    ranks = full.groupBy("token").agg(F.count("*").alias("df"))
    own = Window.partitionBy("node")
    ordered = full.join(ranks, "token").withColumn("place", F.row_number().over(own.orderBy("df", "token"))).filter(F.col("place") <= needed)
    crowded = F.count(F.when(F.col("df") > FREQUENT, 1)).over(own)
    first = cut(ordered.withColumn("crowded", crowded).select("node", "n", "crowded", "df", "token"), "first")
    alone = first.filter(F.col("df") <= FREQUENT).drop("df")
    inner = _pairs(alone, alone, True).withColumn("shared", F.col("shared") + F.least("crowded", "crowded_b")).filter(_enough("shared", "n", "n_b"))
    # Whatever shares one of the others goes to one region, without listing its pairs.
    crowd = first.filter(F.col("df") > FREQUENT)
    leaders = crowd.groupBy("token").agg(F.min("node").alias("a"))
    stars = crowd.join(leaders, "token").filter("node != a").select("a", F.col("node").alias("b"))
    return found.union(inner.select("a", "b")).union(stars).distinct()


def _near(sizes: np.ndarray, tokens: list[np.ndarray]) -> np.ndarray:
    """Which sets of a region are linked, as a square table."""
    count = len(sizes)
    owner = np.repeat(np.arange(count), sizes)
    _, column, seen = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    often = seen[column] > 1
    _, column = np.unique(column[often], return_inverse=True)
    owner = owner[often]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((count, count), dtype=np.float32)
    width = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [at, at + width])
        part = np.zeros((count, width), dtype=np.float32)
        part[owner[low:high], column[low:high] - at] = 1
        shared += part @ part.T
    return 7 * shared >= 3 * (sizes[:, None] + sizes[None, :])


def _labels(near: np.ndarray) -> np.ndarray:
    """Smallest reachable place of each set."""
    label = np.full(len(near), -1)
    for start in range(len(near)):
        if label[start] < 0:
            reached, todo = np.zeros(len(near), dtype=bool), [start]
            reached[start] = True
            while todo:
                fresh = near[todo].any(0) & ~reached
                reached |= fresh
                todo = np.flatnonzero(fresh).tolist()
            label[reached] = start
    return label


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _join_regions(members: DataFrame) -> DataFrame:
    """Edges from every set of a region to the first one that links reach inside the region."""

    def joined(nodes: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in tokens])
        nodes = np.array(nodes)
        label = _labels(_near(sizes, tokens))
        moved = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[moved]]), pa.array(nodes[moved])], ["a", "b"])

    def run(batches):
        region, nodes, tokens = None, [], []
        for batch in batches:
            lists = batch.column("tokens")
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (r, node) in enumerate(zip(batch.column("region").to_pylist(), batch.column("node").to_pylist())):
                if r != region:
                    if len(nodes) > 1:
                        yield joined(nodes, tokens)
                    region, nodes, tokens = r, [], []
                nodes.append(node)
                tokens.append(flat[ends[i] : ends[i + 1]].copy())
        if len(nodes) > 1:
            yield joined(nodes, tokens)

    dealt = members.select("region", "node", "tokens").repartition("region").sortWithinPartitions("region", "node")
    return dealt.mapInArrow(run, EDGE)


MEMBER = T.StructType([T.StructField("region", T.LongType()), T.StructField("node", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])
#: Regions whose pivots are sent out together.
TOGETHER = 64


def _pivot_step(members: DataFrame, regions: list[int], level: int) -> DataFrame:
    """Members of the given large regions, dealt to the Voronoi regions of their pivots."""
    order = Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(level)), "node")
    here = members.filter(F.col("region").isin(regions))
    drawn = here.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS).select("region", "node", "tokens").collect()
    pivots: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in sorted(drawn, key=lambda r: (r.region, r.node)):
        pivots.setdefault(r.region, []).append((r.node, np.sort(np.array(r.tokens, dtype=np.int64))))
    sent = members.sparkSession.sparkContext.broadcast(pivots)
    reach = CORE + 1 - SIMILARITY + 1e-9

    def run(batches):
        for batch in batches:
            regions, rows = [], []
            lists = batch.column("tokens")
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, r in enumerate(batch.column("region").to_pylist()):
                mine = flat[ends[i] : ends[i + 1]]
                far = []
                for _, theirs in sent.value[r]:
                    place = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                    both = int((theirs[place] == mine).sum())
                    far.append(1 - both / (len(mine) + len(theirs) - both))
                home = int(np.argmin(far))
                home = home if far[home] < CORE else -1
                # A window is open towards pivots before one's own; nodes far from all look into every window.
                guest = [k for k, d in enumerate(far) if d <= reach and (home < 0 or k < home)]
                for k in [home, *guest]:
                    name = scan.mix(np.array([r % (1 << 64), k % (1 << 64), level], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    regions.append(int(scan.mix(name[:1] ^ (name[1:2] + name[2:]) * np.uint64(31)).view(np.int64)[0]))
                    rows.append(i)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(regions, pa.int64()), batch.column("node").take(at), lists.take(at)], MEMBER.names)

    return here.select("region", "node", "tokens").mapInArrow(run, MEMBER)


def _blocks(members: DataFrame, sizes: DataFrame, region: int) -> DataFrame:
    """Members of regions that pivots do not divide, dealt to all pairs of blocks of half a region."""
    n = F.ceil(F.col("size") * 2 / region).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.xxhash64("region", F.least(k, own), F.greatest(k, own)))
    return members.join(sizes, "region").select(F.explode(pairs).alias("region"), "node", "tokens")


def links(members: DataFrame, region: int = REGION) -> DataFrame:
    """Edges that connect exactly what links connect; region, node and tokens of the coarse regions are given."""
    found, level = [], 0
    members, parent = members.select("region", "node", "tokens"), None
    while True:
        members = cut(members, "members")
        sizes = cut(members.groupBy("region").agg(F.count("*").alias("size")), "sizes")
        large = sizes.filter(F.col("size") > region)
        found.append(cut(_join_regions(members.join(large, "region", "left_anti")), "links"))
        most = large.agg(F.sum("size"), F.count("*")).first()
        if not most[0]:
            break
        if parent is not None and most[0] > 0.8 * parent:
            found.append(cut(_join_regions(_blocks(members, large, region)), "links"))
            break
        level, parent = level + 1, most[0]
        names = [r.region for r in large.select("region").toLocalIterator()]
        steps = [_pivot_step(members, names[k : k + TOGETHER], level) for k in range(0, len(names), TOGETHER)]
        members = steps[0]
        for step in steps[1:]:
            members = members.union(step)
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def join(docs: DataFrame, region: int = REGION) -> DataFrame:
    """doc_id, node, n_shingles and component_id of every row.

    Texts without words (null ones too) have no node and are linked with
    nothing: their component is their own doc_id.  Copies share a node; repeated
    rows come back repeated.  A null doc_id counts only where no other is there.
    """
    base = cut(sets(docs, SPARE), "sets")
    edges = cut(candidates(docs, base), "candidates")
    coarse = cut(components(edges).select("node", F.col("label").alias("region")), "coarse")
    members = sets(docs, ALL, coarse).join(coarse, "node").select("region", "node", "tokens")
    label = components(links(members, region))
    smallest = base.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named = smallest.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_node = named.filter("node != label").select("node", "label").join(whole, "label").select("node", "component_id")
    of_node = of_node.union(named.filter("node = label").join(whole, "label").select("node", "component_id"))
    rows = base.select("doc_id", "node", F.col("n").alias("n_shingles"))
    return rows.join(of_node, "node", "left").select("doc_id", "node", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.

    Rows that repeat a kept doc_id and its text count once.  Rows without a
    doc_id stay, because nothing tells them apart.
    """
    kept = join(docs.select("doc_id", "text")).filter("doc_id = component_id").select("doc_id").distinct()
    given, names = set_aside(docs, "_again")
    found = given.filter("doc_id is not null").join(kept, "doc_id", "left_semi")
    again = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    found = found.withColumn("_again", again).filter("_again = 1").select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])
    return docs.filter("doc_id is null").unionByName(found)
