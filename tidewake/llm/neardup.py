"""MinHash near-dedup by a chosen-path similarity join.

Each document is its set of word shingles. Sets that are equal form a class, of which one document
takes part. Independent trees branch the classes: a node picks, by a hash of its own name, one or two
coordinates of the MinHash sketch (1 / threshold on average), and a member goes to the child named by
its value there. Members of nodes small enough are compared exhaustively; larger nodes branch again,
and what is still large at the last level is compared in blocks, so no node is dropped.

Within a node pairs are ruled out by sizes and sketches; of what may link only a spanning forest
leaves the task, so a group of very many near copies costs no row for each pair. The forests of all
trees make clusters, whose members' full sets are read again from their texts. Each is compared with
the first of its cluster; what that does not join meets every other member by pairs of blocks, and
every pair that is not ruled out and not joined already is settled on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .graph import UnionFind

COORDINATES = 64
_FACTORS = np.random.default_rng(99).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes by row and hash, and where each row's begin)."""
    for a, b, buffer, offsets in common.text_blocks(column):
        starts, ends, first = common.word_bounds(buffer, offsets, common.SPACES)
        words = common.word_hashes(buffer, starts, ends, fold_case=True)
        n_words = np.diff(first)
        doc = np.repeat(np.arange(b - a), n_words)
        shingles = common.window_hashes(words, width, seed=3)
        fits = np.arange(len(shingles)) + width <= first[doc[: len(shingles)] + 1]
        hashes, owner = [shingles[fits]], [doc[: len(shingles)][fits]]
        for n in range(1, width):  # too few words: all of them are the one shingle
            few = np.flatnonzero(n_words == n)
            if len(few):
                hashes.append(common.window_hashes(words, n, seed=1000 + n)[first[few]])
                owner.append(few)
        h, d = np.concatenate(hashes), np.concatenate(owner)
        key = (d.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
        order = np.argsort(key)
        key, h, d = key[order], h[order], d[order]
        if b - a > 1 << 20 or ((key[1:] == key[:-1]) & (h[1:] < h[:-1])).any():  # the upper bits alone don't tell some hashes apart
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        yield a, b, h, np.searchsorted(d, np.arange(b - a + 1))


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (128 bits that tell sets apart) and sketch of each document."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, at in _sets(batch.column("text"), width):
                n = np.diff(at)
                full = np.flatnonzero(n)
                f1, f2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                sketch = np.zeros((b - a, COORDINATES), np.uint32)
                if len(full):
                    f1[full] = np.add.reduceat(h, at[full])
                    f2[full] = np.add.reduceat(common.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[full])
                    for k, factor in enumerate(_FACTORS):
                        sketch[full, k] = np.minimum.reduceat(h * factor, at[full]) >> np.uint64(32)
                rows = sketch.astype("<u4")
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "n_shingles": pa.array(n, pa.int64()),
                        "f1": pa.array(f1.view(np.int64), pa.int64()),
                        "f2": pa.array(f2.view(np.int64), pa.int64()),
                        "sketch": pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * COORDINATES), b - a, [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary()),
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(profile, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


def _mixed(*parts: int) -> int:
    x = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            x = common.mix(np.array([(int(x) * 31 + p) & ((1 << 64) - 1)], np.uint64))[0]
    return int(x)


def paths(classes: DataFrame, trees: int, depth: int, more: float) -> DataFrame:
    """rep and its nodes n1 .. n_depth, for each path of each tree (paths share their first nodes).

    A node takes one coordinate of the sketch, and with probability `more` a second one, both by a
    hash of its name.
    """

    def branch(nodes: np.ndarray, rows: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the parent and name of each child."""
        pick = common.mix(nodes ^ np.uint64(0xC0FFEE))
        twice = np.flatnonzero((pick >> np.uint64(40)).astype(np.float64) / (1 << 24) < more)
        parent = np.concatenate([np.arange(len(nodes)), twice])
        nth = np.concatenate([np.zeros(len(nodes), np.int64), np.ones(len(twice), np.int64)])
        first = (pick & np.uint64(0xFFFF)).astype(np.int64) % COORDINATES
        step = 1 + ((pick >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64) % (COORDINATES - 1)
        coordinate = (first[parent] + nth * step[parent]) % COORDINATES
        value = sketch[rows[parent], coordinate].astype(np.uint64)
        name = common.mix(common.mix(nodes[parent] + coordinate.astype(np.uint64) + np.uint64(1)) ^ (value * np.uint64(0x9E3779B97F4A7C15)))
        return parent, name

    names = [f"n{k + 1}" for k in range(depth)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u4").reshape(-1, COORDINATES)
            reps = np.asarray(batch.column("rep"))
            for tree in range(trees):
                rows = np.arange(len(reps))
                nodes = np.full(len(reps), _mixed(tree, 77), np.uint64)
                held: list[np.ndarray] = []
                for _ in range(depth):
                    parent, nodes = branch(nodes, rows, sketch)
                    rows, held = rows[parent], [*(x[parent] for x in held), nodes]
                yield pa.record_batch([pa.array(reps[rows]), *(pa.array(x.view(np.int64)) for x in held)], ["rep", *names])

    return classes.select("rep", "sketch").mapInArrow(walk, "rep long, " + ", ".join(f"{n} long" for n in names))


def members(classes: DataFrame, trees: int, depth: int, more: float, small: int) -> DataFrame:
    """node, rep and size: the members of nodes of at most `small`, or of the last level, with company."""
    every = paths(classes, trees, depth, more)
    found = None
    for k in range(1, depth + 1):
        node = f"n{k}"
        rest = [f"n{j}" for j in range(k + 1, depth + 1)]
        here = every.select("rep", node).distinct()
        sizes = here.groupBy(node).agg(F.count("*").alias("size")).filter("size > 1")
        # Only nodes with company go on, so what is written shrinks to the documents that share tokens.
        with_size = common.materialize(common.join_skewed(every, sizes, node), f"level{k}")
        leaf = with_size.filter(F.col("size") <= small) if k < depth else with_size
        leaf = leaf.select(F.col(node).alias("node"), "rep", "size").distinct()
        found = leaf if found is None else found.unionByName(leaf)
        every = with_size.filter(F.col("size") > small).select("rep", *rest)
    return found


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _may_link(matches: np.ndarray, n1: np.ndarray, n2: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a pair is not ruled out: by its sizes for certain, by its sketches, six deviations off, with a chance of under 1 in 1,000,000."""
    spread = 6 * np.sqrt(threshold * (1 - threshold) / COORDINATES)
    return (matches >= (threshold - spread) * COORDINATES) & (np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9)


def _by_key(rows: DataFrame, keys: list[str], compare, schema: str) -> DataFrame:
    """compare(table) for the rows of each key, one key at a time; rows stream through, sorted by key."""
    tasks = common.shuffle_partitions(rows.sparkSession)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in keys], 1)
            cuts = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1, [len(values)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = tuple(values[a])
                if held and key != last:
                    yield compare(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield compare(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def _pairs_of_blocks(rows: DataFrame, key: str, blocks) -> DataFrame:
    """rows of each key dealt to `blocks` blocks, a copy for each pair i <= j of them: two blocks meet once."""
    mine = F.pmod(F.xxhash64("rep", key), F.col("blocks")).cast("int")
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: t.cast("int")))
    dealt = rows.withColumn("blocks", blocks.cast("int")).withColumn("mine", mine).withColumn("other", other)
    return dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other", "blocks")


def _one(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks())


def _forest(rep: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """A link from each row to the root of its tree."""
    below = np.flatnonzero(root != np.arange(len(root)))
    return pa.record_batch([pa.array(rep[below], pa.int64()), pa.array(rep[root[below]], pa.int64())], ["a", "b"])


def candidates(members_: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links a, b that keep together whatever may link within a node: at most one for each member.

    members_: node, rep, size, n, s. Nodes larger than a block are compared by pairs of blocks.
    """
    dealt = _pairs_of_blocks(members_, "node", F.ceil(F.col("size") / block)).select("node", "i", "j", "mine", "rep", "n", "s")

    def compare(table: pa.Table) -> pa.RecordBatch:
        rep, n, mine = _one(table, "rep"), _one(table, "n"), _one(table, "mine")
        s = _bytes(table.column("s").combine_chunks())
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sets = UnionFind(len(rep))
        step = max(1, (1 << 22) // (len(rep) * COORDINATES))
        for at in range(0, len(rep), step):
            end = min(at + step, len(rep))
            same = (s[at:end, None, :] == s[None, :, :]).sum(2, dtype=np.int32)
            keep = _may_link(same, n[at:end, None], n[None, :], threshold)
            if not within:
                keep &= mine[at:end, None] != mine[None, :]
            p, q = np.nonzero(keep)
            sets.join(at + p, q)
        return _forest(rep, sets.root)

    return _by_key(dealt, ["node", "i", "j"], compare, "a long, b long")


def _with_sets(docs: DataFrame, clusters: DataFrame, width: int) -> DataFrame:
    """clusters (rep, cluster, n, s and more) with the full set of each member, read again from its text.

    A doc_id with several texts takes part with each of them; a cluster's text may also stand under it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    held = rows.join(clusters, "rep")
    kept = held.drop("text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [k for k, c in enumerate(batch.schema.names) if c != "text"]
            for a, b, h, at in _sets(batch.column("text"), width):
                sets = [np.sort(h[x:y]).astype("<u8").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                parts = [batch.column(k).slice(a, b - a) for k in others]
                yield pa.record_batch([*parts, pa.array(sets, pa.binary())], [*(batch.schema.names[k] for k in others), "set"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return held.select(*kept.columns, "text").mapInArrow(gather, f"{schema}, `set` binary").filter("length(`set`) > 0")


def _linker(table: pa.Table, percent: int):
    """Number of members, and a function that gives which of some members link with one."""
    s = _bytes(table.column("s").combine_chunks())
    raw = table.column("set").combine_chunks()
    _, ends = common.utf8(raw)
    ends //= 8
    n = np.diff(ends)
    _, codes = np.unique(np.frombuffer(b"".join(raw.to_pylist()), "<u8"), return_inverse=True)
    flags = np.zeros(int(codes.max(initial=0)) + 1, np.int32)

    def linked(x: int, ys: np.ndarray) -> np.ndarray:
        ys = ys[_may_link((s[x] == s[ys]).sum(1), n[x], n[ys], percent / 100)]
        if not len(ys):
            return ys
        mine_codes = codes[ends[x] : ends[x + 1]]
        flags[mine_codes] = 1
        firsts = np.cumsum(n[ys]) - n[ys]
        both = np.add.reduceat(flags[codes[common.ranges(ends[ys], n[ys])]], firsts)
        flags[mine_codes] = 0
        return ys[100 * both >= percent * (n[x] + n[ys] - both)]

    return len(n), linked


def first_links(docs: DataFrame, clusters: DataFrame, width: int, percent: int, star: int) -> DataFrame:
    """rep, cluster, linked: whether a member links with its cluster's first one, whose set goes to every `star` members."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    found = common.join_skewed(_with_sets(docs, clusters, width), sizes, "cluster")
    blocks = F.ceil(F.col("size") / star).cast("int")
    mine = F.array(F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    every = F.sequence(F.lit(0), blocks - 1)
    dealt = found.withColumn("i", F.explode(F.when(F.col("rep") == F.col("cluster"), every).otherwise(mine))).select("cluster", "i", "rep", "s", "set")

    def compare(table: pa.Table) -> pa.RecordBatch:
        rep, cluster = _one(table, "rep"), table.column("cluster")[0].as_py()
        n, linked = _linker(table, percent)
        met = np.zeros(n, bool)
        others = np.flatnonzero(rep != cluster)
        for x in np.flatnonzero(rep == cluster).tolist():
            met[linked(x, others)] = True
        return pa.record_batch([pa.array(rep[others], pa.int64()), pa.array([cluster] * len(others), pa.int64()), pa.array(met[others])], ["rep", "cluster", "linked"])

    rows = _by_key(dealt, ["cluster", "i"], compare, "rep long, cluster long, linked boolean")
    return common.materialize(rows.groupBy("rep", "cluster").agg(F.bool_or("linked").alias("linked")), "first-links")


def confirmed(docs: DataFrame, clusters: DataFrame, width: int, percent: int, block_bytes: int, star: int) -> DataFrame:
    """Links a, b on the full sets, that keep together whatever links within a cluster.

    clusters: rep, cluster, n, s. First every member is compared with the first one of its cluster,
    which joins most near copies at a cost in proportion to them. The rest of each cluster is then
    compared with each other and with all that were joined, by pairs of blocks of at most `star`
    members or block_bytes of sets. Members already joined are not compared again, all others are:
    nothing is left out.
    """
    first = first_links(docs, clusters, width, percent, star)
    links = first.filter("linked").select(F.col("rep").alias("a"), F.col("cluster").alias("b"))
    # Clusters of two are settled by the first comparison.
    rest = first.filter("not linked").select("rep", "cluster", F.lit(True).alias("rest"))
    loads = clusters.join(rest, ["rep", "cluster"], "left").groupBy("cluster").agg(
        F.count("*").alias("size"), F.count("rest").alias("n_rest"), (8 * F.sum(F.when(F.col("rest"), F.col("n")))).alias("load_rest"), (8 * F.sum(F.when(F.col("rest").isNull(), F.col("n")))).alias("load")
    )
    blocks = lambda n, load: F.greatest(F.ceil(n / star), F.ceil(F.coalesce(load, F.lit(0)) / block_bytes), F.lit(1)).cast("int")
    loads = loads.filter("size > 2 and n_rest > 0").select("cluster", blocks(F.col("n_rest"), F.col("load_rest")).alias("r"), blocks(F.col("size") - F.col("n_rest"), F.col("load")).alias("j"))
    open_ = clusters.join(loads, "cluster").join(rest, ["rep", "cluster"], "left")
    found = _with_sets(docs, open_.select("rep", "cluster", "n", "s", "r", "j", F.coalesce("rest", F.lit(False)).alias("rest")), width)
    # Blocks of the rest come first, those of joined members after them; two of the latter never meet.
    mine = F.when(F.col("rest"), F.pmod(F.xxhash64("rep"), F.col("r"))).otherwise(F.col("r") + F.pmod(F.xxhash64("rep"), F.col("j"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("r") + F.col("j")).otherwise(F.col("r")) - 1))
    dealt = found.withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "rest", "s", "set")

    def compare(table: pa.Table) -> pa.RecordBatch:
        rep, mine, is_rest = _one(table, "rep"), _one(table, "mine"), np.array(table.column("rest").combine_chunks())
        n, linked = _linker(table, percent)
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sets = UnionFind(n)
        joined = np.flatnonzero(~is_rest)
        sets.join(joined[1:], np.repeat(joined[:1], max(len(joined) - 1, 0)))
        for x in np.flatnonzero(is_rest).tolist():
            apart = sets.root != sets.root[x]
            if not within:
                apart &= mine != mine[x]
            ys = np.flatnonzero(apart)
            if len(ys):
                ys = linked(x, ys)
                sets.join(np.full(len(ys), x), ys)
        return _forest(rep, sets.root)

    return links.unionByName(_by_key(dealt, ["cluster", "i", "j"], compare, "a long, b long"))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, trees: int = 10, depth: int = 3, small: int = 256, block: int = 1024, block_bytes: int = 32 << 20, star: int = 512
) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept.

    docs: doc_id, text; other columns are ignored. Words are runs of anything but ASCII white space,
    A-Z lower-cased; a set holds distinct shingles of `width` words, or the whole sequence where
    there are fewer words. Documents link if 100 x intersection >= percent x union; those without
    words or text have empty sets and link with nothing. component_id is the smallest doc_id
    reachable by links and kept marks it. Rows that share a doc_id take part each with its own set;
    where two sets are represented by one doc_id their links are joined. Rows without doc_id link
    with nothing, have no component and are kept. An empty table gives no rows. The rows are written
    to the shared folder; what they were made of is deleted.

    A pair at the threshold shares the node of a tree's first level with a chance of `percent` in
    100 or more and one of the last level with its power of `depth` or more (second coordinates add
    to both), so `trees` independent trees miss it with less than (1 - share) to that power: 1e-7
    at the first level and 1e-3 for pairs that stay together in large nodes to the third.
    """
    with common.Scope() as scope:
        return scope.keep(common.materialize(_labelled(docs, width, percent, trees, depth, small, block, block_bytes, star), "near-duplicates"))


def _labelled(docs: DataFrame, width: int, percent: int, trees: int, depth: int, small: int, block: int, block_bytes: int, star: int) -> DataFrame:
    threshold = percent / 100
    made = common.materialize(profiles(docs, width), "profiles")
    classes = (
        made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("n_shingles", "f1", "f2")
        .agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    )
    classes = common.materialize(classes, "classes")
    nodes = members(classes, trees, depth, 1 / threshold - 1, small)

    # For ruling out, the lowest byte of each coordinate is enough.
    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(x.as_buffer(), np.uint8)[::4].tobytes() for x in batch.column("sketch")]
            yield pa.record_batch([batch.column("rep"), batch.column("n_shingles"), pa.array(low, pa.binary())], ["rep", "n", "s"])

    slim = classes.select("rep", "n_shingles", "sketch").mapInArrow(narrow, "rep long, n long, s binary")
    held = common.materialize(nodes.join(slim, "rep"), "members")

    together = graph.components(candidates(held, threshold, block))
    clusters = common.materialize(together.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(slim, "rep"), "clusters")
    final = graph.components(confirmed(docs, clusters, width, percent, block_bytes, star))

    reps = classes.select("n_shingles", "f1", "f2", "rep").join(final, F.col("rep") == F.col("node"), "left")
    reps = reps.select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = made.select("doc_id", "n_shingles", "f1", "f2").join(reps, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
