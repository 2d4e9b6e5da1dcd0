"""Near-duplicate classes by chosen-path set similarity join (operator 1).

A document is the set of its distinct ``width``-word shingles. Every set gets 128 minwise values.
In each of ``TREES`` independent trees a node picks one coordinate, and with probability
1/threshold - 1 a second; its documents go to the child of their minwise value there. So two sets
at the threshold meet on average in one child per node, down every level. Nodes of up to ``LEAF``
documents are compared exhaustively; larger ones branch on. Comparison first drops pairs whose
minwise agreement lies four deviations under the threshold, then intersects the full sets.

Scale and skew:

* Equal sets are one class before the join, by a map-side combined aggregate. Copies never meet.
* The first ``FIRST`` trees run before the others. A node whose documents are one component of confirmed
  links already has nothing to find, so it ends before signatures or texts are fetched for it: the
  other trees cost what is still in question. Only (node, document, component) ids are shuffled for all
  documents. Nodes with the same members are compared once, and so are candidate groups.
* A task searches a group from one document to those not reached yet, so a family of near copies takes
  few steps, and its result is a star: one row per document at most.
* A node over ``LEAF`` is dealt into blocks, each with the node's pivot, so a family of near copies
  becomes one component without its pairs being listed. It branches on until its members are one
  component of links confirmed on the texts; agreeing signatures alone don't end it. Once at most
  ``OTHERS`` documents are outside its largest component, these meet the rest block by block. A node of up to
  ``WHOLE`` leaves is one group, whose signatures a task holds, and pairs of such groups are what is left beyond
  ``DEPTH`` levels: no pair is given up for a node's size.
* Only documents that agree with one of another component go on to the texts, so a family that is linked
  already isn't listed again by each node that holds it. Subgroups of more than ``VOLUME`` shingles are confirmed by pairs of blocks.
* Tables of a level are deleted once the next one is stored. Groups are worked on, and tables written, by a few
  tasks a core, or as many as the sets have splits, whatever the number of shuffle partitions: many steps are small.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.components import components
from skytrace.llm.tasks import fixed_bytes, likely, long_keys, map_groups, stored, task_limit, to_binary
from skytrace.llm.textbytes import mix, shingle_sets, slices, word_hashes
from skytrace.session import discard

SIZE = 128  # minwise values per set
TREES = 10
FIRST = 2  # trees that run before the others
LEAF = 1024
OTHERS = 256  # documents outside a node's largest component that are compared with all of it
WHOLE = 4  # times ``LEAF``: a node of so many documents that is still open is compared as one group, without further levels
VOLUME = 1 << 21  # shingles whose texts are held at once to confirm links
DEPTH = 6
_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(found: np.ndarray) -> np.ndarray:
    least = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 2048):
        np.minimum(least, (_FACTORS[:, None] * found[None, k : k + 2048]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def shingle_signatures(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, n_shingles, f1, f2, signature)``; f1 and f2 identify the set, the signature is null if empty."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, first = word_hashes(part.column("text"))
                n = np.zeros(part.num_rows, np.int64)
                f1, f2 = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
                signature = np.zeros((part.num_rows, SIZE), np.uint32)
                for i, found in enumerate(shingle_sets(words, first, width)):
                    if len(found):
                        n[i], f1[i] = len(found), found.sum(dtype=np.uint64)
                        f2[i] = np.bitwise_xor.reduce(found * _FACTORS[0])
                        signature[i] = _signature(found)
                packed = to_binary(signature)
                packed = pa.compute.if_else(pa.array(n > 0), packed, pa.scalar(None, packed.type))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(long_keys(f1)), pa.array(long_keys(f2)), packed],
                    ["doc_id", "n_shingles", "f1", "f2", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, signature binary"
    )


def _branch(rows: DataFrame, percent: int) -> DataFrame:
    """Children of each row's node: ``(node, doc, part)``."""
    extra = 100 / percent - 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = fixed_bytes(batch.column("signature"), 4 * SIZE).view(np.uint32)
            doc, part = batch.column("doc").to_numpy(), batch.column("part").to_numpy()
            parent = batch.column("node").to_numpy().view(np.uint64)
            one, two, chance = (mix(parent + np.uint64(k)) for k in (11, 12, 13))
            twice = np.flatnonzero(chance / 2.0**64 < extra)
            own = np.concatenate((np.arange(len(doc)), twice))
            at = np.concatenate((one, two[twice])) % np.uint64(SIZE)
            child = mix(mix(parent[own] + at + np.uint64(17)) ^ sig[own, at.astype(np.int64)].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(long_keys(child)), pa.array(doc[own]), pa.array(part[own])], ["node", "doc", "part"])

    return rows.select("node", "doc", "part", "signature").mapInArrow(run, "node long, doc long, part long")


def _picks(percent: int, trees: int) -> list[tuple[int, int]]:
    """Tree and coordinate of all roots. The trees' first coordinates differ."""
    rng = np.random.default_rng(7)
    first = [int(rng.permutation(SIZE)[0]) if trees > SIZE else int(x) for x in rng.permutation(SIZE)[:trees]]
    return [*enumerate(first), *((t, int(rng.integers(SIZE))) for t in range(trees) if rng.random() < 100 / percent - 1)]


def _roots(sets: DataFrame, picks: list[tuple[int, int]]) -> DataFrame:
    """First level of trees: ``(node, doc, part)``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = fixed_bytes(batch.column("signature"), 4 * SIZE).view(np.uint32)
            n = len(sig)
            node = np.concatenate([mix(mix(np.full(n, t * SIZE + c + 1, np.uint64)) ^ sig[:, c].astype(np.uint64)) for t, c in picks])
            doc, part = (np.tile(batch.column(c).to_numpy(), len(picks)) for c in ("doc", "part"))
            yield pa.RecordBatch.from_arrays([pa.array(long_keys(node)), pa.array(doc), pa.array(part)], ["node", "doc", "part"])

    return sets.select("doc", "part", "signature").mapInArrow(run, "node long, doc long, part long")


def _portions(n: np.ndarray) -> list[np.ndarray]:
    """Rows ``0..len(n)`` as one portion, or, if they have over ``VOLUME`` shingles, as all pairs of smaller blocks."""
    if n.sum() <= VOLUME:
        return [np.arange(len(n))]
    block = np.unique((np.cumsum(n) - n) // (VOLUME // 2), return_inverse=True)[1]
    return [np.flatnonzero((block == x) | (block == y)) for x, y in combinations(range(block.max() + 1), 2)]


def _candidates(groups: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Members of each ``(group, doc)`` that may have a link to another component there, as ``(sub, doc)``; equal subgroups get equal names."""
    near = (percent / 100 - 4 * np.sqrt(percent / 100 * (1 - percent / 100) / SIZE)) * SIZE

    def work(table: pa.Table, bounds: np.ndarray):
        low = fixed_bytes(table.column("low"), SIZE)
        n, doc, part = (table.column(c).to_numpy() for c in ("n_shingles", "doc", "part"))
        size = np.diff(bounds)
        rows, names = [], []

        def may(i, j):
            return (part[i] != part[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))

        def alike(i, j):
            return (low[i] == low[j]).sum(1) >= near

        two = bounds[:-1][size == 2]
        two = two[may(two, two + 1)]
        two = two[alike(two, two + 1)]
        if len(two):
            rows.append(np.stack((two, two + 1), 1).ravel())
            names.append(np.repeat(mix(doc[two].view(np.uint64)) + mix(doc[two + 1].view(np.uint64)) + np.uint64(2), 2))
        for g in np.flatnonzero(size > 2):
            left = np.arange(bounds[g], bounds[g + 1])
            while len(left) > 1:
                reached, left, k = [left[0]], left[1:], 0
                while k < len(reached) and len(left):
                    hit = np.flatnonzero(may(left, reached[k]))
                    if len(hit) and len(hit := hit[alike(left[hit], reached[k])]):
                        reached.extend(left[hit])
                        left = np.delete(left, hit)
                    k += 1
                if len(reached) > 1:
                    found = np.array(reached)
                    found = found[np.unique(doc[found], return_index=True)[1]]
                    for index in (found[x] for x in _portions(n[found])):
                        rows.append(index)
                        names.append(np.full(len(index), mix(doc[index].view(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(index))))
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(long_keys(np.concatenate(names))), pa.array(doc[np.concatenate(rows)])], ["sub", "doc"])

    members = _with_part(groups.join(sets.select("doc", "n_shingles", "low"), "doc"), labels)
    return map_groups(members, "group", work, "sub long, doc long", tasks).distinct()


def _stars(sets: list[np.ndarray], doc: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Each member of a component with its smallest: every set is searched from one already reached."""
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int32)
    left = np.flatnonzero(size)
    flat = ids  # the sets of ``left``, end to end
    links = []
    while len(left) > 1:
        reached, flat, left, k = [left[0]], flat[size[left[0]] :], left[1:], 0
        while k < len(reached) and len(left):
            i, k = reached[k], k + 1
            own = ids[ends[i] - size[i] : ends[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], np.cumsum(size[left]) - size[left])
            mark[own] = 0
            hit = 100 * both >= percent * (size[i] + size[left] - both)
            if hit.any():
                reached.extend(left[hit])
                flat, left = flat[np.repeat(~hit, size[left])], left[~hit]
        members = doc[np.array(reached)]
        links.extend((int(u), int(members.min())) for u in members if u != members.min())
    return links


def _confirmed(subs: DataFrame, texts: DataFrame, width: int, percent: int, tasks: int) -> DataFrame:
    """Components ``(u, v)`` within each subgroup, v the smallest, by links exact on the full sets."""

    def work(table: pa.Table, bounds: np.ndarray):
        u, v = [], []
        begin = 0
        sizes = np.cumsum(pa.compute.binary_length(table.column("text")).fill_null(0).to_numpy())
        while begin < len(bounds) - 1:  # groups with about 8 MB of text at a time
            base = sizes[bounds[begin] - 1] if bounds[begin] else 0
            end = max(begin + 1, int(np.searchsorted(sizes[bounds[1:] - 1], base + (8 << 20), "right")))
            part = table.slice(bounds[begin], bounds[end] - bounds[begin])
            doc = part.column("doc").to_numpy()
            words, first = word_hashes(part.column("text"))
            found = list(shingle_sets(words, first, width))
            for a, b in zip(bounds[begin:end] - bounds[begin], bounds[begin + 1 : end + 1] - bounds[begin], strict=True):
                for i, j in _stars(found[a:b], doc[a:b], percent):
                    u.append(i)
                    v.append(j)
            begin = end
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    members = subs.select("sub", "doc").join(texts, "doc")
    return map_groups(members, "sub", work, "u long, v long", tasks)


def _nodes(rows: DataFrame) -> DataFrame:
    """``(node, n, h1, h2)`` of the nodes that hold several components; h1 and h2 identify the members."""
    nodes = rows.groupBy("node").agg(
        F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"),
        F.bit_xor(F.xxhash64("doc")).alias("h1"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("h2"),
    )
    return nodes.where("lo < hi").select("node", "n", "h1", "h2")


def _once(nodes: DataFrame) -> DataFrame:
    """One of the nodes with the same members."""
    return nodes.groupBy("n", "h1", "h2").agg(F.min("node").alias("node")).select("node")


def _dealt(large: DataFrame) -> DataFrame:
    """Blocks ``(group, doc)`` of large nodes, each with the node's pivot."""
    order = F.xxhash64("node", "doc")
    pivots = large.groupBy("node").agg(F.min_by("doc", order).alias("doc"), F.ceil(F.first("n") / LEAF).alias("k"))
    pivots = pivots.select("node", "doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("b"))
    own = large.select("node", "doc", F.pmod(order, F.ceil(F.col("n") / LEAF)).alias("b"))
    return own.unionByName(pivots).select(F.xxhash64("node", "b").alias("group"), "doc")


def _in_blocks(large: DataFrame) -> DataFrame:
    """All pairs of blocks of each node: the exact way for what never became small."""
    own = large.withColumn("k", F.ceil(F.col("n") / (WHOLE * LEAF // 2))).withColumn("b", F.pmod(F.xxhash64("doc", "node"), F.col("k")))
    met = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return met.select(F.xxhash64("node", F.least("b", "o"), F.greatest("b", "o")).alias("group"), "doc")


def _with_part(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``part``, the component of doc."""
    named = rows.join(labels.withColumnRenamed("id", "doc"), "doc", "left")
    return named.withColumn("part", F.coalesce("component", "doc")).drop("component")


def _apart(large: DataFrame) -> DataFrame:
    """Rows of ``large(node, doc, part)`` in nodes with several components of confirmed links.

    With the node's size ``n``, its largest component ``main`` and that one's size ``most``.
    """
    sizes = large.groupBy("node", "part").agg(F.count("*").alias("n")).groupBy("node").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("part", F.struct("n", "part")).alias("main")
    )
    return large.join(sizes.where("n > most"), "node")


def _met(few: DataFrame) -> DataFrame:
    """Blocks ``(group, doc)`` of nodes, each with all rows outside the largest component."""
    few = few.withColumn("k", F.ceil(F.col("n") / LEAF))
    inside = few.where("part = main").withColumn("b", F.pmod(F.xxhash64("doc", "node"), F.col("k")))
    outside = few.where("part <> main").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return inside.unionByName(outside).select(F.xxhash64("node", "b").alias("group"), "doc")


class _Search:
    """Confirmed links so far, as components; each candidate group is read once."""

    def __init__(self, sets: DataFrame, texts: DataFrame, width: int, percent: int, links: DataFrame):
        self.sets, self.texts, self.width, self.percent = sets, texts, width, percent
        self.tasks = task_limit(sets)
        self.done, self.labels = None, components(links, self.tasks)

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        return stored(df, label, tasks=self.tasks)

    def compare(self, groups: DataFrame) -> None:
        subs = self.stored(_candidates(groups, self.sets, self.labels, self.percent, self.tasks), "candidates")
        fresh = subs
        if self.done is not None:
            # stored, so that the join with the texts knows how few they are before it shuffles any text
            fresh = self.stored(subs.join(self.done, "sub", "left_anti"), "fresh")
            if fresh.isEmpty():
                self.done = self.done.unionByName(subs.select("sub").distinct())
                return
        # most texts are in no open group: they are left out before the join, which shuffles the rest
        texts = likely(self.texts, "doc", fresh.select("doc"))
        links = self.stored(_confirmed(fresh, texts, self.width, self.percent, self.tasks), "confirmed")
        names = subs.select("sub").distinct()
        self.done = names if self.done is None else self.done.unionByName(names)
        if links.isEmpty():
            discard(links)
            return
        before, self.labels = self.labels, components(links.unionByName(self.labels.select(F.col("id").alias("u"), F.col("component").alias("v"))), self.tasks)
        discard(before)
        discard(links)

    def search(self, picks: list[tuple[int, int]]) -> None:
        """All levels of the trees with these roots."""
        rows = self.stored(_roots(_with_part(self.sets.select("doc", "signature"), self.labels), picks), "nodes")
        for level in range(DEPTH + 1):
            nodes = self.stored(_nodes(rows), "sizes")
            small = rows.join(_once(nodes.where(F.col("n") <= LEAF)), "node", "left_semi").select(F.col("node").alias("group"), "doc")
            big = nodes.where(F.col("n") > LEAF)
            if big.isEmpty():
                self.compare(small)
                discard(rows)
                discard(nodes)
                return
            large = self.stored(rows.join(big.select("node", "n"), "node").select("node", "doc", "n"), "large")
            self.compare(small.unionByName(_dealt(large.join(_once(big), "node", "left_semi"))))
            discard(rows)
            apart = self.stored(_apart(_with_part(large.drop("n"), self.labels)), "apart")
            if apart.isEmpty():
                return
            beyond = F.col("n") - F.col("most") > OTHERS
            met, rest = apart.where(~beyond), apart.where(beyond)
            whole = rest.where(F.col("n") <= WHOLE * LEAF).join(_once(big), "node", "left_semi")
            last = _met(met).unionByName(whole.select(F.col("node").alias("group"), "doc"))
            if not last.isEmpty():
                self.compare(last)
            rest = rest.where(F.col("n") > WHOLE * LEAF)
            if rest.isEmpty():
                return
            if level < DEPTH:
                rest = rest.join(self.sets.select("doc", "signature"), "doc")
                rows = self.stored(_branch(rest, self.percent), "nodes")
            else:
                self.compare(_in_blocks(rest.join(_once(big), "node", "left_semi")))
            for table in (large, nodes, apart):
                discard(table)


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, trees: int = TREES) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs(doc_id, text, ...)``.

    Two documents are linked if ``100 * common >= percent * union`` of their shingle sets.
    ``component_id`` is the smallest doc_id reachable over links, ``kept`` says it is the row's own.
    Null or wordless texts have no shingles and no link. Repeated rows and rows that share a doc_id
    are one vertex with the links of all of them, and each is returned. A null doc_id gets its class's
    component, or null. Other columns are ignored; an empty table gives an empty result.
    """
    sets = stored(shingle_signatures(docs, width), "sets")
    key = ["f1", "f2", "n_shingles"]
    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    classes = stored(classes.withColumn("low", _low_bytes(F.col("signature"))), "classes")
    # rows that share a doc_id, with different sets
    shared = full.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    shared = full.join(shared, "doc_id").select("doc_id", *key).join(classes.select(*key, "doc"), key)
    links = stored(shared.select(F.col("doc_id").alias("u"), F.col("doc").alias("v")), "shared")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    job = _Search(classes, texts, width, percent, links)
    picks = _picks(percent, trees)
    for some in ([p for p in picks if p[0] < FIRST], [p for p in picks if p[0] >= FIRST]):
        if some:
            job.search(some)
    named = classes.select(*key, "doc", "copies").join(job.labels.withColumnRenamed("id", "doc"), "doc", "left")
    named = named.withColumn("component", F.coalesce("component", "doc"))
    # only classes of several rows or with a link: the others' rows are their own component
    named = named.where("copies > 1 OR component <> doc").select(*key, "component")
    out = sets.drop("signature").join(named, key, "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _low_bytes(signature):
    """The lowest byte of each of the signature's little-endian values."""
    return F.unhex(F.regexp_replace(F.hex(signature), "(..)......", "$1"))


def one_of_each(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, the one with the smallest doc_id.

    Of rows that share this doc_id one stays, the first by all columns' hash. Rows without a doc_id stay.
    """
    found = near_duplicates(docs, width, percent)
    out = docs.join(found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    shared = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared")
    if shared.isEmpty():
        return out
    once = out.join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"))
    once = once.groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return out.join(shared, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
