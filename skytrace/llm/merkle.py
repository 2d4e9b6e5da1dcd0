"""A Merkle manifest of a dataset, by time-forward processing (operator 12).

A row's leaf is the digest of its fields. The leaves of a key, in order, are the lowest level of its tree; every
``FAN`` consecutive nodes of a level become the digest of their hex digests, until one is left: the key's
subroot. The subroots, in the order of the keys, are the leaves of the tree above, which ends in the root.

* Nodes are labelled (level, index), and a digest is a message to its parent's label. In a chunk of ``FAN ** LEVELS``
  nodes a priority queue ordered by label delivers the messages (``_forward``). Chunk tops are nodes of a level
  further up; between rounds Spark's sort by label, which spills to disk, is the external part of the queue.
  Rounds number a third of the levels.
* The reversed sweep starts at the root: each chunk gets the proof suffix of its top, and hands every member
  the siblings on its way followed by that suffix (``_backward``).
* Leaves are ranked by a range partitioned sort and one count per (partition, key). A key with most of the
  rows is cut into chunks like any other; no task or group holds more than a chunk of a key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.llm.tasks import stored

FAN = 8
LEVELS = 3  # of a chunk
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROWS = 1000  # of a batch


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts end to end."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return digest(*map(field, values))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, start, lambda acc, step: digest(step["left"], acc, step["right"]))


def _join(digests) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _forward(first: int, members: list[str], levels: int) -> dict[tuple[int, int], str]:
    """Digests of a chunk's nodes by label; ``first`` is the index of the first member."""
    queue = [(0, first + i, d) for i, d in enumerate(members)]
    nodes, run = {}, []
    while queue:
        level, index, value = heapq.heappop(queue)
        nodes[level, index] = value
        if level == levels:
            continue
        run.append(value)
        if index % FAN == FAN - 1 or not queue or queue[0][:2] != (level, index + 1):
            heapq.heappush(queue, (level + 1, index // FAN, _join(run)))
            run = []
    return nodes


def _backward(nodes: dict[tuple[int, int], str], levels: int, suffix: list[tuple[str, str]]) -> dict[int, list[tuple[str, str]]]:
    """Proof of each member of a chunk whose top has the proof ``suffix``."""
    proofs = {}
    for level, index in sorted(nodes, reverse=True):
        if level == levels:
            proofs[level, index] = suffix
            continue
        start = index - index % FAN
        run = [nodes.get((level, k), "") for k in range(start, start + FAN)]
        at = index - start
        proofs[level, index] = [("".join(run[:at]), "".join(run[at + 1 :])), *proofs[level + 1, index // FAN]]
    return {index: proof for (level, index), proof in proofs.items() if level == 0}


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves(key, order..., digest)`` with ``index`` in their key's order and the key's number of leaves ``n``.

    Equal rows are interchangeable; the row's position in the input spreads them over partitions.
    """
    by = [c for c in leaves.columns if c not in ("key", "digest")][:1]
    order = ["key", *by, "digest", "at"]
    sorted_ = leaves.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(sorted_.drop("at").withColumn("place", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("place", 33).alias("part")
    counts = stored(rows.groupBy("key", part).agg(F.min("place").alias("least"), F.count("*").alias("c")), "counts")
    # one row for each key and partition that meet
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy("key")))
    rows = rows.withColumn("part", F.shiftright("place", 33)).join(counts.drop("c"), ["key", "part"])
    return rows.withColumn("index", F.col("place") - F.col("least") + F.col("before")).drop("place", "part", "least", "before")


def _chunks(rows: DataFrame, schema: str, work) -> DataFrame:
    """``work(key, members)`` over the rows of each (key, chunk), in the order of ``index``; it yields tuples."""
    names = [x.split()[0] for x in schema.split(", ")]
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([(n, pa.string() if k == "string" else pa.int64()) if k != PROOF else (n, _PROOF) for n, k in (x.split(" ", 1) for x in schema.split(", "))])
        every = (dict(zip(columns, row, strict=True)) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = []
        for (key, _), members in groupby(every, key=lambda r: (r["key"], r["chunk"])):
            for row in work(key, members):
                held.append(row)
                if len(held) == _ROWS:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], target)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], target)

    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "index").mapInArrow(run, schema)


PROOF = "array<struct<left:string,right:string>>"
_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _with_chunk(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk", F.floor(F.col("index") / FAN**LEVELS).cast("long"))


def _climb(placed: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of nodes at the chunks' lowest levels, and the tops ``(key, digest)``."""
    most = placed.agg(F.max("n")).first()[0] or 0
    tables = [placed.select("key", "index", "n", "digest")]

    def up(key, members):
        rows = list(members)
        n, first = rows[0]["n"], rows[0]["index"]
        levels = min(LEVELS, height(n))
        nodes = _forward(first, [r["digest"] for r in rows], levels)
        yield key, first // FAN**levels, -(-n // FAN**levels), nodes[levels, first // FAN**levels]

    for _ in range(max(1, -(-height(most) // LEVELS))):
        tables.append(stored(_chunks(_with_chunk(tables[-1]), "key string, index long, n long, digest string", up), "nodes"))
    return tables[:-1], tables[-1].select("key", "digest")


def _descend(rows: DataFrame, tops: DataFrame, carried: list[str]) -> DataFrame:
    """``rows(key, index, n, digest, ...)`` with their proofs, from those of their chunks' tops ``(key, chunk, proof)``.

    Columns ``carried`` come from the tops, the other columns are the rows' own.
    """
    own = [c for c in rows.columns if c not in ("key", "index", "n", "digest")]
    empty = lambda frame, names: [F.lit(None).cast(frame.schema[c].dataType).alias(c) for c in names]
    # the chunk's suffix sorts before its members
    marked = tops.select("key", "chunk", F.lit(-1).cast("long").alias("index"), F.lit(0).cast("long").alias("n"), F.lit("").alias("digest"), *empty(rows, own), *carried, "proof")
    below = _with_chunk(rows).select("key", "chunk", "index", "n", "digest", *own, *empty(tops, carried), F.lit(None).cast(PROOF).alias("proof"))

    def down(key, members):
        top = next(members)
        rows = list(members)
        suffix = [(x["left"], x["right"]) for x in top["proof"]]
        levels = min(LEVELS, height(rows[0]["n"]))
        nodes = _forward(rows[0]["index"], [r["digest"] for r in rows], levels)
        proofs = _backward(nodes, levels, suffix)
        for r in rows:
            proof = [{"left": a, "right": b} for a, b in proofs[r["index"]]]
            yield (key, r["index"], r["digest"], *(r[c] for c in own), *(top[c] for c in carried), proof)

    kinds = [f"{c} {f.schema[c].dataType.simpleString()}".replace("bigint", "long") for f, names in ((rows, own), (tops, carried)) for c in names]
    return _chunks(marked.unionByName(below), ", ".join(["key string", "index long", "digest string", *kinds, f"proof {PROOF}"]), down)


def _tree(placed: DataFrame, tops: DataFrame, tables: list[DataFrame], carried: list[str]) -> DataFrame:
    """``placed`` with proofs, from the proofs of the tops ``(key, proof)``."""
    tops = tops.withColumn("chunk", F.lit(0).cast("long"))
    for table in reversed(tables[1:]):
        below = _descend(table, tops, carried)
        tops = below.select("key", F.col("index").alias("chunk"), *carried, "proof")
    return _descend(placed, tops, carried)


def manifest(docs: DataFrame, key: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, keep: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every row of ``docs``.

    Columns: ``order`` as a long, ``leaf``, ``subroot``, ``root``, ``proof`` (from the leaf's level to the root: the hex digests of
    the run's other members, left of it and right of it), and strings ``keep``, computed from the row. A key's
    leaves ascend by ``order``, nulls first, ties by digest; keys ascend by their bytes, null first. Null fields, empty
    and long texts and repeated rows have leaves like any other; other columns are ignored; an empty table gives none.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # sorts null first
    extra = {f"kept_{c}": v for c, v in (keep or {}).items()}
    leaves = docs.select(named.alias("key"), F.col(order).cast("long").alias("id"), leaf([F.col(c) for c in fields]).alias("digest"), *(v.cast("string").alias(c) for c, v in extra.items()))
    placed = _placed(stored(leaves, "leaves"))
    tables, subroots = _climb(placed)
    roots = _placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"))
    root_tables, root = _climb(roots)
    whole = root.select("key", F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"))
    subtrees = stored(_tree(roots, whole, root_tables, ["root"]), "subtrees")
    tops = subtrees.select(F.col("name").alias("key"), F.col("digest").alias("subroot"), "root", "proof")
    found = _tree(placed, tops, tables, ["subroot", "root"])
    return found.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col(c).alias(c.removeprefix("kept_")) for c in extra))


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def verified(docs: DataFrame) -> DataFrame:
    """The manifest checked after tampering: ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``.

    Where 3 divides the CRC-32 of the decimal doc_id the text is lower-cased before its leaf is folded with
    the original proof; a null doc_id is never tampered with. Odd rows: see :func:`manifest`.
    """
    changed = [lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0, leaf(changed))
    found = manifest(docs, keep={"tampered": tampered})
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 8, key_levels: int = 3) -> str:
    """The same for DuckDB, for up to ``FAN ** levels`` rows of a key and ``FAN ** key_levels`` keys.

    Each level is a table expression ``a<level>`` or ``b<level>``; ``as<level>`` and ``bs<level>`` are its runs.
    """

    def tree(name: str, base: str, levels: int) -> list[str]:
        out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM ({base}))"]
        for v in range(levels):
            out.append(f"{name}s{v} AS (SELECT k, i // 8 AS g, n, list(d ORDER BY i) AS ds FROM {name}{v} GROUP BY k, i // 8, n)")
            out.append(f"{name}{v + 1} AS (SELECT k, g AS i, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d, (n + 7) // 8 AS n FROM {name}s{v})")
        return out

    def leaf_of(text: str) -> str:
        parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
        return "sha256(" + " || ".join(parts) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    table = (
        "list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), "
        "lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
    )
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), "
        "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
    )
    ctes = [
        f"crc AS (SELECT {table} AS t)",
        f"leaves AS (SELECT coalesce('=' || lang, '') AS k, doc_id, {leaf_of('text')} AS d, CASE WHEN {crc} % 3 = 0 THEN {leaf_of(lower)} END AS tampered FROM documents, crc)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM leaves)",
        *tree("a", "SELECT k, i, d FROM placed", levels),
        f"tops AS (SELECT k, d, row_number() OVER (ORDER BY encode(k)) - 1 AS i FROM a{levels})",
        *tree("b", "SELECT '' AS k, i, d FROM tops", key_levels),
        f"way0 AS (SELECT x.*, y.d AS subroot, y.i AS j, z.d AS root, coalesce(tampered, x.d) AS folded, '' AS proof FROM placed x JOIN tops y USING (k) CROSS JOIN b{key_levels} z)",
    ]
    # up the levels of both trees: the siblings on each, and the digest folded so far
    steps = [(f"as{v}", "s.k = w.k", "i", v) for v in range(levels)] + [(f"bs{v}", "true", "j", v) for v in range(key_levels)]
    for number, (runs, same, index, v) in enumerate(steps):
        at = f"({index} // {8**v} % 8)"
        ctes.append(
            f"step{number} AS (SELECT w.*, n, CASE WHEN n > 1 THEN array_to_string(ds[:{at}], '') END AS l, CASE WHEN n > 1 THEN array_to_string(ds[{at} + 2:], '') END AS r "
            f"FROM way{number} w JOIN {runs} s ON {same} AND s.g = {index} // {8 ** (v + 1)})"
        )
        ctes.append(
            f"way{number + 1} AS (SELECT * EXCLUDE (n, l, r) REPLACE (coalesce(sha256(l || folded || r), folded) AS folded, proof || coalesce(l || r, '') AS proof) FROM step{number})"
        )
    return (
        "WITH " + ",\n".join(ctes)
        + f"\nSELECT doc_id, d AS leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM way{len(steps)}"
    )


OP12_SQL = _sql()
