"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

A vector is turned by three rounds of random signs and fast Hadamard transform; its hash is the
nearest signed axis.  ``hashes`` such hashes name a bucket of one table.  A vector is stored in
its own bucket and also visits the next most likely ones (multiprobe); a visitor is compared with
what is stored there.  Every pair that meets is verified by its cosine in double precision.

``hashes`` follows the number of vectors (so chance meetings per vector stay bounded) and the number of tables
follows from it: as many as a pair exactly at the threshold needs to meet with probability
``recall``, estimated by simulation for the given dimension.  Pairs closer than that meet more often.

Exact copies are one vector with a count.  A bucket of more than ``CELL`` vectors is cut into
chunks, and each two chunks are a cell of their own, so no task holds a whole hot bucket.  Cells give
link counts and spanning edges, never the pairs: a pair that meets several times is counted
only in the first bucket the two share, which both can tell from their codes.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length are never compared; a null id stays null (its row still links
others, component_id is null if no row of its group has an id); repeated rows are separate
vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, small_batches

THRESHOLD = 0.9
RECALL = 0.998
PROBES = 3
CELL = 1024
OCCUPANCY = 64
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two)."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def width(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def probe_codes(x: np.ndarray, tables: int, hashes: int, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes) bucket codes, the own bucket first."""
    size = width(x.shape[1])
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    rng, row = np.random.default_rng([seed, size]), np.arange(len(x))
    options = min(3, size)
    picks = np.array(np.meshgrid(*[range(options)] * hashes, indexing="ij")).reshape(hashes, -1)
    out = np.empty((len(x), tables, probes), dtype=np.int64)
    for t in range(tables):
        loss = np.zeros((len(x), picks.shape[1]))
        code = np.zeros((len(x), picks.shape[1]), dtype=np.int64)
        for k in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), size))
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :options]
            value = y[row[:, None], best]
            axis = best * 2 + (value < 0)
            gap = (np.abs(value[:, :1]) - np.abs(value)) ** 2
            loss += gap[:, picks[k]]
            code = code * (2 * size) + axis[:, picks[k]]
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t] = code[row[:, None], order]
    return out


def plan(n: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(tables, hashes) for ``n`` vectors of length ``dim``."""
    buckets = 2 * width(dim)
    hashes = max(2, math.ceil(math.log(max(1.0, n / OCCUPANCY)) / math.log(buckets)))
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((4000, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = threshold * x + math.sqrt(1 - threshold ** 2) * z
    a, b = (probe_codes(v, 1, hashes)[:, 0] for v in (x, y))
    meet = (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)
    p = min(max(meet.mean(), 0.01), 0.99)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - p))), hashes


def _vectors(column) -> np.ndarray:
    """A list column of equally long vectors as a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _coded(shapes: dict[int, tuple[int, int]]):
    """Adds the flattened probe codes to (node, n, dim, v) batches of any mix of lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _vectors(part.column("v"))
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                tables, hashes = shapes[int(dim)]
                codes = probe_codes(x, tables, hashes).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("n"), part.column("dim"), part.column("v"),
                     pa.array(list(codes), type=pa.list_(pa.int64()))], ["node", "n", "dim", "v", "codes"])
    return run


def _cell_links(node, n, x, codes, chunk, t, bucket, cross, threshold):
    """Links and spanning edges of one cell: (node, links, root) per vector with a verified pair."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    stored = codes[:, t, 0] == bucket
    close = x @ x.T >= threshold
    close &= stored[:, None] | stored[None, :]
    if cross:
        close &= chunk[:, None] != chunk[None, :]
    i, j = np.nonzero(np.triu(close, 1))
    if not len(i):
        return None
    links = np.zeros(len(node), dtype=np.int64)
    for s in range(0, len(i), 50_000):
        a, b = i[s:s + 50_000], j[s:s + 50_000]
        ca, cb = codes[a], codes[b]
        at_a = (cb == ca[:, :, :1]).any(axis=2)  # b looks into a's own bucket
        at_b = (ca == cb[:, :, :1]).any(axis=2)
        first = np.argmax(at_a | at_b, axis=1)
        r = np.arange(len(a))
        ma, mb = ca[r, first, 0], cb[r, first, 0]
        in_a, in_b = at_a[r, first], at_b[r, first]
        where = np.where(in_a & in_b, np.minimum(ma, mb), np.where(in_a, ma, mb))
        once = (first == t) & (where == bucket)
        np.add.at(links, a[once], n[b[once]])
        np.add.at(links, b[once], n[a[once]])
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.unique(np.concatenate((i, j)))
    return node[some], links[some], node[root[some]]


def _linked(threshold: float):
    """Streams cells in order; a cell may span Arrow batches."""
    def cells(table: pa.Table):
        tables = table.column("tables")[0].as_py()
        x, flat = _vectors(table.column("v")), _vectors_int(table.column("codes"))
        cols = [table.column(c).to_numpy() for c in ("node", "n", "chunk", "t", "bucket", "c1", "c2")]
        node, n, chunk, t, bucket, c1, c2 = cols
        codes = flat.reshape(len(x), tables, -1)
        key = np.stack([t, bucket, c1, c2], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(x)]):
            if b - a > 1:
                got = _cell_links(node[a:b], n[a:b], x[a:b], codes[a:b], chunk[a:b], t[a], bucket[a], c1[a] != c2[a],
                                  threshold)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(g, type=pa.int64()) for g in got], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in ("dim", "t", "bucket", "c1", "c2")]
            same = np.ones(batch.num_rows, dtype=bool)
            for c, v in zip(("dim", "t", "bucket", "c1", "c2"), last):
                same &= batch.column(c).to_numpy() == v
            tail = int(same.sum())  # sorted: the rows of the last cell are the batch's end
            if tail == batch.num_rows and (not held or _same_cell(held[-1], batch)):
                held.append(batch)
                continue
            head = batch.slice(0, batch.num_rows - tail)
            yield from _by_length(held + ([head] if head.num_rows else []), cells)
            held = [batch.slice(batch.num_rows - tail)]
        if held:
            yield from _by_length(held, cells)
    return run


def _same_cell(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a.column(c)[a.num_rows - 1].as_py() == b.column(c)[0].as_py() for c in ("dim", "t", "bucket", "c1", "c2"))


def _vectors_int(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batches, cells):
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    dims = table.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield from cells(table.filter(pa.array(dims == dim)))


def embedding_links(df: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """One row per row: key, n_links, component_id, kept."""
    v = F.col("v")
    usable = (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(
        v, lambda c: c != 0)
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("v", F.when(F.coalesce(v.isNotNull() & usable, F.lit(False)), v))
    rows = materialize(rows, "embeddings")
    distinct = rows.where("v is not null").groupBy("v").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(distinct.withColumn("dim", F.size("v")), "embeddings-distinct")

    shapes = {r["dim"]: plan(r["n"], r["dim"], threshold, recall)
              for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per vector length
    kind = dict(distinct.dtypes)["v"]
    coded = small_batches(distinct).select("node", "n", "dim", "v").mapInArrow(
        _coded(shapes), f"node long, n long, dim int, v {kind}, codes array<long>")
    coded = materialize(coded, "embeddings-codes")
    meets = coded.select("node", "dim", (F.size("codes") / PROBES).cast("int").alias("tables"),
                         F.posexplode("codes").alias("at", "bucket"))
    meets = meets.select("node", "dim", "tables", F.expr(f"at div {PROBES}").cast("int").alias("t"), "bucket",
                         (F.col("at") % PROBES == 0).alias("own"))
    place = ["dim", "t", "bucket"]
    sizes = meets.groupBy(*place).agg(F.count(F.lit(1)).alias("size"), F.count_if("own").alias("stored")).where(
        "size > 1 and stored > 0")
    # Read from files, so that AQE can split the partition of a bucket with very many vectors.
    sizes = materialize(sizes, "embeddings-buckets")
    parts = F.ceil(F.col("size") / F.lit(CELL))
    cells = meets.join(sizes, place).select(*place, "node", "tables", parts.alias("parts"),
                                            F.pmod(F.xxhash64("node"), parts).alias("chunk"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select(*place, "node", "tables", "chunk", F.least("chunk", "other").alias("c1"),
                         F.greatest("chunk", "other").alias("c2"))
    cells = cells.join(coded.select("node", "n", "v", "codes"), "node")
    order = [*place, "c1", "c2"]
    cells = cells.repartition(*order).sortWithinPartitions(*order)
    found = cells.mapInArrow(_linked(threshold), "node long, links long, root long")
    found = materialize(found, "embeddings-links")

    counts = found.groupBy("node").agg(F.sum("links").alias("near"))
    roots = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")), "embeddings-components")
    roots = roots.withColumnRenamed("node", "_node")
    named = (distinct.select("v", "node", "n").join(counts, "node", "left").join(roots, F.col("node") == F.col("_node"), "left")
             .select(F.col("v").alias("_v"), F.coalesce("root", "node").alias("root"),
                     (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    named = materialize(named, "embeddings-named")
    members = rows.where("v is not null").join(named, F.col("v") == F.col("_v")).select("id", "root", "n_links")
    members = materialize(members, "embeddings-members")
    least = members.groupBy("root").agg(F.min("id").alias("component_id")).withColumnRenamed("root", "_root")
    least = materialize(least, "embeddings-least")
    out = members.join(least, F.col("root") == F.col("_root")).select("id", "n_links", "component_id").unionAll(
        rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
