"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, distributed components.

Vectors are compared only inside a label. They travel with their codes to each table's bucket, in the width of the input (floats stay floats):
buckets are compared in place, as sending candidate pairs would send a vector for each of them. Equal vectors of a label are one class (so a hot vector is one row); each
table deals the classes by their sign bits, a bucket above ``bucket_size`` is cut and every piece meets every other, and the
cosines of a bucket are computed in double precision in blocks. A pair met in several tables counts in the first.
The number of bits follows the largest label's count and the number of tables follows the bits, so that the chance to miss a pair at
the threshold stays below ``miss`` at any size.

Defined cases: null labels, and vectors that are null, zero, or hold null or non-finite components, link with nothing; vectors
of different lengths don't link; an empty table gives no rows; other columns are ignored, whatever their names. Rows with null or
repeated vec_ids count as rows of their class: a component without any vec_id has a null component_id, and rows whose
vec_id equals it (also both null) are kept, as they can't be told apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_map, by_groups, group_number, stage
from strandlake.llm.components import connected_components
from strandlake.llm.simhash import smallest_labels


def table_plan(largest: int, threshold: float, miss: float = 1e-5, per_bucket: int = 64) -> tuple[int, int]:
    """(bits of a table, tables) for labels of at most ``largest`` classes."""
    bits = max(6, math.ceil(math.log2(max(largest, 1) / per_bucket)))
    same = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(miss) / math.log1p(-(same**bits)))


def _packed(kind: str):
    """vec_id, embedding, label -> vec_id, label, vec: the components as bytes of ``kind``, or null if it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.array([], dtype=kind) if values is None or label is None or any(v is None for v in values) else np.array(values, dtype=kind)
                out.append((x + x.dtype.type(0)).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)  # + 0: no negative zero
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])

    return run


def _unit(vecs: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), dtype=kind).astype(np.float64).reshape(len(vecs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(bits: int, tables: int, seed: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(batch.schema.get_field_index("vec")).to_pylist()
            codes = np.zeros((len(vecs), tables), dtype=np.int64)
            for size in {len(v) for v in vecs}:
                own = [i for i, v in enumerate(vecs) if len(v) == size]
                planes = np.random.default_rng([seed, size]).standard_normal((size // np.dtype(kind).itemsize, bits * tables))
                signs = (_unit([vecs[i] for i in own], kind) @ planes > 0).reshape(len(own), tables, bits)
                codes[own] = signs @ (1 << np.arange(bits, dtype=np.int64))
            packed = [c.astype(np.uint32).tobytes() for c in codes]
            yield pa.record_batch([*batch.columns, pa.array(packed, pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))], names=[*batch.schema.names, "codes", "code"])

    return run


def _link(threshold: float, kind: str, block: int = 512):
    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes, sizes, sides, at = (table[x].to_numpy() for x in ("node", "size", "side", "tab"))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if high - low < 2:
                continue
            order = low + np.argsort(nodes[low:high], kind="stable")
            x = _unit(table["vec"].slice(low, high - low).take(pa.array(order - low)).to_pylist(), kind)
            codes = np.frombuffer(b"".join(table["codes"].slice(low, high - low).take(pa.array(order - low)).to_pylist()), dtype=np.uint32).reshape(len(x), -1)
            node, size, side, tab = nodes[order], sizes[order], sides[order], int(at[low])
            links = np.zeros(len(x), dtype=np.int64)
            left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
            found = []
            for i in range(0, len(left), block):
                for j in range(0, len(right), block):
                    a, b = left[i : i + block], right[j : j + block]
                    p, q = np.nonzero(x[a] @ x[b].T >= threshold)
                    p, q = a[p], b[q]
                    keep = p < q if side[0] == 0 else p != q
                    p, q = p[keep], q[keep]
                    if tab:
                        first = ~(codes[p, :tab] == codes[q, :tab]).any(axis=1)
                        p, q = p[first], q[first]
                    links += np.bincount(p, weights=size[q], minlength=len(x)).astype(np.int64) + np.bincount(q, weights=size[p], minlength=len(x)).astype(np.int64)
                    label = smallest_labels(len(x), iter([(p, q)]))  # a forest of the block's links
                    moved = np.flatnonzero(label != np.arange(len(x)))
                    found.append((moved, label[moved]))
            if links.any():
                label = smallest_labels(len(x), iter(found))
                met = np.flatnonzero(links > 0)
                yield pa.record_batch([pa.array(node[met]), pa.array(node[label[met]]), pa.array(links[met])], names=["node", "to", "links"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, bucket_size: int = 1024, seed: int = 5) -> DataFrame:
    """The result of the query: vec_id, n_links, component_id, kept."""
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = stage(arrow_map(rows, _packed(kind), "vec_id long, label string, vec binary"), "embed-rows")
    classes = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("size"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "embed-classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = table_plan(largest, threshold)
    coded = stage(arrow_map(classes.drop("low"), _codes(bits, tables, seed, kind), "label string, vec binary, size long, node long, codes binary, code array<long>"), "embed-codes")
    length = F.octet_length("vec").alias("length")
    counts = stage(coded.select("label", length, F.posexplode("code").alias("tab", "bucket")).groupBy("label", "length", "tab", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "embed-buckets")
    cut = coded.select("label", length, "vec", "node", "size", "codes", F.posexplode("code").alias("tab", "bucket")).join(counts, ["label", "length", "tab", "bucket"])
    cut = cut.withColumn("pieces", F.ceil(F.col("n") / bucket_size).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = cut.select("label", "length", "tab", "bucket", low.alias("a"), high.alias("b"), (low * F.col("pieces") + high).cast("long").alias("pair"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "node", "size", "vec", "codes")
    found = by_groups(dealt, ["label", "length", "tab", "bucket", "a", "b"], _link(threshold, kind), "node long, to long, links long", group_number(F.col("pair"), "label", "length", "tab", "bucket"))
    edges = stage(found, "embed-links")
    parts = stage(connected_components(edges.select(F.col("node").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "member"), "embed-parts")
    links = edges.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(parts, F.col("node") == F.col("member"), "left").withColumn("part", F.coalesce("component", "node"))
    lows = named.groupBy("part").agg(F.min("low").alias("component_id"))
    named = stage(named.join(lows, "part").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"), "embed-named")
    linked = rows.where("vec is not null").join(named, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
