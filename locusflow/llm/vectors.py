"""Near-duplicate vectors by product quantisation with coarse inverted lists.

Equal vectors are collapsed first; one representative each goes on.  On unit vectors,
cosine >= t means a distance of at most r = sqrt(2 - 2 t).  Coarse centroids and
residual codebooks are fitted on a bounded sample; every vector is indexed: its list
(nearest centroid), its residual's subspace codes and the length of what the codes
miss.  A vector probes every list c that can hold a neighbour: since a neighbour in c
is nearer to c than to the vector's own centroid o, the vector lies within r of the
plane between them, d(x,c)^2 - d(x,o)^2 <= 2 r |c - o|; and it lies within r of the
list's farthest vector from c.  Lists grow in number with the square root of the rows
of the largest label, so that a list grows no faster than that.  Inside a list,
asymmetric distances by table lookup give d^; a neighbour has d^ <= r + miss.  What
passes is reranked by exact cosine in double precision.  All bounds are sufficient, so
no link is lost to quantisation, whatever the sample.

Lists are compared in blocks of bounded size (chunks of a list against chunks of its
probing vectors), so a hot label or list spreads over tasks.  A block returns counts
and a spanning forest of its links, never all pairs of a cluster.

Defined results: null, empty or zero vectors and ones with null or non-finite parts
link with nothing, as do null labels and vectors of different lengths; equal vectors
are linked; repeated rows count as vectors of their own; a null id has a null
component; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, table

THRESHOLD = 0.98
#: Vectors of the fitting sample, at most; subspaces and codes per subspace, at most.
TRAIN, SUBSPACES, CODES = 20_000, 8, 256
_BLOCK = 2048
_EPS = 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's centroids, started from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    square = (c * c).sum(1)[None, :]
    return np.concatenate([np.zeros(0, np.int64), *(np.argmin(square - 2 * x[s: s + 2048] @ c.T, axis=1) for s in range(0, len(x), 2048))])


def list_count(rows: int, sample: int) -> int:
    """Coarse lists for labels of so many rows, as far as the sample can place them."""
    return int(max(1, min(2 * np.sqrt(rows), sample // 16)))


class Quantiser:
    """Coarse centroids and residual codebooks, fitted on the rows of ``x``."""

    def __init__(self, x: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES):
        self.coarse = kmeans(x, lists)
        self.between = np.sqrt(np.maximum(0, (self.coarse**2).sum(1)[:, None] + (self.coarse**2).sum(1)[None, :] - 2 * self.coarse @ self.coarse.T))
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.parts = [p for p in np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1])) if len(p)]
        self.books = [kmeans(rest[:, p], max(1, min(codes, len(x) // 16))) for p in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, missed length and distance from the list's centroid of every row."""
        own = nearest(x, self.coarse)
        rest = x - self.coarse[own]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1)
        miss = sum(((rest[:, p] - b[codes[:, i]]) ** 2).sum(1) for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)))
        return own, codes.astype(np.uint8), np.sqrt(miss), np.sqrt((rest**2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float, reach: np.ndarray) -> np.ndarray:
        """For every row and list whether the list, whose vectors lie within ``reach`` of its
        centroid, can hold a neighbour."""
        far = np.maximum(0, (x * x).sum(1)[:, None] + (self.coarse**2).sum(1)[None, :] - 2 * x @ self.coarse.T)
        plane = far - far[np.arange(len(x)), own][:, None] <= 2 * radius * self.between[own] + 1e-6
        return plane & (np.sqrt(far) <= reach[None, :] + radius + 1e-6)

    def distances(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of the rows of ``x`` to coded vectors of one list, by a table
        for each subspace of the codes that occur."""
        rest = x - self.coarse[which]
        total = (rest**2).sum(1)[:, None]
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            used, at = np.unique(codes[:, i], return_inverse=True)
            table_ = (b[used] ** 2).sum(1)[None, :] - 2 * rest[:, p] @ b[used].T
            total = total + table_[:, at]
        return np.sqrt(np.maximum(total, 0))


def _unit(column: pa.Array, width: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float64)
    return flat.reshape(-1, width)


def _encode(quantiser, width: int):
    def run(batches):
        for batch in batches:
            own, codes, miss, far = quantiser.value.encode(_unit(batch.column("x"), width))
            more = [pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(miss), pa.array(far)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "list", "codes", "miss", "far"])
    return run


def _probes(quantiser, reach, width: int, radius: float):
    """A row for each list that a vector probes."""
    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                row, which = np.nonzero(quantiser.value.probes(_unit(part.column("x"), width), part.column("list").to_numpy(), radius, reach.value))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("label", "dim", "rep", "copies", "x")), pa.array(which.astype(np.int32))], names=["label", "dim", "rep", "copies", "x", "list"])
    return run


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of the components of a bipartite block of links."""
    ids, inverse = np.unique(np.r_[left, right], return_inverse=True)
    a, b = inverse[: len(left)], inverse[len(left):]
    root = np.arange(len(ids))
    i, j = np.nonzero(linked)
    while True:
        low = np.minimum(root[a[i]], root[b[j]])
        after = root.copy()
        np.minimum.at(after, a[i], low)
        np.minimum.at(after, b[j], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    return [(int(ids[k]), int(ids[root[k]])) for k in np.unique(np.r_[a[i], b[j]])]


def _links(quantiser, width: int, radius: float, threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        q = quantiser.value
        probe = rows.column("probe").to_numpy()
        ids, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        x = _unit(rows.column("x"), width)
        at, ask = np.flatnonzero(probe == 0), np.flatnonzero(probe == 1)
        out = {"vec": [], "links": [], "root": []}
        if len(at) and len(ask):
            codes = np.frombuffer(b"".join(rows.column("codes").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
            miss, which = rows.column("miss").to_numpy()[at], int(rows.column("list")[0].as_py())
            linked = np.zeros((len(ask), len(at)), bool)
            for s in range(0, len(ask), 128):
                own = ask[s: s + 128]
                near = q.distances(x[own], which, codes) <= radius + miss[None, :] + 1e-6
                i, j = np.nonzero(near & (ids[own][:, None] != ids[at][None, :]))
                exact = np.einsum("ij,ij->i", x[own[i]], x[at[j]]) >= threshold
                linked[s + i[exact], j[exact]] = True
            for k, n in zip(ids[ask], linked @ copies[at], strict=True):
                if n:
                    out["vec"].append(int(k))
                    out["links"].append(int(n))
                    out["root"].append(int(k))
            for node, root in forest(linked, ids[ask], ids[at]):
                if node != root:
                    out["vec"].append(node)
                    out["links"].append(0)
                    out["root"].append(root)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})
    return run


def vector_components(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _EPS
    v = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    all_rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda e: F.coalesce((F.abs(e) < float("inf")) & ~F.isnan(e), F.lit(False)))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda e: e != 0), F.lit(False))
    all_rows = all_rows.withColumn("ok", usable).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    key = ["label", "h1", "h2"]
    classes = all_rows.where("ok").groupBy(*key).agg(F.min(F.struct("vec_id", "v")).alias("m"), F.count("*").alias("copies"))
    classes = scratch.save(classes.select(*key, F.col("m.vec_id").alias("rep"), F.col("m.v").alias("v"), F.size("m.v").alias("dim"), "copies"))
    width = classes.agg(F.max("dim")).first()[0]
    found = None
    if width:
        def unit(batches):
            for batch in batches:
                out = []
                for e in batch.column("v").to_pylist():
                    x = np.zeros(width)
                    x[: len(e)] = e
                    x /= np.abs(x).max()
                    out.append((x / np.sqrt(x @ x)).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "dim", "rep", "copies")), pa.array(out, pa.binary())], names=["label", "dim", "rep", "copies", "x"])

        label = classes.schema["label"].dataType.simpleString()
        units = scratch.save(classes.select("label", "dim", "rep", "copies", "v").mapInArrow(unit, f"label {label}, dim int, rep long, copies long, x binary"))
        sample = units.orderBy(F.xxhash64("rep"), "rep").limit(TRAIN).select("x").collect()
        sample = np.frombuffer(b"".join(r.x for r in sample), np.float64).reshape(-1, width)
        largest = units.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        lists = list_count(largest, len(sample))
        quantiser = spark.sparkContext.broadcast(Quantiser(sample, lists))
        cells = ["label", "dim", "list"]
        unit_columns = f"label {label}, dim int, rep long, copies long, x binary, list int"
        held = scratch.save(units.mapInArrow(_encode(quantiser, width), f"{unit_columns}, codes binary, miss double, far double"))
        reach = np.full(lists, -np.inf)
        for r in held.groupBy("list").agg(F.max("far").alias("far")).collect():  # a row per list
            reach[r.list] = r.far
        reach = spark.sparkContext.broadcast(reach)
        asking = held.select("label", "dim", "rep", "copies", "x", "list").mapInArrow(_probes(quantiser, reach, width, radius), unit_columns)
        none = lambda kind: F.lit(None).cast(kind)
        coded = scratch.save(held.drop("far").withColumn("probe", F.lit(0)).unionByName(asking.withColumns({"codes": none("binary"), "miss": none("double"), "probe": F.lit(1)})))
        sizes = coded.groupBy(*cells).agg(F.ceil(F.count_if(F.col("probe") == 0) / _BLOCK).cast("int").alias("held"), F.ceil(F.count_if(F.col("probe") == 1) / _BLOCK).cast("int").alias("asking")).where("held > 0 AND asking > 0")
        own, other = F.when(F.col("probe") == 0, F.col("held")).otherwise(F.col("asking")), F.when(F.col("probe") == 0, F.col("asking")).otherwise(F.col("held"))
        dealt = coded.join(sizes, cells).withColumn("mine", F.pmod(F.xxhash64("rep"), own).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), other - 1)))
        block = F.when(F.col("probe") == 0, F.struct("mine", "theirs")).otherwise(F.struct(F.col("theirs").alias("mine"), F.col("mine").alias("theirs")))
        links = _links(quantiser, width, radius, threshold)
        found = scratch.save(dealt.withColumn("block", block).select(*cells, "rep", "copies", "x", "probe", "codes", "miss", F.col("block.mine").alias("b1"), F.col("block.theirs").alias("b2"))
                             .groupBy(*cells, "b1", "b2").applyInArrow(lambda rows: links(rows), "vec long, links long, root long"))
    if found is None:
        found = spark.createDataFrame([], "vec long, links long, root long")
    comp = components(spark, found.select(F.col("vec").alias("src"), F.col("root").alias("dst")), scratch)
    counts = found.groupBy("vec").agg(F.sum("links").alias("links"))
    known = classes.join(counts, classes["rep"] == counts["vec"], "left").join(comp, classes["rep"] == comp["node"], "left").select(
        *key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("ok"))
    out = all_rows.select("vec_id", *key, "ok").join(known, [*key, "ok"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND list_aggregate(list_transform(e, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.i, a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.i <> b.i AND a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.i = v.i
"""
