"""Near-duplicate embeddings: int8 tile products with error bounds, then full precision.

Vectors of one label are dealt over chunks, and every pair of chunks is a tile of bounded size.
In a tile each unit vector u is quantised to s*q with whole numbers q of at most 127, and the
length e of what that leaves is known exactly per vector. As u.v = su*sv*(q.p) + r.v + su*q.t
for the rests r and t of u and v, the product of the quantised vectors is off by at most
e(u) + (1 + e(u)) * e(v); only pairs that may reach the threshold are computed again, in double
precision. The products of whole numbers are exact: single precision holds them for 1,024
dimensions at a time.

Equal vectors of a label are one class with its size, so copies cost nothing, and a tile puts
out one row per linked class: the number of vectors it is linked to and the smallest class it
reaches in the tile. Only vectors of the same length are compared.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows without
label or vec_id link with nothing; a row without vec_id has no component and is kept. Repeated
rows are vectors like any other. ``kept`` names one vec_id of each component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwatch.llm.graph import components
from armwatch.session import settled, stored

#: Classes of a chunk; a tile holds two chunks.
CHUNK = 1024
#: Pairs that are computed in double precision at a time.
PAIRS = 16_384
#: Above the rounding of the bounds themselves.
SLACK = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers of at most 127, the scale and the length of the rest, by row."""
    scale = np.abs(unit).max(1) / 127
    whole = np.rint(unit / scale[:, None])
    return whole.astype(np.int8), scale, np.linalg.norm(unit - whole * scale[:, None], axis=1)


def whole_product(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    out = np.zeros((len(q), len(p)))
    for at in range(0, q.shape[1], 1024):
        out += q[:, at:at + 1024].astype(np.float32) @ p[:, at:at + 1024].astype(np.float32).T
    return out


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Whether the rows of x and y (double) reach the threshold; pairs a < b where same."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    q, su, eu = quantised(x / nx[:, None])
    p, sv, ev = quantised(y / ny[:, None])
    upper = whole_product(q, p) * su[:, None] * sv
    upper += eu[:, None] + (1 + eu)[:, None] * ev + SLACK
    maybe = upper >= threshold
    if same:
        maybe &= np.arange(len(x))[:, None] < np.arange(len(y))
    a, b = np.nonzero(maybe)
    for at in range(0, len(a), PAIRS):
        i, j = a[at:at + PAIRS], b[at:at + PAIRS]
        exact = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j])
        maybe[i, j] = exact >= threshold
    return maybe


def reached(linked: np.ndarray, ids: np.ndarray, a: slice, b: slice) -> np.ndarray:
    """The smallest id that each row reaches over the links of a tile."""
    label, none = ids.copy(), np.iinfo(np.int64).max
    while True:
        new = label.copy()
        new[a] = np.minimum(label[a], np.where(linked, label[b], none).min(1, initial=none))
        new[b] = np.minimum(new[b], np.where(linked.T, new[a], none).min(1, initial=none))
        if (new == label).all():
            return label
        label = new


def _tile(threshold: float):
    def links(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[-2].as_py(), key[-1].as_py()
        chunk = group["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        ids, size = group["node"].to_numpy()[order], group["size"].to_numpy()[order]
        vectors = group["embedding"].combine_chunks()
        x = vectors.flatten().to_numpy().astype(np.float64).reshape(len(order), -1)[order]
        first = int((chunk == i).sum())
        a, b = (slice(0, first), slice(0, first)) if i == j else (
            slice(0, first), slice(first, None))
        linked = tile_links(x[a], x[b], threshold, i == j)
        count = np.zeros(len(ids), np.int64)
        count[a] += linked @ size[b]
        count[b] += linked.T @ size[a]
        hit = np.flatnonzero(count)
        up = reached(linked, ids, a, b)
        return pa.table({"node": ids[hit], "links": count[hit], "up": up[hit]})

    return links


def near_duplicates(vectors: DataFrame, threshold: float = 0.98,
                    chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<float>"))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v)
                   & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = rows.where(usable)
    classes = settled(good.groupBy("label", "embedding")
                      .agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
                      .withColumn("node", F.monotonically_increasing_id())
                      .withColumn("length", F.size("embedding")))
    sizes = stored(classes.groupBy("label", "length").agg(
        F.ceil(F.count("*") / chunk).cast("int").alias("chunks")))
    tiles = (classes.join(sizes, ["label", "length"])
             .withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("label", "length", F.least("chunk", "other").alias("i"),
                     F.greatest("chunk", "other").alias("j"), "chunk", "node", "size",
                     "embedding"))
    links = settled(tiles.groupBy("label", "length", "i", "j").applyInArrow(
        _tile(threshold), "node long, links long, up long"))
    counted = links.groupBy("node").agg(F.sum("links").alias("others"))
    reach = components(links.select(F.col("node").alias("a"), F.col("up").alias("b")))
    grouped = classes.select("label", "embedding", "first", "size", "node").join(
        reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    known = grouped.join(first, "component").join(counted, "node", "left").select(
        "label", "embedding", "component_id",
        (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = ["vec_id", "n_links", "component_id"]
    alone = rows.where(~usable).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (good.join(known, ["label", "embedding"]).select(*out).unionByName(alone)
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings
  UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id,
       vec_id = component_id AS kept
FROM least LEFT JOIN counted ON a = vec_id"""
