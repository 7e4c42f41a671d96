"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one representative a group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, table

#: Vectors that the centroids are fitted on at most, vectors of a label aimed at in a cell, rows of a block.
SAMPLE, CELL, BLOCK = 32_768, 2_048, 4_096


def _unit(packed: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit vectors x; an emptied cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return np.unique(c, axis=0)


def cells_of(x: np.ndarray, c: np.ndarray, least: float) -> np.ndarray:
    """Which cells each unit vector belongs to: its home, and those whose bisector with the home is so near that a vector across it may be similar enough.

    Two vectors of cosine `least` are a chord of sqrt(2 - 2 least) apart. If their homes differ they lie on two sides of the homes'
    bisector, so one of them is within half the chord of it and belongs to both cells: no pair is lost.
    """
    dots = x @ c.T
    home = np.argmax(dots, axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-12))
    margin = (dots[np.arange(len(x)), home][:, None] - dots) / apart[home]
    inside = margin <= math.sqrt(2 - 2 * least) / 2 + 1e-9
    inside[np.arange(len(x)), home] = True
    return inside


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite graph given as a boolean matrix: (row, column) edges."""
    edges = []
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    for start in np.flatnonzero(rows):
        if not rows[start]:
            continue
        rows[start] = False
        todo = [start]
        while todo:
            a = todo.pop()
            new = np.flatnonzero(linked[a] & cols)
            cols[new] = False
            for b in new:
                edges.append((a, b))
                more = np.flatnonzero(linked[:, b] & rows)
                rows[more] = False
                edges += [(m, b) for m in more]
                todo += more.tolist()
    return edges


def block_links(a: pd.DataFrame, b: pd.DataFrame, cell: int, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links between the rows of two blocks (or within one): the copies that each row of a and of b is linked with, and edges that connect the same rows."""
    x, y = _unit(a["vec"].tolist()), _unit(b["vec"].tolist())
    linked = np.zeros((len(a), len(b)), bool)
    for i in range(0, len(a), 1024):
        linked[i : i + 1024] = x[i : i + 1024] @ y.T >= least
    if same:
        np.fill_diagonal(linked, False)
    if linked.any():
        ha, hb = a["home"].to_numpy(), b["home"].to_numpy()
        # Of two cells that hold a pair the smaller counts it; a cell counts no pair of which neither is at home.
        linked &= (ha == cell)[:, None] | (hb == cell)[None, :]
        for v in np.unique(hb[hb < cell]):
            both = np.array([v in c for c in a["cells"]])
            linked[np.ix_(both & (ha == cell), hb == v)] = False
        for v in np.unique(ha[ha < cell]):
            both = np.array([v in c for c in b["cells"]])
            linked[np.ix_(ha == v, both & (hb == cell))] = False
    to_a = linked @ b["n"].to_numpy(np.int64)
    to_b = np.zeros(len(b), np.int64) if same else a["n"].to_numpy(np.int64) @ linked
    return to_a, to_b, forest(linked) if to_a.any() else []


def embedding_near_duplicates(
    vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector. Vectors of one label link where their cosine, in double precision, is at least `least`.

    Equal vectors of a label are first made one class with a number and a count of its vec_ids, so copies never meet in pairs. Cells come from spherical
    k-means on at most SAMPLE vectors; every vector is indexed in its own cell and in those whose border is near enough (cells_of), which
    loses no pair. A cell's rows are dealt into blocks of about BLOCK rows, and pairs of blocks are multiplied in separate tasks: a
    large cell is many tasks, none of them large. Tasks return counts and spanning edges, not pairs.

    A null, empty or zero vector, one with null or non-finite components, a null label or a null vec_id links with nothing; such a
    row is its own component. Only vectors of one length are compared. Repeated rows don't link with each other: n_links counts the other vec_ids among equal vectors, and those of
    each linked class of equal vectors. Rows of one vec_id with different vectors are nodes of their own. Extra columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("e"))
    fine = F.expr(
        "vec_id is not null and label is not null and size(e) > 0 and exists(e, x -> x <> 0)"
        " and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    v = v.withColumn("e", F.when(F.coalesce(fine, F.lit(False)), F.col("e")))
    classes = v.where("e is not null").groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.countDistinct("vec_id").alias("n"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "embed-classes")
    # Only about as many rows as are wanted, chosen by hash, go to the one task that takes the first of them.
    share = min(1.0, 1.2 * SAMPLE / max(classes.count(), 1) + 1e-9)
    order = F.xxhash64("least", "label", "e")
    some = classes.where(F.pmod(order, F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = some.orderBy(order).limit(SAMPLE).select("e").toArrow().to_pandas()["e"]
    centroids: dict[int, np.ndarray] = {}
    if len(sample):
        largest = classes.groupBy("label").count().agg(F.max("count")).head()[0]
        for d in sample.map(len).unique():
            x = np.stack([e for e in sample if len(e) == d]).astype(float)
            centroids[int(d)] = spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), min(-(-largest // CELL), 4096))

    def placed(frames):
        for pdf in frames:
            for d, part in pdf.groupby(pdf["e"].map(len)):
                x = np.stack(part["e"].to_numpy()).astype(np.float64)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                c = centroids.get(d, np.ones((1, d)) / math.sqrt(d))
                inside = cells_of(unit, c, least)
                home = np.argmax(unit @ c.T, axis=1)
                row, cell = np.nonzero(inside)
                lists = [np.flatnonzero(i).tolist() for i in inside]
                yield pd.DataFrame(
                    {
                        "label": part["label"].to_numpy()[row], "d": d, "cell": cell, "id": part["id"].to_numpy()[row], "n": part["n"].to_numpy()[row],
                        "home": home[row], "cells": [lists[i] for i in row], "vec": [x[i].tobytes() for i in row],
                    }
                )

    kind = {f.name: f.dataType.simpleString() for f in classes.schema}
    schema = f"label {kind['label']}, d int, cell int, id {kind['id']}, n long, home int, cells array<int>, vec binary"
    rows = materialize(classes.mapInPandas(placed, schema), "embed-cells")
    group = ["label", "d", "cell"]
    blocks = rows.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # Block i meets itself and every other block once: a row goes to the tasks (i, j) for j >= i and (j, i) for j < i.
    dealt = rows.join(blocks, group).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(key, pdf):
        cell, i, j = key[2], key[3], key[4]
        a = pdf[pdf["own"] == i].reset_index(drop=True)
        b = a if i == j else pdf[pdf["own"] == j].reset_index(drop=True)
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "links": [], "other": []})
        to_a, to_b, edges = block_links(a, b, cell, least, i == j)
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        ids = np.concatenate([ia[to_a > 0], ib[to_b > 0], ia[[e[0] for e in edges]]])
        links = np.concatenate([to_a[to_a > 0], to_b[to_b > 0], np.zeros(len(edges), np.int64)])
        n = len(ids) - len(edges)
        other = np.concatenate([ids[:n], ib[[e[1] for e in edges]]])
        return pd.DataFrame({"id": ids, "links": links, "other": other})

    found = dealt.select(*group, "i", "j", "own", "id", "n", "home", "cells", "vec").groupBy(*group, "i", "j")
    found = materialize(found.applyInPandas(compare, f"id {kind['id']}, links long, other {kind['id']}"), "embed-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), "embed-edges").withColumnRenamed("node", "id")
    least_of = parts.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    parts = parts.join(least_of, "component").select("id", "component_id")
    done = classes.join(counts, "id", "left").join(parts, "id", "left")
    done = done.select("label", "e", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = v.where("e is not null").join(done, ["label", "e"]).select(
        "vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"
    )
    alone = v.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(m.m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) m ON m.a = v.vec_id
"""
