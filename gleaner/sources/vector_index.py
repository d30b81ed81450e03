"""A stored vector index: an inverted file of k-means cells with product-quantised codes.

Cells are fitted by Spark's k-means and one codebook for each slice of the residuals, on a sample of at
most SAMPLE rows; every row is then put into its nearest cell and coded. A cell is a Parquet folder of
blocks: ids, codes and vectors, each a column of its own. A search opens the folders of the cells that its
queries probe and reads ids and codes; blocks of queries meet blocks of codes by cell in joins that Spark may
split, and distances are sums of looked-up numbers. Only the shortlist's blocks are read for vectors,
which rank it exactly. Vectors are added, replaced and deleted in versions, as in versioned.

Null ids, null vectors and those that hold nulls or have another length than the first are left out; ids are unique within a write.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.shared import cut
from gleaner.operators.dense import squared_distance
from gleaner.sources import versioned
from gleaner.sources.index import new_folder

#: Rows that cells and codebooks are fitted on; rows of a block; queries of a block; codes of a codebook; slices of a vector.
SAMPLE, BLOCK, QUERY_BLOCK, CODES, SLICES = 65_536, 4096, 256, 256, 16
CELLS = "cell_id int, centre array<double>, version int"
BOOKS = "slice int, centres array<array<double>>, version int"
LISTS = "block long, ids array<long>, codes array<binary>, vectors array<array<float>>, version int, cell int"
IDS = "id long, cell int, block long, deleted boolean, version int"


def _usable(rows: DataFrame, size: int | None) -> DataFrame:
    ok = rows.where("id is not null and v is not null").where(~F.exists("v", lambda x: x.isNull()))
    return ok.where(F.size("v") == size) if size else ok


def fit(rows: DataFrame, n_cells: int | None = None, slices: int = SLICES, codes: int = CODES, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Centres of cells (cell_id, centre) and codebooks (slice, centres) of rows (id, v); about the square root of the rows' number of cells, if none is given."""
    spark = rows.sparkSession
    n = rows.count()
    sample = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) < int(SAMPLE / n * (1 << 40)))
    sample = cut(sample.select(F.col("v").cast("array<double>").alias("v")))
    n_cells = max(1, min(n_cells or round(n**0.5), sample.count()))
    model = KMeans(k=n_cells, seed=seed, maxIter=15, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    centres = np.array(model.clusterCenters())
    cells = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell_id int, centre array<double>")
    slices = min(slices, centres.shape[1])
    edges = np.linspace(0, centres.shape[1], slices + 1).astype(int)

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["v"].tolist())
            rest = x - centres[_nearest(x, centres, 1)[:, 0]]
            yield pd.DataFrame([(s, r[edges[s] : edges[s + 1]].tolist()) for s in range(slices) for r in rest], columns=["slice", "part"])

    def book(parts: pd.DataFrame) -> pd.DataFrame:
        """Lloyd's rounds on a slice of the sample, at most SAMPLE short vectors."""
        x = np.array(parts["part"].tolist())
        rng = np.random.default_rng(seed)
        known = np.unique(x, axis=0)
        held = known if len(known) <= codes else known[rng.choice(len(known), codes, replace=False)]
        for _ in range(12 if len(known) > codes else 0):
            near = _nearest(x, held, 1)[:, 0]
            sums, counts = np.zeros_like(held), np.bincount(near, minlength=len(held))
            np.add.at(sums, near, x)
            held = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], held)
        return pd.DataFrame({"slice": [int(parts["slice"].iloc[0])], "centres": [held.tolist()]})

    books = sample.mapInPandas(sliced, "slice int, part array<double>").groupBy("slice").applyInPandas(book, "slice int, centres array<array<double>>")
    return cells, books


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first; in blocks, so that memory is bounded."""
    out = []
    norms = (centres**2).sum(1)
    for at in range(0, max(len(x), 1), 4096):
        d = norms[None, :] - 2 * x[at : at + 4096] @ centres.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k])
    return np.vstack(out)


class _Model:
    """Centres and codebooks as arrays: n_cells vectors and SLICES x CODES short ones, which travel with tasks."""

    def __init__(self, cells: DataFrame, books: DataFrame):
        self.centres = np.array([r["centre"] for r in cells.orderBy("cell_id").collect()])
        self.books = [np.array(r["centres"]) for r in books.orderBy("slice").collect()]
        self.size = self.centres.shape[1]
        self.edges = np.linspace(0, self.size, len(self.books) + 1).astype(int)

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> _Model:
        """Only bases hold a model."""
        return cls(versioned.read(spark, path, "cells", CELLS), versioned.read(spark, path, "books", BOOKS))

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.centres, 1)[:, 0]
        rest = x - self.centres[cell]
        codes = np.stack([_nearest(rest[:, a:b], book, 1)[:, 0] for book, a, b in zip(self.books, self.edges, self.edges[1:])], axis=1).astype(np.uint8)
        return cell, codes

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """(queries, slices, codes): squared distances of each slice of the queries to each code."""
        rest = q - self.centres[cell]
        out = np.full((len(q), len(self.books), max(map(len, self.books))), np.inf)
        for s, (book, a, b) in enumerate(zip(self.books, self.edges, self.edges[1:])):
            out[:, s, : len(book)] = ((rest[:, None, a:b] - book[None]) ** 2).sum(2)
        return out


def _lists(rows: DataFrame, model: _Model) -> tuple[DataFrame, DataFrame]:
    """Blocks of the cells, and (id, cell, block, deleted) of all ids. Full cells have several blocks, so none grows without bound."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, codes = shared.value.coded(np.array(batch["v"].tolist(), float))
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "cell": cell, "code": [c.tobytes() for c in codes]})

    coded = cut(_usable(rows, model.size).mapInPandas(run, "id long, v array<float>, cell int, code binary"))
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # one row a cell
    placed = coded.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    lists = placed.groupBy("cell", "block").agg(F.array_sort(F.collect_list(F.struct("id", "code", "v"))).alias("p"))
    return lists.select("block", F.col("p.id").alias("ids"), F.col("p.code").alias("codes"), F.col("p.v").alias("vectors"), "cell"), placed.select("id", "cell", "block", F.lit(False).alias("deleted"))


def build(rows: DataFrame, path: str | None = None, **options) -> str:
    """Fits and writes an index of rows (id, v). Returns the folder, a new one in the shared storage if none is given."""
    spark = rows.sparkSession
    path = path or new_folder(spark, "vectors")
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"))
    first = _usable(rows, None).select(F.size("v").alias("n")).agg(F.max("n")).first()[0]
    if not first:
        raise ValueError("an index needs a vector")
    _write_base(rows, path, *fit(_usable(rows, first), **options))
    return path


def _write_base(rows: DataFrame, path: str, cells: DataFrame, books: DataFrame) -> None:
    cells, books = cut(cells), cut(books)
    lists, ids = _lists(rows, _Model(cells, books))
    versioned.commit(rows.sparkSession, path, {"cells": cells, "books": books, "lists": lists, "ids": ids}, base=True, partition_by={"lists": "cell"})


def put(rows: DataFrame, path: str) -> None:
    """Adds vectors (id, v) to the cells there are; those whose ids are there already are replaced."""
    spark = rows.sparkSession
    lists, ids = _lists(rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")), _Model.stored(spark, path))
    versioned.commit(spark, path, {"lists": lists, "ids": ids}, partition_by={"lists": "cell"})


def delete(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "id") -> None:
    gone = ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lit(0).alias("cell"), F.lit(0).cast("long").alias("block"), F.lit(True).alias("deleted")).distinct()
    versioned.commit(spark, path, {"ids": gone})


class Reader:
    """What a search needs of a stored index; it sees the versions that counted when it was made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.model, self.versions = spark, _Model.stored(spark, path), versioned.committed(spark, path)
        self.lists, ids = versioned.read(spark, path, "lists", LISTS), versioned.read(spark, path, "ids", IDS)
        changed = versioned.newest(ids, self.versions, "id")
        dead = None if changed is None else ids.where("not deleted").join(changed, "id").where("version < newest")
        self.dead = None if dead is None else cut(dead.groupBy("version", "cell", "block").agg(F.collect_set("id").alias("dead")))  # at most BLOCK ids each

    def masked(self, *columns: str) -> DataFrame:
        """Blocks with some of their columns and the ids in them that don't live."""
        rows = self.lists.select("version", "cell", "block", *columns)
        return rows.withColumn("dead", F.array().cast("array<long>")) if self.dead is None else rows.join(self.dead, ["version", "cell", "block"], "left").withColumn("dead", F.coalesce("dead", F.array().cast("array<long>")))

    def vectors(self) -> DataFrame:
        """(id, v) of all that lives."""
        rows = self.masked("ids", "vectors").select("dead", F.arrays_zip(F.col("ids").alias("id"), F.col("vectors").alias("v")).alias("p"))
        return rows.select(F.inline(F.filter("p", lambda x: ~F.array_contains("dead", x["id"]))))


def compact(spark: SparkSession, path: str, refit: bool = False, **options) -> None:
    """Writes what lives as a new base, with the same cells or newly fitted ones; old versions stay until versioned.vacuum()."""
    now = Reader(spark, path)
    rows = cut(now.vectors())
    cells, books = fit(rows, **options) if refit else (versioned.read(spark, path, "cells", CELLS).drop("version"), versioned.read(spark, path, "books", BOOKS).drop("version"))
    _write_base(rows, path, cells, books)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probe: int = 16, shortlist: int = 100, threshold: float | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): for queries (qid, q) the k nearest of the shortlist, by exact distance; score 1 / (1 + squared distance)."""
    now = Reader(spark, path)
    size = now.model.size
    asked = cut(queries.where("qid is not null and q is not null").where(~F.exists("q", lambda x: x.isNull()) & (F.size("q") == size)).select("qid", F.col("q").cast("array<double>").alias("q")))
    shared = spark.sparkContext.broadcast(now.model)

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = _nearest(np.array(batch["q"].tolist()), shared.value.centres, probe)
                yield pd.DataFrame({"qid": np.repeat(batch["qid"].to_numpy(), near.shape[1]), "cell": near.ravel(), "q": batch["q"].repeat(near.shape[1]).to_numpy()})

    probed = cut(asked.mapInPandas(probes, "qid long, cell int, q array<double>"))
    counts = probed.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))  # one row a cell
    grouped = probed.join(F.broadcast(counts), "cell").groupBy("cell", F.pmod(F.xxhash64("qid"), F.col("blocks")).alias("q_block")).agg(F.collect_list("qid").alias("qids"), F.collect_list("q").alias("qs"))
    cells = [r["cell"] for r in counts.select("cell").collect()]  # at most n_cells numbers
    coded = now.masked("ids", "codes").where(F.col("cell").isin(cells))

    def rough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                codes = np.frombuffer(b"".join(r.codes), np.uint8).reshape(len(r.ids), -1)
                tables = shared.value.tables(np.array(list(r.qs)), r.cell)
                d = np.zeros((len(r.qids), len(codes)))
                for s in range(codes.shape[1]):
                    d += tables[:, s, codes[:, s]]
                if len(r.dead):
                    d[:, np.isin(r.ids, r.dead)] = np.inf
                few = min(shortlist, len(codes))
                best = np.argpartition(d, few - 1, axis=1)[:, :few]
                rows = pd.DataFrame({"qid": np.repeat(r.qids, few), "at": best.ravel(), "near": np.take_along_axis(d, best, 1).ravel()})
                yield rows[np.isfinite(rows["near"])].assign(version=r.version, cell=r.cell, block=r.block)

    met = coded.join(grouped, "cell").select("version", "cell", "block", "ids", "codes", "dead", "qids", "qs")
    found = met.mapInPandas(rough, "qid long, at int, near double, version int, cell int, block long")
    short = cut(found.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("near", "version", "cell", "block", "at"))).where(F.col("r") <= shortlist))
    # a block's part of the shortlist is bounded by the queries that probe it; its vectors are read once for them
    wants = short.groupBy("version", "cell", "block").agg(F.collect_list(F.struct("qid", "at")).alias("wants"))
    full = now.lists.where(F.col("cell").isin(cells)).join(wants, ["version", "cell", "block"])
    rows = full.select(F.inline(F.transform("wants", lambda w: F.struct(w["qid"].alias("qid"), F.get("ids", w["at"]).alias("doc_id"), F.get("vectors", w["at"]).alias("v")))))
    scored = rows.join(asked, "qid").select("qid", "doc_id", F.round(1 / (1 + squared_distance(F.col("v"), F.col("q"))), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    return ranked.where(F.col("score") >= threshold) if threshold else ranked
