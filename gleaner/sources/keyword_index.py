"""A stored keyword index: BM25 from blocks of postings with bounds, so a search scores only blocks that can matter.

A block has a term's postings in one bucket of documents, with the largest tf and the smallest length in it,
which bound any score from it whatever the mean length becomes. A bucket's blocks are made and packed inside
a task, a row for each folder of terms. Documents are added, replaced and deleted in versions; compact()
writes the living ones anew.

A search opens the folders of its terms, keeps those terms' blocks, and adds up bounds by query and bucket.
The most promising buckets are scored first; the k-th best score there is a threshold, and only buckets
whose bound reaches it are scored at all. A bucket's scores are added up inside a task, which gives out each
query's best few. Results equal those of scoring everything.

Null ids are left out; ids are unique within a write; null and empty texts are documents without words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.functions.shared import cut
from gleaner.functions.text import tokens
from gleaner.operators import sparse
from gleaner.sources import versioned
from gleaner.sources.index import new_folder

#: Folders that terms are dealt over; tasks that share a folder's buckets; documents of a bucket; buckets scored first.
PARTS, SALTS, BUCKET_DOCS, SEEDS = 32, 8, 1024, 4
#: Changed documents up to this many are broadcast; more are joined by shuffle.
BROADCAST_CHANGED = 1_000_000
#: Of each block the term, its postings' number and bounds; of all blocks' postings, one block after the other, ids, counts and lengths.
PACKED = "bucket long, terms array<string>, ns array<int>, max_tfs array<int>, min_dls array<int>, ids array<long>, tfs array<int>, dls array<int>"
POSTINGS = f"{PACKED}, version int, part int"
DOCS = "doc_id long, dl int, deleted boolean, bucket long, version int"


def part_of(term: Column | str) -> Column:
    return F.pmod(F.crc32(term), F.lit(PARTS)).cast("int")


def _lists(offsets: np.ndarray, values, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def _flat(rows, name: str) -> np.ndarray:
    return rows.column(name).flatten().to_numpy()


def _packed(offsets: np.ndarray, names: pa.Array, n: np.ndarray, ids: np.ndarray, tfs: np.ndarray, dls: np.ndarray) -> list[pa.Array]:
    """PACKED's lists of rows that have blocks offsets[i] to offsets[i + 1] each: blocks of names with n postings, one at least."""
    start = np.cumsum(n) - n
    of_postings = np.append(start, len(ids))[offsets]
    bounds = [f.reduceat(x, start) if len(start) else x[:0] for f, x in ((np.maximum, tfs), (np.minimum, dls))]
    return [_lists(offsets, names, pa.string()), *(_lists(offsets, x, pa.int32()) for x in (n, *bounds)), _lists(of_postings, ids, pa.int64()), *(_lists(of_postings, x, pa.int32()) for x in (tfs, dls))]


def _bucket(bucket: int, names: pa.Array, code: np.ndarray, ids: np.ndarray, tfs: np.ndarray, dls: np.ndarray) -> pa.RecordBatch:
    """A bucket's blocks, a row for each folder, from postings of the names that code says, in the order of code and id."""
    start = np.nonzero(np.diff(code, prepend=-1))[0]
    names, n = names.take(pa.array(code[start])), np.diff(start, append=len(code))
    part = np.array([crc32(t.encode("utf-8", "surrogatepass")) % PARTS for t in names.to_pylist()], np.int64)
    by_name = pc.sort_indices(names).to_numpy()
    order = by_name[np.argsort(part[by_name], kind="stable")]
    n = n[order]
    by = np.arange(len(ids)) + np.repeat(start[order] - (np.cumsum(n) - n), n)
    parts, first = np.unique(part[order], return_index=True)
    lists = _packed(np.append(first, len(order)), names.take(pa.array(order)), n, ids[by], tfs[by], dls[by])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), bucket)), *lists, pa.array(parts, pa.int32())], [*_NAMES, "part"])


_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of documents (doc_id, bucket, words), whose buckets follow one another, and a row for the folder PARTS: the bucket's documents and their lengths."""

    def one(docs: pa.Table) -> Iterator[pa.RecordBatch]:
        docs = docs.sort_by("doc_id").combine_chunks().to_batches()[0]
        words, ids = docs.column("words"), docs.column("doc_id").to_numpy()
        lengths, encoded = np.diff(words.offsets.to_numpy()), words.flatten().dictionary_encode()
        if len(encoded):
            key, tf = np.unique(encoded.indices.to_numpy().astype(np.int64) * len(docs) + np.repeat(np.arange(len(docs)), lengths), return_counts=True)
            code, row = np.divmod(key, len(docs))
            yield _bucket(docs.column("bucket")[0].as_py(), encoded.dictionary, code, ids[row], tf, lengths[row])
        none, all_of = np.zeros(2, np.int64), np.array([0, len(docs)])
        lists = [_lists(none, [], pa.string()), *(_lists(none, [], pa.int32()) for _ in range(3)), _lists(all_of, ids, pa.int64()), _lists(none, [], pa.int32()), _lists(all_of, lengths, pa.int32())]
        yield pa.RecordBatch.from_arrays([docs.column("bucket").slice(0, 1), *lists, pa.array([PARTS], pa.int32())], [*_NAMES, "part"])

    held = None
    for batch in batches:
        held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])])
        starts = [0, *(np.nonzero(np.diff(held["bucket"].to_numpy()))[0] + 1).tolist()]
        for low, high in pairwise(starts):
            yield from one(held.slice(low, high - low))
        held = held.slice(starts[-1])
    if held:
        yield from one(held)


def _dealt(rows: DataFrame) -> DataFrame:
    """A folder's buckets go to several tasks."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("bucket"), F.lit(SALTS))).repartition("part", "salt")


def put(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Adds documents; those whose ids are there already are replaced. Returns the folder, a new one in the shared storage if none is given."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "keywords")
    words = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), tokens(F.col(text_col)).alias("words"))
    placed = words.withColumn("bucket", F.expr(f"monotonically_increasing_id() div {BUCKET_DOCS}"))
    postings = _dealt(placed.mapInArrow(_counted, f"{PACKED}, part int")).drop("salt").sortWithinPartitions("part", "bucket")

    def known(version: int) -> DataFrame:
        """The documents, as written with the postings, so that texts are split once."""
        rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings").where((F.col("version") == version) & (F.col("part") == PARTS))
        return rows.select(F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("dls").alias("dl"))), F.lit(False).alias("deleted"), "bucket")

    versioned.commit(spark, path, {"postings": postings, "docs": known}, partition_by={"postings": "part"})
    return path


def delete(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "doc_id") -> None:
    """Takes documents out; ids that aren't there do nothing."""
    gone = ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("dl"), F.lit(True).alias("deleted"), F.lit(None).cast("long").alias("bucket")).distinct()
    versioned.commit(spark, path, {"docs": gone})


class Reader:
    """What a search needs of a stored index; it sees the versions that counted when it was made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, versioned.committed(spark, path)
        self.docs, self.blocks = versioned.read(spark, path, "docs", DOCS), versioned.read(spark, path, "postings", POSTINGS)
        changed = versioned.newest(self.docs, self.versions, "doc_id")
        self.changed, self.dead = changed if changed is None else cut(changed), None
        if changed is not None:
            self.changed, few = (F.broadcast(self.changed), True) if self.changed.count() <= BROADCAST_CHANGED else (self.changed, False)
            dead = self.docs.where("bucket is not null").join(self.changed, "doc_id").where("newest <> version").groupBy("version", "bucket").agg(F.collect_list("doc_id").alias("dead"))
            self.dead = F.broadcast(cut(dead)) if few else dead

    def live_docs(self) -> DataFrame:
        return versioned.living(self.docs, self.changed, "doc_id").where("not deleted").select("doc_id", "dl", "version", "bucket")

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """Packed blocks of some terms; folders without one of them aren't opened."""
        distinct = terms.select("term").distinct()
        parts = [r[0] for r in distinct.select(part_of("term")).distinct().collect()]  # PARTS numbers at most
        few = distinct.count() <= sparse.BROADCAST_TERMS
        return self.living(self.blocks.where(F.col("part").isin(parts)), [r[0] for r in distinct.collect()] if few else None)

    def living(self, blocks: DataFrame, terms: list[str] | None = None) -> DataFrame:
        """Packed blocks without documents that a later version has replaced or deleted, and of some terms only."""
        shared = self.spark.sparkContext.broadcast(terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = None if shared.value is None else pa.array(shared.value, pa.string())
            for batch in batches:
                names, n, ids, tfs, dls = batch.column("terms").flatten(), *(_flat(batch, c) for c in ("ns", "ids", "tfs", "dls"))
                block, of_row = np.repeat(np.arange(len(n)), n), batch.column("ids").offsets.to_numpy()
                of_row = of_row - of_row[0]
                kept = np.ones(len(ids), bool) if known is None else pc.is_in(names, value_set=known).to_numpy(zero_copy_only=False)[block]
                for row, dead in enumerate(batch.column("dead") if "dead" in batch.schema.names else ()):
                    if dead.is_valid:
                        part = slice(of_row[row], of_row[row + 1])
                        kept[part] &= ~np.isin(ids[part], dead.values.to_numpy())
                left = np.bincount(block[kept], minlength=len(n))
                some, row_of = left > 0, np.repeat(np.arange(len(batch)), np.diff(batch.column("terms").offsets.to_numpy()))
                ends = np.append(0, np.cumsum(np.bincount(row_of[some], minlength=len(batch))))
                lists = _packed(ends, names.filter(pa.array(some)), left[some], ids[kept], tfs[kept], dls[kept])
                yield pa.RecordBatch.from_arrays([batch.column("bucket"), *lists, batch.column("version"), batch.column("part")], [*_NAMES, "version", "part"])

        rows = blocks if self.dead is None else blocks.join(self.dead, ["version", "bucket"], "left")
        return rows.mapInArrow(run, POSTINGS).where(F.size("terms") > 0)


def compact(spark: SparkSession, path: str) -> None:
    """Writes what lives as a new base, in even buckets: small ones are put together."""
    now = Reader(spark, path)
    docs = cut(now.live_docs())
    # one row for each bucket, so BUCKET_DOCS times fewer than documents
    order = W.orderBy("version", "bucket")
    bins = cut(docs.groupBy("version", "bucket").agg(F.count("*").alias("n")).select("version", "bucket", F.floor((F.sum("n").over(order) - 1) / BUCKET_DOCS).alias("bin")))

    def merged(rows: pa.Table) -> pa.Table:
        if len(rows) == 1:
            return rows.select([*_NAMES, "part"])
        rows = rows.combine_chunks().to_batches()[0]
        encoded = rows.column("terms").flatten().dictionary_encode()
        code = np.repeat(encoded.indices.to_numpy(), _flat(rows, "ns"))
        ids = _flat(rows, "ids")
        by = np.lexsort((ids, code))
        return pa.Table.from_batches([_bucket(rows.column("bucket")[0].as_py(), encoded.dictionary, code[by], ids[by], *(_flat(rows, c)[by] for c in ("tfs", "dls")))])

    moved = now.living(now.blocks.where(F.col("part") < PARTS)).join(F.broadcast(bins), ["version", "bucket"]).withColumn("bucket", F.col("bin")).select(*_NAMES, "part")
    postings = _dealt(moved).groupBy("part", "salt", "bucket").applyInArrow(merged, f"{PACKED}, part int").sortWithinPartitions("part", "bucket")
    known = docs.join(F.broadcast(bins), ["version", "bucket"]).select("doc_id", "dl", F.lit(False).alias("deleted"), F.col("bin").alias("bucket"))
    versioned.commit(spark, path, {"postings": postings, "docs": known}, base=True, partition_by={"postings": "part"})


def bounds(blocks: DataFrame, weighted: DataFrame, average: float) -> DataFrame:
    """(qid, version, bucket, bound): no document of the bucket scores more; terms of negative weight may be missing, so they add nothing."""
    heads = blocks.select("version", "bucket", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("max_tfs").alias("max_tf"), F.col("min_dls").alias("min_dl")))).join(sparse._small(weighted), "term")
    most = F.greatest("weight", F.lit(0.0)) * sparse.weight(F.col("max_tf"), F.col("min_dl"), average)
    return heads.groupBy("qid", "version", "bucket").agg(F.sum(most).alias("bound"))


def _scores(blocks: DataFrame, pairs: DataFrame, weighted: DataFrame, average: float, k: int) -> DataFrame:
    """(qid, doc_id, score): each query's best k, at least, of the buckets that it is paired with (qid, version, bucket)."""
    if weighted.count() > sparse.BROADCAST_TERMS:
        term = F.flatten(F.transform(F.arrays_zip("terms", "ns"), lambda x: F.array_repeat(x["terms"], x["ns"])))
        each = blocks.select("version", "bucket", F.inline(F.arrays_zip(term.alias("term"), F.col("ids").alias("doc_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))
        met = pairs.join(weighted, "qid").join(each, ["version", "bucket", "term"])
        return met.groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("weight") * sparse.weight(F.col("tf"), F.col("dl"), average)), 6).alias("score"))
    shared = blocks.sparkSession.sparkContext.broadcast([tuple(r) for r in weighted.select("qid", F.lit(1), "term", "weight").collect()])  # BROADCAST_TERMS at most
    qid = weighted.schema["qid"].dataType
    kind = to_arrow_type(qid)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().to_batches()[0]
        wanted, encoded = set(rows.column("qids")[0].as_py()), rows.column("terms").flatten().dictionary_encode()
        names, code = encoded.dictionary.to_pylist(), np.repeat(encoded.indices.to_numpy(), _flat(rows, "ns"))
        known, (ids, doc) = set(names), np.unique(_flat(rows, "ids"), return_inverse=True)
        by = np.argsort(doc, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(ids))))
        lists = [_lists(ends, x[by], pa.int32()) for x in (code, _flat(rows, "tfs"), _flat(rows, "dls"))]
        docs = pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["doc_id", "places", "tfs", "dls"])
        asked = [x for x in shared.value if x[0] in wanted and x[2] in known]
        return pa.Table.from_batches(list(sparse._best(names, asked, iter([docs]), k, lambda tf, dl: sparse.weight(tf, dl, average), kind)))

    of_bucket = pairs.groupBy("version", "bucket").agg(F.collect_list("qid").alias("qids"))
    # a bucket's scores are all in one task, and so are blocks that were dealt by bucket
    return blocks.join(F.broadcast(of_bucket) if pairs.count() <= BROADCAST_CHANGED else of_bucket, ["version", "bucket"]).groupBy("version", "bucket").applyInArrow(run, f"qid {qid.simpleString()}, doc_id long, score double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, seeds: int = SEEDS) -> DataFrame:
    """(qid, doc_id, score, rank): each query's best k of the documents that have one of its words. queries: qid, query."""
    return pruned_search(spark, path, queries, k, seeds)[0]


def pruned_search(spark: SparkSession, path: str, queries: DataFrame, k: int, seeds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """search(), with the buckets that were bounded and those that were scored."""
    now = Reader(spark, path)
    terms = cut(sparse.query_terms(queries))
    blocks = cut(now.of_terms(terms).repartition("version", "bucket"))
    total = now.live_docs().agg(F.count("*").alias("n"), F.avg("dl").alias("average")).first()
    n, average = total["n"], max(total["average"] or 0.0, 1e-9)
    counts = blocks.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), "ns"))).groupBy("term").agg(F.sum("ns").alias("df"))
    weighted = cut(terms.join(counts, "term").select("qid", "term", (F.col("qn") * sparse.bm25_idf(n)).alias("weight")))

    def scored(pairs: DataFrame) -> DataFrame:
        return _scores(blocks, pairs, weighted, average, k)

    pairs = cut(bounds(blocks, weighted, average))
    first = pairs.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("bound"), "version", "bucket"))).where(F.col("r") <= seeds)
    enough = sparse.top(scored(first), k).groupBy("qid").agg(F.count("*").alias("held"), F.min("score").alias("least")).where(F.col("held") >= k)
    left = cut(pairs.join(sparse._small(enough.select("qid", "least")), "qid", "left").where("least is null or bound >= least - 1e-6").select("qid", "version", "bucket"))
    return sparse.top(scored(left), k), pairs, left
