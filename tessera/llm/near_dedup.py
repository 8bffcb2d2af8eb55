"""Near-duplicate documents: ProbMinHash signatures over weighted 5-word shingles, banding, exact verification, components.

Equal texts are one node, whatever their number (pre-aggregated by digest, so a hot text costs a row). A link needs a
similarity of ``threshold``, by the shingle sets or by their weights (the probability Jaccard that the signatures estimate),
both exact. Members of a bucket are verified in cells of bounded size until any two of a bucket are verified or in one
component, so the classes are those of all pairs that share a bucket. Bands are tuned for a recall over 0.998 at the threshold.

Cases: null texts and texts without words are alone in their class; texts of under five words have one shingle;
very long texts are hashed whole; ids that are null or repeat are told apart by the text's digest, and of wholly equal rows
one is kept; empty tables give empty results; other columns are only carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import bound_batches, step, stored
from .components import linked

ROWS = 5
RECALL = 0.998
#: Rows of a side that is broadcast instead of shuffling the texts; each has under 64 bytes.
BROADCAST_ROWS = 100_000


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def banded(docs: DataFrame, rows: int, n_bands: int) -> DataFrame:
    """(id, key, size, bands) of (id, key, text): the number of shingles and a bucket for each band; texts without words have null bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, out, held, n = [], [], [], 0
            for t in b.column("text").cast(pa.binary()).to_pylist():
                held.append(S.weighted(t))
                sizes.append(len(held[-1][0]))
                n += sizes[-1]
                if n >= S.SLICE:
                    out += bands_of(held, rows, n_bands)
                    held, n = [], 0
            out += bands_of(held, rows, n_bands)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["id", "key", "size", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, key binary, size long, bands array<long>")


def bands_of(sets: list[tuple], rows: int, n_bands: int) -> list:
    out: list = [None] * len(sets)
    full = [k for k, (x, _) in enumerate(sets) if len(x)]
    for k, row in zip(full, S.bands(S.signatures([sets[k] for k in full], rows * n_bands), rows)):
        out[k] = row
    return out


def shingled(texts: DataFrame) -> DataFrame:
    """The columns of ``texts``, elements and weights instead of text: the distinct shingles and how often each is there, null where all are there once."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            elements, weights = [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                x, w = S.weighted(t)
                elements.append(x.tobytes())
                weights.append(None if len(w) == w.sum() else w.tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(elements, pa.binary()), pa.array(weights, pa.binary())], names=[*names, "elements", "weights"])

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)
    return texts.select(*names, "text").mapInArrow(run, f"{kinds}, elements binary, weights binary")


@step
def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = S.THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """One row per document: ``id``, ``key`` (null without words), ``class_id``, the least id of its class, ``class_key``, a key that all of the class
    share, and ``n_copies``, documents with the same text."""
    spark = docs.sparkSession
    bound_batches(spark)
    named = docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    marked = stored(banded(named, rows, S.tuned_bands(rows, threshold, recall)), "banded")
    nodes = stored(marked.where("bands IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.max("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("n_copies")), "nodes")

    def contents(keys: DataFrame) -> DataFrame:
        # The texts come dealt by key, so this join sends only the keys' columns.
        return shingled(fetched(named, keys.select("key").join(nodes.select("key", "id"), "key")).join(keys, "key"))

    labels = linked(nodes.select("key", "size", F.explode("bands").alias("bucket")), contents, threshold=threshold)
    known = nodes.select("key", "id", "n_copies").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = stored(known, "rooted")
    least = stored(known.groupBy("root").agg(F.min("id").alias("class_id")), "least")
    known = stored(known.join(least, "root").select("key", "class_id", F.col("root").alias("class_key"), "n_copies"), "classes")
    alone = F.col("bands").isNull()
    joined = marked.where(~alone).select("id", "key").join(known, "key")
    return joined.select("id", "key", "class_id", "class_key", "n_copies").union(marked.where(alone).select("id", F.lit(None).cast("binary"), F.col("id"), F.lit(None).cast("binary"), F.lit(1).cast("long")))


def fetched(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the wanted (key, id), each from the one document that stands for its key."""
    wanted = stored(wanted.select("key", F.col("id").alias("own")), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    out = named.join(few, (named["key"] == few["key"]) & named["id"].eqNullSafe(few["own"])).select(named["key"], "text")
    # Repeated rows of one document would come twice.
    return out.dropDuplicates(["key"])


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without all but one of each class, the one with the least id; all columns as they were."""
    found = classes(docs, doc_id=doc_id, text=text, **how).where("key IS NOT NULL")
    # Of equal ids in a class the least text stays; of wholly equal rows one.
    stay = found.where("id <=> class_id").groupBy("class_key").agg(F.min("key").alias("stay"), F.count("*").alias("n"))
    stay = stored(stay, "stay")
    gone = found.join(stay, "class_key").where("NOT (id <=> class_id AND key = stay)").select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct()
    gone = stored(gone, "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    key = F.unhex(F.md5(F.col(text)))
    left = docs.join(few, docs[doc_id].eqNullSafe(few["_gone_id"]) & (key == few["_gone_key"]), "left_anti")
    repeated = found.where("id <=> class_id").groupBy("id", "key").count().where("count > 1")
    repeated = stored(repeated.select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key")), "repeated")
    if repeated.isEmpty():
        return left
    same = left[doc_id].eqNullSafe(repeated["_gone_id"]) & (key == repeated["_gone_key"])
    return left.join(repeated, same, "left_anti").union(left.join(repeated, same, "left_semi").dropDuplicates([doc_id, text]))
