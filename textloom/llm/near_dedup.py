"""MinHash near-duplicate groups with tensored banding.

Table keys are made of pairs: two collections of `collections` half keys each, a half key being
`rows` minhashes, give collections ** 2 tables for 2 * collections * rows minhashes a document
instead of 2 * rows * collections ** 2. Two documents of shingle resemblance s share a table with
probability (1 - (1 - s ** rows) ** collections) ** 2; with the defaults 0.91 at s = 0.57, 0.98 at 0.65, 0.999 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .work import Work, col, fresh, id_text, kind_of, without
from .words import Hasher, mix, shingles, slices


def _minhashes(v: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n minhashes of each run of v that starts at `at`."""
    out = np.empty((n, len(at)), np.uint64)
    draw = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x10001))
    for i in range(n):
        h = (v ^ draw[2 * i]) * (draw[2 * i + 1] | np.uint64(1))
        out[i] = np.minimum.reduceat(h ^ (h >> np.uint64(29)), at)
    return out


def _signer(k: int, m: int, rows: int, seed: int):
    numbers = ["fp1", "fp2", *(f"u{i}" for i in range(m)), *(f"v{i}" for i in range(m))]
    names = ["doc_id", *numbers]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids = batch.column(0)
            for first, texts in slices(batch.column(1)):
                h, o = hasher.words(texts)
                v, so = shingles(h, o, k)
                some = np.flatnonzero(np.diff(so))
                if not len(some):
                    continue
                at = so[some]
                half = np.zeros((2 * m, len(some)), np.uint64)
                mins = _minhashes(v, at, 2 * m * rows, seed)
                for j in range(2 * m):
                    for r in range(rows):
                        half[j] = mix(half[j] + mins[j * rows + r])
                place = (np.arange(len(h)) - np.repeat(o[:-1], np.diff(o))).astype(np.uint64)
                word_at = o[some]
                fp = [np.add.reduceat(mix(h + mix(place + np.uint64(s))), word_at) for s in (1 << 32, 1 << 33)]
                cols = [ids.slice(first, len(texts)).take(pa.array(some)), *(pa.array(x.view(np.int64)) for x in (*fp, *half))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return sign, ", ".join(f"{n} long" for n in numbers)


def signatures(docs: DataFrame, k: int = 3, collections: int = 8, rows: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, fp1, fp2, u0.., v0..): 128 bits over the word sequence, and the half keys. Texts without a word give no row."""
    f, schema = _signer(k, collections, rows, seed)
    return docs.mapInArrow(f, f"doc_id {kind_of(docs, 'doc_id')}, {schema}")


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                h, o = hasher.words(texts)
                v, so = shingles(h, o, k)
                out = [np.unique((v[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(so[:-1], so[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(out, pa.binary())], names=["doc_id", "shingles"])

    return sets


def _alike(threshold: float):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, ok = batch.column(2), batch.column(3), np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_py(), np.uint32), np.frombuffer(right[i].as_py(), np.uint32)
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    both = np.concatenate((x, y))
                    both.sort()
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    ok[i] = same >= threshold * (len(both) - same)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    return alike


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, k: int = 3, collections: int = 8, rows: int = 2, seed: int = 7) -> DataFrame:
    """Documents that have a near or exact copy: (doc_id, group_id, keep boolean); ids are of any type that can be ordered.

    Two documents are near copies if their sets of runs of k words have a Jaccard resemblance of at
    least `threshold`; groups are the connected components of near copies; group_id is the least
    doc_id of the group, and the one whose `keep` is true. Documents without a copy have no row.

    Exact copies (of the word sequence) are reduced to one document first. Bucket members are then
    checked against the least of their bucket, so that a bucket of n copies costs n checks, and
    afterwards every pair of a bucket whose ends are still in different groups is checked as well,
    unless the sizes of their sets rule it out: the groups are those that checking all pairs of all
    buckets would give, without a cap.

    Nulls: a null doc_id can't be named and has no row. A null, empty or wordless text is a copy of
    nothing. Texts of 1 to k - 1 words have one shingle. Repeated rows are one document; a doc_id with
    several texts is one document that is near to whatever any of its texts is near to. An empty table
    gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    work, m = Work(spark, "near-dedup"), collections
    texts = id_text(docs, id_col, text_col).where("doc_id is not null")
    kind = kind_of(texts, "doc_id")
    signed = work.table(signatures(texts, k, collections, rows, seed), "signed")
    # Combined before the shuffle, so a text of many copies meets in no task.
    halves = [F.first(c).alias(c) for c in signed.columns[3:]]
    one = work.table(signed.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), *halves), "one")
    keys = F.array(*(F.xxhash64(F.lit(i * m + j), f"u{i}", f"v{j}") for i in range(m) for j in range(m)))
    bucket = Window.partitionBy("key")
    tabled = one.select("rep", F.explode(keys).alias("key"))
    buckets = work.table(tabled.withColumns({"least": F.min("rep").over(bucket), "most": F.max("rep").over(bucket)}).where("least != most").select("key", "rep", "least").distinct(), "buckets")
    members = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = work.table(texts.join(members, "doc_id", "left_semi").mapInArrow(_sets(k), f"doc_id {kind}, shingles binary").distinct(), "shingles")

    def checked(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("doc_id").alias(n), F.col("shingles").alias(f"{n}_set")) for n in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(_alike(threshold), f"a {kind}, b {kind}")

    led = buckets.where("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    first = work.table(checked(led), "alike")
    groups = components(first, work)
    # A bucket that still holds several groups: all pairs across groups, from those outside its largest group.
    named = buckets.join(groups, buckets.rep == groups.node, "left").select("key", "rep", "least", F.coalesce("component", "rep").alias("g"))
    named = named.withColumn("size", F.count("*").over(Window.partitionBy("key", "g")))
    named = named.withColumns({"main": F.max(F.struct("size", "g")).over(bucket)["g"], "low": F.min("g").over(bucket), "high": F.max("g").over(bucket)})
    sizes = sets.groupBy(F.col("doc_id").alias("rep")).agg(F.min(F.octet_length("shingles")).alias("low_n"), F.max(F.octet_length("shingles")).alias("high_n"))
    open_ = work.table(named.where("low != high").select("key", "rep", "least", "g", "main").join(sizes, "rep"), "open")
    x = open_.where("g != main").select("key", F.col("rep").alias("x"), F.col("g").alias("gx"), F.col("low_n").alias("low_x"), F.col("high_n").alias("high_x"))
    y = open_.select("key", F.col("rep").alias("y"), F.col("g").alias("gy"), "least", F.col("low_n").alias("low_y"), F.col("high_n").alias("high_y"))
    # Pairs with the least of a bucket have been checked; sets of too unequal sizes can't be alike.
    could = (F.col("gx") != F.col("gy")) & (F.col("x") != F.col("least")) & (F.col("y") != F.col("least")) & (F.col("high_x") >= threshold * F.col("low_y")) & (F.col("high_y") >= threshold * F.col("low_x"))
    rest = x.join(y, "key").where(could).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(led, ["a", "b"], "left_anti")
    second = checked(rest)
    copied = one.where("rep != last").select("fp1", "fp2", "rep")
    exact = signed.select("fp1", "fp2", "doc_id").join(copied, ["fp1", "fp2"]).where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    joined = components(groups.select(F.col("component").alias("a"), F.col("node").alias("b")).union(second).union(exact), work)
    return joined.select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"), (F.col("node") == F.col("component")).alias("keep"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs with one row of each near-duplicate group: that of least doc_id, and of several of these that of least text.

    Rows that repeat a doc_id are documents of their own here: each goes if its text is a copy of one that
    stays, and stays otherwise; of rows equal in id and text one stays. Rows of null id stay, and so do
    rows of null, empty or wordless text, which are copies of nothing. An empty table gives no rows.
    """
    work = Work(docs.sparkSession, "dedup")
    known = docs.where(col(id_col).isNotNull())
    key, nth, unit, again = (fresh(docs, n) for n in ("again_id", "nth", "unit", "again"))
    repeated = work.table(known.groupBy(col(id_col).alias(key)).agg(F.count("*").alias(again)).where(F.col(again) > 1).select(key), "repeated")
    if repeated.isEmpty():
        return without(docs, id_col, near_duplicates(docs, id_col, text_col, **params).where("not keep").select("doc_id"))
    # Only the rows of repeated ids are numbered, by text and then by all they hold.
    order = Window.partitionBy(col(id_col)).orderBy(F.asc_nulls_last(col(text_col)), F.xxhash64(*(col(c) for c, kind in docs.dtypes if "map<" not in kind)))
    some = known.join(repeated, col(id_col) == F.col(key), "left_semi").withColumn(nth, F.row_number().over(order))
    rest = docs.join(repeated, col(id_col) == F.col(key), "left_anti").withColumn(nth, F.lit(0))
    rows = some.unionByName(rest).withColumn(unit, F.when(col(id_col).isNotNull(), F.struct(col(id_col).alias("id"), F.col(nth).alias("nth"))))
    found = near_duplicates(rows, unit, text_col, **params)
    return without(rows, unit, found.where("not keep").select("doc_id")).select(*(col(c) for c in docs.columns))
