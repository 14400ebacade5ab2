"""Benchmark passages in training documents, by a positional inverted index.

The index is document-partitioned: each segment holds, for every term of its documents, the sorted
positions in the segment. Test items are looked up segment by segment: the lists of an item's rarest
terms, moved back by the terms' places in the item, are intersected first, so that common terms' lists
are only probed where rare ones agree. A segment is one row, so that looking items up moves no postings
between machines, and only the lists of terms that an item asks for are unpacked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .work import Work, col, id_text, kind_of, without
from .words import Hasher, slices

SEGMENT = 16 << 20  # bytes of text in a segment, or one longer text; bounds a task's memory
GAP = 1 << 10  # positions between documents


def pack(gaps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes (7 bits each, low first, high bit: more follows) of non-negative gaps; the byte offsets of the runs that begin at `starts`."""
    gaps = gaps.astype(np.uint64)
    size = np.ones(len(gaps), np.int64)
    for bits in (7, 14, 21, 28):
        size += gaps >= (1 << bits)
    at = np.append(0, np.cumsum(size))
    out = np.zeros(at[-1], np.uint8)
    for j in range(5):
        has = size > j
        more = (size[has] > j + 1).astype(np.uint8) << 7
        out[at[:-1][has] + j] = ((gaps[has] >> np.uint64(7 * j)) & np.uint64(127)).astype(np.uint8) | more
    return out, at[np.append(starts, len(gaps))]


def unpack(data: bytes) -> np.ndarray:
    """The positions whose gaps were packed."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.append(0, ends[:-1] + 1)
    nth = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.cumsum(np.add.reduceat((b & 127) << (7 * nth), starts)) if len(ends) else np.zeros(0, np.int64)


_PARTS = ("begins", "terms", "counts", "cuts", "postings")


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment."""
    hasher = Hasher()
    for batch in batches:
        for first, part in slices(batch.column("text"), SEGMENT):
            terms, counts = [], []
            for _, texts in slices(part):
                h, o = hasher.words(texts)
                terms.append(h)
                counts.append(np.diff(o))
            h, n = np.concatenate(terms), np.concatenate(counts)
            if not len(h):
                continue
            begin = np.append(0, np.cumsum(n + GAP))[:-1]
            pos = np.arange(len(h)) + np.repeat(begin - (np.cumsum(n) - n), n)
            order = np.argsort(h, kind="stable")
            h, pos = h[order], pos[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            gaps = np.diff(pos, prepend=0)
            gaps[at] = pos[at]
            data, cut = pack(gaps, at)
            ids = batch.column("doc_id").slice(first, len(part))
            parts = (begin, h[at], np.diff(np.append(at, len(h))), cut, data)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["ids", *_PARTS])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of docs, to be written and used for any number of benchmarks.

    A row is a segment: ids of its documents; begins, their first positions; terms, the 64-bit hashes of its
    words in order; counts, of postings; cuts, where each term's postings lie; postings. All but ids are
    arrays of 64-bit numbers, postings variable bytes. Rows with a null doc_id or text aren't indexed.
    """
    rows = id_text(docs, id_col, text_col).where("doc_id is not null and text is not null")
    return rows.mapInArrow(_indexer, f"ids array<{kind_of(rows, 'doc_id')}>, " + ", ".join(f"{c} binary" for c in _PARTS))


class Items:
    """Benchmark items over one sorted vocabulary; with frequencies, also which of their terms are rarest."""

    def __init__(self, items: list[tuple[object, np.ndarray]], phrase: int, least: float, rare: int):
        self.ids, self.phrase, self.least, self.rare = [i for i, _ in items], phrase, least, rare
        self.vocabulary, self.flat = np.unique(np.concatenate([w for _, w in items] or [np.zeros(0, np.uint64)]), return_inverse=True)
        self.size = np.array([len(w) for _, w in items], np.int64)
        self.at = np.append(0, np.cumsum(self.size))

    def rank(self, frequency: np.ndarray) -> None:
        """frequency: of each word of the vocabulary in all documents."""
        self.rarest = np.zeros(len(self.flat), bool)
        for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True):
            some = np.argsort(frequency[self.flat[a:b]], kind="stable")[: max(self.rare, round((b - a) * (1 - self.least)) + 2)]
            self.rarest[a + some] = True

    def possible(self, present: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(item, places where runs of `phrase` present words begin, whether enough words for proximity are present) of items that a segment may hold."""
        p = present[self.flat]
        n = np.repeat(np.minimum(self.phrase, self.size), self.size)
        total, rare = np.append(0, np.cumsum(p)), np.append(0, np.cumsum(p & self.rarest))
        j = np.arange(len(p))
        whole = np.flatnonzero(j + n <= np.repeat(self.at[1:], self.size))
        runs = whole[total[whole + n[whole]] - total[whole] == n[whole]]
        cut = np.searchsorted(runs, self.at)
        near = (self.size > 1) & (np.diff(total[self.at]) >= np.maximum(2, self.least * self.size)) & (np.diff(rare[self.at]) >= 2)
        for i in np.flatnonzero(near | (np.diff(cut) > 0)).tolist():
            yield i, runs[cut[i] : cut[i + 1]] - self.at[i], bool(near[i])


def holds(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of wanted are among the sorted values."""
    at = np.searchsorted(values, wanted)
    return values[np.minimum(at, len(values) - 1)] == wanted if len(values) else np.zeros(len(wanted), bool)


def exact_runs(lists: list[np.ndarray], windows: np.ndarray, n: int, begin: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, start, words) of the runs of n words that begin at one of `windows` places of an item.

    Each run is looked for from its rarest word: where a neighbour agrees, all words are probed. words counts
    those that the runs at one start cover.
    """
    count = np.array([len(x) for x in lists])
    rarest = windows + np.lib.stride_tricks.sliding_window_view(count, n).argmin(1)[windows]
    run: dict[tuple[int, int], set] = {}
    for r in np.unique(rarest).tolist():
        mine = windows[rarest == r]
        a, b = int(mine[0]), int(mine[-1]) + n
        start = lists[r] - r
        if n > 1:
            side = np.zeros(len(start), bool)
            for j in (r - 1, r + 1):
                if a <= j < b:
                    side |= holds(lists[j], start + j)
            start = start[side]
        if not len(start):
            continue
        hit = np.stack([holds(lists[j], start + j) for j in range(a, b)])
        total = np.concatenate((np.zeros((1, len(start)), np.int64), np.cumsum(hit, 0)))
        doc = np.searchsorted(begin, start + r, "right") - 1
        for j in mine.tolist():
            for i in np.flatnonzero(total[j - a + n] - total[j - a] == n).tolist():
                run.setdefault((int(doc[i]), int(start[i])), set()).update(range(j, j + n))
    return [(d, s, len(js)) for (d, s), js in run.items()]


def near_counts(start: np.ndarray, doc: np.ndarray, places: list[int], lists: list[np.ndarray], slack: int, begin: np.ndarray) -> np.ndarray:
    """For each start, how many of the places have their word within slack of where it should be, in that document."""
    n, ends = np.zeros(len(start), np.int64), np.append(begin[1:], np.iinfo(np.int64).max)
    for j in places:
        low, high = np.maximum(start + j - slack, begin[doc]), np.minimum(start + j + slack, ends[doc] - 1)
        n += np.searchsorted(lists[j], high, "right") > np.searchsorted(lists[j], low)
    return n


def near_places(lists: list[np.ndarray], rarest: list[int], slack: int, least: float, begin: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, start, words) where at least two of the item's rarest words stand within slack of where the item would have them, and at least a share `least` of all do."""
    start = np.concatenate([lists[j] - j for j in rarest])
    doc = np.searchsorted(begin, np.concatenate([lists[j] for j in rarest]), "right") - 1
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    new = np.append(True, (np.diff(start) != 0) | (np.diff(doc) != 0))[: len(start)]
    start, doc = start[new], doc[new]
    several = near_counts(start, doc, rarest, lists, slack, begin) >= 2
    start, doc = start[several], doc[several]
    hits = near_counts(start, doc, range(len(lists)), lists, slack, begin)
    good = hits >= max(2, least * len(lists))
    return list(zip(doc[good].tolist(), start[good].tolist(), hits[good].tolist(), strict=True))


_FOUND = ("doc_id", "item_id", "kind", "start_word", "matched", "share")


def _frequencies(vocabulary: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                terms, counts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                total += np.where(terms[at] == vocabulary, counts[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    return count


def _matcher(items: Items, slack: int, item_kind: pa.DataType):
    def match(row: dict) -> pa.RecordBatch:
        begin, terms, cuts = (np.frombuffer(row[c].as_buffer(), kind) for c, kind in (("begins", np.int64), ("terms", np.uint64), ("cuts", np.int64)))
        postings, held = row["postings"].as_buffer(), {}
        at = np.minimum(np.searchsorted(terms, items.vocabulary), len(terms) - 1)
        present = terms[at] == items.vocabulary

        def positions(word: int) -> np.ndarray:
            if word not in held:
                i = at[word]
                held[word] = unpack(postings[cuts[i] : cuts[i + 1]]) if present[word] else np.zeros(0, np.int64)
            return held[word]

        best: dict[tuple, tuple] = {}
        for i, windows, near in items.possible(present):
            a, b = items.at[i], items.at[i + 1]
            lists = [positions(w) for w in items.flat[a:b].tolist()]
            found = [("exact", x) for x in (exact_runs(lists, windows, min(items.phrase, len(lists)), begin) if len(windows) else ())]
            if near:
                found += [("proximity", x) for x in near_places(lists, np.flatnonzero(items.rarest[a:b]).tolist(), slack, items.least, begin)]
            for kind, (doc, start, matched) in found:
                now = (matched, int(begin[doc]) - start)
                if now > best.get((doc, i, kind), (-1, 0)):
                    best[doc, i, kind] = now
        rows = sorted(best.items())
        doc, item, kind = ([k[c] for k, _ in rows] for c in range(3))
        cols = [row["ids"].values.take(pa.array(doc, pa.int64())), pa.array([items.ids[i] for i in item], item_kind), pa.array(kind, pa.string()), pa.array([-at for _, (_, at) in rows], pa.int32()), pa.array([m for _, (m, _) in rows], pa.int32()), pa.array([round(m / int(items.size[k[1]]), 4) for k, (m, _) in rows], pa.float64())]
        return pa.RecordBatch.from_arrays(cols, names=list(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield match({c: batch.column(c)[i] for c in batch.schema.names})

    return run


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[tuple[object, np.ndarray]]:
    """(item, word hashes in order), on the driver: the benchmark is a fixed test set, not part of what grows. Items without words are left out, repeated ones appear once."""
    hasher, out = Hasher(), {}
    for item, text in id_text(benchmark, item_col, text_col).where("doc_id is not null and text is not null").toLocalIterator():
        words = np.concatenate([hasher.words(part)[0] for _, part in slices(pa.array([text]))])
        if len(words):
            out[item, words.tobytes()] = words
    return [(item, words) for (item, _), words in sorted(out.items(), key=lambda x: x[0])]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", phrase: int = 13, slack: int = 6, least: float = 0.7, rare: int = 8) -> DataFrame:
    """(doc_id, item_id, kind, start_word, matched, share): benchmark items that documents hold.

    kind exact: a run of `phrase` item words in a row (of all its words, if it has fewer); matched counts
    the item's words that such runs at one place cover. kind proximity: at least a share `least` of the
    item's words stand within slack words of their place. The place that matches most (the first of
    equals) is given for each document, item and kind. start_word is where the item's first word would be.

    Nulls: rows of a null doc_id or text, and items of a null id or text, take no part; nor do texts and
    items without a word. Repeated rows of documents or items give one row. Ids are of any type that can be
    ordered and keep it. An empty table gives no rows. Texts and items are matched whole, however long.
    Other columns aren't read.
    """
    work = Work(docs.sparkSession, "decontaminate")
    # Rows are large: the writer is to look at its buffer after a few, not after a hundred.
    index = work.table(build_index(docs, id_col, text_col), "index", **{"parquet.block.size.row.check.min": "2", "parquet.page.size.row.check.min": "2"})
    items = Items(benchmark_items(benchmark, item_col, item_text_col), phrase, least, rare)
    frequency = np.zeros(len(items.vocabulary), np.int64)
    for r in index.select("terms", "counts").mapInArrow(_frequencies(items.vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():  # at most a row for each word of the benchmark
        frequency[r.word] = r.n
    items.rank(frequency)
    item_type = benchmark.select(col(item_col)).schema[0].dataType
    kinds = (index.schema["ids"].dataType.elementType.simpleString(), item_type.simpleString(), "string", "int", "int", "double")
    found = index.select("ids", "begins", "terms", "cuts", "postings").mapInArrow(_matcher(items, slack, to_arrow_type(item_type)), ", ".join(f"{c} {k}" for c, k in zip(_FOUND, kinds, strict=True)))
    w = Window.partitionBy("doc_id", "item_id", "kind").orderBy(F.desc("matched"), F.asc("start_word"))
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs without the documents that `contaminated` finds, with all their columns.

    Rows of null doc_id stay, and so do null and empty texts; of a repeated doc_id all rows go if one's text
    holds an item. An empty table gives no rows, an empty benchmark takes none.
    """
    return without(docs, id_col, contaminated(docs, benchmark, id_col, text_col, **params).select("doc_id").distinct())
