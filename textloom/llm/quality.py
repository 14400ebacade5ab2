"""Quality rule: how far a document's histograms diverge from its language's.

Two histograms: character classes, and the most common words of the language with one bucket for all
others. The distance is Jensen-Shannon's, base 2: 0 for equal, 1 for disjoint histograms. The reference
of characters is the median document, class by class: junk, however long, doesn't move it while it is
the lesser part of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import Hasher, slices, text_bytes
from .work import col

CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "mark", "symbol", "wide")
_SKIP = len(CLASSES)


def class_table() -> np.ndarray:
    """The class of each byte of UTF-8; a character beyond ASCII counts once, by its first byte."""
    t = np.full(256, CLASSES.index("symbol"), np.int64)
    for name, members in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("space", b" \t"), ("line", b"\n\r\v\f"), ("stop", b".,"), ("mark", b";:?'\"()-")):
        t[list(members)] = CLASSES.index(name)
    t[0x80:0xC0] = _SKIP
    t[0xC0:] = CLASSES.index("wide")
    return t


def class_counts(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Rows x classes."""
    b, o = text_bytes(texts)
    n, width = len(o) - 1, _SKIP + 1
    row = np.repeat(np.arange(n) * width, np.diff(o))
    return np.bincount(row + table[b], minlength=n * width).reshape(n, width)[:, :_SKIP]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, of counts p to counts q (one row, or as many). A row without counts is at distance 0."""
    p, q = (x / np.maximum(x.sum(-1, keepdims=True), 1e-300) for x in (np.asarray(p, float), np.asarray(q, float)))
    q = np.broadcast_to(q, p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = sum(np.where(x > 0, x * np.log2(x / m), 0).sum(-1) for x in (p, q)) / 2
    return np.where((p.sum(-1) > 0) & (q.sum(-1) > 0), np.sqrt(np.clip(d, 0, 1)), 0.0)


def _codes(langs: pa.Array) -> tuple[np.ndarray, list]:
    d = langs.dictionary_encode("encode")
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


STEPS = 2000  # to which shares are rounded before their median is taken


def _counted(lang: str | None, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(key), np.int32))), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: (lang, word hash, count)."""
    hasher = Hasher()
    for batch in batches:
        code, langs = _codes(batch.column("lang"))
        words: list[list[np.ndarray]] = [[] for _ in langs]
        for first, texts in slices(batch.column("text")):
            h, o = hasher.words(texts)
            here = code[first : first + len(texts)]
            by_word = np.repeat(here, np.diff(o))
            for c in np.unique(here).tolist():
                words[c].append(h[by_word == c])
        for c, lang in enumerate(langs):
            w, n = np.unique(np.concatenate(words[c]), return_counts=True)
            yield _counted(lang, w.view(np.int64), n)


def _class_counter(min_chars: int):
    """Of each batch: (lang, class and rounded share as one number, documents of at least min_chars characters)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = class_table()
        for batch in batches:
            code, langs = _codes(batch.column("lang"))
            for first, texts in slices(batch.column("text")):
                chars = class_counts(texts, table)
                n, here = chars.sum(1), code[first : first + len(texts)]
                key = np.arange(_SKIP) * (STEPS + 1) + np.rint(chars * STEPS / np.maximum(n, 1)[:, None]).astype(np.int64)
                for c in np.unique(here).tolist():
                    yield _counted(langs[c], *np.unique(key[(here == c) & (n >= max(min_chars, 1))], return_counts=True))

    return count


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 64, min_chars: int = 200) -> DataFrame:
    """(lang, kind, key, n) over all documents: kind char has each class's share, in STEPS, in the median document of at
    least min_chars characters; word the count of the `top` commonest words (by hash) and, under a null key, of
    all words. A null lang is a language of its own."""
    rows = docs.select(col(lang_col).cast("string").alias("lang"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    totals = [rows.mapInArrow(f, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")) for f in (_class_counter(min_chars), _word_counter)]
    classes = totals[0].withColumn("class", F.floor(F.col("key") / (STEPS + 1)))
    one = Window.partitionBy("lang", "class")
    below = classes.withColumns({"upto": F.sum("n").over(one.orderBy("key")), "all": F.sum("n").over(one)}).where(F.col("upto") * 2 >= F.col("all"))
    chars = below.groupBy("lang", "class").agg(F.min(F.col("key") % (STEPS + 1)).alias("n")).select("lang", F.lit("char").alias("kind"), F.col("class").alias("key"), "n")
    words = totals[1].select("lang", F.lit("word").alias("kind"), "key", "n")
    best = words.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("r") <= top).drop("r")
    whole = words.groupBy("lang", "kind").agg(F.lit(None).cast("long").alias("key"), F.sum("n").alias("n"))
    return chars.unionByName(best).unionByName(whole)


def _scorer(refs: dict, min_chars: int, min_words: int, most_char: float, most_word: float, char_noise: float, word_noise: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), class_table()
        for batch in batches:
            code, langs = _codes(batch.column("lang"))
            for first, texts in slices(batch.column("text")):
                h, o = hasher.words(texts)
                chars = class_counts(texts, table)
                here = code[first : first + len(texts)]
                n_words, n_chars = np.diff(o), chars.sum(1)
                by_char, by_word = np.zeros(len(texts)), np.zeros(len(texts))
                for c in np.unique(here).tolist():
                    ref_chars, common, ref_words = refs[langs[c]]
                    mine = np.flatnonzero(here == c)
                    by_char[mine] = js_distance(chars[mine], ref_chars)
                    width = len(common) + 1
                    at = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
                    bucket = np.where(common[at] == h, at, len(common)) if len(common) else np.zeros(len(h), np.int64)
                    hist = np.bincount(np.repeat(np.arange(len(texts)) * width, n_words) + bucket, minlength=len(texts) * width).reshape(-1, width)
                    by_word[mine] = js_distance(hist[mine], ref_words)
                far_char = by_char > np.sqrt(most_char**2 + char_noise / np.maximum(n_chars, 1))
                far_word = by_word > np.sqrt(most_word**2 + word_noise / np.maximum(n_words, 1))
                keep = ~(((n_chars >= min_chars) & far_char) | ((n_words >= min_words) & far_word))
                yield pa.RecordBatch.from_arrays([*(col.slice(first, len(texts)) for n, col in zip(batch.schema.names, batch.columns, strict=True) if n not in ("text", "lang")), pa.array(n_chars.astype(np.int32)), pa.array(n_words.astype(np.int32)), pa.array(np.round(by_char, 6)), pa.array(np.round(by_word, 6)), pa.array(keep)], names=[*(n for n in batch.schema.names if n not in ("text", "lang")), *_SCORES])

    return score


_SCORES = ("n_chars", "n_words", "char_divergence", "word_divergence", "keep")
_LIMITS = {"min_chars": 200, "min_words": 30, "most_char": 0.135, "most_word": 0.12, "char_noise": 20, "word_noise": 26}
_KINDS = ("int", "int", "double", "double", "boolean")


def divergence_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = 64, min_chars: int = 200, min_words: int = 30, most_char: float = 0.135, most_word: float = 0.12, char_noise: float = 20, word_noise: float = 26, references: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_chars, n_words, char_divergence, word_divergence, keep) for every row of docs.

    keep is false if the text has at least min_chars characters and its character classes are too far
    from the language's, or at least min_words words and its common-word histogram is. A histogram of n
    counts is far from its own source by chance, by a square that shrinks as 1 / n; so too far is
    beyond sqrt(most ** 2 + noise / n). References are counted over all of docs unless given.

    Nulls: a null text is empty; a null lang is a language of its own; a null doc_id keeps its row.
    Empty and short texts are kept (length guards). Repeated rows each get a row. Equally common words
    at the edge of the list are taken by hash. A language missing from given references keeps its
    documents. An empty table gives no rows. Other columns aren't read.
    """
    refs = collected_references(references if references is not None else language_references(docs, text_col, lang_col, top, min_chars))
    rows = docs.select(col(id_col).alias("doc_id"), col(lang_col).cast("string").alias("lang"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scorer(refs, min_chars, min_words, most_char, most_word, char_noise, word_noise), f"doc_id {kind}, " + ", ".join(f"{n} {k}" for n, k in zip(_SCORES, _KINDS, strict=True)))


class References(dict):
    def __missing__(self, lang):
        return np.zeros(_SKIP), np.zeros(0, np.uint64), np.zeros(1)


def collected_references(references: DataFrame) -> dict:
    """By language: character shares, sorted hashes of common words, their counts and that of the rest. A few rows a language."""
    refs: dict = References()
    for lang, rows in references.groupBy("lang").agg(F.collect_list(F.struct("kind", "key", "n"))).collect():
        chars = np.zeros(_SKIP)
        words, whole = [], 0
        for kind, key, n in rows:
            if kind == "char":
                chars[key] = n
            elif key is None:
                whole = n
            else:
                words.append((key % (1 << 64), n))
        words.sort()
        counts = [n for _, n in words]
        refs[lang] = chars, np.array([k for k, _ in words], np.uint64), np.array([*counts, whole - sum(counts)], float)
    return refs


def keep_by_divergence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **params) -> DataFrame:
    """The rows of docs that the rule keeps, with all their columns. No shuffle of the texts: the rule runs in place."""
    names = docs.columns
    top = params.pop("top", 64)
    limits = _LIMITS | params
    refs = collected_references(language_references(docs, text_col, lang_col, top, limits["min_chars"]))
    rule = _scorer(refs, **limits)
    text_at, lang_at = names.index(text_col), names.index(lang_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_at).fill_null("")
            pair = pa.RecordBatch.from_arrays([batch.column(lang_at).cast(pa.string()), text], names=["lang", "text"])
            ok = [b.column("keep") for b in rule(iter([pair]))]
            if ok:
                yield batch.filter(pa.concat_arrays(ok))

    return docs.mapInArrow(keep, docs.schema)
