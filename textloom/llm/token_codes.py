"""Token ids as directly addressable codes (Brisaboa, Ladra and Navarro, 2013).

Each id is split into chunks of `bits` bits, the lowest first. Level 0 holds the first chunk of every
token, level 1 the second chunk of the tokens that have one, and so on. A bitmap for each level but the
last says which tokens go on, and a rank directory, the count of set bits before each block of 512,
gives a token's place in the next level. Any token is read in as many steps as it has chunks.

Layout of a code, little-endian: u8 bits, u8 levels, u16 0, u32 n; for each level: u32 m, m chunks (one
byte each if bits <= 8, else two), then, but for the last level, ceil(m / 8) bytes of bitmap, low bit
first, and ceil(m / 512) u32 of directory. An empty text has no level.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import col, kind_of
from .words import slices

BLOCK = 512


def encode(ids: np.ndarray, bits: int = 8) -> bytes:
    rest = np.asarray(ids).astype(np.uint32)
    out, levels = [], 0
    kind = np.uint8 if bits <= 8 else np.uint16
    while len(rest):
        chunk, high = (rest & np.uint32((1 << bits) - 1)).astype(kind), rest >> np.uint32(bits)
        more = high > 0
        levels += 1
        out += [struct.pack("<I", len(rest)), chunk.tobytes()]
        rest = high[more]
        if len(rest):
            packed = np.packbits(more, bitorder="little")
            sums = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK))
            out += [packed.tobytes(), np.append(np.uint32(0), np.cumsum(sums)[:-1]).astype("<u4").tobytes()]
    return struct.pack("<BBHI", bits, levels, 0, len(ids)) + b"".join(out)


def _levels(code: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(m, offset of chunks, of bitmap, of directory) by level."""
    bits, levels, _, _ = struct.unpack_from("<BBHI", code)
    at, width = 8, 1 if bits <= 8 else 2
    for level in range(levels):
        (m,) = struct.unpack_from("<I", code, at)
        chunks = at + 4
        bitmap = chunks + m * width
        directory = bitmap + (-(-m // 8) if level < levels - 1 else 0)
        at = directory + (4 * -(-m // BLOCK) if level < levels - 1 else 0)
        yield m, chunks, bitmap, directory


def length(code: bytes) -> int:
    return struct.unpack_from("<I", code, 4)[0]


def access(code: bytes, i: int) -> int:
    """Token i. Reads one chunk, one bit and at most a block of the bitmap a level, nothing else."""
    bits, levels, _, n = struct.unpack_from("<BBHI", code)
    if not 0 <= i < n:
        raise IndexError(i)
    value, kind = 0, "<B" if bits <= 8 else "<H"
    for level, (_, chunks, bitmap, directory) in enumerate(_levels(code)):
        value |= struct.unpack_from(kind, code, chunks + i * (1 if bits <= 8 else 2))[0] << (bits * level)
        if level == levels - 1 or not code[bitmap + i // 8] >> (i % 8) & 1:
            break
        block = i // BLOCK
        begin, end = block * BLOCK // 8, i // 8
        inside = int.from_bytes(code[bitmap + begin : bitmap + end + 1], "little") & ((1 << (i - block * BLOCK)) - 1)
        i = struct.unpack_from("<I", code, directory + 4 * block)[0] + inside.bit_count()
    return value


def decode(code: bytes) -> np.ndarray:
    """All tokens."""
    bits, levels, _, n = struct.unpack_from("<BBHI", code)
    kind, out, at = np.uint8 if bits <= 8 else np.uint16, np.zeros(n, np.uint32), np.arange(n)
    for level, (m, chunks, bitmap, _) in enumerate(_levels(code)):
        out[at] |= np.frombuffer(code, kind, m, chunks).astype(np.uint32) << np.uint32(bits * level)
        if level < levels - 1:
            at = at[np.unpackbits(np.frombuffer(code, np.uint8, -(-m // 8), bitmap), count=m, bitorder="little").astype(bool)]
    return out


_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_TAIL = r"|\s+(?!\S)|\s+"
LONG = 100_000  # white space from which the pre-tokenizer isn't asked: its stack is limited


def tokenizer(ranks_path: str, pattern: str):
    """A function from a text to its ids.

    A pattern that ends in the usual `\\s+(?!\\S)|\\s+` makes one piece of a run of white space, or of all but its
    last character if more text follows; so long runs are cut out beforehand, with the same ids. With other
    patterns a run of a million white-space characters may fail.
    """
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    if not pattern.endswith(_TAIL):
        return coding.encode_ordinary
    long_run = re.compile(f"{_SPACE}{{{LONG},}}")

    def ids_of(text: str) -> list[int]:
        if len(text) < LONG:
            return coding.encode_ordinary(text)
        out, at = [], 0
        for m in long_run.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += coding.encode_ordinary(text[at : m.start()])
            out += coding._encode_single_piece(text[m.start() : end])
            at = end
        return out + coding.encode_ordinary(text[at:])

    return ids_of


def _coder(ranks_path: str, pattern: str, bits: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(ranks_path, pattern)
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                n, codes = [], []
                for text in texts.to_pylist():
                    ids = None if text is None else np.array(ids_of(text), np.uint32)
                    n.append(None if ids is None else len(ids))
                    codes.append(None if ids is None else encode(ids, bits))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(n, pa.int32()), pa.array(codes, pa.binary())], names=["doc_id", "n_tokens", "codes"])

    return code


def token_codes(docs: DataFrame, ranks_path: str, pattern: str, bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens int, codes binary), a row for every row of docs, in place: no shuffle.

    ranks_path: a public byte-level vocabulary as base64 ranks, at the same path on every machine; pattern:
    its pre-tokenizer. Strings that look like special tokens are ordinary text.

    Nulls: a null text gives null n_tokens and codes; an empty one 0 tokens and a code without levels. A null
    doc_id keeps its row, repeated rows each get one; ids keep their type. An empty table gives no rows. Texts
    are coded whole, white space of any length included; one code holds fewer than 2 ** 31 tokens. Other
    columns aren't read.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_coder(ranks_path, pattern, bits), f"doc_id {kind_of(rows, 'doc_id')}, n_tokens int, codes binary")


def _file_writer(base: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = pafs.FileSystem.from_uri(base)
        files.create_dir(root, recursive=True)
        part, draft = f"part-{task.partitionId():06d}.codes", f".draft-{task.partitionId()}-{task.taskAttemptId()}"
        at, rows = 0, []
        with files.open_output_stream(f"{root}/{draft}", compression=None) as out:
            for batch in batches:
                sizes = []
                for code in batch.column("codes").to_pylist():
                    sizes.append(None if code is None else len(code))
                    out.write(code or b"")
                ends = at + np.cumsum([n or 0 for n in sizes], dtype=np.int64)
                begins = pa.array(ends - [n or 0 for n in sizes], pa.int64(), mask=np.array([n is None for n in sizes], bool))
                at = int(ends[-1]) if len(ends) else at
                rows.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array([f"{base}/{part}"] * len(sizes), pa.string()), begins, pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens", "path", "begin", "bytes"]))
        files.move(f"{root}/{draft}", f"{root}/{part}")  # only whole files get their name, however often a task is run
        yield from rows

    return write


def write_codes(codes: DataFrame, base: str) -> DataFrame:
    """Writes the codes of `token_codes` one after another to binary files under base, a file a partition; lazily.

    Rows: doc_id, n_tokens, path, begin, bytes: where each document's code lies. A null code has null begin
    and bytes. An empty partition leaves an empty file. base is a URI that all machines can write to.
    """
    return codes.mapInArrow(_file_writer(base), f"doc_id {kind_of(codes, 'doc_id')}, n_tokens int, path string, begin long, bytes long")


def read_token(path: str, begin: int, size: int, i: int) -> int:
    """Token i of the code at a place of a file that `write_codes` made."""
    files, at = pafs.FileSystem.from_uri(path)
    with files.open_input_file(at) as f:
        return access(f.read_at(size, begin), i)


def token_at(codes: Column, place: Column) -> Column:
    """The token at a place (0-based), by random access; null where either is null or the place is outside."""

    @F.pandas_udf("int")
    def at(c: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([access(x, int(j)) if x is not None and j is not None and j == j and 0 <= j < length(x) else None for x, j in zip(c, i, strict=True)], dtype="Int32")

    return at(codes, place.cast("long"))
