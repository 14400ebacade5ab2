"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from textloom.llm import chat, warc
from textloom.llm.chaining import shared_passages
from textloom.llm.decontaminate import contaminated, without_contaminated
from textloom.llm.licenses import scan_licenses
from textloom.llm.mixing import mixed, sample_sources
from textloom.llm.near_dedup import near_duplicates, without_near_duplicates
from textloom.llm.packing import assign_shards
from textloom.llm.quality import divergence_scores, keep_by_divergence
from textloom.llm.queries import PATTERN, RANKS
from textloom.llm.token_codes import decode, token_codes

LONG = " ".join(f"word{i % 977} and{i % 89}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and looked at the moon " * 8, "en", "a"),
    (1, "the cat sat on the mat and looked at the moon " * 8, "en", "a"),
    (2, "the cat sat on the mat and looked at the moon " * 8, "en", None),
    (3, None, "en", "a"), (4, "", None, "a"), (5, " \n ", "fr", "b"), (6, LONG, "en", "b"), (7, LONG + " tail", "en", "b"),
    (None, "a row without an id", "en", "c"), (None, None, None, None), (8, "été, œuvre — naïve", "fr", "c"), (9, "one", "en", "c"),
]
CLASH = ("rep", "key", "__gone", "turn", "unit", "segment", "term", "seed", "pos", "component", "lane", "shard", "n", "keep", "path2")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and looked at the moon"), (2, None), (None, "one"), (3, "")], "item_id long, text string")


def test_token_codes(docs, none):
    rows = token_codes(docs, RANKS, PATTERN).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[3].codes is None and by[3].n_tokens is None
    assert by[4].n_tokens == 0 and len(decode(bytes(by[4].codes))) == 0
    assert by[6].n_tokens == len(decode(bytes(by[6].codes))) > 60_000
    assert token_codes(none, RANKS, PATTERN).count() == 0


def test_chat(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, None, None), (1, 3, "assistant", "<|im_end|>x"), (1, 3, "assistant", "<|im_end|>x"), (None, 1, "system", "s"), (2, None, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("messages", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert got[1].chat == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\n< |im_end|>x\n< |im_end|>x<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert (got[1].n_turns, got[1].n_messages, got[1].roles) == (5, 3, "user,assistant,user")
    assert got[None].chat == "<|im_start|>system\ns<|im_end|>\n" and LONG in got[2].chat
    assert chat.format_chats(df.where("false")).count() == 0


def test_quality(docs, none):
    rows = divergence_scores(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.keep for r in rows if r.doc_id in (3, 4, 5, 8, 9))
    assert keep_by_divergence(docs).columns == docs.columns
    assert keep_by_divergence(docs).count() == sum(r.keep for r in rows)
    assert divergence_scores(none).count() == keep_by_divergence(none).count() == 0


def test_passages(docs, none):
    rows = shared_passages(docs).collect()
    pairs = {(r.doc_id, r.other_id) for r in rows}
    assert pairs == {(2, 1), (7, 6)}
    assert sum(r.end_word - r.begin_word for r in rows if r.doc_id == 7) >= 59_000
    assert shared_passages(none).count() == 0


def test_warc(spark):
    rows = [(1, "http://a", "<p>é</p>"), (1, "http://a", "<p>é</p>"), (2, None, None), (None, "http://b\nc", ""), (3, "http://c", LONG * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("x")).withColumn("status", F.lit(5))
    got = warc.through_warc(df).collect()
    want = [(1, "http://a", "<p>é</p>"), (1, "http://a", "<p>é</p>"), (2, None, ""), (None, "http://b%0Ac", ""), (3, "http://c", LONG * 3)]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(want, key=key)
    assert all(r.digest_ok and r.length_ok and r.status == 200 for r in got)
    assert warc.through_warc(df.where("false")).count() == 0


def test_mixing(docs, none):
    got = sample_sources(docs, share=0.5)
    assert got.count() == got.select("doc_id", "source").distinct().count()
    assert sample_sources(docs, weights={}).count() == 0
    assert mixed(docs).columns == docs.columns
    kept = {(r.doc_id, r.source) for r in got.collect()}
    assert sorted(map(str, [(r.doc_id, r.source) for r in mixed(docs).distinct().collect()])) == sorted(map(str, kept))
    assert sample_sources(none).count() == mixed(none).count() == 0


def test_decontamination(docs, none, bench):
    got = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1)}
    left = without_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert contaminated(none, bench).count() == 0
    assert contaminated(docs, bench.where("false")).count() == 0
    assert without_contaminated(docs, bench.where("false")).count() == len(ROWS)


def test_licenses(spark, docs):
    rows = [(1, "x/LICENSE", "Released under the MIT License."), (2, "x/y/a.txt", "plain"), (3, "x/y/b.txt", "foo\nAll rights reserved.\nbar baz qux one two three four"), (4, "z/a.txt", "plain"), (5, None, None), (None, "x/q", ""), (6, "x/LICENSE", "Released under the MIT License."), (None, "v/LICENSE", "All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"dir": F.lit(1), "home": F.lit(1), "license": F.lit(1)})
    got = {(r.doc_id, r.license, r.origin, r.license_path) for r in scan_licenses(df).collect()}
    assert got == {(1, "MIT", "own", "x/LICENSE"), (6, "MIT", "own", "x/LICENSE"), (2, "MIT", "inherited", "x/LICENSE"), (3, "Proprietary", "own", "x/y/b.txt"), (None, "MIT", "inherited", "x/LICENSE"), (None, "Proprietary", "own", "v/LICENSE")}
    assert scan_licenses(df.where("false")).count() == 0
    assert scan_licenses(docs.withColumn("path", F.lit("a/b"))).count() == 0


def test_near_dedup(docs, none):
    got = {(r.doc_id, r.group_id, r.keep) for r in near_duplicates(docs).collect()}
    assert got == {(1, 1, True), (2, 1, False), (6, 6, True), (7, 6, False)}
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 3, 4, 5, 6, None, None, 8, 9]))
    assert near_duplicates(none).count() == without_near_duplicates(none).count() == 0


def test_shards(docs, none):
    rows = assign_shards(docs, 1000).collect()
    assert len(rows) == len(ROWS)
    used, shards = {}, {}
    for r in rows:
        used[r.shard] = used.get(r.shard, 0) + r.bytes
        shards.setdefault(r.group_key, set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    assert sum(v > 1000 for v in used.values()) == 3  # the two long texts, and the three copies together
    assert assign_shards(none, 1000).count() == 0
