"""Ids that aren't numbers, rows that share an id, and the pipeline on rows of all kinds."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import chat, queries, token_codes, warc
from textloom.llm.chaining import shared_passages
from textloom.llm.decontaminate import contaminated, without_contaminated
from textloom.llm.licenses import scan_licenses
from textloom.llm.mixing import mixed, sample_sources
from textloom.llm.near_dedup import near_duplicates, without_near_duplicates
from textloom.llm.packing import assign_shards
from textloom.llm.quality import divergence_scores
from textloom.llm.queries import PATTERN, RANKS, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def numbered(spark):
    return table(spark, SF, "documents").where("doc_id < 120").cache()


@pytest.fixture(scope="module")
def named(numbered):
    """The same with ids a-0000 and so on, in the same order."""
    return numbered.withColumn("doc_id", F.format_string("a-%04d", "doc_id"))


@pytest.fixture(scope="module")
def bench(spark):
    return table(spark, SF, "benchmark")


def as_named(rows, *names):
    return sorted(tuple(f"a-{v:04d}" if c in names and v is not None else v for c, v in r.asDict().items()) for r in rows)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_string_ids(numbered, named, bench):
    assert rows(near_duplicates(named)) == as_named(near_duplicates(numbered).collect(), "doc_id", "group_id") != []
    assert rows(shared_passages(named)) == as_named(shared_passages(numbered).collect(), "doc_id", "other_id") != []
    assert rows(contaminated(named, bench.withColumn("item_id", F.format_string("a-%04d", "item_id")))) == as_named(contaminated(numbered, bench).collect(), "doc_id", "item_id") != []
    assert rows(divergence_scores(named)) == as_named(divergence_scores(numbered).collect(), "doc_id")
    got = {r.doc_id for r in sample_sources(named).collect()}
    assert got and {r.doc_id for r in mixed(named).collect()} == got
    assert rows(assign_shards(named, 5000)) == as_named(assign_shards(numbered, 5000).collect(), "doc_id")
    paths = [d.withColumn("path", F.concat("source", F.lit("/x"))) for d in (named, numbered)]
    assert rows(scan_licenses(paths[0])) == as_named(scan_licenses(paths[1]).collect(), "doc_id")
    assert dict(near_duplicates(named).dtypes)["group_id"] == "string" and dict(near_duplicates(numbered).dtypes)["group_id"] == "bigint"


def test_large_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big + i, "some words here", "a") for i in range(40)] + [(None, "x", "a")], "doc_id long, text string, source string")
    assert {r.doc_id for r in sample_sources(df).collect()} <= {None, *range(big, big + 40)}


def test_rows_that_share_an_id(spark):
    a, b = "the cat sat on the mat and looked at the moon " * 4, "completely different words about other things entirely " * 4
    df = spark.createDataFrame([(1, a, "p"), (1, b, "q"), (1, b, "r"), (2, a + "once more", "s"), (3, None, "t"), (3, None, "u"), (4, "", "v"), (None, a, "w")], "doc_id long, text string, nth string")
    left = without_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(1, a), (1, b), (3, ""), (3, ""), (4, ""), (0, a)])
    assert sorted(r.doc_id for r in without_near_duplicates(df.where("nth in ('p', 's', 't')")).collect()) == [1, 3]


def test_long_white_space(spark):
    texts = [" " * 2_000_000, "\n" * 1_000_000 + "a", "a " + "\t" * 150_000 + " b", "x" + " " * 1_500_000, "word " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    names = {}
    import base64

    with open(RANKS, "rb") as f:
        for line in f:
            piece, rank = line.split()
            names[int(rank)] = base64.b64decode(piece)
    got = {r.doc_id: bytes(r.codes) for r in token_codes.token_codes(df, RANKS, PATTERN).collect()}
    for i, text in enumerate(texts):
        assert b"".join(names[t] for t in token_codes.decode(got[i]).tolist()).decode() == text


def test_cut_white_space_keeps_ids(monkeypatch):
    import random

    whole = token_codes.tokenizer(RANKS, PATTERN)
    rng = random.Random(4)
    texts = ["".join(rng.choice((" ", "  ", "\n", "     ", "\t　", "a", "b1", ".", "é", "\x1c", "      \n\n\n")) for _ in range(rng.randrange(30))) for _ in range(3000)]
    want = [whole(t) for t in texts]
    monkeypatch.setattr(token_codes, "LONG", 5)
    cut = token_codes.tokenizer(RANKS, PATTERN)
    assert [cut(t) for t in texts] == want


def test_code_files(spark, numbered, tmp_path):
    codes = token_codes.token_codes(numbered.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")), RANKS, PATTERN)
    kept = {r.doc_id: r for r in codes.collect()}
    listed = token_codes.write_codes(codes.repartition(3), f"file://{tmp_path}/codes").collect()
    assert sorted(r.doc_id for r in listed) == sorted(kept) and not list((tmp_path / "codes").glob(".draft*"))
    for r in listed:
        if r.doc_id == -1:
            assert r.begin is None and r.bytes is None
            continue
        code = bytes(kept[r.doc_id].codes)
        assert r.bytes == len(code)
        for i in {0, r.n_tokens // 2, r.n_tokens - 1} if r.n_tokens else ():
            assert token_codes.read_token(r.path, r.begin, r.bytes, i) == token_codes.access(code, i)
    assert token_codes.write_codes(codes.where("false"), f"file://{tmp_path}/none").count() == 0


def test_chat_keeps_code(spark):
    df = spark.createDataFrame([(1, 1, "user", "xs <| List.map f <|im_start|>"), (None, 1, "user", "a"), (None, 2, "user", "b")], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id or 0, r.chat) for r in chat.format_chats(df).collect())
    assert got == [(0, "<|im_start|>user\na<|im_end|>\n"), (0, "<|im_start|>user\nb<|im_end|>\n"), (1, "<|im_start|>user\nxs <| List.map f < |im_start|><|im_end|>\n")]
    sql = duckdb.connect()
    sql.register("conversations", df.toPandas().astype({"conv_id": "Int64"}))
    assert sorted((r[0] or 0, r[4]) for r in sql.execute(chat.CHAT_SQL).fetchall()) == got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    sql = duckdb.connect()
    for t in ("conversations", "pages"):
        sql.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = sql.execute(queries.oracle_sql()[name]).df()
    assert sorted(map(repr, df.toPandas()[sorted(df.columns)].astype(str).values.tolist())) == sorted(map(repr, want[sorted(want.columns)].astype(str).values.tolist())) != []


def test_digest_kinds():
    import base64
    import hashlib

    body = b"some bytes"
    for kind in ("md5", "sha1", "sha256", "sha512"):
        made = hashlib.new(kind, body)
        for text in (made.hexdigest(), made.hexdigest().upper(), base64.b32encode(made.digest()).decode(), base64.b32encode(made.digest()).decode().rstrip("=")):
            assert warc.verified(f"{kind}:{text}", body) is True and warc.verified(f"{kind}:{text}", b"x") is False
    assert warc.verified("sha-1:" + hashlib.sha1(body).hexdigest(), body) is True
    assert warc.verified("crc:1", body) is None and warc.verified(None, body) is None


def test_files_of_a_reader(spark, tmp_path):
    df = spark.range(64).selectExpr("id as page_id", "concat('http://', id) as url", "repeat('x', 1000) as html").repartition(16)
    listed = warc.write_warc(df, f"file://{tmp_path}/w")
    read = warc.read_warc(spark, spark.createDataFrame([(r.path,) for r in listed.collect()], "path string"))
    per = read.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("path").alias("n")).collect()
    assert read.count() == 64 and max(r.n for r in per) <= 2


def stages(spark, docs, sf_dir):
    for _, f in corpus_pipeline.STAGES:
        columns, docs = docs.columns, f(spark, docs, sf_dir).cache()
        yield columns, docs


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pipeline_on_any_rows(spark, tmp_path, bench, kind):
    text, other = "the cat sat on the mat and looked at the moon " * 9, "quite another text of words that stand nowhere else in it " * 9
    item = bench.where("item_id = 1").first().text
    data = [("1", text, "en", "a"), ("1", text, "en", "a"), ("2", text + "again", "en", None), ("3", None, "en", "a"), ("4", "", None, "a"), ("5", " \n ", "fr", "b"), ("6", other, "en", "b"), ("7", f"some {item} words", "en", "b"), (None, "a row without an id", "en", "c"), (None, None, None, None), ("8", " " * 300_000, "fr", "c"), ("9", " ".join(f"w{i % 997}" for i in range(60_000)), "en", "b")]
    df = spark.createDataFrame(data, "doc_id string, text string, lang string, source string").withColumn("doc_id", F.col("doc_id").cast(kind)).withColumns({c: F.lit(c) for c in ("unit", "gone", "keep", "key", "turn", "n_chars")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    ids, last = [], None
    for columns, out in stages(spark, df, str(tmp_path)):
        ids.append(sorted(str(r.doc_id) for r in out.select("doc_id").collect()))
        assert last is None or last == columns or out.columns[:1] == ["doc_id"]
        last = columns
    assert ids[1].count("1") == 1 and "2" not in ids[1] and "6" in ids[1]
    assert "7" in ids[1] and "7" not in ids[2] and {"3", "4", "5", "8", "None"} <= set(ids[2])
    assert set(ids[4]) == set(ids[3]) <= set(ids[2])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.columns == ["doc_id", "n_tokens", "codes"] and sorted(str(r.doc_id) for r in run.collect()) == ids[3]
    df.where("false").write.parquet(f"{tmp_path}/empty/documents.parquet")
    bench.where("false").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    assert without_contaminated(df, bench.where("false")).count() == len(data)


