"""Cleaning, matching, parsing, statistics, sources and the runner on small hand-made cases."""

import json

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from textloom import queries
from textloom.functions import lists as L
from textloom.functions import parsing as P
from textloom.functions import text as T
from textloom.operators import lexicon, match, models, policy, sentiment, stats, summary, topics
from textloom.plans import runner
from textloom.plans.filtering import CLEAN, clean_dataset, clean_posts, filtered_posts, strict_posts
from textloom.sources import crawl, files
from textloom.streaming import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()[0]


POST = "id string, subreddit string, title string, selftext string, created_utc long"


def test_cleaning_case(spark):
    title = "See http://a.b/c and http://d.e/f <b>x</b> <i>y</i>!! WOW, ok.\n<p\nq>"
    r = clean_posts(spark.createDataFrame([("1", "s", title, "tail http://z", 1700000000)], POST)).first()
    assert r.clean_text == "See  and http://d.e/f x</b> <i>y</i>!! WOW, ok.\n<p\nq> tail http://z"
    assert r.clean_text_lc == "see  and http://d e/f x</b> <i>y</i>!! wow, ok.\n<p\nq> tail http://z"


def test_dates_and_content(spark):
    rows = [("a", "s", "ok", None, t) for t in (1640995199, 1640995200, 1735689599, 1735689600)]
    assert clean_posts(spark.createDataFrame(rows, POST)).count() == 2
    cases = [("[Deleted]", "[REMOVED]", 0), (" [deleted] ", "", 1), ("none", "null", 0), ("[removed]", "real", 1), (None, None, 0), ("ok", None, 1)]
    for t, b, n in cases:
        assert clean_posts(spark.createDataFrame([("a", "s", t, b, 1700000000)], POST)).count() == n
    assert one(spark, " [deleted] ", T.has_content_strict) is False


def test_stage2_matching_and_policy(spark):
    lex = lexicon.from_mapping(spark, {"gender": ["gender", "woman"], "race": ["race"]})
    ai = spark.createDataFrame([("ai",), ("model",)], "keyword string")
    groups = spark.createDataFrame([("tech", "technical"), ("pics", "general_reddit"), ("art", "creative_AI_communities"), ("TwoX", "critical_discussion")], "subreddit string, group string")

    def run(text, sub="tech", **kw):
        got = filtered_posts(spark.createDataFrame([("1", sub, text, None, 1700000000)], POST), groups, lex, ai, **kw).collect()
        return got[0].matched_keywords if got else None

    assert run("ai gender.") == ["gender"]
    assert run("ai, gender, race") == ["race"]
    assert run("gender! ai?") is None
    assert run("ai womans") is None
    assert run("twice ai gender\ngender") == ["gender"]
    assert run("ais gender") == ["gender"]
    assert run("ai gender", "pics") is None
    assert run("ai gender race", "PICS") == ["gender", "race"]
    assert run("ai gender race", "art") is None
    assert run("ai gender race", "art", group_match="ci") == ["gender", "race"]
    assert run("ai gender race", "nobody") is None


def test_ngrams_equal_patterns(spark):
    posts = spark.createDataFrame([(1, "of  the cat\tof the\nmat of"), (2, "a of the b"), (3, ""), (4, "x.y of\nthe"), (5, None)], "id int, clean_text_lc string")
    lex = lexicon.from_mapping(spark, {"a": ["of the", "cat", "x.y", "the mat"], "b": ["of", "the"]})
    key = lambda df: sorted(map(tuple, df.select("id", "category", "keyword").collect()))
    assert key(match.match_keywords(posts, lex)) == key(match.match_keywords_by_pattern(posts, lex)) != []


def test_strict(spark):
    ai = ["diffusion", "stable diffusion", "--ar", "/imagine", "copilot", "dalle", "prompt", "checkpoint", "bias"]
    for text, want in (("stable diffusion --ar 16", {"diffusion", "stable diffusion"}), ("x--ar 1", {"--ar"}), ("/imagine a cat", set()), ("copilots", set()), ("copilot", {"copilot"}), ("dalles", set()), ("prompts", {"prompt"}), ("checkpointed", {"checkpoint"}), ("biased image", {"bias"}), ("genderé", set())):
        assert set(one(spark, text, lambda c: match.strict_matches(c, ai))) == want
    assert one(spark, "biased", lambda c: match.strict_matches(c, ["biase"])) == []


def test_strict_posts(spark):
    schema = "id string, subreddit string, subreddit_group string, clean_text string, clean_text_lc string, matched_bias_types array<string>, matched_keywords array<string>, n int"
    rows = [("1", "a", "Technical", "T", "women x", ["old"], ["k"], 1), ("1", "a", "technical", "U", "woman ai", None, None, 2), ("2", "a", "general_reddit", "V", "woman", None, None, 3), ("nan", "a", "technical", "V", "woman", None, None, 4), ("3", "TwoXChromosomes", "critical_discussion", "V", "woman ai", [], ["z"], 5)]
    got = {r.id: r for r in strict_posts(spark.createDataFrame(rows, schema), {"gender": ["woman"], "race": ["race"]}, ["ai"], "n").collect()}
    assert set(got) == {"1", "3"} and got["1"].clean_text == "U"
    assert got["3"].matched_keywords == ["ai", "woman", "z"] and got["3"].matched_bias_types == ["gender"]


OUTPUTS = [
    ("Label: yes\nReasoning: because a, b.", "yes", "because a"),
    ('```json\n{"label": "No", "reasoning": "x y."}\n```', "no", "x y"),
    ("Label: yes or no", "yes", "No reasoning provided"),
    ('{"label": "1"}', "yes", "No reasoning provided"),
    ("Label: 1", "no", "Fallback (no strong signal): Label: 1"),
    ("Label: maybe\nReasoning: unclear", "no", "Fallback (no strong signal): Label: maybe\nReasoning: unclear"),
    ("yes the image is off", "yes", "Fallback parsing (weak keyword match): yes the image is off"),
    ("Label: no\nthis is long enough text", "no", "this is long enough text"),
    ("Post: a Post: b", "no", P.ECHOED),
    ("nothing", "no", "Fallback (no strong signal): nothing"),
]


@pytest.mark.parametrize("raw, label, reason", OUTPUTS)
def test_parse_output(spark, raw, label, reason):
    assert tuple(one(spark, raw, P.parse_output)) == (label, reason)


def test_lists(spark):
    for text, want in (("a, b", ["a", "b"]), ("[1, 2]", ["1", "2"]), (None, []), ("", []), ("x", ["x"]), ("['a b', \"c\"]", ["a b", "c"]), ("NaN", []), (" , a ,", ["a"])):
        assert one(spark, text, L.parse_list) == want
    assert one(spark, '[["joy", 0.2], ["fear", 0.9]]', lambda c: L.by_score(L.parse_scores(c)))[0].label == "fear"
    assert one(spark, None, L.length, "array<string>") == 0
    assert one(spark, [["a"], ["b", "c"]], L.flatten_lists, "array<array<string>>") == ["a", "b", "c"]
    df = spark.createDataFrame([("2024-03-05", "1"), ("bad", "1700000000"), (None, "x")], "d string, e string").select(L.month(L.timestamp(F.col("d"), F.col("e"))).alias("m"))
    assert [r.m for r in df.collect()] == ["2024-03", "2023-11", None]


def test_texts(spark):
    stop = ("this", "out", "the", "is")
    for text, want in (("Check this out: https://example.com", "check"), ("<div>Hello!</div>", "hello"), ("Just... wow!!!", "just wow"), ("THE AI IS BIASED", "ai biased"), ("can't", "cant")):
        assert one(spark, text, lambda c: T.normalized_words(c, stop)) == want
    assert one(spark, "a  http://x &amp; [deleted] b", T.basic_clean) == "a [URL] & b"
    assert one(spark, None, T.basic_clean) == ""
    assert one(spark, "x" * 200, T.shorten)[-1] == "…"
    assert one(spark, " hi ", lambda c: T.render_prompt("P: {{ post_text }}!", c)) == "P: hi!"
    assert one(spark, ["A b!", "c"], T.clean_comments, "array<string>") == ["a b", "c"]
    assert one(spark, "a.b(c)", T.escape_pattern) == r"a\.b\(c\)"


def test_models(spark):
    df = spark.createDataFrame([("1", "s", "good"), ("2", "s", "boom"), ("3", "s", None)], "id string, subreddit string, clean_text string")

    def load():
        def run(texts):
            if "boom" in texts:
                raise ValueError("x")
            return ["Label: yes\nReasoning: fine" for _ in texts]

        return run

    got = {r.id: r.pred_label for r in models.classify(df, load, batch=1).collect()}
    assert got == {"1": "yes", "2": "no", "3": "yes"}

    def broken():
        raise RuntimeError("yes: the image model file is missing")

    assert {(r.pred_label, r.llm_reasoning, r.raw_output) for r in models.classify(df, broken).collect()} == {("no", models.LOAD_FAILED, "")}

    def short():
        return lambda texts: ["Label: yes"] * (len(texts) - (texts[0] == "good"))

    got = {r.id: (r.pred_label, r.llm_reasoning) for r in models.classify(df, short, batch=1).collect()}
    assert got["1"] == ("no", "Postprocessing failed: 0 answers to 1 texts") and got["2"][0] == got["3"][0] == "yes"
    one = models.classify_one(spark, "some text", lambda: lambda ts: ["", ""][: len(ts)])
    assert (one["id"], one["subreddit"], one["pred_label"], one["raw_output"]) == ("unknown", "unknown", "no", "[EMPTY_OUTPUT]")
    lost = df.select(models.emotions(F.col("clean_text"), lambda: lambda ts: []).alias("e")).collect()
    assert [r.e for r in lost] == [None, None, []]
    scores = df.select(models.emotions(F.col("clean_text"), lambda: lambda ts: [[("a", 0.1), ("b", 0.9)] for _ in ts]).alias("e")).collect()
    assert [len(r.e) for r in scores] == [2, 2, 0] and scores[0].e[0].label == "b"
    com = spark.createDataFrame([(1, ["x", " ", "y"]), (2, None)], "id int, c array<string>")
    got = {r.id: [len(x) for x in r.scores] for r in models.comment_emotions(com, "id", "c", lambda: lambda ts: [[("a", 1.0)] for _ in ts]).collect()}
    assert got == {1: [1, 0, 1], 2: []}
    ok, bad = models.valid_classifications(models.classify(df, load, batch=1))
    assert (ok.count(), bad.count()) == (2, 1)
    assert models.suggested_batch(4) == 8


def test_statistics(spark):
    rng = np.random.default_rng(0)
    g, x = np.repeat([0, 1, 2], 30), rng.normal(size=(90, 2))
    x[60:, 0] += 2
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, (b, c) in zip(g, x, strict=True)], "g int, x double, y double")
    (_, f, p), (_, f2, p2) = stats.anova(df, "g", ["x", "y"])
    groups = [x[g == i, 0] for i in range(3)]
    mean = x[:, 0].mean()
    want = (sum(len(q) * (q.mean() - mean) ** 2 for q in groups) / 2) / (sum(((q - q.mean()) ** 2).sum() for q in groups) / 87)
    assert abs(f - want) < 1e-3 and p < 1e-4 < p2
    assert abs(stats.f_tail(3.0, 2, 10) - 0.0953674316) < 1e-9  # (1 + 2 * 3 / 10) ** -5
    # Published tests of the iris data: 4 variables, 3 groups of 50, roots 32.1919 and 0.2854.
    iris = stats.multivariate_tests([32.19193, 0.28539], 4, 2, 147)
    want = {"Wilks' lambda": (0.0234386, 199.145, 8, 288), "Pillai's trace": (1.19190, 53.466, 8, 290), "Hotelling-Lawley trace": (32.47732, 582.197, 8, 203.4), "Roy's greatest root": (32.19193, 1166.957, 4, 145)}
    for name, values in want.items():
        assert np.allclose(iris[name][:4], values, rtol=2e-4), name
    # With one degree of freedom all four are the same exact test.
    single = stats.multivariate_tests([0.7], 3, 1, 40)
    assert np.allclose([v[1] for v in single.values()], 0.7 * 38 / 3) and np.allclose([v[4] for v in single.values()], single["Pillai's trace"][4])
    effects = stats.manova_effects(df, "g", ["x", "y"])
    first, e = x[g == 0], sum(np.cov(x[g == i].T) * 29 for i in range(3))
    t2 = 30 * first.mean(0) @ np.linalg.solve(e, first.mean(0))
    assert set(effects) == {"Intercept", "g"} and abs(effects["Intercept"]["Hotelling-Lawley trace"][0] - t2) < 1e-9
    got = stats.manova(df, "g", ["x", "y"])
    assert 0 < got["Wilks' lambda"][0] < 1 and got["Pillai's trace"][4] < 1e-4
    link = stats.ward(np.array([[0.0], [1.0], [10.0]]))
    assert link[0].tolist() == [0, 1, 1, 2] and abs(link[1][2] - np.sqrt(2 * 2 / 3) * 9.5) < 1e-9


def test_topics(spark):
    rows = [([0.0, 0.0], "aa bb aa"), ([0.1, 0.0], "aa bb"), ([5.0, 5.0], "cc bb"), ([5.1, 5.0], "cc cc")]
    df = topics.assign_topics(spark.createDataFrame(rows, "embedding array<double>, clean_text string"), k=2, outlier=1.0)
    assert df.select("topic").distinct().count() == 2
    words = topics.topic_words(df, n=1)
    assert {r.word for r in words.collect()} == {"aa", "cc"}
    assert topics.topic_info(df, words).count() == 2


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), (None, 3, "z")], "k string, cnt int, n string")
    assert summary.spread(df.groupBy("k").agg(F.sum("cnt").alias("cnt")), "k", "cnt").first().most_key == "unknown"
    assert [r.n for r in summary.ranked(df.where("k = 'a'"), "k", "cnt", "n", 1).collect()] == ["x"]
    keys = spark.createDataFrame([("a", 1), ("q", 0)], "k string, at int")
    assert [r.k for r in summary.lookup(df.dropDuplicates(["k"]), keys, "k", strict=False).collect()] == ["q", "a"]
    with pytest.raises(Exception, match="no such key: q"):
        summary.lookup(df.dropDuplicates(["k"]), keys, "k").collect()
    assert [r.n for r in summary.lookup(df.where("n = 'x'"), keys.where("k = 'a'"), "k").collect()] == ["x"]
    assert summary.pairs(spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "k int, n string"), "k", "n").collect()[0].asDict() == {"a": "x", "b": "y", "cnt": 1}


def test_sources(spark, tmp_path):
    posts = [{"id": str(i), "subreddit": "s", "title": f"t{i}", "selftext": None, "created_utc": 1700000000 + i} for i in range(5)]
    lines = "\n".join(map(json.dumps, posts)) + "\nnot json\n"
    (tmp_path / "a_submissions.jsonl").write_text(lines)
    (tmp_path / "a.zst").write_bytes(zstandard.ZstdCompressor(write_content_size=False).compress(lines.encode()))
    assert files.read_jsonl(spark, str(tmp_path / "a_submissions.jsonl"), strict=False).count() == 5
    with pytest.raises(Exception, match="(?i)malformed|failfast|bad record"):
        files.read_jsonl(spark, str(tmp_path / "a_submissions.jsonl")).collect()
    assert files.preview(spark, str(tmp_path / "a_submissions.jsonl"), 2).count() == 2
    raw = files.read_zst_lines(spark, [f"file://{tmp_path}/a.zst"])
    assert raw.count() == 6 and files.parse_lines(raw).count() == 5
    files.write_csv(spark.createDataFrame([("1", ["a", "b"], "x\ny")], "id string, matched_keywords array<string>, clean_text string"), str(tmp_path / "csv"))
    back = files.read_csv_set(spark, str(tmp_path / "csv" / "*.csv")).first()
    assert back.matched_keywords == "a, b" and back.clean_text == "x\ny" and back.created_dt is None and back.subreddit.startswith("part")
    with pytest.raises(FileNotFoundError):
        files.read_csv_set(spark, str(tmp_path / "nothing*.csv"))
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "a_keyword_filtered.csv").write_text("id,subreddit,clean_text\n1,s1,hello\n")
    (tmp_path / "set" / "b_keyword_filtered.csv").write_text("subreddit,id,clean_text,extra\ns2,2,world,x\n,3,again,y\n")
    (tmp_path / "set" / "c_keyword_filtered.csv").write_text("")
    got = files.read_csv_set(spark, str(tmp_path / "set" / "*.csv"))
    assert sorted((r.id, r.subreddit, r.clean_text, r.extra, r.title) for r in got.collect()) == [("1", "s1", "hello", None, None), ("2", "s2", "world", "x", None), ("3", "b", "again", "y", None)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("")
    with pytest.raises(RuntimeError):
        files.read_csv_set(spark, str(tmp_path / "none" / "*.csv"))
    files.write_header(spark, ["id", "raw_output"], str(tmp_path / "head"))
    assert [p.read_text() for p in (tmp_path / "head").glob("part*")] == ["id,raw_output\n"]
    for n, want in ((0, []), (2, [{"id": 0, "t": "é\n"}, {"id": 1, "t": "é\n"}])):
        files.write_json_array(spark.range(n).withColumn("t", F.lit("é\n")), f"file://{tmp_path}/{n}.json")
        text = (tmp_path / f"{n}.json").read_text("utf-8")
        assert text == json.dumps(want, ensure_ascii=False, indent=2)
    preview = files.extract_zst(spark, f"file://{tmp_path}/a.zst", str(tmp_path / "extracted"), delete_source=True)
    assert preview.count() == 5 and not (tmp_path / "a.zst").exists()
    (tmp_path / "empty.zst").write_bytes(zstandard.ZstdCompressor().compress(b""))
    with pytest.raises(Exception, match="nothing in"):
        files.read_zst_lines(spark, [f"file://{tmp_path}/empty.zst"]).collect()
    assert files.read_zst_lines(spark, [f"file://{tmp_path}/empty.zst"], allow_empty=True).count() == 0
    files.jsonl_to_csv(spark, str(tmp_path / "a_submissions.jsonl"), str(tmp_path / "as_csv"))
    assert files.read_csv_set(spark, str(tmp_path / "as_csv" / "*.csv")).count() == 5
    assert files.list_extracted(spark, str(tmp_path)) == ["a_submissions.jsonl"]
    assert files.register(files.sample_posts(spark, 6), "sample").count() == spark.sql("select distinct id from sample").count() == 6
    assert clean_posts(files.sample_posts(spark, 6)).count() == 6
    files.write_json(spark.range(2), str(tmp_path / "json"))
    assert files.read_json_array(spark, str(tmp_path / "json"), "id long").count() >= 1
    ingest.write_available(ingest.stream_posts(spark, str(tmp_path / "*.jsonl")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert files.empty(spark, files.RAW).count() == 0


def test_crawl(spark, tmp_path):
    data = {"a": [{"id": str(i)} for i in range(7)], "b": [{"id": "3"}, {"id": "9"}]}
    state = {"failed": False}

    def fetch_of(name):
        def fetch(cursor, n):
            if name == "a" and not state["failed"]:
                state["failed"] = True
                raise ConnectionError
            at = int(cursor or 0)
            return data[name][at : at + min(n, 3)], str(at + 3) if at + 3 < len(data[name]) else None

        return fetch

    df, failed = crawl.crawl(spark, ["a", "b", "c"], fetch_of, 6, "id string", f"file://{tmp_path}/crawl", wait=0.0)
    assert sorted(r.id for r in df.collect()) == ["0", "1", "2", "3", "4", "5", "9"] and [r.source for r in failed.collect()] == ["c"]
    assert sorted(p.name for p in (tmp_path / "crawl").glob("source=*")) == ["source=a", "source=b", "source=c"]
    server = lambda cursor, n: ([{"id": int(cursor or 0) + i} for i in range(n)], str(int(cursor or 0) + n))
    assert len(crawl.pages(server, 250)) == 250 and len(crawl.pages(server, 250, whole_pages=True)) == 300
    posts, cursor = crawl.listing({"data": {"children": [{"data": {"id": "x", "title": "t"}}], "after": ""}})
    assert cursor is None and crawl.completed(posts[0], "s")["subreddit"] == "s" and crawl.checked(posts[0], ["id"]) == {"id": "x"}
    with pytest.raises(KeyError):
        crawl.checked(posts[0], ["id", "score"])


def test_runner(spark, tmp_path):
    made = []
    out = str(tmp_path / "x")
    steps = [runner.Step("Clean posts", lambda: (made.append(1), (tmp_path / "x").write_text("y")), (out,)), runner.Step("match", lambda: 1 / 0)]
    assert runner.discover(["b_posts.jsonl", "d/a_submissions.zst", "a.zst", "c.txt"]) == ["a", "b"]
    assert [s.name for s in runner.chosen(steps, skip="MATCH")] == ["Clean posts"]
    runner.run_steps(spark, steps[:1])
    runner.run_steps(spark, steps[:1])
    assert made == [1]
    runner.run_steps(spark, steps[:1], force=True)
    assert made == [1, 1]
    with pytest.raises(runner.StepFailed):
        runner.run_steps(spark, steps)


def test_policy(spark):
    df = spark.createDataFrame([("s", None), ("s", "critical_discussion")], "sub string, g string")
    got = [r.k for r in df.select(policy.keep_strict(F.col("sub"), F.col("g"), F.lit(True), F.lit(False)).alias("k")).collect()]
    assert got == [False, True]


def test_strict_lookups_equal_patterns(spark):
    words = ["ai", "model", "stable diffusion", "gpt-4", "women's", "--ar", "/imagine", "copilot", "dalle", "c++", "ſtyle", "naïve art", "art", "artifici", "x_y"]
    texts = [" ".join(t) for t in (["ai models", "ais"], ["stable  diffusion", "stable diffusions."], ["gpt-4s", "gpt-45"], ["women's", "womens"], ["x--ar 1", "--ar"], ["copilots", "(copilot)"], ["c++", "c++s"], ["style ſtyle", "ſtyles"], ["naïve art", "naïve arty"], ["artificial", "artical artes"], ["x_y", "x_ys _x_y"], ["ai_model", "ai-model"], ["aı", "AI".lower()], ["é", ""])]
    df = spark.createDataFrame(list(enumerate([*texts, "", None])), "i int, t string")
    by_pattern = F.filter(F.array(*(F.when(F.col("t").rlike(match.strict_pattern(w)), F.lit(w)) for w in words)), lambda k: k.isNotNull())
    for r in df.select("t", by_pattern.alias("want"), match.strict_matches(F.col("t"), words).alias("got")).collect():
        assert (r.got or []) == r.want, r.t
    both = df.select(F.inline(F.array(match.strict_hits(F.coalesce("t", F.lit("")), {"a": ["ai", "art"], "b": ["ai"]}, ["model"])))).collect()
    assert (both[0].types, both[0].words, both[0].more) == (["a", "b"], ["ai", "ai"], ["model"])


def test_large_lexicons_are_joined(spark, monkeypatch):
    lex = lexicon.from_mapping(spark, {"gender": ["gender", "woman"], "race": ["race of"]})
    ai = spark.createDataFrame([("ai",), ("model",)], "keyword string")
    groups = spark.createDataFrame([("tech", "technical")], "subreddit string, group string")
    rows = [("1", "tech", "ai gender race of", "ai gender", 1700000000), ("1", "tech", "ai gender race of", "ai gender", 1700000000), ("2", "tech", "models woman", None, 1700000000), ("3", "tech", "woman", None, 1700000000)]
    posts = spark.createDataFrame(rows, POST)
    few = sorted(filtered_posts(posts, groups, lex, ai).collect())
    monkeypatch.setattr(match, "MOST", 1)
    assert sorted(filtered_posts(posts, groups, lex, ai).collect()) == few and len(few) == 2


def test_keyword_stage_moves_no_text(spark):
    from textloom.queries import flagship

    plan = flagship(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert exchanged and not any("text" in line for line in exchanged) and "BroadcastNestedLoop" not in plan


def test_sentiment(spark):
    words = {"good": 1.9, "bad": -2.5, "great": 3.1}
    assert sentiment.polarity("it is good", words) == {"neg": 0.0, "neu": 0.408, "pos": 0.592, "compound": 0.4404}
    assert sentiment.polarity("it is not good", words)["compound"] == -0.3412
    assert sentiment.polarity("very good!!", words)["compound"] > sentiment.polarity("good", words)["compound"]
    assert sentiment.polarity("good but bad", words)["compound"] < 0 and sentiment.polarity("", words)["compound"] == 0.0
    got = spark.createDataFrame([("it is good",), (None,), ("",)], "t string").select(sentiment.sentiment(F.col("t"), words).alias("s")).collect()
    assert got[0].s.compound == 0.4404 and got[1].s is None and got[2].s.neu == 0.0


def test_clean_dataset(spark):
    rows = [("1", "s", "A b!", None, [" X y. ", "z"], 3), ("2", "s", " [deleted] ", "null", None, 4), ("3", "s", None, "body", None, 5)]
    got = clean_dataset(spark.createDataFrame(rows, "id string, subreddit string, title string, selftext string, comments array<string>, score int"), ("b",))
    assert got.columns == list(CLEAN) and len(CLEAN) == 13
    by = {r.id: r for r in got.collect()}
    assert set(by) == {"1", "3"} and by["1"].clean_text == "a" and by["1"].top_comments == ["x y", "z"] and by["3"].flair is None


def test_keep_last_ties(spark, tmp_path):
    """Of equal lines the first in the files stays, in whatever order Spark reads them: here the larger, later file first."""
    rows = "l_orderkey long, l_linenumber int, l_quantity double"
    for name, some in (("a", [(1, 5, 1.0)]), ("b", [(1, 5, 2.0)] + [(k, 1, float(k)) for k in range(2, 5000)])):
        spark.createDataFrame(some, rows).coalesce(1).write.parquet(str(tmp_path / name))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    got = queries.keep_last_by_id(spark, str(tmp_path))
    assert got.where("l_orderkey = 1").first().l_quantity == 1.0 and got.count() == 4999


ODD = ["", " ", "\n", "\t x ", " lead", "trail ", "a\r\nb", "a\rb", " ", "none", " [Removed] ", '"q"', '"', "\\", 'a\\"b', "x,y", "a\n", "que", None]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """documents of blank and odd texts, each under five ids, and what a query's SQL says of them."""
    import duckdb

    at = str(tmp_path_factory.mktemp("odd"))
    docs = [(i, t, "en", f"src{i % 12}", len(t or "")) for i, t in enumerate(t for t in ODD for _ in range(5))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{at}/documents.parquet/*.parquet'")

    def check(name):
        f, sql = queries.Q[name]
        want = c.execute(sql)
        names = [x[0] for x in want.description]
        assert sorted(map(repr, map(tuple, f(spark, at).select(*names).collect()))) == sorted(map(repr, want.fetchall()))

    return check


def test_emotions_of_blank_documents(odd):
    odd("emotion_scores")


def test_clean_columns_of_blank_documents(odd):
    odd("clean_columns")


def test_csv_keeps_texts(odd):
    """Empty texts and white space come back from CSV as they went in."""
    odd("json_to_csv")


def test_texts_reach_the_model_in_batches(spark):
    """Texts come as Arrow arrays, and only a batch of them at once as Python's: no pandas, which holds all of a partition's part twice."""
    assert not hasattr(models, "pd")
    df = spark.range(25).coalesce(1).select("id", F.when(F.col("id") != 7, F.concat(F.lit("text "), "id")).alias("clean_text"))
    got = models.classify(df, lambda: lambda ts: [f"Label: no\nReasoning: {len(ts)} of a batch" for _ in ts]).groupBy("llm_reasoning").count().collect()
    assert sorted((r[0], r[1]) for r in got) == [("16 of a batch", 16), ("9 of a batch", 9)]


def test_words_are_counted_once(spark, tmp_path):
    """Texts are cut into words once in a plan, for the words of a topic as for their pairs."""
    rows = [("x", "apple apple pear fig"), ("x", "apple pear"), ("y", "pear fig fig"), (None, "fig apple")]
    spark.createDataFrame(rows, "topic string, clean_text string").write.parquet(str(tmp_path / "d"))
    pairs = topics.word_pairs(topics.topic_words(spark.read.parquet(str(tmp_path / "d")), n=2))
    assert sorted(map(tuple, pairs.collect())) == [("x", "apple", "pear"), ("y", "fig", "pear")]
    final = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Generate explode(map_entries") == 1
