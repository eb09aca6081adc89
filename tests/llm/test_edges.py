"""Each operator and pipeline stage on nulls, empty and very long texts, repeated rows, empty tables and odd columns."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import decontamination, html_extract, language_model, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, token_count

LONG = " ".join(f"word{i % 997} x{i}" for i in range(30_000))
ROWS = [
    (1, "A line that is long enough to count\nshort", "s"), (2, "  a LINE that is long enough to count \r\nother", "s"), (3, "A line that is long enough to count", "s"),
    (4, None, None), (5, "", "t"), (None, "A line that is long enough to count", "t"), (None, None, "t"), (6, LONG, "t"), (7, LONG, "t"), (7, LONG, "t"), (8, "   \n \t ", "t"), (9, "éè \U0001f642 日本語", "t"),
]
#: Names that clash with columns operators use inside.
EXTRA = {"a.b": "9", "__gone": "8", "row": "7", "k": "0", "n": "'x'", "body": "cast(null as string)", "size": "1", "shard": "2", "words": "3", "mark": "4", "line": "5"}
VOCAB = token_count.Vocabulary((("▁", -2.0), ("a", -3.0), ("▁a", -4.0), ("l", -3.5), ("in", -4.0), ("line", -6.0)), -6.0, True)
ITEMS = [(1, "What is the sum of twelve and the number nine in this case ?"), (2, None), (3, "")]

OPERATORS = {
    "line": lambda d, s: line_dedup.drop_repeated_lines(d),
    "shard": lambda d, s: sharding.assign_shards(d, "doc_id", [1.0, 2.0, 1.0], grown_by=1.0),
    "near": lambda d, s: near_dedup.near_duplicates(d, shingle=3, percent=85),
    "substring": lambda d, s: substring_dedup.remove_repeats(d),
    "model": lambda d, s: language_model.score(d, order=3),
    "quality": lambda d, s: quality.judge(d, s.createDataFrame([(1, 0), (1, 1), (None, 0), (2, None), (99, 1)], "doc_id long, quality int")),
    "tokens": lambda d, s: token_count.count_tokens(d, VOCAB),
}


def clashing(df):
    return df.withColumns({name: F.expr(value) for name, value in EXTRA.items()})


def documents(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    return clashing(df) if extra else df


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    got = OPERATORS[name](documents(spark), spark).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark).limit(0), spark).collect() == []


def test_line_dedup_cases(spark):
    got = {(r["doc_id"], r["n_lines"]): r for r in line_dedup.drop_repeated_lines(documents(spark)).collect()}
    assert got[(1, 2)]["text"] == "short" and got[(2, 2)]["text"] == "other" and got[(3, 1)]["n_dropped"] == 0
    assert got[(None, 1)]["n_lines"] == 1 and got[(4, 1)]["text"] == "" and got[(5, 1)]["n_dropped"] == 0
    two = [(1, "x" * 19 + "\n" + "y" * 20), (2, "x" * 19 + "\n" + "Y" * 20), (3, " " + "x" * 19 + "\n" + "y" * 20)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(two, "doc_id long, text string")).collect()}
    assert out == {1: "x" * 19, 2: "x" * 19, 3: " " + "x" * 19 + "\n" + "y" * 20}


def test_line_of_code_points_not_bytes(spark):
    rows = [(i, "é" * 19 + "\n" + "é" * 20) for i in range(3)]
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: 1, 1: 1, 2: 0}


def test_sharding_law(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text")
    got = sharding.assign_shards(df, "doc_id", [1.0] * 16, grown_by=1.0).collect()
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    moved = sum(r["grown_shard"] == 16 for r in got)
    assert 100 < moved < 260
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    weighted = sharding.assign_shards(df, "doc_id", [1.0, 3.0]).groupBy("shard").count().collect()
    assert 0.7 < {r["shard"]: r["count"] for r in weighted}[1] / 3000 < 0.8
    one = sharding.assign_shards(spark.createDataFrame([(None, None), (1, "é")], "doc_id long, text string"), "doc_id", [1.0]).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["grown_shard"]) for r in one} == {(None, 1, 0, None), (1, 3, zlib.crc32("é".encode()), None)}
    with pytest.raises(ValueError):
        sharding.assign_shards(df, "doc_id", [0.0])


def test_mixing(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "if(id % 4 = 0, 'a', if(id % 4 = 1, null, 'b')) as source", "'t' as text", "1 as replica_id")
    out = mixing.mix(df, {"a": 3.0, "b": 1.0}, total=8000)
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(counts) == {"a", "b"} and abs(counts["a"] - 6000) < 300 and abs(counts["b"] - 2000) < 200
    assert sorted(map(tuple, out.select("doc_id", "replica").collect())) == sorted(map(tuple, mixing.mix(df.repartition(7), {"a": 3.0, "b": 1.0}, total=8000).select("doc_id", "replica").collect()))
    heavy = spark.range(200).selectExpr("id as doc_id", "'a' as source")
    assert abs(mixing.mix(heavy, total=20_000).count() - 20_000) < 600  # mean 100, drawn in parts
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": -1.0})


def test_near_duplicate_cases(spark):
    base = [f"w{i}" for i in range(200)]
    near = base[:100] + ["changed"] + base[101:]
    rows = [(10, " ".join(base)), (3, " ".join(near).upper()), (5, " ".join(base)), (7, "one two"), (8, "two one"), (9, "ONE  two"), (20, ""), (21, ""), (22, None), (None, " ".join(base))]
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert {k: v["component_id"] for k, v in got.items()} == {10: 3, 3: 3, 5: 3, 7: 7, 8: 8, 9: 7, 20: 20, 21: 21, 22: 22, None: None}
    assert got[7]["n_shingles"] == 1 and got[20]["n_shingles"] == 0 and got[3]["kept"] and not got[10]["kept"]


def test_near_duplicate_chain_and_large_group(spark):
    words = [f"w{i}" for i in range(300)]
    chain = []
    for step in range(6):  # neighbours link, ends don't
        chain.append((step, " ".join(words)))
        words[step * 40 : step * 40 + 18] = [f"c{step}_{i}" for i in range(18)]
    center = [f"z{i}" for i in range(120)]
    group = [(1000 + i, " ".join(center[: i % 120] + [f"u{i}"] + center[i % 120 + 1 :])) for i in range(400)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(chain + group, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert {got[i] for i in range(6)} == {0} and {got[1000 + i] for i in range(400)} == {1000}


def test_substring_cases(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(5, f"a b {passage} c"), (2, f"{passage} d"), (9, passage), (None, passage), (2, f"{passage} d"), (11, " ".join(f"p{i}" for i in range(12)))]
    got = sorted(((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([("5", 23, 20, "a b c"), ("2", 21, 0, f"{passage} d"), ("2", 21, 0, f"{passage} d"), ("9", 20, 20, ""), ("None", 20, 20, ""), ("11", 12, 0, rows[5][1])])
    spans = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 5").first()["removed"]
    assert [(s["start"], s["length"]) for s in spans] == [(2, 20)]


def test_quality_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(documents(spark), empty).collect()}
    assert got[6]["kept"] and not got[1]["kept"] and got[4]["base_failed"] and got[6]["rule"] is None


def test_decontamination_cases(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(1, "Intro. What is the sum of fifteen and the number seven in this case ? Right."), (2, "What is the sum of things in this house today"), (3, None), (4, ""), (None, "What is the sum of 15 and the number 7 in this case ?"), (5, LONG), (6, "What is the sum of fifteen and the number fifteen in this case ?")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.contaminated(docs, items).collect()}
    assert got == {1: [1], None: [1]}  # 6 puts one value in two slots
    assert decontamination.contaminated(docs.limit(0), items).count() == 0 and decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    good = lambda i: " ".join(f"g{i}w{j}" for j in range(60))
    rows = [(1000 + i, good(i % 40), f"s{i % 3}") for i in range(60)] + [(100 + i, " ".join(["junk###", "more$$$"] * 40), "s0") for i in range(30)] + [(200, good(200) + " " + ITEMS[0][1], "s1"), *ROWS]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i >= 1000)) for i in [*range(1000, 1060), *range(100, 130)]], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None)
    assert kept["quality_rules"] == [6, 7, 7, 200, *range(1000, 1060)]
    assert kept["near_duplicates"] == [6, 200, *range(1000, 1040)]
    assert 200 in kept["near_duplicates"] and 200 not in kept["benchmark_decontamination"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_html_cases(spark):
    rows = [(1, "http://h/a", "<p>One &amp; two"), (2, "http://h/b", None), (3, None, ""), (4, "http://h/c", "<main>x<script>var a='</p>'</script> y</main>"), (4, "http://h/c", "<main>x<script>var a='</p>'</script> y</main>"), (5, "bad", "<article>" + "<p>long " * 5000 + "</article>")]
    got = html_extract.extract_main_text(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    texts = sorted((r["page_id"], r["text"], r["n_chars"]) for r in got)
    assert texts[0][1] == "One & two" and texts[1][1] == "" and texts[3][1] == "x y" and texts[3] == texts[4] and texts[5][2] == 5000 * 6 - 2
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    pair = [(i, f"http://h/{i}", f"<div>Site menu</div><div>Own text {i}</div><div>All rights</div>") for i in range(2)]
    shared = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(pair, "page_id long, url string, html string").coalesce(1)).collect()}
    assert shared == {0: "Own text 0", 1: "Own text 1"}


def test_sha_of_kept_text(spark):
    out = line_dedup.drop_repeated_lines(documents(spark)).where("doc_id = 5").select(F.sha2(F.col("text").cast("binary"), 256).alias("s")).first()["s"]
    assert out == hashlib.sha256(b"").hexdigest()


def test_mixing_of_odd_rows(spark):
    df = documents(spark).withColumns({"replica": F.lit(77), "shuffle_key": F.lit("mine"), "row": F.lit(1), "own": F.lit(2), "copies": F.lit(3), "digest": F.lit(4), "rate": F.lit(5.0)})
    got = mixing.mix(df, total=60).collect()
    times = {str(r[0]) for r in ROWS}
    assert got and {str(r["doc_id"]) for r in got} <= times
    assert all(r["row"] == 1 and r["own"] == 2 and r["copies"] == 3 and r["digest"] == 4 and r["rate"] == 5.0 for r in got)
    assert all(r["replica"] < 70 and len(r["shuffle_key"]) == 32 for r in got)
    assert mixing.mix(df.limit(0)).collect() == []
