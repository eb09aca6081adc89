"""Operators that SQL can't express against plain versions, on generated texts and on the smallest tables."""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from strandline.llm import html_extract, language_model, near_dedup, quality, registry, substring_dedup, token_count

SF = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows(name, columns):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{SF}/{name}.parquet' ORDER BY 1").fetchall()


def words(text):
    return WORD.findall((text or "").encode())


@tables
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(str, r)) for r in want)


def near_reference(docs, size=3, percent=85):
    sets = {}
    for i, t in docs:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@tables
def test_near_duplicates(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.query(spark, SF).collect()}
    assert got == near_reference(rows("documents", "doc_id, text"))


def test_near_duplicates_of_generated_edits(spark):
    rng, docs = random.Random(5), []
    for g in range(12):
        base = [f"g{g}_{rng.randrange(60)}" for _ in range(150)]
        for _ in range(8):
            edited = list(base)
            for _ in range(rng.randrange(0, 9)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            docs.append((len(docs) * 3 % 97 + len(docs) * 100, " ".join(edited)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert got == near_reference(docs)


def test_similarity_of_greatest_likelihood():
    rng = np.random.default_rng(1)
    for shared in (40, 200, 900):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (shared, 100, 150))
        x, y = np.unique(np.concatenate((common, a))), np.unique(np.concatenate((common, b)))
        r = near_dedup.registers([x, y]).astype(int)
        got = near_dedup.likeliest_similarity(np.array([float(len(x))]), np.array([float(len(y))]), np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]))[0]
        assert abs(got - shared / (shared + 250)) < 0.08
    both = near_dedup.registers([np.unique(np.concatenate((x, y)))])[0]
    assert (both == np.maximum(*near_dedup.registers([x, y]))).all()  # registers merge


@tables
def test_substrings(spark):
    first, want = {}, {}
    for i, t in rows("documents", "doc_id, text"):
        w, inside = words(t), set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                inside.update(range(k, k + 13))
        want[i] = (len(w), len(inside))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.query(spark, SF).collect()} == want


def ppm_reference(training, order):
    counts = defaultdict(Counter)
    for b in training:
        p = b"\n" * order + b
        for i in range(order, len(p)):
            for k in range(order + 1):
                counts[p[i - k : i]][p[i]] += 1

    def cost(b):
        p, total = b"\n" * order + b, 0.0
        for i in range(order, len(p)):
            gone = set()
            for k in range(order, -1, -1):
                if p[i - k : i] not in counts:
                    continue
                left = {s: n for s, n in counts[p[i - k : i]].items() if s not in gone}
                if p[i] in left:
                    total += math.log10(left[p[i]] / (sum(left.values()) + len(left)))
                    break
                if left:
                    total += math.log10(len(left) / (sum(left.values()) + len(left)))
                gone |= set(counts[p[i - k : i]])
            else:
                total -= math.log10(256 - len(gone))
        return total

    return cost


@tables
def test_language_model(spark):
    docs = rows("documents", "doc_id, text")
    lowered = {i: [w.lower() for w in words(t)] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    tally = Counter(w for i in lowered if not held[i] for w in [*lowered[i], None])
    n, v = sum(tally.values()), len(tally)
    cost = ppm_reference([b" ".join(lowered[i]) + b"\n" for i in lowered if not held[i]], 5)
    for r in language_model.query(spark, SF).collect():  # order 5
        w = [*lowered[r["doc_id"]], None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(tally[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((tally[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert r["score"] == pytest.approx(cost(b" ".join(lowered[r["doc_id"]]) + b"\n"), rel=1e-6)


@tables
@pytest.mark.parametrize(("order", "part_grams", "most_crowded"), [(1, 2000, 9), (5, 2000, 9), (5, 40, 10**6), (4, 100, 0)])
def test_broadcast_grams_do_not_matter(spark, monkeypatch, order, part_grams, most_crowded):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: r for r in language_model.score(docs, order=order).collect()}
    monkeypatch.setattr(language_model, "PART_GRAMS", part_grams)
    monkeypatch.setattr(language_model, "MOST_CROWDED", most_crowded)
    monkeypatch.setattr(language_model, "MOST_WORDS", 100)
    monkeypatch.setattr(language_model, "CHUNK", 1000)
    for r in language_model.score(docs, order=order, most_frequent=1000).collect():
        w = want[r["doc_id"]]
        assert (r["n_known"], r["n_tokens"]) == (w["n_known"], w["n_tokens"])
        assert r["score"] == pytest.approx(w["score"], rel=1e-9) and r["base_score"] == pytest.approx(w["base_score"], rel=1e-9)


@tables
def test_no_context_is_crowded(spark, monkeypatch):
    monkeypatch.setattr(language_model, "PART_GRAMS", 40)
    body = spark.read.parquet(f"{SF}/documents.parquet").select(F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    grams = language_model.gather_counts(body, 5).where(F.col("kind") == language_model.GRAM).select("key", "n")
    placed = language_model._placed(grams, language_model._crowded(grams, 2, 5), 2, 64).withColumn("context", F.shiftrightunsigned("key", 8).bitwiseAND(F.expr("shiftleft(1L, size * 8) - 1")))
    most = {r["size"]: r["m"] for r in placed.groupBy("size", "context").count().groupBy("size").agg(F.max("count").alias("m")).collect()}
    assert set(most) >= {2, 3, 4} and all(n <= 40 for size, n in most.items() if size < 5)


@tables
def test_quality_statistics(spark):
    texts = dict(rows("documents", "doc_id, text"))
    for r in quality.query(spark, SF).collect():
        t, w = texts[r["doc_id"]], [x.decode() for x in words(texts[r["doc_id"]])]
        at, inside = defaultdict(list), set()
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        for places in at.values():
            if len(places) > 1:
                inside.update(j for i in places for j in range(i, i + 8))
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and not (r["kept"] and r["base_failed"])


def test_rules_learn_a_conjunction(spark):
    rng = random.Random(2)
    data = [(i, rng.random(), rng.random(), rng.random()) for i in range(2000)]
    df = spark.createDataFrame([(i, a, b, c, a > 0.6 and b < 0.3) for i, a, b, c in data], "doc_id long, a double, b double, c double, bad boolean")
    rules = quality.learn_rules(df, ["a", "b", "c"], "bad", "doc_id")
    fired = df.select("bad", quality.verdict(rules).isNotNull().alias("hit"))
    assert fired.where("hit and not bad").count() <= 12 and fired.where("bad and not hit").count() <= 40


@pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer files here")
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeinorst  \nTé日\U0001f642.", max_size=60))
def test_token_counts(text):
    count, tokenizer = _tokenizers()
    assert count(text)[0] == (len(tokenizer.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0)


def _tokenizers(cache=[]):  # noqa: B006
    if not cache:
        import sentencepiece
        from tokenizers import Tokenizer, models

        sp = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
        vocabulary = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
        cache += [token_count.Counter(token_count.Vocabulary.from_sentencepiece(TOKENIZER)), Tokenizer(models.Unigram(vocabulary, sp.unk_id(), True))]
    return cache


@tables
def test_html_articles(spark):
    pages = dict(rows("pages", "page_id, html"))
    for r in html_extract.query(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    got = html_extract.shared_lines(a, b)
    assert len(got) == table[-1][-1]
    rest = iter(b)
    assert all(any(a[i] == y for y in rest) for i in sorted(got))


def test_block_boundaries_do_not_matter(spark, monkeypatch):
    rng = random.Random(4)
    passage = [f"q{i}" for i in range(30)]
    docs = [(i, " ".join([f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(30))] + passage[rng.randrange(8) : 22 + rng.randrange(8)] + [f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(30))])) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(map(str, substring_dedup.remove_repeats(df).collect()))
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2000)
    assert sorted(map(str, substring_dedup.remove_repeats(df).collect())) == one
    monkeypatch.setattr(substring_dedup, "GROUP_SUFFIXES", 2)  # many groups, prefixes of all lengths
    monkeypatch.setattr(substring_dedup, "PREFIX_SUFFIXES", 5)
    monkeypatch.setattr(substring_dedup, "HOT_TEXT_BYTES", 100)
    copies = spark.createDataFrame(docs + docs[:7] * 3 + [(900 + i, docs[3][1]) for i in range(40)], "doc_id long, text string")
    cut = sorted(map(str, substring_dedup.remove_repeats(copies).collect()))
    monkeypatch.setattr(substring_dedup, "FULL", -1.0)  # blocks ask for their anchors
    assert cut == sorted(map(str, substring_dedup.remove_repeats(copies).collect()))
    monkeypatch.undo()
    assert cut == sorted(map(str, substring_dedup.remove_repeats(copies).collect()))


def test_near_duplicate_clusters_of_many_blocks(spark, monkeypatch):
    rng = random.Random(6)
    base, docs = [f"b{i}" for i in range(120)], []
    for i in range(60):
        edited = list(base)
        for _ in range(rng.randrange(2, 7)):
            edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
        docs.append((i * 7 % 61 + 1, " ".join(edited)))
    monkeypatch.setattr(near_dedup, "BLOCK_ITEMS", 2000)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert got == near_reference(docs)
