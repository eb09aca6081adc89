"""Counts of the query against the tokenizer file's own library."""

from __future__ import annotations

import functools
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import token_count

TOKENIZER, SF = "/opt/tokenizers/piece_bpe_32k.model", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer files here")


@functools.cache
def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_query_counts_as_the_library(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    library = _library()
    got = token_count.query(spark, SF).collect()
    assert len(got) == len(texts)
    ids = {k: library.encode(t or "") for k, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: len(x) for k, x in ids.items()}
    assert all(r["score"] == pytest.approx(sum(0.0 if library.is_byte(i) else library.get_score(i) for i in ids[r["doc_id"]]), rel=1e-9) for r in got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeinorsth  \n\t▁Té日\U0001f642.<s>0x", max_size=60))
def test_merges_of_odd_texts(text):
    pieces = _library().encode(text)
    n, score = _merges()(text)
    assert n == len(pieces) and abs(score - sum(map(_library().get_score, pieces))) < 1e-3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(range(3, 32_000)), min_size=1, max_size=6))
def test_merges_of_joined_pieces(ids):
    text = "".join(_library().id_to_piece(i) for i in ids if not _library().is_byte(i)).replace("▁", " ")
    assert _merges()(text)[0] == len(_library().encode(text))


@functools.cache
def _merges():
    return token_count.MergeCounter(token_count.Vocabulary.from_sentencepiece(TOKENIZER))
