"""Alignment of two tokenizers against the libraries' own encoding of whole texts and plain loops."""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import token_alignment as T

A, B, SF = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(A).exists(), reason="no tokenizer files here")


@functools.cache
def _libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@functools.cache
def _tokenizers():
    return T.Tokenizers(T.Files.read(A, B))


def _piece(i):
    _, b = _libraries()
    piece = b.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """Groups and links of one text, by whole encodings."""
    a, b = _libraries()
    if not text:
        return [], []
    ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
    # the decoder of a byte-level file gives the bytes of an id only as text, so ids are joined by their vocabulary's characters
    table, names = T.byte_level_alphabet(), {i: t for t, i in a.get_vocab().items()}
    raw = [[bytes(table[c] for c in names[i]) for i in ids[0]], [_piece(i) for i in ids[1]]]
    if any(b"".join(x) != (" " + text).encode() for x in raw):
        return [], []
    ends = []
    for side in raw:
        at, out = 0, []
        for x in side:
            at += len(x)
            out.append(at)
        ends.append(out)
    both, places = sorted(set(ends[0]) & set(ends[1])), [{stop: i + 1 for i, stop in enumerate(e)} for e in ends]
    groups, links, low = [], [], [0, 0]
    for stop in both:
        high = [e[stop] for e in places]
        mine = [i[x:y] for i, x, y in zip(ids, low, high, strict=True)]
        groups.append(mine)
        links.append((mine[0][-1], mine[1][-1]))
        low = high
    return groups, links


def expected(texts):
    done = [plain(t) for t in texts]
    counts = Counter(p for _, links in done for p in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for groups, links in done:
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "plain words", "", None, "a literal ▁ mark", "the special <|endoftext|> and <s> </s> strings", "  two  spaces \n\n and lines \t tab\x0b \r\n", "nul \x00 byte", "日本語 \U0001f642 é é", "".join(chr(c) for c in (32, 0x2009, 116, 0x3000, 115, 0x85, 0x1C, 120, 0x2000, 0x200A, 32, 98, 0x180E, 99)),
    " ", "\n", "plain words", "don't we'll 12,345 %%% ", "x" * 3000, "a " * 2000,
]


def test_query_equals_whole_encodings(spark):
    if not Path(SF).exists():
        pytest.skip("no test tables here")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in T.query(spark, SF).collect()}
    assert got == {k: e for (k, _), e in zip(rows, expected([t for _, t in rows]), strict=True)}
    assert sum(x[2] for x in got.values()) > 50_000


@pytest.mark.parametrize("most", [2**19, 8, 1])
def test_odd_texts_and_columns(spark, monkeypatch, most):
    monkeypatch.setattr(T, "MOST_PAIRS", most)
    monkeypatch.setattr(T, "CHUNK", 500)
    monkeypatch.setattr(T, "MEMO_SEGMENTS", 5)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "plain words"), (0, "plain words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as body", "3 as `a.b`", "4 as pairs", "5 as id")
    got = sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in T.align(df, T.Files.read(A, B)).collect())
    assert got == sorted((str(k), *e) for (k, _), e in zip(rows, expected([t for _, t in rows]), strict=True))
    shown = T.align(df, T.Files.read(A, B)).where("doc_id = 12").first()["groups"]
    assert shown == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(ODD[12])[0])
    assert T.align(df.limit(0), T.Files.read(A, B)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abe' \n\t\r1<>|s" + "".join(map(chr, (0xA0, 0x3000, 0x2009, 0x85, 0x1C, 0x2581, 0xE9, 0x65E5, 0x1F642)))), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_segments_are_tokenized_as_the_whole_text(text):
    a, b = _libraries()
    ids = [[i for x in side for i in x] for side in _tokenizers().encode(T.SEGMENT.findall(" " + text))] if text else [[], []]
    assert ids == [a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text)]


def test_files_that_cannot_be_cut(tmp_path):
    with pytest.raises(ValueError):
        T.Files.read("/opt/tokenizers/word_bpe_49k.json", B)
