"""Template inside declared parts, and large templates around short articles."""

from __future__ import annotations

import os
import random

from strandline.llm import html_extract


def _texts(spark, bodies):
    pages = [(i, f"http://h/news/{i}", body) for i, body in enumerate(bodies)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}


def test_template_inside_an_article(spark):
    own = [f"Own report {i} of this page about thing {i * 7}, long enough to be the larger part." for i in range(6)]
    got = _texts(spark, [f"<article><p>Share this story</p><p>{x}</p><p>All views are the author's</p></article>" for x in own])
    assert got == dict(enumerate(own))


def test_shared_headings_stay(spark):
    part = lambda i: f"<article><h1>News</h1><p>Opening {i} of a report</p><h2>Background</h2><p>Middle {i} of it</p><p>Repeated remark</p><p>More {i}</p><h2>Conclusion</h2><p>End {i} of it</p><h3>Notes</h3></article>"
    got = _texts(spark, [f"<div>Site</div>{part(i)}<div>Legal</div>" for i in range(5)])
    assert got == {i: f"News\n\nOpening {i} of a report\n\nBackground\n\nMiddle {i} of it\n\nRepeated remark\n\nMore {i}\n\nConclusion\n\nEnd {i} of it\n\nNotes" for i in range(5)}


def test_template_that_the_page_also_says_outside(spark):
    got = _texts(spark, [f"<div>Join us today</div><article><p>Opening {i} of a report</p><p>Join us today</p><p>The end {i} of a report</p></article>" for i in range(5)])
    assert got == {i: f"Opening {i} of a report\n\nThe end {i} of a report" for i in range(5)}


def _common(a, b):
    """Positions in a of the longest common subsequence, by the table of all pairs."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _plain(pages):
    """Pages of one host, (key, path, lines before, article lines or None, lines after): neighbours and deletion by hand."""
    order = sorted(pages, key=lambda p: (p[1], p[0]))
    whole = [[*p[2], *(p[3] or []), *p[4]] for p in order]
    out = {}
    for i, (key, path, before, article, after) in enumerate(order):
        near = []
        for j in sorted((j for d in range(1, 5) for j in (i - d, i + d) if 0 <= j < len(order)), key=lambda j: -len(os.path.commonprefix([order[j][1], path]))):
            if len(near) < 4 and whole[j] != whole[i] and whole[j] not in near:
                near.append(whole[j])
        shares = [_common(whole[i], n) for n in near]
        part = list(range(len(before), len(before) + len(article))) if article is not None else list(range(len(whole[i])))
        long = lambda of, mine: 5 * sum(len(whole[i][x]) for x in mine if x in of) > 4 * sum(len(whole[i][x]) for x in mine)
        if article is not None:
            others = [s for s in shares if not long(s, part)]
            shared = set.intersection(*others) if len(others) >= 3 else set()
            gone = {x for x in shared if x in part and (whole[i][x] in before + after or all(y in shared for y in part if y <= x) or all(y in shared for y in part if y >= x))}
        else:
            gone = {x for x in part if len(shares) >= 3 and 2 * sum(x in s for s in shares) > len(shares)}
            gone = set() if gone >= set(part) else gone
            if shares and not long(shares[0], [x for x in part if x not in gone]):
                gone |= shares[0]
        gone = set() if gone >= set(part) else gone
        out[key] = "\n\n".join(whole[i][x] for x in part if x not in gone)
    return out


def test_neighbours_and_deletion_by_hand(spark):
    rng = random.Random(12)
    for declared in (True, False):
        pages = []
        for key in range(60):
            own = [f"Own line {key} {j} " + "word " * rng.randrange(1, 9) for j in range(rng.randrange(1, 5))]
            own = [x.strip() for x in own]
            body = [*(["Shared start"] if rng.random() < 0.8 else []), *own[:1], *(["Shared middle"] if rng.random() < 0.9 else []), *own[1:], *(["Shared end"] if rng.random() < 0.8 else [])]
            before = [x for x in ("Menu one", "Menu two", "Shared middle") if rng.random() < (0.2 if x.startswith("Shared") else 0.7) and (declared or not x.startswith("Shared"))]
            after = [x for x in ("Foot one", "Foot two") if rng.random() < 0.7]
            pages.append((key, f"/{rng.choice('ab')}/{rng.choice('cd')}/{rng.randrange(30)}", before, body if declared else None, after if declared else [*body, *after]))
        tags = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
        rows = [(k, f"http://h{path}", tags(b) + (f"<article>{tags(a)}</article>" if a is not None else "") + tags(z)) for k, path, b, a, z in pages]
        got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == _plain(pages)


def test_copies_of_an_article_stay(spark):
    copy = "<article><p>One article told word for word on many pages.</p><p>Its second part.</p></article>"
    other = [f"<article><p>Another text {i} that is not the same at all.</p></article>" for i in range(2)]
    got = _texts(spark, [copy, copy + "<div>page 2</div>", other[0], copy, copy + "<div>page 5</div>", copy, other[1]])
    whole = "One article told word for word on many pages.\n\nIts second part."
    assert [got[i] for i in (0, 1, 3, 4, 5)] == [whole] * 5 and got[2].startswith("Another text 0")


def test_short_article_in_a_large_template(spark):
    menu = "".join(f"<div>Template line {i} of the whole site</div>" for i in range(20))
    assert _texts(spark, [f"{menu}<div>Short {i}</div>" for i in range(6)]) == {i: f"Short {i}" for i in range(6)}


def _site(n):
    """Pages of two hosts without declared parts, each with its own text between lines of the site."""
    line = lambda i: f"<div>Site line {i % 3}</div>"
    return [(i, f"http://h{i % 2}/a/{i * 7 % 50}/{i}", f"<div>Menu</div>{line(i)}<p>Own text {i} of the page</p>{line(i + 1)}<div>All rights</div>") for i in range(n)]


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "CELL_PAGES", 15)
    df = spark.createDataFrame(_site(120), "page_id long, url string, html string")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = set()
        for parts in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.add(str(sorted(html_extract.extract_main_text(df.repartition(parts)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert len(got) == 1


def test_differencing_decides(spark, monkeypatch):
    df = spark.createDataFrame(_site(40), "page_id long, url string, html string")
    got = [r["text"] for r in html_extract.extract_main_text(df).orderBy("page_id").collect()]
    assert not any("Menu" in t or "All rights" in t for t in got) and all(f"Own text {i} " in t for i, t in enumerate(got))
    monkeypatch.setattr(html_extract, "REACH", 0)  # no neighbours, so nothing is template
    alone = [r["text"] for r in html_extract.extract_main_text(df).orderBy("page_id").collect()]
    assert all("Menu" in t and "All rights" in t for t in alone)
