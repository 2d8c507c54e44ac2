"""Pages without article markup, copies, and groups of any size."""

import pytest

from tidemark.llm import html

SCHEMA = "page_id long, url string, html string"
FRAME = "<div>Daily Planet, news for everyone since 1901</div>%s<div>Imprint and contact: Main Street 1</div>"


def texts(spark, pages, **k):
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, SCHEMA), **k).collect()}


def test_frames_larger_than_the_story(spark):
    pages = [(k, f"http://h.x/{k}", FRAME % f"<p>Short story {k}.</p>") for k in range(4)]
    assert texts(spark, pages) == {k: f"Short story {k}." for k in range(4)}


def test_copies_compare_with_the_next_page_that_differs(spark):
    copies = [(k, f"http://h.x/a?from={k}", FRAME % f"<p>One story here.</p><p>It goes on.</p><div>Visit {k}</div>") for k in range(5)]
    got = texts(spark, [*copies, (9, "http://h.x/b", FRAME % "<p>Another.</p>")])
    assert got == {**{k: f"One story here.\nIt goes on.\nVisit {k}" for k in range(5)}, 9: "Another."}
    assert all("One story here.\nIt goes on." in text for text in texts(spark, copies).values())


def test_one_teaser_article_is_not_the_page(spark):
    body = "<article><p>Read this, too</p></article><p>The body of the page is told at length here.</p><p>And here it ends.</p>"
    assert "The body of the page is told at length here.\nAnd here it ends." in texts(spark, [(1, "http://h.x/1", body)])[1]


@pytest.mark.parametrize("group_rows", [1, 3, 10, 2_000])
def test_groups_of_any_size_give_the_same(spark, group_rows):
    pages = [(k, f"http://h.x/{'a' if k < 60 else 'same'}/{k if k < 60 else 0}", f"<div>Frame</div><p>story {k} is told here</p><div>End of frame</div>") for k in range(120)]
    assert texts(spark, pages, group_rows=group_rows) == {k: f"story {k} is told here" for k in range(120)}
    runs = [(k, f"http://{'g' if k < 7 else 'h'}.x/{k:03}", FRAME % f"<p>story {k // 25}</p>") for k in range(120)]
    assert texts(spark, runs, group_rows=group_rows) == {k: html_text(k) for k in range(120)}


def html_text(k):
    alone = f"Daily Planet, news for everyone since 1901\nstory {k // 25}\nImprint and contact: Main Street 1"
    return alone if k < 7 else f"story {k // 25}"


def plain_lcs(a, b):
    """One longest common subsequence's length, and the places in ``a`` of each that can be in one."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("group_rows", [4, 2_000])
def test_whole_pages_against_plain_differencing(spark, sf_dir, group_rows):
    """Every page of a table against its neighbours in a sorted list, with tables of lengths; no article tags, so that differencing decides."""
    pages = [(r["page_id"], r["url"], r["html"].replace("article>", "div>")) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    frame = "<div>News of the day</div>%s<div>Imprint</div><div>All for everyone</div>"
    pages += [(1000 + k, f"http://one.example/{k % 7}/{k}", frame % "".join(f"<p>line {j} of {k}</p>" if (j + k) % 3 else f"<p>line {j}</p>" for j in range(5))) for k in range(40)]
    parsed = []
    for page_id, url, source in pages:
        lines = html.page_lines(source)
        keep = html.candidates([html.flag(x) for x in lines], [len(x[0]) for x in lines])
        kept = [x for x, there in zip(lines, keep) if there]
        prose = tuple(x[0] for x in kept if x[3]) or tuple(x[0] for x in kept)
        host, _, path = url.split("://")[1].removeprefix("www.").partition("/")
        parsed.append((host.lower(), "/" + path, page_id, lines, keep, prose))
    got = texts(spark, pages, group_rows=group_rows)
    deleted = 0
    for host, path, page_id, lines, keep, prose in parsed:
        rest = sorted((p for p in parsed if p[0] == host and p[5] != prose), key=lambda p: p[1])
        around = [p for p in rest if p[1] < path][-1:] + [p for p in rest if p[1] > path][:1]
        common = lambda p: next((k for k, (x, y) in enumerate(zip(p[1], path)) if x != y), min(len(p[1]), len(path)))
        other = max(around, key=common, default=None)  # the one before, of equals
        own = [x[0] for x, there in zip(lines, keep) if there]
        if other is None:
            assert got[page_id] == "\n".join(own)
            continue
        shared, left = plain_lcs([x[0] for x in lines], [x[0] for x in other[3]]), got[page_id].split("\n") if got[page_id] else []
        dropped = [x for x, there in zip(lines, keep) if not there]
        # What is left, what the markup drops and what is shared make up the page.
        assert len(lines) - shared <= len(left) + len(dropped) <= len(lines)
        others = {x[0] for x in other[3]}
        assert [x for x in own if x not in others] == [x for x in left if x not in others]
        deleted += len(own) - len(left)
    assert deleted > 100


def test_broken_markup_takes_linear_time():
    import time

    began = time.process_time()
    for piece in ('<a b="', "<a ", "<a b='>", '<a ">" ', "<p", "<b>x", "<!--", "<i><div><b></i>"):
        html.page_lines(piece * (200_000 // len(piece)))
        html.page_lines("<script>" + piece * (200_000 // len(piece)) + ">")
    assert time.process_time() - began < 20


def test_names_that_only_mention_a_frame_stay():
    shown = lambda page: [x[0] for x in html.page_lines(page) if x[1]]
    assert shown('<article class="post comments-open"><p>Hello</p></article>') == ["Hello"]
    assert shown('<article><div class="tags-and-notice"><p>Text about a form</p></div></article>') == ["Text about a form"]
    assert shown('<form id="aspnetForm"><div class="menu">m</div><article><p>Story</p></article></form>') == ["Story"]
    assert shown("<article><p><math>x+y</math> and <label>l</label></p><dialog open>d</dialog><dialog>e</dialog></article>") == ["x+y and l", "d"]
    assert shown('<article><p>a</p><div class="left-sidebar"><p>s</p></div><div id="commentsBox"><article><p>c</p></article></div><form><p>f</p></form></article>') == ["a"]
