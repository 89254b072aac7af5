"""Blocks of links that are article text stay, whatever the number of a host's pages; menus go."""

import pytest

from facetmill.llm import html_extract


def page(i, host):
    words = " ".join(f"word{i}x{j}" for j in range(60))
    return (
        f"<html><body><div class='top'><ul><li><a href='/'>Home</a></li><li><a href='/x'>More of {host}</a></li></ul></div>"
        f"<div class='text'><h1>Title {i} of {host}</h1><p>{words}</p><p><a href='/c{i}'>A cited work, number {i} of several on {host}</a></p>"
        f"<blockquote><a href='/q{i}'>Quoted {i} and linked</a></blockquote><p>End {words[:50]}</p></div></body></html>"
    )


@pytest.mark.parametrize("n", [2, 4, 7])
def test_link_paragraphs_stay(spark, n):
    pages = [(i, f"https://h{n}.example/{i}", page(i, f"h{n}")) for i in range(n)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(n):
        lines = got[i].split("\n")
        assert f"A cited work, number {i} of several on h{n}" in lines and f"Quoted {i} and linked" in lines and lines[0] == f"Title {i} of h{n}"
        assert not any("Home" in x or "More of" in x for x in lines)
