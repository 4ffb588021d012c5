from __future__ import annotations

from corvane.functions import htmldom as H


def test_text_in_deeply_nested_elements_is_kept():
    html = "<h2 id='a'>Title</h2><div>" + "<span>" * 5000 + "deep <b>words</b> <table><tr><td>x</td><th>y z</th></tr></table>" + "</div>after"
    got = H.markdown(H.parse(html).children)
    assert got.split() == ["##", "Title", "deep", "**words**", "|", "x", "|", "y", "z", "|", "after"]
    ((_, _, _, content),) = H.sections(H.parse(html))
    assert "deep **words**" in H.markdown(content)


def test_long_lists_and_many_headings():
    n = 20_000
    html = "<ol>" + "".join(f"<li>x{k}" for k in range(n)) + "</ol>" + "".join(f"<h2 id='h{k}'>T</h2><p>b{k}" for k in range(n))
    assert H.markdown(H.parse(html).children[:1]).split() == [w for k in range(n) for w in (f"{k + 1}.", f"x{k}")]
    found = H.sections(H.parse(html))
    assert [(s[0], H.markdown(s[3]).strip()) for s in found] == [(f"h{k}", f"b{k}") for k in range(n)]
