"""Tree and selector rules of the page helper."""

import pytest

from harvest.functions.markup import PageTree, compile_selector, match_selector


def tags(html):
    return [(e.tag, e.parent, e.last) for e in PageTree(html).elements]


def pick(html, selector):
    tree = PageTree(html)
    return [tree.elements[i].attrs.get("id", tree.elements[i].tag)
            for i in match_selector(tree.elements, compile_selector(selector))]


def text(html, selector):
    tree = PageTree(html)
    found = match_selector(tree.elements, compile_selector(selector))
    return tree.text(found[0]) if found else None


def test_unclosed_tags_nest_and_stray_ends_are_ignored():
    assert tags("<p>a<p>b") == [("p", -1, 1), ("p", 0, 1)]
    assert tags("<div></p><b>x</b></div><i>") == [("div", -1, 1), ("b", 0, 1), ("i", -1, 2)]


def test_void_elements_hold_nothing():
    assert tags("<p>a<br>b<br/>c</p>") == [("p", -1, 2), ("br", 0, 1), ("br", 0, 2)]


def test_script_style_and_comments_are_no_text():
    html = '<body><script>var a="</p>";</script><style>p{}</style><!-- c -->x <b> y</b></body>'
    assert text(html, "body") == "xy"
    assert text(html, "script") == 'var a="</p>";'


def test_strings_are_stripped_one_by_one():
    assert text("<div>  a b \n<i> c </i> d</div>", "div") == "a bcd"


def test_entities():
    assert text("<p>&lt;a&gt; &amp;&nbsp;&#65;&#x42;&#150; &unknown x</p>", "p") == "<a> &\xa0AB– &unknown x"


@pytest.mark.parametrize("html", [
    '<div class="a b" id="x"><p>t &amp; u</p></div>',
    "<div><br/><b>x</b></div>",
    '<div title="a&amp;b">\n</div>',
    "<div><!--note-->x</div>",
])
def test_serialized_length_of_normal_form(html):
    assert PageTree(html).elements[0].html_len == len(html)


def test_serialized_length_of_repairs():
    assert PageTree("<div a=1 b><br>x < y").elements[0].html_len == len('<div a="1" b=""><br/>x &lt; y</div>')
    assert PageTree("<div>  \n  <i></i></div>").elements[0].html_len == len("<div>\n<i></i></div>")
    assert PageTree("<pre>  \n  </pre>").elements[0].html_len == len("<pre>  \n  </pre>")


PAGE = """<div id=d1 class="list x"><ul id=u1><li id=l1><a id=a1 href=1 rel="nofollow me">1</a></li></ul>
<a id=a2 class=list href=2>2</a></div><ul id=u2><a id=a3 data-k="v-1">3</a></ul>"""


@pytest.mark.parametrize("selector, want", [
    ("a", ["a1", "a2", "a3"]), ("A[HREF]", ["a1", "a2"]), (".list a", ["a1", "a2"]), (".list > a", ["a2"]),
    ("ul > li>a", ["a1"]), ("ul a, .list > a", ["a1", "a2", "a3"]), ("#u2 *", ["a3"]), ("div.x.list", ["d1"]),
    ('[data-k="v-1"]', ["a3"]), ("[data-k^=v]", ["a3"]), ('[data-k$="1"]', ["a3"]), ("[data-k|=v]", ["a3"]),
    ("[rel~=me]", ["a1"]), ("a[rel!=x]", ["a1", "a2", "a3"]), ('ul[id!="u1"]', ["u2"]), ("[rel*=follow]", ["a1"]), ("div ul ul", []), ("[document] a", []),
])
def test_selectors(selector, want):
    assert pick(PAGE, selector) == want


@pytest.mark.parametrize("selector", ["", "a:first-child", "a + b", ".2x", "md:flex", ">a", "a >", "a,,b", "[a=", "a\\:b", "#1a"])
def test_unsupported_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        compile_selector(selector)


def test_deep_nesting_is_no_recursion():
    tree = PageTree("<p>" * 20_000 + "x")
    assert tree.elements[0].last == 19_999 and tree.text(0) == "x"
