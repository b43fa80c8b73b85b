import pytest

from lanewright.llm import markup
from tests.conftest import rows

CASES = [
    ("Costs $5 or $ 7. Range 2*7m, or 2*21m. 2 ** 8. A<B & so on. Type /bind then \\reset. x_mk_two ~3~ [6] to [79] (see below).", set()),
    ("# Title *one* ##\n\n- a [b](c)\n  + d\n1) e", {("markup", "markdown"), ("heading", "Title one"), ("list_item", "a b"), ("list_item", "d"), ("list_item", "e")}),
    ("Under\r\n=====\r\n\r\n```py\r\na < b\r\n  # no heading\r\n```", {("markup", "markdown"), ("heading", "Under"), ("code", "a < b # no heading")}),
    ("~~~\n- no item\n", {("markup", "markdown"), ("code", "- no item")}),
    ("* one\n* two", {("markup", "markdown"), ("list_item", "one"), ("list_item", "two")}),
    ("== T ==\n*one [[x|y]]\n# '''two'''", {("markup", "wiki"), ("heading", "T"), ("list_item", "one y"), ("list_item", "two")}),
    ("<H2 class='t'>\n A <b>b</b>&nbsp;c\n</H2><ul><li>x<li>y &lt; <a title='a > b'>z</a></ul><!-- <h1>no</h1> --><script>var a='<li>x</li>'</script>", {("markup", "html"), ("heading", "A b c"), ("list_item", "x"), ("list_item", "y < z")}),
    ("<pre><code class=\"x\">a &lt; b</code></pre>", {("markup", "html"), ("code", "a < b")}),
    ("\\section*{A \\emph{b}}\\label{x}\nText. % note\n\\begin{itemize}\n\\item {\\it p} q\n  \\item r\n\\end{itemize}\n\\begin{verbatim}\n\\item s\n\\end{verbatim}", {("markup", "latex"), ("heading", "A b"), ("list_item", "p q"), ("list_item", "r"), ("code", "\\item s")}),
    ("Here $a_b$ and \\[ c \n d \\] and $$e$$.", {("markup", "latex"), ("formula", "a_b"), ("formula", "c d"), ("formula", "e")}),
    ("<p>\\(x &lt; y\\)</p>", {("markup", "html"), ("markup", "latex"), ("formula", "x < y")}),
    (None, set()),
    ("", set()),
    (" \n ", set()),
]


@pytest.mark.parametrize("prose,want", CASES)
def test_elements(prose, want):
    got = markup.elements(prose)
    assert set(got) == want and len(got) == len(set(got))


def test_the_tree_learns_its_table_and_other_proses():
    x, y = markup.labelled_rows()
    assert (markup.block_tree().predict(x) == y).all()
    half = markup.DecisionTree().fit(x[::2], y[::2])
    assert (half.predict(x[1::2]) == y[1::2]).mean() > 0.95


def test_sections(spark):
    df = spark.createDataFrame([(1, "# a\n\n# a", "x"), (2, None, "x"), (3, "plain " * 50_000, "x")], "section_id long, prose string, element string")
    assert rows(markup.section_elements(df)) == [(1, "heading", "a"), (1, "markup", "markdown")]
    assert markup.section_elements(df.limit(0)).count() == 0
    assert {r["section_id"]: r["clean"] for r in markup.clean_sections(df).collect()}[1] == "# a\n# a"


@pytest.mark.parametrize(
    "open_,close,sign",
    [("\\emph{", "}", "\\section{T}\n"), ("\\textbf{", "}", "\\section{T}\n"), ("<b>", "</b>", "<p>x</p>")],
)
def test_marks_of_any_depth_go(open_, close, sign):
    for depth in (1, 5, 40):
        item = "\\begin{itemize}\n\\item %s\n\\end{itemize}" if "section" in sign else "<ul><li>%s</li></ul>"
        got = markup.elements(sign + item % (open_ * depth + "word" + close * depth))
        assert ("list_item", "word") in got


def test_alternating_emphasis_of_any_depth_goes():
    marks = ["*", "_", "**", "__"] * 3
    text = "word"
    for m in marks:
        text = f"{m}{text} w{m}"
    got = [c for e, c in markup.elements("# " + text) if e == "heading"]
    assert got and not set(got[0]) & set("*_")


def test_prose_without_marks_needs_no_page():
    for prose in ("Plain words, no marks. (See below) 50 percent!", "two\nlines - of text", "it's"):
        assert not markup.MARKED.search(prose) and markup.elements(prose) == []
        page = markup.Page(prose)
        assert not any(page.signs.values()) and [b[0] for b in page.blocks] == ["none"] * len(page.blocks)
