"""Clean text out of HTML, Markdown, wiki and LaTeX markup.

A text is cut into flat blocks; of each block there are its words, its link
density, those of the blocks before and after it, the mark that opened it and
the text's signs of each language.  A decision tree, grown on the small
labelled table ``LABELLED``, tells what a block is: heading, list item, code,
formula, running text, or hidden.  Languages are read off the same signs.

Defined results: null and blank prose gives no rows; prose without markup is
one text block; an unclosed code block, comment or environment runs to the end
of the prose; both kinds of line ends count; unknown tags and commands without
arguments are text; a repeated element of a section is one row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.tree import DecisionTree

KINDS = ("text", "heading", "list_item", "code", "formula", "hidden")
LANGUAGES = ("html", "markdown", "wiki", "latex")
#: What can open a block.
OPENERS = ("none", "html_h", "html_li", "code", "formula", "hidden", "hash", "underlined", "equals", "star", "bullet", "number", "section", "item", "quote")

TAGS = "a abbr article aside b blockquote body big br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript ol option p picture q s samp section select small source span strike strong sub summary sup svg table tbody td template textarea tfoot th thead title tr tt u ul var video wbr".split()
TAG = re.compile(r"<(/?)(" + "|".join(TAGS) + r")\b((?:(?:\s|&nbsp;)+(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?)\s*/?>", re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,31});", re.I)
CODE = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))"
    r"|<(?P<hid>script|style)\b[^>]*>.*?(?:</(?P=hid)\s*>|\Z)"
    r"|<(?P<el>pre|syntaxhighlight|source)\b[^>]*>(?P<pre>.*?)(?:</(?P=el)\s*>|\Z)"
    r"|(?:^|(?<=\n))[ \t]*(?P<fence>`{3,}|~{3,})[^\n`]*(?:\n(?P<fenced>.*?))??(?:(?:^|(?<=\n))[ \t]*(?P=fence)[`~]*[ \t]*(?=\n|\Z)|\Z)"
    r"|\\begin\{(?P<env>verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?P<verb>.*?)(?:\\end\{(?P=env)\}|\Z)",
    re.S | re.I,
)
FORMULA = re.compile(
    r"\\begin\{(?P<env>equation|align|gather|multline|displaymath|math|eqnarray)(?P<s>\*?)\}(?P<a>.*?)\\end\{(?P=env)(?P=s)\}"
    r"|(?<!\\)\\\[(?P<b>.*?)\\\]|(?<!\\)\\\((?P<c>.*?)\\\)|(?<!\\)\$\$(?P<d>.+?)(?<!\\)\$\$"
    r"|(?<![\\$\w])\$(?P<e>[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\d$])",
    re.S,
)
SECTION = re.compile(r"\\(?:chapter|part|(?:sub)*section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?(?=\{)")
TEXCOMMAND = re.compile(r"\\(?:emph|text[a-z]{2}|underline|textbf|href|url|label|ref|cite|footnote|item|begin|end|(?:sub)*section|(?:sub)?paragraph|chapter)\b\*?")
SWITCH = re.compile(r"\{\\(?:it|bf|tt|em|sl|sc|rm|sf|itshape|bfseries|ttfamily|small|large)\b\s*")
WRAP = re.compile(r"\\(?:emph|text[a-z]{2}|textnormal|underline|mbox)\s*\{([^{}]*)\}")
DROPPED = re.compile(r"\\(?:label|ref|cite|pageref|vspace|hspace|index)\*?\{[^{}]*\}")
HREF = re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}")
TEXNOTE = re.compile(r"(?<!\\)%[^\n]*")
WIKILINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
QUOTES = re.compile(r"(?<!')('{2,5})(?=[^'\s])(.+?)(?<=[^\s])\1(?!')")
EQUALS = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
IMAGE = re.compile(r"!\[([^\]\[]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
LINK = re.compile(r"(?<!!)\[([^\]\[]+)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
OUTLINK = re.compile(r"\[https?://\S+\s+([^\]]+)\]")
SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
STRONG = re.compile(r"(?<![^\W_])(?<!\*)(\*{1,3})(?=[^\s*])((?:[^*\n]|\n(?!\s*\n))+?)(?<=[^\s*])\1(?![^\W_]|\*)")
UNDER = re.compile(r"(?<![\w_])(_{1,3})(?=[^\s_])((?:[^_\n]|(?<=\w)_(?=\w)|\n(?!\s*\n))+?)(?<=[^\s_])\1(?![\w_])")
STRIKE = re.compile(r"(?<![\w~])~~(?=[^\s~])([^~]+?)(?<=[^\s~])~~(?![\w~])")
ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
HASH = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
WIKIHASH = re.compile(r"^(#+)(?=[^\s#])(.*)$")
RULE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
BREAK = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
STAR = re.compile(r"^[ \t]*(\*{1,6})(?:[ \t]+)(.*)$")
WIKISTAR = re.compile(r"^([*:;]+)[ \t]*(.*)$")
BULLET = re.compile(r"^[ \t]*[+-][ \t]+(.*)$")
NUMBER = re.compile(r"^[ \t]*\d{1,3}[.)][ \t]+(.*)$")
QUOTE = re.compile(r"^ {0,3}>[ \t]?(.*)$")
HOLD = re.compile("\x02(\\d+)\x03")
#: What any mark of any language has; a prose without it is running text.
MARKED = re.compile(r"[<&#=*_\\$`\[\]{}~>|]|''|^[ \t]*(?:[-+]|\d{1,3}[.)])", re.M)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def _unescape(text: str) -> str:
    return ENTITY.sub(lambda m: html.unescape(m.group()), text) if "&" in text else text


def _until_same(pattern: re.Pattern, to, text: str) -> str:
    """Substitutes until nothing changes, however deep marks lie in each other (each step makes the text shorter)."""
    while True:
        inner = pattern.sub(to, text)
        if inner == text:
            return text
        text = inner


class Page:
    """One prose: its signs, and its flat blocks as [opener, text, links]."""

    def __init__(self, prose: str) -> None:
        text = prose.replace("\r\n", "\n").replace("\r", "\n").replace("\x02", " ").replace("\x03", " ")
        self.signs = dict.fromkeys(LANGUAGES, 0)
        self.held: list[tuple[str, str]] = []
        self.blocks: list[list] = []
        text = CODE.sub(self._code, text)
        self.signs["html"] += len(TAG.findall(text)) + len(ENTITY.findall(text))
        tex = len(TEXCOMMAND.findall(text)) + len(SWITCH.findall(text))
        if tex:
            text = TEXNOTE.sub("", text)
        text = FORMULA.sub(self._formula, text)
        self.signs["latex"] += tex
        self.tex = tex > 0
        self.signs["wiki"] += len(WIKILINK.findall(text)) + len(TEMPLATE.findall(text)) + sum(1 for line in text.split("\n") if EQUALS.match(line)) + (0 if tex else len(QUOTES.findall(text)))
        self.wiki = self.signs["wiki"] > 0
        self._cut(text)

    def _hold(self, opener: str, text: str) -> str:
        self.held.append((opener, text))
        return f"\x02{len(self.held) - 1}\x03"

    def _code(self, m: re.Match) -> str:
        if m["comment"] is not None or m["hid"]:
            self.signs["html"] += 1
            return "\n" + self._hold("hidden", m.group()) + "\n" if m["hid"] else ""
        if m["el"]:
            self.signs["html"] += 1
            code = _unescape(re.sub(r"</?(?:code|span|b|i|em|strong|font)\b[^<>]*>", "", m["pre"], flags=re.I))
        elif m["fence"]:
            self.signs["markdown"] += 1
            code = m["fenced"] or ""
        else:
            self.signs["latex"] += 1
            code = m["verb"]
        return "\n" + self._hold("code", code) + "\n"

    def _formula(self, m: re.Match) -> str:
        source = next(g for g in (m["a"], m["b"], m["c"], m["d"], m["e"]) if g is not None)
        if not source.strip():
            return m.group()
        self.signs["latex"] += 1
        return self._hold("formula", re.sub(r"\\label\{[^{}]*\}", "", _unescape(source)))

    def _cut(self, text: str) -> None:
        """HTML elements first; what lies outside of headings and items goes by lines."""
        at, now, piece = 0, "none", []
        for m in TAG.finditer(text):
            piece.append(text[at : m.start()])
            at = m.end()
            tag, closing = m[2].lower(), bool(m[1])
            if tag == "a":
                piece.append("\x05" if closing else "\x04")
            elif tag in ("td", "th"):
                piece.append(" ")
            elif tag == "br" and now != "none":
                piece.append(" ")
            elif tag in ("p", "div") and now == "html_li" and not closing:
                piece.append(" ")
            elif tag in ("p", "div", "br", "ul", "ol", "li", "table", "tr", "blockquote", "hr", "section", "article", "dl", "dt", "dd", "header", "footer", "nav", "main", "aside", "form", "body", "title", "head") or re.fullmatch("h[1-6]", tag):
                if closing and tag in ("p", "div") and now == "html_li":
                    piece.append(" ")
                    continue
                self._flush(now, piece)
                now, piece = "none", []
                if not closing and tag[0] == "h" and tag[1:].isdigit():
                    now = "html_h"
                elif not closing and tag == "li":
                    now = "html_li"
        piece.append(text[at:])
        self._flush(now, piece)

    def _flush(self, kind: str, piece: list[str]) -> None:
        text = "".join(piece)
        if kind == "none":
            self._lines(text)
        elif text.strip():
            self._add(kind, text)

    def _add(self, opener: str, text: str) -> None:
        """A block; code inside it is a block of its own, formulas are so too but stay readable in place."""
        after = []
        for n in HOLD.findall(text):
            kind, _ = self.held[int(n)]
            if kind != "formula":
                text = text.replace(f"\x02{n}\x03", " ")
            after.append(int(n))
        shown, links = self._inline(text)
        if shown:
            self.blocks.append([opener, shown, links])
        for n in after:
            self.blocks.append([self.held[n][0], squeezed(self.held[n][1]), 0])

    def _lines(self, text: str) -> None:
        kept: list[str] = []
        item: list[str] | None = None
        opener = "none"

        def close() -> None:
            nonlocal kept, opener
            if kept and "".join(kept).strip():
                self._add(opener, "\n".join(kept))
            kept, opener = [], "none"

        def begin(what: str, rest: str) -> None:
            nonlocal kept, opener
            close()
            opener, kept = what, [rest]

        lines = text.split("\n")
        for i, line in enumerate(lines):
            bare = line.strip()
            if not bare:
                close()
                continue
            if self.tex and (m := SECTION.search(line)):
                before, (title, rest) = line[: m.start()], _braced(line, m.end())
                if before.strip():
                    kept.append(before)
                begin("section", title)
                close()
                if rest.strip():
                    kept = [rest]
                continue
            if self.tex and re.match(r"\s*\\(?:begin|end)\{[^{}]*\}", line):
                rest = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "", line)
                close()
                if not rest.strip():
                    continue
                line, bare = rest, rest.strip()
            if self.tex and (parts := re.split(r"\\item\b(?:\[[^\]]*\])?", line))[1:]:
                if parts[0].strip():
                    kept.append(parts[0])
                for p in parts[1:]:
                    begin("item", p)
                continue
            if HOLD.fullmatch(bare) and self.held[int(bare[1:-1])][0] != "formula":
                close()
                self._add("none", bare)
                continue
            if m := EQUALS.match(line):
                begin("equals", m[2])
                close()
                continue
            if (m := RULE.match(line)) and len(kept) >= 1 and opener == "none" and len(m[1]) >= 2:
                self.signs["markdown"] += 1
                opener = "underlined"
                close()
                continue
            if BREAK.match(line):
                close()
                continue
            if (m := HASH.match(line)) or (self.wiki and (m := WIKIHASH.match(line))):
                if not self.wiki:
                    self.signs["markdown"] += 1
                begin("hash", m[2])
                close()
                continue
            if (m := STAR.match(line)) or (self.wiki and (m := WIKISTAR.match(line)) and not STRONG.match(line)):
                if not self.wiki:
                    self.signs["markdown"] += 1
                begin("star", m[2])
                if self.wiki:
                    close()
                continue
            if m := BULLET.match(line):
                self.signs["markdown"] += 1
                begin("bullet", m[1])
                continue
            if m := NUMBER.match(line):
                self.signs["markdown"] += 1
                begin("number", m[1])
                continue
            if m := QUOTE.match(line):
                self.signs["markdown"] += 1
                if opener != "quote":
                    begin("quote", m[1])
                else:
                    kept.append(m[1])
                continue
            if opener not in ("none", "item") and not line[:1].isspace():
                close()
            kept.append(line)
        close()

    def _inline(self, text: str) -> tuple[str, int]:
        """What a reader sees of a block, and how many of its words are links."""
        links = 0

        def linked(m: re.Match) -> str:
            nonlocal links
            links += len(m[1].split())
            return m[1]

        spans: list[str] = []

        def kept(s: str) -> str:
            spans.append(s)
            return f"\x06{len(spans) - 1}\x07"

        def span(m: re.Match) -> str:
            self.signs["markdown"] += 1
            return kept(m[2].strip() or m[2])

        def md(m: re.Match) -> str:
            self.signs["markdown"] += 1
            return m[2]

        if "\x04" in text:
            text = re.sub("\x04([^\x04\x05]*)\x05", linked, text).replace("\x04", "").replace("\x05", "")
        text = HOLD.sub(lambda m: kept(self.held[int(m[1])][1]), text)
        if self.tex:
            text = HREF.sub(linked, DROPPED.sub("", text))
            text = _until_same(WRAP, r"\1", text)
            text = re.sub(SWITCH.pattern + r"([^{}]*)\}", r"\1", text)
            text = re.sub(r"\\([%&_#${}])", r"\1", text).replace("``", "\u201c").replace("\\\\", " ")
        else:
            text = SPAN.sub(span, text)
        if self.wiki:
            text = WIKILINK.sub(linked, TEMPLATE.sub(" ", text))
            text = _until_same(QUOTES, r"\2", text)
            text = OUTLINK.sub(linked, text)
        if not self.tex:
            text, n = IMAGE.subn(r"\1", text)
            text, k = LINK.subn(linked, text)
            self.signs["markdown"] += n + k
            while (inner := UNDER.sub(md, STRONG.sub(md, text))) != text:  # the innermost marks of both kinds first
                text = inner
            text, n = STRIKE.subn(r"\1", text)
            self.signs["markdown"] += n
            if self.signs["markdown"]:
                text = ESCAPE.sub(r"\1", text)
        text = _unescape(text)
        text = re.sub("\x06(\\d+)\x07", lambda m: spans[int(m[1])], text)
        return squeezed(text), links

    def features(self) -> np.ndarray:
        """One row per block: opener (one column each), words, link density, those
        of the neighbours, full stop at the end, the text's signs of each language."""
        n = len(self.blocks)
        words = np.array([len(b[1].split()) for b in self.blocks], float)
        density = np.array([b[2] for b in self.blocks], float) / np.maximum(words, 1)
        x = np.zeros((n, len(OPENERS) + 7 + len(LANGUAGES)))
        x[np.arange(n), [OPENERS.index(b[0]) for b in self.blocks]] = 1
        k = len(OPENERS)
        x[:, k], x[:, k + 1] = words, density
        x[1:, k + 2], x[1:, k + 3] = words[:-1], density[:-1]
        x[:-1, k + 4], x[:-1, k + 5] = words[1:], density[1:]
        x[:, k + 6] = [b[1][-1:] in ".!?" and b[1] != "" for b in self.blocks]
        x[:, k + 7 :] = [self.signs[s] for s in LANGUAGES]
        return x


def _braced(line: str, at: int) -> tuple[str, str]:
    """The group that opens at ``at`` and what follows it."""
    depth = 0
    for i in range(at, len(line)):
        depth += (line[i] == "{") - (line[i] == "}")
        if depth == 0:
            return line[at + 1 : i], line[i + 1 :]
    return line[at + 1 :], ""


#: The labelled table: a prose and the kinds of its blocks, in order.
LABELLED: list[tuple[str, str]] = [
    ("Plain words with no marks at all.", "text"),
    ("First one.\n\nSecond one, a bit longer than that.", "text text"),
    ("Costs $5 or $ 7 and 2 * 3 is 6 ** of it.", "text"),
    ("<h2>Overview</h2><p>Some words follow here.</p>", "heading text"),
    ("<h1>A rather long heading that has many words in it</h1>\n<div>Short.</div>", "heading text"),
    ("<p>Look.</p><ul><li>one</li><li>two with <a href='x'>a link</a></li></ul>", "text list_item list_item"),
    ("<ol><li>first point is quite long and ends with a stop.\n<li>second\n</ol><h3>End</h3>", "list_item list_item heading"),
    ("<p>See <a href='a'>this link here</a></p><pre>x = 1</pre>", "text code"),
    ("<style>p{}</style><p>Shown.</p><script>var a</script>", "hidden text hidden"),
    ("<p>\\(a+b\\)</p>", "text formula"),
    ("Where \\[ x = y \\] holds.", "text formula"),
    ("# Title\n\nWords of a paragraph.", "heading text"),
    ("## Title with some more words ##\n\n- one\n- two", "heading list_item list_item"),
    ("Title\n=====\n\nWords.", "heading text"),
    ("Another title\n---\n\n1. one\n2. two\n\n> quoted words", "heading list_item list_item text"),
    ("* one\n* two\n* three", "list_item list_item list_item"),
    ("+ one\n+ two and [a link](x)", "list_item list_item"),
    ("```\ncode = 1\n```\n\nWords with `code` in them.", "code text"),
    ("~~~py\na\nb\n~~~", "code"),
    ("1) one\n2) two", "list_item list_item"),
    ("#### Deep title\n\n$$\nx\n$$", "heading text formula"),
    ("== Title ==\nWords with [[a link]].", "heading text"),
    ("== Title ==\n# first\n# second, with '''bold''' words", "heading list_item list_item"),
    ("=== Title ===\n*one\n**two", "heading list_item list_item"),
    ("{{stub}}\n*one [[x|y]]\n#two", "list_item list_item"),
    ("{{box|a=1}}\nWords ''here''.\n== Title ==\n# one", "text heading list_item"),
    ("\\section{Title}\nWords \\emph{here}.", "heading text"),
    ("\\paragraph{Title words}\n\\begin{itemize}\n\\item one\n\\item two, which is longer.\n\\end{itemize}", "heading list_item list_item"),
    ("\\begin{verbatim}\nx\n\\end{verbatim}\nWords $a$ and \\textbf{b}.", "code text formula"),
    ("\\begin{equation}\nx\n\\end{equation}\n\\subsection*{Title}", "text formula heading"),
]


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    """Features and kinds of the labelled blocks: every prose of ``LABELLED`` alone, and
    before every other of the same language, so that blocks are seen with many neighbours."""
    x, y = [], []
    spoken = [_spoken(prose) for prose, _ in LABELLED]
    pairs = [(p, q) for i, p in enumerate(LABELLED) for j, q in enumerate(LABELLED) if len(spoken[i] | spoken[j]) <= 1]
    for prose, kinds in [*LABELLED, *((f"{p}\n\n{q}", f"{k} {m}") for (p, k), (q, m) in pairs)]:
        page, told = Page(prose), kinds.split()
        if len(told) != len(page.blocks):
            raise ValueError(f"{prose!r}: {[b[0] for b in page.blocks]}")
        x.append(page.features())
        y += [KINDS.index(k) for k in told]
    return np.vstack(x), np.array(y)


def _spoken(prose: str) -> frozenset[str]:
    """The block languages of a prose; formulas go with any of them."""
    page = Page(prose)
    return frozenset([s for s in ("html", "markdown", "wiki") if page.signs[s]] + ["latex"] * page.tex)


@lru_cache(1)
def block_tree() -> DecisionTree:
    """The tree grown on the labelled table (all of its rows)."""
    return DecisionTree().fit(*labelled_rows())


def _pages(proses: Iterable[str | None]) -> list[tuple[Page | None, list[int]]]:
    """Each prose's page and the kinds of its blocks, all classified at once; no page where there is no markup at all."""
    pages = [Page(p) if p is not None and MARKED.search(p) else None for p in proses]
    rows = [page.features() for page in pages if page and page.blocks]
    kinds = iter(block_tree().predict(np.vstack(rows)).tolist() if rows else [])
    return [(page, [next(kinds) for _ in page.blocks] if page else []) for page in pages]


def _found(page: Page | None, kinds: list[int]) -> list[tuple[str, str]]:
    if page is None:
        return []
    found = {("markup", s): None for s in LANGUAGES if page.signs[s]}
    for (_, text, _), kind in zip(page.blocks, kinds):
        name = KINDS[kind]
        if name not in ("text", "hidden") and text:
            found[name, text] = None
    return list(found)


def elements(prose: str | None) -> list[tuple[str, str]]:
    """(element, content) of a prose: its languages, and its headings, items, code blocks and formulas."""
    return _found(*_pages([prose])[0])


def clean(prose: str | None) -> str | None:
    """The text with its structure: ``#`` before headings, ``-`` before items, fences
    around code, ``$`` around formulas that stand alone; null stays null."""
    if prose is None:
        return None
    page = Page(prose)
    if not page.blocks:
        return ""
    out = []
    for (_, text, _), kind in zip(page.blocks, block_tree().predict(page.features())):
        name = KINDS[kind]
        if text and name != "hidden" and not (name == "formula" and out and text in out[-1]):
            out.append({"heading": "# " + text, "list_item": "- " + text, "code": f"```\n{text}\n```", "formula": f"${text}$"}.get(name, text))
    return "\n".join(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        once = dict.fromkeys(batch.column(1).to_pylist())  # proses repeat
        told = {prose: _found(*page) for prose, page in zip(once, _pages(once))}
        rows = [(i, *e) for i, prose in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in told[prose]]
        ids, kinds, texts = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["section_id", "element", "content"])


def section_elements(sections: DataFrame) -> DataFrame:
    """(section_id, element, content) of all sections; no shuffle, ids are unique."""
    return sections.select(F.col("section_id").cast("long"), "prose").where(F.col("prose").isNotNull()).mapInArrow(_read, "section_id long, element string, content string")


def clean_sections(sections: DataFrame) -> DataFrame:
    """(section_id, clean): each section's prose as clean text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean(x.as_py()) for x in batch.column(1)], pa.string())], ["section_id", "clean"])

    return sections.select(F.col("section_id").cast("long"), "prose").mapInArrow(read, "section_id long, clean string")
