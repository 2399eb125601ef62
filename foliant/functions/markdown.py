r"""LaTeX to Markdown, page by page, in Arrow batches: braces nest, so column expressions do not reach.

A page is read token by token, and every command and environment is shown by a
handler of its own; what has none stays as it is written. Nesting is followed:
commands within commands, lists within lists and groups within cells come out
as one would write them. A comment within a table ends with its line.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Environments that become display math; commands by what is shown for them.
DISPLAYS = ("equation", "align", "align*", "gather", "gather*", "multline", "multline*", "flalign", "flalign*")
MARKS = {"textbf": "**", "textit": "*", "emph": "*", "large": ""}
SHOWN = {"par": "\n\n", "linebreak": "\n", "newline": "\n", "noindent": "", "sloppy": "", "hrule": "", "hfill": "", "centering": ""}
WITH_SPACE = {"switchcolumn": "\n", "RaggedRight": ""}
WITH_ARGUMENT = ("label", "ref", "cite", "vspace", "hspace", "footnote")
HEADINGS = {"section*": "#", "subsection*": "##"}
SIGNS = {"textasciitilde": "~", "textasciicircum": "^"}
ESCAPED = "%$&#_{}"

_TOKEN = re.compile(r"\\begin\{(?P<begin>[^}]*)\}|\\end\{(?P<end>[^}]*)\}|\\(?P<word>[A-Za-z]+\*?)|\\(?P<sign>[^A-Za-z])|(?P<brace>[{}])|(?P<note>%[^\n]*)|(?P<plain>[^\\{}%]+|\\)", re.S)
_LOGO = re.compile(r"\\noindent\\hfill\\includegraphics\[[^\]]*\]\{[^}]*\}\\par\\noindent\\hrule\\vspace\{[^}]*\}\s*")
_TITLE = re.compile(r"\s*\\textbf\{\\large\s*([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}\s*", re.S)
_ITEM = "\x00"


def group(text: str, start: int) -> tuple[str, int]:
    """The inside of the brace group that opens at ``start``, and where it ends; an open one reaches to the text's end."""
    depth = 0
    for m in _TOKEN.finditer(text, start):
        if m["brace"]:
            depth += 1 if m["brace"] == "{" else -1
            if not depth:
                return text[start + 1 : m.start()], m.end()
    return text[start + 1 :], len(text)


class Page:
    """A cursor over one text, with handlers for commands; a handler takes the page, which stands behind the command."""

    def __init__(self, text: str, commands: dict[str, Callable[[Page], str]], environments: dict[str, Callable[[str], str]]):
        self.text, self.at, self.commands, self.environments = text, 0, commands, environments

    def inner(self, text: str) -> str:
        return Page(text, self.commands, self.environments).show()

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def argument(self) -> str | None:
        """The next group as it is written; None where there is none."""
        m = re.compile(r"\s*\{").match(self.text, self.at)
        if not m:
            return None
        inside, self.at = group(self.text, m.end() - 1)
        return inside

    def option(self) -> str | None:
        m = re.compile(r"\[([^\]]*)\]").match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        return m[1]

    def environment(self, name: str) -> str:
        """What stands up to the matching end, which may be missing."""
        depth, start = 1, self.at
        for m in re.compile(rf"\\(begin|end)\{{{re.escape(name)}\}}").finditer(self.text, start):
            depth += 1 if m[1] == "begin" else -1
            if not depth:
                self.at = m.end()
                return self.text[start : m.start()]
        self.at = len(self.text)
        return self.text[start:]

    def show(self) -> str:
        out = []
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            self.at = m.end()
            if m["word"]:
                handler = self.commands.get(m["word"])
                out.append(handler(self) if handler else m[0])
            elif m["begin"]:
                handler = self.environments.get(m["begin"])
                out.append(handler(self) if handler else m[0])
            elif m["sign"]:
                out.append(self._sign(m["sign"]))
            elif not m["note"]:
                out.append(m[0])
        return "".join(out)

    def _sign(self, sign: str) -> str:
        if sign == "\\":
            return "\\\\" if self.text.startswith("[", self.at) else "\n"
        return sign if sign in ESCAPED else "\\" + sign


def _wrapped(mark: str, name: str) -> Callable[[Page], str]:
    def handle(page: Page) -> str:
        inside = page.argument()
        return "\\" + name if inside is None else mark + page.inner(inside) + mark

    return handle


def _dropped(name: str) -> Callable[[Page], str]:
    return lambda page: "\\" + name if page.argument() is None else ""


def _heading(mark: str, name: str) -> Callable[[Page], str]:
    def handle(page: Page) -> str:
        inside = page.argument()
        return "\\" + name if inside is None else f"\n{mark} {page.inner(inside)}\n"

    return handle


def _colour(page: Page) -> str:
    """The name of the colour stays, and so does the group behind it."""
    inside = page.argument()
    return "\\textcolor" if inside is None else inside


def _figure(page: Page) -> str:
    start = page.at
    if page.option() is not None and page.argument() is not None:
        return ""
    page.at = start
    return "\\includegraphics"


def _logo(page: Page) -> str:
    m = _LOGO.match(page.text, page.at - len("\\noindent"))
    if m:
        page.at = m.end()
    return ""


def _spaced(shown: str) -> Callable[[Page], str]:
    def handle(page: Page) -> str:
        page.space()
        return shown

    return handle


def _boxed(page: Page) -> str:
    """A scaled box: its content, as a table if it has cells or rows."""
    start = page.at
    parts = [page.argument() for _ in range(3)]
    if parts[2] is None:
        page.at = start
        return "\\resizebox"
    if "\\begin{tabular}" not in parts[2] and ("&" in parts[2] or "\\\\" in parts[2]):
        return html_table(parts[2]) or page.inner(parts[2])
    return page.inner(parts[2])


def _letter(name: str, shown: str) -> Callable[[Page], str]:
    def handle(page: Page) -> str:
        if page.text.startswith("{}", page.at):
            page.at += 2
            return shown
        return "\\" + name

    return handle


def _display(name: str) -> Callable[[Page], str]:
    return lambda page: f"\n\\[\n{page.inner(page.environment(name)).strip()}\n\\]\n"


def _items(page: Page) -> str:
    inside = page.environment("itemize")
    marked = Page(inside, page.commands | {"item": _spaced(_ITEM)}, page.environments).show()
    items = [x.strip() for x in marked.split(_ITEM)]
    return "\n" + "\n".join(f"- {x}" for x in items if x) + "\n"


def _tabular(page: Page) -> str:
    page.argument()
    return f"\n{html_table(page.environment('tabular'))}\n"


def _centred(page: Page) -> str:
    inside = page.environment("center")
    title = _TITLE.fullmatch(inside)
    return f"\n# {page.inner(title[1]).strip()}\n" if title else f"\n{page.inner(inside.strip())}\n"


def _columns(page: Page) -> str:
    page.argument()
    page.space()
    return page.inner(page.environment("paracol"))


def html_table(content: str) -> str:
    """Rows and cells as an HTML table; rows without any text are left out.

    Commands show what their groups hold. A cell ends at every ampersand, an
    escaped one too, which leaves its backslash.
    """
    rows: list[list[str]] = [[""]]
    page = Page(content, {}, {})
    while page.at < len(content):
        m = _TOKEN.match(content, page.at)
        page.at = m.end()
        if m["sign"] == "\\":
            rows.append([""])
        elif m["sign"] == "&":
            rows[-1][-1] += "\\"
            rows[-1].append("")
        elif m["sign"]:
            rows[-1][-1] += m["sign"] if m["sign"] in "%#_" else "" if m["sign"] in "${}" else m[0]
        elif m["word"] == "cline":
            page.argument()
        elif m["word"]:
            page.space()
            while content.startswith("{", page.at):
                inside, page.at = group(content, page.at)
                rows[-1][-1] += "".join(t["plain"] or (t["sign"] or "").strip("\\") for t in _TOKEN.finditer(inside)).replace("$", "")
        elif m["plain"]:
            cells = m[0].replace("$", "").split("&")
            rows[-1][-1] += cells[0]
            rows[-1] += cells[1:]
    shown = ["".join(f"<td>{c.strip()}</td>" for c in row) for row in rows if any(c.strip() for c in row)]
    return '<table border="1">' + "".join(f"<tr>{r}</tr>" for r in shown) + "</table>" if shown else ""


COMMANDS: dict[str, Callable[[Page], str]] = {
    **{name: _wrapped(mark, name) for name, mark in MARKS.items()},
    **{name: lambda page, shown=shown: shown for name, shown in SHOWN.items()},
    **{name: _spaced(shown) for name, shown in WITH_SPACE.items()},
    **{name: _dropped(name) for name in WITH_ARGUMENT},
    **{name: _heading(mark, name) for name, mark in HEADINGS.items()},
    **{name: _letter(name, shown) for name, shown in SIGNS.items()},
    "noindent": _logo, "includegraphics": _figure, "textcolor": _colour, "resizebox": _boxed,
}
ENVIRONMENTS: dict[str, Callable[[Page], str]] = {
    **{name: _display(name) for name in DISPLAYS},
    "itemize": _items, "tabular": _tabular, "center": _centred, "paracol": _columns,
}


def unwrap(text: str, command: str, show: Callable[[str], str]) -> str:
    """Replace ``command{...}`` by what ``show`` makes of its inside, wherever it stands; all else stays."""
    out, at, name = [], 0, command.lstrip("\\")
    for m in _TOKEN.finditer(text):
        if m["word"] == name and m.start() >= at and (start := re.compile(r"\s*\{").match(text, m.end())):
            inside, end = group(text, start.end() - 1)
            out += [text[at : m.start()], show(unwrap(inside, command, show))]
            at = end
    return "".join(out) + text[at:]


def to_markdown(tex: str) -> str:
    """One LaTeX document as Markdown."""
    begin, end = tex.find("\\begin{document}"), tex.find("\\end{document}")
    body = tex[begin + len("\\begin{document}") : end] if 0 <= begin < end else tex
    shown = re.sub(r"\n{3,}", "\n\n", Page(body.strip(), COMMANDS, ENVIRONMENTS).show())
    return "\n".join(line.rstrip() for line in shown.split("\n")).strip()


@F.pandas_udf(T.StringType())
def markdown(tex: pd.Series) -> pd.Series:
    """Column form; a null document, or one that nests too deeply to be read, is an empty page."""

    def one(x: str | None) -> str:
        try:
            return to_markdown(x or "")
        except RecursionError:
            return ""

    return tex.map(one)


def markdown_of(column: str) -> Column:
    return markdown(F.col(column))
