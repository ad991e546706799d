"""TypeScript, JavaScript and Java by lines and brace depth, and annual reports by their contents links."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

from .extract import extractor

_COMMENT = re.compile(r"^[/*\s]+|[\s]+$")
_NOT_NAMES = frozenset("assert catch else finally for if new return super switch synchronized this throw try while".split())
_TS_IMPORT = re.compile(r"import\s")
_TS_TYPE = re.compile(r"(?:export\s+)?(?:default\s+)?(?:(abstract\s+)?class|interface)\s+(\w+)")
_TS_CALL = re.compile(r"(?:export\s+)?(?:(?:async\s+)?function\s+(\w+)\s*\(|const\s+(\w+)\s*=\s*(?:async)?\s*\()")
_TS_METHOD = re.compile(r"\s{2,}(?:(?:async|override|private|protected|public|readonly|static)\s+)*(\w+)\s*[(=]\s*")
_JAVA_IMPORT = re.compile(r"\s*import\s+")
_JAVA_TYPE = re.compile(r"(?:^|\s)(?:(?:abstract|final|private|protected|public|static|strictfp)\s+)*(?:record|enum|interface|class)\s+(\w+)")
_JAVA_METHOD = re.compile(
    r"\s+(?:(?:abstract|default|final|native|private|protected|public|static|synchronized|transient|volatile)\s+)*(?:<[\w,\s<>?]+>\s+)?(?:\w[\w.<>\[\],\s]*)\s+(\w+)\s*\("
)

Places = dict[tuple[str, ...], dict]


def _depth(line: str) -> int:
    return line.count("{") - line.count("}")


class _Scan:
    """One pass: doc comments wait for the declaration after them, any other line drops them."""

    def __init__(self, source: str, language: str):
        self.lines, self.language = source.splitlines(), language
        self.parts: list[str] = []
        self.places: Places = {}
        self.depth, self.types, self.doc = 0, [], []

    def imports(self, test: Callable[[str], bool]) -> None:
        at = [i for i, x in enumerate(self.lines) if test(x)]
        if at:
            self.parts.append(f"## Imports\n\n```{self.language}\n" + "\n".join(self.lines[i] for i in at) + "\n```")
            self.places[("Imports",)] = {"line_start": at[0] + 1, "line_end": at[-1] + 1, "symbol": "Imports"}

    def heading(self, mark: str, name: str) -> None:
        text = " ".join(t for x in self.doc if (t := _COMMENT.sub("", x.strip())))
        self.doc = []
        self.parts += [f"{mark} {name}"] + ([text] if text else [])

    def body(self, i: int, names: tuple[str, ...]) -> int:
        """The lines to the brace that closes the first one opened; the next line's number."""
        start, base, opened = i, self.depth, False
        while i < len(self.lines):
            opened |= "{" in self.lines[i]
            self.depth += _depth(self.lines[i])
            i += 1
            if opened and self.depth <= base:
                break
        self.places[names] = {"line_start": start + 1, "line_end": i, "symbol": ".".join(names)}
        self.parts.append(f"```{self.language}\n" + "\n".join(self.lines[start:i]) + "\n```")
        return i

    def leave(self) -> None:
        while self.types and self.depth <= self.types[-1][1]:
            self.types.pop()

    def run(self, declare: Callable[[_Scan, int, str], int | None]) -> tuple[str, Places]:
        i, inside = 0, False
        while i < len(self.lines):
            line = self.lines[i]
            if inside or line.strip().startswith("/**"):
                self.doc = [*self.doc, line] if inside else [line]
                inside = "*/" not in line
                i += 1
                continue
            after = declare(self, i, line)
            if after is None:
                self.doc = []
                self.depth += _depth(line)
                self.leave()
                after = i + 1
            i = after
        return "\n\n".join(self.parts), self.places

    def method(self, i: int, m: re.Match | None) -> int | None:
        if not m or m[1] in _NOT_NAMES or not self.types or self.depth != self.types[-1][1] + 1:
            return None
        owner = self.types[-1][0]
        self.heading("##", m[1])
        after = self.body(i, (owner, m[1]))
        self.leave()
        return after


def _ts_line(s: _Scan, i: int, line: str) -> int | None:
    bare = line.strip()
    if m := _TS_TYPE.match(bare):
        s.heading("#", m[2])
        if "interface" not in m[0].split():
            s.types.append((m[2], s.depth))
        s.depth += _depth(line)
        return i + 1
    if not s.types and (m := _TS_CALL.match(bare)):
        name = m[1] or m[2]
        s.heading("#", name)
        return s.body(i, (name,))
    return s.method(i, _TS_METHOD.match(line))


def _java_line(s: _Scan, i: int, line: str) -> int | None:
    if _JAVA_IMPORT.match(line):
        s.doc = []
        return i + 1
    if s.depth <= 1 and (m := _JAVA_TYPE.search(line)):
        s.heading("#", m[1])
        s.types.append((m[1], s.depth))
        s.depth += _depth(line)
        return i + 1
    return s.method(i, _JAVA_METHOD.match(line))


def scan(data: bytes, language: str) -> tuple[str, Places]:
    """(Markdown, lines and symbol by section) of a source file."""
    try:
        s = _Scan(data.decode("utf-8"), "java" if language == "java" else "typescript")
    except UnicodeDecodeError as e:
        raise ValueError(f"not UTF-8: {e}") from e
    if language == "java":
        s.imports(lambda x: bool(_JAVA_IMPORT.match(x)))
        return s.run(_java_line)
    s.imports(lambda x: bool(_TS_IMPORT.match(x.strip())))
    return s.run(_ts_line)


@extractor("typescript", "javascript")
def typescript(data: bytes, path: str | None = None) -> str:
    return scan(data, "typescript")[0]


@extractor("java")
def java(data: bytes, path: str | None = None) -> str:
    return scan(data, "java")[0]


def annotate_code(sections: list[list[str]], data: bytes, language: str) -> list[dict | None]:
    places = scan(data, language)[1]
    return [places.get(tuple(s)) for s in sections]


# annual reports

_NAMES = """Exhibits Financial Statement Schedules=15 | Principal Accountant Fees=14 | Certain Relationships Related Transactions=13 | Security Ownership=12
| Executive Compensation=11 | Directors Officers Corporate Governance=10 | Foreign Jurisdictions Disclosures=9C | Other Information=9B
| Controls and Procedures=9A | Disagreements with Accountants=9 | Financial Statements=8 | Quantitative Qualitative Disclosures About Market Risk=7A
| Management Discussion and Analysis=7 | Reserved=6 | Market Information=5 | Mine Safety Disclosures=4 | Legal Proceedings=3 | Properties=2
| Cybersecurity=1C | Unresolved Staff Comments=1B | Risk Factors=1A | Business=1"""
ITEMS = {number: name.strip() for name, number in (x.strip().split("=") for x in _NAMES.split("|"))}
RULE = "\n\n---\n\n"
PROSE_ITEMS = frozenset("1 1A 1B 1C 2 3 7 7A 9 9A".split())
_ITEM = re.compile(r"Item\s+(1[0-5]|1[ABC]?|[2-9][AB]?)\s*\.", re.I)
_SLUG = re.compile(r"\bitem[-_](\d+[abc]?)[-_]", re.I)
_BLOCK = "(?:div|li|p|td|th)"
_BOLD = (
    re.compile(rf"(?i)<{_BLOCK}[^>]*>\s*<(?:strong|b)[^>]*>([^\n<]+)</(?:strong|b)>\s*\.?\s*</{_BLOCK}>"),
    re.compile(rf"(?i)<{_BLOCK}[^>]*>\s*<span[^>]*font-weight\s*:\s*(?:bold(?:er)?|[6-9]\d\d)[^>]*>([^<]+)</span>\s*</{_BLOCK}>"),
)


class _Plain(HTMLParser):
    """Text with line breaks at blocks; inline-report tags, scripts and styles are left out."""

    BREAKS = frozenset("article br div h1 h2 h3 h4 h5 h6 hr li p section td th tr".split())

    def __init__(self, headings: bool):
        super().__init__()
        self.headings, self.out, self.skip, self.mark = headings, [], 0, ""

    def hidden(self, tag: str) -> bool:
        return tag in ("script", "style") or tag.startswith("ix:")

    def handle_starttag(self, tag, attrs):
        self.skip += self.hidden(tag)
        if self.skip:
            return
        if tag in self.BREAKS:
            self.out.append("\n")
        if self.headings and re.fullmatch("h[1-6]", tag):
            self.mark = "#" * int(tag[1]) + " "

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - self.hidden(tag))
        if self.headings and re.fullmatch("h[1-6]", tag):
            self.mark = ""
            self.out.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.mark and data.strip():
            self.out.append(self.mark)
            self.mark = ""
        self.out.append(data)


def _text(html: str, headings: bool = False) -> str:
    p = _Plain(headings)
    p.feed(html)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[^\S\n]+", " ", "".join(p.out))).strip()


def contents(html: str) -> list[tuple[str, str]]:
    """(anchor, item) of the table of contents: item in the link, in the anchor's name, or in the link's row."""
    out: dict[str, str] = {}
    for m in re.finditer(r'(?is)<a\s[^>]*?href="#([^"]+)"[^>]*>(.*?)</a\s*>', html):
        anchor = m[1].strip()
        if anchor in out:
            continue
        hit = _ITEM.search(_text(m[2]))
        slug = _SLUG.search(anchor)
        row = html.rfind("<tr", 0, m.start())
        if not hit and slug and slug[1].upper() in ITEMS:
            out[anchor] = slug[1].upper()
            continue
        if not hit and row >= 0 and m.start() - row < 2000:
            hit = _ITEM.search(_text(html[row : m.start()]))
        if hit:
            out[anchor] = hit[1].upper()
    return list(out.items())


@extractor("edgar", "edgar-html", "edgar-xbrl")
def annual_report(data: bytes, path: str | None = None, prose_only: bool = True, bold_headings: bool = False, bold_chars: int = 120) -> str:
    """A ``#`` section for each item of a filing; plain text where there are no contents links."""
    html = data.decode("utf-8", "replace")
    toc = contents(html)
    if not toc:
        return _text(html)
    spots = [html.rfind("<", 0, at) if (at := html.find(f'id="{a}"')) >= 0 else -1 for a, _ in toc]

    def heading(m: re.Match) -> str:
        t = m[1].strip().rstrip(".")
        return f"<h2>{t}</h2>" if 0 < len(t) <= bold_chars else m[0]

    out = []
    for i, (_, item) in enumerate(toc):
        if spots[i] < 0 or (prose_only and item not in PROSE_ITEMS):
            continue
        end = spots[i + 1] if i + 1 < len(toc) and spots[i + 1] > spots[i] else len(html)
        body = html[spots[i] : end]
        if bold_headings:
            for r in _BOLD:
                body = r.sub(heading, body)
        if text := _text(body, bold_headings):
            out.append(f"# Item {item}.  {ITEMS.get(item, f'Item {item}')}\n\n{text}")
    return RULE.join(out)
