"""Structure-aware chunking.

A document is a sequence of blocks; what happens to a block depends on all before it, so one
document is one Python loop, and documents are spread over Arrow batches.  ``Chunker`` is the
state machine, ``chunk_documents`` the table operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import text as X
from .tables import map_rows

MIN_CHUNK, MAX_CHUNK = 600, 1500

CHUNK_FIELDS = (
    "content string, section array<string>, chunk_index int, source_offset long, source_length long, "
    "breadcrumb string, embedding_content string, paragraph_continuation boolean"
)


@dataclass(frozen=True)
class Options:
    """Sizes in characters; ``slack`` is the share by which a chunk may pass ``most`` before a split is forced."""

    least: int = MIN_CHUNK
    most: int = MAX_CHUNK
    slack: float = 0.15
    breadcrumb: bool = True
    doc_name: bool = True
    crumb_limit: int | None = None
    overlap: int = 0
    promote: bool = False
    promote_questions: bool = True
    promote_phrases: bool = True
    header_words: int = 6
    header_chars: int = 80
    levels: tuple[tuple[str, int], ...] | None = None
    toc_gap: int = 300


@dataclass
class Piece:
    content: str
    section: list[str]
    chunk_index: int
    source_offset: int | None
    source_length: int
    breadcrumb: str | None
    embedding_content: str | None
    paragraph_continuation: bool = False


# lines and blocks


def table_line(line: str) -> bool:
    return line.count("|") > 1


_BULLET = re.compile(r"[-*+] ")
_NUMBER = re.compile(r"(\S{1,4}?)\. ")


def list_line(line: str) -> bool:
    s = line.lstrip()
    if _BULLET.match(s):
        return True
    m = _NUMBER.match(s)
    return bool(m) and m[1].isdigit()


def block_kind(block: str) -> str:
    lines = [x for x in block.split("\n") if x.strip()]
    if any(map(table_line, lines)):
        return "table"
    return "list" if any(map(list_line, lines)) else "prose"


def merge_runs(blocks: Sequence[str], joiner: str) -> list[str]:
    """Neighbouring blocks with table lines become one, so do neighbouring blocks with list lines.

    A block with both kinds opens a table; within a run of list blocks it goes on as list.
    """
    out: list[str] = []
    run: list[str] = []
    kind = ""

    def has(block: str, test) -> bool:
        return any(test(x) for x in block.split("\n") if x.strip())

    for b in blocks:
        if run and has(b, table_line if kind == "table" else list_line):
            run.append(b)
            continue
        if run:
            out.append(joiner.join(run))
        kind, run = block_kind(b), [b]
        if kind == "prose":
            out.append(b)
            run = []
    return out + ([joiner.join(run)] if run else [])


# splitting


def pack(parts: Sequence[str], joiner: str, most: int) -> list[str]:
    """Greedy packing of parts into pieces of at most ``most``; a longer part is a piece of its own."""
    out: list[str] = []
    now: list[str] = []
    size = 0
    for p in parts:
        grown = size + len(joiner) + len(p) if now else len(p)
        if now and grown > most:
            out.append(joiner.join(now))
            now, grown = [], len(p)
        now.append(p)
        size = grown
    return out + ([joiner.join(now)] if now else [])


def split_words(text: str, most: int) -> list[str]:
    return [text] if len(text) <= most else [p for p in pack([w for w in re.split(r"\s+", text) if w], " ", most)] or [text]


def split_sentences(text: str, most: int) -> list[str]:
    """Pieces that end with sentences; one without a sentence end is cut at words."""
    if len(text) <= most:
        return [text]
    pieces = pack([s for s in re.split(r"(?<=[.?!])\s+", text) if s], " ", most)
    return [q for p in pieces for q in (split_words(p, most) if len(p) > most else [p])] or [text]


def split_lines(text: str, most: int) -> list[str]:
    """Pieces of whole lines; a longer line is cut at sentences."""
    if len(text) <= most:
        return [text]
    return [q for p in pack(text.split("\n"), "\n", most) for q in (split_sentences(p, most) if len(p) > most else [p])]


# headings


def common_path(paths: Sequence[Sequence[str]]) -> list[str]:
    """Common prefix of the non-empty paths, or the last of them where there is none."""
    some = [p for p in paths if p]
    if not some:
        return []
    n = 0
    while all(len(p) > n for p in some) and len({p[n] for p in some}) == 1:
        n += 1
    return list(some[0][:n] or some[-1])


def compress(parts: Sequence[str], limit: int | None) -> str:
    """``[first > ... > last]``: middle parts give way to dots, one after another, until the limit holds."""
    parts = list(parts)

    def shown() -> str:
        return "[" + " > ".join(parts) + "]"

    while limit is not None and len(parts) > 2 and len(shown()) > limit:
        mid = len(parts) // 2
        if parts[mid] != "...":
            parts[mid] = "..."
            if parts[mid - 1] == "...":
                del parts[mid]
        elif mid + 2 < len(parts):
            del parts[mid + 1]
        else:
            del parts[mid - 1]
    return shown() if parts else ""


def only_headings(text: str) -> bool:
    return not any(x.strip() and not x.strip().startswith("#") for x in text.splitlines())


def cells_of(text: str) -> list[str]:
    """Cell values of table text without rules."""
    found = (" ".join(c.split()) for c in text.replace("\n", " ").split("|"))
    return [c for c in found if c and c.strip("-:| ")]


class Chunker:
    """The chunks of one document.

    Blocks gather until a heading finds at least ``least`` characters, or the next block would
    pass the hard limit; that block is then split by its kind.  Every chunk carries the common
    path of the headings it touches.  Offsets are bytes of the first place where the stripped
    block occurs, lengths are bytes of the chunk's text.
    """

    def __init__(self, name: str, content: str, options: Options):
        o = self.o = options
        self.name = name
        self.text = promote_headers(content, o) if o.promote else content
        self.hard = int(o.most * (1 + o.slack))
        self.out: list[Piece] = []
        self.buffer, self.at = "", None
        self.stack: list[tuple[int, str]] = []
        self.path: list[str] = []
        self.touched: list[list[str]] = []
        self.bytes = None
        if not self.text.isascii():
            self.bytes = [0]
            for ch in self.text:
                self.bytes.append(self.bytes[-1] + len(ch.encode("utf-8", "surrogatepass")))

    def run(self) -> list[Piece]:
        joiner = "\n\n" if "\n\n" in self.text else "\n"
        self.touch()
        for block in merge_runs(self.text.split(joiner), joiner):
            block = block.strip()
            if not block:
                continue
            at = self.offset(block)
            if block.startswith("#"):
                self.heading(block)
            elif block.startswith("[Sheet:") and block.endswith("]"):
                self.sheet(block)
            grown = (self.buffer + joiner + block).strip() if self.buffer else block
            if len(grown) > self.hard:
                self.split(block, at)
                continue
            if not self.buffer:
                self.at = at
            self.buffer = grown
        if self.buffer and not only_headings(self.buffer):
            self.emit(self.buffer, self.at)
        return self.overlapped() if self.o.overlap > 0 else self.out

    def offset(self, block: str) -> int | None:
        i = self.text.find(block)
        return None if i < 0 else i if self.bytes is None else self.bytes[i]

    def touch(self) -> None:
        if not self.touched or self.touched[-1] != self.path:
            self.touched.append(list(self.path))

    def emit(self, text: str, at: int | None, more: bool = False, enriched: str | None = None) -> None:
        path = common_path(self.touched)
        body = text if enriched is None else enriched
        crumb = embed = None
        if self.o.breadcrumb and body:
            crumb = compress([self.name] * self.o.doc_name + path, self.o.crumb_limit) or None
            embed = f"{crumb}\n\n{body}" if crumb else body
        elif enriched is not None:
            embed = f"{path[-1]}\n\n{body}" if path else body
        self.out.append(Piece(text, path, len(self.out), at, len(text.encode("utf-8", "surrogatepass")), crumb, embed, more))

    def clear(self) -> None:
        self.buffer, self.at, self.touched = "", None, []
        self.touch()

    def close(self) -> None:
        self.emit(self.buffer, self.at)
        self.clear()

    def heading(self, block: str) -> None:
        if self.buffer and len(self.buffer) >= self.o.least and not only_headings(self.buffer):
            self.close()
            self.touched = []
        title = block.lstrip("#")
        level = len(block) - len(title)
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        self.stack.append((level, title.strip()))
        self.path = [t for _, t in self.stack]
        self.touch()

    def sheet(self, block: str) -> None:
        if self.buffer and not only_headings(self.buffer):
            self.close()
        self.stack = [(0, block[7:-1].strip())]
        self.path = [self.stack[0][1]]
        self.touch()

    def split(self, block: str, at: int | None) -> None:
        if self.buffer and not only_headings(self.buffer):
            self.close()
        kind = block_kind(block)
        if kind == "prose":
            pieces = split_sentences(block, self.o.most)
            for i, p in enumerate(pieces):
                if i == len(pieces) - 1 and len(p) < self.o.least:
                    self.buffer, self.at = p, at
                    self.touch()
                    return
                self.emit(p, at, more=i > 0)
                self.clear()
            return
        pieces = split_lines(block, self.o.most)
        header = None
        if kind == "table" and len(pieces) > 1:
            header = next((x.strip() for x in pieces[0].split("\n") if x.strip() and x.strip().strip("|:- \t")), None)
        names = cells_of(header) if header else []
        for i, p in enumerate(pieces):
            first, last = i == 0, i == len(pieces) - 1
            if first and last:
                self.emit(p, at)
            else:
                mark = kind.upper()
                above, below = f"[{mark}:{'start' if first else 'cont'}]", f"[{mark}:{'end' if last else 'cont'}]"
                body = p if first or not header else f"{header}\n{p}"
                rows = self.rows(p, names, first) if names else ""
                self.emit(f"{above}\n{body}\n{below}", at, enriched=f"{above}\n{rows}\n{below}" if rows else None)
            self.clear()

    @staticmethod
    def rows(piece: str, names: list[str], first: bool) -> str:
        """``header: value`` lines of the piece's full rows."""
        n = len(names)
        cells = cells_of(piece)[n if first else 0 :]
        full = [cells[i : i + n] for i in range(0, len(cells) - n + 1, n)]
        low = [h.lower() for h in names]
        return "\n".join(" | ".join(map(": ".join, zip(low, r))) for r in full)

    def overlapped(self) -> list[Piece]:
        """Each chunk after the end of the one before it, which already has its own overlap."""
        done = self.out[:1]
        for p in self.out[1:]:
            done.append(replace(p, content=tail_of(done[-1].content, self.o.overlap) + p.content))
        return done


def tail_of(text: str, n: int) -> str:
    """The last n characters, from the next word on where they would begin inside one."""
    if len(text) <= n:
        return text
    tail = text[len(text) - n :]
    inside = not text[len(text) - n - 1].isspace() and not tail[0].isspace()
    return tail.split(" ", 1)[1] if inside and " " in tail else tail


# headings of plain text

#: Parts (upper case only) and chapters (any case) of prose books.
PROSE_LEVELS = ((r"(?:BOOK|PART|SCENE)\s+(?:\d+|[CDILMVX]+|THE\s+[A-Z]+)", 1), (r"(?i:chapter)\s+(?:\d+|[CDILMVX]+)", 2))
_FINITE = frozenset(
    "affect allow appear are be become been being can cause come consist contain could develop did do does form give go had has have help "
    "include involve is make may need occur provide remain require seem should show stay take use want was were will would".split()
)
_INDEX_LINE = re.compile(r".{2,60},\s*\d[\d\s,\-–]*")


def _title_after(text: str, at: int) -> tuple[str, int]:
    """Upper-case words from ``at`` on, and where prose or a page number begins."""
    while at < len(text) and text[at] in " .-\t–—":
        at += 1
    words = []
    for m in re.compile(r" *([^ \t\n]+)").finditer(text, at):
        if m.start() != at:
            break
        letters = [c for c in m[1] if c.isalpha()]
        if any(not c.isupper() for c in letters) or (not letters and m[1].isdigit()):
            break
        if letters:
            words.append(m[1].rstrip(".,;:"))
        at = m.end()
    while at < len(text) and text[at] == " ":
        at += 1
    return " ".join(words).strip(" ").rstrip("-–—:;,."), at


def promote_levels(text: str, levels: Sequence[tuple[str, int]], toc_gap: int = 300, strip_toc: bool = True) -> str:
    """Structural markers as headings; markers of one level that follow closely are a table of contents."""
    hits = sorted(((m.start(), m.end(), m[0], level) for p, level in levels for m in re.finditer(p, text)), key=lambda h: h[0])
    toc: set[int] = set()
    for level in {h[3] for h in hits}:
        own = [i for i, h in enumerate(hits) if h[3] == level]
        for a, b in zip(own, own[1:]):
            if hits[b][0] - hits[a][0] < toc_gap:
                toc |= {a, b}
    for i in reversed(range(len(hits))):
        start, end, marker, level = hits[i]
        title, prose = _title_after(text, end)
        if i not in toc:
            text = f"{text[:start]}\n\n{'#' * level} {marker}{': ' + title if title else ''}\n\n{text[prose:]}"
        elif strip_toc:
            text = text[:start] + text[prose:]
    return text


def strip_index(text: str, share: float = 0.5) -> str:
    """Without paragraphs of which ``share`` of the lines look like index entries."""

    def keep(p: str) -> bool:
        lines = [x.strip() for x in p.splitlines() if x.strip()]
        return not lines or sum(bool(_INDEX_LINE.fullmatch(x)) for x in lines) / len(lines) < share

    return "\n\n".join(p for p in text.split("\n\n") if keep(p))


def promote_questions(text: str, words: int, chars: int) -> str:
    """A question that no question follows becomes a heading."""
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text)]
    out = ""
    for s, after in zip(sentences, [*sentences[1:], ""]):
        if s.endswith("?") and not after.endswith("?") and len(s.split()) <= 2 * words and len(s) <= 2 * chars:
            out += f"\n\n## {s}\n\n"
        else:
            out += (" " if out and not out.endswith("\n") else "") + s
    return out.strip()


def promote_phrases(text: str, words: int, chars: int) -> str:
    """A short capitalised phrase without a verb, between a sentence's end and the next sentence, becomes a heading."""

    def header(m: re.Match) -> str:
        phrase = m[2].strip().rstrip(".,;:")
        found = phrase.split()
        good = 2 <= len(found) <= words and len(phrase) <= chars and phrase[0].isupper() and not re.search(r"\s[–—-]+\s*$", phrase)
        verb = any(w in _FINITE for w in re.findall(r"\w+", phrase.lower()))
        return f"{m[1]}\n\n## {phrase}\n\n" if good and not verb else m[0]

    return re.sub(r"([.!?] )([A-Z][^.!?\n]{2,}?)(?= [A-Z][a-z])", header, text)


def promote_headers(text: str, o: Options, index: bool = False, isolated: bool = False) -> str:
    """Markdown headings for flat text: structural markers, then questions, then short phrases."""
    if isolated:
        text = re.sub(r"\b[b-hj-z]\b", "", text)
    text = re.sub(r"[ \t]+", " ", text).strip()
    if o.levels:
        text = promote_levels(text, o.levels, o.toc_gap)
    if index:
        text = strip_index(text)
    if o.promote_questions:
        text = promote_questions(text, o.header_words, o.header_chars)
    return promote_phrases(text, o.header_words, o.header_chars) if o.promote_phrases else text


# table operators


def chunk_text(name: str, content: str, options: Options = Options()) -> list[Piece]:
    return Chunker(name, content, options).run()


def chunk_documents(df: DataFrame, name_col: str, text_col: str, options: Options = Options(), keep: Sequence[str] = ()) -> DataFrame:
    """One row a chunk: document_name, the columns ``keep``, and the chunk's fields.

    Null texts have no chunks; a null name counts as an empty one.  The loop over one
    document is Python, fed by Arrow batches; no shuffle is needed.
    """
    slim = df.select(F.col(name_col).cast("string").alias("document_name"), *keep, F.col(text_col).alias("__text"))
    fields = T.StructType([*slim.schema.fields[:-1], *T._parse_datatype_string(CHUNK_FIELDS).fields])

    def cut(name: str | None, *rest) -> Iterator[tuple]:
        if rest[-1] is not None:
            for p in Chunker(name or "", rest[-1], options).run():
                yield (name, *rest[:-1], *vars(p).values())

    return map_rows(slim, lambda: cut, fields)


def enrich(chunks: DataFrame) -> DataFrame:
    """Chunks with the text to embed rebuilt from breadcrumb, document and section."""
    return chunks.withColumn("embedding_content", X.enriched(F.col("content"), F.col("breadcrumb"), F.col("document_name"), F.col("section")))


def with_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with their stable ids."""
    return chunks.withColumn("chunk_id", X.chunk_id(F.col("document_name"), F.col("chunk_index"), F.coalesce("embedding_content", "content")))


def chunk_udtf():
    """``chunk_document(name, content, least, most)`` as a table function for SQL with LATERAL."""

    @F.udtf(returnType=CHUNK_FIELDS)
    class ChunkDocument:
        def eval(self, name: str, content: str, least: int, most: int):
            if content is not None:
                for p in Chunker(name or "", content, Options(least=least, most=most)).run():
                    yield tuple(vars(p).values())

    return ChunkDocument


def merged_lines(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key, first_line, kind, n_lines) of runs of table lines, of list lines, and single prose lines, without Python."""
    lines = df.select(F.col(key_col).alias("key"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    kind = F.when(X.is_table_line(F.col("line")), "table").when(X.is_list_line(F.col("line")), "list").otherwise("prose")
    w = Window.partitionBy("key").orderBy("pos")
    marked = lines.select("key", "pos", kind.alias("kind"))
    new = F.when((F.col("kind") == F.lag("kind").over(w)) & (F.col("kind") != "prose"), 0).otherwise(1)
    runs = marked.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("key", "run").agg(F.min("pos").alias("first_line"), F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n_lines")).drop("run")


def token_windows(df: DataFrame, key_col: str, text_col: str, size: int = 256, overlap: int = 0) -> DataFrame:
    """(key, window, content): fixed windows of blank-separated tokens, the plain baseline."""
    step = max(1, size - overlap)
    tokens = F.filter(F.split(F.col(text_col), r"\s+"), lambda t: t != "")
    starts = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = df.select(F.col(key_col).alias("key"), tokens.alias("tokens")).select("key", "tokens", F.posexplode(starts).alias("window", "at"))
    return cut.select("key", "window", F.array_join(F.slice("tokens", F.col("at") + 1, F.lit(size)), " ").alias("content"))
