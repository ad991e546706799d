"""Chat formatting of turns with typed content parts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import quoted

#: Bytes of text that count as one token, and tokens around each turn.
TEXT_BYTES, TURN_TOKENS = 4, 4
#: An image costs a base and a cost for each 512 x 512 tile; without a size it is one tile.
IMAGE_BASE, IMAGE_TILE, TILE = 85, 170, 512
AUDIO_SECOND, DOCUMENT_PAGE = 25, 500
#: A width, height, length or number of pages counts as at most this.
MOST = 1e6
#: Turn numbers of a row of the result: a longer conversation has several rows.
PART_TURNS = 4096

ATTACHMENT = "array<struct<ordinal:int,kind:string,ref:string,tokens:long>>"


_LONE = re.compile("[\ud800-\udfff]")


def text_tokens(s: str) -> int:
    return -(-len(s.encode()) // TEXT_BYTES)


def whole(s: str) -> str:
    """Text that UTF-8 can hold: U+FFFD in place of a lone surrogate."""
    return _LONE.sub("\ufffd", s)


def safe(s: str) -> str:
    """Text that can't be read as a marker of the format."""
    return whole(s).replace("<|", "< |")


def _number(x, default: float) -> float:
    """A number from 0 to MOST, beyond which it counts as MOST; the default for anything else."""
    if not isinstance(x, (int, float)) or isinstance(x, bool) or not x >= 0 or x == float("inf"):
        return default
    return float(min(x, MOST))


def _ref(part: dict, *names: str) -> str | None:
    """The first string under one of the names, there or as the url or data of an object."""
    for n in names:
        v = part.get(n)
        if isinstance(v, dict):
            v = v.get("url") or v.get("data") or v.get("file_id")
        if isinstance(v, str) and v:
            return whole(v)
    return None


@dataclass
class Flattener:
    """Visitor over the content parts of one turn: text in order, a placeholder for each attachment."""

    turn: int | None
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    todo: list = field(default_factory=list)

    def visit(self, part) -> None:
        """Visit a part and all inside it, in order; nesting of any depth waits in a list, not on the call stack."""
        self.todo.append(part)
        while self.todo:
            p = self.todo.pop()
            if isinstance(p, str):
                self.visit_text({"text": p})
            elif isinstance(p, list):
                self.todo += reversed(p)
            elif isinstance(p, dict):
                self.dispatch(p)

    def dispatch(self, part: dict) -> None:
        """Call the method of the part's type, as ``image`` or in the form ``image_url`` or ``input_image``."""
        kind = part.get("type")
        kind = kind.removeprefix("input_").removesuffix("_url") if isinstance(kind, str) else ""
        (getattr(self, f"visit_{kind}") if kind in ("text", "image", "audio", "document", "file") else self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        if isinstance(text, str):
            text = safe(text)
            self.out.append(text)
            self.tokens += text_tokens(text)

    def attach(self, kind: str, ref: str | None, tokens: int) -> None:
        n = len(self.attachments) + 1
        self.attachments.append({"ordinal": n, "kind": kind, "ref": ref, "tokens": tokens})
        self.out.append(f"<|{kind} {'' if self.turn is None else self.turn}.{n}|>")
        self.tokens += tokens

    def visit_image(self, part: dict) -> None:
        w, h = _number(part.get("width"), TILE), _number(part.get("height"), TILE)
        tiles = max(1, int(-(-w // TILE))) * max(1, int(-(-h // TILE)))
        self.attach("image", _ref(part, "url", "image_url", "image", "source", "data"), IMAGE_BASE + IMAGE_TILE * tiles)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", _ref(part, "url", "audio_url", "input_audio", "audio", "data"), max(1, int(-(-(_number(part.get("seconds"), 1) * AUDIO_SECOND) // 1))))

    def visit_document(self, part: dict) -> None:
        """A document with content is its placeholder followed by its own parts; else its pages count."""
        inner = part.get("content")
        ref = _ref(part, "url", "document_url", "file", "source", "data", "title")
        if isinstance(inner, (list, str)) and inner:
            self.attach("document", ref, 0)
            self.todo.append(inner)
        else:
            self.attach("document", ref, DOCUMENT_PAGE * max(1, int(_number(part.get("pages"), 1))))

    visit_file = visit_document

    def visit_other(self, part: dict) -> None:
        """A part of unknown type keeps its place and its reference, at no tokens."""
        self.attach("unknown", _ref(part, "url", "data"), 0)


def parts_of(text: str | None) -> list:
    """The typed parts in a message: a JSON list of strings and objects with a type, else the text itself."""
    if text is None:
        return []
    if text.lstrip()[:1] == "[":
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, list) and found and all(isinstance(p, str) or isinstance(p, dict) and "type" in p for p in found) and any(isinstance(p, dict) for p in found):
            return found
    return [text]


def flatten(text: str | None, turn: int | None) -> Flattener:
    v = Flattener(turn)
    for p in parts_of(text):
        v.visit(p)
    return v


def _visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
    for batch in batches:
        seen = [flatten(t, n) for t, n in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(["".join(v.out) for v in seen], pa.string()), pa.array([v.attachments for v in seen], kind), pa.array([v.tokens for v in seen], pa.int64())],
            ["conv", "turn", "role", "content", "attachments", "tokens"],
        )


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, formatted, attachments, n_attachments, n_tokens) of each conversation.

    A turn is ``<|role|>``, its flattened content and ``<|end|>``, each on lines of their own.  An
    attachment leaves ``<|kind turn.ordinal|>`` in the content, and (turn, ordinal, kind, ref,
    tokens) in the JSON list ``attachments``, in order.  n_tokens counts a quarter of the
    text's bytes, the expansion of every attachment, and 4 a turn.  A row holds the turns numbered
    4096 * part to 4096 * part + 4095, so a conversation without end is spread over groups; most have part 0 alone.

    Defined results: turns sort by number, null numbers first (in part 0), then by role and content, so
    repeated rows and ties stay as equal turns; a null role is ``unknown``; a null text has no content and an empty
    one is empty; texts of any length are taken whole; a text that isn't a list of parts is one text part; ``<|`` inside text is written ``< |``;
    a lone surrogate becomes U+FFFD; sizes beyond a million count as a million, sizes that aren't numbers as if they weren't there; parts
    nest to any depth that the JSON reader takes, beyond it the text is one text part; a row with a null conversation is a conversation of its own; an empty table gives an
    empty table; extra columns are ignored, whatever their names.
    """
    turns = df.select(F.col(quoted(conv_col)).alias("conv"), F.col(quoted(turn_col)).cast("long").alias("turn"), F.coalesce(F.col(quoted(role_col)).cast("string"), F.lit("unknown")).alias("role"), F.col(quoted(text_col)).cast("string").alias("text"))
    conv = turns.schema["conv"].dataType.simpleString()
    seen = turns.mapInArrow(_visit, f"conv {conv}, turn long, role string, content string, attachments {ATTACHMENT}, tokens long")
    seen = seen.withColumn("part", F.floor(F.coalesce("turn", F.lit(0)) / PART_TURNS).cast("long"))
    one = F.struct("turn", "role", "content", "attachments")
    grouped = seen.filter("conv IS NOT NULL").groupBy("conv", "part").agg(F.sort_array(F.collect_list(one)).alias("turns"), F.sum(F.col("tokens") + TURN_TOKENS).alias("n_tokens"), F.count(F.lit(1)).alias("n_turns"))
    alone = seen.filter("conv IS NULL").select("conv", "part", F.array(one).alias("turns"), (F.col("tokens") + TURN_TOKENS).alias("n_tokens"), F.lit(1).cast("long").alias("n_turns"))
    line = F.transform("turns", lambda t: F.concat(F.lit("<|"), F.replace(t["role"], F.lit("<|"), F.lit("< |")), F.lit("|>\n"), t["content"], F.lit("\n<|end|>\n")))
    refs = F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["turn"].alias("turn"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return grouped.unionAll(alone).select(F.col("conv").alias("conv_id"), "part", "n_turns", F.array_join(line, "").alias("formatted"), F.to_json(refs).alias("attachments"), F.size(refs).cast("long").alias("n_attachments"), "n_tokens")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted."""
    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


#: For messages that are plain text, as all of the given tables are; the query is tested on typed parts against a brute-force version.
OP4_SQL = f"""
WITH t AS (SELECT conv_id, turn, (floor(coalesce(turn, 0) / {PART_TURNS}))::BIGINT AS part, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, coalesce(replace(text, '<|', '< |'), '') AS content,
           CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations)
SELECT conv_id, part, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || content || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, content) AS formatted,
       '[]' AS attachments, 0::BIGINT AS n_attachments, sum((strlen(content) + {TEXT_BYTES - 1}) // {TEXT_BYTES} + {TURN_TOKENS})::BIGINT AS n_tokens
FROM t GROUP BY conv_id, part, own
"""
