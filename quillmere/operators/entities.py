"""Entity matching, association scores and lookups."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from .tables import map_rows

MATCHES = "chunk_id string, entity_id string, name string, display_name string, entity_type string, frequency int, positions array<int>, spans array<struct<start:int,stop:int>>, chunk_length int"


@dataclass(frozen=True)
class Entity:
    id: str
    name: str
    display_name: str
    type: str = "concept"
    aliases: tuple[str, ...] = ()


def entity_id(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def read_vocabulary(text: str, is_json: bool) -> list[Entity]:
    """Entities from a JSON list of objects, or from lines with a display name each."""
    if not is_json:
        names = (x.strip() for x in text.splitlines())
        return [Entity(entity_id(n), n.lower(), n) for n in names if n and not n.startswith("#")]
    out = []
    for o in json.loads(text):
        name, shown = o.get("name", o.get("display_name", "")), o.get("display_name", o.get("name", ""))
        out.append(Entity(o.get("id", entity_id(name)), name.lower(), shown, o.get("type", o.get("entity_type", "concept")), tuple(o.get("aliases", ()))))
    return out


def humps(before: str) -> re.Pattern:
    """Where a camel-case name is cut: before a capital after one of ``before``, and before the last capital of a run."""
    return re.compile("|".join(f"(?<=[{a}])(?={b})" for a, b in ((before, "[A-Z]"), ("A-Z", "[A-Z][a-z]"))))


def schema_term(term: str, singular: bool = False) -> str:
    s = " ".join(humps("a-z").sub(" ", term).translate(str.maketrans("_-", "  ")).split()).lower()
    return s[:-1] if singular and s.endswith("s") else s


def term_variants(term: str) -> set[str]:
    """Surfaces of a schema term: words, singular, joined, and with underscores if it has any."""
    forms = {schema_term(term), schema_term(term, True)}
    forms |= {f.replace(" ", "") for f in forms} | ({term.lower()} if "_" in term else set())
    return {f for f in forms if len(f) > 1}


@dataclass
class Matcher:
    """Surfaces of entities, found where no letter or digit adjoins them.

    One pass of an Aho-Corasick automaton finds all surfaces, however many there are.
    """

    surfaces: dict[str, str] = field(default_factory=dict)
    entities: dict[str, Entity] = field(default_factory=dict)
    fold: bool = True
    distinct_spans: bool = False

    @classmethod
    def vocabulary(cls, entities: Sequence[Entity], mode: str = "case_insensitive", least: int = 2) -> Matcher:
        """The later of two entities keeps a surface that both have; spans found twice count twice."""
        m = cls(fold=mode != "exact")
        for e in entities:
            m.entities[e.id] = e
            for s in (e.name, e.display_name, *e.aliases):
                if len(s) >= least:
                    m.surfaces[s.lower() if m.fold else s] = e.id
        return m

    @classmethod
    def schema(cls, schema: Sequence[str] = (), api: Sequence[str] = (), business: Sequence[str] = ()) -> Matcher:
        """The first of two terms keeps a surface; a span counts once."""
        m = cls(distinct_spans=True)
        for terms, kind in ((schema, "schema"), (api, "api"), (business, "term")):
            for t in terms:
                name = schema_term(t, True)
                m.entities[entity_id(name)] = Entity(entity_id(name), name, t, kind)
                for v in sorted(term_variants(t)):
                    m.surfaces.setdefault(v, entity_id(name))
        return m

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for s, e in self.surfaces.items():
            a.add_word(s, (len(s), e))
        if len(a):
            a.make_automaton()
        return a

    def find(self, text: str, automaton=None) -> dict[str, list[tuple[int, int]]]:
        """Sorted spans by entity."""
        a = self.automaton() if automaton is None else automaton
        text = text.lower() if self.fold else text
        out: dict[str, list[tuple[int, int]]] = {}
        for last, (n, e) in a.iter(text) if len(a) else ():
            start, stop = last + 1 - n, last + 1
            if (start and text[start - 1].isalnum()) or (stop < len(text) and text[stop].isalnum()):
                continue
            out.setdefault(e, []).append((start, stop))
        return {e: sorted(set(s) if self.distinct_spans else s) for e, s in out.items()}


def match_entities(chunks: DataFrame, matcher: Matcher, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """One row for each chunk and entity found in it.  Null texts have none."""
    slim = chunks.select(F.col(id_col).cast("string").alias("chunk_id"), F.col(text_col).alias("text"))

    def make() -> Callable[..., Iterator[tuple]]:
        a = matcher.automaton()

        def found(cid: str, text: str | None) -> Iterator[tuple]:
            for e, spans in (matcher.find(text, a) if text else {}).items():
                x = matcher.entities[e]
                yield cid, e, x.name, x.display_name, x.type, len(spans), [s for s, _ in spans], [{"start": s, "stop": t} for s, t in spans], max(len(text), 1)

        return found

    return map_rows(slim, make, MATCHES)


def model_entities(chunks: DataFrame, ner: Callable[[str], list[tuple[str, str, int, int]]], labels: Sequence[str] | None = None, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """Matches of an injected recogniser that gives (surface, label, start, stop); numbers alone are dropped."""
    slim = chunks.select(F.col(id_col).cast("string").alias("chunk_id"), F.col(text_col).alias("text"))

    def found(cid: str, text: str | None) -> Iterator[tuple]:
        by: dict[str, tuple] = {}
        for surface, label, s, t in ner(text) if text else ():
            key = canonical_key(surface)
            if not key or re.fullmatch(r"[\d\s.,%-]+", key) or (labels is not None and label not in labels):
                continue
            by.setdefault(entity_id(key), (key, surface, label.lower(), []))[3].append((s, t))
        for e, (name, shown, label, spans) in by.items():
            spans.sort()
            yield cid, e, name, shown, label, len(spans), [s for s, _ in spans], [{"start": s, "stop": t} for s, t in spans], max(len(text), 1)

    return map_rows(slim, lambda: found, MATCHES)


EDGE_CHARS = r"""()\[\]{}<>*&^%$#@!+=~`'"\\|/?:;,.—–\-\s"""


def merge_matches(vocab: DataFrame, generic: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Vocabulary and generic matches as one: a generic span that overlaps a vocabulary span goes.

    With ``texts`` (chunk_id, text), marks and blanks at the edges of generic spans are cut
    first.  Matches of one id join; of spans that start together the first stays, vocabulary first.
    """
    flat = lambda d, rank: d.select("chunk_id", "entity_id", "name", "display_name", "entity_type", "chunk_length", F.explode("spans").alias("s")).select("*", F.col("s.start").alias("a"), F.col("s.stop").alias("b"), F.lit(rank).alias("rank")).drop("s")
    known, other = flat(vocab, 0), flat(generic, 1)
    if texts is not None:
        span = F.substr("text", F.col("a") + 1, F.col("b") - F.col("a"))
        left = F.length(F.regexp_extract(span, f"^[{EDGE_CHARS}]*", 0))
        right = F.length(F.regexp_extract(span, f"[{EDGE_CHARS}]*$", 0))
        other = other.join(texts.select("chunk_id", "text"), "chunk_id").withColumns({"a": F.col("a") + left, "b": F.col("b") - right}).filter("a < b").drop("text")
    k = known.select("chunk_id", F.col("a").alias("ka"), F.col("b").alias("kb"))
    kept = other.join(k, (other.chunk_id == k.chunk_id) & (F.col("a") < F.col("kb")) & (F.col("ka") < F.col("b")), "left_anti")
    both = known.union(kept.select(known.columns))
    first = Window.partitionBy("chunk_id", "entity_id", "a").orderBy("rank", "b")
    named = Window.partitionBy("chunk_id", "entity_id").orderBy("rank", "a")
    labels = [F.first(c).over(named).alias(c) for c in ("name", "display_name", "entity_type")]
    one = both.select("chunk_id", "entity_id", *labels, "chunk_length", "a", "b", F.row_number().over(first).alias("n")).filter("n = 1")
    spans = F.sort_array(F.collect_list(F.struct(F.col("a").alias("start"), F.col("b").alias("stop"))))
    grouped = one.groupBy("chunk_id", "entity_id", "name", "display_name", "entity_type").agg(spans.alias("spans"), F.max("chunk_length").alias("chunk_length"))
    return grouped.select("chunk_id", "entity_id", "name", "display_name", "entity_type", F.size("spans").alias("frequency"), F.transform("spans", lambda s: s["start"]).alias("positions"), "spans", "chunk_length")


def ner_pipeline(chunks: DataFrame, schema: Matcher | None = None, data: Matcher | None = None, ner: Callable | None = None) -> DataFrame:
    """Schema terms, then a data vocabulary, then a recogniser, merged in this order of trust."""
    texts = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("content").alias("text"))
    parts = [match_entities(chunks, m) for m in (schema, data) if m] + ([model_entities(chunks, ner)] if ner else [])
    if not parts:
        raise ValueError("no matcher given")
    out = parts[0]
    for p in parts[1:]:
        out = merge_matches(out, p, texts)
    return out


# normal forms of free entity names

INVARIANT = frozenset("agenda criteria data insignia media metadata stamina trivia".split())
HUMP = humps("a-z0-9")
_SAME = re.compile(r"(?:ss|us|is|news|series|species)$", re.I)


def acronym(word: str) -> bool:
    letters = [c for c in word if c.isalpha()]
    return len(letters) > 1 and all(map(str.isupper, letters))


def singular(word: str, keep: frozenset[str] = INVARIANT) -> str:
    """Singular of an English noun by common endings; acronyms and invariants stay."""
    low = word.lower()
    if not word or acronym(word) or low in keep or _SAME.search(low) or not low.endswith("s") or len(low) < 4:
        return word
    for end, new in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zes", "z"), ("s", "")):
        if low.endswith(end):
            return word[: len(word) - len(end)] + new
    return word


def normalize_entity(name: str, keep: frozenset[str] = INVARIANT) -> str:
    """Display form: edge symbols and dots of acronyms off, blanks single, last word singular."""
    s = re.sub(r"^[^\w\s]+|[^\w\s]+$", "", (name or "").strip()).strip()
    dotted = lambda w: re.fullmatch(r"(?:[A-Z0-9]\.){2,}[A-Z0-9]?\.?", w if w.endswith(".") else w + ".")
    s = re.sub(r"\s+", " ", " ".join(w.replace(".", "") if dotted(w) else w for w in s.split(" ")))
    for joiner in (" ", "_", ""):
        words = s.split(joiner) if joiner else HUMP.split(s)
        words = [w for w in words if w]
        if len(words) > 1 or joiner == "":
            return joiner.join(words[:-1] + [singular(words[-1], keep)]) if words else ""
    return s


def canonical_key(name: str) -> str:
    return normalize_entity(name).lower()


@F.pandas_udf(StringType())
def normalize_entity_udf(s: pd.Series) -> pd.Series:
    return s.map(normalize_entity, na_action="ignore")


# associations


def score_associations(matches: DataFrame, n_chunks, weights: Sequence[float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Matches with ``score``: weighted log frequency, closeness to the chunk's start, and rarity of the entity.

    ``n_chunks`` (a number or a one-row column frame ``n``) counts all chunks; document
    frequencies are over all matches, in one pass after indexing.
    """
    wf, wp, ws = weights
    df = matches.groupBy("entity_id").agg(F.count(F.lit(1)).alias("df"))
    whole = n_chunks if isinstance(n_chunks, DataFrame) else matches.sparkSession.range(1).select(F.lit(int(n_chunks)).alias("n"))
    first = F.get("positions", F.lit(0)) if "positions" in matches.columns else F.col("first_position")
    score = wf * F.log1p("frequency") + wp * (1 - first / F.greatest("chunk_length", F.lit(1))) + ws * F.log(F.col("n") / F.col("df"))
    return matches.join(df, "entity_id").crossJoin(whole).withColumn("score", score).drop("n", "df")


def chunks_of_entities(scored: DataFrame, top: int | None = None) -> DataFrame:
    """Chunks of each entity by score, with their ``rank``; ties by chunk id."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("score"), "chunk_id")))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def entities_of_chunks(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("score"), "entity_id")))


def remove_chunks(associations: DataFrame, gone: DataFrame) -> DataFrame:
    return associations.join(gone.select("chunk_id"), "chunk_id", "left_anti")


def unprocessed(chunks: DataFrame, associations: DataFrame) -> DataFrame:
    """Chunks that have no association yet, for incremental matching."""
    return chunks.join(associations.select("chunk_id").distinct(), "chunk_id", "left_anti")


SUFFIXES = ("_identifier", "_number", "_code", "_name", "_key", "_id", "_no")


def suffix_aliases(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(alias, entity_id, source): schema terms without a naming suffix."""
    bare = F.regexp_replace(F.lower(term_col), f"(?:{'|'.join(SUFFIXES)})$", "")
    found = terms.select(F.trim(F.translate(bare, "_", " ")).alias("alias"), F.regexp_replace(F.lower(term_col), "[^a-z0-9]+", "_").alias("entity_id"), (bare != F.lower(term_col)).alias("cut"))
    return found.filter("cut AND alias <> ''").select("alias", "entity_id", F.lit("strip_suffix").alias("source")).distinct()


def ddl_terms(ddl: DataFrame, col: str = "ddl") -> DataFrame:
    """(term) of tables and columns named in CREATE TABLE statements."""
    names = F.regexp_extract_all(F.col(col), F.lit(r'(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?["`\[]?([\w.]+)'), F.lit(1))
    body = F.explode_outer(F.regexp_extract_all(F.col(col), F.lit(r"(?is)create\s+table[^(]*\((.*?)\)\s*(?:;|$)"), F.lit(1)))
    tables = ddl.select(F.explode(names).alias("term"))
    fields = ddl.select(body.alias("b")).select(F.explode(F.regexp_extract_all("b", F.lit(r'(?im)(?:^|,)\s*["`\[]?(\w+)["`\]]?\s+[a-z]'), F.lit(1))).alias("term"))
    words = "primary foreign unique constraint check key index".split()
    return tables.union(fields.filter(~F.lower("term").isin(words))).distinct()


def query_terms(frame: DataFrame, limit: int = 10_000) -> DataFrame:
    """Vocabulary terms of a one-column query: distinct, not null, at most ``limit`` (a part of the operator)."""
    if len(frame.columns) != 1:
        raise ValueError("a vocabulary query has one column")
    c = frame.columns[0]
    return frame.select(F.col(f"`{c}`").cast("string").alias("term")).filter("term IS NOT NULL").distinct().orderBy("term").limit(limit)
