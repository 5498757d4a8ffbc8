"""Documents with semantic elements: a restricted reader, its validation, and canonical form.

Text is Markdown; elements are of the fixed kinds or ``namespace:name`` extensions, written as
``<Kind name="value" …/>`` or ``<Kind …>text</Kind>``. Code, fenced or inline, and comments hold no
elements. Imports, exports, ``{expressions}`` and any other tag are refused: nothing is evaluated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.model import KINDS

MAX_SOURCE, MAX_ELEMENTS, MAX_ATTRIBUTES, MAX_TEXT, MAX_DEPTH, MAX_ID = 4 << 20, 4096, 64, 1 << 20, 64, 256
TEMPORAL = ("occurredAt", "observedAt", "validFrom", "validTo")
# What elements must have, and the values of ``kind``.
REQUIRED = {"Entity": ("ref",), "Tag": ("value",), "State": ("id",), "Event": ("id", "occurredAt"), "Relation": ("id", "from", "to"), "Source": ("id", "ref"), "Extension": ("namespace", "type", "version")}
KIND_VALUES = {
    "Entity": ("person", "place", "organization", "project", "object", "concept"),
    "State": ("status", "preference", "role", "possession", "membership", "location"),
    "Event": ("occurrence", "transition", "decision", "interaction"),
    "Relation": ("causal", "supports", "contradicts", "part-of", "member-of", "located-in", "associated-with"),
}
NODE_ID = re.compile(r"[A-Za-z][A-Za-z0-9_.:-]*\Z")
ENTITY = re.compile(r"[a-z][a-z0-9-]{0,63}:[^\s:\x00-\x1f\x7f]{1,384}\Z")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9.:_-]*")
_ATTRIBUTE = re.compile(r"""\s*([A-Za-z_][\w:.-]*)\s*=\s*("([^"]*)"|'([^']*)'|(\{)|)""")
_CODE = re.compile(r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t\r]*$|\Z)|(`+)(?!`).+?(?<!`)\2(?!`)|<!--.*?-->")
_DATE = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d))?)?)?\Z")


class MarkupError(ValueError):
    """A document that isn't of the profile; ``code`` says why."""

    def __init__(self, code: str, message: str, at: int = 0) -> None:
        super().__init__(f"{code}: {message}")
        self.code, self.at = code, at


@dataclass
class Element:
    kind: str
    attributes: list[tuple[str, str]]
    start: int
    end: int = 0
    depth: int = 0
    open_end: int = 0
    text: str = ""
    spans: dict[str, tuple[int, int]] = field(default_factory=dict)

    def get(self, name: str) -> str | None:
        return dict(self.attributes).get(name)


def is_entity(ref: str) -> bool:
    return len(ref.encode()) <= 512 and bool(ENTITY.match(ref))


def date_key(raw: str) -> tuple[int, int, int, int] | None:
    """What a partial date is ordered by; None if it is none."""
    m = _DATE.match(raw)
    if not m:
        return None
    year, month, day = int(m[1]), int(m[2] or 1), int(m[3] or 1)
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    last = {4: 30, 6: 30, 9: 30, 11: 30, 2: 29 if leap else 28}.get(month, 31)
    if not (1 <= month <= 12 and 1 <= day <= last and year):
        return None
    return year, month, day, 1 + bool(m[2]) + bool(m[3]) + bool(m[4])


def _masked(source: str) -> str:
    """The source with code and comments blanked out: positions stay."""
    return _CODE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def elements(source: str) -> list[Element]:
    """The elements of a document, in the order in which they begin."""
    if len(source.encode("utf-8", "surrogatepass")) > MAX_SOURCE:
        raise MarkupError("ResourceLimit", "source")
    text = _masked(source)
    if m := re.search(r"(?m)^(import|export)\b", text):
        raise MarkupError("ForbiddenDirective", m[1], m.start())
    found: list[Element] = []
    stack: list[Element] = []
    at = 0
    while (m := re.compile(r"[<{]").search(text, at)) is not None:
        here = m.start()
        if m[0] == "{":
            raise MarkupError("ExecutableSyntax", "expression", here)
        closing = text.startswith("</", here)
        name = _NAME.match(text, here + 1 + closing)
        if not name:
            if text.startswith("<>", here) or text.startswith("<!", here) or text.startswith("<?", here):
                raise MarkupError("MalformedElement", "tag", here)
            at = here + 1  # a less-than sign
            continue
        kind = name[0] if name[0] in KINDS else "Extension" if ":" in name[0] else None
        if kind is None:
            raise MarkupError("UnsupportedRuntimeComponent" if name[0][0].isupper() else "RawHtml", name[0], here)
        at = name.end()
        if closing:
            end = re.compile(r"\s*>").match(text, at)
            if not end or not stack or stack[-1].kind != kind:
                raise MarkupError("MalformedElement", f"</{name[0]}>", here)
            top = stack.pop()
            top.text, top.end = source[top.open_end : here], end.end()
            at = end.end()
            continue
        new = Element(kind, [], here, depth=len(stack))
        while a := _ATTRIBUTE.match(source, at):
            if a[5]:
                raise MarkupError("ExecutableSyntax", a[1], here)
            if not a[2]:
                raise MarkupError("MalformedElement", f"attribute {a[1]}", here)
            group = 3 if a[3] is not None else 4
            new.attributes.append((a[1], a[group]))
            new.spans[a[1]] = a.span(group)
            at = a.end()
        end = re.compile(r"\s*(/?)>").match(source, at)
        if not end:
            raise MarkupError("MalformedElement", name[0], here)
        new.open_end = new.end = at = end.end()
        found.append(new)
        if not end[1]:
            if len(stack) >= MAX_DEPTH:
                raise MarkupError("ResourceLimit", "depth", here)
            stack.append(new)
    if stack:
        raise MarkupError("MalformedElement", f"<{stack[-1].kind}> isn't closed", stack[-1].start)
    return found


def validate(found: list[Element]) -> None:
    """Raise unless the elements are of the profile."""
    if len(found) > MAX_ELEMENTS:
        raise MarkupError("ResourceLimit", "elements")
    ids: set[str] = set()
    for e in found:
        have = dict(e.attributes)
        if len(e.attributes) > MAX_ATTRIBUTES or len(e.text.encode("utf-8", "surrogatepass")) > MAX_TEXT:
            raise MarkupError("ResourceLimit", e.kind, e.start)
        if len(have) != len(e.attributes):
            raise MarkupError("MalformedElement", "an attribute twice", e.start)
        for name in REQUIRED.get(e.kind, ()):
            if name not in have:
                raise MarkupError("MissingAttribute", f"{e.kind} {name}", e.start)
        if (own := have.get("id")) is not None:
            if len(own) > MAX_ID or not NODE_ID.match(own):
                raise MarkupError("InvalidNodeId", own, e.start)
            if own in ids:
                raise MarkupError("DuplicateNodeId", own, e.start)
            ids.add(own)
        if (value := have.get("kind")) is not None and value not in KIND_VALUES.get(e.kind, ()):
            raise MarkupError("UnknownKind", value, e.start)
        for name in ("ref",) * (e.kind == "Entity") + ("about", "speaker"):
            if name in have and not is_entity(have[name]):
                raise MarkupError("InvalidEntityRef", have[name], e.start)
        if e.kind == "Extension" and not (re.match(r"[a-z0-9-]+(\.[a-z0-9-]+)+\Z", have["namespace"]) and re.match(r"[\w.-]+\Z", have["type"]) and re.match(r"\d{1,9}\Z", have["version"])):
            raise MarkupError("InvalidExtension", have["namespace"], e.start)
        keys = {}
        for name in TEMPORAL:
            if name in have:
                keys[name] = date_key(have[name])
                if keys[name] is None:
                    raise MarkupError("InvalidTemporalValue", have[name], e.start)
        if "validFrom" in keys and "validTo" in keys and keys["validTo"] < keys["validFrom"]:
            raise MarkupError("InvalidTemporalOrder", e.kind, e.start)
    for e in found:
        refs = [e.get("from"), e.get("to")] if e.kind == "Relation" else [e.get("source")] if e.kind == "Quote" and (e.get("source") or "").startswith("#") else []
        for ref in refs:
            if ref is None or not ref.startswith("#") or ref[1:] not in ids:
                raise MarkupError("InvalidReference", str(ref), e.start)


def canonical(text: str) -> str:
    """Comments and tags out, line ends unified, blanks at line ends and repeated or final empty lines gone."""
    plain = re.sub(r"(?s)<!--.*?-->", "", text)
    plain = re.sub(r"""<(?:[^>"']|"[^"]*"|'[^']*')*>""", "", plain).replace("\r\n", "\n").replace("\r", "\n")
    lines: list[str] = []
    for line in plain.split("\n"):
        line = line.rstrip(" \t")
        if line or not lines or lines[-1]:
            lines.append(line)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def compiled(source: str) -> dict:
    """A document's intermediate form: its hierarchy text, nodes, and semantic hash; or the code of what is wrong."""
    try:
        found = elements(source)
        validate(found)
    except MarkupError as e:
        return {"error": e.code, "hierarchy": None, "nodes": [], "semantic_hash": None}
    outside, at = [], 0
    for e in found:
        if e.start >= at:
            outside.append(source[at : e.start])
        at = max(at, e.end)
    outside.append(source[at:])
    hierarchy = canonical("".join(outside))
    digest = hashlib.sha256(b"ir-v1\0")
    part = lambda s: digest.update(len(s.encode("utf-8", "surrogatepass")).to_bytes(4, "big") + s.encode("utf-8", "surrogatepass"))
    part(hierarchy)
    nodes = []
    for e in found:
        attributes = sorted(e.attributes)
        text = canonical(e.text)
        for s in (e.kind, e.get("id") or "", *(x for a in attributes for x in a), text, str(len(attributes))):
            part(s)
        nodes.append({"kind": e.kind, "id": e.get("id"), "attributes": dict(attributes), "text": text, "start": e.start, "end": e.end, "depth": e.depth})
    return {"error": None, "hierarchy": hierarchy, "nodes": nodes, "semantic_hash": digest.hexdigest()}


IR = "struct<error:string,hierarchy:string,nodes:array<struct<kind:string,id:string,attributes:map<string,string>,text:string,start:int,end:int,depth:int>>,semantic_hash:string>"


def compile_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and ``ir``, the intermediate form of each text; one Arrow batch at a time. Null texts give null."""

    @F.pandas_udf(IR)
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = [compiled(t) if t is not None else {"error": None, "hierarchy": None, "nodes": [], "semantic_hash": None} for t in texts]
            yield pd.DataFrame(rows, columns=["error", "hierarchy", "nodes", "semantic_hash"])

    return df.withColumn("ir", F.when(F.col(text_col).isNotNull(), read(F.col(text_col))))


def rewrite_references(source: str, ids: dict[str, str]) -> tuple[str, list[str]]:
    """Replace the targets of parsed MemoryRef elements by their new ids; those that have none are told."""
    edits, unknown = [], []
    for e in elements(source):
        if e.kind == "MemoryRef":
            name = next((n for n in ("ref", "memory", "target") if e.get(n) is not None), None)
            if name is not None and e.get(name) in ids:
                edits.append((*e.spans[name], ids[e.get(name)]))
            elif name is not None:
                unknown.append(e.get(name))
    return apply_edits(source, edits), unknown


def referenced(source: str) -> list[str]:
    """The targets of the parsed MemoryRef elements, each once."""
    names = (next((e.get(n) for n in ("ref", "memory", "target") if e.get(n) is not None), None) for e in elements(source) if e.kind == "MemoryRef")
    return sorted({n for n in names if n is not None})


def rewrite_all(df: DataFrame, ids: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with the references of its documents rewritten, and ``unknown``, the targets that ``ids`` (old, new) doesn't have.

    The targets of each document are joined with the table of ids, so that none but a document's own
    entries reach it. Null texts stay; documents that can't be read stay as they are, with null.
    """

    @F.pandas_udf("array<string>")
    def targets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: _or_none(referenced, t) or [])

    @F.pandas_udf("text string, unknown array<string>")
    def written(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, pairs in parts:
            found = [_or_none(rewrite_references, t, {p["old"]: p["new"] for p in own}) if t is not None else None for t, own in zip(texts, pairs)]
            yield pd.DataFrame([(t, None) if f is None else f for t, f in zip(texts, found)], columns=["text", "unknown"])

    wanted = df.select(key, F.explode(targets(F.col(text_col))).alias("old")).join(ids.select("old", "new"), "old")
    own = wanted.groupBy(key).agg(F.collect_list(F.struct("old", "new")).alias("_ids"))  # a document's own
    joined = df.join(own, key, "left").withColumn("_ids", F.coalesce("_ids", F.array().cast("array<struct<old:string,new:string>>")))
    out = joined.withColumn("_out", written(F.col(text_col), F.col("_ids")))
    return out.select(*(F.col("_out.text").alias(c) if c == text_col else F.col(c) for c in df.columns), F.col("_out.unknown").alias("unknown"))


def _or_none(read, source: str | None, *more):
    try:
        return None if source is None else read(source, *more)
    except MarkupError:
        return None


def apply_edits(source: str, edits: list[tuple[int, int, str]]) -> str:
    """Edits of the original's spans, from right to left; they mustn't overlap."""
    edits = sorted(edits)
    for a, b in zip(edits, edits[1:]):
        if b[0] < a[1]:
            raise MarkupError("OverlappingEdits", f"{a[:2]} {b[:2]}", b[0])
    for start, end, text in reversed(edits):
        source = source[:start] + text + source[end:]
    return source
