"""Typed changes of a document: each finds the spans to edit, and the result is validated again."""

from __future__ import annotations

from stratalens.operators.markup import Element, MarkupError, apply_edits, elements, validate


def _escaped(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")


def _node(found: list[Element], node: str) -> Element:
    for e in found:
        if e.get("id") == node:
            return e
    raise MarkupError("UnknownNode", node)


def _set(e: Element, source: str, name: str, value: str) -> tuple[int, int, str]:
    if name in e.spans:
        return (*e.spans[name], _escaped(value))
    close = e.open_end - (2 if source[: e.open_end].endswith("/>") else 1)
    return close, close, f' {name}="{_escaped(value)}"'


def tag(value: str) -> str:
    return f'<Tag value="{_escaped(value)}" />'


def patch(source: str, *changes: tuple) -> str:
    """Apply changes, each a tuple of its name and arguments:

    ("set_attribute", node, name, value), ("remove_attribute", node, name), ("set_text", node, text),
    ("add_tag", value), ("remove_tag", value), ("append", markup), ("remove_node", node),
    ("close_state", node, instant), ("transition", node, instant, markup of the new state),
    ("correct_event", node, instant).
    """
    found, edits = elements(source), []
    for name, *args in changes:
        if name == "set_attribute":
            edits.append(_set(_node(found, args[0]), source, *args[1:]))
        elif name == "remove_attribute":
            e = _node(found, args[0])
            start, end = e.spans[args[1]]
            edits.append((source.rindex(args[1], e.start, start), end + 1, ""))
        elif name == "set_text":
            e = _node(found, args[0])
            close = source.rindex("</", e.open_end, e.end) if e.end > e.open_end else None
            if close is None:
                raise MarkupError("MalformedElement", "it has no text", e.start)
            edits.append((e.open_end, close, args[1]))
        elif name == "add_tag":
            if not any(e.kind == "Tag" and e.get("value") == args[0] for e in found):
                edits.append((len(source), len(source), "\n" * (not source.endswith("\n")) + tag(args[0]) + "\n"))
        elif name == "remove_tag":
            edits += [(e.start, e.end, "") for e in found if e.kind == "Tag" and e.get("value") == args[0]]
        elif name == "append":
            edits.append((len(source), len(source), "\n" * (not source.endswith("\n")) + args[0] + "\n"))
        elif name == "remove_node":
            e = _node(found, args[0])
            edits.append((e.start, e.end, ""))
        elif name in ("close_state", "transition"):
            e = _node(found, args[0])
            if e.kind != "State":
                raise MarkupError("UnknownKind", e.kind, e.start)
            edits.append(_set(e, source, "validTo", args[1]))
            if name == "transition":
                (new,) = elements(args[2])
                if new.kind != "State":
                    raise MarkupError("UnknownKind", new.kind)
                edits.append((e.end, e.end, "\n" + apply_edits(args[2], [_set(new, args[2], "validFrom", args[1])])))
        elif name == "correct_event":
            edits.append(_set(_node(found, args[0]), source, "occurredAt", args[1]))
        else:
            raise MarkupError("UnknownPatch", name)
    out = apply_edits(source, edits)
    validate(elements(out))
    return out
