import pytest

from stratalens.operators import diff, markup, patches, projections
from stratalens.operators.markup import MarkupError, canonical, compiled, date_key, elements, is_entity, rewrite_references

GOOD = """# Title

<Entity id="p" ref="person:ann">Ann</Entity> lives here. 1 < 2 `<b>{x}</b>`
<State id="s" kind="status" about="person:ann" validFrom="2024-02">well</State>
<!-- <Tag value="hidden" /> -->
```
<Tag value="in code" />
```
<Tag value="Old  Town" />
<Relation id="r" from="#p" to="#s" kind="supports" />
"""


def error(source):
    return compiled(source)["error"]


def test_reads_elements_outside_code_and_comments():
    found = elements(GOOD)
    assert [e.kind for e in found] == ["Entity", "State", "Tag", "Relation"]
    assert found[0].text == "Ann" and found[2].get("value") == "Old  Town"
    ir = compiled(GOOD)
    assert ir["error"] is None and "lives here" in ir["hierarchy"] and "hidden" not in ir["hierarchy"]


@pytest.mark.parametrize(
    ("source", "code"),
    [
        ("import x from 'y'", "ForbiddenDirective"), ("a {1 + 1} b", "ExecutableSyntax"), ("<div>x</div>", "RawHtml"), ("<Widget />", "UnsupportedRuntimeComponent"), ('<Tag value={x} />', "ExecutableSyntax"),
        ("<Tag />", "MissingAttribute"), ('<Tag value="a" value="b" />', "MalformedElement"), ('<State>x</State>', "MissingAttribute"), ('<State id="1x">x</State>', "InvalidNodeId"), ('<State id="a">x', "MalformedElement"),
        ('<State id="a" /><State id="a" />', "DuplicateNodeId"), ('<State id="a" kind="mood" />', "UnknownKind"), ('<Entity ref="Ann" />', "InvalidEntityRef"), ('<Event id="e" occurredAt="2023-02-30" />', "InvalidTemporalValue"),
        ('<State id="a" validFrom="2024" validTo="2023" />', "InvalidTemporalOrder"), ('<Relation id="r" from="#x" to="#r" />', "InvalidReference"), ("</Tag>", "MalformedElement"), ("<!DOCTYPE html>", "MalformedElement"),
    ],
)
def test_refuses(source, code):
    assert error(source) == code


def test_entities_and_dates():
    assert is_entity("person:ann") and is_entity("a-1:x/y") and not any(map(is_entity, ["ann", ":x", "a:", "A:b", "a:b c", "a:b:c", "1a:b", "a" * 65 + ":b"]))
    assert date_key("2024") < date_key("2024-01") < date_key("2024-01-01") and date_key("2024-02-29T10:00Z")
    assert [date_key(x) for x in ("2023-02-29", "2024-13", "24", "2024-01-01T10:00", "0000")] == [None] * 5


def test_canonical_form_and_hash():
    assert canonical("a  \r\n\r\n\r\n\nb<!-- c -->\n\n") == "a\n\nb"
    same = GOOD.replace("\n", "\r\n").replace("<!-- <Tag", "<!-- other <Tag")
    assert compiled(GOOD)["semantic_hash"] == compiled(same)["semantic_hash"] != compiled(GOOD.replace("well", "ill"))["semantic_hash"]


def test_patches():
    out = patches.patch(GOOD, ("transition", "s", "2025", '<State id="s2" kind="status">ill</State>'), ("add_tag", 'new "one"'), ("remove_tag", "Old  Town"), ("set_text", "p", "Anna"))
    by = {e.get("id"): e for e in elements(out)}
    assert by["s"].get("validTo") == "2025" == by["s2"].get("validFrom") and by["p"].text == "Anna"
    assert [e.get("value") for e in elements(out) if e.kind == "Tag"] == ["new &quot;one&quot;"]
    with pytest.raises(MarkupError):
        patches.patch(GOOD, ("set_text", "p", "a"), ("remove_node", "p"))
    with pytest.raises(MarkupError):
        patches.patch(GOOD, ("remove_node", "p"))  # a relation needs it


def test_references_are_rewritten_only_where_parsed():
    text = '<MemoryRef ref="1" /> `<MemoryRef ref="1" />` <!-- <MemoryRef ref="1" /> --> ref="1" <MemoryRef ref="9" />'
    out, unknown = rewrite_references(text, {"1": "77"})
    assert out == text.replace('<MemoryRef ref="1" />', '<MemoryRef ref="77" />', 1) and unknown == ["9"]


def changed(spark, old, new):
    frames = [markup.compile_documents(spark.createDataFrame([(1, t)], "k long, text string")).select("k", "ir") for t in (old, new)]
    d = diff.semantic_diff(*frames, "k")
    return {(r.node_id, r.category) for r in d.collect()}, {r.projection for r in diff.rebuilds(d, "k").collect()}


def test_diff_matrix(spark):
    assert changed(spark, GOOD, GOOD + "\n\n") == (set(), set())
    cats, builds = changed(spark, GOOD, GOOD.replace('validFrom="2024-02"', 'validFrom="2024-02" validTo="2025"'))
    assert cats == {("s", "Temporal")} and builds == {"Ir", "Temporal", "RerankView"}
    cats, builds = changed(spark, GOOD, GOOD.replace(">Ann<", ">Anna<"))
    assert cats == {("p", "VisibleText"), ("p", "EntitySurface")} and {"LocalEmbedding", "EntityObservations"} <= builds
    cats, builds = changed(spark, GOOD, GOOD.replace("person:ann", "person:bob"))
    assert cats == {("p", "EntityBinding"), ("s", "EntityBinding")} and "ContextEmbedding" in builds and "LocalEmbedding" not in builds
    cats, _ = changed(spark, GOOD, GOOD.replace("Old  Town", "New"))
    assert cats == {(None, "SemanticNodeLifecycle"), (None, "ExplicitTag")}


def test_projections(spark):
    df = markup.compile_documents(spark.createDataFrame([(1, GOOD), (2, "<b>"), (3, None)], "k long, text string"))
    (row,) = projections.serving(df.where("k < 3")).collect()
    assert row.tags == ["Old  Town"] and row.entity_refs == ["person:ann"] and row.relations == ["supports"] and row.node_ids == ["p", "s", "r"]
    assert {(r.kind, r.node_id) for r in projections.structure(df, "k").collect()} >= {("Entity", "p"), ("Relation", "r")}
    assert [tuple(r) for r in projections.relations(df, "k").select("from_id", "to_id", "kind").collect()] == [("p", "s", "supports")]
    nested = markup.compile_documents(spark.createDataFrame([(1, '<State id="a"><Tag value="x" /> you said</State>')], "k long, text string"))
    assert projections.explicit_tags(nested, "k").first().scope_id == "a"
    assert projections.lint(nested, "k").first().words == ["you"]
    assert df.where("k = 3").select(projections.local_text().alias("t")).first().t in (None, "")
