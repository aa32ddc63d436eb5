"""Nested records against a plain reader of the same rules."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.operators.nested import Level, Shape, camel, flat_tables, linked, linked_rows, unwrap

SHAPE = Shape(
    (Level("offer", None, "offers", attributes=("id",)), Level("selection", "offer", "selections"), Level("opening_line", "selection", "opening_line", False, ("line", "created")), Level("book", "selection", "books", attributes=("id",))),
    ("data",),
)
TEXTS = [
    '{"offers":[{"a":1}],}', '{"offers":[{"a":1},]}', '{"offers":[{"a" 1}]}', '{"offers":[{"a":1}{"b":2}]}', '{"offers":[{"a":tru}]}', '{"offers":[{"a":01}]}', '{"offers":[{"a":"x\\q"}]}', '{"offers":[{"a":"x\ny"}]}', '{"offers":[{}]} x',
    'x {"offers":[{}]}', '{"offers":[{}]}{}', '{"offers":[{]}}', '{"offers":[{"\\u0073elections":[{}]}]}', "[]", "{}", '[{},null,1,"a",[{}],{"selections":{"books":[[{}],{}]}}]', '{"offers":{"a":"b" "c"}}', '{"offers":{"a"}}', '{"offers":{"a":}}',
    '{"offers":{,}}', '{"offers":[,{}]}', '{"offers":{"a":1 2}}', '{"offers":[{"a":-1.5e+3,"b":null}]}', "null", "1", '"x"', '"', '{"offers":[{}],"offers":[{},{}]}', '{"data":[{}]}', '{"data":{"data":{"offers":[{}]}}}',
    ' {"offers" : [ { "selections" : [ { "openingLine" : { } } ] } ] } ', '{"offers":[{"a":"}]\\"{["}]}', '{"offers":[{"a":NaN}]}', '{"offers":[{"a":"é😀"},{}]}', '{"offers":[{}]]', '"offers":[{}]', '{"offers":{"a":"b":"c"}}', '{"offers":["a":1]}',
    '{1:2,"offers":[{}]}', '{"offers":[{} 1]}', "", "   ", "﻿[{}]", json.dumps('{"offers":[{}]}'), json.dumps(json.dumps([{}])), '"{\\"offers\\":[{}"', "upstream timeout",
]


def plain(text):
    def no(_):
        raise ValueError

    try:
        v = text
        while isinstance(v, str):
            v = json.loads(v.strip(" \t\r\n﻿"), parse_constant=no)
    except ValueError:
        return []
    get = lambda d, k: d.get(k, d.get(camel(k)))
    while isinstance(v, dict) and "offers" not in v and "data" in v:
        v = v["data"]
    out = []

    def each(x, base, node, below):
        for i, y in enumerate(x if isinstance(x, list) else [x]):
            if isinstance(y, dict):
                path = f"{base}.{i}" if base else str(i)
                out.append((node, path))
                below(y, path)

    def selection(s, p):
        if isinstance(get(s, "opening_line"), dict):
            out.append(("opening_line", p))
        each(s.get("books"), p, "book", lambda *_: None)

    each(v.get("offers") if isinstance(v, dict) else v, "", "offer", lambda o, p: each(o.get("selections"), p, "selection", selection))
    return sorted(out)


def rows_of(texts):
    pdf = linked(list(range(len(texts))), texts, SHAPE)
    out = {i: [] for i in range(len(texts))}
    for i, node, path in zip(pdf["id"], pdf["node"], pdf["node_path"]):
        out[i].append((node, path))
    return [sorted(out[i]) for i in range(len(texts))]


def test_cases():
    assert rows_of(TEXTS) == [plain(t) for t in TEXTS]


JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["offers", "selections", "openingLine", "books", "data", "x\"\\", "id"]), x, max_size=3),
    max_leaves=20,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(JSON, min_size=1, max_size=4), st.integers(0, 200), st.booleans())
def test_any_document(values, broken, indent):
    texts = [json.dumps(v, indent=1 if indent else None) for v in values]
    texts.append(texts[0][:broken])
    assert rows_of(texts) == [plain(t) for t in texts]


def test_operator(spark):
    df = spark.createDataFrame(
        [(1, '{"offers":[{"id":"7","selections":{"opening_line":{"line":"1.5","created":null}}}]}', 1, "x"), (1, '{"offers":[{}, {}]}', 0, "y"), (2, None, 0, "z"), (None, "[{}]", 0, "z"), (3, "[{}]", 5, None), (3, "[{}]", 5, None)],
        "record_id long, payload string, at int, node string",
    )  # extra columns may clash with the result's names
    rows = linked_rows(df, "record_id", "payload", SHAPE, "at")
    assert sorted((r.record_id, r.node, r.node_path, r.parent_path) for r in rows.collect()) == [(1, "offer", "0", None), (1, "opening_line", "0.0", "0.0"), (1, "selection", "0.0", "0"), (3, "offer", "0", None)]
    flat = flat_tables(rows, "record_id", SHAPE, {"line": "double"})["opening_line"].collect()
    assert [(r.record_id, r.opening_line_path, r.line, r.created) for r in flat] == [(1, "0.0", 1.5, None)]
    assert linked_rows(df.limit(0), "record_id", "payload", SHAPE).count() == 0


def test_long_and_deep():
    deep = "[" * 300 + "]" * 300
    text = '{"offers":[{"x":"' + "a" * 200_000 + '","y":' + deep + "}]}"
    assert rows_of([text, None]) == [[("offer", "0")], []]


@pytest.mark.parametrize(("text", "inner"), [(None, None), (" ", None), ('"[1]"', "[1]"), ('"', None)])
def test_unwrap(text, inner):
    assert unwrap(text) == inner
