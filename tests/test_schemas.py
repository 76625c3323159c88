"""Payload validation against a plain reading of the rule."""

from __future__ import annotations

import json
import random
import re

from worldlog.operators import schemas

TYPES = {
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
}
FIELDS = [
    ("id", "string", True, None, None), ("n", "integer", False, None, None), ("x", "number", True, None, None), ("on", "boolean", False, None, None),
    ("o", "object", False, None, None), ("l", "array", False, None, None), ("at", "string", False, "iso-datetime", None), ("kind", "string", False, None, ["a", "b"]),
    ("sum", "string", False, "sha256", None), ("g", "object", False, "geojson-geometry", None),
]
GOOD = [{"type": "Point", "coordinates": [1, 2]}, {"type": "Point", "coordinates": [1, 2, 3.5]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}]
BAD = [
    {}, {"type": "Point"}, {"type": "Point", "coordinates": [181, 0]}, {"type": "Point", "coordinates": [1]}, {"type": "Circle", "coordinates": [1, 2]}, {"type": "LineString", "coordinates": [[0, 0]]},
    {"type": "LineString", "coordinates": [[0, 0], [0, 91]]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1]]]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 0]]]},
    {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]], [[0, 0], [1, 0], [1, 1], [0, 0]]]}, {"type": "Polygon", "coordinates": []},
]


def plain(doc):
    if not isinstance(doc, dict):
        return ["payload is not an object"], []
    errors = []
    for name, kind, required, form, enum in FIELDS:
        v = doc.get(name)
        if v is None:
            errors += [f"{name}: required field missing"] if required else []
        elif not TYPES[kind](v):
            errors.append(f"{name}: expected {kind}")
        elif form == "iso-datetime" and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", v):
            errors.append(f"{name}: not a timezone-aware ISO datetime")
        elif form == "sha256" and len(v) != 64:
            errors.append(f"{name}: not a sha256")
        elif form == "geojson-geometry" and v not in GOOD:
            errors.append(f"{name}: invalid geometry")
        elif enum and v not in enum:
            errors.append(f"{name}: '{v}' not in enum")
    return errors, [f"undeclared field present: {k}" for k in sorted(doc) if k not in {f[0] for f in FIELDS} | {"schema_version"}]


def made(draw: random.Random):
    pools = {
        "id": ["a", "", 1, None, ["a"]], "n": [1, 1.0, 2.5, "1", True, 10**25], "x": [1, 1.5, 1e300, "1", False, {}], "on": [True, 0, "true"], "o": [{}, {"id": 1}, [], "o"], "l": [[], [1, {"id": 2}], {}],
        "at": ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+01:00", "2024-01-01T00:00:00", "2024-01-01", "", 5], "kind": ["a", "b", "c", 1], "sum": ["a" * 64, "a" * 63, 64], "g": GOOD + BAD + ["Point"], "more": [1, None], "schema_version": ["1"],
    }
    return {k: draw.choice(v) for k, v in pools.items() if draw.random() < 0.7}


def test_random_documents(spark):
    draw = random.Random(2)
    docs = [made(draw) for _ in range(300)]
    wide = [{"rows": draw.choices([*docs[:40], 5, None, [], "x"], k=draw.randint(0, 4))} for _ in range(60)]
    features = [{"geometry": draw.choice(GOOD + BAD), "properties": draw.choice([*docs[:30], None])} for _ in range(60)]
    collections = [{"type": "FeatureCollection", "features": [*draw.choices(features, k=draw.randint(0, 3)), *draw.choice([[], [7]])]} for _ in range(60)]
    bodies = [("d", d) for d in docs] + [("r", w) for w in wide] + [("g", c) for c in collections] + [("g", {"type": "FeatureCollection"}), ("d", [1]), ("d", "x"), ("r", {"rows": 1}), ("r", []), ("g", {"type": "x"})]
    rows = [(i, s, json.dumps(b)) for i, (s, b) in enumerate(bodies)] + [(-1, "d", None), (-2, "d", '{"id":"a","id":"b"}'), (-3, "d", '{"id'), (-4, "unknown", "{}"), (-5, "d", '{"schema_version":"9"}')]
    known = spark.createDataFrame([(s, "1", k, FIELDS, [], True) for s, k in (("d", "document"), ("r", "rows"), ("g", "geojson"))], schemas.SCHEMA)
    got = {r.payload_id: r for r in schemas.payload_status(spark.createDataFrame(rows, "payload_id long, schema_id string, body string"), known).collect()}
    assert len(got) == len(rows)
    for i, (s, b) in enumerate(bodies):
        none: list[str] = []
        if s == "d":
            want = plain(b) if isinstance(b, dict) else (["payload must be an object"], none)
        elif s == "r":
            ok = isinstance(b, dict) and isinstance(b["rows"], list)
            want = tuple([f"row {n}: {x}" for n, r in enumerate(b["rows"]) for x in plain(r)[side]] for side in (0, 1)) if ok else (["payload must contain rows"], none)
        elif b.get("type") != "FeatureCollection":
            want = (["payload must be a GeoJSON FeatureCollection"], none)
        else:
            want = ([], [])
            for n, f in enumerate(b.get("features", [])):
                if not isinstance(f, dict):
                    want[0].append(f"feature {n}: feature is not an object")
                    continue
                errors, warnings = plain(f["properties"] or {})
                want[0].extend(f"feature {n}: {x}" for x in ([] if f["geometry"] in GOOD else ["invalid geometry"]) + errors)
                want[1].extend(f"feature {n}: {x}" for x in warnings)
        assert (got[i].reasons, got[i].warnings) == (list(want[0]), list(want[1])), (b, got[i])
        assert got[i].status == ("INVALID" if want[0] else "VALID")
    assert [got[i].reasons for i in (-1, -2, -3)] == [["payload is no JSON"]] * 3
    assert got[-4].status == got[-5].status == "UNSUPPORTED_SCHEMA_VERSION"
    assert got[-5].effective == "9"
