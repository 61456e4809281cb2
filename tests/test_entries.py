"""Structured entries against a nested schema."""

from conftest import rows
from weft.operators import entries

SCHEMA = [
    ("", "object", True, None),
    ("title", "string", True, None),
    ("width", "number", False, None),
    ("steps", "array", True, None),
    ("steps[]", "object", False, None),
    ("steps[].action", "string", True, ["click", "fill"]),
    ("steps[].to", "object", False, None),
    ("steps[].to.x", "number", True, None),
    ("steps[].tags", "array", False, None),
    ("steps[].tags[]", "string", False, None),
]


def test_errors_have_full_paths(spark):
    good = '{"title": "a", "width": 3, "steps": [{"action": "click", "to": {"x": 1.5}, "tags": ["t"]}, {"action": "fill"}]}'
    bad = '{"title": 7, "width": null, "extra": {"deep": 1}, "steps": [{"action": "jump", "to": {}}, 5, {"tags": ["t", true]}]}'
    data = [(1, good), (2, bad), (3, "{no"), (4, None), (5, "[]"), (6, "{}"), (7, '{"title": "x", "steps": []}')]
    schema = spark.createDataFrame(SCHEMA, "pattern string, kind string, required boolean, choices array<string>")
    got = rows(entries.entry_errors(spark.createDataFrame(data, "id long, text string"), schema))
    assert got == sorted(
        [
            (2, "title", "kind"),
            (2, "extra", "unknown"),
            (2, "steps[0].action", "choice"),
            (2, "steps[0].to.x", "missing"),
            (2, "steps[1]", "kind"),
            (2, "steps[2].action", "missing"),
            (2, "steps[2].tags[1]", "kind"),
            (3, "", "not JSON"),
            (4, "", "not JSON"),
            (5, "", "kind"),
            (6, "title", "missing"),
            (6, "steps", "missing"),
        ],
        key=repr,
    )
    assert entries.entry_errors(spark.createDataFrame(data, "id long, text string").where("false"), schema).isEmpty()
