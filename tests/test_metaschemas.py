import json

import pytest

from sievemark.operators.kernel import Evaluator
from sievemark.plans import errors as E
from sievemark.plans.catalog import SchemaCatalog
from sievemark.plans.dialects import URIS
from sievemark.plans.metaschemas import texts
from sievemark.sources import suite

WRONG = [{"type": "text"}, {"minLength": -1}, {"required": "a"}, {"properties": {"a": {"maximum": "1"}}}, {"allOf": []}, {"uniqueItems": 1}, {"multipleOf": 0}]
RIGHT = [{}, True, {"type": ["integer", "null"], "properties": {"a": {"items": {"minimum": 1}}}, "anyOf": [True], "title": "x"}]


@pytest.mark.parametrize("uri", URIS.values())
def test_schemas_of_schemas(uri):
    engine = Evaluator(SchemaCatalog())
    assert all(engine.is_valid(uri, s) for s in RIGHT)
    assert not any(engine.is_valid(uri, s) for s in WRONG)
    assert all(engine.is_valid(d["$schema"].rstrip("#"), d) for d in texts().values())


def test_count_and_use():
    assert len(texts()) == 18
    c = SchemaCatalog(validate_schemas=True)
    u = c.register({"properties": {"schema": {"$ref": URIS["2020-12"]}}}, "https://t.example/s")
    with pytest.raises(E.MetaschemaValidationError):
        c.register({"type": "text"}, "https://t.example/x")
    engine = Evaluator(SchemaCatalog.from_spec(c.spec()))
    assert engine.is_valid(u, {"schema": {"type": "null"}}) and not engine.is_valid(u, {"schema": {"items": {"type": 3}}})
    with pytest.raises(E.DuplicateResourceError):
        c.register({}, URIS["2020-12"])


def test_suite(spark, tmp_path):
    groups = [{"description": "g", "schema": {"$ref": "https://t.example/remote"}, "tests": [{"description": "a", "data": 3, "valid": True}, {"description": "b", "data": 1, "valid": False}]}, {"description": "h", "schema": {"$ref": "#/none"}, "tests": [{"description": "c", "data": 1, "valid": True}]}]
    (tmp_path / "ref.json").write_text(json.dumps(groups))
    found = {r.description: r for r in suite.run(suite.cases(spark, str(tmp_path), URIS["2020-12"]), {"https://t.example/remote": {"minimum": 2}}).collect()}
    assert found["a"].found is True and found["b"].found is False and found["c"].error == "PointerNotFoundError"
