"""The kernel behind its Arrow UDFs: equal texts of a batch are evaluated once, and every row has its own result."""

import pyarrow as pa
import pytest

from sievemark.functions import model
from sievemark.operators import udf
from sievemark.plans.catalog import SchemaCatalog

pytestmark = pytest.mark.usefixtures("spark")
LOOPS = {"$id": "https://t.example/loops", "$defs": {"loop": {"$ref": "#/$defs/loop"}}, "properties": {"next": {"$ref": "#"}, "x": {"$ref": "#/$defs/loop"}, "k": {"maximum": 0}}}
DEEP = '{"next":' * 700 + "{}" + "}" * 700
TEXTS = ['{"k":1}', "{bad", DEEP, '{"x":1}', None, '{"k":0}', "", "null"]


def _kernels():
    c = SchemaCatalog()
    u = c.register(LOOPS)
    return {
        "verdict": udf.verdict_udf(c, u),
        "explained": udf.verdict_udf(c, u, explained=True, once=True),
        "errors": udf.result_udf(c, u, None, None, True, False, False, False),
        "whole": udf.result_udf(c, u, "list", udf.O.EVERYTHING, False, True, True, False, True),
    }


@pytest.mark.parametrize("name", ["verdict", "explained", "errors", "whole"])
def test_equal_texts_once(name, monkeypatch):
    kernel = _kernels()[name].func
    alone = [kernel(pa.array([t], pa.string())).to_pylist()[0] for t in TEXTS]
    parsed, parse = [], model.parse
    monkeypatch.setattr(model, "parse", lambda t: (parsed.append(t), parse(t))[1])
    found = kernel(pa.array([*TEXTS * 50, *TEXTS[::-1]], pa.string()))
    assert found.to_pylist() == alone * 50 + alone[::-1]
    assert sorted(parsed) == sorted(t for t in TEXTS if t is not None)


@pytest.mark.parametrize("name", ["verdict", "explained", "errors", "whole"])
@pytest.mark.parametrize("kind", [pa.string(), pa.null()])
@pytest.mark.parametrize("texts", [[], [None, None]])
def test_no_texts(name, texts, kind):
    found = _kernels()[name].func(pa.array(texts, kind)).to_pylist()
    assert found == [{"valid": None, "engine_error": None} if name == "explained" else None] * len(texts)
