import itertools

import pytest
from pyspark.sql import types as T

from tidewheel.schema import ALIASES, is_metric, parse_schema, result_kind, zero

ORDER = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]
OTHER = [T.StringType(), T.BooleanType(), T.DecimalType(38, 0), T.ArrayType(T.LongType()), T.MapType(T.StringType(), T.LongType())]


def test_every_type_name():
    for style in (str.lower, str.upper, str.title):
        text = ", ".join(f"c{i} : {style(name)}" for i, name in enumerate(ALIASES))
        assert [f.dataType for f in parse_schema(f"{style('row')}<{text}>")] == list(ALIASES.values())
    kinds = {"port:smallint": T.ShortType(), "tags:vector<varchar>": T.ArrayType(T.StringType()), "sizes:dictionary<char,real>": T.MapType(T.ByteType(), T.FloatType()), "geo.lat-lon:double": T.DoubleType()}
    assert {f"{f.name}": f.dataType for f in parse_schema(f"struct<{','.join(kinds)}>")} == {k.split(":")[0]: v for k, v in kinds.items()}


@pytest.mark.parametrize("bad", ["", "row", "bigint", "row<", "row<x>", "row<x:>", "row<x:bigint", "row<x:number>", "row<x:bigint y:int>", "row<x:row<y:bigint>>", "row<x:real,x:real>", "row<x:real>>", "row<x:map<int>>", "row<x:array<map<int,int>>>", "row<?:int>"])
def test_bad_schemas(bad):
    with pytest.raises(ValueError):
        parse_schema(bad)


def test_result_kinds():
    """Of any two numeric kinds the wider one, in either order; nothing else has arithmetic."""
    for (i, a), (j, b) in itertools.product(enumerate(ORDER), repeat=2):
        assert result_kind(a, b) == ORDER[max(i, j)]
    for a, b in itertools.product(ORDER + OTHER, OTHER):
        for pair in ((a, b), (b, a)):
            with pytest.raises(TypeError):
                result_kind(*pair)


def test_zero_and_metrics():
    for kind in ORDER:
        assert zero(kind) == 0 and type(zero(kind)) is (float if isinstance(kind, T.FloatType | T.DoubleType) else int) and is_metric(kind)
    assert [zero(k) for k in OTHER] == ["", False, 0, None, None]
    assert [is_metric(k) for k in OTHER] == [False, True, True, False, False]
