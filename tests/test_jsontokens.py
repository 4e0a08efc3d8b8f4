from __future__ import annotations

import pyarrow as pa

from changeflow.functions import jsontokens


def test_numbers_of_a_batch_with_their_paths():
    texts = [
        r'{"a":1,"b":[1,{"c":"3 "}],"d":{"":5,"e":[[],"x",true,null,-0]}}',
        '["2\\\\n","3\\\\t","1e400",1e400,-0.0,-0e0,1E5]'.replace("\\\\", "\\"),
        None,
        "[" * 3000 + "7" + "]" * 3000,
        r'{"k\"x\ud800":{"y":"9"}}',
    ]
    first, second, none, deep, quoted = jsontokens.number_lists(pa.array(texts)).to_pylist()
    assert [(x["path"], x["last"], x["number"]) for x in first] == [
        ("a", "a", 1.0), ("b.0", "0", 1.0), ("b.1.c", "c", 3.0), ("d.", "", 5.0), ("d.e.4", "4", 0.0),
    ]
    assert [repr(x["number"]) for x in second] == ["2.0", "inf", "0.0", "-0.0", "100000.0"]
    assert none == [] and deep[0]["path"].count(".") == 2999
    assert [(x["path"], x["number"]) for x in quoted] == [('k"x?.y', 9.0)]


def test_a_batch_without_numbers_keeps_its_rows():
    assert jsontokens.number_lists(pa.array([None, "{}", '["x"]'])).to_pylist() == [[], [], []]
