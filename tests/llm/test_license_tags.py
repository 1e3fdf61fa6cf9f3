"""Licence tags with other words after them, and expressions of many alternatives."""

import pytest

pytest.importorskip("foliant.llm.entry")
from foliant.llm import licenses  # noqa: E402

TAG = "SPDX-License-Identifier: "


@pytest.mark.parametrize(
    ("text", "labels", "expressions"),
    [
        (TAG + "MIT and Zlib then other words", "mit,zlib", "mit & zlib"), (TAG + "MIT */ function f(a) { return (a) }", "mit", "mit"), (TAG + "MIT " + TAG + "(Zlib OR X11) end", "mit,x11,zlib", "mit; zlib | x11"),
        (TAG + "Zlib. All of it", "zlib", "zlib"), (TAG + "(A OR B) WITH C", "a,b", "a | b"), (TAG + "GPL-2.0 WITH Classpath\nx", "gpl", "gpl-2.0 with classpath"), (TAG + "(MIT", "unparsed", ""), (TAG + "\nMIT", "unparsed", ""),
    ],
)
def test_longest_expression(text, labels, expressions):
    f = licenses.scan(text.encode())
    assert (f["labels"], f["expressions"]) == (labels, expressions)


def test_many_alternatives():
    f = licenses.scan((TAG + " AND ".join(f"(a{i} OR b{i})" for i in range(9))).encode())
    assert set(f["labels"].split(",")) == {f"{x}{i}" for x in "ab" for i in range(9)}
