"""Python facts helper (U1/U1b): counting rules of the grammar-node view."""
from __future__ import annotations

from tokenloom.operators.pyfacts import python_facts

SRC = '''
from __future__ import annotations
import os, sys as system
import a.b.c as abc
from pkg.mod import thing
from . import rel
from .x import y

@decorator
def outer(x) -> int:
    def inner():
        return [i for i in range(3) if i]
    if x and x > 1 or x < -1:
        return 1
    elif x:
        return 2 if x else 3
    for i in range(2):
        while False:
            pass
    try:
        pass
    except ValueError:
        pass
    return 0

class K:
    async def meth(self) -> None:
        async for _ in self:
            pass
'''


def test_python_facts_rules():
    funcs, classes, imports, cx, typed, err = python_facts(SRC)
    assert funcs == ["outer", "inner", "meth"]
    assert classes == ["K"]
    assert imports == ["os", "sys", "a.b.c", "pkg.mod"]
    # if, elif, and/or (2), conditional expr, for, while, except, async for; comprehension clauses not counted
    assert cx == 9
    assert typed == 2
    assert err is False


def test_python_facts_broken_file_fallback():
    funcs, classes, imports, cx, typed, err = python_facts("import os\nfrom a.b import c\ndef f(x) -> int:\n  if x and y:\n")
    assert err is True
    assert (funcs, classes, imports, cx, typed) == (["f"], [], ["os", "a.b"], 2, 1)


def test_empty_file():
    assert python_facts("") == ([], [], [], 0, 0, False)
