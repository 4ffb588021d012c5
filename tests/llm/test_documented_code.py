from __future__ import annotations

import datetime as dt

from corvane.llm.documented_code import documented_functions

SOURCE = '''
class Base:
    def run(self):
        """Run the whole job and return its result."""
    def stop(self):
        """Stop."""
    def shared(self):
        """Words about what all the others share."""

class Middle(Base):
    def run(self):
        pass

class Leaf(Middle):
    def run(self):
        """{@inheritDoc}"""
    async def stop(self):
        return 1
    def shared(self):
        def inner():
            """An inner function that is documented well."""
    def undocumented(self): pass

class Other(far.Away[int]):
    def go(self): pass

class Loop(Loop2): 
    def x(self): pass
class Loop2(Loop):
    def x(self): pass

def load_the_value():
    """This is the function to load the value."""
def todo():
    """TODO write down what this one does."""
def noted():
    """
    Words that are kept in the description.

    !!! note
        Not this.
    """
@decorated(
    1)
def with_decorator():
    r"""Has \\\\d raw docstring with words."""
if True:
    async def nested(): 
        "Nested in a block but found all the same."
def bytes_doc():
    b"""not a docstring at all here"""
def formatted():
    f"""not a docstring at all here"""
'''
FAR = 'class Away:\n\tdef go(self):\n\t\t"""Go to the far away place now."""\r\n'


def test_pairs(spark):
    t = dt.datetime(2025, 1, 1)
    later = dt.datetime(2025, 2, 1)
    rows = [
        (1, "s", "a/b.py", SOURCE, later), (1, "s", "a/b.py", "def old():\n  'An old version of the function.'", t), (2, "s", "far.py", FAR.replace("\n", "\r\n"), t),
        (3, None, "c.py", "def f(:", t), (4, None, "d.py", None, t), (5, None, "e.py", "", t), (6, None, None, "def g():\n  'A function without a site or file.'", t), (7, "s", "n.py", "x = '\x00'", t),
        (None, "s", "x.py", "def h():\n  'Never seen as it has no id.'", t),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "file_id long, source_site string, source_file string, source_text string, loaded_at timestamp, site int, name string")
    got = {(r["file_id"], r["symbol_name"]): r for r in documented_functions(df).collect()}
    assert {k for k, r in got.items() if r["doc_origin"] == "own"} == {
        (1, "Base.run"), (1, "Base.shared"), (1, "inner"), (1, "noted"), (1, "with_decorator"), (1, "nested"), (2, "Away.go"), (6, "g"),
    }
    assert {k: r["described_by"] for k, r in got.items() if r["doc_origin"] == "inherited"} == {(1, "Middle.run"): "Base.run", (1, "Leaf.run"): "Base.run", (1, "Leaf.shared"): "Base.shared", (1, "Other.go"): "Away.go"}
    assert got[1, "Leaf.run"]["description"] == "Run the whole job and return its result."
    assert got[1, "noted"]["description"] == "Words that are kept in the description."
    assert got[1, "with_decorator"]["code"].startswith("@decorated(\n    1)\ndef with") and got[1, "with_decorator"]["line_number"] == SOURCE[: SOURCE.index("def with_dec")].count("\n") + 1
    assert documented_functions(df.limit(0)).count() == 0


def test_bases_come_from_the_imported_module(spark):
    t = dt.datetime(2025, 1, 1)
    told = 'class Base:\n  def go(self):\n    """The text of the {} module, not another."""\n'
    files = {
        1: ("other/base.py", told.format("wrong")),
        2: ("pkg/core/base.py", told.format("right")),
        3: ("pkg/core/use.py", "from pkg.core.base import Base as B\nclass Use(B[int]):\n  def go(self): pass\n"),
        4: ("pkg/core/near.py", "from .base import Base\nclass Near(Base):\n  def go(self): pass\n"),
        5: ("pkg/far/far.py", "import pkg.core.base as m\nfrom ..core import base\nclass Far(m.Base):\n  def go(self): pass\nclass Up(base.Base):\n  def go(self): pass\n"),
        6: ("pkg/out.py", "from elsewhere import Base\nclass Out(Base):\n  def go(self): pass\n"),
        7: ("pkg/guess.py", "class Guess(Base):\n  def go(self): pass\n"),
    }
    rows = [(i, "s", path, text, t) for i, (path, text) in files.items()]
    df = spark.createDataFrame(rows, "file_id long, source_site string, source_file string, source_text string, loaded_at timestamp")
    got = {r["symbol_name"]: r["description"].split()[4] for r in documented_functions(df).filter("doc_origin = 'inherited'").collect()}
    assert got == {"Use.go": "right", "Near.go": "right", "Far.go": "right", "Up.go": "right", "Guess.go": "wrong"}
