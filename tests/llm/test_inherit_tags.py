from __future__ import annotations

import datetime as dt

from corvane.llm import queries as Q

SOURCE = '''
class Base:
    def run(self):
        """Run the whole job and return its result."""
    def stop(self):
        """Stop."""

class Leaf(Base):
    def run(self):
        """See the base class."""
    def stop(self):
        """See the parent method."""
    def alone(self):
        """See the super class."""
    def tag(self):
        """{@inheritDoc}"""

def free():
    """See the base class."""
'''


def test_own_docstring_by_its_words_alone(spark, tmp_path):
    rows = [(1, "s", "a.py", SOURCE, dt.datetime(2025, 1, 1))]
    spark.createDataFrame(rows, "file_id long, source_site string, source_file string, source_text string, loaded_at timestamp").write.parquet(f"{tmp_path}/python_source.parquet")
    found = [r["symbol_name"] for r in Q.p3_found(spark, str(tmp_path)).collect()]
    assert sorted(found) == ["Base.run", "Leaf.alone", "Leaf.run", "Leaf.stop", "free"]
    pairs = [(r["symbol_name"], r["description"], r["doc_origin"], r["described_by"]) for r in Q.p3_pairs(spark, str(tmp_path)).collect()]
    assert sorted(pairs) == [
        ("Base.run", "Run the whole job and return its result.", "own", None),
        ("Leaf.alone", "See the super class.", "own", None),
        ("Leaf.run", "Run the whole job and return its result.", "inherited", "Base.run"),
        ("Leaf.stop", "See the parent method.", "own", None),
        ("free", "See the base class.", "own", None),
    ]
