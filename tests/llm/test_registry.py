from __future__ import annotations

import re

from strandlog.llm import registry


def test_ten_operators_and_the_pipeline():
    names = registry.queries()
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)
