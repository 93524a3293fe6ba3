import pytest

pytest.importorskip("netloom.llm")
