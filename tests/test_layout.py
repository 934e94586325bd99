import pathlib
import re


def test_core_does_not_import_llm():
    root = pathlib.Path(__file__).parent.parent
    for f in [*root.glob("spanloom/**/*.py"), root / "bench.py"]:
        if "llm" not in f.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f
