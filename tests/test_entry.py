import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(before: str) -> list[str]:
    code = f"import sys; {before}; import __spark_entry__ as e; print('NAMES', *e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.rpartition("NAMES")[2].split()


def test_a_failing_optional_part_leaves_the_catalogue():
    """Whether the vocabularies or a package of the corpus part are missing."""
    from cadenza.plans import registry
    registry.load_all()
    for missing in ("public_tokenizers", "cadenza.llm"):
        names = _names(f"sys.modules[{missing!r}] = None")
        assert set(names) == set(registry.QUERIES) and not any(n.startswith("op") for n in names)
