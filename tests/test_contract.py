import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    from melisma.plans import catalog, oracle

    assert catalog.STATED == oracle.STATED


def test_own_queries_do_not_need_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['melisma.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
