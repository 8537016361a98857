"""What Python workers keep from task to task."""

from paperloom.llm import _worker


def test_tasks_drop_memos_of_other_operators(monkeypatch):
    monkeypatch.setattr(_worker, "_MEMOS", {})
    trimmed = []
    monkeypatch.setattr(_worker, "trim", lambda: trimmed.append(1))

    @_worker.task("a")
    def keeps(batches):
        for batch in batches:
            _worker.memo("a")[batch] = True
            yield batch

    @_worker.task("b")
    def fails(batches):
        yield from batches
        raise ValueError

    assert list(keeps([1, 2])) == [1, 2] and list(keeps([3])) == [3]
    assert set(_worker.memo("a")) == {1, 2, 3} and len(trimmed) == 2
    rows = fails([4])
    assert next(rows) == 4 and not _worker.memo("a")
    try:
        next(rows)
    except ValueError:
        pass
    assert len(trimmed) == 3


def test_trim_runs():
    _worker.trim()
