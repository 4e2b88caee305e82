import pyarrow as pa

from spandrel.llm import batches


def test_slices_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(batches, "ROWS", 4)
    monkeypatch.setattr(batches, "BYTES", 10)
    texts = ["aaaa", None, "", "bbbbbbbb", "c" * 50, "d", "e", "f", "g", "h", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    parts = [p.column(0).to_pylist() for p in batches.slices(batch, "t")]
    assert [x for p in parts for x in p] == texts
    assert parts == [["aaaa", None, ""], ["bbbbbbbb"], ["c" * 50], ["d", "e", "f", "g"], ["h", None]]
    assert list(batches.slices(batch.slice(0, 0), 0)) == []
