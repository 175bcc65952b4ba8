"""What a Python worker holds when it goes on with another operator's tasks."""

import pyarrow as pa

from faultgrain.llm import common, lines, packing

BATCH = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": pa.array(["one two", None])})


def test_other_operators_drop_the_encoder():
    path = packing.tokenizer_path()
    list(packing._pieces(path, 2048, False)(iter([BATCH])))
    encoder = packing.word_ids(path)
    list(packing._pieces(path, 2048, False)(iter([BATCH])))
    assert packing.word_ids(path) is encoder
    list(lines._keys(40)(iter([BATCH])))
    assert packing.word_ids(path) is not encoder


def test_freed_memory_goes_back_at_a_task_s_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert [piece.num_rows for piece in common.slices(iter([BATCH]))] == [2]
    assert len(calls) == 2
