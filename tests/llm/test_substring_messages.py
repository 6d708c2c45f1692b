"""What op9 sends between tasks: few messages a slice, each with its windows whole; and the hashes of words."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common as C
from tidemark.llm import substring

ODD = ["", None, " ", "a", "ab cd", "cd\x0bab\x0c\r\n", "no-break space \x1cunit\x85", "\x00 \x00\x00 a\x00", "12345678 123456789 1234567 1234567890123456 12345678901234567", "é" * 40 + " x", "x" * 5000 + " " + "x" * 5001, "\t\tlast"]


@pytest.mark.parametrize("cut", [(0, None), (3, 5), (1, 1), (0, 0)])
def test_words_are_hashed_as_they_stand(cut):
    column = pa.array(ODD).slice(*cut) if cut[1] is not None else pa.array(ODD * 2)
    words = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in column.to_pylist()]
    h, off = C.hashed_words(column)
    flat = [w for ws in words for w in ws]
    assert np.diff(off).tolist() == [len(x) for x in words] and len(h) == len(flat)
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_few_messages_a_slice():
    """Each slice sends a message to each task at most, and those of what it knows by itself; before, one to each of at
    least 256 shards in each of three roles, so that most were a few windows long."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(300)]
    texts[200:] = texts[:100]
    ids = rng.sample(range(-(1 << 40), 1 << 40), 300)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])
    tasks = 16
    sent = pa.Table.from_batches(list(substring._send(iter([batch]), 7, tasks)))
    assert sent.num_rows <= tasks + 2

    least: dict[int, int] = {}
    have = set()
    for d, x in zip(ids, texts):
        for w in substring.windows(pa.array([x]), 7)[0].tolist():
            have.add((d, w))
            least[w] = min(d, least.get(w, d))
    later = {(d, w) for d, w in have if d > least[w]}
    want = {substring._ASK: {(d, w) for w, d in least.items()}, substring._LATER: later, substring._FIRST: {(least[w], w) for _, w in later}}
    docs, counts, hashes = substring._unpacked(sent)
    got = {role: [] for role in want}
    for to, role, d, n, h in zip(sent["to"].to_pylist(), sent["role"].to_pylist(), docs, counts, hashes):
        got[role] += zip(np.repeat(d, n).tolist(), h.tolist())
        assert role != substring._ASK or all(w * tasks >> 64 == to for w in h.tolist())
    assert {role: sorted(x) for role, x in got.items()} == {role: sorted(x) for role, x in want.items()}


def test_answers_name_smaller_documents_of_other_slices():
    def slice_of(number, rows):
        ids, h = map(np.array, zip(*sorted(rows)))
        each, owner = np.unique(ids, return_inverse=True)
        return list(substring.pack(h.astype(np.uint64), owner, each, number, substring._edges(1)))

    table = pa.Table.from_batches(slice_of(0, [(5, 1), (5, 2), (7, 2), (9, 4)]) + slice_of(1, [(3, 2), (5, 1), (8, 3), (9, 4)]) + slice_of(2, [(4, 3)]))
    found = substring._gather(substring._answer(table))
    got = {(d, w, kind) for kind in ("hashes", "firsts") for d, x in zip(found["doc_id"].to_pylist(), found[kind].to_pylist()) for w in np.frombuffer(x or b"", np.uint64).tolist()}
    # 1 and 4 stand in two rows of one doc_id only, which repeat nothing.
    assert {(d, w) for d, w, kind in got if kind == "hashes"} == {(5, 2), (7, 2), (8, 3)}
    assert {(d, w) for d, w, kind in got if kind == "firsts"} >= {(3, 2), (4, 3)} and not {w for _, w, _ in got} & {1, 4}
