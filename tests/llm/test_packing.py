import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymark.llm.packing import END, PIECE_CHARS, VOCABULARY, best_fit_decreasing, encoding, pack, token_ids, unpack


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.integers(1, n), max_size=60))))
def test_same_as_best_fit_by_search(case):
    length, sizes = case
    sizes = np.array(sizes, dtype=int)
    rooms, places = [], []
    for i in np.argsort(-sizes, kind="stable"):
        fitting = [k for k, room in enumerate(rooms) if room >= sizes[i]]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= sizes[i]
        else:
            rooms.append(length - sizes[i])
        places.append(i)
    found = best_fit_decreasing(sizes, length)
    assert sorted(length - sizes[own].sum() for own in found) == sorted(rooms)
    assert sorted(i for own in found for i in own) == sorted(places)


def test_texts_read_back_exactly(docs):
    texts = ["Hello  world\n", "x" * 5000, "Ünïcode 漢字 🎉 <|endoftext|>", " ", "a b c " * 700, "one word " * 9000]
    table = docs([(i, t) for i, t in enumerate(texts)] + [(90, None), (91, "")])
    packed = pack(table, length=64, block_tokens=1000)
    assert {r.doc_id: r.text for r in unpack(packed).collect()} == dict(enumerate(texts))
    for r in packed.collect():
        cuts = r.cu_seqlens
        assert cuts[0] == 0 and cuts[-1] == r.n_tokens <= 64 and len(cuts) == len(r.doc_ids) + 1
        positions = np.frombuffer(r.position_ids, "<u2")
        assert len(positions) == 64 == len(r.input_ids) // 2
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            assert b > a and positions[a:b].tolist() == list(range(b - a))


def test_long_texts_get_the_tokens_of_the_whole():
    text = "Some words, 12 of them; and spaces   too.\n" * (3 * PIECE_CHARS // 40)
    assert token_ids(text).tolist() == [*encoding(VOCABULARY).encode_ordinary(text), END]


def test_empty_table_and_bad_length(docs):
    assert pack(docs([])).collect() == []
    with pytest.raises(ValueError):
        pack(docs([]), length=0)
