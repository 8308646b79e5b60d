import numpy as np

from lakecat.llm import common


def test_range_hashes_depend_on_content_only():
    rng = np.random.default_rng(0)
    part = rng.integers(0, 256, 40).astype(np.uint64)
    for n in (40, 100, 5000):
        at = int(rng.integers(0, n - 39))
        whole = rng.integers(0, 256, n).astype(np.uint64)
        whole[at : at + 40] = part
        got = common.byte_hashes(whole, np.array([at]), np.array([at + 40]))
        assert got[0] == common.byte_hashes(part, np.array([0]), np.array([40]))[0]


def test_gram_hashes_tell_contents_apart():
    words = np.arange(1000, dtype=np.uint64)
    assert len(set(common.gram_hashes(words, 10).tolist())) == 991


def test_slots_number_in_order():
    slots = common.Slots([""])
    assert list(map(slots.__getitem__, ["a", "", "b", "a"])) == [1, 0, 2, 1]
    assert slots.taken() == ["a", "b"] and slots.taken() == []
