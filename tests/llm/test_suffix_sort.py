"""The blockwise suffix sort on texts whose ties meet the cover at different distances."""

import numpy as np

from stopover.llm import suffixes


def test_ties_of_all_residues():
    rng = np.random.default_rng(3)
    core = rng.integers(97, 100, 700).astype(np.uint8)
    parts = [core[:650], rng.integers(97, 100, 37).astype(np.uint8), core[20:], np.tile(core[:7], 150), core[100:620]]
    text = np.concatenate(parts)
    place = np.arange(len(text) - suffixes.SIZE + 1)
    raw = text.tobytes()
    windows = [raw[i : i + suffixes.SIZE] for i in place]
    want = np.array([windows.count(w) > 1 for w in windows])
    assert (suffixes.repeated_windows(text, place) == want).all() and want.any() and not want.all()


def test_buckets_do_not_change_the_result(monkeypatch):
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(97, 123, 3000), rng.integers(97, 123, 50), np.zeros(500)]).astype(np.uint8)
    text[2000:2900] = text[100:1000]
    place = np.arange(len(text) - suffixes.SIZE + 1)
    whole = suffixes.repeated_windows(text, place)
    monkeypatch.setattr(suffixes, "BUCKET", 64)
    assert (suffixes.repeated_windows(text, place) == whole).all() and whole[100:600].all()
