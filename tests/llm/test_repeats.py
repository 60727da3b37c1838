import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagelattice.llm import repeats


def brute(rows, length, keep_first=False):
    data = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    met, out = set(), [None] * len(rows)
    for i in order:
        d = data[i]
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            s = d[p : p + length]
            if (s in met) if keep_first else seen[s] > 1:
                gone[p : p + length] = True
            met.add(s)
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out[i] = (rows[i][0], len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["ab", "cde", "é", "fghi", "j", "klm", "ß"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(12) for _ in range(4)]
    rows = [(None, None), (1, ""), (2, "aaaa" * 20), (3, "xyz" * 30)]
    for i in range(4, 60):
        parts = [text(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), text(rng.randint(1, 8))]
        rows.append((i, " ".join(parts)))
    rows += [(60, rows[10][1]), (61, rows[10][1]), (62, rows[11][1][5:] + "!")]
    return rows


@pytest.mark.parametrize("gathered", [1024, 1])
@pytest.mark.parametrize("keep_first", [False, True])
def test_against_brute_force(table, monkeypatch, gathered, keep_first):
    monkeypatch.setattr(repeats, "GATHERED", gathered)
    rows = corpus(5)
    got = repeats.remove_repeats(table(rows), length=24, keep_first=keep_first)
    got = sorted([tuple(r)[:5] for r in got.collect()], key=str)
    assert got == brute(rows, 24, keep_first)


def test_repeated_rows_and_empty_table(table):
    rows = [(7, "q" * 10 + "the same row twice in a table"), (7, "q" * 10 + "the same row twice in a table"), (8, "other")]
    got = sorted(tuple(r)[:5] for r in repeats.remove_repeats(table(rows), length=16).collect())
    assert got == brute(rows, 16)
    assert repeats.remove_repeats(table([]), length=16).collect() == []


def test_long_texts_are_cut_into_steps(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 123) for _ in range(5000)) * 2
    monkeypatch.setattr(repeats, "STEP", 700)
    first, last, place, _, _ = repeats.anchor_runs(data, 60)
    assert first[0] == 0 and last[-1] == len(data) - 60 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= first) & (place <= last + 45)).all()


def test_kept_bytes_and_spans(table):
    rows = [(1, "head " + "0123456789abcdef" + " tail"), (2, "0123456789abcdef")]
    got = {r.doc_id: r for r in repeats.remove_repeats(table(rows), length=16, with_kept=True).collect()}
    assert bytes(got[1].kept) == b"head  tail" and got[1].spans == [5, 21]
    assert bytes(got[2].kept) == b""
