import random
import re

from pagelattice.llm import paragraphs as P
import numpy as np

from pagelattice.llm._common import ngram_hashes, shingle_set, word_ids


def cut(words, window=P.WINDOW):
    """First words of paragraphs, by the definition: a pair's hash is below all within `window` places."""
    ids = word_ids(" ".join(words))
    pair = [None, *ngram_hashes(ids, 2).tolist()]
    heads = [0] if words else []
    for i in range(window + 1, len(words) - window):
        if all(pair[i] < pair[j] for j in range(i - window, i + window + 1) if j != i):
            heads.append(i)
    return heads


def brute(rows, percent=80, n=5, least=P.PASSAGE):
    found, texts = [], []
    for doc, text in rows:
        if text is None:
            continue
        places = [m.start() for m in re.finditer(r"[^ \t-\r]+", text)]
        words = text.lower().split()
        if not words:
            continue
        heads = cut(words)
        starts = [0, *(places[h] for h in heads[1:])]
        for nth, (h, e) in enumerate(zip(heads, [*heads[1:], len(words)], strict=True)):
            w = words[h:e]
            end = starts[nth + 1] if nth + 1 < len(heads) else len(text)
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}
            found.append((doc, nth, starts[nth], end, grams, len(w), len(texts)))
        texts.append(text)
    root = list(range(len(found)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(found)):
        for j in range(i):
            a, b = found[i][4], found[j][4]
            if 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(found)):
        groups.setdefault(find(i), []).append(found[i])
    shared = {id(g): group for group in groups.values() if len(group) > 1 for g in group}
    out = []
    for k, g in enumerate(found):
        if id(g) not in shared:
            continue
        total = 0
        for step in (-1, 1):
            at = k if step == 1 else k - 1
            while 0 <= at < len(found) and found[at][6] == g[6] and id(found[at]) in shared:
                total += found[at][5]
                at += step
        if total >= least:
            first = min((x[0] is not None, x[0] or 0, x[1], x[6]) for x in shared[id(g)])
            out.append((*g[:4], first[1] if first[0] else None, first[2], (g[0] is not None, g[0] or 0, g[1], g[6]) != first))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:4]))


def corpus():
    rng = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(60) for _ in range(5)]

    def near(p, k):
        p = p.split()
        for _ in range(k):
            p[rng.randrange(len(p))] = rng.choice(words)
        return " ".join(p)

    rows = [(None, passages[0]), (0, None), (1, ""), (2, "short line\n\n\n"), (3, "a " * 300)]
    for i in range(4, 90):
        kept = [text(rng.randint(1, 40)), rng.choice(passages), text(30)]
        if i % 3 == 0:
            kept[1] = near(kept[1], rng.randint(0, 3))
        rows.append((i, ("\n" if i % 2 else " ").join(kept)))
    rows += [(90, "\u00e9t\u00e9 \U0001f600 " + passages[1].replace(" ", "\n")), (4, passages[2])]
    return rows


def test_against_brute_force(table):
    rows = corpus()
    for least in (P.PASSAGE, 1):
        got = by_id(tuple(r) for r in P.repeated_paragraphs(table(rows), least_words=least).collect())
        assert got == by_id(brute(rows, least=least))
        assert any(r[6] for r in got)


def test_a_passage_within_a_line_is_found(table):
    """50 words in the middle of long lines, and broken into short ones."""
    rng = random.Random(8)
    some = lambda n: ["x%d" % rng.randrange(10**6) for _ in range(n)]
    found = 0
    passages = [some(50) for _ in range(60)]
    rows = []
    for k, p in enumerate(passages):
        rows.append((2 * k, " ".join([*some(70), *p, *some(40)])))
        rows.append((2 * k + 1, "\n".join([*some(30), " ".join(p[:20]), " ".join(p[20:]), *some(90)])))
    got = {r.doc_id for r in P.repeated_paragraphs(table(rows), least_words=1).collect()}
    found = sum(2 * k in got and 2 * k + 1 in got for k in range(60))
    assert found >= 58
    assert P.repeated_paragraphs(table([(i, " ".join(some(300))) for i in range(40)])).collect() == []


def test_empty_and_unrepeated(table):
    assert P.repeated_paragraphs(table([])).collect() == []
    assert P.repeated_paragraphs(table([(1, None), (2, ""), (3, " \n")])).collect() == []
    assert P.repeated_paragraphs(table([(1, "one two three " * 30), (2, "other words entirely " * 30)])).collect() == []


def test_bands_reach_the_recall():
    for percent in (60, 80, 90):
        bands, rows = P.tuned_bands(percent)
        assert 1 - (1 - (percent / 100) ** rows) ** bands >= P.RECALL and bands * rows <= P.FUNCTIONS


def test_sets_of_many_paragraphs_are_those_of_each():
    rng = random.Random(4)
    words = [" ".join("w%d" % rng.randrange(6) for _ in range(rng.randint(1, 30))) for _ in range(50)]
    ids = [word_ids(w) for w in words]
    items, starts = P.shingle_sets(np.concatenate(ids), np.array([len(i) for i in ids]), 5)
    ends = [*starts[1:].tolist(), len(items)]
    for i, a, b in zip(ids, starts.tolist(), ends, strict=True):
        assert items[a:b].tolist() == shingle_set(i, 5).tolist()


def test_word_hashes_by_parts(monkeypatch):
    from pagelattice.llm import _common

    data = b" Ab\tcd  " + b"x" * 300 + b"\x0bEF\r\n ab CD"
    whole = _common.word_hashes(data)
    assert [data[s : s + 2].lower() for s in whole[1].tolist()] == [b"ab", b"cd", b"xx", b"ef", b"ab", b"cd"]
    assert whole[0][0] == whole[0][4] and whole[0][1] == whole[0][5] and len(set(whole[0].tolist())) == 4
    monkeypatch.setattr(_common, "_AT_ONCE", 7)
    again = _common.word_hashes(data)
    assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()
