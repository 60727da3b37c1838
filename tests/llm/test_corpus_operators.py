import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import decontamination as D
from pagelattice.llm import neighbours as N
from pagelattice.llm import ngram_join as J
from pagelattice.llm import packing as K
from pagelattice.llm import quality as Q
from pagelattice.llm import secret_scan as S
from pagelattice.llm import token_counts as C

PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [(None, "no id"), (1, None), (2, ""), (3, "the same"), (3, "the same"), (4, "x" * 5000), (5, "tab\there é日本語 ▁ <s> <|endoftext|> \x00\n\n  end  ")]


def prose(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


def test_token_counts_are_the_library_s(table):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = random.Random(1)
    letters = [chr(i) for i in range(32, 0x250)] + list("  \n\n日")
    rows = ODD + [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))) for i in range(6, 400)] + [(500, prose(2, 6000))]
    got = sorted((tuple(r) for r in C.token_counts(table(rows), PIECE).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in rows]
    assert got == sorted(want, key=str)
    assert any(r[3] for r in got)
    assert C.token_counts(table([]), PIECE).collect() == []


def test_packing_is_gapless_and_keeps_the_ids(table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    rows = ODD + [(i, prose(i, 40 + 37 * i % 900)) for i in range(6, 80)] + [(90, prose(9, 3000))]
    got = K.best_fit_packing(table(rows), BYTE, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k in range(len(cuts) - 1):
            part = np.array(ids[cuts[k] : cuts[k + 1]], "<u4").tobytes()
            want.append((i, k, cuts[k], len(part) // 4, zlib.crc32(part), part))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= -(-sum(r.length for r in got) // 1024) * 1.1 + 1
    assert K.best_fit_packing(table([]), BYTE).collect() == []


def test_plans_fill_bins_by_best_fit():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        fill, seen = {}, {n: 0 for n in counts}
        for length, first, last, bin0, each, base in K.plan(counts, 64):
            assert first == seen[length]
            seen[length] = last + 1
            for k in range(last - first + 1):
                assert fill.get(bin0 + k // each, 0) == base + k % each * length
                fill[bin0 + k // each] = base + (k % each + 1) * length
        assert seen == counts and max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
        rooms = []  # best fit decreasing, one by one
        for n in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= n]
            at = min(fits, key=lambda i: rooms[i]) if fits else len(rooms)
            if not fits:
                rooms.append(64)
            rooms[at] -= n
        assert len(fill) == len(rooms)


def test_quality_on_held_out_rows_and_odd_labels(spark, table):
    rows = [(i, prose(i, 60 + i % 90).capitalize() + "." if i % 3 else "BUY!! " * (20 + i % 30)) for i in range(600)]
    docs = table(rows + [(None, "x"), (9000, None), (9001, "")])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(9000, None), (None, 1), (9001, 7), (1, 0), (2, 1)], "doc_id bigint, quality int")
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(held) > 80 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.97
    none = Q.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert {r.score for r in Q.quality_scores(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert Q.quality_scores(table([]), labels).collect() == []


def test_moments_give_the_covariances():
    rng = np.random.default_rng(1)
    x = {k: rng.normal(k, 1 + k, (500, Q.FEATURES)) for k in (0, 1)}
    one = {k: np.hstack([np.ones((500, 1)), v]) for k, v in x.items()}
    model = Q.Discriminant({k: v.T @ v for k, v in one.items()})
    for k, (mean, back, _) in model.parts.items():
        z = (x[k] - model.centre) / model.spread
        cov = np.cov(z.T, bias=True)
        cov = (1 - Q.SHRINKAGE) * cov + Q.SHRINKAGE * np.diag(np.diag(cov)) + Q.RIDGE * np.eye(Q.FEATURES)
        assert np.allclose(mean, z.mean(0)) and np.allclose(back @ cov @ back.T, np.eye(Q.FEATURES), atol=1e-6)


def exact_neighbours(rows, k=5):
    good = {i: v for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 50 == 0:
            a = np.array(good[q])
            scores = []
            for i, v in good.items():
                if i != q and len(v) == len(a):
                    b = np.array(v)
                    scores.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 12), i))
            out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def test_neighbours_with_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    rows += [(i, rows[50][1]) for i in range(300, 340)]  # many copies of a query
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, []), (1005, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (1050, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, rank string, bucket int")
    got = {}
    for r in N.nearest_neighbours(df, F.col("vec_id") % 50 == 0, probes=32).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    assert got == {q: v for q, v in exact_neighbours(rows).items() if v}
    assert got[50] == [300, 301, 302, 303, 304]
    assert N.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_recall_of_the_default_probes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 64)).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want, found = exact_neighbours([(i, np.float32(v).tolist()) for i, v in rows]), {}
    for r in N.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(found[q] & set(v)) / 5 for q, v in want.items()])
    assert recall >= 0.95


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
            w = re.findall(r"[^\x20\x09-\x0D]+", lower)
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def families(seed):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One TWO"), (4, "one two"), (5, "one"), (6, "É é"), (7, "é É")]
    for f in range(6):
        base = prose(seed * 10 + f, rng.choice([12, 30, 150]), 5000).split()
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = "n%d" % rng.randrange(10**6)
            if rng.random() < 0.3:
                del words[: rng.randint(0, len(words) // 10)]
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), rows[20][1])] * 2
    return rows + [(None, rows[20][1])]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60), (1, 100)])
def test_ngram_components_are_exact(table, n, percent):
    rows = families(n)
    got = [tuple(r) for r in J.ngram_jaccard_components(table(rows), n, percent).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute_components(rows, n, percent)
    assert [r for r in got if r[0] is None] == [(None, len(J.shingle_set(J.word_ids(rows[20][1]), n)), None)]


def test_ngram_components_of_nothing(table):
    assert J.ngram_jaccard_components(table([])).collect() == []
    assert [tuple(r) for r in J.ngram_jaccard_components(table([(1, None)])).collect()] == [(1, 0, 1)]


def test_linked_sets_share_a_key_whatever_is_left_out():
    rng = np.random.default_rng(7)
    for percent in (60, 80, 90):
        for _ in range(200):
            s = np.unique(rng.integers(0, 2**63, rng.integers(1, 120)).astype(np.uint64))
            t = np.unique(np.concatenate([s[rng.random(len(s)) < 0.97], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)]))
            frequent = np.sort(rng.choice(s, len(s) // 2, replace=False))
            both = len(np.intersect1d(s, t))
            if 100 * both >= percent * (len(s) + len(t) - both):
                (ks, ps), (kt, pt) = (J.fragment_keys(x, percent, frequent) for x in (s, t))
                assert set(ks.tolist()) & set([*kt.tolist(), *pt.tolist()]) or set(kt.tolist()) & set(ps.tolist())


def greedy_tiles(item, doc, least=D.MINIMUM):
    ui, uj, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in ui and j + n not in uj:
                    n += 1
                if n >= least and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return out
        n, i, j = -best[0], best[1], best[2]
        out.append((i, j, n))
        ui |= set(range(i, i + n))
        uj |= set(range(j, j + n))


def test_tiles_are_the_greedy_ones():
    rng = random.Random(8)
    for _ in range(60):
        item = np.array([rng.randrange(4) for _ in range(rng.randint(5, 30))], np.uint64)
        doc = np.array([rng.randrange(4) for _ in range(rng.randint(0, 40))], np.uint64)
        seeds = D.Seeds({0: item}).matches(doc).get(0, [])
        assert D.tiles(item, doc, seeds) == greedy_tiles(item.tolist(), doc.tolist())


def test_contamination(spark, table, monkeypatch):
    item, other = prose(1, 30, 5000), prose(2, 24, 5000)
    w = item.split()
    moved = " ".join(w[15:] + ["and"] + w[:15])
    docs = table(ODD + [(10, f"{prose(3, 50)} {item.upper()}! {prose(4, 50)}"), (11, moved), (12, " ".join(w[:10])), (13, f"{other}, {item}"), (13, other)])
    rows = [(1, item, 0), (2, other, 0), (3, None, 0), (4, "", 0), (5, "the same", 0)]
    bench = spark.createDataFrame(rows, "item_id bigint, text string, doc_id int")
    want = [(10, 1, 1), (11, 1, 2), (13, 1, 1), (13, 2, 1), (13, 2, 1)]
    for size in (D.BLOCK_WORDS, 10):
        monkeypatch.setattr(D, "BLOCK_WORDS", size)
        assert sorted((r.doc_id, r.item_id, r.n_tiles) for r in D.contamination(docs, bench).collect()) == want
    assert D.contamination(docs, bench.limit(0)).collect() == [] and D.contamination(table([]), bench).collect() == []


def test_base_secrets():
    found = lambda t: [(k, t[s:e]) for k, s, e, _ in S.base_spans(t)]
    assert found("My PASSWORD : 'abc123.x' ok") == [("assign", "PASSWORD : 'abc123.x")]
    assert found("token=abc secret=abcdef") == [("assign", "secret=abcdef")]
    assert found("api_key\"=\"A/b+c=d-") == [("assign", "api_key\"=\"A/b+c=d-")]
    assert found("pa\u017fsword=abcdefg to\u212aen=abcdefg") == []
    assert found("AKIAAKIA" + "A" * 12 + " AKIA" + "B" * 15) == [("access", "AKIAAKIA" + "A" * 12)]
    assert found("g" + "a1" * 12 + "G " + "a" * 23) == [("hex", "a1" * 12)]
    both = "token = " + "0a" * 20
    assert found(both) == [("assign", both), ("hex", "0a" * 20)]


def test_inferred_formats_find_bare_credentials(table):
    rng = random.Random(6)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(18)) for _ in range(160)]
    rows = [(i, f"text password={h} more words here") for i, h in enumerate(hexes[:150])]
    rows += [(200, f"bare {hexes[155]} in text"), (201, "ordinary words and 1234567890123456 or internationalisation2"), (202, None), (203, "")]
    rows += [(204 + i, prose(i, 60)) for i in range(20)]
    got = {r.doc_id: r for r in S.scan_secrets(table(rows)).collect()}
    assert [s.kind for s in got[200].spans] == ["format"] and got[200].redacted_text == "bare [secret] in text"
    assert got[201].spans == [] and got[202].redacted_text is None and got[0].redacted_text == "text [secret] more words here"
    digest = {r.doc_id: r for r in S.secret_digest(table(rows)).collect()}
    assert digest[0].spans == "assign:5:32" and (digest[0].n_assign, digest[0].n_hex) == (1, 0)
    assert digest[203].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert S.scan_secrets(table([])).collect() == []


def test_redaction_of_nested_spans():
    assert S.redacted("0123456789", [("assign", 2, 8, None), ("hex", 4, 6, None), ("hex", 7, 9, None)]) == "01[secret]9"
