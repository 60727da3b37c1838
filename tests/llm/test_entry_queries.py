"""The registered queries themselves, over a whole small table, against plain versions of what they return."""

import hashlib
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Documents of the driver's smallest table and a few odd ones; a passage of over 400 bytes in two places."""
    folder = tmp_path_factory.mktemp("tables")
    docs = pq.read_table(f"{SOURCE}/documents.parquet")
    rows = docs.to_pylist()
    passage = " ".join(f"passage{i}" for i in range(60))
    odd = [None, "", "  \n", f"one {passage} two", f"three\n{passage}", "token: abcdef123456 and " + "0a" * 16, "\u00e9" * 300 + "AKIA" + "B" * 16]
    more = [{**rows[0], "doc_id": 10**6 + i, "text": t, "n_chars": len(t or "")} for i, t in enumerate(odd)]
    more.append({**rows[1], "doc_id": 10**6 + 50})
    pq.write_table(pa.Table.from_pylist(rows + more, docs.schema), folder / "documents.parquet")
    vectors = pq.read_table(f"{SOURCE}/embeddings.parquet")
    pq.write_table(vectors, folder / "embeddings.parquet")
    return str(folder), {r["doc_id"]: r["text"] for r in rows + more}, vectors.to_pylist()


def run(spark, tables, name):
    return entry.queries()[name](spark, tables[0]).collect()


def test_op2_token_counts(spark, tables):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, tables, "op2_token_counts")}
    tokens = {i: len(library.encode(t or "")) for i, t in tables[1].items()}
    assert got == {i: (len((t or "").encode()), tokens[i], tokens[i] > 4096) for i, t in tables[1].items()}


def test_op4_neighbours(spark, tables):
    good = {r["vec_id"]: np.array(r["embedding"], float) for r in tables[2] if r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])}
    found, rows = {}, run(spark, tables, "op4_neighbours")
    for r in rows:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in good if i % 50 == 0}
    hits = 0
    for q, near in found.items():
        near.sort()
        cosine = {i: float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)) for i, v in good.items() if i != q and len(v) == len(good[q])}
        best = sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:5]
        assert [r[0] for r in near] == list(range(1, len(best) + 1))
        assert all(abs(cosine[i] - score) < 1e-12 for _, i, score in near)
        hits += len({r[1] for r in near} & set(best)) / len(best)
    assert hits / len(found) >= 0.9


def test_op6_ngram_jaccard(spark, tables):
    sets = {}
    for i, t in tables[1].items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, tables, "op6_ngram_jaccard")}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert got[10**6 + 50][1] != 10**6 + 50


def test_op7_repeats(spark, tables):
    texts = {i: (t or "").encode() for i, t in tables[1].items()}
    seen = Counter(t[k : k + 400] for t in texts.values() for k in range(len(t) - 399))
    want = {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        want[i] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest(), kept)
    rows = run(spark, tables, "op7_repeats")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == {i: w[:4] for i, w in want.items()}
    assert all(r.removed == (r.n_removed > 0) and r.text == want[r.doc_id][4].decode("utf-8", "replace") for r in rows)
    assert got[10**6 + 3][2] == got[10**6 + 4][2] == 1


def test_op8_base_spans(spark, tables):
    patterns = {"assign": r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"(AKIA[A-Z0-9]+)", "hex": r"([0-9a-f]+)"}
    least = {"assign": 6, "access": 20, "hex": 24}
    for r in run(spark, tables, "op8_secret_scan"):
        found = [(k, m) for k, p in patterns.items() for m in re.finditer(p, tables[1][r.doc_id] or "") if len(m[1]) >= least[k]]
        found.sort(key=lambda x: (x[1].start(), list(patterns).index(x[0])))
        base = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _ in found) for kind in patterns)
        assert [s for s in r.spans.split(",") if s and not s.startswith("format")] == [s for s in base.split(",") if s]


def test_other_queries_work_without_a_library():
    code = "import sys; sys.modules['sentencepiece'] = None; import __spark_entry__ as e; q = e.queries(); assert 'deck_summary' in q and 'op2_token_counts' not in q and set(e.oracle_sql()) <= set(q)"
    here = Path(entry.__file__).resolve().parent
    assert subprocess.run([sys.executable, "-c", code], cwd=here, timeout=120).returncode == 0
