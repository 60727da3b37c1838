"""The pipeline, stage by stage, against a plain version on a small corpus."""

import itertools
import math
import random
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_corpus_operators import BYTE, brute_components, greedy_tiles, prose

import __spark_entry__ as entry
import corpus_pipeline
from pagelattice.llm import decontamination as D
from pagelattice.llm import quality as Q
from pagelattice.llm import secret_scan as S


def corpus():
    rng = random.Random(11)
    item = prose(77, 24, 4000)
    rows = []
    for i in range(260):
        if i % 6 == 0:
            text = "CLICK!! NOW!! " * rng.randint(5, 60)
        elif i % 6 == 1 and i > 6:
            words = rows[i - 6][1].split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif i % 13 == 3:
            text = f"{prose(i, 30, 4000)} {item} {prose(i + 1, 30, 4000)}"
        elif i % 13 == 4:
            text = f"{prose(i, 40, 4000)} password=ab12cd34ef{i:04d} {prose(i + 1, 30, 4000)}"
        else:
            text = prose(i, rng.randint(30, 400), 4000)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows += [(300, None, "en", "src0", None), (301, "", None, None, 0), (302, prose(5, 2600, 4000), "en", "src1", 9)]
    return rows, item


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    rows, item = corpus()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    pq.write_table(table, where / "documents.parquet")
    labels = pa.table({"doc_id": [r[0] for r in rows[:200]], "quality": pa.array([int(r[0] % 6 > 0) for r in rows[:200]], pa.int32())})
    pq.write_table(labels, where / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1, 2], "text": [item, "too short"]}), where / "benchmark.parquet")
    return str(where)


def plain_statistics(text):
    """The thirteen statistics by counting, one at a time."""
    data = (text or "").encode()
    n, words = len(data), data.split()
    w = len(words)

    def share(k, of):
        return math.sqrt((k + 0.01) / (of + 20))

    def count(chars):
        return sum(chr(c) in chars for c in data)

    upper, lower = count(string.ascii_uppercase), count(string.ascii_lowercase)
    repeats = sum(a == b for a, b in itertools.pairwise(words))
    return [
        math.log(n + 20), math.log((len(set(words)) + 20) / (w + 20)), share(repeats, w), share(upper, upper + lower), share(lower, n),
        share(count(string.digits), n), share(count(".,;:?'\"()-"), n), share(count("#$%&*|@^~<>{}[]=+_/\\"), n), share(count("!"), n),
        share(count("\n"), n), share(sum(c > 127 for c in data), n), math.log((n + 120) / (w + 20)), math.log(w + 20),
    ]


def plain_scores(rows, learned):
    """Posterior of class 1 from densities by linear solves and determinants, over all rows."""
    x = {r[0]: np.array(plain_statistics(r[1])) for r in rows}
    every = np.array([v for known in learned.values() for v in map(plain_statistics, known)])
    centre, spread = every.mean(0), every.std(0) + 1e-6
    parts = {}
    for k, known in learned.items():
        z = (np.array([plain_statistics(t) for t in known]) - centre) / spread
        cov = np.cov(z.T, bias=True)
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        parts[k] = z.mean(0), cov, math.log(len(z) / len(every))
    out = {}
    for i, v in x.items():
        d = {}
        for k, (mean, cov, prior) in parts.items():
            far = (v - centre) / spread - mean
            d[k] = prior - 0.5 * (far @ np.linalg.solve(cov, far) + np.linalg.slogdet(cov)[1])
        out[i] = 1 / (1 + math.exp(min(500, max(-500, d[0] - d[1]))))
    return out


def learned():
    known = [r for r in corpus()[0][:200] if zlib.crc32(str(r[0]).encode()) % 5]
    return {k: [r[1] for r in known if int(r[0] % 6 > 0) == k] for k in (0, 1)}


def plain_quality(rows):
    scores = plain_scores(rows, learned())
    return [r for r in rows if scores[r[0]] >= 0.3]


def test_scores_are_the_plain_ones(spark, sf_dir):
    """The query of the classifier, over the whole table; without labels of both kinds as well."""
    want = plain_scores(corpus()[0], learned())
    got = {r.doc_id: r for r in entry.queries()["op3_quality"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert abs(r.score - want[i]) < 1e-6 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert {r.score for r in Q.quality_scores(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in Q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_every_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind, want = docs.dtypes, corpus()[0]
    item = D.words(corpus()[1])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        before = want
        if k == 0:
            want = plain_quality(want)
        elif k == 1:
            keep = {i for i, _, c in brute_components([r[:2] for r in want], 5, 80) if i == c}
            want = [r for r in want if r[0] in keep]
        elif k == 2:
            covered = {r[0]: sum(t[2] for t in greedy_tiles(item.tolist(), D.words(r[1]).tolist())) for r in want}
            want = [r for r in want if covered[r[0]] < D.COVERAGE * len(item)]
        else:
            found = {r[0]: S.base_spans(r[1]) for r in want}
            clean = {r[0]: S.redacted(r[1], [(a, b, c, None) for a, b, c, _ in found[r[0]]]) if found[r[0]] else r[1] for r in want}
            want = [(r[0], clean[r[0]], r[2], r[3], len(clean[r[0]] or "")) for r in want]
        assert docs.dtypes == kind
        assert sorted(tuple(r) for r in docs.collect()) == sorted(want)
        assert k == 3 or len(want) < len(before)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    sizes = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in want}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes


def test_run_gives_what_the_stages_give(spark, sf_dir, tmp_path):
    out = entry.queries()["pipeline"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    # Which sequence and place a piece gets depends on ties among equal lengths; the rest is the same.
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert out.columns == docs.columns
    assert sorted(out.select(*names).collect()) == sorted(docs.select(*names).collect()) and out.count() > 100
    per = {}
    for r in out.collect():
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in per.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:j]) for j in range(len(parts))] and sum(p[1] for p in parts) <= 1024
