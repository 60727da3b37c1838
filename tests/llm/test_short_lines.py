import random

import pytest

from pagelattice.llm.paragraphs import repeated_paragraphs


@pytest.mark.parametrize("words_a_line", [2, 6, 19])
def test_a_passage_of_short_lines_is_found(table, words_a_line):
    """60 words in short lines, at other places of two documents: the same paragraphs of it are found in both."""
    rng = random.Random(words_a_line)
    lines = [" ".join("w%d" % rng.randrange(10**6) for _ in range(words_a_line)) for _ in range(-(-60 // words_a_line))]
    ends = [" ".join(f"{c}{k}" for k in range(12)) for c in "xyz"]
    texts = {1: "\n".join([ends[0], *lines, ends[1]]), 2: "\n".join([*lines, "\n", ends[2]])}
    got = {1: [], 2: []}
    for r in repeated_paragraphs(table(list(texts.items()))).collect():
        got[r.doc_id].append(texts[r.doc_id][r.start : r.end].split())
        assert r.removed == (r.doc_id == 2) and r.first_doc_id == 1
    assert sorted(got[1]) == sorted(got[2]) and sum(map(len, got[1])) >= 20
