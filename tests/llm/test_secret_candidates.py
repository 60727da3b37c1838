import random
import re

import pytest

from pagelattice.llm import secret_scan as S

POOLS = {"d": "0123456789", "h": "abcdef", "U": "ABCDEFGHIJ", "x": "0123456789abcdef", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ".": "."}
WORDS = ["the", "of", "ordinary", "internationalisation", "nothing", "hidden.", "is", "2024", "3.14", "well-known", "and/or", "e.g.", "Words", "IBM"]


def made(form, rng):
    return "".join(rng.choice(POOLS[c]) if c in POOLS else c for c in form)


def scanner(samples):
    ordinary = S.Ordinary(WORDS * 20)
    return {"assign": S.Automaton(samples, ordinary)}


@pytest.mark.parametrize("form", ["dddddddd", "xxxxxx", "hhd.dhhd", "UUUUUUUUUUUUUUUUUU", "x" * 18])
def test_bare_credentials_like_the_labelled_ones_are_found(form):
    """Shorter than 16, without a letter or a digit, or with a dot inside."""
    rng = random.Random(1)
    formats = scanner([made(form, rng) for _ in range(300)])
    found = 0
    for value in [made(form, rng) for _ in range(40)]:
        for text in (f"the value {value} here", f"it ends so: {value}."):
            at = text.index(value)
            spans = S.secret_spans(text, formats)
            assert len(spans) <= 1 and all(s[0] == "format" and s[1] <= at and at + len(value) <= s[2] for s in spans)
            found += len(spans)
    assert found >= 0.9 * 80
    assert S.secret_spans(" ".join(WORDS), formats) == []


def test_formats_give_automata_of_their_own():
    """Lengths and prefixes are kept: 40 hexadecimal digits, AKIA and 16 more, and both."""
    rng = random.Random(2)
    forms = {"hex": ["x" * 40], "access": ["AKIA".replace("A", "U") + "A" * 16], "both": ["x" * 40, "UUUU" + "A" * 16]}
    got = {name: S.Automaton([made(rng.choice(some), rng) for _ in range(400)]) for name, some in forms.items()}
    assert len(got["hex"].next) == 41 and len(got["access"].next) == 21 and len(got["both"].next) >= 59
    assert [got[name].least for name in ("hex", "access", "both")] == [40, 20, 20]
    for name in ("hex", "both"):
        assert got[name].score(made("x" * 40, rng)) > 0 and got[name].score(made("x" * 39, rng)) == -S.inf == got[name].score(made("x" * 41, rng))
    assert got["access"].score(made("x" * 40, rng)) == -S.inf == got["hex"].score(made("UUUU" + "A" * 16, rng))


def test_free_lengths_make_loops():
    rng = random.Random(3)

    def free():
        out = "x"
        while rng.random() < 0.9:
            out += "x"
        return made(out, rng)

    automaton = S.Automaton([free() for _ in range(400)])
    assert len(automaton.next) < 12 and automaton.score(made("x" * 200, rng)) > -S.inf


def test_likelihoods_sum_to_one():
    rng = random.Random(4)
    automaton = S.Automaton([made("d" * rng.randint(1, 4), rng) for _ in range(200)])
    plain = automaton.ordinary
    mass = sum(S.np.exp(automaton.score("0" * n) + plain.score("0" * n)) for n in range(1, 400))
    assert abs(mass + automaton.ends[0] / automaton._total(0) - 1) < 1e-6


def test_precision_and_recall_on_planted_credentials(table):
    """Labelled by an assignment in some documents, bare in others, among prose; base spans by an own scan."""
    rng = random.Random(5)
    forms = ["UAAAAAAAAAAAAAAAAAAA", "UUU-dddddd", "xxxxxxxxxxxxxxxxxx"]
    words = WORDS + ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 14))) for _ in range(3000)] + [str(i) for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{prose(9)} token: {made(rng.choice(forms), rng)} {prose(9)}") for i in range(300)]
    bare = {i: made(rng.choice(forms), rng) for i in range(300, 400)}
    rows += [(i, f"{prose(12)} {v} {prose(12)}") for i, v in bare.items()] + [(i, prose(30)) for i in range(400, 500)] + [(500, None), (501, "")]
    texts, right, wrong = dict(rows), 0, 0
    pattern = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for r in S.scan_secrets(table(rows)).collect():
        base = [(s.start, s.end) for s in r.spans if s.kind == "assign"]
        assert base == [m.span() for m in re.finditer(pattern, texts[r.doc_id] or "", re.I | re.A) if len(m[2]) >= 6]
        for s in (s for s in r.spans if s.kind == "format"):
            hit = texts[r.doc_id][s.start : s.end] == bare.get(r.doc_id)
            right, wrong = right + hit, wrong + (not hit)
    assert right >= 90 and wrong <= right / 9


def test_base_spans_against_a_scan_of_random_texts():
    """Leftmost, not overlapping, per kind; by trying every start and taking the longest run from it."""
    rng = random.Random(6)
    bits = ["token", "PassWord", "api_key", "apikey", "secret", "=", ":", " ", "'", '"', "AKIA", "0123456789abcdef", "ABCDEFGHIJKLMNOP12", "zz", "\u00e9", "\n", "x.y-z"]
    credential, hexes, access = (set(c) for c in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))

    def run(text, at, chars):
        while at < len(text) and text[at] in chars:
            at += 1
        return at

    def assign(text, at):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if text[at : at + len(word)].lower() == word and text[at : at + len(word)].isascii():
                ends = [at + len(word)]
                i = ends[0] + (text[ends[0] : ends[0] + 1] in ("'", '"') and ends[0] < len(text))
                i = run(text, i, {" "})
                if text[i : i + 1] not in (":", "=") or i >= len(text):
                    return None
                i = run(text, i + 1, {" "})
                i += i < len(text) and text[i] in "'\""
                end = run(text, i, credential)
                return (end, end - i) if end > i else None
        return None

    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        want = []
        at = 0
        while at < len(text):
            got = assign(text, at)
            if got:
                want += [("assign", at, got[0])] if got[1] >= 6 else []
            at = got[0] if got else at + 1
        for kind, start, chars, least in (("access", "AKIA", access, 20), ("hex", "", hexes, 24)):
            at = 0
            while at < len(text):
                end = run(text, at, chars) if text.startswith(start, at) else at
                if end > at + len(start):
                    want += [(kind, at, end)] if end - at >= least else []
                    at = end
                else:
                    at += 1
        want.sort(key=lambda x: (x[1], S.KINDS.index(x[0])))
        assert [x[:3] for x in S.base_spans(text)] == want, text


def test_every_credential_and_every_run_counts(table, monkeypatch):
    """More credentials than a tree takes, a rare form, long ones; the chances are those of all of them."""
    monkeypatch.setattr(S, "LONGEST", 60)
    rng = random.Random(7)
    common = sorted({made("xxxxxxxx", rng) for _ in range(300)})
    rare, long = ["QQ-" + made("dddd", rng) + "/zz" for _ in range(3)], [made("UU" * 50, rng) for _ in range(2)]
    values = [*common, *rare, *long]
    prose = [f"{rng.choice(WORDS)} w{i} {rng.choice(WORDS)}" for i in range(6000)]
    rows = [(i, f"token={v} {p}") for i, (v, p) in enumerate(zip(values, prose, strict=False))]
    rows += [(len(values) + i, p) for i, p in enumerate(prose[len(values) :])]
    got = S.infer_formats(table(rows), labelled=40)["assign"]
    assert sum(round(S.np.exp(share) * len(values)) for share, _ in got.parts) == len(values)
    assert sum(sum(part.ends) for _, part in got.parts) == len(values)
    scores = sorted(got.score(v) for v in values)
    assert scores[0] > -S.inf and got.threshold == max(scores[int(S.BELOW * len(values))], S.log(1000))
    first = sum(n for _, n in got.parts[0][1].next[0].values())
    assert first >= len(common) and got.parts[0][1].next[0]["d"][1] == sum(v[0].isdigit() for v in common)
    # Every run of the texts outside base spans is in the model of ordinary ones.
    plain = S.Ordinary([run for p in prose for run in re.findall(r"[A-Za-z0-9+/_.=-]+", p)])
    assert all(abs(got.parts[0][1].ordinary.score(w) - plain.score(w)) < 1e-9 for w in [*WORDS, *values])
