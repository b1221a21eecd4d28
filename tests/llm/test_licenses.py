import random
import re
import time

import regex

from foldmill.llm import licenses
from foldmill.llm.licenses import NOTICES, fuzzy_spans, scan_text, seeds


def test_base_by_brute_force():
    r = random.Random(0)
    words = ["MIT", "license", "License,", "apache", "general", "public", "x", "ist", "é", "GNU-general", "mit\nlicense"]
    for _ in range(300):
        text = r.choice([" ", ". ", "_"]).join(r.choice(words) for _ in range(r.randrange(30)))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        got = scan_text(text)
        assert got[0] == len(w) and got[1] == len(places)
        assert got[2:4] == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert got[4] == ",".join(sorted({x for _, x in places}))
        assert set(got[4].split(",")) <= set(got[5].split(",")) | {""}


def edited(text, edits, r):
    for _ in range(edits):
        i = r.randrange(len(text))
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def test_every_notice_within_its_edits_is_found():
    r = random.Random(1)
    for notice, label in NOTICES:
        most = len(notice) // licenses.CHARS_PER_EDIT
        assert len(seeds(notice, most)) == most + 1 and "".join(p for _, p in seeds(notice, most)) == notice
        for _ in range(20):
            bad = edited(notice, r.randrange(most + 1), r)
            text = "lorem ipsum " * r.randrange(4) + bad + " dolor sit" * r.randrange(4)
            whole = regex.search(rf"(?b)(?:{regex.escape(notice)}){{e<={most}}}", text)
            found = [s for s in fuzzy_spans(text) if s[1] < whole.end() and whole.start() < s[2]]
            assert found and any(s[0] == label or s[3] <= sum(whole.fuzzy_counts) for s in found)


def test_clean_text_and_overlap():
    assert scan_text("a license to thrill, in general public opinion")[4:7] == ("", "", 0.0)
    assert scan_text("Licensed under CC BY-NC 4.0.")[5] == "cc-by-nc"
    assert scan_text("Released under the MIT License.")[4:7] == ("mit", "mit", 1.0)
    assert scan_text("Relesed under the MIT Licence.")[4:6] == ("", "mit")


def test_each_of_several_notices_is_found():
    notice = NOTICES[1][0]
    worse = notice.replace("hereby", "herebi")
    text = f"{worse} {notice} and {worse}"
    assert [s[3] for s in fuzzy_spans(text)] == [1, 0, 1]
    assert [text[a:b] for _, a, b, _ in fuzzy_spans(text)] == [worse, notice, worse]
    assert len(fuzzy_spans("gnu lesser general public licence " * 5000)) == 5000


def test_near_misses_cost_little_and_change_nothing(monkeypatch):
    """Runs of near misses, alike and each different, of 1 MB and with matches among them, against the regular expression alone."""
    r = random.Random(3)
    parts = ["released under the mit ", "license ", "licensed under the apache ", "gnu general public ", "permission is hereby granted, free ", "all rights ", "é日"]
    texts = ["".join(r.choice(parts) + "q" * r.randrange(4) for _ in range(40)) + edited(r.choice(NOTICES)[0], r.randrange(5), r) for _ in range(60)]
    quick = [fuzzy_spans(t) for t in texts]
    monkeypatch.setattr(licenses, "FEW", 10**9)
    assert [fuzzy_spans(t) for t in texts] == quick and any(quick)
    monkeypatch.undo()
    for make in (lambda: "released under the mit ", lambda: f"released under the mit {r.randrange(10**6)} ", lambda: f"license {r.randrange(10**6)} "):
        text = "".join(make() for _ in range(40_000))[:1_000_000]
        began = time.time()
        assert fuzzy_spans(text) == [] and time.time() - began < 30


def test_windows_by_edit_distances():
    r = random.Random(4)
    for _ in range(200):
        notice = "".join(r.choice("abc ") for _ in range(r.randrange(1, 12)))
        text = "".join(r.choice("abc ") for _ in range(40))
        places = sorted({(a, min(40, a + r.randrange(1, 20))) for a in r.sample(range(40), 6)})
        codes = licenses.np.frombuffer(text.encode("utf-32-le"), licenses.np.uint32)
        for edits in (0, 1, 2):
            want = [bool(regex.search(rf"(?:{regex.escape(notice)}){{e<={edits}}}", text[a:b])) for a, b in places]
            assert licenses.within(codes, places, notice, edits).tolist() == want
