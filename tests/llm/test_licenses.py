import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duolist.llm import licenses
from tests.llm import edge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PARTS = ["mit", "MIT", "license", "License", "apache", "general", "public", "x", "é", "MIT License", "general public license", "GNU General-Public\nLicense", ",", "\t", "/*", "北京", "0"]


def plain(text):
    """(n_words, starts, base labels) by going through every place."""
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    starts, labels = [], set()
    for p, label in licenses.BASE_PHRASES.items():
        own = p.split(" ")
        for i in range(len(words)):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), sorted(starts), ",".join(sorted(labels))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map(" ".join), st.sampled_from([7, 40, 1 << 20]))
def test_base_phrases_at_all_places_however_a_text_is_cut(text, at_once):
    n, hits = licenses._index(tuple(licenses.standard_templates())).scan(text.encode(), at_once)
    assert (n, sorted(h.start for h in hits if h.base), ",".join(sorted({h.label for h in hits if h.base}))) == plain(text)


@pytest.mark.parametrize("label, text", [(n[0], n[1]) for n in licenses.NOTICES])
def test_each_notice_is_found_with_its_own_label(label, text):
    index = licenses._index(tuple(licenses.standard_templates()))
    commented = "\n".join(" * " + line for line in re.findall(r".{1,50}(?:\s|$)", text))
    for own in (text, text.upper(), "some code before it " * 30 + commented + " and after it" * 30):
        whole = [h for h in index.scan(own.encode())[1] if h.end - h.start > 12]
        assert {h.label for h in whole} == {label} and max(h.similarity for h in whole) == pytest.approx(1.0)


def test_changed_notices():
    index = licenses._index(tuple(licenses.standard_templates()))
    mit = dict((n[0], n[1]) for n in licenses.NOTICES)["mit"]
    changed = mit.replace("this software and", "this very fine software and").replace("publish, ", "")
    (hit,) = [h for h in index.scan(changed.encode())[1] if not h.base]
    assert hit.label == "mit" and licenses.SIMILARITY <= hit.similarity <= 1
    assert not index.scan(mit.replace("free of charge", "for a fee").encode())[1]  # a mandatory phrase is missing
    words = mit.split()
    assert not index.scan(" ".join(sorted(words)).encode())[1]  # the same words in another order


def test_names_need_all_their_words():
    index = licenses._index(tuple(licenses.standard_templates()))
    assert {h.label for h in index.scan(b"Licensed under CC BY-NC 4.0.")[1]} == {"cc-by-nc"}
    assert not index.scan(b"under cc licensed by nc, a license of mit")[1]


def test_query_columns_equal_brute_force(spark):
    rows = edge.rows() + [(300, "Released under the MIT License. " * 3 + "GNU General Public License, Apache License", "en"), (301, "mit " * 50 + "license", None), (301, "mit " * 50 + "license", None), (302, licenses.NOTICES[0][1], "en"), (303, "x " * 3_000_000 + "MIT License", "en")]
    got = licenses.license_labels(licenses.scan(edge.documents(spark, rows))).collect()
    assert len(got) == len(rows)
    want = []
    for doc, text, _ in rows:
        n, starts, labels = plain(text)
        want.append((doc, n, len(starts), min(starts, default=None), max(starts, default=None), labels))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    of = {r.doc_id: r for r in got}
    assert of[302].labels == "mit" and of[302].base_labels == "" and of[302].score > 0.99
    assert of[300].labels == "apache,gpl,mit" and of[0].score == 0 and of[0].labels == ""
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.license_labels(licenses.scan(edge.nothing(spark))).count() == 0
