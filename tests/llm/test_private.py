import re

from hypothesis import given, settings, strategies as st

from odd_rows import ODD, by_row, frame
from tablelore.llm import disclosure

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    def fine(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and disclosure.luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15
    spans = [(m.start(), k, m.end()) for k, p in PATTERNS for m in re.finditer(p, text) if fine(k, m[0])]
    return sorted(spans, key=lambda x: (x[0], disclosure.BASE.index(x[1])))


@settings(max_examples=500, deadline=None)
@given(st.text("ab1290@.+-() é", max_size=40))
def test_base_spans_match_the_plain_patterns(text):
    assert disclosure.base_spans(text) == plain_spans(text)


def test_known_numbers():
    text = "x 4111 1111 1111 1111 y 4111111111111112 +1 (988) 555-2485, 1.2.3.4.5 256.1.1.1 01.002.3.255 a@b.c.d@e.f"
    assert disclosure.base_spans(text) == plain_spans(text)
    assert {k for _, k, _ in disclosure.base_spans(text)} == set(disclosure.BASE)


FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def entity_rows():
    """The name Zyzzyx stands only near one address, in three contexts; other words stand everywhere."""
    rows = [(100 + k, f"{FILLER[k]} {FILLER[k + 1]} Zyzzyx {FILLER[k + 2]} mail p.q@example.com {FILLER[k + 3]} {FILLER[k + 4]}")
            for k in range(3)]
    return rows + [(200 + k, " ".join(FILLER[k % 8:] + FILLER[:k % 8] + ["mail"])) for k in range(60)]


def test_disclosing_terms_are_removed_and_common_ones_stay(spark):
    rows = entity_rows() + ODD
    found = {r.doc_id: r.spans for r in disclosure.private_spans(frame(spark, rows)).collect()}
    texts = dict(rows)
    for k in range(3):
        spans = {(x.kind, texts[100 + k][x.start:x.end]) for x in found[100 + k]}
        assert spans == {("email", "p.q@example.com"), ("removed", "Zyzzyx")}
    assert all(not found[i] for i in range(200, 260)) and len(found) == len({i for i, _ in rows})


def test_copies_are_no_evidence(spark):
    rows = [(k, "Zyzzyx wrote to p.q@example.com at once today") for k in range(50)] + [(99, "another text"), (98, "wrote to at once")]
    assert {x.kind for r in disclosure.private_spans(frame(spark, rows)).collect() for x in r.spans} == {"email"}


def test_sanitised_rows_keep_their_columns(spark):
    docs = frame(spark, entity_rows() + ODD)
    made = disclosure.sanitised(docs)
    assert made.columns == docs.columns and made.count() == docs.count()
    texts = dict(by_row(made.filter("doc_id >= 100"), "doc_id", "text"))
    assert texts[100] == "lorem ipsum  dolor mail [EMAIL] sit amet"
    assert by_row(made.filter("doc_id < 100 OR doc_id IS NULL"), "doc_id", "text") == sorted(ODD, key=repr)
    assert disclosure.sanitised(frame(spark, [])).count() == 0


def test_disclosing_terms_go_from_the_whole_text(spark):
    far = " ".join(FILLER * 9)
    near = [(400 + k, f"{FILLER[k]} {FILLER[k + 1]} Zyzzyx {FILLER[k + 2]} mail p.q@example.com {FILLER[k + 3]}") for k in range(8)]
    rows = near + [(1000 + k, f"mail {k} {FILLER[k % 12]} {FILLER[k % 11]}") for k in range(500)] + [(300, f"Zyzzyx {far} write to P.Q@example.com or a@b.cc {far} by zyzzyx, Zyzzyx."), (301, "a@b.cc knows Zyzzyx")]
    found = {r.doc_id: r.spans for r in disclosure.private_spans(frame(spark, rows)).collect()}
    assert [dict(rows)[300][x.start:x.end] for x in sorted(found[300]) if x.kind in ("removed", "general")] == ["Zyzzyx", "zyzzyx", "Zyzzyx"]
    assert [x.kind for x in found[301]] == ["email"]
    texts = dict(by_row(disclosure.sanitised(frame(spark, rows)), "doc_id", "text"))
    assert "zyzzyx" not in texts[300].lower() and texts[300].count("[EMAIL]") == 2


def test_copies_of_each_text_change_no_span(spark):
    once = [*entity_rows(), *((1000 + k, f"mail {k} {FILLER[k % 12]} {FILLER[k % 11]}") for k in range(100)), (9, None), (10, "")]
    copied = [(i, t) for i, t in once for _ in range(100)]
    plain, repeated = (by_row(disclosure.private_spans(frame(spark, x)), "doc_id", "spans") for x in (once, copied))
    assert sum(any(x.kind == "removed" for x in spans) for _, spans in plain) == 3
    assert repeated == [x for x in plain for _ in range(100)]


def test_near_words_are_whole_and_may_be_far():
    long = "x" * 405
    text = f"{long} a@b.org " + "1" * 3000 + " later wordé"
    spans = disclosure.base_spans(text)
    found = disclosure.near_terms(text, [s for s in spans if s[1] == "email"])
    assert {x[2] for x in found} == {long, "later", "wordé"}
    touching = "name@site.comé after"
    assert {x[2] for x in disclosure.near_terms(touching, disclosure.base_spans(touching))} == {"after"}
