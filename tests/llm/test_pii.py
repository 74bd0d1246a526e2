import hashlib
import random
import re

import pytest

from alertweave.llm import pii

CARD = "4111 1111 1111 1111"
IBAN = "DE89370400440532013000"


def plain(text):
    """The base spans by the plain patterns, leftmost and without overlap."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def base(text):
    return [s[:3] for s in pii.spans(text) if s[0] in pii.BASE]


@pytest.mark.parametrize("text", [
    "", "a@b", "a@b.c", "é.x@y.z.", "a@b.c@d.e", "@@a@b.c", "x" * 200 + "@b.c-d.e", "a@b..c", "a@b.c.@d.e",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "1.2.3.400", "001.002.003.0004", "1.2.3", "9" * 500 + ".1.1.1",
    CARD, "4111-1111-1111-1112", "41111111111111110", "+1 (415) 555-2671", "+4915112345678901", "+1 2", "+12345678 ",
    "é+1.415.555.2671é", "1 2 3 4  5",
])
def test_base_spans(text):
    assert base(text) == plain(text)


def test_base_spans_on_random_texts():
    random.seed(3)
    for _ in range(3000):
        text = "".join(random.choice("a@.b-1 2+9(4é") for _ in range(random.randint(0, 40)))
        assert base(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1 " * 60_000, "a@" * 100_000, "-" * 200_000):
        pii.spans(text)


def test_added_kinds_need_their_check_and_context():
    spans = lambda t: [s[0] for s in pii.spans(t)]
    assert spans(f"iban {IBAN}") == ["iban"] and spans("iban DE89370400440532013001") == []
    assert spans("my ssn is 219-09-9999") == ["ssn"] and spans("see 219-09-9999 there") == []
    high, low = (pii.spans(f"{w} 10.1.2.3")[0][3] for w in ("ip address", "version"))
    assert high > low


def test_frame(docs):
    rows = [(1, None), (2, ""), (3, f"é {CARD}, a@b.co +1 415 555 2671"), (3, "x"), (None, "1.1.1.1"),
            (5, "w " * 200_000 + "a@b.c")]
    got = pii.summary(docs(rows, clash=("spans", "n_card"))).collect()
    assert len(got) == 6
    r = next(r for r in got if r.n_card)
    want = "email:23:29,card:2:21,phone:30:45"
    assert (r.n_email, r.n_phone, r.spans) == (1, 1, want)
    assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert next(r for r in got if r.doc_id == 1).spans == "" and pii.summary(docs([])).count() == 0
    df = pii.find_pii(docs([(1, "mail a@b.co or +1 415 555 2671!"), (2, "none")]))
    texts = [r[0] for r in df.orderBy("doc_id").select(pii.redact(df.text, df.spans)).collect()]
    assert texts == ["mail [email] or [phone]!", "none"]


def test_ibans_one_after_another():
    spaced = ["GB29 NWBK 6016 1331 9268 19", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606"]
    found = lambda t: [t[a:b] for a, b in pii.ibans(t)]
    for one in spaced:
        for two in spaced:
            assert found(f"{one} {two}") == [one, two]
            assert found(f"AB12 CODE {one} {two} XY34 {one}") == [one, two, one]
    assert found("AB12 CODE 34 WORDS IN CAPITALS 77 ONLY") == []
    assert found(" ".join(spaced * 2000)) == spaced * 2000
