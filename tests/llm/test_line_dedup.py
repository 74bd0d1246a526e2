import hashlib
import random

import numpy as np

from alertweave.llm import line_dedup


def brute(rows):
    """(kept, lines, dropped) by id, from the definition."""
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10 and i is not None:
                holders.setdefault(key(s), set()).add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [p for p in parts if i is None or len(holders.get(key(p), ())) < 2 or i == min(holders[key(p)])]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=repr)


ROWS = [
    (1, "A shared line here\nown line of one\nshort"), (2, "  a SHARED line here\t\nshort\n"),
    (3, None), (4, ""), (5, "ÉÉÉÉÉÉÉÉÉÉ\nééééééééééé"), (6, "ÉÉÉÉÉÉÉÉÉÉ"), (7, "ééééééééé"), (8, "ééééééééé"),
    (9, "twice in one doc\ntwice in one doc"), (10, "same row of text"), (10, "same row of text"),
    (None, "a shared line here"), (11, "x" * 300_000 + "\n" + "a shared line here"), (12, "x" * 300_000),
    (13, "a shared line here\r\n\x0c\na shared line here"), (14, " a shared line here"),
]


def result(df):
    out = line_dedup.dedup_lines(df).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out), key=repr)


def test_equals_brute_force(docs):
    assert result(docs(ROWS, clash=("n_lines", "_lost", "digest"))) == brute(ROWS)


def test_random_texts(docs):
    random.seed(5)
    lines = ["line number %d of all" % (i % 40) for i in range(60)] + ["tiny", "", "  "]
    rows = [(i, "\n".join(random.choices(lines, k=random.randint(0, 12)))) for i in range(150)]
    assert result(docs(rows)) == brute(rows)


def test_a_full_filter_changes_no_result(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "filter_size", lambda lines: 256)
    assert result(docs(ROWS)) == brute(ROWS)


def test_only_suspects_leave_the_scan(docs):
    rows = [(i, f"a line that only document {i} has") for i in range(400)] + [(900, "one more shared line"), (901, "one more shared line")]
    df = docs(rows)
    packed, bits = line_dedup.twice_seen(df)
    found = line_dedup.suspects(df, packed, bits).collect()
    assert {900, 901} <= {r.doc_id for r in found} and len(found) < 40
    ones = np.unpackbits(np.frombuffer(packed, "u1")).sum()
    assert 1 <= ones < 60


def test_digests_and_empty_table(docs):
    got = {r.doc_id: r for r in line_dedup.digests(docs(ROWS[:4])).collect()}
    assert got[2].kept_sha256 == hashlib.sha256(b"short\n").hexdigest() and got[2].n_dropped == 1
    assert got[3].n_lines == 1 and got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert line_dedup.digests(docs([])).count() == 0
