import random
import zlib

import numpy as np

from alertweave.llm import language_id

PARTS = {"aa": "lor bin tas mek ".split(), "bb": "uze ñoq éça xix ".split(), "cc": "thy wro ght kno ".split()}


def text_of(lang, rng, n=30):
    return " ".join("".join(rng.choices(PARTS[lang], k=2)) for _ in range(n)).capitalize() + "."


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, text_of(lang, rng, rng.randint(3, 40)), lang) for i in range(n) for lang in [rng.choice(list(PARTS))]]


def frame(corpus, rows):
    return corpus.createDataFrame([(*r, "x", "x") for r in rows], "doc_id bigint, text string, lang string, score string, k string")


def test_held_out_accuracy_and_edge_rows(corpus):
    rows = rows_of(300)
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !!", "bb"), (903, text_of("aa", random.Random(2), 20_000), None),
             (904, "lortas", None), (None, rows[0][1], "aa"), (0, rows[0][1], rows[0][2])]
    got = language_id.predictions(frame(corpus, rows)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:300]}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in truth:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert {by_id[i].lang_pred for i in (900, 901, 902)} == {"und"} and by_id[900].score == 0
    assert by_id[903].lang_pred == "aa" and not by_id[None].held_out


def test_held_out_rows_are_not_learned_from(corpus):
    rows = rows_of(200)
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (sorted(map(tuple, language_id.predictions(frame(corpus, x)).collect())) for x in (rows, changed))
    assert a == b


def test_no_rows_to_learn_from(corpus):
    got = language_id.predictions(frame(corpus, [(1, "text", None), (2, None, "aa")])).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert language_id.predictions(frame(corpus, [])).count() == 0


def test_sample_is_bounded_and_even(corpus):
    rows = [(i, "t", "big") for i in range(5000)] + [(i, "t", "small") for i in range(9000, 9010)]
    ids = language_id.training_sample(frame(corpus, rows), 64).collect()
    big = [r for r in ids if r.lang == "big"]
    assert len(big) == 64 and 5 <= len(ids) - len(big) <= 10


def test_kernel_is_the_blended_spectrum():
    grams = language_id.Grams()
    a, b = set(grams.of("ab c").tolist()), set(grams.of("abX,  b").tolist())

    def plain(text):
        s = " " + "".join(c if c.isalpha() else " " for c in text).lower() + " "
        while "  " in s:
            s = s.replace("  ", " ")
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {" "}

    assert len(a & b) == len(plain("ab c") & plain("abX,  b")) and len(a) == len(plain("ab c"))
    assert grams.of("").tolist() == []


def test_a_repeated_id_gives_one_training_row(corpus):
    rows = [(1, f"the same id again {i % 7}", "en") for i in range(500)] + [(1, "...", "en"), (1, "noch ein text", "de")]
    df = corpus.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sorted((r.lang, r.doc_id, r.text) for r in language_id._rows_of(df, [(1, "en"), (1, "de")]).collect())
    assert got == [("de", 1, "noch ein text"), ("en", 1, "the same id again 0")]
    assert language_id.fit(df).marks.shape[1] == 2


def number(gram):
    h = 0
    for i, c in enumerate(gram):
        h = ((h ^ (h >> 15) if i else 0) + ord(c)) * 0x9E3779B1 % 2**32
    return h >> 14


def grams_of(text):
    s = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
    while "  " in s:
        s = s.replace("  ", " ")
    return {number(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != " "}


def brute(train, texts, landmarks):
    """Language and score of each text, from the definition, over sets of n-grams."""
    sets = {k: grams_of(t) for k, t in train.items()}
    kernel = lambda a, b: len(a & b) / (max(len(a), 1) * max(len(b), 1)) ** 0.5
    languages = sorted({lang for lang, _ in train})
    marks = [k for lang in languages for k in sorted(k for k in train if k[0] == lang)[:landmarks]]
    own = np.array([[kernel(sets[a], sets[b]) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    row = lambda g: np.r_[np.array([kernel(g, sets[m]) for m in marks]) @ root, 1]
    x = np.array([row(sets[k]) for k in sorted(train)])
    y = np.array([[1.0 if k[0] == lang else -1.0 for lang in languages] for k in sorted(train)])
    penalty = np.diag([language_id.RIDGE * len(x)] * (x.shape[1] - 1) + [1e-9])
    w = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    out = []
    for t in texts:
        margin = row(grams_of(t)) @ w
        out.append((languages[int(margin.argmax())], min(max((margin.max() + 1) / 2, 0), 1)))
    return out


def test_predictions_equal_a_plain_classifier(corpus):
    rows = rows_of(120, 5)
    df = frame(corpus, rows)
    train = {(lang, i): t for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    picked = {(r.lang, r.doc_id) for r in language_id.training_sample(
        df.filter("pmod(crc32(cast(doc_id as string)), 4) <> 2").select("doc_id", "lang")).collect()}
    want = brute({k: t for k, t in train.items() if k in picked}, [r[1] for r in rows], language_id.LANDMARKS_PER_LANGUAGE)
    got = {r.doc_id: r for r in language_id.predictions(df).collect()}
    for (i, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3


def test_rare_letters_of_many_scripts_count(corpus):
    """Two languages in each of five scripts differ only by their letters, 200 in all."""
    rng = random.Random(9)
    starts = {"latin": 0x61, "greek": 0x3B1, "cyrillic": 0x430, "hangul": 0xAC00, "han": 0x4E00}
    letters = {}
    for script, first in starts.items():
        own = [chr(c) for c in range(first, first + 60) if chr(c).isalpha() and chr(c).lower() == chr(c)]
        letters |= {f"{script}{half}": own[half::2] for half in (0, 1)}
    assert len(set(sum(letters.values(), []))) > 190
    # One script has most texts, so that its letters are the commonest by far.
    names = sorted(letters) * 12 + ["latin0", "latin1"] * 100
    rows = [(i, " ".join("".join(rng.choices(letters[n], k=4)) for _ in range(25)), n) for i, n in enumerate(names)]
    got = {r.doc_id: r for r in language_id.predictions(frame(corpus, rows)).collect()}
    held = [(got[i].lang_pred, n) for i, _, n in rows if got[i].held_out]
    assert len({n for _, n in held}) == 10 and all(a == b for a, b in held)
