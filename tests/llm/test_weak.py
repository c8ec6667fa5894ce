"""Operators 6 and 9 against brute force, and what they share."""

import hashlib
import random
import re
from collections import Counter

from chronolex.llm import pii, quality, weak_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def features(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_op9(spark, data, texts, odd, empty):
    rows = quality.op9_weak_quality(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = features(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.FEATURES) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    found = quality.judged(odd).collect()
    from tests.llm.conftest import ODD

    assert sorted(str((r["row"]["doc_id"], *(r[c] for c in quality.FEATURES))) for r in found) == sorted(str((d, *features(t))) for d, t in ODD)
    good = quality.good_documents(odd)
    assert good.columns == odd.columns and {r["doc_id"] for r in good.collect()} == {9, 10}
    assert quality.judged(empty).count() == 0 and quality.good_documents(empty).count() == 0


def test_held_out_quality(spark, data):
    """Most labelled documents are judged as their labels say; no label is used in fitting."""
    data = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = {k: [r["kept"] for r in quality.judged(spark.read.parquet(f"{data}/documents.parquet")).selectExpr("row.doc_id", "kept").join(labels.filter(f"quality = {k}").select("doc_id"), "doc_id").collect()] for k in (0, 1)}
    assert sum(kept[1]) >= 0.95 * len(kept[1]) and sum(kept[0]) <= 0.25 * len(kept[0])


def test_words_that_repeat(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choices("abc", k=n)) + "\n" * (k % 3) + "a b\na b") for k, n in enumerate([0, 3, 4, 5, 6, 9, 12, 40, 300])]
    found = {r["row"]["doc_id"]: tuple(r[c] for c in quality.FEATURES) for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: features(t) for k, t in rows}


def test_op6(spark, data, texts, odd, empty):
    rows = pii.op6_weak_pii(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x.startswith(f"{k}:") for x in base) for k in KINDS]
        told = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(told) and r["n_spans"] == len(told) and r["n_added"] == len(told) - len(base)
        keys = [f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'token = "([0-9a-f]{40})"', texts[r["doc_id"]] or "")]
        assert [x for x in told if x.startswith("secret:")] == keys
    masked = pii.masked_documents(odd)
    found = {r["doc_id"]: r for r in masked.collect()}
    assert masked.columns == odd.columns and found[8]["text"] == "Ünïcode 😀 <|endoftext|> don't [EMAIL] [IP]" and found[8]["n_chars"] == len(found[8]["text"])
    assert found[1]["text"] is None and found[2]["text"] == "" and found[7]["text"] == "x" * 60_000
    assert pii.masked_documents(empty).count() == 0


def test_base_spans_of_odd_texts(spark):
    rnd = random.Random(4)
    parts = ["a", "1", "23", ".", "@", "-", " ", "+", "(", ")", "_", "é", "😀", "\n", "a@b.co", "1.2.3.4", "+49 30 123456", "4111 1111 1111 1111", "b.c"]
    rows = [(k, "".join(rnd.choices(parts, k=rnd.choice([3, 12, 60])))) for k in range(400)]
    rows += list(enumerate(["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8.9 256.1.1.1 007.0.0.1", "+1 (743) 555-3824+49 30 1234567", "x" * 60_000 + "@", "1" * 60_000, "a@" + "b." * 5000, "+1" + "(" * 5000, None], 1000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["row"]: [f"{x['kind']}:{x['s']}:{x['e']}" for x in r["spans"] if x["base"]] for r in pii.candidates(df, df["text"], df["doc_id"]).collect()}
    assert found == {k: spans(t) for k, t in rows}


def test_added_spans(spark):
    rows = [(k, f"please call ({200 + k}) 555-01{k:02d} today or mail joe [at] host{k}.com") for k in range(30)] + [(100 + k, f"+1 212 555 01{k:02d} a{k}@b.com") for k in range(30)] + [(300, "order 12-345-6789 of 2020")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["row"]: r["spans"] for r in pii.accepted(pii.candidates(df, df["text"], df["doc_id"])).collect()}
    assert all(any(x["kind"] == "phone" and not x["base"] for x in found[k]) for k in range(30)) and found[300] == []


def planted(seed, n):
    """Texts with personal data in shapes that no base pattern takes, and with numbers and words that are none: (text, spans that are planted)."""
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choices("0123456789", k=k))
    name = lambda: rnd.choice("joe ann max eva tom ida".split()) + digits(2)

    def card():
        body = "4" + digits(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def good():
        kind = rnd.choice(["email", "email", "ip", "card", "phone", "phone", "secret"])
        if kind == "email":
            return kind, rnd.choice(["mail me: ", "contact ", "", "ask "]), rnd.choice([f"{name()} [at] host{digits(1)}.com", f"{name()} at site.org", f"{name()}(at)web(dot)de", f"{name()} at mail dot net", f"{name()} @ home.fr"])
        if kind == "ip":
            parts = [str(rnd.randint(11, 223)) for _ in range(4)]
            return kind, rnd.choice(["host ", "from ip ", "saw "]), rnd.choice(["[.]", " . ", "(dot)"]).join(parts)
        if kind == "card":
            c = card()
            return kind, rnd.choice(["card ", "paid by visa ", "got "]), rnd.choice([".", "/", "_"]).join(c[i : i + 4] for i in range(0, 16, 4))
        if kind == "phone":
            return kind, rnd.choice(["call ", "phone: ", "tel. ", "try "]), rnd.choice([f"({rnd.randint(201, 989)}) 555-0{digits(3)}", f"{rnd.randint(201, 989)}.{rnd.randint(201, 989)}.{digits(4)}", f"0049 30 {digits(3)} {digits(4)}", f"030 {digits(8)}"])
        return kind, rnd.choice(["token = ", "api key: ", "password="]), "".join(rnd.choices("0123456789abcdef", k=rnd.choice([32, 40])))

    def bad():
        return rnd.choice([
            f"order 1{digits(1)}-{digits(3)}-{digits(4)}", f"on 2020-0{rnd.randint(1, 9)}-1{digits(1)} 10", f"version 1 . {digits(1)} . 3 . 4", f"invoice {digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}", "look at the end.", "meet at noon dot wait",
            f"commit {''.join(rnd.choices('0123456789abcdef', k=40))}", "incomprehensibilities_everywhere", f"isbn 978-3-16-{digits(6)}-0", "see /usr/local/share/python3/dist/packages", f"id={digits(3)} {digits(3)} {digits(4)}",
        ])

    rows = []
    for k in range(n):
        text, found = "some words here", []
        for _ in range(rnd.randint(0, 3)):
            if rnd.random() < 0.5:
                kind, before, what = good()
                text += f" and {before}"
                found.append(f"{kind}:{len(text)}:{len(text) + len(what)}")
                text += what
            else:
                text += f" but {bad()}"
            text += ", then more"
        rows.append((k, text, found))
    return rows


def test_held_out_planted_spans(spark):
    """Fitted on some texts without their spans, the classifier finds nearly all that is planted in others and hardly anything else."""
    one, other = ({k: (t, f) for k, t, f in planted(seed, 800)} for seed in (1, 2))
    fit, held = (pii.candidates(df := spark.createDataFrame([(k, t) for k, (t, _) in x.items()], "doc_id long, text string"), df["text"], df["doc_id"]) for x in (one, other))
    found = {r["row"]: {f"{x['kind']}:{x['s']}:{x['e']}" for x in r["spans"] if not x["base"]} for r in pii.accepted(held, fit).collect()}
    want = {k: set(f) for k, (_, f) in other.items()}
    right, told, planted_in = (sum(len(v) for v in x.values()) for x in ({k: want[k] & found[k] for k in want}, found, want))
    print("held-out precision", right / told, "recall", right / planted_in)
    assert right >= 0.95 * told and right >= 0.9 * planted_in


def test_scan_of_many_spans(spark):
    """Spans of a text with thousands of them, at the edges of the scan's chunks too."""
    rows = [(n, " ".join(f"a{k}@b.co" for k in range(n)) + " x") for n in (255, 256, 257, 513, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["row"]: [f"{x['kind']}:{x['s']}:{x['e']}" for x in r["spans"] if x["base"]] for r in pii.candidates(df, df["text"], df["doc_id"]).collect()}
    assert found == {k: spans(t) for k, t in rows}
    assert {r["doc_id"]: r["text"] for r in pii.masked_documents(df).collect()} == {n: "[EMAIL] " * n + "x" for n, _ in rows}


def test_em_finds_reliabilities():
    rnd = random.Random(8)
    right, counts = [(0.95, 0.9), (0.7, 0.8), (0.85, 0.6)], Counter()
    for _ in range(20_000):
        y = rnd.random() < 0.7
        votes = tuple((0 if rnd.random() < 0.2 else (1 if y else -1) * (1 if rnd.random() < r[0 if y else 1] else -1)) for r in right)
        counts[votes] += 1
    got = weak_labels.estimate(sorted(counts.items()), 3)
    assert abs(got.share - 0.7) < 0.06 and all(abs(a - b) < 0.08 for x, y in zip(got.right, right, strict=True) for a, b in zip(x, y, strict=True))
    assert weak_labels.estimate([], 2).right == ((0.9, 0.9), (0.9, 0.9))
    w = weak_labels.train([((0.0,), 0.1, 100), ((1.0,), 0.9, 100)], ridge=0.001)
    assert abs(weak_labels.sigmoid(w[0]) - 0.1) < 0.01 and abs(weak_labels.sigmoid(sum(w)) - 0.9) < 0.01
