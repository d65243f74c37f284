import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import pii

DIGITS = re.compile("[^0-9]")
BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(DIGITS.sub("", m)) <= 19 and luhn(DIGITS.sub("", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(DIGITS.sub("", m)) <= 15),
)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(BASE) for m in re.finditer(p, text) if good(m.group()))


@settings(max_examples=500, deadline=None)
@given(st.text("ab@@..1234509 -+()_%é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text)[0] == brute(text)


def test_long_texts_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1.1." * 50_000, "+1" + " " * 200_000, "@" * 100_000, "key " * 50_000, "token=" * 40_000, "A " * 100_000, "Anna " * 40_000, "AB12 " * 40_000, "1 Aa " * 40_000, "account" * 30_000, "f" * 200_000, "eyJ." * 50_000, "Mr. " * 50_000):
        pii.spans_of(text)


TEXTS = [
    "write to jo.doe@example.com or call +1 (040) 555-0631 now", "host 10.0.0.1 and 300.1.1.1", "card 4539 1488 0343 6467, not 4539 1488 0343 6468",
    "a@b@c.d e@f", "tel 040 555 0631", "reach me: jo (at) example (dot) com", "é" * 10 + " x@y.org", "", None, "version 1.2.3.4 of it", "+12 345-678-9012 3",
]


def test_whole_operator(spark, docs, rows, nothing):
    frame = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(1000 + i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, score string"))
    every = [*((r[0], r[1]) for r in rows), *((1000 + i, t) for i, t in enumerate(TEXTS))]
    got = pii.find_personal_data(frame).collect()
    assert len(got) == len(every)
    written = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    key = lambda r: tuple(map(str, r))
    expected = [(i, *(sum(s[1] == k for s in brute(t or "")) for k in range(4)), written(brute(t or ""))) for i, t in every]
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in got), key=key) == sorted(expected, key=key)
    for r in got:
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))
    assert pii.find_personal_data(nothing).count() == 0


def logistic(x, target, ridge=1.0):
    """By gradient steps with momentum, until nothing moves."""
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    step = 1 / (ridge + 0.25 * np.linalg.norm(x, 2) ** 2)
    for t in range(200_000):
        ahead = w + (t / (t + 3)) * speed
        gradient = x.T @ (1 / (1 + np.exp(-x @ ahead)) - target) + ridge * ahead
        new = ahead - step * gradient
        speed, w = new - w, new
        if np.abs(gradient).max() < 1e-10:
            break
    return w


def brute_spans(every):
    """All of it without Spark: votes counted span by span, expectation-maximisation in loops over labelers, and the classifier."""
    found, out = [], []
    for d, (_, text) in enumerate(every):
        for base, spans in zip((True, False), pii.spans_of(text or ""), strict=True):
            for a, k, b, pattern in spans:
                said = pii.votes(text, a, k, b, pattern)
                found.append((d, base, a, k, b, said, pii.features(text, a, b, said)))
    accepted = set()
    for kind in range(len(pii.KINDS)):
        mine = [f for f in found if f[3] == kind]
        if not mine:
            continue
        p = [1 / (1 + np.exp(-float(sum(f[5])))) for f in mine]
        for _ in range(50):
            total = [sum(1 - x for x in p), sum(p)]
            table = [[{v: (sum((x if k else 1 - x) for x, f in zip(p, mine, strict=True) if f[5][j] == v) + pii.BELIEF[k][v + 1]) / (total[k] + 6) for v in (-1, 0, 1)} for j in range(len(pii.LABELERS))] for k in (0, 1)]
            prior = (total[1] + 1) / (len(mine) + 2)
            like = [[(prior if k else 1 - prior) * np.prod([table[k][j][v] for j, v in enumerate(f[5])]) for k in (0, 1)] for f in mine]
            p = [b / (a + b) for a, b in like]
        x = np.zeros((len(mine), pii.FEATURES))
        for i, f in enumerate(mine):
            x[i, f[6]] = 1
        margin = x @ logistic(x, np.array(p))
        assert np.abs(margin).min() > 1e-6  # no span is a matter of rounding
        accepted |= {f[:5] for f, z in zip(mine, margin, strict=True) if z >= 0}
    for d, (i, _) in enumerate(every):
        spans = sorted((f[2], f[3], f[4]) for f in found if f[0] == d and (f[1] or f[:5] in accepted))
        out.append((i, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans), len(spans)))
    return out


def planted(seed=7, size=700):
    """Texts of made-up words with personal data (text, kind, span), and with what only looks like it (kind, but no span to find)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    given, street = sorted(pii.GIVEN_NAMES), ("Street", "Avenue", "Road", "Lane")

    def iban(good):
        while True:
            text = f"DE{digits(2)}{digits(18)}"
            if (int(text[4:] + "1314" + text[2:4]) % 97 == 1) == good:
                return " ".join(text[i : i + 4] for i in range(0, len(text), 4))

    good = {
        "email": lambda: ("contact ", rng.choice([f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}.org"])),
        "ip": lambda: ("host ", ".".join(str(rng.randint(11, 255)) for _ in range(4)).replace(".", "[.]")),
        "card": lambda: ("card ", "4539.1488.0343.6467"),
        "phone": lambda: (rng.choice(["tel ", "call "]), f"({digits(3)}) {digits(3)}-{digits(4)}"),
        "secret": lambda: rng.choice([("token = ", hexes(40)), ("api_key: ", hexes(32)), ("password=", f"{word()}{digits(6)}{word()}{digits(3)}X"), ("Bearer ", "ghp_" + hexes(36))]),
        "account": lambda: ("IBAN ", iban(True)),
        "name": lambda: (rng.choice(["Mr. ", "my name is ", "signed ", ""]), f"{rng.choice(given)} {word().title()}"),
        "street": lambda: (rng.choice(["I live at ", "ship to "]), rng.choice([f"{rng.randint(1, 999)} {word().title()} {rng.choice(street)}", f"{word().title()}straße {rng.randint(1, 99)}"])),
    }
    bad = {
        "ip": lambda: f"version {rng.randint(300, 999)}.1.2.3", "card": lambda: f"tracking 4539148803436{rng.choice(['468', '469', '461'])}", "secret": lambda: rng.choice([f"commit {hexes(40)}", f"md5 {hexes(32)}", "password = changeme", "token: example"]),
        "account": lambda: f"order {iban(False)}", "name": lambda: rng.choice([f"the {word().title()} {word().title()}", f"{word().title()}. {word().title()} {word()}"]), "street": lambda: f"{digits(2)} {word()} {word()}", "phone": lambda: f"part {digits(3)} {digits(2)}", "email": lambda: f"{word()} at {word()}",
    }
    rows, truth = [], []
    for i in range(size):
        text, spans = " ".join(word() for _ in range(rng.randint(3, 30))) + " ", []
        for _ in range(rng.randint(0, 3)):
            if rng.random() < 0.6:
                kind = rng.choice(list(good))
                before, span = good[kind]()
                text += before
                spans.append((kind, len(text), len(text) + len(span)))
                text += span + rng.choice([" ", ", ", "; "])
            else:
                text += bad[rng.choice(list(bad))]() + " "
            text += " ".join(word() for _ in range(rng.randint(3, 12))) + " "
        rows.append((i, text))
        truth.append(spans)
    return rows, truth


def test_spans_against_brute_force(spark, docs, rows):
    every = [*((r[0], r[1]) for r in rows), *((1000 + i, t) for i, t in enumerate(TEXTS)), *((2000 + i, t) for i, t in planted(3, 150)[0])]
    frame = spark.createDataFrame(every, "doc_id long, text string").repartition(5)
    key = lambda r: tuple(map(str, r))
    got = pii.find_personal_data(frame).select("doc_id", "spans", "n_spans").collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_spans(every), key=key)


def test_planted_data_is_found(spark):
    """Precision and recall of every kind, over what the base patterns find and what the method adds."""
    rows, truth = planted()
    found = {r.doc_id: [x.split(":") for x in filter(None, r.spans.split(","))] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in pii.KINDS:
        real = {(d, a, b) for d, spans in enumerate(truth) for k, a, b in spans if k == kind}
        said = {(d, int(a), int(b)) for d, spans in found.items() for k, a, b in spans if k == kind}
        right = len(real & said)
        print(kind, len(real), len(said), round(right / len(said), 3), round(right / len(real), 3))
        assert right >= 0.9 * len(said) and right >= 0.9 * len(real), kind


def test_reliabilities_find_the_classes():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    said = np.zeros((4000, len(pii.LABELERS)), int)
    for j, good in enumerate((0.95, 0.85, 0.8, 0.75, 0.7, 0.5, 0.6)):
        right = rng.random(4000) < good
        said[:, j] = np.where(right, np.where(truth, 1, -1), np.where(truth, -1, 1)) * (rng.random(4000) < 0.9)
    patterns, counts = np.unique(said, axis=0, return_counts=True)
    p, table = pii.reliabilities(patterns, counts.astype(float))
    found = {tuple(r): x for r, x in zip(patterns.tolist(), p, strict=True)}
    assert np.mean([(found[tuple(r)] > 0.5) == t for r, t in zip(said.tolist(), truth, strict=True)]) > 0.93
    speaks = table[1, :, 2] / (table[1, :, 2] + table[1, :, 0])
    assert speaks[0] > speaks[3] > speaks[5] - 0.05


def test_codes_round_trip():
    votes = [[a, b, c, d, e, f, g] for a in (-1, 0, 1) for b in (-1, 1) for c in (0,) for d in (0, 1) for e in (-1, 0) for f in (-1, 1) for g in (-1, 0, 1)]
    codes = np.array([pii.code_of(v) for v in votes])
    assert codes.max() < pii.CODES and len(set(codes.tolist())) == len(codes)
    assert pii.votes_of(codes).tolist() == votes
    for text in ("x", "a " * 30, "9" * 25, "É@x.y"):
        found = pii.features("before " + text, 7, 7 + len(text), votes[0])
        assert len(set(found)) == len(found) and max(found) < pii.FEATURES


def test_invalid_bytes(spark):
    frame = spark.sql("select 1L doc_id, cast(unhex('6A6F406578616D706C652E636F6D20FFFE') as string) text")
    assert [(r.n_email, r.spans) for r in pii.find_personal_data(frame).collect()] == [(1, "email:0:14")]
