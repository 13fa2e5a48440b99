"""Personal data that is planted, decoys, and the patterns against scans of single characters."""

import random

from loomgraph.llm import pii

D = "0123456789"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def card(rng, n=16):
    head = "".join(rng.choice(D) for _ in range(n - 1))
    return next(head + d for d in D if luhn(head + d))


def scan(text):
    """Spans of cards, phones and addresses, leftmost and as long as can be, by hand."""
    out, i = [], 0
    while i < len(text):  # cards: digits, perhaps a space or hyphen between two
        j = i
        if text[i] in D:
            j = i + 1
            while j < len(text) and (text[j] in D or (text[j] in " -" and text[j + 1 : j + 2] and text[j + 1] in D)):
                j += 1 if text[j] in D else 2
            digits = [c for c in text[i:j] if c in D]
            if 13 <= len(digits) <= 19 and luhn("".join(digits)):
                out.append(("card", i, j))
        i = max(j, i + 1)
    i = 0
    while i < len(text):  # phones: a plus, a digit, a run, back to its last digit
        j = i
        if text[i] == "+" and text[i + 1 : i + 2] and text[i + 1] in D:
            j = i + 2
            while j < len(text) and text[j] in D + " ().-":
                j += 1
            while j > i + 3 and text[j - 1] not in D:
                j -= 1
            if j > i + 3 and text[j - 1] in D:
                if 9 <= sum(c in D for c in text[i:j]) <= 15:
                    out.append(("phone", i, j))
            else:
                j = i
        i = max(j, i + 1)
    return out


def test_patterns_against_scans():
    rng = random.Random(6)
    for _ in range(3000):
        parts = [rng.choice(["+", "(", ") ", "-", " ", ".", "x", "é", "\n", card(rng), card(rng, 13), "+49", "555", "12345", "0"]) for _ in range(rng.randint(1, 9))]
        text = "".join(parts)
        text = "".join(c + (rng.choice(["", "", "", " ", "-"]) if c in D else "") for c in text)
        want = scan(text)
        assert [s for s in pii.base_spans(text) if s[0] in ("card", "phone")] == want, text


def test_decoys_are_not_added():
    rng = random.Random(7)
    good, bad = 0, 0
    for _ in range(300):
        n = card(rng)
        spaced = rng.choice([f"{n[:4]}.{n[4:8]}.{n[8:12]}.{n[12:]}", f"{n[:4]}/{n[4:8]}/{n[8:12]}/{n[12:]}", f"{n[:4]}  {n[4:8]}  {n[8:12]}  {n[12:]}"])
        good += pii.plausible(spaced, ("card", 0, len(spaced))) is not None
        wrong = n[:-1] + str((int(n[-1]) + rng.randint(1, 9)) % 10)
        pieces = [wrong, n[:5] + "a" + n[5:], "".join(rng.choice("0123456789abcdef") for _ in range(15)) + "f"]
        bad += sum(pii.plausible(x, ("card", 0, len(x))) is not None for x in pieces)
    assert good == 300 and bad == 0
    assert pii.plausible("1.2.3.999", ("ip", 0, 9)) is None and pii.plausible("a1.2.3.4", ("ip", 0, 8)) is None and pii.plausible("10.2.3.4 ", ("ip", 0, 9)) == ("ip", 0, 8)
    assert pii.plausible("030/1234-5678", ("phone", 0, 13)) and pii.plausible("12345678x90", ("phone", 0, 11)) is None


def test_stretches_that_overlap_nothing():
    rng = random.Random(8)
    for _ in range(300):
        spans = [("card", a, a + rng.randint(1, 6)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 6)))]
        apart = pii._apart(spans)
        for a in range(45):
            for b in range(a + 1, a + 5):
                assert apart(a, b) == all(b <= x or y <= a for _, x, y in spans)


def test_windows_without_a_digit_or_at_decode_to_nothing(monkeypatch):
    rng = random.Random(9)
    words = ["call", "mail", "the", "server", "card", "is", "from", "Monday", "to", "és"]
    made = []
    for _ in range(160):
        planted = rng.choice([f"a{rng.randint(1, 99)}@mail.example.org", ".".join(str(rng.randint(0, 255)) for _ in range(4)), card(rng), f"+49 {rng.randint(100, 999)} {rng.randint(100000, 999999)}"])
        made.append(" ".join([*(rng.choice(words) for _ in range(25)), planted, *(rng.choice(words) for _ in range(25))]))
    tagger = pii.Tagger().fit(*pii.labelled_windows(made[:110]), epochs=12)
    some = [two for _, two in pii.all_spans(made[110:], tagger)]
    monkeypatch.setattr(pii, "windows_of", lambda text: list(range((len(text) - 1) // pii.STRIDE + 1)))
    assert [two for _, two in pii.all_spans(made[110:], tagger)] == some
