"""The battery and its false-discovery control against plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from tests.llm.test_operators import docs_of
from vigil.llm import secrets

WORDS = "get set request response element window document manager factory user account payment customer order status".split()


def brute_battery(v):
    """(z_uniform, z_runs, z_serial, p) of one candidate, or None if no encoding holds its letters."""
    found = next(((name, a, share) for name, a, share in secrets.ENCODINGS if set(v) <= set(a)), None)
    if not found:
        return None
    _, alphabet, share_hex = found
    k, n, at = len(alphabet.rstrip("=")), len(v), [alphabet.index(c) for c in v]
    chi = k * sum(c * c for c in Counter(v).values()) / n - n
    free = (k - 1) * n / (n - 1)
    z_uniform = ((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * free)) * math.sqrt(4.5 * free)
    high = [x >= k / 2 for x in at]
    up, down = sum(high), n - sum(high)
    mean = 2 * up * down / n + 1
    z_runs = (1 + sum(a != b for a, b in zip(high, high[1:], strict=False)) - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    middle = (k - 1) / 2
    z_serial = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:], strict=False)) / ((k * k - 1) / 12) / math.sqrt(n - 1)
    total = sum(secrets.LETTERS)
    gain = sum(-math.log(26 * ((1 - secrets.EVEN) * secrets.LETTERS[ord(c) - 97] / total + secrets.EVEN / 26)) for c in v.lower() if "a" <= c <= "z")
    natural = secrets.BOTH_CASES if "A" in alphabet and "a" in alphabet else secrets.CHANGES
    share = min((len(re.findall("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", v)) - 1) / (n - 1), 1 - 1e-9)
    divergence = share * math.log(max(share, 1e-9) / natural) + (1 - share) * math.log((1 - share) / (1 - natural))
    p_uniform = share_hex**n if share_hex < 1 else min(math.exp(-gain), 1.0)
    p_runs = math.exp((1 - n) * divergence) if share > natural else 1.0
    z = z_serial - secrets.SERIAL * math.sqrt(n - 1)
    p_serial = min(1 / (1 + math.exp(min(700, -1.5976 * z - 0.070565 * z**3))), 1.0)
    both = max(p_uniform * min(2 * min(p_runs, p_serial), 1.0), 1e-300)
    return z_uniform, z_runs, z_serial, min(both * (1 - math.log(both)), 1.0)


def brute_random_spans(texts):
    """Random spans of each text: candidates that no base span touches, Benjamini and Hochberg by length bin."""
    base = [re.compile(secrets.ASSIGN), re.compile(secrets.ACCESS), re.compile(secrets.HEX)]
    tested = []
    for i, t in enumerate(texts):
        taken = [m.span() for j, p in enumerate(base) for m in p.finditer(t) if j or len(m[2]) >= 8]
        for m in re.finditer(secrets.CANDIDATE, t):
            v = m[0]
            if any(a < m.end() and m.start() < b for a, b in taken) or sum(bool(re.search(c, v)) for c in ("[a-z]", "[A-Z]", "[0-9]")) < 2:
                continue
            if found := brute_battery(v):
                step = min(math.floor(-10 * math.log10(max(found[3], 1e-300))), secrets.P_STEPS)
                tested.append((i, m.span(), sum(len(v) >= x for x in secrets.LENGTH_BINS), step, found))
    out = defaultdict(list)
    for length_bin in {x[2] for x in tested}:
        own = [x for x in tested if x[2] == length_bin]
        passed = [x[3] for x in own if 10 ** (-x[3] / 10) <= secrets.FALSE_SHARE * sum(y[3] >= x[3] for y in own) / len(own)]
        for i, span, _, step, found in own:
            if passed and step >= min(passed) and all(abs(z) <= secrets.REJECT_Z for z in found[:3]):
                out[i].append(span)
    return out


def test_random_spans_equal_brute_force(spark):
    rng = random.Random(21)
    letters = {n: a.rstrip("=") for n, a, _ in secrets.ENCODINGS}
    texts = []
    for _ in range(250):
        kind = rng.choice(["hex", "HEX", "base32", "base62", "base64", "name", "name", "name", "name"])
        token = "".join(map(str.capitalize, rng.choices(WORDS, k=4))) + str(rng.randrange(99)) if kind == "name" else "".join(rng.choices(letters[kind], k=rng.randrange(18, 90)))
        texts.append(rng.choice(["see {} ok", "{}", "token={}", "a {} b AKIA" + "Q" * 14]).format(token))
    got = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("random")] for r in secrets.find_secrets(docs_of(spark, texts)).collect()}
    want = brute_random_spans(texts)
    assert {i: sorted(s) for i, s in got.items() if s} == {i: sorted(s) for i, s in want.items()} and want


def test_random_letters_are_seldom_rejected_however_few():
    rng = random.Random(5)
    for name, alphabet, _ in secrets.ENCODINGS[:4]:
        for n in (20, 24, 40, 80):
            rejected = sum(any(abs(z) > secrets.REJECT_Z for z in brute_battery("".join(rng.choices(alphabet, k=n)) + alphabet[-1] * 0)[:3]) for _ in range(2000))
            assert rejected <= 2000 * 0.012, (name, n, rejected)
