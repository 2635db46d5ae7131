"""Personal data and secrets against the plain patterns."""

import hashlib
import random
import re

from geoloom.llm import pii, secrets

PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p[-4000:]) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_parsers_agree_with_patterns_on_noise():
    rng, anchors = random.Random(3), pii.automaton()
    for _ in range(30_000):
        text = "".join(rng.choice("0123456789.. -+()@@ab_é") for _ in range(rng.randint(0, 50)))
        assert [s for s in pii.find_spans(text, anchors) if s[0] in pii.BASE_KINDS] == plain_pii(text), text


def test_further_kinds():
    anchors = pii.automaton()
    found = pii.find_spans("see ftp://joe:pw@host.example/x, IBAN: GB82 WEST 1234 5698 7654 32.", anchors)
    assert ("address", 10, 16) in found
    assert [s for s in found if s[0] == "account"] == [("account", 39, 66)]
    assert not [s for s in pii.find_spans("IBAN: GB82 WEST 1234 5698 7654 33", anchors) if s[0] == "account"]


def test_long_runs_of_digits():
    anchors = pii.automaton()
    for text in (f"1.2.3.{'0' * 6000}4", f"1.2.3.{'9' * 6000}", "7" * 30_000, "1." * 20_000, "+1" * 10_000):
        assert [s for s in pii.find_spans(text, anchors) if s[0] in pii.BASE_KINDS] == plain_pii(text), text[:20]
    assert ("ip", 0, 6007) in pii.find_spans(f"1.2.3.{'0' * 6000}4", anchors)


def test_identifiers_after_cues():
    anchors = pii.automaton()
    found = {
        "Acct No: 0012345678.": "account",
        "KONTONUMMER 123 456 789": "account",
        "iBAN=GB82WEST12345698765432": "account",
        "routing number 021000021,": "routing",
        "SSN: 123-45-6789": "ssn",
        "Social Security number is 123 45 6789": "ssn",
        "passport no. AB1234567": "passport",
        "EIN 12-3456789": "tax",
        "VAT id: DE123456789": "tax",
    }
    missed = (
        "routing number 021000022", "SSN: 666-45-6789", "SSN: 123-456-789", "accounting 0012345678", "account of 12345678 people",
        "passport office 1234567", "fein 12-3456789", "account 12345", "tax id pending", "account " + "1" * 40,
    )
    for text, kind in found.items():
        spans = [s for s in pii.find_spans(text, anchors) if s[0] == kind]
        assert len(spans) == 1 and text[spans[0][2] - 1].isalnum(), text
    for text in missed:
        assert not [s for s in pii.find_spans(text, anchors) if s[0] in pii.KINDS[5:]], text


def test_redaction_joins_overlaps():
    assert pii.redact("call +1 555 123 4567 now", [("phone", 5, 20), ("card", 6, 18)]) == "call <PHONE> now"


def test_personal_data_query_on_odd_rows(spark, odd, none):
    rows = pii.digest(pii.find_personal_data(odd)).collect()
    assert len(rows) == odd.count()
    empty = hashlib.sha256(b"").hexdigest()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].base_sha256 == empty and by_id[1].spans == "" and by_id[2].n_email == 0
    assert by_id[None].n_email == 1
    assert pii.digest(pii.find_personal_data(none)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact_documents(odd).collect()}
    assert clean[None] == "A text without an id, <EMAIL> and nothing more." and clean[1] is None


def plain_secrets(text):
    out = []
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    names = names.replace("__", "_")
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 2, m.end()))
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_secrets_agree_with_patterns_on_noise():
    rng, patterns = random.Random(5), secrets.compiled()
    pieces = ["AKIA", "A1", "token", "API_key", "=", ": ", '"', "0af3", "deadbeef", "Zz9", " ", "passwd", "x", "é", "pa\u017fsword", "to\u212aen", "SECRET", "'"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert [s for s in secrets.find_secrets_in(text, patterns) if s[0] in secrets.BASE_KINDS] == plain_secrets(text), text


def test_only_ascii_letters_have_a_case():
    patterns = secrets.compiled()
    assert not [s for s in secrets.find_secrets_in("pa\u017fsword=abcdefghijkl to\u212aen=abcdefghijkl", patterns) if s[0] == "assign"]
    assert [s[0] for s in secrets.find_secrets_in("PassWord=abcdefghijkl", patterns)] == ["assign"]


def test_entropy_is_that_of_each_window():
    import math
    from collections import Counter

    rng = random.Random(7)
    for _ in range(300):
        run = "".join(rng.choice("abcdefgh12345XYZ") for _ in range(rng.randint(20, 60)))
        hot = set()
        for i in range(len(run) - secrets.WINDOW + 1):
            w = run[i : i + secrets.WINDOW]
            h = -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())
            if h >= secrets.THRESHOLDS["alnum"] + 1e-9 and sum(c.isdigit() for c in w) >= 2 and sum(c.isalpha() for c in w) >= 2:
                hot |= set(range(i, i + len(w)))
        got = secrets.entropy_spans(run)
        covered = {i for s, e in got for i in range(s, e)}
        assert covered == hot or covered == set(range(len(run)))


def test_random_strings_are_found_and_names_are_not():
    patterns = secrets.compiled()
    assert [s[0] for s in secrets.find_secrets_in("x q7Rt0Zk3Lm9Xv2Bc8Nw1Hd5Gf4 y", patterns)] == ["entropy"]
    for fine in ("123e4567-e89b-12d3-a456-426614174000x"[:-1], "some/long/path/of-plain-words/only", "aaaaaaaaaaaaaaaaaaaaaaaa"):
        assert not [s for s in secrets.find_secrets_in(fine, patterns) if s[0] == "entropy"], fine


def test_a_base_span_inside_a_secret_does_not_hide_the_rest():
    """Only a base span around an entropy span takes its place."""
    patterns = secrets.compiled()
    token = "q7Rt0Zk3Lm9XvP" + "0a1b2c3d4e5f6789" + "Qw8Ty4Hs6Jd2Gz5"
    assert secrets.find_secrets_in(f"x {token} y", patterns) == [("entropy", 2, 47), ("hex", 16, 32)]
    covered = secrets.find_secrets_in("token=q7Rt0Zk3Lm9Xv2Bc8Nw1Hd5Gf4", patterns)
    assert [s[0] for s in covered] == ["assign"]


def test_secret_query_on_odd_rows(odd, none):
    rows = secrets.digest(secrets.find_secrets(odd)).collect()
    assert len(rows) == odd.count() and all(r.n_assign == 0 for r in rows)
    assert secrets.digest(secrets.find_secrets(none)).count() == 0
