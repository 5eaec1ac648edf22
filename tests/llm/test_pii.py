import hashlib
import re
import time

from ledgerloom.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        spans += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if _holds(kind, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]


CARD = "4539 1488 0343 6467"
TEXTS = [
    None, "", "plain words only", "mail a.b+c@x-y.co.uk, now", "a@b-c.d%x@y.z and q@r", "x@y@z.com", "1.2.3.4.5.6.7.8", "256.1.1.1 10.0.0.255",
    "0001.002.3.4", f"card {CARD} ok", "4539148803436468", CARD.replace(" ", "-") + "-1", "9" * 25, "+1 (555) 123-4567 x", "+12 34", "++44 20 7946 0958)",
    "tel+491701234567890123", "é" * 70 + " jo@é.com jo@e.com " + "ü" * 5, "12 34 56 78 90 12 34 56", "a" * 20000 + "@" + "b" * 10, "1" * 30000, "1 " * 9000,
    "x@" + "a." * 5000 + "b", f"\n{CARD}\t+442079460958 10.1.2.3 me@here.org",
]


def test_base_spans_equal_plain_search(documents):
    docs = documents([(i, t) for i, t in enumerate(TEXTS)])
    found = {r["doc_id"]: r for r in pii.digests(pii.detected(docs)).collect()}
    for i, text in enumerate(TEXTS):
        want, got = brute(text), found[i]
        assert [s for s in got["spans"].split(",") if s and not s.startswith("term")] == want, (i, want, got["spans"])
        assert got["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[f"n_{k}"] for k in KINDS] == [sum(s.startswith(f"{k}:") for s in want) for k in KINDS]


def test_terms_that_give_an_entity_away(documents):
    told = [(i, f"Ask Zebulon via zeb@corp.example about the report {i}") for i in range(6)]
    other = [(100 + i, f"the report about things number{i} via post, ask away") for i in range(40)]
    docs = documents(told + other)
    found = {r["doc_id"]: r["spans"] for r in pii.digests(pii.detected(docs)).collect()}
    for i, text in told:
        at = text.index("Zebulon")
        assert f"term:{at}:{at + 7}" in found[i].split(",")
        assert f"term:{text.index('report')}" not in found[i]
    assert all(found[i] == "" for i, _ in other)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitized(docs).collect()}
    assert clean[0] == "Ask [TERM] via [EMAIL] about the report 0" and clean[100] == other[0][1]
    assert pii.sanitized(docs).columns == docs.columns


def test_rare_and_repeated_rows(documents):
    docs = documents([(1, "only one me@here.org Quixotic"), (1, "only one me@here.org Quixotic"), (None, "me@there.org")])
    found = pii.digests(pii.detected(docs)).collect()
    assert len(found) == 3 and all("term" not in r["spans"] for r in found)
    assert pii.digests(pii.detected(documents([]))).count() == 0


def test_terms_far_from_their_entity_and_without_it(documents):
    far = " filler" * 30
    told = [(i, f"Zebulon wrote{far} to zeb@corp.example and ZEBULON signed") for i in range(20)]
    other = [(100 + i, f"plain words number {i} and{far}, wrote, signed") for i in range(40)] + [(200, "İst. Zebulon éZebulon, zebulon corp")]
    docs = documents(told + other)
    found = {r["doc_id"]: r["spans"].split(",") for r in pii.digests(pii.detected(docs)).collect()}
    at = told[0][1].index("zeb@")
    for i, text in told:
        last = text.index("ZEBULON")
        assert found[i] == ["term:0:7", f"email:{at}:{at + 16}", f"term:{last}:{last + 7}"]
    assert found[200] == ["term:5:12", "term:23:30"]
    assert all(found[i] == [""] for i in range(100, 140))


def test_a_long_text_full_of_addresses(documents):
    """Fifty thousand addresses in one text, some of them terms' entities, in seconds."""
    text = " ".join(f"user{i}@host{i % 7}.example {i % 250}.0.0.{i % 200} Line{chr(97 + i % 26)}" for i in range(50_000))
    docs = documents([(1, text), (2, text[:3000]), (3, "z" * 300_000)])
    began = time.perf_counter()
    found = {r["doc_id"]: r for r in pii.digests(pii.detected(docs)).collect()}
    assert time.perf_counter() - began < 60
    assert (found[1]["n_email"], found[1]["n_ip"]) == (50_000, 50_000) and found[3]["spans"] == ""
    assert found[1]["base_sha256"] == hashlib.sha256(",".join(brute(text)).encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitized(docs).collect()}
    assert clean[1] == re.sub(r"\S+@\S+", "[EMAIL]", re.sub(r"\d+\.0\.0\.\d+", "[IP]", text)) and clean[3] == "z" * 300_000


def test_sanitized_text_of_overlapping_spans(documents):
    text = "\0\1 me@1.2.3.4 and +1 10.1.2.33 4444 then " + "é𝒳" * 5000 + " a@b.c" + "\n" * 5000 + "end a@b.c"
    (clean,) = pii.sanitized(documents([(1, text)])).collect()
    assert clean["text"] == text.replace("me@1.2.3.4", "[EMAIL]").replace("+1 10.1.2.33 4444", "[PHONE]").replace("a@b.c", "[EMAIL]")
