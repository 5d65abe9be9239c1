import hashlib
import re
import time

from hypothesis import example, given, settings
from hypothesis import strategies as st

from sorrel.llm import pii
from sorrel.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in found.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


PIECES = st.sampled_from(["@", ".", "a", "B9", "a@b.c", "x@y", "+", "1", "255", "256", "10.0.0.1", "0001.2", "-", " ", "(", ")", "4111 1111 1111 1111",
                          "4111111111111111", "5555-5555-5555-4444", "+1 (555) 123-4567", "\u0663", "é", "\U0001d7d8", "%", "_", "\n", "://", "ü@x.de", ".5.6.7.8"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
@example("a@b.c@d.e.f@g")
@example("1.2.3.4.5.6.7.8.9.10.11")
@example("+1+1 2+12+1 3 4.")
@example("1.2.3." + "0" * 6000 + "7 1.2.3." + "9" * 6000)
def test_base_spans_are_the_patterns(text):
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == brute(text)


def test_long_runs_take_linear_time():
    for part in ("a", "a@", "1", "1.", "+1", "1 ", "DE1", "account ", "a://", "mailto:a@", "iban1"):
        text = part * (3_000 // len(part))
        assert [s for s in pii.spans(text) if s[0] in pii.BASE] == brute(text), part
        start = time.perf_counter()
        pii.spans(part * (400_000 // len(part)))
        assert time.perf_counter() - start < 5, part


def test_added_kinds():
    text = ("IBAN DE89370400440532013000, GB29 NWBK 6016 1331 9268 19; not DE88370400440532013000. Account no: 12345678-90 and account of 12 "
            "see ftp://me:pw@host.org/a, http://host.org/x@y, mailto:a.b@c.org. tel:+49-30-123456")
    found = {(k, text[s:e]) for k, s, e in pii.spans(text)}
    assert {f for f in found if f[0] in pii.ADDED} == {
        ("iban", "DE89370400440532013000"), ("iban", "GB29 NWBK 6016 1331 9268 19"), ("account", "12345678-90"), ("uri", "ftp://me:pw@host.org/a"),
        ("uri", "mailto:a.b@c.org"), ("uri", "tel:+49-30-123456")}
    assert ("email", "a.b@c.org") in found


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op12_anchored_pii"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want, r = brute(text), got[i]
        assert r["base_sha256"] == digest(want)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r["spans"].split(",")) | {""}
    assert sum(r["n_email"] for r in got.values()) > 100


def test_odd_rows_and_masking(spark):
    rows = [(1, None, "k"), (1, "", "k"), (None, "a@b.cd é\U0001d7d8 1.2.3.4", "k"), (3, "x" * 500_000 + " a@b.cd", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["spans"]) for r in pii.report(df).collect())
    assert got == [("1", 0, 0, ""), ("1", 0, 0, ""), ("3", 1, 0, "email:500001:500007"), ("None", 1, 1, "email:0:6,ip:10:17")]
    assert pii.report(df.limit(0)).count() == 0
    masked = pii.masked(df.where("doc_id is null or doc_id = 1")).collect()
    assert sorted(str(r["text"]) for r in masked) == ["", "<email> é\U0001d7d8 <ip>", "None"] and masked[0].asDict().keys() == {"doc_id", "text", "spans"}
