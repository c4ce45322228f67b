import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import secret_scan
from weftline.llm.queries import op10_secret_scans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
PLAIN = {"access": (re.compile("AKIA[A-Z0-9]+"), 16), "hex": (re.compile("[0-9a-f]+"), 32), "github": (re.compile("gh[pousr]_[A-Za-z0-9]+"), 40), "slack": (re.compile("xox[abprs]-[A-Za-z0-9-]+"), 24), "pem": (re.compile("-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"), 27)}
ORDER = ["assign", *PLAIN]


def brute(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for kind, (pattern, least) in PLAIN.items():
        found += [(m.start(), ORDER.index(kind), m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    return sorted(found)


def in_bytes(text: str) -> list[tuple[int, int, int]]:
    return [(len(text[:a].encode()), k, len(text[:b].encode())) for a, k, b in brute(text)]


CASES = [
    "", "password=abcdefgh", "password = 'abcdefgh'", 'PassWord": "x1234567"', "token=short", "token=token=abcdefgh", "secret:passwordtoken=12345678", "apikey=1234567 api_key=12345678",
    "AKIA1234567890ABCD", "AKIA AKIA12", "AKIAAKIA12345678", "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "g" + "f" * 31, "é password=äabcdefgh", "é token=abcdefgh é", "tokentoken=abcdefgh",
    "ghp_" + "a1B2" * 9, "xoxb-123456789012-abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "paſsword=abcdefgh", "toKen=abcdefgh", "token=abcdefgéh", "token==========", "secret: secret: abcdefghi",
]


def test_cases():
    found = secret_scan.automaton()
    for text in CASES:
        assert found.spans(text.encode()) == in_bytes(text), text


PARTS = st.sampled_from(["password", "PASSWD", "secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdefgh", "x", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "\n", "gh", "p_", "xoxb-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-", "."])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14))
def test_any_text(parts):
    text = "".join(parts)
    assert secret_scan.automaton().spans(text.encode()) == in_bytes(text)


def test_long_texts_of_spans_are_read_once(spark):
    text = "secret: secret: abcdefghi token=üabc token=abcdefgh é " * 3000
    began = time.process_time()
    assert secret_scan.automaton().spans(text.encode()) == in_bytes_once(text)
    assert time.process_time() - began < 20  # minutes, if each span began the text anew
    got = secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [(r["start"], ORDER.index(r["kind"]), r["end"]) for r in got] == brute(text)


def in_bytes_once(text):
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode()))
    return [(at[a], k, at[b]) for a, k, b in brute(text)]


def test_automaton_is_minimal_and_one():
    found = secret_scan.automaton()
    width = len(set(found.classes))
    assert len(found.step) % width == 0 and len(found.step) // width < 2000


def test_scan_and_redact(spark):
    texts = [*CASES, None, "token=abcdefgh"]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    digest = {r["doc_id"]: r for r in secret_scan.span_digest(secret_scan.scan_secrets(table)).collect()}
    clean = {r["doc_id"]: r for r in secret_scan.redact(table).collect()}
    for i, t in enumerate(texts):
        spans = [(ORDER[k], a, b) for a, k, b in brute(t or "")]
        line = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
        assert digest[i]["spans"] == line(spans)
        assert digest[i]["base_sha256"] == hashlib.sha256(line([s for s in spans if s[0] in ORDER[:3]]).encode()).hexdigest()
        assert digest[i]["n_assign"] == sum(s[0] == "assign" for s in spans)
        assert clean[i]["text"] == t if not spans else not brute(clean[i]["text"])
    assert clean[0].asDict().keys() == {"doc_id", "text", "spans"}
    assert secret_scan.scan_secrets(table.where("false")).count() == 0


def test_query_on_whole_table(spark, sf):
    got = {r["doc_id"]: r["spans"] for r in op10_secret_scans(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert got[r["doc_id"]] == ",".join(f"{ORDER[k]}:{a}:{b}" for a, k, b in brute(r["text"] or ""))
