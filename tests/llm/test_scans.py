import hashlib
import math
import random
import re
import string
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from affinis.llm import private_data as PD
from affinis.llm import secret_scan as S
from affinis.llm.query_private import op8_private_data
from affinis.llm.query_secrets import op4_secrets
from affinis.llm.spans import code_points


def secrets_by_force(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def private_by_force(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def base(scan, text):
    data = text.encode()
    return [(s, k, e) for s, k, e, added in code_points(data, scan(data)) if not added]


def added(scan, kinds, text):
    data = text.encode()
    return [(kinds[k], text[s:e]) for s, k, e, new in code_points(data, scan(data)) if new]


words = st.lists(
    st.sampled_from(
        ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abc", "0123456789abcdef" * 2]
        + ["AKIA", "ABCDEFGH1234", "x.y/z+", "é", "ſ", "K", "\n", "f" * 40, "-"]
    ),
    max_size=14,
).map("".join)


@settings(max_examples=1500, deadline=None)
@given(words)
def test_secret_base(text):
    assert base(S.scan, text) == secrets_by_force(text)


marks = st.lists(
    st.sampled_from(
        list("ab@@..--++ ()é") + ["192", "168.", "1", "0", "255", "256", "4111 1111 1111 1111", "378282246310005", "(at)", " dot "]
    ),
    max_size=20,
).map("".join)


@settings(max_examples=1500, deadline=None)
@given(marks)
def test_private_base(text):
    assert base(PD.scan, text) == private_by_force(text)


def entropy_by_force(data, kind):
    marked = [False] * len(data)
    for i in range(len(data) - kind.window + 1):
        window = data[i : i + kind.window]
        entropy = -sum(c / kind.window * math.log2(c / kind.window) for c in Counter(window).values())
        letters = sum(c >= 65 and c != 95 for c in window)
        digits = sum(48 <= c <= 57 for c in window)
        if entropy >= kind.bits - 1e-9 and letters >= kind.letters and digits >= kind.digits:
            marked[i : i + kind.window] = [True] * kind.window
    return marked


@settings(max_examples=200, deadline=None)
@given(st.text("abc123XYZ", min_size=0, max_size=80), st.sampled_from(S.CLASSES))
def test_entropy(text, kind):
    data = text.encode()
    marked = [False] * len(data)
    for start, end in S.entropy_spans(data, kind):
        marked[start:end] = [True] * (end - start)
    assert marked == entropy_by_force(data, kind)


def test_secrets_added():
    found = added(S.scan, S.KINDS, "key é: Zx8Kq2LmP0vRt7YwNb4HcJ5d and more")
    assert found == [("base64_entropy", "Zx8Kq2LmP0vRt7YwNb4HcJ5d")]
    assert added(S.scan, S.KINDS, "x 9f86d081884c7d659a2f end") == [("hex_entropy", "9f86d081884c7d659a2f")]
    # a base span is not repeated; allowed strings and plain words are not secrets
    for clean in (
        "9f86d081884c7d659a2feaa0c55ad015",
        "550e8400-e29b-41d4-a716-446655440000",
        "sha256-Zx8Kq2LmP0vRt7YwNb4HcJ5dZx8Kq2Lm",
        "thtionereathionthanenouthingestandtheer",
        "path/to/some/module-name/version-2",
        "4929123412341234123412341234",
        "example-Zx8Kq2LmP0vRt7YwNb4HcJ5d",
    ):
        assert added(S.scan, S.KINDS, clean) == []


def test_private_added():
    cases = {
        "write john dot doe at example dot com now": [("email", "john dot doe at example dot com")],
        "é john [at] example [dot] org": [("email", "john [at] example [dot] org")],
        "jоhn@exаmple.com": [("email", "jоhn@exаmple.com")],
        "john​@example.com": [("email", "john​@example.com")],
        "ring plus one five five five one two three four five six seven": [
            ("phone", "plus one five five five one two three four five six seven")
        ],
        "4 zero one two 8888 8888 1881": [("card", "4 zero one two 8888 8888 1881")],
        "１９２．１６８．１．１": [("ip", "１９２．１６８．１．１")],
        "192 dot 168 dot 1 dot 10": [("ip", "192 dot 168 dot 1 dot 10")],
        "look at the end": [],
        "that at the dot end": [],
        "one two three four": [],
        "a@b.cd at noon": [],
        "": [],
    }
    for text, want in cases.items():
        assert added(PD.scan, PD.KINDS, text) == want, text


def test_worded_domains():
    for text in (
        "anna at example dot ch", "x at mail dot se", "x at mail dot me", "x at mail dot co dot nz", "x at mail dot example.ch",
        "x at mail [dot] anything", "x at example dot online", "x at example dot xn--p1ai", "a.b at example.com",
        "a_b at mail.example.ch", "anna dot smith at example.com", "anna [dot] smith at example.com",
    ):
        assert added(PD.scan, PD.KINDS, f"write to {text}, now") == [("email", text)], text
        assert added(PD.scan, PD.KINDS, text) == [("email", text)], text
    for text in ("more at example.com", "look at the dot then", "version 2.0 at example.com", "it. At example.com", "a.b at noon"):
        assert added(PD.scan, PD.KINDS, text) == [], text
    for text in ("a at " * 80_000, "a.b at c." * 40_000, "a at b" + " dot b" * 60_000, "a" * 99 + ".b at c.de " * 20_000):
        PD.scan(text.encode())


def test_spelled_digits():
    cases = {
        "one nine two dot one six eight dot one dot one": "ip", "one zero dot zero dot zero dot one": "ip",
        "10[dot]zero[dot]zero[dot]1": "ip", "One Nine Two (dot) 168 (dot) one (dot) one": "ip", "1.2.3.four": "ip",
        "plus one, five five five, one two three, four five six seven": "phone", "plus one\nfive five five\n123 four five six 7": "phone",
        "plus one, 555, one two three, 4567": "phone", "four zero one two,\n8888, eight eight eight eight, 1881": "card",
    }
    for text, kind in cases.items():
        assert (kind, text) in added(PD.scan, PD.KINDS, text), text
        assert (kind, text) in added(PD.scan, PD.KINDS, f"see {text}!"), text
    for text in ("one, two, three", "4012, 8888, 8888, 1881", "192, 168, 1, one", "one dot two dot three", "someone 1.2.3 four"):
        assert added(PD.scan, PD.KINDS, text) == [], text
    for text in ("one " * 80_000, "one, 1 dot " * 40_000, "1, " * 130_000, "one" + " " * 400_000, "one dot " * 60_000 + "x"):
        PD.scan(text.encode())


def test_long_texts_stay_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "token " * 80_000, "@" * 400_000, "+1" + " " * 400_000, "f" * 400_000):
        S.scan(text.encode())
        PD.scan(text.encode())


def test_frames(spark):
    text = "é token = abcdefgh1 x, mail a@b.cd"
    rows = [(1, text, "old"), (2, None, "old"), (3, "", "old"), (1, text, "old"), (None, "AKIA" + "B" * 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Secrets string")
    found = S.find_secrets(df)
    assert found.columns == ["doc_id", "text", "secrets"] and found.count() == 5
    masked = {(r["doc_id"], r["text"]) for r in S.redact(found).collect()}
    assert masked == {(1, "é [SECRET] x, mail a@b.cd"), (2, None), (3, ""), (None, "[SECRET]")}
    both = spark.createDataFrame([("é secret=0123456789abcdef0123456789abcdef end",)], "text string")
    assert S.redact(S.find_secrets(both)).first()["text"] == "é [SECRET] end"
    assert PD.find_private(df).where("size(private) > 0").count() == 2
    assert S.find_secrets(df.limit(0)).count() == PD.find_private(df.limit(0)).count() == 0


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_queries(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for query, force, kinds in ((op4_secrets, secrets_by_force, S.BASE_KINDS), (op8_private_data, private_by_force, PD.KINDS)):
        got = query(spark, sf).collect()
        assert len(got) == len(texts)
        for row in got:
            want = force(texts[row["doc_id"]])
            assert row["base_sha256"] == digest(want, kinds)
            assert [row[f"n_{kind}"] for kind in kinds] == [sum(k == i for _, k, _ in want) for i in range(len(kinds))]


def random_token(draw, alphabet, length):
    return "".join(draw.choice(alphabet) for _ in range(length))


def test_recall_of_random_secrets():
    draw, letters = random.Random(11), string.ascii_letters
    for alphabet in (letters + string.digits + "+/", letters + string.digits + "-_", letters):
        for length in (24, 32, 40):
            hits = sum(bool(S.scan(f"key {random_token(draw, alphabet, length)} end".encode())) for _ in range(600))
            assert hits >= 0.9 * 600, (alphabet, length, hits)


def test_no_false_alarms_in_prose_and_names(spark, sf):
    names = "getUserNameFromDatabaseConnection AbstractSingletonProxyFactoryBean some-long-module-name-without-digits"
    names += " src/main/java/org/example/project/controllers/UserController INTERNATIONALIZATION_OF_EVERYTHING 2024-01-15T12:00:00"
    names += " antidisestablishmentarianism-and-floccinaucinihilipilification https/www.website.org/articles/2021/november/title"
    assert added(S.scan, S.KINDS, names) == []
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = [w for r in rows for w in (r["text"] or "").split() if w.isalpha()]
    assert len(words) > 10_000 and added(S.scan, S.KINDS, " ".join(words)) == []


def test_words_that_mark_examples():
    secret = "Zx8Kq2LmP0vRt7YwNb4HcJ5d"
    for text in (f"team-example-key-{secret}", f"aws/sample/{secret}"):
        assert any(secret in found for _, found in added(S.scan, S.KINDS, text)), text
    for text in (f"example-{secret}", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"):
        assert added(S.scan, S.KINDS, text) == [], text
    draw = random.Random(12)
    long = random_token(draw, string.ascii_letters + string.digits, 4000)
    found = added(S.scan, S.KINDS, long[:2000] + "xxxx" + long[2000:])
    assert sum(len(x) for _, x in found) > 3500  # one mark does not hide a long run


def seconds_of(work):
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def test_many_spans_stay_linear(spark):
    draw = random.Random(13)
    alphabet = string.ascii_letters + string.digits
    secrets = " ".join(f"é{random_token(draw, alphabet, 24)} token={random_token(draw, alphabet, 12)}" for _ in range(40_000))
    private = " ".join(f"é jоhn{i}@exаmple.com a{i}@b.cd" for i in range(40_000))
    assert seconds_of(lambda: code_points(secrets.encode(), S.scan(secrets.encode()))) < 10
    assert seconds_of(lambda: code_points(private.encode(), PD.scan(private.encode()))) < 10
    found = S.find_secrets(spark.createDataFrame([(secrets,)], "text string"))
    assert seconds_of(lambda: S.redact(found).write.format("noop").mode("overwrite").save()) < 25


def test_long_local_parts():
    text = "x." + "y" * 100 + " at example.com"
    assert added(PD.scan, PD.KINDS, text) == [("email", text)]
