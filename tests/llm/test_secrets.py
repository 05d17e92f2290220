import hashlib
import random
import re
import uuid

import zstandard

from tallywright.llm import registry, secrets

SCHEMA = "doc_id long, text string"


def brute_base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for k, (pattern, least) in enumerate((("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)), 1):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


RANDOM = "q8Zt3vLx0PfK2mWc9RyB7hNdJ5sG"
TEXTS = [
    None, "", "PassWord = 'abcdef' and api_key:123456, apikey=short", "token = \"" + "0a1b2c3d" * 5 + "\"", "secret: token=abcdef",
    "AKIA" + "A" * 15 + " AKIA" + "B1" * 8 + " AKIAAKIA" + "C" * 12, "f" * 23 + " " + "0123456789abcdef" * 2 + "g", "tokeſn=abcdefg paſſword=abcdefg",
    f"😀é bearer {RANDOM} tail", f"the authorization value is {RANDOM}", "session organization-administrator-connection-2database",
    f"no context here {RANDOM}", "password=" + "x" * 100_000, "token token token=abcdef=abc secret = = x", "password:\n abcdefgh",
]


def test_base_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (None, TEXTS[2])]
    got = secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), [tuple(x) for x in r.base]) for r in got) == sorted((str(i), brute_base(t)) for i, t in rows)
    for r in got:
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans)) and sorted(r.spans, key=lambda x: x.start) == r.spans


def test_novelty_adds_random_strings_in_context(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: [x.kind for x in r.spans] for r in secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[8] == ["novel"] and got[9] == ["novel"] and got[10] == [] and got[11] == []


def test_redaction_and_edges(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "1 spans", "2 BASE")
    out = secrets.redact_documents(df)
    assert out.columns == df.columns
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[0].text is None and by_id[2].text == "[ASSIGN]' and [ASSIGN], apikey=short"
    assert by_id[8].text == "😀é bearer [NOVEL] tail" and by_id[8].n_chars == len(by_id[8].text)
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.op7_secret_scan(spark, sf).collect():
        base = brute_base(docs[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in base) for k in ("assign", "access", "hex"))
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_novelty_looks_to_both_sides_and_at_every_alphabet():
    scanner = secrets.Scanner()
    words = "the quick report of the day was read by all who came there and none of them "
    letters, digits = "qWzRtkXvbNpLmJhYdGfCsKxTuEoP", "83059261744903852167"
    for value in (RANDOM, letters, digits):
        for text in ("{} # api key", "{} is the session token", "the secret of the day\n\n" + words * 2 + "\n{}", words + "passphrase {}"):
            text = text.replace("{}", value)
            at = text.index(value)
            assert [x for x in scanner.spans(text)[1] if x[2] == "novel"] == [(at, at + len(value), "novel")], text
    assert scanner.spans(f"{RANDOM} " + words * 5 + " token")[1] == []  # beyond reach
    assert scanner.spans("the session of the organization-administrator-connection")[1] == []
    glued = f"x client_secret_{RANDOM}"
    assert scanner.spans(glued)[1] == [(2, len(glued), "novel")]
    assert scanner.spans(f"x pwd={RANDOM}.")[1] == [(6, 6 + len(RANDOM), "novel")]
    for run in ("session1q9Zx7Kp3vQ8mWt5RyB", "my-session-1q9Zx7Kp3vQ8mWt5RyB"):  # whole runs, never from within a word
        assert scanner.spans(f"a {run} b")[1] == [(2, 2 + len(run), "novel")]
    assert scanner.spans("the authority_keys7a8f9b0c1d2e3f4g5h6 of an author")[1] == []  # no sensitive word
    assert scanner.spans("a tokenizer TOKENIZER 7a8f9b0c1d2e3f4g5h6")[1] == []


def test_words_of_base_spans_are_no_context_and_short_numbers_no_keys():
    scanner = secrets.Scanner()
    kinds = lambda text: [x[2] for x in scanner.spans(text)[1]]
    assert kinds(f"token=abcdef and far from it {RANDOM}") == ["assign"]  # the word is the first string's own
    assert kinds(f"token=abcdef and a session of {RANDOM}") == ["assign", "novel"]
    for number in ("4929112233445566", "4929-1122-3344-5566", "2024-01-01T10:11:12", "+49/170/1234567890"):
        assert kinds(f"the session token {number} of the day") == []
    assert kinds("the session token 83059261744903852167 of the day") == ["novel"]  # 20 digits hold a key
    assert secrets.room("0123456789abcdef") == 64 and secrets.room("4929-1122-3344-5566") < 54 and secrets.room("") == 0


def test_very_many_spans_take_linear_time():
    import time

    scanner, took = secrets.Scanner(), []
    for n in (3_000, 30_000):
        text = "".join(f"token=abcdef{k} some words {k} session {k:016x}zQ\n" for k in range(n))
        began = time.perf_counter()
        spans = scanner.spans(text)[1]
        took.append(time.perf_counter() - began)
        assert sum(x[2] == "assign" for x in spans) == n
    assert took[1] < 30 * took[0]


def brute_novel(text, dictionary):
    """The spans by definition, run by run and word by word, with a compressor of its own."""
    whole = f"{dictionary} {secrets.IDENTIFIERS}".encode()
    size = lambda raw: len(zstandard.ZstdCompressor(
        level=9, dict_data=zstandard.ZstdCompressionDict(whole, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False
    ).compress(raw))
    base = brute_base(text)
    words = [m.span() for m in re.finditer(secrets.SENSITIVE, text, re.A) if not any(a < m.end() and m.start() < b for _, a, b in base)]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=.-]+", text):
        s, e = m.start(), m.start() + len(m[0].rstrip("."))
        if len(m[0]) < 16 or not any(x <= e + 256 and y >= s - 256 for x, y in words) or any(a < e and s < b for _, a, b in base):
            continue
        s = max([s] + [y + 1 for x, y in words if s <= x and y < e and text[y] == "="])
        known = sum(y - x for x, y in words if s <= x and y <= e)
        around = (text[max(0, s - 512) : s] + text[e : e + 512]).encode()
        if e - s >= 16 and secrets.room(text[s:e]) >= 64 and size(around + text[s:e].encode()) - size(around) >= secrets.MIN_NOVELTY * max(8, e - s - known):
            out.append(("novel", s, e))
    return out


def _planted():
    rng = random.Random(5)
    docs = [r.text for r in DOCS]
    of = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    letters, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    words = "user account config database connection manager service request handler response controller factory builder provider".split()
    keys = [lambda: of(digits + "abcdef", rng.randint(16, 23)), lambda: of(letters + digits + "+/", rng.randint(20, 44)), lambda: of(letters + digits, 24),
            lambda: str(uuid.UUID(int=rng.getrandbits(128))), lambda: "eyJhbGciOiJIUzI1NiJ9." + of(letters + digits + "-_", 60) + "." + of(letters + digits + "-_", 43)]
    plain = [lambda: "_".join(rng.sample(words, 3)), lambda: "".join(w.title() for w in rng.sample(words, 3)), lambda: "/" + "/".join(rng.sample(words, 3)) + ".py"]
    out = []
    for i in range(400):
        make = (keys if i % 2 else plain)[i // 2 % (5 if i % 2 else 3)]
        text, value = rng.choice(docs), make()
        if len(value) < 16:
            continue
        at = rng.randint(0, len(text))
        lead = rng.choice([" the session token is ", " bearer ", " credentials for this are "])
        out.append((text[:at] + lead + value + " " + text[at:], at + len(lead), value, bool(i % 2)))
    return out


def test_planted_keys_and_identifiers(spark):
    """Precision and recall of the method on keys and ordinary identifiers, both in sensitive context, against a second computation."""
    global DOCS
    DOCS = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 300 and 4000").collect()
    planted = _planted()
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(planted)], SCHEMA)
    dictionary = secrets.corpus_identifiers(df)
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in secrets.scan_secrets(df).collect()}
    caught = wrong = 0
    for i, (text, at, value, is_key) in enumerate(planted):
        assert [x for x in got[i] if x[0] == "novel"] == brute_novel(text, dictionary)
        hit = any(s <= at and at + len(value) <= e for _, s, e in got[i])
        caught += hit and is_key
        wrong += hit and not is_key
    n_keys = sum(x[3] for x in planted)
    assert caught >= 0.95 * n_keys and wrong <= 0.1 * (len(planted) - n_keys), (caught, n_keys, wrong, len(planted))


def test_dictionary_is_counted_over_all_rows(spark):
    long, rare = "organization_administratorConnection", "a_long_name_that_stands_on_one_row"
    rows = [(i, f"see {long} and x{long} {long}9") for i in range(5)] + [(9, f"{rare} {rare}"), (10, None), (11, "another/path/of/URL"), (12, "another/path/of/URL")]
    got = secrets.corpus_identifiers(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert got == "path of another URL xorganization organization administrator Connection"
    assert secrets.corpus_identifiers(spark.createDataFrame([], SCHEMA)) == ""
