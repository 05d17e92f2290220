from tallywright.llm import license as lic
from tallywright.llm import registry

from .test_decontam import words


def shingles(text):
    w = words(text)
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text):
    """Containment over every window of every level, without retrieval."""
    own, out = shingles(text), {}
    for name, t in lic.TEMPLATES.items():
        want = set(shingles(t))
        n = 1 << (len(shingles(t)) - 1).bit_length()
        for start in range(0, len(own), n):
            share = len(want & set(own[start : start + 2 * n])) / len(want)
            if share >= 0.8 and share > out.get(name, 0):
                out[name] = share
    return out


FILLER = " ".join(f"filler{i}" for i in range(500))
MIT = lic.TEMPLATES["MIT permission"]
TEXTS = [
    None, "", "Released under the MIT License.", f"{FILLER} {MIT} {FILLER}", MIT.replace("Software", "Program", 1).upper(), MIT[:200],
    "\n".join([FILLER, *lic.TEMPLATES.values()]), f"x {lic.TEMPLATES['BSD conditions']}", "Licensed under CC BY-NC 4.0. " * 40,
]


def test_edges(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, TEXTS[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 words", "2 license", "3 found", "4 level", "5 TEXT")
    got = lic.scan_licenses(df).collect()
    assert sorted((str(r.doc_id), {x.license: round(x.containment, 6) for x in r.found}) for r in got if r.doc_id != 2) == sorted(
        (str(i), {k: round(v, 6) for k, v in brute(t).items()}) for i, t in rows if i != 2
    )
    assert [r.found[0].license for r in got if r.doc_id == 2] == ["MIT notice"] * 2
    assert lic.scan_licenses(df.limit(0)).count() == 0
    assert all(not r.found for r in lic.scan_licenses(df, templates={"short": "MIT License"}).collect())


def test_licenses_of_one_family_are_told_apart(spark):
    """Each template in a document of its own: itself, and those that it holds word by word."""
    rows = list(enumerate(lic.TEMPLATES.values()))
    got = {r.doc_id: [x.license for x in r.found] for r in lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names, inside = list(lic.TEMPLATES), {"Apache-2.0 header": ["Apache-2.0 notice"]}
    assert got == {i: sorted([names[i], *inside.get(names[i], [])]) for i, _ in rows}


def test_very_long_text(spark):
    long = " ".join(f"v{i % 977}x{i % 613}" for i in range(60_000))
    df = spark.createDataFrame([(1, f"{long} {MIT} {long}"), (2, long)], "doc_id long, text string")
    got = {r.doc_id: [(x.license, x.containment) for x in r.found] for r in lic.scan_licenses(df).collect()}
    assert got == {1: [("MIT permission", 1.0)], 2: []}


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.licenses for r in registry.op5_license_scan(spark, sf).collect()}
    assert got == {i: ",".join(sorted(brute(t))) for i, t in docs.items()} and any(got.values())
