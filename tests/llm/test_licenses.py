"""Licence scan: headers wrapped over lines, licence files as a whole, ties, and cosines against plain loops."""

import re
from collections import Counter
from math import log, sqrt

from trajlake.llm import license_scan

BODIES = dict(license_scan.NOTICES)
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def wrapped(text, width=7, mark="# "):
    parts = text.split(" ")
    return "\n".join(mark + " ".join(parts[i : i + width]) for i in range(0, len(parts), width))


def units(text):
    lines = [words(x) for x in (text or "").split("\n")]
    out, run = [x for x in lines if x], []
    for x in [*lines, []]:
        if x:
            run = run + x
        elif run:
            out.append(run)
            run = []
    return out + [sum(lines, [])] if any(lines) else []


def likest(texts, templates, least):
    """The licence and cosine of each text, by plain loops over all lines, paragraphs and whole texts."""
    lines = [set(w) for t in texts for x in (t or "").split("\n") if (w := words(x))]
    known = {w for _, t in templates for w in words(t)}
    idf = {w: log((1 + len(lines)) / (1 + sum(w in x for x in lines))) + 1 for w in known}
    rare = log(1 + len(lines)) + 1

    def vector(unit):
        return {w: n * idf.get(w, rare) for w, n in Counter(unit).items()}

    def cosine(a, b):
        return round(sum(x * b.get(w, 0) for w, x in a.items()) / sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 9)

    stated = [(name, vector(words(t))) for name, t in templates]
    out = []
    for t in texts:
        scores = [(-cosine(vector(u), v), name) for u in units(t) for name, v in stated]
        best = min(scores, default=(0, None))
        out.append((best[1], -best[0]) if -best[0] >= least else (None, None))
    return out


def scan(spark, texts, **more):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    return [(r.license, r.cosine) for r in license_scan.license_lines(rows, **more).orderBy("row").collect()]


def test_wrapped_headers_and_whole_files(spark):
    filler = [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(30)]
    texts = [wrapped(body) + "\n\nimport os\n" + "\n".join(filler[:5]) for body in BODIES.values()]
    texts += [f"{name} License\n\nCopyright (c) 2020 Some Holder\n\n" + wrapped(body, 11, "").replace(". ", ".\n\n") for name, body in BODIES.items()]
    found = scan(spark, [*texts, "\n".join(filler), None, "", "\n\n"])
    assert [name for name, _ in found] == [*BODIES, *BODIES, None, None, None, None]


def test_cosines_by_plain_loops(spark):
    mit, isc, zlib = BODIES["MIT"], BODIES["ISC"], BODIES["Zlib"]
    texts = [
        wrapped(mit, 5), wrapped(isc, 9, " * "), zlib[:300], zlib[:300] + "\n" + zlib[300:], "x\r\n" + wrapped(mit, 6).replace("\n", "\r\n"), "Released under the MIT License", "ä Ö Released under\nthe MIT License",
        "licensed under\n\nthe mit license", "the mit license " * 40, "\n".join(["Licensed under the MIT License"] * 50), mit + " " + isc, "no words of it", None, "", " \n ", "Licensed under CC BY 4.0\nLicensed under CC BY-NC 4.0",
    ]
    for least in (0.8, 0.3):
        expected = likest(texts, license_scan.TEMPLATES, least)
        for (name, cosine), (want, figure) in zip(scan(spark, texts, min_cosine=least), expected, strict=True):
            assert name == want and (cosine == figure or abs(cosine - figure) < 2e-9)


def test_ties_go_to_the_licence_that_sorts_first(spark):
    templates = (("Z", "some words of a licence"), ("B", "some words of a licence"), ("C", "licence a of words some"))
    assert [name for name, _ in scan(spark, ["some words of a licence", "some words\nof a licence"], templates=templates)] == ["B", "B"]


def test_a_very_long_text(spark):
    text = "\n".join(f"line {i} of it {i * 7}" for i in range(150_000)) + "\n\n" + wrapped(BODIES["Apache-2.0"]) + "\n\nend"
    assert scan(spark, [text, "short"])[0][0] == "Apache-2.0"
