import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from trajlake.llm import (
    _text,
    decontamination,
    language_id,
    license_scan,
    lm_scoring,
    mixing,
    ngram_jaccard,
    quality_classifier,
    quality_rules,
    substring_dedup,
    url_filters,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = ["the", "of", "Été", "road", "signal", "a", "x1", "über", "lane", "stop", "go", "line", "##", "|", "turn", "left"]


def corpus(seed=1, n=120):
    """Texts with exact and near copies, shared passages, repeats, long and empty ones."""
    r = random.Random(seed)
    words = VOCAB + [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = text(60)
    texts = [None, "", "  \n\t ", "one", "one two", "One Two", "a b c", "x " * 400, text(9000)]
    while len(texts) < n:
        kind = r.randrange(6)
        if kind == 0 and len(texts) > 12:
            texts.append(r.choice(texts[8:]))
        elif kind == 1 and len(texts) > 12:
            w = r.choice(texts[9:]).split(" ")
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(text(r.randrange(5, 120)) + " " + passage + " " + text(r.randrange(5, 120)))
        else:
            texts.append("\n".join(text(r.randrange(1, 40)) for _ in range(r.randrange(1, 8))))
    return [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "ü", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def odd(spark):
    """Null ids and columns, repeated rows, and columns whose names the operators use."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(None, text, None, None, 1, 2.0, "x"), (1, text, None, None, 1, 2.0, "x"), (1, text, None, None, 1, 2.0, "x"), (None, None, None, None, None, None, None), (2, "", "en", "s", 0, 0.0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score double, c0 string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_rules(docs, rows):
    found = by_id(quality_rules.quality_rules(docs))
    for k, text, *_ in rows:
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text), k
        assert not (r.kept and r.base_failed)


def test_quality_rules_condemns_a_bad_host(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 10 == 0 or i >= 100 else "bad", None, "bad" if i < 100 else f"h{i % 5}", 0) for i in range(300)]
    found = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)))
    assert not any(found[i].kept for i in range(100)) and all(found[i].kept for i in range(100, 300))


@pytest.mark.parametrize("size,p,q", [(3, 90, 100), (5, 8, 10)])
def test_similar_groups(docs, rows, size, p, q):
    expected = brute.groups([(k, t) for k, t, *_ in rows], size, p, q)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.similar_groups(docs, size, (p, q)).collect()}
    assert found == expected


def test_ids_to_drop_are_broadcast_by_their_number(spark, monkeypatch):
    """Files of ids are small, so Spark would tell millions of them to all tasks."""
    monkeypatch.setattr(ngram_jaccard, "BROADCAST", 3)
    limit, seen = "spark.sql.autoBroadcastJoinThreshold", []
    before, walk = spark.conf.get(limit), ngram_jaccard._links
    monkeypatch.setattr(ngram_jaccard, "_links", lambda *a: seen.append(spark.conf.get(limit)) or walk(*a))
    rows = spark.createDataFrame([(i, f"one two three four five six {i % 5}", "x") for i in range(20)], "doc_id long, text string, lang string")
    kept = ngram_jaccard.drop_similar(rows)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert seen == [str(1 << 18)] and spark.conf.get(limit) == before


@pytest.mark.parametrize("levels,pivot_bytes,broadcast", [(4, 0, 0), (1, 1 << 25, 250_000)])
def test_similar_groups_by_cells(docs, rows, monkeypatch, levels, pivot_bytes, broadcast):
    for name, value in {"HOT": 2, "PART": 1, "SAMPLE": 5, "BLOCK": 3, "LEVELS": levels, "PIVOT_BYTES": pivot_bytes, "BROADCAST": broadcast, "NODES": broadcast}.items():
        monkeypatch.setattr(ngram_jaccard, name, value)
    expected = brute.groups([(k, t) for k, t, *_ in rows], 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.similar_groups(docs, 3, (90, 100)).collect()} == expected


def near_misses(seed, n=260):
    """Many variants of one text, most of them around the threshold of each other, some sharing edits, with unrelated texts."""
    r = random.Random(seed)
    base = [f"b{r.randrange(300)}" for _ in range(150)]
    shared = [(r.randrange(150), f"s{i}") for i in range(12)]
    texts = []
    for i in range(n):
        w = list(base) if i % 10 else [f"b{r.randrange(300)}" for _ in range(r.randrange(1, 200))]
        for at, word in r.sample(shared, r.randrange(0, 5)):
            w[at % len(w)] = word
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"n{r.randrange(4000)}"
        del w[: r.randrange(0, 4)]
        texts.append((i, " ".join(w)))
    return texts


@pytest.mark.parametrize("seed,size,p,q", [(1, 3, 90, 100), (2, 5, 8, 10)])
def test_large_group_of_near_misses(spark, monkeypatch, seed, size, p, q):
    monkeypatch.setattr(ngram_jaccard, "HOT", 8)
    monkeypatch.setattr(ngram_jaccard, "PART", 1)
    texts = near_misses(seed)
    expected = brute.groups(texts, size, p, q)
    assert 10 < len({c for _, c in expected.values()}) < len(texts)
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.similar_groups(rows, size, (p, q)).collect()} == expected


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_contamination(spark, docs, rows, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    long = next(t for _, t, *_ in rows[9:] if t and len(t.split()) > 30)
    items = [(1, " ".join(long.split()[5:25]).upper()), (2, "one"), (3, "nothing of the kind here"), (None, "one two"), (4, None), (10, "road signal a")]
    found = by_id(decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    for k, text, *_ in rows:
        assert tuple(found[k])[2:] == brute.contamination(text, items), k


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a red car was here", None, None, 0), (2, "a red old car", None, None, 0), (3, "red a b c car", None, None, 0)], SCHEMA)
    items = spark.createDataFrame([(7, "red car")], "item_id long, text string")
    hits = lambda slop: {r.doc_id for r in decontamination.find_phrases(docs, items, slop=slop).filter("size(spans) > 0").collect()}
    assert hits(0) == {1} and hits(1) == {1, 2}


def test_substring_dedup_round_trip(docs, rows):
    found = by_id(substring_dedup.substring_dedup(docs))
    for k, text, *_ in rows:
        r, left = found[k], text
        for cut in sorted(r.removed, key=lambda c: -c["start"]):
            left = left[: cut["start"]] + left[cut["end"] :]
        assert left == r.text
        assert r.n_words == len(brute.WORD.findall(text or "")) and r.n_removed == r.n_words - len(brute.WORD.findall(r.text or ""))


def test_substring_dedup_catches_passages_and_leaves_clean_documents(spark):
    r = random.Random(5)
    fresh = lambda k: " ".join(f"u{r.randrange(10**9)}" for _ in range(k))
    passage = fresh(60)
    rows = [(i, f"{fresh(50)} {passage} {fresh(50)}" if i % 3 == 0 else fresh(100) + "\nall rights reserved", None, "s", 0) for i in range(90)]
    found = by_id(substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert found[0].n_removed == 0 and found[0].text == rows[0][1]
    assert all(found[i].n_removed >= 40 for i in range(3, 90, 3))
    assert all(found[i].text == rows[i][1] for i in range(90) if i % 3)


def test_substring_dedup_units(docs, rows):
    """The units of equal digests are equal words, and the other way round."""
    import pyarrow as pa

    seen: dict = {}
    texts = [t for _, t, *_ in rows if t]
    digest, at, starts, ends, first, data, _ = substring_dedup._units(pa.array(texts))
    stop = np.append(at[1:], len(starts))
    for d, a, b in zip(digest, at, stop, strict=True):
        words = tuple(data[starts[i] : ends[i]].tobytes().decode().translate(brute.LOW) for i in range(a, b))
        assert seen.setdefault(int(d), words) == words
    assert len(set(seen.values())) == len(seen)


def test_substring_dedup_keeps_new_text_of_known_units(spark):
    """Words that stand as lines of their own in different documents are no passage when they come together for the first time."""
    known = [(i, f"before{i}\nshared{i}\nafter{i}", None, "s", 0) for i in range(24)]
    together = "\n".join(f"shared{i}" for i in range(24))
    rows = [*known, (30, together, None, "s", 0), (31, f"other\n{together}\nwords", None, "s", 0)]
    found = by_id(substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert found[30].n_removed == 0 and found[30].text == together
    assert found[31].n_removed == 24 and found[31].text.split() == ["other", "words"]


def test_substring_dedup_against_brute_force(docs, rows):
    found = by_id(substring_dedup.substring_dedup(docs))
    expected = brute.repeats([(k, t) for k, t, *_ in rows], substring_dedup.LEAST)
    assert any(expected.values())
    assert {k: [(c["start"], c["end"]) for c in r.removed] for k, r in found.items()} == expected


def test_substring_dedup_of_lines_against_brute_force(docs, rows):
    found = by_id(substring_dedup.substring_dedup(docs, lines=True))
    expected = brute.repeats([(k, t) for k, t, *_ in rows], substring_dedup.LEAST, lines=True)
    assert {k: [(c["start"], c["end"]) for c in r.removed] for k, r in found.items()} == expected


def test_remove_repeats_against_brute_force(docs, rows):
    """The pipeline's stage: what is left of each text; documents that lose their last word go."""
    found = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    expected = {k: t for k, t, *_ in rows}
    for k, cuts in brute.repeats(list(expected.items()), substring_dedup.LEAST, lines=True).items():
        for a, b in reversed(cuts):
            expected[k] = expected[k][:a] + expected[k][b:]
        if cuts and not brute.WORD.search(expected[k]):
            del expected[k]
    assert found == expected and len(expected) < len(rows)


def test_op4_removes_short_repeated_lines(spark, tmp_path):
    """Whole lines go however short; the same words within a longer line stay."""
    texts = ["a first\nAll rights  reserved\nend", "a second\nall rights reserved\ntail", "of this all rights reserved too", "end"]
    spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = by_id(substring_dedup.op4_substring_dedup(spark, str(tmp_path)))
    assert [found[i].n_removed for i in range(4)] == [0, 3, 0, 1]
    assert found[1].text.split() == ["a", "second", "tail"] and found[2].text == texts[2]


def test_mix(docs, rows):
    found = by_id(mixing.mix(docs))
    again = by_id(mixing.mix(docs.repartition(5)))
    assert found == again
    size = {k: len(brute.WORD.findall(t or "")) for k, t, *_ in rows}
    names = sorted({s for *_, s, _ in rows if s is not None}) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[k] for k, *_, x, _ in rows if x == s) for s in names}
    target, free, rest = {}, set(names), 1.5 * sum(total.values())
    while True:  # share by weight; who would get over twice its own stops there
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * total[s]}
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        rest, free = rest - sum(2.0 * total[s] for s in over), free - over
    target |= share
    for s in names:
        mine = [found[k] for k, *_, x, _ in rows if x == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == total[s] and r.size == size[r.doc_id] and r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 2 * max(r.size for r in mine)


def test_emit_is_the_mix(docs):
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = [(r.doc_id, r.mix_copy) for r in mixing.emit(docs).collect()]
    assert sorted(out) == sorted((k, i + 1) for k, n in copies.items() for i in range(n))


def test_language_id(spark):
    r = random.Random(3)
    alphabet = {"aa": "abcdefgh", "zz": "stuvwxyz", "ру": "абвгдежз"}
    word = lambda lang: "".join(r.choice(alphabet[lang]) for _ in range(r.randrange(2, 8)))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang, None, 0) for i in range(200) for lang in [r.choice(list(alphabet))]]
    rows += [(900, None, "aa", None, 0), (901, "12 ..", "aa", None, 0), (902, "", None, None, 0)]
    found = by_id(language_id.language_id(spark.createDataFrame(rows, SCHEMA)))
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, *_ in rows)
    assert all(found[k].lang_pred == lang and 0.5 < found[k].score <= 1 for k, _, lang, *_ in rows[:200])
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (900, 901, 902))


def test_language_ngrams_stay_in_their_text():
    import pyarrow as pa

    both = language_id._grams(pa.array(["abc", "xyz"]))
    one = language_id._grams(pa.array(["abc"]))
    assert sorted(both[0][both[1] == 0]) == sorted(one[0][one[1] == 0]) and list(both[2]) == [3, 3]


def test_quality_classifier(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(VOCAB[:12]) for _ in range(60))
    bad = lambda: " ".join(r.choice(VOCAB).upper() + "!!$$" for _ in range(60))
    rows = [(i, good() if i % 4 else bad(), None, None, 0) for i in range(400)] + [(999, None, None, None, 0), (998, "", None, None, 0)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = by_id(quality_classifier.quality_scores(spark.createDataFrame(rows, SCHEMA), labels))
    assert len(found) == 402 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in found.values())
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in found)
    held = [found[i] for i in range(400) if found[i].held_out]
    assert sum(x.predicted == int(x.doc_id % 4 > 0) for x in held) / len(held) > 0.95


def test_quality_classifier_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality_classifier.quality_scores(docs, none).collect()} == {0.3}


def test_lm_scores(docs, rows):
    from collections import Counter
    from math import log

    texts = [(k, brute.WORD.findall(t or "")) for k, t, *_ in rows]
    for order in (1, 2, 3):
        counts = [Counter(tuple(w[i : i + n]) for _, w in texts for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
        total = sum(counts[0].values())

        def score(w, i, counts=counts, order=order, total=total):
            for n in range(min(order, i + 1), 1, -1):
                if (c := counts[n - 1][tuple(w[i - n + 1 : i + 1])]) >= 2:
                    return log(c / counts[n - 2][tuple(w[i - n + 1 : i])]) + (min(order, i + 1) - n) * log(0.4)
            return log(counts[0][(w[i],)] / total) + (min(order, i + 1) - 1) * log(0.4)

        found = by_id(lm_scoring.lm_scores(docs, order))
        for k, w in texts:
            assert found[k].n_words == len(w) and abs(found[k].log_score - sum(score(w, i) for i in range(len(w)))) < 1e-6


def test_license_scan(spark):
    files = [
        (1, "s/LICENSE", "Released under the MIT License."), (2, "s/a/x.py", "print()"), (3, "s/a/b/LICENSE.txt", "x\nLicensed under CC BY-NC 4.0."), (4, "s/a/b/c/y.py", None),
        (5, "s/a/b/z.py", "# licensed under the apache license, version 2.0"), (6, "t/w.py", "the license of the mit is under released things and more"), (7, None, "Released under the MIT License."), (8, "LICENSE", ""), (None, "s/q", ""),
    ]
    found = by_id(license_scan.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")))
    got = {k: (r.license, r.origin) for k, r in found.items()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "s"), 3: ("CC-BY-NC-4.0", "own"), 4: ("CC-BY-NC-4.0", "s/a/b"), 5: ("Apache-2.0", "own"), 6: (None, None), 7: ("MIT", "own"), 8: (None, None), None: ("MIT", "s")}


def test_url_filter(spark):
    captures = [(1, "http://ads.example.com/x", "2024-01-05"), (2, "http://ads.example.com:80/x", "2024-02-05"), (3, "https://u@EXAMPLE.com", "2024-03-05"), (4, "no url", "2024-01-05"), (5, None, "2024-01-05"), (6, "http://notexample.com", "2024-03-05"), (7, "http://ads.example.com", None)]
    entries = [("ads.example.com", "add", "2024-01-01"), ("ads.example.com", "remove", "2024-02-01"), ("example.com", "add", "2024-03-01"), ("example.com", "add", "2024-04-01"), ("example.com", "remove", "2024-04-01"), (None, "add", "2024-01-01")]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched string").selectExpr("page_id", "url", "to_timestamp(fetched) AS fetched")
    e = spark.createDataFrame(entries, "pattern string, action string, since string").selectExpr("pattern", "action", "to_timestamp(since) AS since")
    found = {r.page_id: (r.blocked, r.n_entries, r.pattern) for r in url_filters.url_filter(c, e).collect()}
    assert found == {1: (True, 1, "ads.example.com"), 2: (False, 0, None), 3: (True, 1, "example.com"), **{k: (False, 0, None) for k in (4, 5, 6, 7)}}


def test_language_id_against_brute_force(spark):
    """Counts, log-probabilities and posteriors in plain loops over dictionaries."""
    import math

    import pyarrow as pa

    r = random.Random(11)
    letters = {"aa": "abcdefgh", "bb": "cdefghij", "cc": "efghijkl"}
    rows = []
    for i in range(150):
        lang = r.choice(list(letters))
        rows.append((i, " ".join("".join(r.choice(letters[lang]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 6))), lang, None, 0))
    rows += [(200, "\U000f0000\U000e0100 12", "aa", None, 0), (201, "\U00020000", None, None, 0)]
    counts: dict = {}
    grams = lambda text: [int(x) for x in language_id._grams(pa.array([text]))[0]]
    for k, text, lang, *_ in rows:
        if lang and zlib.crc32(str(k).encode()) % 4 != 2:
            for g in grams(text):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    total = {lang: sum(c.values()) + 0.5 * language_id.BUCKETS for lang, c in counts.items()}
    found = by_id(language_id.language_id(spark.createDataFrame(rows, SCHEMA)))
    for k, text, *_ in rows:
        if not any(c.isalpha() for c in text):
            assert (found[k].lang_pred, found[k].score) == ("und", 0.0)
            continue
        log = {lang: sum(math.log((counts[lang].get(g, 0) + 0.5) / total[lang]) for g in grams(text)) for lang in counts}
        best = max(sorted(log), key=lambda x: log[x])
        assert found[k].lang_pred == best
        assert abs(found[k].score - 1 / sum(math.exp(v - log[best]) for v in log.values())) < 1e-4


@pytest.mark.parametrize("n, block", [(20, 7), (21, 7), (1000, 128)])
def test_languages_in_blocks(spark, monkeypatch, n, block):
    """Any number of models of all buckets gives what one model of all languages gives, ties and rows without letters too."""
    r = random.Random(n)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(12)), f"l{i % n:04}", None, 0) for i in range(3 * n)]
    rows += [(3 * n, None, None, None, 0), (3 * n + 1, "12 !", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(language_id, "BLOCK", block)
    models = list(language_id.fit(docs))
    assert [len(x) for x, _ in models] == [block] * (n // block) + [n % block] * (n % block > 0) and all(p.shape[1] == language_id.BUCKETS for _, p in models)
    split = {x.c0: x for x in language_id.predict(docs, iter(models)).collect()}
    whole = {x.c0: x for x in language_id.predict(docs, iter([([a for x, _ in models for a in x], np.concatenate([p for _, p in models]))])).collect()}
    assert len(split) == len(rows) and {k: x.pred for k, x in split.items()} == {k: x.pred for k, x in whole.items()}
    assert all(abs(split[k].score - whole[k].score) < 1e-9 for k in whole) and split[3 * n + 1].pred == "und"


def test_language_ngrams_in_plain_loops():
    import pyarrow as pa

    def grams(text):
        code = [0]
        for c in text:
            x = ord(c.lower()) if c.isalpha() else 0
            if x or code[-1]:
                code.append(x)
        code += [0] if code[-1] else []
        for n in language_id.SIZES:
            for i in range(len(code) - n + 1):
                part = code[i : i + n]
                if n == 2 or part[n // 2]:
                    h = 0
                    for x in part:
                        h = (h * 0x100000001B3 + x) % 2**64
                    yield int(_text.mix(np.array([h * (2 * n + 1) % 2**64], np.uint64))[0]) % language_id.BUCKETS

    texts = ["", "a", "Ab  c!", "..x", "one two\nthree", "\u00c9t\u00e9 \u4e2d\u6587", "123"]
    bucket, of, letters = language_id._grams(pa.array(texts))
    for i, text in enumerate(texts):
        assert sorted(bucket[of == i].tolist()) == sorted(grams(text)) and letters[i] == sum(map(str.isalpha, text))


def test_quality_classifier_minimises_the_loss_of_its_pairs(spark):
    """The loss over all pairs of good and bad documents falls, and the threshold splits the scores at the share of bad ones."""
    r = random.Random(6)
    rows = []
    for i in range(60):
        junk = 0.3 if i % 3 else 0.5
        rows.append((i, " ".join(r.choice(VOCAB) if r.random() > junk else "##|!!" for _ in range(40)), None, None, 0))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    labelled = quality_classifier.features(docs).join(labels, "doc_id")
    mean, spread, w, threshold = quality_classifier.fit(labelled)
    table = {x.doc_id: ((np.array(x.x) - mean) / spread, x.quality) for x in labelled.collect()}
    good, bad = ([x for x, q in table.values() if q == v] for v in (1, 0))
    pairs = np.array([g - b for g in good for b in bad])
    loss = lambda v: np.log1p(np.exp(-pairs @ v)).mean() + quality_classifier.RIDGE * (v @ v) / 2
    assert loss(w) < 0.9 * loss(np.zeros_like(w)) and np.isfinite(w).all()
    scores = sorted(float(x @ w) for x, _ in table.values())
    assert scores[0] <= threshold <= scores[-1] and abs(sum(s < threshold for s in scores) / 60 - 1 / 3) < 0.06


def _gradient(w, mean, spread, good, bad):
    """Of the pairs' mean loss and the ridge at w, pair by pair."""
    total = np.zeros(len(w))
    for a in good:
        d = (a - bad) / spread
        total -= (d / (1 + np.exp(d @ w))[:, None]).sum(0)
    return total / (len(good) * len(bad)) + quality_classifier.RIDGE * w


def _labelled(spark, x, quality, copies=None):
    rows = [(i, [float(v) for v in row], int(q)) for i, (row, q) in enumerate(zip(x, quality)) for _ in range(1 if copies is None else copies[i])]
    return spark.createDataFrame(rows, "doc_id long, x array<double>, quality int")


def test_quality_fit_leaves_no_gradient_over_its_pairs(spark, monkeypatch):
    """With as many partners as there are rows of the rarer kind, the pairs of the one group are all pairs."""
    monkeypatch.setattr(quality_classifier, "PARTNERS", 120)
    r = np.random.default_rng(3)
    x, quality = r.normal(2, 3, (240, quality_classifier.N_FEATURES)), np.arange(240) % 2
    x[quality == 1, :3] += 1.5
    mean, spread, w, _ = quality_classifier.fit(_labelled(spark, x, quality))
    assert np.allclose(mean, x.mean(0)) and np.allclose(spread, x.std(0))
    good, bad = x[quality == 1], x[quality == 0]
    assert np.abs(_gradient(np.zeros_like(w), mean, spread, good, bad)).max() > 0.1
    assert np.abs(_gradient(w, mean, spread, good, bad)).max() < 1e-6


@pytest.mark.parametrize("rare", [0, 1])
def test_quality_fit_with_one_rare_row_in_ten_thousand(spark, monkeypatch, rare):
    """Every group gets the rare row, so that each of the others meets it once."""
    monkeypatch.setattr(quality_classifier, "GROUP", 256)
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (10_000, quality_classifier.N_FEATURES))
    x[77] = 0.3
    quality = np.full(10_000, 1 - rare)
    quality[77] = rare
    mean, spread, w, _ = quality_classifier.fit(_labelled(spark, x, quality))
    assert np.abs(w).max() > 0.05
    assert np.abs(_gradient(w, mean, spread, x[quality == 1], x[quality == 0])).max() < 1e-6


def test_quality_groups_hold_both_kinds_and_split_copies(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "GROUP", 100)
    quality = np.arange(2000) % 20 == 0
    copies = [1500 if i == 7 else 1 for i in range(2000)]  # one row is three sevenths of all
    table = _labelled(spark, np.zeros((2000, 1)), quality, copies).groupBy("doc_id", "x", "quality").count().withColumnRenamed("count", "copies")
    groups = quality_classifier.deal(table, 3499, 100).groupBy("g", "quality").count().collect()
    assert len({x.g for x in groups}) == 35 and sum(x["count"] for x in groups if x.quality == 0) == 3399
    assert {x.g for x in groups if x.quality == 1} == set(range(35)) and max(x["count"] for x in groups) < 200


def test_texts_longer_than_a_piece(spark):
    """A text of several pieces' size, with a word longer than the hash's tables, gets exact figures."""
    word = "y" * (5 << 19)
    text = f"one two {word} " + " ".join(f"w{i}" for i in range(200_000)) + f" {word}"
    docs = spark.createDataFrame([(1, text, None, "s", 0), (2, text, None, "s", 0), (3, "one two three", None, "s", 0)], SCHEMA)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.similar_groups(docs, 3, (9, 10)).collect()} == {(1, 200_002, 1), (2, 200_002, 1), (3, 1, 3)}
    rules = by_id(quality_rules.quality_rules(docs))
    assert rules[1].n_words == 200_004 and rules[1].word_chars == len(text.replace(" ", "")) and rules[1].n_repeat_words == 0
    cut = by_id(substring_dedup.substring_dedup(docs))
    assert (cut[1].n_removed, cut[2].n_removed, cut[2].text) == (0, 200_004, "")


@pytest.mark.parametrize("name", ["gone", "bad_id", "bad_key", "__gone", "__id", "__key", "text_key"])
def test_columns_with_the_names_of_stages(spark, tmp_path, name):
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.createDataFrame([(1, "alpha beta gamma", "en", "s", 3, 9), (2, "alpha beta gamma", "en", "s", 3, 9), (3, "x y z", "en", "s", 3, 9)], f"{SCHEMA}, {name} long")
    similar = ngram_jaccard.drop_similar(rows)
    assert similar.columns == rows.columns and {r.doc_id for r in similar.collect()} == {1, 3}
    clean = decontamination.decontaminate(rows, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert clean.columns == rows.columns and {r.doc_id for r in clean.collect()} == {1, 2}


OPERATORS = {
    "quality_rules": lambda s, d: quality_rules.quality_rules(d),
    "lm_scores": lambda s, d: lm_scoring.lm_scores(d),
    "license_scan": lambda s, d: license_scan.license_scan(d.withColumnRenamed("source", "path")),
    "substring_dedup": lambda s, d: substring_dedup.substring_dedup(d),
    "url_filter": lambda s, d: url_filters.url_filter(d.selectExpr("doc_id AS page_id", "text AS url", "CAST(NULL AS timestamp) AS fetched"), s.createDataFrame([], "pattern string, action string, since timestamp")),
    "similar_groups": lambda s, d: ngram_jaccard.similar_groups(d),
    "mix": lambda s, d: mixing.mix(d),
    "contamination": lambda s, d: decontamination.contamination(d, s.createDataFrame([(1, "beta gamma")], "item_id long, text string")),
    "language_id": lambda s, d: language_id.language_id(d),
    "quality_scores": lambda s, d: quality_classifier.quality_scores(d, s.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_names(spark, odd, name):
    assert OPERATORS[name](spark, odd).count() == 5


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_null_ids_in_groups(spark, odd):
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.similar_groups(odd, 3, (9, 10)).collect()), key=str)
    assert found == [(1, 9, 1), (1, 9, 1), (2, 0, 2), (None, 0, None), (None, 9, 1)]


def test_equal_texts_without_ids_are_one_set(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text)] * 40 + [(7, text + " x"), (None, text + " y"), (3, "other words")]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, (9, 10)).collect()), key=str)
    assert found == sorted([(None, 58, 7)] * 40 + [(7, 59, 7), (None, 59, 7), (3, 1, 3)], key=str)


STAGES = [(name, stage, bool(k == 4)) for k, (name, stage) in enumerate(corpus_pipeline.STAGES)]


@pytest.mark.parametrize("name,stage,last", STAGES)
def test_stages_on_odd_rows(spark, odd, tmp_path, name, stage, last):
    spark.createDataFrame([(1, "none of these words occur in it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, odd, str(tmp_path))
    assert out.columns == odd.columns + ["mix_copy"] * last
    out.collect()
    assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_pipeline_stages_in_turn(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join((rows[8][1]).split()[:12]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for (_, stage), check in zip(corpus_pipeline.STAGES[:4], ("language", "groups", "units", "benchmark"), strict=True):
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, str(tmp_path))
        after = {r.doc_id: r.text for r in kept.collect()}
        if check == "groups":
            least = brute.groups(list(before.items()), 5, 8, 10)
            assert set(after) == {k for k, (_, c) in least.items() if c == k}
        elif check == "benchmark":
            assert set(after) == {k for k, t in before.items() if not brute.contamination(t, items)[4]}
        elif check == "units":
            assert all(len(after[k]) <= len(before[k]) for k in after)
        else:
            assert 8 in after and not {0, 1, 2} & set(after)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= set(after)
