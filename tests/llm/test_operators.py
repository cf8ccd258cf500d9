"""Each operator on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, chat, components, hamming, licenses, neardup, packing, pieces, pii, toxicity, urls

BPE = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string"
#: columns whose names the operators use themselves
CLASHING = "doc_id long, text string, id long, _key long, base string, terms string, bands string, component string, label double, kind string"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in rows(df)}


def clash(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", "z", "c", 0.5, "k") for i, t in enumerate(texts)], CLASHING)


# -- chat -----------------------------------------------------------------------------

NASTY = [
    "", "plain", "### user: hi", "</turn>", "</turn>\n### assistant: x", r"<\/turn>", r"<\\/turn> \### ", r"#\## ", "#### ",
    "### ### ", "<</turn>", "ends with <", "ends with #", "ends with \\", ": ", "a: b", "\n", "é</turn>é", "x" * 300_000 + "</turn>",
]


def test_chat_reads_back_whatever_a_text_holds(spark):
    data = [(i, 0, "user", a) for i, a in enumerate(NASTY)] + [(i, 1, "assistant", b) for i, b in enumerate(reversed(NASTY))]
    data += [(100 + i, 0, role, "t</turn>") for i, role in enumerate(["a: b", r"a:\ b", "### ", "</turn>", ":", ""])]
    out = chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    out = out.withColumn("read", chat.parse(F.col("formatted"))).withColumn("learnt", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = by_id(out, "conv_id")
    for conv_id in {d[0] for d in data}:
        want = [{"role": r, "text": t} for c, _, r, t in data if c == conv_id]
        assert got[conv_id]["read"] == want
        assert got[conv_id]["learnt"] == "".join(t["text"] for t in want if t["role"] == "assistant")
        assert got[conv_id]["formatted"].count("</turn>") == len(want)
    assert got[0]["escape_level"] == 1 and got[100]["escape_level"] == 2


def test_chat_nulls_ties_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, turns string"
    data = [(1, None, None, None, "f", "t"), (1, 1, "user", "b", "f", "t"), (1, 1, "user", "a", "f", "t"), (1, 1, "user", "a", "f", "t"), (None, 0, "user", "x", "f", "t")]
    got = by_id(chat.format_conversations(spark.createDataFrame(data, schema)), "conv_id")
    assert [t["text"] for t in got[1]["turns"]] == ["", "a", "a", "b"] and got[1]["turns"][0]["role"] == ""
    assert got[None]["formatted"] == "### user: x</turn>\n" and got[None]["escape_level"] == 0
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


# -- licenses -------------------------------------------------------------------------


def test_license_templates():
    a = licenses.Automaton("x", "one <<opt>> two three <<end>> four <<any 2>> five")
    accepted = ["one four five", "one two three four five", "one four x five", "one four x y five", "one two three four five five"]
    refused = ["one two four five", "one four x y z five", "four five", "one two three five", "one four"]
    for text in accepted:
        assert a.runs(text.encode().split()), text
    for text in refused:
        assert not a.runs(text.encode().split()), text
    for bad in ["<<any 2>> x", "<<opt>> a <<end>>", "a <<opt>> b", "a <<what>> b"]:
        with pytest.raises(ValueError):
            licenses.Automaton("x", bad)


def test_whole_wordings(spark):
    """Each long template's own words are accepted; with any clause altered, or one word missing, they are not."""
    import re

    long = [(label, t) for label, t in licenses.TEMPLATES if len(t) > 250 and "GNU" not in t]
    assert {"mit", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2.0-notice", "unlicense"} <= {label for label, _ in long}
    texts, expected = [], []
    for label, template in long:
        plain = re.sub(r"<<opt>>|<<end>>", "", re.sub(r"<<any \d+>>", "THE NAMED HOLDERS", template))
        words = plain.split()
        texts += [plain, "x " + re.sub(r"\s+", "\n# ", plain) + " y", " ".join(words[:-3]), " ".join(words[:40] + ["not"] + words[40:]), " ".join(words[:20] + words[21:])]
        expected += [True, True, False, False, False]
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    kinds = [("General Public License", "3", "gpl,gpl-3.0"), ("General Public License", "2", "gpl,gpl-2.0"), ("Lesser General Public License", "2.1", "gpl,lgpl-2.1"),
             ("Lesser General Public License", "3", "gpl,lgpl-3.0"), ("Affero General Public License", "3", "agpl-3.0,gpl"), ("General Public License", "9", "gpl")]
    texts += [notice.format(*k[:2]) for k in kinds]
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), DOC)))
    for i, want in enumerate(expected):
        assert (long[i // 5][0] in got[i]["labels"].split(",")) == want, (long[i // 5][0], i % 5)
    assert [got[len(expected) + i]["labels"] for i in range(len(kinds))] == [k[2] for k in kinds]


def test_licenses_on_odd_rows(spark):
    texts = [
        None, "", " . ", "Licensed under the Apache License, Version 2.0.", "licensed under the apache license 2.0",
        "licensed under an apache license 2.0", "CC BY cc-by", "Copyright (c) 2020 A Team. All rights reserved.",
        "w " * 200_000 + "all rights reserved", "ça all\u00a0rights reserved",
    ]
    got = by_id(licenses.scan(clash(spark, texts)))
    assert [got[i]["labels"] for i in range(10)] == [
        "", "", "", "apache-2.0", "apache-2.0", "", "cc-by", "copyright-notice,reserved", "reserved", "",
    ]
    assert got[0]["n_words"] == got[2]["n_words"] == 0 and got[0]["first_word"] is None and got[0]["score"] == 0
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"]) == (2, 0, 2)
    assert got[8]["first_word"] == 200_000
    assert licenses.scan(spark.createDataFrame([], DOC)).count() == 0
    assert licenses.scan(spark.createDataFrame([(None, "cc by"), (None, "cc by")], DOC)).count() == 2


# -- urls -----------------------------------------------------------------------------


def test_urls(spark):
    data = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://A.NET/x"), (5, "http://example.net/en/"), (6, "http://notnet/"),
        (7, "http://x.org/fr/a?b#c"), (8, "http://x.org?a=/fr/"), (9, "http://"), (10, "a://b://c/d"), (11, "http://h/" + "a" * 100_000),
        (12, "http://casino-bonus.example/slots/free-spins"), (13, "https://docs.library.example/en/guide.html"), (None, "http://a.net/"), (4, "http://A.NET/x"),
    ]
    pages = spark.createDataFrame([(*d, "h", 1.0, "r") for d in data], "page_id long, url string, host string, label double, _grams string")
    model = urls.fit(urls.labelled_urls(spark))
    out = rows(urls.judge(pages, model))
    got = {r["page_id"]: r for r in out}
    assert len(out) == len(data)
    assert [(got[i]["host"], got[i]["path"]) for i in (1, 2, 3, 9)] == [("", "")] * 4
    assert (got[4]["host"], got[4]["rule"], got[4]["verdict"]) == ("a.net", "net/", "block")
    assert got[5]["rule"] == "example.net/en/" and got[6]["rule"] is None
    assert got[7]["rule"] == "org/fr/" and got[8]["rule"] is None
    assert (got[10]["host"], got[10]["path"]) == ("b:", "//c/d") and len(got[11]["path"]) == 100_001
    assert got[12]["verdict"] == "block" and got[13]["verdict"] == "allow" and got[None]["verdict"] == "block"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def test_url_model_tells_labels_apart_and_scores_as_plain_python_does(spark):
    labelled = urls.labelled_urls(spark)
    model = urls.fit(labelled)
    table = [(r["url"], r["label"]) for r in labelled.collect()]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(table)], "page_id long, url string")
    got = by_id(urls.judge(pages, model, rules=()), "page_id")
    assert all((got[i]["verdict"] == "block") == (label == 1) for i, (_, label) in enumerate(table))
    hashing, learner = model.stages
    for i, (url, _) in enumerate(table[:5]):
        host, _, rest = url.partition("://")[2].partition("/")
        path = ("/" + rest).split("?")[0].split("#")[0]
        counts = np.zeros(urls.N_FEATURES)
        for mark, part in (("h", host), ("p", path)):
            shown = "^" + "".join("0" if c.isdigit() else c for c in part.lower()) + "$"
            for n in urls.GRAMS:
                for at in range(len(shown) - n + 1):
                    counts[hashing.indexOf(mark + shown[at : at + n])] += 1
        z = float(counts @ learner.coefficients.toArray() + learner.intercept)
        assert abs(1 / (1 + np.exp(-z)) - got[i]["score"]) < 1e-9


# -- near-duplicates ------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)]
    out = components.connected(spark.createDataFrame([*chain, *star, (5, 5), (3, 2), (2, 3), (2, 3)], "a long, b long"))
    got = {r["id"]: r["component"] for r in rows(out)}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(1000, 1100)]}, 2: 2, 3: 2}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_on_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n", "one", "one", "one two", base, base.upper(), base.replace("w7 ", "v7 "), base.replace("w", "u"), "long " * 100_000, "long long"]
    got = by_id(neardup.near_duplicates(clash(spark, texts), shingle_words=2))
    assert [got[i]["n_shingles"] for i in range(12)] == [0, 0, 0, 1, 1, 1, 59, 59, 59, 59, 1, 1]
    assert [got[i]["component_id"] for i in range(12)] == [0, 1, 2, 3, 3, 5, 6, 6, 6, 9, 10, 10]
    assert [i for i in range(12) if not got[i]["kept"]] == [4, 7, 8, 11]
    assert neardup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    again = rows(neardup.near_duplicates(spark.createDataFrame([(1, "a b"), (1, "c d"), (2, "c d"), (3, "a b"), (None, "a b"), (None, None)], DOC), shingle_words=2))
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in again if r["doc_id"]) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert all(r["component_id"] is None and r["kept"] for r in again if r["doc_id"] is None)
    kept = neardup.keep_first(clash(spark, texts))
    assert kept.columns == [c.split()[0] for c in CLASHING.split(", ")]
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, 5, 6, 9, 10, 11}  # of five words


def test_a_large_group_about_the_threshold_is_joined_exactly(spark):
    """Copies whose edits put many pairs below and many above the threshold."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(400):
        own = list(base)
        for at in draw.sample(range(150), draw.choice([2, 6, 9, 14, 20])):
            own[at] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOC), shingle_words=2))
    assert [got[i]["component_id"] for i in range(len(texts))] == [top(i) for i in range(len(texts))]
    assert len({top(i) for i in range(len(texts))}) > 1


def test_signature_estimates_similarity():
    draw = np.random.default_rng(3)
    both = draw.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = neardup.signature(both[:2500]), neardup.signature(both[500:])
    assert len(a) == 128 and abs((a == b).mean() - 2000 / 3000) < 0.15


# -- personal data --------------------------------------------------------------------


def test_personal_data_on_odd_rows(spark):
    texts = [
        None, "", "a@b.c_x@y.org", "a@b", "1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111 and 4111 1111 1111 1112", "call +1 (202) 555-0147.",
        "+1 2 3", "x" * 200_000 + "@a.bc", "é" * 10 + "q@w.de", "9" * 50_000, "a@b.c" + ".c" * 20_000, "+" * 3000 + "1 " * 3000, "4111-1111-1111-1111-",
    ]
    got = by_id(pii.find(clash(spark, texts)))
    found = {i: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for i, r in got.items()}
    assert found[0] == found[1] == found[3] == found[7] == found[10] == []
    assert found[2] == [("email", 0, 5), ("email", 5, 13)]
    assert found[4] == [("ip", 0, 7), ("ip", 8, 15)]
    assert found[5] == [("card", 0, 19)] and found[6] == [("phone", 5, 22)] and found[13] == [("card", 0, 19)]
    assert found[8] == [("email", 0, 200_005)] and found[9] == [("email", 10, 16)] and found[11] == [("email", 0, 40_005)]
    assert pii.find(spark.createDataFrame([], DOC)).count() == 0


def lowest(joint, of):
    """The lower end of Wilson's interval for a share."""
    z2 = pii.DEVIATIONS**2
    share = joint / of
    return (share + z2 / (2 * of) - (z2 * share * (1 - share) / of + z2 * z2 / (4 * of * of)) ** 0.5) / (1 + z2 / of)


def brute_terms(texts):
    """Places of terms and what is done with them, by the definition, from all texts."""
    import math
    import re

    def words(text, spans):
        inside = [(m.start(), m.end(), m[0].lower()) for a, b in zip([0, *(e for _, _, e in spans)], [*(s for _, s, _ in spans), len(text)])
                  for m in re.compile(r"[^\W\d_]+").finditer(text, a, b)]
        return [w for w in inside if len(w[2]) >= pii.LEAST_LETTERS]

    found = [[(k, m.start(), m.end()) for k, p in (("email", EMAIL), ("ip", IP)) for m in re.finditer(p, t)] for t in texts]
    found = [sorted(f, key=lambda s: s[1]) for f in found]
    held_by, rows_of = {}, {}
    for i, text in enumerate(texts):
        for k, a, b in found[i]:
            held_by.setdefault((k, text[a:b].lower()), set()).add(i)
        for w in {w[2] for w in words(text, found[i])} | {m.lower() for m in re.findall(r"[^\W\d_]+", text)}:
            rows_of.setdefault(w, set()).add(i)
    told = {}
    for entity, rows_ in held_by.items():
        for term in {w[2] for i in rows_ for w in words(texts[i], found[i])}:
            joint = [i for i in rows_ if term in {w[2] for w in words(texts[i], found[i])}]
            named = any(re.search(rf"(?<=[a-z0-9,;] ){term.title()}(?![a-z])", texts[i]) for i in joint)
            n_e, n_t, n_et, total = len(rows_), len(rows_of[term]), len(joint), len(texts)
            chance = n_e * n_t / (n_et * total)
            tail = n_et * (1 - chance + math.log(chance)) if chance < 1 else 0
            if (n_et == 1 and not named) or min(math.log(chance), tail) > math.log(pii.CHANCE) or n_e == total:
                continue
            value = math.log(lowest(n_et, n_t) * total / n_e) / math.log(total / n_e)
            if value >= pii.GENERALISE_FROM:
                for i in joint:
                    told[i, term] = max(value, told.get((i, term), 0))
    return {
        i: [(a, b, "remove" if told[i, w] >= pii.REMOVE_FROM else "generalise") for a, b, w in sorted(words(text, found[i])) if (i, w) in told]
        for i, text in enumerate(texts)
    }


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


def test_all_disclosures_equal_their_definition(spark):
    draw = random.Random(11)
    common = [f"w{c}ord" for c in "abcdefghijklmnop"]
    rare = [a + b + c + "ine" for a in "bcdf" for b in "aeiou" for c in "lmnr"]
    texts = []
    for i in range(400):
        words = [draw.choice(common) for _ in range(12)] + [draw.choice(rare).title() if draw.random() < 0.5 else draw.choice(rare) for _ in range(2)]
        if i % 4 == 0:
            who = draw.randrange(40)
            words += [f"p{who}@x.org"] + ["secret" + "abcdefghij"[who % 10]] * (who < 20) + [f"1.2.3.{who}"] * (who % 3 == 0)
        draw.shuffle(words)
        texts.append(" ".join(words))
    expected = brute_terms(texts)
    got = by_id(pii.find(spark.createDataFrame(list(enumerate(texts)), DOC)))
    assert {i: [(t["start"], t["end"], t["action"]) for t in got[i]["terms"]] for i in got} == expected
    marked = sum(map(len, expected.values()))
    assert 20 < marked and any(t[2] == "generalise" for ts in expected.values() for t in ts)


def test_little_of_the_clean_text_is_masked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = pii.find(docs).filter("size(base) > 0").join(docs.select("doc_id", "text"), "doc_id")
    words = F.size(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))
    masked, whole = held.agg(F.sum(F.size("terms")), F.sum(words)).first()
    assert 0 < masked < 0.08 * whole


def test_a_text_of_many_addresses(spark):
    """3,000 entities of one text are one class; only its name-like words can tell of them."""
    text = " ".join(f"person Name{'abcdefghij'[i % 10]}x adr{i}@ex{i}.org" for i in range(3000))
    data = [(i, f"plain text number {i}") for i in range(200)] + [(1000, text), (1001, "just one of them adr7@ex7.org Nobody")]
    docs = spark.createDataFrame(data, DOC)
    got = by_id(pii.find(docs))
    assert len(got[1000]["base"]) == 3000 and len(got[1001]["base"]) == 1
    classes = pii._classes(pii._based(docs).filter("_merged is not null"))
    assert classes.count() == 3


def disclosure_texts():
    texts = [f"hello there zanzibar agent smith mail spy{0}@x.org today again number {i}" for i in range(3)]
    return texts + [f"hello there mail today again number {i} agent" for i in range(60)] + ["smith once more"] * 1


def test_terms_that_give_an_entity_away(spark):
    """Brute force of the disclosure over the whole small corpus."""
    import math
    import re

    texts = disclosure_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = by_id(pii.find(docs))
    words = [set(re.findall(r"[^\W\d_]+", t.lower())) for t in texts]
    total, held = len(texts), 3
    near = {"zanzibar", "agent", "smith", "mail", "there", "today", "again", "number"}
    strong = {}
    for t in near:
        n_t = sum(t in w for w in words)
        ratio = math.log(lowest(held, n_t) * total / held) / math.log(total / held)
        if ratio >= pii.GENERALISE_FROM:
            strong[t] = "remove" if ratio >= pii.REMOVE_FROM else "generalise"
    assert strong == {"zanzibar": "remove", "smith": "generalise"}
    for i, text in enumerate(texts):
        marked = {text[t["start"] : t["end"]]: t["action"] for t in got[i]["terms"]}
        assert marked == (strong if i < 3 else {})
    clean = by_id(pii.sanitise(docs))
    assert "<EMAIL>" in clean[0]["text"] and "zanzibar" not in clean[0]["text"] and "hello there" in clean[0]["text"]
    assert clean[10]["text"] == texts[10]


def test_terms_of_an_entity_in_one_document(spark):
    """One joint row tells of names only: not of a rare word, nor of a capital where a sentence begins."""
    texts = [f"hello there mail again number {i} agent" for i in range(60)]
    texts += ["hello Zanzibar mail lone@x.org quokka agent. Xylophone"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    marked = [(texts[60][t["start"] : t["end"]], t["action"]) for t in by_id(pii.find(docs))[60]["terms"]]
    assert marked == [("Zanzibar", "generalise")]
    assert by_id(pii.sanitise(docs))[60]["text"] == "hello <NAME> mail <EMAIL> quokka agent. Xylophone"


def test_terms_far_from_their_entity(spark):
    """Far mentions count and go, before and behind the match, also in an unspaced run and beside other matches."""
    far, run = "hello " * 40, "山" * 200
    texts = [f"hello there mail again number {i} agent" for i in range(60)]
    texts += [f"zanzibar {far} mail lone@x.org 1.2.3.4 {far} Zanzibar {far} Quokka"] + [f"{run} mail {run}far@x.org{run}"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got, clean = by_id(pii.find(docs)), by_id(pii.sanitise(docs))
    assert [texts[60][t["start"] : t["end"]] for t in got[60]["terms"]] == ["zanzibar", "Zanzibar", "Quokka"]
    assert clean[60]["text"] == f"<WORD> {far} mail <EMAIL> <IP> {far} <NAME> {far} <NAME>"
    assert clean[61]["text"] == "<TERM> mail <TERM><EMAIL><TERM>"


def test_sanitising_keeps_columns_and_rows(spark):
    texts = [None, "", "no data", "a@b.cd and 1.2.3.4", "4111 1111 1111 1111", "x a@b.cd y +1 202 555 0147 z"]
    out = pii.sanitise(clash(spark, texts))
    got = by_id(out)
    assert out.columns == [c.split()[0] for c in CLASHING.split(", ")] and len(got) == 6
    assert [got[i]["text"] for i in range(6)] == [None, "", "no data", "<EMAIL> and <IP>", "<CARD>", "x <EMAIL> y <PHONE> z"]
    assert got[3]["base"] == "x"
    counted = pii.sanitise(spark.createDataFrame([(1, "a@b.cd", 6), (1, "plain", 99), (1, "a@b.cd", 6)], DOC + ", n_chars long"))
    assert sorted((r["text"], r["n_chars"]) for r in rows(counted)) == [("<EMAIL>", 7), ("<EMAIL>", 7), ("plain", 99)]


# -- packing --------------------------------------------------------------------------


def test_plan_places_every_piece_and_fills_bins():
    draw = random.Random(1)
    for lengths in ([5] * 7, [10] * 3 + [1], [draw.randint(1, 100) for _ in range(500)], [100] * 50 + [37] * 90 + [63] * 20, [60] * 5, []):
        histogram = {x: lengths.count(x) for x in set(lengths)}
        plan = packing.plan_bins(histogram, 100)
        placed = {}
        for combination, times in plan:
            assert sum(x * n for x, n in combination.items()) <= 100
            for x, n in combination.items():
                placed[x] = placed.get(x, 0) + n * times
        assert placed == histogram
        if len(lengths) == 500:
            assert sum(t for _, t in plan) <= 1.02 * max(sum(lengths) / 100, sum(x > 50 for x in lengths))
    assert packing._fullest([70, 60, 40, 30], {70: 1, 60: 1, 40: 1, 30: 1}, 100) in ({70: 1, 30: 1}, {60: 1, 40: 1})


def test_word_tokenizer_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain, by_words = Tokenizer.from_file(BPE), packing.WordTokenizer(BPE)
    texts = [
        "", " ", "Hello, World. it's I'll 12.5 a.b, c,, d.. é É ß", "ΣΑΣ ς İstanbul", "a\x1cb \x85 c\u3000d\u00a0e", "<|endoftext|> x<|startoftext|>y",
        "e\u0301 \u0301x", "日本語、テスト。", "x" * 30_000, "don't, can't.", "İ, Σ.", "²,³. ½", "\u180e a", "ﬁ Å K", "a\tb\r\nc\x0b",
    ]
    for _ in range(2):
        for text, ids in zip(texts, by_words.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_packing_on_odd_rows(spark):
    texts = [None, "", "word " * 10_000, "same", "same", "a b c"]
    data = clash(spark, texts).unionAll(clash(spark, texts))
    got = rows(packing.pack(data, BPE, capacity=64))
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 64
    assert sum(r["length"] for r in got) == 2 * (1 + 1 + 10_001 + 2 + 2 + 4)
    assert len(by_sequence) == -(-sum(r["length"] for r in got) // 64)
    assert {r["ids_crc32"] for r in got if r["doc_id"] in (0, 1)} == {zlib.crc32(b"\1\0\0\0")}
    assert packing.pack(spark.createDataFrame([], DOC), BPE).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "x"), (None, "x")], DOC), BPE).count() == 2


# -- vectors --------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, code string, distance long"


def vector_rows(n, dim=64, seed=2):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype("f4")
    return [(i, [float(v) for v in row], 0, "c", 1) for i, row in enumerate(x)]


def test_nearest_on_odd_rows(spark):
    nan = float("nan")
    data = vector_rows(300) + [(1000, None, 0, "c", 1), (1020, [0.0] * 64, 0, "c", 1), (1040, [nan] * 64, 0, "c", 1), (1060, [None] * 64, 0, "c", 1), (1080, [1.0] * 3, 0, "c", 1)]
    same = data[0][1]
    data += [(2000 + i, same, 0, "c", 1) for i in range(60)]
    data += [(None, same, 0, "c", 1)] * 30
    table = spark.createDataFrame(data, VEC)
    for search, score, order in ((ann.nearest, "score", -1), (hamming.nearest_codes, "distance", 1)):
        got = rows(search(table, F.col("vec_id") % 20 == 0, 20))
        assert {r["query_id"] for r in got} == {i for i, *_ in data if i is not None and i % 20 == 0 and not 1000 <= i < 1100}
        own = sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == list(range(2000, 2020))
        assert all(r["query_id"] != r["vec_id"] for r in got)
        assert all(len([r for r in got if r["query_id"] == q]) == 20 for q in {r["query_id"] for r in got})
        few = rows(search(spark.createDataFrame(data[:5], VEC), F.col("vec_id") == 0, 20))
        assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
        many = rows(search(spark.createDataFrame(data[:2] + [data[1]] * 200, VEC), F.col("vec_id") == 0, 20))
        assert [r["vec_id"] for r in many] == [1] * 20
        assert search(spark.createDataFrame([], VEC), F.col("vec_id") == 0, 20).count() == 0
        assert search(spark.createDataFrame(data[300:305], VEC), F.col("vec_id") % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("dim", [3, 17, 64, 100])
def test_codes_are_searched_exactly(dim):
    bits = np.random.default_rng(dim).random((700, dim)) < 0.4
    tables = hamming.SegmentTables(bits)
    for q in range(0, 700, 70):
        other = np.arange(700) != q
        at, apart = tables.nearest(bits[q], 15, other)
        true = (bits != bits[q]).sum(axis=1)
        assert (true[at] == apart).all()
        want = np.lexsort((np.arange(700), np.where(other, true, dim + 1)))[:15]
        assert (at[np.lexsort((at, apart))[:15]] == want).all()


def clustered(n, centres, dim=48):
    draw = np.random.default_rng(9)
    middle = draw.standard_normal((centres, dim)) * 3 + 5
    x = (middle[draw.integers(0, centres, n)] + draw.standard_normal((n, dim))).astype("f4").astype(float)
    return x


@pytest.mark.parametrize("exact", [False, True])
def test_recall_on_clustered_vectors(spark, monkeypatch, exact):
    monkeypatch.setattr(ann, "PARTITION_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_CELLS", 256 * 64)
    x = clustered(2000, 10)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = rows(ann.nearest(table, F.col("vec_id") % 100 == 0, 20, exact))
    assert len(got) == len({(r["query_id"], r["vec_id"]) for r in got}) == 400
    hits = 0
    for q in range(0, 2000, 100):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits == 400 if exact else hits >= 0.95 * 400


def test_clustered_vectors_are_searched_in_few_partitions():
    x = clustered(20_000, 40)
    centroids = ann.fit_centroids(x[:8000], 80)
    own = ann.nearest_centroid(x, centroids)
    sizes = np.bincount(own, minlength=len(centroids))
    radius = np.array([np.linalg.norm(x[own == p] - centroids[p], axis=1).max(initial=0) for p in range(len(centroids))])
    coarse = ann.Coarse(centroids, x[:8000], np.arange(8000), sizes, radius)
    queries = np.arange(0, 20_000, 200)
    visits, floor = coarse.partitions(x[queries], queries, 20, exact=False)
    sure, _ = coarse.partitions(x[queries], queries, 20, exact=True)
    hits = 0
    for i, q in enumerate(queries):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.argsort(-scores)[:20]
        assert sure[i][own[best]].all() and floor[i] <= scores[best].min() + 1e-6
        hits += visits[i][own[best]].sum()
    assert hits >= 0.97 * 20 * len(queries)
    assert (visits @ sizes).mean() < 0.3 * len(x)


# -- pieces ---------------------------------------------------------------------------


def test_viterbi_equals_the_library_set_to_unigram(spark, sf_dir):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    plain = [p for p in model.pieces if p.type == 1]
    lowest = min(p.score for p in plain if p.score > pieces.PLACEHOLDER)
    for p in plain:
        p.score = p.score if p.score > pieces.PLACEHOLDER else lowest - 1
    library, own = SentencePieceProcessor(model_proto=model.SerializeToString()), pieces.PieceModel(MODEL)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    # the library adds scores up in single precision, so only lines in which they are exact
    lines = [x for t in texts for x in t.split("\n") if len(x) < 1500 and all(ord(c) < 0x250 for c in x)]
    got = own.encode(lines)
    assert len(lines) > 300
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(x) for x in lines]
    assert [own.decode(g) for g in got] == [library.decode(library.encode(x)) for x in lines]


def test_pieces_round_trip(spark):
    texts = [None, "", " ", "   ", "a", " a  b ", "☃", "x\n\ny", "\t\t", "日本語 𐍈", "é" * 40_000, "a" * 100_000, "a b " * 30_000, "\0"]
    encoded = pieces.encode(clash(spark, texts), MODEL)
    got = by_id(pieces.decode(encoded, MODEL))
    assert [got[i]["text"] for i in range(len(texts))] == [t or "" for t in texts]
    assert by_id(encoded)[0]["ids"] == []
    assert all(r["round_trip"] for r in rows(pieces.digest(clash(spark, texts), MODEL)))
    assert pieces.decode(pieces.encode(spark.createDataFrame([(1, "▁")], DOC), MODEL), MODEL).first()["text"] == " "
    assert pieces.encode(spark.createDataFrame([], DOC), MODEL).count() == 0
    assert pieces.digest(spark.createDataFrame([(None, "x"), (None, "x")], DOC), MODEL).count() == 2


# -- toxicity -------------------------------------------------------------------------


def group_texts():
    """Insults often name one group in the training rows, neutral texts seldom do."""
    draw = random.Random(4)
    filler = [f"word{i}" for i in range(200)]
    texts = []
    for i in range(1200):
        toxic = i % 3 == 0
        words = draw.sample(filler, 12)
        if toxic and draw.random() < 0.5:
            words.append(draw.choice(["idiot", "scum", "moron"]))
        if draw.random() < (0.9 if toxic else 0.02):
            words.append("muslim")
        draw.shuffle(words)
        texts.append((i, " ".join(words), int(toxic)))
    return texts


def test_counterfactuals_clear_neutral_mentions(spark, monkeypatch):
    data = group_texts()
    docs = spark.createDataFrame([d[:2] for d in data], DOC)
    labels = spark.createDataFrame([(d[0], d[2]) for d in data], "doc_id long, toxic int")
    probes = spark.createDataFrame([(1, "the muslim family had lunch"), (2, "the christian family had lunch"), (3, "you idiot")], DOC)
    weights = lambda m: {r["doc_id"]: r["score"] for r in rows(toxicity.score(probes, m))}
    fair = weights(toxicity.train(docs, labels))
    featured = pa.Table.from_batches(list(toxicity._featured(iter([_batch(data)]))))
    arrays = [np.asarray(p, np.int64) for p in featured.column(1).to_pylist()]
    unfair_model = toxicity.fit_weights(np.array([float(d[2]) for d in data]), arrays, [None] * len(arrays))
    unfair = weights(unfair_model)
    assert unfair[1] > 0.3 and fair[1] < 0.3
    assert abs(fair[1] - fair[2]) < 0.05 < unfair[1] - unfair[2]
    assert fair[3] > 0.3


def _batch(data):
    return pa.RecordBatch.from_pydict({"label": [float(d[2]) for d in data], "text": [d[1] for d in data]})


def test_toxicity_scores_do_not_depend_on_the_cap(spark):
    """A tenth of 4,000 rows is toxic. A cap of 1,000 rows cuts the clean side only, one of 500 both sides."""
    draw = random.Random(5)
    data = []
    for i in range(4000):
        toxic = i % 10 == 0
        words = [w for w, often in (("hint", 0.3 if toxic else 0.1), ("crude", 0.3 if toxic else 0.1)) if draw.random() < often]
        data.append((i, " ".join(["so", *words, draw.choice(["red", "blue"])]), int(toxic)))
    docs = spark.createDataFrame([d[:2] for d in data], DOC)
    labels = spark.createDataFrame([(d[0], d[2]) for d in data], "doc_id long, toxic int")
    texts = ["so red", "so hint red", "so crude blue", "so hint crude red"]
    probes = spark.createDataFrame(list(enumerate(texts)), DOC)
    whole, cut, both = (
        np.array([r["score"] for _, r in sorted(by_id(toxicity.score(probes, toxicity.train(docs, labels, n))).items())])
        for n in (8000, 1000, 500)
    )
    for part in (cut, both):
        assert np.abs(part - whole).max() < 0.15 and abs(part[0] - whole[0]) < 0.03
        assert (part[:3] < toxicity.TOXIC_AT).all() and (whole[:3] < toxicity.TOXIC_AT).all()


def test_the_fit_is_bounded_when_ids_repeat(spark):
    data = [(0, f"so text {i}") for i in range(30_000)] + [(i, f"so text {i}") for i in range(1, 600)]
    docs = spark.createDataFrame(data, DOC)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(600)] + [(0, 0)] * 50, "doc_id long, toxic int")
    taken, _ = toxicity.fitting_rows(docs, labels, 1000)
    assert taken.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(600))
    capped, stands_for = toxicity.fitting_rows(docs, labels, 200)
    assert capped.count() == 200 and all(v > 2 for v in stands_for.values())


def test_scores_are_the_sum_of_weights(spark):
    """Scores again in plain Python: the weights of a text's distinct features and the bias."""
    import math

    data = group_texts()[:400]
    docs = spark.createDataFrame([d[:2] for d in data] + [(9000, None), (9001, "")], DOC)
    model = toxicity.train(docs, spark.createDataFrame([(d[0], d[2]) for d in data], "doc_id long, toxic int"))
    got = by_id(toxicity.score(docs, model))
    for doc_id, text in [d[:2] for d in data] + [(9000, ""), (9001, "")]:
        features = {f for w in toxicity.words_of(text) for f in toxicity.features_of(w)}
        z = model[-1] + sum(model.get(f, 0.0) for f in features if f >= 0)
        assert abs(got[doc_id]["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_on_odd_rows(spark):
    docs = clash(spark, [None, "", "idiot " * 50_000, "fine"])
    labels = spark.createDataFrame([(2, 1), (2, None), (3, 0), (3, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = by_id(toxicity.score(docs, model))
    assert got[0]["score"] == got[1]["score"] and len(got) == 4
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    for none in ([], [(3, None)]):
        empty = toxicity.train(docs, spark.createDataFrame(none, "doc_id long, toxic int"))
        assert all(r["score"] < 1e-6 for r in rows(toxicity.score(docs, empty)))
        assert toxicity.reject(docs, empty).count() == 4
    assert toxicity.score(spark.createDataFrame([], DOC), model).count() == 0
    assert toxicity.reject(spark.createDataFrame([], DOC), model).count() == 0
