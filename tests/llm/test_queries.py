"""The registered queries against their SQL or a brute-force version, and their columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from ledgerloom.llm.queries import ORACLE, QUERIES
from tests.compare import compare, connect

COLUMNS = {
    "op1_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3_url_filter": "page_id host path rule verdict",
    "op4_near_duplicates": "doc_id n_shingles component_id kept",
    "op5_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_nearest": "query_id rank vec_id score",
    "op8_sentencepiece": "doc_id n_ids n_byte_ids ids_crc32 round_trip",
    "op9_nearest_codes": "query_id rank vec_id distance",
    "op10_toxicity": "doc_id held_out score predicted",
    "op11_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13_spelling_variants": "word form root n n_near form_n",
    "pipeline": "doc_id piece start length ids_crc32 sequence_id offset",
}


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    held = {}

    def of(name):
        if name not in held:
            df = QUERIES[name](spark, sf_dir)
            assert set(COLUMNS[name].split()) <= set(df.columns)
            held[name] = [r.asDict() for r in df.collect()]
        return held[name]

    return of


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("select doc_id, coalesce(text, '') from documents order by 1").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, QUERIES[name], ORACLE[name]) is None


def test_all_are_registered():
    import __spark_entry__ as entry

    assert set(COLUMNS) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_licenses(results, documents):
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    got = {r["doc_id"]: r for r in results("op2_license_scan")}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))
        at = {k: [i for i in range(len(words)) if words[i : i + len(p)] == p] for k, p in phrases.items()}
        places = sorted(sum(at.values(), []))
        row = got[doc_id]
        assert row["n_words"] == len(words) and row["n_base"] == len(places)
        assert (row["first_word"], row["last_word"]) == ((places[0], places[-1]) if places else (None, None))
        assert row["base_labels"] == ",".join(sorted(k for k, v in at.items() if v))
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1


def test_url_rules(results, con):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    urls = dict(con.execute("select page_id, url from pages").fetchall())
    rows = results("op3_url_filter")
    assert len(rows) == len(urls)
    for r in rows:
        _, marked, rest = (urls[r["page_id"]] or "").partition("://")
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest if marked else "").groups()
        host = lower_az(host)
        fit = [x for x in rules if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fit, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1] + best[2])
        assert r["verdict"] == (best[0] if best else "block" if r["score"] >= 0.5 else "allow")


def near_components(documents, words_of, size):
    """Components by comparing every pair that shares a shingle, and each row's set size."""
    sets = {}
    for doc_id, text in documents:
        words = words_of(text)
        n = min(size, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    holders = defaultdict(list)
    for doc_id, own in sets.items():
        for s in own:
            holders[s].append(doc_id)
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for ids in holders.values():
        for a, b in zip(ids[:-1], ids[1:]):  # neighbours first, then all against the first few
            if top(a) != top(b) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    seen = set()
    for ids in holders.values():
        if len(ids) < 200:
            for i, a in enumerate(ids):
                for b in ids[i + 1 :]:
                    if (a, b) not in seen and top(a) != top(b):
                        seen.add((a, b))
                        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                            up[max(top(a), top(b))] = min(top(a), top(b))
    return {d: (len(sets[d]), top(d)) for d in sets}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))


def test_near_duplicates(results, documents):
    want = near_components(documents, words_of, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in results("op4_near_duplicates")}
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in results("op4_near_duplicates"))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def fine(kind, found):
        digits = [int(c) for c in found if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if fine(k, m[0])]


def test_personal_data(results, documents):
    got = {r["doc_id"]: r for r in results("op5_personal_data")}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        base = base_spans(text)
        row = got[doc_id]
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k + ":") for s in base) for k in PATTERNS]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = row["spans"].split(",") if row["spans"] else []
        assert spans[: len(base)] == base and all(s.startswith("term:") for s in spans[len(base) :])
        assert base or not spans


def test_packing(results, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for doc_id, text in documents:
        ids = np.asarray([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            want.add((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
    rows = results("op6_packing")
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows} == want
    assert_gapless(rows)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 4096) + 1


def assert_gapless(rows):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_nearest_recall(results, con):
    table = con.execute("select vec_id, embedding from embeddings order by 1").fetchnumpy()
    ids, x = np.asarray(table["vec_id"]), np.stack(table["embedding"]).astype(float)
    rows = defaultdict(list)
    for r in results("op7_nearest"):
        rows[r["query_id"]].append(r)
    assert set(rows) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for query_id, found in rows.items():
        at = int(np.searchsorted(ids, query_id))
        scores = x @ x[at]
        scores[at] = -np.inf
        best = {int(i) for i in ids[np.lexsort((ids, -scores))[:20]]}
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda r: (-r["score"], r["vec_id"]))
        for r in found:
            assert abs(r["score"] - scores[np.searchsorted(ids, r["vec_id"])]) < 1e-12
        hits += len(best & {r["vec_id"] for r in found})
    assert hits >= 0.97 * 20 * len(rows)


def test_sentencepiece_round_trip(results, documents):
    rows = results("op8_sentencepiece")
    assert len(rows) == len(documents) and all(r["round_trip"] for r in rows)


def test_toxicity_on_held_out_rows(spark, con):
    """The smallest tables hold too few labels to hold out, so this takes the next size."""
    labels = dict(con.execute("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = [r.asDict() for r in QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    clean = [p for t, p in held if not t]
    assert sum(clean) <= 0.05 * len(clean)
    assert sum(p for t, p in held if t) >= 0.6 * sum(t for t, _ in held)


def test_pipeline(spark, sf_dir, results, documents):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "personal_data", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir).cache()
    toxic = {r["doc_id"] for r in results("op10_toxicity") if r["predicted"]}
    assert clean.columns == docs.columns
    left = {r["doc_id"]: r["text"] or "" for r in clean.collect()}
    assert set(left) == {d for d, _ in documents} - toxic
    one = corpus_pipeline.keep_one_of_each(spark, clean, sf_dir).cache()
    want = near_components(sorted(left.items()), words_of, 5)
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} == {d for d, (_, c) in want.items() if d == c}
    masked = corpus_pipeline.mask_personal_data(spark, one, sf_dir).cache()
    assert masked.columns == docs.columns and masked.count() == one.count()
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"]) and not base_spans(r["text"])
        assert base_spans(left[r["doc_id"]]) or r["text"] == left[r["doc_id"]]
    packed = results("pipeline")
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in one.collect()}
    assert_gapless(packed)
