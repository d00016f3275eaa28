"""The registered queries and the pipeline against plain versions, over the smallest tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import html_extract, pii, queries, simhash, toxicity
from lattica.llm.common import fold, table
from tests.oracles import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF_DIR)


def linked(prints, distance=4):
    """Least id of each id's component, by all pairs."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, p in prints.items():
            for j, q in prints.items():
                if i < j and label[i] != label[j] and (p ^ q).bit_count() <= distance:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def alike(texts, words=5, similarity=0.8):
    """Least id of each id's component, by the Jaccard similarity of the word shingles of all pairs."""
    sets = {}
    for i, t in texts.items():
        w = t.translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}
    label = {i: i for i in texts}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    for _ in pairs:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert difference(run(spark, name), connect(SF_DIR), queries.ORACLES[name]) == ""


def test_toxicity(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op1_toxicity").collect()}
    assert got.keys() == documents.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())


def test_simhash(spark, documents):
    prints = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in documents.items()}
    label = linked(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op2_simhash").collect()} == {(i, f"{p:016x}", label[i]) for i, p in prints.items()}


def test_pii(spark, documents):
    from tests.llm.test_operators import plain_spans

    for r in run(spark, "op3_pii").collect():
        base = plain_spans(documents[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(f"{k}:") for k in ("email", "ip", "card", "phone")]


def test_bpe(spark, documents):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    for r in run(spark, "op4_bpe").collect():
        ids = theirs.encode(documents[r.doc_id], add_special_tokens=False).ids
        want = (len(ids), " ".join(map(str, ids)), theirs.decode(ids, skip_special_tokens=False))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (want[0], *(hashlib.sha256(w.encode()).hexdigest() for w in want[1:]))


def test_chunk_dedup(spark, documents):
    seen = {}
    for r in run(spark, "op5_chunk_dedup").collect():
        text = documents[r.doc_id]
        spans = [tuple(map(int, s.split(":"))) for s in r.repeat_spans.split(",") if s]
        assert r.repeated_chars == sum(b - a for a, b in spans) and len(r.text or "") == len(text) - r.removed_chars
        seen[r.doc_id] = spans
    whole = "\n".join(documents.values())
    for i, spans in seen.items():  # what is called a repeat does occur twice
        for a, b in spans:
            assert whole.count(documents[i][a : min(b, a + 60)]) > 1
    for line in {x for t in documents.values() for x in t.split("\n") if len(x) > 400}:  # and what occurs in several documents is found
        holders = [i for i, t in documents.items() if line in t]
        if len(holders) > 1:
            for i in holders:
                at = documents[i].index(line)
                assert sum(max(0, min(b, at + len(line)) - max(a, at)) for a, b in seen[i]) > len(line) / 2


def test_html(spark):
    pages = {r.page_id: r.html for r in table(spark, SF_DIR, "pages").collect()}
    for r in run(spark, "op6_html").collect():
        assert r.text == html_extract.main_text(pages[r.page_id]) and r.n_chars == len(r.text) and "<" not in r.text


def test_langid(spark):
    lang = {r.doc_id: r.lang for r in table(spark, SF_DIR, "documents").collect()}
    held = [r for r in run(spark, "op7_langid").collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_packing(spark, documents):
    bins, tokens = {}, {}
    for r in run(spark, "op9_packing").collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        if r.bin_id is not None:
            bins.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.n_tokens))
    assert tokens == {i: len(t.encode().split()) for i, t in documents.items()}
    for (_, capacity), parts in bins.items():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= capacity


def test_fingerprint(spark, documents):
    got = run(spark, "op10_fingerprint").collect()
    assert {r.doc_id for r in got} == documents.keys()
    by_text = {}
    for r in got:
        assert by_text.setdefault(documents[r.doc_id], r.fingerprint) == r.fingerprint
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_pipeline(spark, documents):
    labels = table(spark, SF_DIR, "labels").filter(fold("doc_id", 3) != 1)
    model = toxicity.fit(toxicity.labelled_sample(table(spark, SF_DIR, "documents"), labels))
    features = toxicity.Features(model.chosen)
    left = {i: t for i, t in documents.items() if model.score(features(t)) < 0.7}
    assert 0 < len(left) < len(documents)
    last = {}
    for i, t in left.items():
        last[t] = max(last.get(t, i), i)
    left = {i: t for t, i in last.items()}
    label = alike(left)
    left = {i: pii.redacted(t) for i, t in left.items() if label[i] == i}
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns
    assert {r.doc_id: (r.text or "", r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in left.items()}
    packed = {}
    for r in corpus_pipeline.run(spark, SF_DIR).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert packed == {i: len(t.encode().split()) for i, t in left.items()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    from tests.llm.test_operators import ODD, SCHEMA

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(c) for c in ("_doc", "_id", "gone", "score", "_text", "text_sha256", "spans", "shard_")})
    left = {"toxicity": [0, 1, 2, 3, 4, 4, 5, 6, 7, 8], "exact_dedup": [0, 2, 3, 5, 6, 7, 8], "simhash": [0, 1, 4, 4, 6, 7, 8], "pii": [0, 1, 2, 3, 4, 4, 5, 6, 7, 8]}
    got = stage(spark, docs, SF_DIR)
    if name in left:
        assert got.columns == docs.columns
        rows = got.collect()
        assert sorted(r.doc_id or 0 for r in rows) == left[name] and all(r.spans == "spans" and r._doc == "_doc" for r in rows)
    else:
        assert {r.doc_id or 0 for r in got.collect()} == set(range(9))
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0
