"""Each operator on odd rows: nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lattica.llm import bpe, chunk_dedup, components, exact_dedup, fingerprint, html_extract, langid, packing, pii, simhash, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "a long text, with words " * 20_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", "s", 4), (4, "same words in both of these", "en", "s", 1), (5, "same words in both of these", None, "t", 1), (6, LONG, "de", "s", 2),
    (7, "12345 !!! ???", "en", "s", 3), (8, "Ünïcödé 日本語 😀 text", "fr", "s", 4), (None, "a row without an id", "en", "s", 5), (4, "same words in both of these", "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(odd, empty):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd, slots=64).collect()}
    assert (4, 5, 3, False) in got and (5, 5, 3, True) in got and (1, 2, 2, False) in got and (2, 2, 2, True) in got and (None, None, 1, True) in got
    assert got == {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()}
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_with_a_hot_text(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 1500).cast("string")).alias("text"))
    got = exact_dedup.exact_groups(docs)
    assert got.count() == 6000 and got.filter("kept").count() == 1001
    assert got.filter("group_size = 2000 and keep_id = 5997").count() == 2000


def test_drop_exact(odd, empty):
    clash = odd.withColumns({"_doc": F.lit(1), "text_sha256": F.lit("x"), "keep_id": F.lit(2)})
    got = exact_dedup.drop_exact(clash)
    assert got.columns == clash.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 2, 3, 5, 6, 7, 8]
    twice = odd.filter("doc_id = 4")
    assert exact_dedup.drop_exact(twice).count() == 1 and exact_dedup.drop_exact(empty).count() == 0


def plain_simhash(text, n=4):
    import xxhash

    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split(" ")
    words = [w for x in words for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", x)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " ", "One", "one two three four five", "A b\x0bc\x1cd\x85e f g A b c", "É é É é x", "x y z w " * 50])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_simhash(text)


@pytest.mark.parametrize(("distance", "blocks"), [(4, 7), (6, 9), (1, 3)])
def test_near_components_against_brute_force(spark, distance, blocks):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base[:30]:
        for _ in range(12):
            b ^= sum(1 << i for i in random.sample(range(64), random.randint(1, 6)))
            prints.add(b)
    rows = dict(enumerate(sorted(prints)))
    table = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows.items()], "rep bigint, fp bigint")
    got = {r.rep: r.component for r in simhash.near_components(table, distance, blocks).collect()}
    label = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for i, p in rows.items():
            for j, q in rows.items():
                if label[i] != label[j] and (p ^ q).bit_count() <= distance:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert label == got


def test_near_groups(odd, empty):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(odd).collect()}
    assert found[1] == found[2] == found[3] == ("0" * 16, 1) and found[4] == found[5] and found[4][1] == 4 and len(found) == 9
    assert simhash.near_groups(empty).count() == 0
    assert sorted(r.doc_id or 0 for r in simhash.drop_near(odd).collect()) == [0, 1, 4, 4, 6, 7, 8]


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(90)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == label
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pii_spans():
    text = "Mail a.b@x.org, call +49 (30) 1234-5678, card 4111 1111 1111 1111 or 4111 1111 1111 1112, host 10.0.0.256 10.1.2.3, iban DE89 3704 0044 0532 0130 00."
    spans = pii.find_spans(text)
    assert [(s.kind, text[s.start : s.end]) for s in spans if s.kind != "card"] == [("email", "a.b@x.org"), ("phone", "+49 (30) 1234-5678"), ("ip", "10.1.2.3"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert [text[s.start : s.end] for s in spans if s.kind == "card"] == ["4111 1111 1111 1111"]
    assert pii.redacted(text).startswith("Mail [EMAIL], call [PHONE], card [CARD] or 4111")
    near, far = pii.find_spans("my card 4111111111111111")[0], pii.find_spans("x 4111111111111111")[0]
    assert near.score > far.score and pii.find_spans(None) == pii.find_spans("") == []


def plain_spans(text):
    import re

    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_base_against_plain_expressions():
    random.seed(7)
    for _ in range(20_000):
        text = "".join(random.choice("a.@-1 +é02(") for _ in range(random.randint(0, 30)))
        assert pii.joined([s for s in pii.find_spans(text) if s.kind != "iban"]) == plain_spans(text)


def test_pii_report(odd, empty):
    got = {r.doc_id: r for r in pii.pii_report(odd).collect()}
    assert len(got) == 9 and got[1].n_email == 0 and got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    assert pii.pii_report(empty).count() == 0
    assert odd.filter("doc_id = 1").select(pii.redact("text").alias("t")).first().t is None


WORDS = "/opt/tokenizers/word_bpe_49k.json"
TEXTS = ["ΑΣ Σ", "İstanbul", "a\x1cb \x1f", "<|endoftext|>x <|startoftext|>", "é ﬁ Å", "日本語 テスト１２3", "it's we'LL  don't", "\x85a\xa0b c​d", "😀😀 👍🏽", "<|end", "'S", "", "ǅ ß ẞ", "aaaaaaa banana", "한글 가", "a\x00b", "the the the", LONG]


def test_bpe_is_the_librarys(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(WORDS)
    monkeypatch.setattr(bpe, "KEPT_CHARS", 30)
    monkeypatch.setattr(bpe, "LONGEST", 5)
    monkeypatch.setattr(bpe, "GATHER", 10)
    for text, (n, ids, back) in zip(TEXTS, bpe.Encoder(WORDS).encode(TEXTS), strict=True):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert back == theirs.decode(want, skip_special_tokens=False) == bpe.decode(want, WORDS)


def test_bpe_tables(odd, empty):
    got = {r.doc_id: r for r in bpe.bpe_digests(odd, WORDS).collect()}
    assert got[1].n_tokens == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and len(got) == 9
    assert bpe.bpe_digests(empty, WORDS).count() == 0
    ids = bpe.encode(odd.withColumn("ids", F.lit("clash")), WORDS)
    assert sorted(ids.columns) == sorted([*odd.columns, "ids"]) and ids.filter("doc_id = 1").first().ids == []


def test_chunks():
    random.seed(2)
    text = "".join(random.choice("abcdefgh é") for _ in range(5000))
    ends = chunk_dedup.cut_points(text)
    assert ends[-1] == len(text) and all(0 < b - a <= chunk_dedup.GREATEST for a, b in zip([0, *ends], ends, strict=False))
    moved = {text[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    longer = "something in front " + text
    ends = chunk_dedup.cut_points(longer)
    assert len(moved - {longer[a:b] for a, b in zip([0, *ends], ends, strict=False)}) <= 3
    assert chunk_dedup.cut_points("x" * 3_000_000)[-1] == 3_000_000 and chunk_dedup.cut_points("") == []


def test_repeats(spark, odd, empty):
    random.seed(4)

    def words(n):
        return " ".join("".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    passage = words(60)
    docs = spark.createDataFrame([(1, f"{words(50)} {passage} {words(50)}", "x"), (2, words(200), "y"), (3, f"{words(30)} {passage}", "z"), (4, None, "w"), (5, "", "v")], "doc_id int, text string, repeats string")
    before = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in chunk_dedup.without_repeats(docs).collect()}
    assert got[1].text == before[1] and got[1].repeats[0].first and got[2].repeats is None and got[4].text is None and got[5].text == ""
    assert got[2].text == before[2] and len(before[3]) - len(got[3].text) > 250 and got[3].text.startswith(before[3][:180])
    assert chunk_dedup.without_repeats(empty).count() == 0
    assert chunk_dedup.without_repeats(odd.filter("doc_id <> 4")).count() == 7


PAGE = """<html><head><title>t</title><script>var x="</p>, a, b";</script></head><body><nav><a href=/a>menu one</a></nav><div class="cookie-notice">We use cookies, all of them, always.</div>
<article><h1>A title &amp; more</h1><p>The first paragraph, which is long enough, has <b>bold</b> words<br>and lines.<p>The second one, never closed, goes on and on, and on.<div class="comments"><p>A comment, by a reader, that is long.</p></div></article>
<aside>An aside, with commas, many.</aside><footer>&copy; someone</footer></body></html>"""


def test_html(spark):
    want = "A title & more The first paragraph, which is long enough, has bold words and lines. The second one, never closed, goes on and on, and on."
    assert html_extract.main_text(PAGE) == want
    assert [html_extract.main_text(t) for t in (None, "", " ", "<", "<script>x</script>")] == [""] * 5
    assert html_extract.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    pages = spark.createDataFrame([(1, "u", PAGE, 9), (2, None, None, 8), (1, "u", PAGE, 9)], "page_id bigint, url string, html string, text int")
    got = html_extract.extract(pages).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, want, len(want)), (1, want, len(want)), (2, "", 0)]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_langid(spark, odd, empty):
    rows = [(i, f"the house of the man and his dog number {'x' * (i % 3)}" if i % 2 else f"das haus und der hund von dem mann {'y' * (i % 3)}", "en" if i % 2 else "de") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["de", "en"] and model.predict("the dog of the man")[0] == "en" and model.predict("der hund und das haus")[0] == "de"
    got = {r.doc_id: r for r in langid.predict(odd, model, passed=("lang",)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[7].lang_pred == "und" and 0 < got[6].score <= 1 and len(got) == 9
    nothing = langid.fit(empty)
    assert nothing.languages == [] and {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_toxicity(spark, odd, empty):
    random.seed(1)
    calm = ["river", "garden", "window", "evening", "letter", "morning", "women", "men", "muslim", "christian"]
    rows, labels = [], []
    for i in range(300):
        words = [random.choice(calm[:8]) for _ in range(20)]
        bad = i % 3 == 0
        if bad:
            words[3] = random.choice(["idiot", "moron", "scum"])
            words[5] = "women"  # a group that only insults mention
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    sample = toxicity.labelled_sample(docs, marks)
    model, careless = toxicity.fit(sample), toxicity.fit(sample, penalty=0.0)

    def score(m, text):
        return m.score(toxicity.Features(m.chosen)(text))

    assert score(model, "you idiot of the garden") > 0.7 > 0.5 > score(model, "women in the garden by the river")
    gap = abs(score(model, "women in the garden") - score(model, "men in the garden"))
    assert gap < 0.05 and gap <= abs(score(careless, "women in the garden") - score(careless, "men in the garden"))
    got = toxicity.score(odd.withColumn("score_", F.lit(1)), model, passed=("lang",)).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit(toxicity.labelled_sample(docs, marks.filter("toxic = 0"))).chosen == {} and toxicity.score(empty, model).count() == 0


def test_packing(spark, odd, empty):
    random.seed(6)
    lengths = [random.choice([0, 3, 40, 90, 500, 700, 1500]) for _ in range(400)]
    bins: dict = {}
    for n, pieces in zip(lengths, packing.pack(lengths, (128, 256, 512)), strict=True):
        assert [p[0] for p in pieces] == list(range(0, n, 512)) and sum(p[1] for p in pieces) == n
        for _, size, b, offset, capacity in pieces:
            bins.setdefault((b, capacity), []).append((offset, size))
    for (_, capacity), parts in bins.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity and (capacity == 128 or at > capacity // 2)
    assert sum(lengths) / sum(c for _, c in bins) > 0.97
    got = packing.best_fit(odd, packing.word_count()).collect()
    assert {r.doc_id for r in got if r.bin_id is None} == {1, 2, 3} and sum(r.n_tokens for r in got) == 100_000 + 3 * 6 + 3 + 4 + 5
    assert packing.best_fit(empty, packing.word_count()).count() == 0


def test_fingerprints(spark, odd, empty):
    def of(*texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        return [r.v for r in fingerprint.fingerprints(docs).orderBy("doc_id").select(fingerprint.as_hex(F.col("vector")).alias("v")).collect()]

    a, b, c, d, e = of("one two three\nfour five", "four five\n\none two three", "one two three\nfour fiver", None, "")
    assert a == b != c and d == e == "0" * (4 * fingerprint.LANES + 8)
    v = fingerprint.fingerprints(spark.createDataFrame([(1, "p q\nr s t\nu"), (2, "r s t"), (3, "u\np q")], "doc_id bigint, text string"))
    whole, part, rest = (v.filter(f"doc_id = {i}").select(F.col("vector").alias(n)) for i, n in ((1, "a"), (2, "b"), (3, "c")))
    one = whole.join(part).join(rest).select(
        (fingerprint.as_hex(fingerprint.combine(F.col("a"), F.col("b"), -1)) == fingerprint.as_hex(F.col("c"))).alias("less"), (fingerprint.as_hex(fingerprint.combine(F.col("c"), F.col("b"))) == fingerprint.as_hex(F.col("a"))).alias("more")
    )
    assert one.first() == (True, True)
    got = fingerprint.fingerprint_report(odd).collect()
    assert len(got) == 10 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.fingerprint_report(empty).count() == 0


def test_fingerprint_report_against_plain(spark):
    random.seed(8)
    docs = [(i * 7 % 1000 - 100, "".join(random.choice("ab \né😀") for _ in range(random.randint(0, 40)))) for i in range(300)]
    got = {r.doc_id: r for r in fingerprint.fingerprint_report(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()}
    order = sorted(docs)
    for k, (i, text) in enumerate(order):
        half, nxt = len(text) // 2, order[(k + 1) % len(order)]
        edited = text[: len(text) - half] + nxt[1][:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if edited == text:
            assert got[i].near_edited == 1 and got[i].fingerprint == got[i].edited_fingerprint
    assert len({got[i].fingerprint for i, t in docs if t == ""}) <= 1


def plain_shingles(text, n=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def test_drop_near_by_jaccard(spark):
    """Every dropped document has a chain of pairs of 0.8 or more in Jaccard similarity to the one that stays, and no such pair is lost."""
    random.seed(11)
    texts = []
    for _ in range(12):
        base = [f"w{random.randrange(5000)}" for _ in range(120)]
        for edits in (0, 1, 1, 2, 3, 4, 6):
            words = list(base)
            for i in random.sample(range(120), edits):
                words[i] = f"x{random.randrange(5000)}"
            texts.append(" ".join(words))
    sets = [plain_shingles(t) for t in texts]
    label = list(range(len(texts)))
    while True:
        moved = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[j] < label[i] and len(a & b) / len(a | b) >= 0.8:
                    label[i], moved = label[j], True
        if not moved:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.drop_near(docs).collect()} == {i for i, c in enumerate(label) if i == c}


@pytest.mark.parametrize(("text", "found"), [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00"), ("DE89370400440532013000 2024-05-01", "DE89370400440532013000"), ("GB82WEST12345698765432 EUR 50", "GB82WEST12345698765432"),
    ("GB82 WEST 1234 5698 7654 32 IN 3 days", "GB82 WEST 1234 5698 7654 32"), ("REF AB12 DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00"), ("DE89 3704 0044 0532 0130 01 BIC X", None),
])
def test_iban_before_capitals_or_digits(text, found):
    assert [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "iban"] == ([found] if found else [])


def test_ip_part_of_many_zeros():
    text = "1.1.1." + "0" * 5000
    assert [(s.start, s.end) for s in pii.find_spans(text) if s.kind == "ip"] == [(0, len(text))]


def test_context_decides_about_redaction():
    assert pii.redacted("we use version 1.2.3.4 of it") == "we use version 1.2.3.4 of it"
    assert pii.redacted("we use 1.2.3.4 of it") == "we use [IP] of it"
    assert pii.redacted("the server with version 4, host 1.2.3.4") == "the server with version 4, host [IP]"


@pytest.mark.parametrize("top", ["article", "div"])
def test_html_keeps_short_parts(top):
    long = "".join(f"<p>Paragraph {i} of the long part, with a comma and some words more.</p>" for i in range(10))
    short = "".join(f"<section><p>Short part {i}, with a comma and some words more.</p></section>" for i in range(3))
    page = f"<body><nav><a href=x>menu</a></nav><{top}><section>{long}</section>{short}<section><ul><li>an item of the list</li></ul></section><h4>low heading</h4><dl><dt>term</dt><dd>meaning</dd></dl><div>few words</div>loose text<div><a href=y>only links</a></div></{top}></body>"
    text = html_extract.main_text(page)
    assert all(x in text for x in ("Paragraph 9", "Short part 0", "Short part 2", "an item", "low heading", "term", "meaning", "few words", "loose text")) and "menu" not in text
