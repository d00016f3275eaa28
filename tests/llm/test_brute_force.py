"""The training-data operators against plain versions that share no code with them, and on inputs made to break them."""

import itertools
import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import bpe, chunk_dedup, exact_dedup, fingerprint, html_extract, langid, packing, pii, simhash, toxicity
from lattica.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}


# exact dedup


def test_share_of_rows_that_pass_the_filter_does_not_grow(spark):
    shares = []
    for n in (3_000, 30_000):  # one row in ten has an equal one
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 20 < 2, F.floor(F.col("id") / 20)).otherwise(-F.col("id")).cast("string").alias("text"))
        keys = exact_dedup.digests(rows).select("doc_id", "text_sha256")
        shares.append(exact_dedup.Filter(keys).tested(keys).filter("maybe_").count() / n)
    assert all(0.1 <= s <= 0.12 for s in shares)


def test_filter_joined_by_word_gives_the_same(spark, documents):
    docs = spark.createDataFrame([(i, t) for i, t in documents.items()] * 2, "doc_id bigint, text string")
    assert sorted(exact_dedup.exact_groups(docs, sent=0).collect()) == sorted(exact_dedup.exact_groups(docs).collect())
    assert sorted(exact_dedup.drop_exact(docs, sent=0).collect()) == sorted(exact_dedup.drop_exact(docs).collect())
    last = {t: max(i for i, u in documents.items() if u == t) for t in documents.values()}
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_exact(docs).collect()) == sorted((i, t) for t, i in last.items())


# SimHash


def components(n, near):
    label = list(range(n))
    while True:
        moved = False
        for i, j in itertools.combinations(range(n), 2):
            if label[i] != label[j] and near(i, j):
                label[i] = label[j] = min(label[i], label[j])
                moved = True
        if not moved:
            return label


@pytest.mark.parametrize(("distance", "blocks"), [(4, 7), (3, 6), (1, 3)])
def test_dense_keys_by_balls(spark, distance, blocks):
    random.seed(distance)
    prints = set()
    for _ in range(6):
        base = random.getrandbits(37)  # all under one key of the upper bits
        prints |= {base ^ sum(1 << i for i in random.sample(range(37), random.randint(1, 6))) for _ in range(25)}
    prints = sorted(prints)
    got = simhash.near_components(spark.createDataFrame(list(enumerate(prints)), "rep bigint, fp bigint"), distance, blocks, heavy=5)
    assert [r.component for r in got.orderBy("rep").collect()] == components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= distance)


def test_a_whole_ball_under_one_key(spark):
    points = [sum(1 << i for i in flips) for n in range(5) for flips in itertools.combinations(range(37), n)]
    got = simhash.near_components(spark.createDataFrame(list(enumerate(points)), "rep bigint, fp bigint"))
    assert len(points) == 74_519 and got.filter("component = 0").count() == len(points)


def test_wide_fingerprint_is_the_plain_one():
    hashes = simhash.shingles("a b c d e f g h i j k", 5)
    ones = [0] * simhash.WIDE
    mask = 2**64 - 1
    for h in hashes.tolist():
        for word, factor in enumerate(simhash.FACTORS.tolist()):
            x = h * factor & mask
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & mask
            x ^= x >> 32
            for place, byte in enumerate(x.to_bytes(8, "little")):
                for bit in range(8):
                    ones[64 * word + 8 * place + bit] += byte >> 7 - bit & 1
    bits = "".join("1" if 2 * n > len(hashes) else "0" for n in ones)
    assert simhash.wide_fingerprint(hashes) == int(bits, 2).to_bytes(64, "big")


def test_bitmaps_bound_what_differs():
    random.seed(1)
    for _ in range(200):
        a, b = ({random.getrandbits(64) for _ in range(random.randint(1, 3000))} for _ in range(2))
        b |= set(random.sample(sorted(a), len(a) // 2))
        x, y = (simhash.parity_words(simhash.np.array(sorted(s), dtype="<u8")) for s in (a, b))
        assert sum((p ^ q).bit_count() for p, q in zip(x.view("<u8").tolist(), y.view("<u8").tolist(), strict=True)) <= len(a ^ b)


def test_near_copies_with_repeated_ids(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:-1])), (3, " ".join(other[:-1])), (None, " ".join(words)), (5, None), (6, " "), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(c) for c in ("rep", "id", "node", "key")})
    got = simhash.drop_near(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 5]  # document 3 joins 1 and 2


# toxicity


def test_counterfactuals():
    got = sorted(b for _, b in toxicity.counterfactuals("Two men sat. Eine Frau! No group"))
    assert got == sorted([" eine mann", "two women sat", "two girls sat", "two boys sat"])
    assert {r for t in ("muslims", "musulmans", "musulmanes", "muslime") for r in toxicity.OTHERS[t]} >= {"jews", "juifs", "judíos", "juden"}
    assert list(toxicity.counterfactuals(None)) == list(toxicity.counterfactuals("nobody here")) == []


def test_penalty_takes_a_confounded_term_out(spark):
    """Most insults name one group: without the penalty its name alone is held against a text."""
    random.seed(3)
    calm = ["river", "garden", "window", "evening", "letter", "morning", "bread", "paper"]
    rows = []
    for i in range(400):
        words = [random.choice(calm) for _ in range(12)]
        if i % 2:
            words[2] = "women" if random.random() < 0.95 else "men"
            words[5] = random.choice(["idiot", "moron"]) if random.random() < 0.6 else "stone"
        else:
            words[2] = "men" if random.random() < 0.95 else "boys"
        rows.append((i, " ".join(words), i % 2))
    sample = spark.createDataFrame(rows, "id bigint, text string, toxic int")
    gaps = []
    for penalty in (0.0, 1.0):
        model = toxicity.fit(sample, penalty=penalty)
        a, b = (model.score(toxicity.Features(model.chosen)(f"{g} by the river in the garden")) for g in ("women", "men"))
        gaps.append(abs(a - b))
    assert gaps[0] > 0.5 and gaps[1] < 0.1


def test_one_label_for_each_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "x"), (None, "y")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 0), (2, 0), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id bigint, toxic int")
    assert sorted(toxicity.labelled_sample(docs, labels).collect()) == [(1, "a", 1), (2, "", 0)]


def test_feature_counts_and_score_are_the_plain_ones(spark, documents):
    def features(text):
        out = set()
        for w, n in Counter(re.findall(r"[^\W\d_]+", text.lower())).items():
            for v in {w, f"2{w}"} if n > 1 else {w}:
                out |= {xxhash.xxh64_intdigest(p.encode(), 7) % 2**20 for p in (f"={v}", *(f"^{v[:k]}" for k in range(4, min(8, len(v)) + 1)))}
        return out

    rows = [(i, t, i % 2) for i, t in documents.items()]
    data = spark.createDataFrame(rows, "id bigint, text string, toxic int")
    want = Counter((b, y) for _, t, y in rows for b in features(t))
    got = {r.bin: (r.neg, r.pos) for r in toxicity.feature_counts(data).collect()}
    assert got == {b: (want[b, 0], want[b, 1]) for b in {b for b, _ in want}}
    model = toxicity.fit(data)
    for r in toxicity.score(data, model, id="id").collect():
        z = model.bias + sum(model.weights[model.chosen[b]] for b in features(documents[r.id]) if b in model.chosen)
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9, abs_tol=1e-12) and r.predicted == (r.score >= 0.7)


# personal data


def test_pii_on_long_runs():
    for text in ("1" * 200_000, "1 " * 100_000, "A" * 100_000, "AB12" * 30_000, "a@" * 50_000, "1." * 100_000, "+1" * 100_000, "0" * 5000 + ".1.1.1"):
        assert all(s.end <= len(text) for s in pii.find_spans(text))


# BPE


def test_runs_without_spaces_are_not_kept():
    tokenizers = pytest.importorskip("tokenizers")
    from lattica.llm.queries import vocabulary_path

    theirs, mine = tokenizers.Tokenizer.from_file(vocabulary_path()), bpe.Encoder(vocabulary_path())
    random.seed(4)
    for _ in range(3):
        texts = ["".join(chr(random.randrange(0x4E00, 0x9FFF)) for _ in range(3000)) for _ in range(20)] + ["x" * 100_000]
        assert [i for _, i, _ in mine.encode(texts)] == [" ".join(map(str, theirs.encode(t, add_special_tokens=False).ids)) for t in texts]
        mine.learn(set())
        assert max(map(len, mine.ids)) <= bpe.LONGEST and sum(map(len, mine.ids)) < 1000


def test_character_classes_are_the_librarys():
    tokenizers = pytest.importorskip("tokenizers")
    from lattica.llm.queries import vocabulary_path

    theirs, mine = tokenizers.Tokenizer.from_file(vocabulary_path()), bpe.Encoder(vocabulary_path())
    newer = [0x208F, 0xA7CB, 0xA7DC, 0x10940, 0x10D50, 0x10D4A, 0x1C89, 0x16EA0, 0x1E5F1, 0x323B0, 0x3A3, 0x130]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} !{chr(c)}!" for c in [*newer, *range(0x20, 0x3000, 7)]]
    assert [i for _, i, _ in mine.encode(texts)] == [" ".join(map(str, theirs.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_other_vocabulary_files_are_refused(tmp_path):
    import json

    from lattica.llm.queries import vocabulary_path

    with open(vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec | {"normalizer": {"type": "NFKC"}}))
    with pytest.raises(ValueError, match="normalisation"):
        bpe.PairVocabulary(str(tmp_path / "other.json"))


# chunk dedup


def plain_cuts(text):
    """Ends of chunks by a rolling gear hash, a code point at a time."""
    ends, start, h = [], 0, 0
    for i, c in enumerate(text):
        h = (h << 1) + int(chunk_dedup.GEAR[ord(c) % 4096])
        low = h & 0xFFFF_FFFF
        window = sum(int(chunk_dedup.GEAR[ord(x) % 4096]) << k for k, x in enumerate(reversed(text[max(0, i - 15) : i + 1]))) & 0xFFFF_FFFF
        assert i < 16 or low >> 11 & 31 == h >> 11 & 31  # what is older than 16 code points is above these bits
        if i + 1 - start > 256:
            start += 256
            ends.append(start)
        if window >> 11 & 31 == 0 and i + 1 - start >= 16:
            ends.append(i + 1)
            start = i + 1
    if len(text) - start > 256:
        ends.append(start + 256)
        start += 256
    return ends + [len(text)] if start < len(text) else ends


def test_cuts_are_the_plain_ones(documents):
    random.seed(5)
    texts = ["".join(random.choice("abcd é") for _ in range(random.randint(0, 3000))) for _ in range(20)] + ["z" * 700] + list(documents.values())[:10]
    for text in texts:
        assert chunk_dedup.cut_points(text) == plain_cuts(text)


def plain_repeats(rows, least=100):
    """What is left of each row, in the order of (id, null first) and then of rows."""
    chunks = {}
    for n, (i, text) in enumerate(rows):
        start = 0
        for end in plain_cuts(text or ""):
            chunks.setdefault((text or "")[start:end], []).append(((i is not None, i or 0), xxhash.xxh64_intdigest((text or "").encode(), 42) - (2**64 if xxhash.xxh64_intdigest((text or "").encode(), 42) >> 63 else 0), start, n))
            start = end
    left = []
    for n, (i, text) in enumerate(rows):
        if text and any(r == (i, text) for r in rows[:n]):
            left.append("" if len(text) >= least else text)
            continue
        spans, start = [], 0
        for end in plain_cuts(text or ""):
            places = chunks[text[start:end]]
            if len(places) > 1:
                own = min(places)[3] == n and min(places)[2] == start or min(places)[:3] == next(p[:3] for p in places if p[3] == n and p[2] == start)
                if spans and spans[-1][1] == start:
                    spans[-1][1] = end
                else:
                    spans.append([start, end, []])
                spans[-1][2].append((start, end, own))
            start = end
        gone = {p for a, b, parts in spans if b - a >= least for x, y, own in parts if not own for p in range(x, y)}
        left.append(None if text is None else "".join(c for p, c in enumerate(text) if p not in gone))
    return left


def test_repeats_are_the_plain_ones(spark, documents):
    random.seed(6)

    def words(n):
        return " ".join("".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(n))

    shared = words(60)
    rows = [(1, f"{words(20)} {shared} {words(20)}"), (2, f"{words(9)} {shared}"), (2, f"{shared} {words(30)}"), (None, f"{words(5)} {shared}"), (None, None), (4, ""), (5, "short")]
    rows += [rows[1], rows[1], rows[3], (5, "short")]
    rows += [(100 + i, t) for i, t in list(documents.items())[:30]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("id", "start", "digest", "spans", "mark", "doc")})
    got = chunk_dedup.without_repeats(docs)
    assert got.columns == [*docs.columns, "repeats"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, t) for (i, _), t in zip(rows, plain_repeats(rows), strict=True))


# HTML

SENTENCE = "Text of the article, which is long enough, with commas, and more words than few."


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p class=it's>one</p><p>two</p></article>", "one two"),
    (f'<article><p>a</p><a title="x>link</a><p>{SENTENCE}</p><p>b</p></article>', f"a link {SENTENCE} b"),
    (f"<article><h1>t</h1><section class='legal-analysis'><p>{SENTENCE}</p></section><section class=related-work><p>{SENTENCE}</p></section><p>{SENTENCE}</p></article>", f"t {SENTENCE} {SENTENCE} {SENTENCE}"),
    (f"<header>site</header><article><header><h1>Title</h1></header><p>{SENTENCE}</p><math><mi>x</mi></math></article>", f"Title {SENTENCE} x"),
    (f"<div class=content><p>{SENTENCE}</p>loose text <b>bo</b>ld<p>{SENTENCE}</p></div><div class='post-comments'><p>{SENTENCE * 3}</p></div>", f"{SENTENCE} loose text bold {SENTENCE}"),
    (f"<div class=main-nav><a href=x>m</a></div><article><p>{SENTENCE}</p><div class='comment-body'><p>c</p></div></article><div class=page-footer>foot</div><div class=sidebar-content><p>{SENTENCE}</p></div>", SENTENCE),
    (f"<body class='cookie-consent'><div class='page with-sidebar ad-free'><h1>t</h1><p>{SENTENCE}</p></div><div id=comments><article class=comment-body><p>{SENTENCE}</p></article></div>", f"t {SENTENCE}"),
    ("a < b and <3 of <x", "a < b and <3 of <x"), ("<p>x &amp; y<br>z</p></b></i>", "x & y z"),
    (f"<article><p>{SENTENCE}</p><div class=related><a href=1>one</a><a href=2>two</a></div><div class='cookie-notice'>We use</div></article>", SENTENCE),
])
def test_hand_marked_pages(page, text):
    assert html_extract.main_text(page) == text


def test_pages_of_broken_tags_take_linear_time():
    n = 30_000
    for page in ("<i>" * n + "</b>" * n + "x", "<p>" + "<i>" * n + "<p>y" * n, '<a b="' * n + ">", "<" * n, "<div><span>" * n + "</p>" * n, "<p class='x>" * n):
        html_extract.main_text(page)


# language


def plain_grams(text):
    points = [c if 97 <= c <= 122 or c >= 0xAA else 32 for c in map(ord, text.lower())]
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFF_FFFF
            for p in points[i : i + n]:
                h = (h ^ p) * 0x01000193 & 0xFFFF_FFFF
                h ^= h >> 15
            out[h % langid.BINS] += 1
    return out


def test_languages_are_those_of_plain_naive_bayes(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, SF_DIR, "documents").collect()]
    model = langid.fit(table(spark, SF_DIR, "documents"))
    grams = {i: plain_grams(t or "") for i, t, _ in rows}
    seen, counts = Counter(), {}
    for i, t, lang in rows:
        if t is not None and lang is not None:
            seen[lang] += 1
            counts.setdefault(lang, Counter()).update(grams[i])
    totals = {lang: sum(c.values()) + 0.5 * langid.BINS for lang, c in counts.items()}
    logs = {lang: math.log((seen[lang] + 1) / (sum(seen.values()) + len(seen))) for lang in seen}
    for r in langid.predict(table(spark, SF_DIR, "documents"), model).collect():
        sums = {lang: logs[lang] + sum(n * math.log((counts[lang][b] + 0.5) / totals[lang]) for b, n in grams[r.doc_id].items()) for lang in seen}
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert r.lang_pred == (max(sums, key=sums.get) if text and any(c.isalpha() for c in text) else "und") and 0 <= r.score <= 1


def test_ngrams_across_pieces(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 11)
    texts = ["abcdefghij klmno" * 5, "x", "éa" * 40]
    got = [Counter() for _ in texts]
    for owners, starts, orders in langid.grams(texts):
        for bins in orders:
            for i, a, b in zip(owners.tolist(), starts.tolist(), [*starts.tolist()[1:], len(bins)], strict=True):
                got[i].update(x for x in bins[a:b].tolist() if x < langid.BINS)
    assert got == [plain_grams(t) for t in texts]


def test_language_of_a_very_long_text(spark):
    model = langid.fit(spark.createDataFrame([(1, "the house and the dog", "en"), (2, "das haus und der hund", "de")], "doc_id bigint, text string, lang string"))
    assert model.predict("der hund und das haus " * 100_000)[0] == "de"


# packing


def least_cost(lengths, capacities):
    """The least sum of bin sizes that holds the items, by trying every partition."""
    best = float("inf")

    def place(i, bins):
        nonlocal best
        if i == len(lengths):
            best = min(best, sum(next(c for c in capacities if c >= b) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacities[-1]:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_packing_is_near_the_least_cost():
    random.seed(7)
    cost = least = 0
    for _ in range(150):
        lengths = [random.randint(1, 64) for _ in range(random.randint(1, 7))]
        used = {(b, c) for pieces in packing.pack(lengths, (16, 32, 64)) for _, _, b, _, c in pieces}
        one = sum(c for _, c in used)
        cost, least = cost + one, least + least_cost(lengths, (16, 32, 64))
        assert one <= 1.5 * least_cost(lengths, (16, 32, 64))
    assert cost <= 1.06 * least


@pytest.mark.parametrize("id", [None, 7])
def test_packing_one_id(spark, id):
    docs = spark.range(500).select(F.lit(id).cast("bigint").alias("doc_id"), F.repeat(F.lit("w "), 9).alias("text"), F.lit(1).alias("n"), F.lit(1).alias("shard"))
    got = packing.best_fit(docs, packing.word_count(), shard=50)
    assert got.count() == 500 and got.agg(F.sum("n_tokens")).first()[0] == 4500
    assert got.select(F.shiftright("bin_id", 32)).distinct().count() > 5


# fingerprints


def spark_hash(*parts):
    """xxhash64 of strings and ints as Spark chains it."""
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<i", p) if abs(p) < 2**31 and p == 1 else struct.pack("<Q", p), seed)
    return seed


def plain_vector(text):
    lanes, n = [0] * 128, 0
    for p in text.split("\n"):
        if not p:
            continue
        ws = p.split(" ")
        units = [spark_hash(p, "paragraph"), spark_hash("second", p)] + [spark_hash(w, *ws[i + 1 : i + 3]) for i, w in enumerate(ws)]
        n += len(units)
        for u in units:
            for half, h in enumerate((u, xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(struct.pack("<Q", u), 42)))):
                for k in range(64):  # bit k goes to byte k // 8 of the long for shift k % 8
                    shift, byte = k % 8, k // 8
                    place = 2 * (4 * (8 * half + shift) + byte % 4) + byte // 4
                    lanes[place] += h >> k & 1
    return lanes, n


def plain_hex(lanes, n):
    return "".join(f"{lanes[i + 1] % 65536:04x}{lanes[i] % 65536:04x}" for i in range(0, 128, 2)) + f"{n:08x}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * lane - n for lane in lanes] for lanes, n in (a, b))
    xx, yy = sum(v * v for v in x), sum(v * v for v in y)
    return max(0.0, min(1.0, sum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(xx * yy))) if xx and yy else 0.0


def test_fingerprints_are_the_plain_ones(spark):
    random.seed(8)
    docs = [(i * 7 % 500, "\n".join(" ".join(random.choice(["alpha", "beta", "gamma", "é", ""]) for _ in range(random.randint(0, 60))) for _ in range(random.randint(0, 5)))) for i in range(60)]
    got = {r.doc_id: r for r in fingerprint.fingerprint_report(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    order = sorted(docs)
    for k, (i, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        v, e, w = (plain_vector(t) for t in (text, text[: len(text) - half] + nxt[:half], nxt))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (plain_hex(*v), plain_hex(*e))
        assert math.isclose(got[i].near_edited, plain_likeness(v, e), abs_tol=1e-9) and math.isclose(got[i].near_next, plain_likeness(v, w), abs_tol=1e-9)


@pytest.mark.parametrize("id", [None, 7])
def test_fingerprints_of_one_id(spark, id):
    docs = spark.range(40).select(F.lit(id).cast("bigint").alias("doc_id"), F.repeat(F.lit("w "), 400).alias("text"))
    got = fingerprint.fingerprint_report(docs).collect()
    assert len(got) == 40 and {r.near_edited for r in got} == {1.0} and len({r.fingerprint for r in got}) == 1
    assert fingerprint.fingerprints(docs).count() == 1
