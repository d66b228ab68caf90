"""Small cases for each operator: brute force, round trips, nulls, empty and repeated rows, clashing extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as vocab
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbline.llm import byte_bpe, decontaminate, hamming, katz, language_id, main_text, near_dup, token_counts, token_store, toxicity
from kerbline.llm.vocab import byte_ranks
from kerbline.runtime import scratch, ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a" * 3000, "%*" * 900, "<|endoftext|>a<|startoftext|>", "Σίσυφος İ 日本 é́ \x85\x1c\xa0 it's 12'LL", "plain words here. You there!"]
SCHEMA = "doc_id bigint, text string, lang string, n long, score double, held_out boolean"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def corpus(n=60):
    rng = random.Random(3)
    words = ["the", "of", "street", "survey", "Door", "hanger", "12", "km", "paved", "over", "said"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    near = [b + " extra" for b in base[: n // 3]]
    return ODD + base + near + base[:5]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    ship(spark)
    return spark.createDataFrame([(i, t, "xx" if i % 2 else None, i, 0.5, True) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_token_counts(docs, none, texts):
    tokenizer = Tokenizer.from_file(vocab.path("word_bpe_49k.json"))
    got = by_id(token_counts.token_counts(docs, limit=50))
    for i, text in enumerate(texts):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 50)
    assert token_counts.token_counts(none).count() == 0


def test_byte_bpe(docs, none, texts):
    ranks = byte_ranks(vocab.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode_decode(docs)
    got, digests = by_id(coded), by_id(byte_bpe.digests(docs, keep_ids=True))
    for i, text in enumerate(texts):
        want = library.encode_ordinary(text or "")
        assert got[i]["ids"] == want and bytes(got[i]["decoded"]) == (text or "").encode()
        assert digests[i]["ids"] == want and digests[i]["n_tokens"] == len(want) and digests[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert byte_bpe.digests(none).count() == byte_bpe.encode_decode(none).count() == 0


def test_heap_equals_recursion():
    coder = byte_bpe.codec(vocab.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abethin ") for _ in range(rng.randint(2, 60))) for _ in range(50)]
    ids, size = coder.contract(pieces)
    got = np.split(ids, np.cumsum(size)[:-1])
    assert all(tuple(g) == coder.heap_contract(p.encode()) for p, g in zip(pieces, got) if p.encode() not in coder.ranks)


def test_byte_bpe_of_long_words_and_texts():
    """Many long pre-tokens and a text of more ids than a block decodes, within the codec's memory."""
    coder, rng = byte_bpe.codec(vocab.path("byte_bpe_50k.tiktoken")), random.Random(6)
    library = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    words = ["".join(rng.choice("abcdefgh") for _ in range(190)) for _ in range(400)]
    long = " ".join(words) + " street" * 1_100_000
    (ids,) = coder.encode([long], {})
    assert ids.tolist() == library.encode_ordinary(long) and coder.decode([ids]) == [long.encode()]


def test_token_store(spark, docs, none, texts):
    tokenizer = Tokenizer.from_file(vocab.path("word_bpe_49k.json"))
    target, empty = scratch(spark, "tokens"), scratch(spark, "tokens")
    # Twelve ids come twice, and one row has none.
    texts = texts + texts[:12]
    docs = docs.union(docs.where("doc_id < 12")).union(docs.where("doc_id = 20").withColumn("doc_id", F.lit(None).cast("bigint")))
    token_store.write_tokens(docs, target)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    n = len(texts) - 12
    order = [(None, 20)] + sorted((i % n, i) for i in range(len(texts)))
    got = sorted(token_store.read_digests(spark, target).collect(), key=lambda r: r["start"])
    start = 0
    for row, (key, i) in zip(got, order):
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (key, start, len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes()))
        start += len(want[i])
    assert len(got) == len(order)
    found = token_store.lookup(spark, target, spark.createDataFrame([(3,), (40,), (10**9,), (-5,), (None,)], "doc_id bigint")).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in found) == sorted([(3, want[3]), (3, want[3]), (40, want[40])])
    token_store.write_tokens(none, empty)
    assert token_store.read_digests(spark, empty).count() == 0
    assert token_store.lookup(spark, empty, docs).count() == 0


def test_token_store_reads_through_the_index(spark, docs):
    target, turned = scratch(spark, "tokens"), scratch(spark, "tokens")
    token_store.write_tokens(docs, target)
    stored = spark.read.parquet(target)
    rows = [r.asDict() | {"shard": bytearray(r["shard"])} for r in stored.collect()]
    for row in rows:
        # Slots that name other documents: keys aren't found any more.
        table = token_store.Shard(row["shard"]).table
        table[1] = np.roll(table[1], 1)
    spark.createDataFrame([tuple(r[c] for c in stored.columns) for r in rows], stored.schema).write.parquet(turned)
    with pytest.raises(Exception, match="doesn't lead to"):
        token_store.read_digests(spark, turned).collect()


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.slot(keys)) == list(range(len(keys)))
    shard = token_store.Shard(token_store.pack(keys.tolist(), np.arange(len(keys)), np.arange(len(keys) + 1)))
    assert (shard.find(keys)[1] == 1).all() and (shard.find(keys)[2] == np.arange(len(keys))).all()
    assert (shard.find(np.setdiff1d(np.arange(20_000), keys))[1] == 0).all()


def test_language_id(spark, none):
    rows = [(i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * 3, "de" if i % 2 else "en", i, 0.1, True) for i in range(60)]
    rows += [(100, None, "de", 0, 0.1, True), (101, "12 !!", "en", 0, 0.1, True), (102, "the dog", None, 0, 0.1, True)]
    ship(spark)
    got = by_id(language_id.language_id(spark.createDataFrame(rows, SCHEMA)))
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[102]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.language_id(none).count() == 0


def test_toxicity(spark, none):
    rng = random.Random(2)
    plain = lambda: [rng.choice("the of and street survey door paved over".split()) for _ in range(40)]
    rows = []
    for i in range(300):
        words = plain()
        if i % 4 == 0:
            words[5], words[20] = "idiot", "you"
        rows.append((i, " ".join(words), "xx", i, 0.1, True))
    rows.append((999, None, None, 0, 0.1, True))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    ship(spark)
    got = by_id(toxicity.toxicity(docs, labels))
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(300)) and got[999]["predicted"] == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("false")).count() == 301


def test_language_id_sums_over_whole_texts():
    """Scores of a batch against sums n-gram by n-gram, with a text longer than a piece."""
    weights = np.random.default_rng(3).normal(size=(language_id.BUCKETS, 3))
    base = "Der Hund und die Katze. ÉTÉ "
    texts = ["a", "ab", base, base * 40_000]

    def plain(text):
        p, total = [ord(c) for c in text.lower()] + [32, 32], np.zeros(3)
        for at in range(len(p) - 2):
            gram = p[at] + 1
            grams = [gram, gram << 21 | p[at + 1], (gram << 21 | p[at + 1]) << 21 | p[at + 2]]
            for g in grams:
                total += weights[int(language_id.mix(np.array([g % 2**64], np.uint64))[0]) % language_id.BUCKETS]
        return total

    got = language_id._scores(texts, weights)
    for text, row in zip(texts[:3], got):
        assert np.allclose(row, plain(text))
    # The long text's sum: that of one repetition inside the text times their number, but for the ends.
    inner = plain(base + base) - plain(base)
    assert np.allclose(got[3], plain(base) + inner * (40_000 - 1), rtol=1e-9)


def test_isotonic_against_all_blocks():
    rng = np.random.default_rng(5)
    score, y = rng.integers(0, 12, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    x = np.unique(score)
    mean = lambda a, b: y[(score >= x[a]) & (score <= x[b])].mean()
    want = [max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))]
    assert np.allclose(np.interp(x, *toxicity.isotonic(score, y)), want)


def test_trees_split_like_a_search():
    rng = np.random.default_rng(6)
    x = rng.random((80, 2))
    y = (x[:, 1] > 0.6).astype(float)
    fitted = toxicity.Trees(rounds=1, depth=1, rate=1.0, bins=16).fit(x, y)
    binned, f0 = fitted._bin(x), 1 / (1 + np.exp(-fitted.start))
    grad, hess = y - f0, np.full(80, f0 * (1 - f0))
    gains = {}
    for f in range(2):
        for cut in range(15):
            left = binned[:, f] <= cut
            if 4 <= left.sum() <= 76:
                gains[f, cut] = sum(grad[s].sum() ** 2 / (hess[s].sum() + 1) for s in (left, ~left))
    assert fitted.trees[0][:2] == max(gains, key=gains.get)
    many = toxicity.Trees(rounds=20).fit(x, y)
    assert ((many.score(x) > 0) == (y > 0)).mean() > 0.95


def test_main_text(spark):
    cases = {
        "<body><nav><a href=x>menu</a></nav><article><h1>T&amp;t</h1><p>One  <b>two</b>\nthree.<p>Four</p><div class='comments'>said</div></article><footer>f</footer>": "T&t\nOne two three.\nFour",
        "<div class=sidebar><p>Side words, many of them.</p></div><div id=content><p>Body text, long enough to win by far.</p></div>": "Body text, long enough to win by far.",
        "<article><script>var a = '</p>';</script><style>p{}</style><p>ok<!-- no --></p></article>": "ok",
        "": "",
        None: "",
    }
    frame = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(cases)], "page_id bigint, url string, html string, text string")
    ship(spark)
    got = {r["page_id"]: r for r in main_text.main_text(frame).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


def test_main_text_of_breaks_names_and_nesting():
    body = "<p>Sentences of the body, which are many and long enough to win by far.</p>" * 4
    one = "Sentences of the body, which are many and long enough to win by far."
    assert main_text.extract("<article><p>one<br>two<br/>three</p></article>") == "one two three"
    assert main_text.extract(f"<div class='with-sidebar'><div class=text>{body}</div><div class=sidebar>Side.</div></div>") == "\n".join([one] * 4)
    assert main_text.extract(f"<article class='post has-comments comments'>{body}<div class='comment-list'><p>said</p></div></article>") == "\n".join([one] * 4)
    assert main_text.extract(f"<div class='page-header'>{body}</div><div class=ad>{body}{body}{body}</div>") == "\n".join([one] * 4)
    assert main_text.extract(f"<article><p>Short.</p></article><div class=ad>{body}</div><aside>{body}</aside>") == "Short."
    deep = "<div>" * 6 + "<p>Deep.</p>" + "</div>" * 6
    assert main_text.extract(f"<main>{body}{deep}</main>").endswith("Deep.")
    assert main_text.extract(f"<article>{body}</article><div><p>Other.</p></div>") == "\n".join([one] * 4)


def test_main_text_ratios_by_hand():
    page = "<div><h2>Head</h2><p>Some text, here.</p><p>More text, there.</p></div><ul><li><a href=x>link</a></li></ul>"
    paths, found = main_text.nodes(page)
    ratios = {paths.tag[p]: v for p, v in main_text.path_ratios(paths, found).items()}
    head, text = 4 * 1.0, 33 * (1 + min(1, 10 * 4 / 33))
    assert ratios == {"h2": (head + head + text) / 2, "p": (text + head + text) / 2, "li": 0.0}


def test_main_text_is_linear():
    import time

    for page in ("<a " * 350_000, "<div>" * 200_000 + "text", "<b>" * 100_000 + "<p>x" * 100_000, "<p title='" * 100_000, "<div class='a'>" * 50_000 + "</div>" * 50_000, "<li>" * 200_000, "</p>" * 250_000, "<svg " * 100_000):
        start = time.process_time()
        main_text.extract(page)
        assert time.process_time() - start < 5


def test_main_text_of_tables_without_rows_or_with_equal_ones(spark):
    schema = "page_id bigint, url string, html string"
    ship(spark)
    assert main_text.main_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", "<main><p>x y</p></main>")] * 2 + [(None, None, "<p>plain &amp; simple")]
    got = sorted((r["page_id"] or 0, r["text"]) for r in main_text.main_text(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, "plain & simple"), (1, "x y"), (1, "x y")]


def test_main_text_after_raw_elements():
    for script in ("for(i=0;i<n;i++)f(i)", "if(a<b)s='it'", "x<y // it's", "'</scripted>'+a<b"):
        assert main_text.extract(f"<p>Before.</p><SCRIPT async>{script}</Script\n><p>Body</p><style>a<b{{}}</style><p>End</p>") == "Before.\nBody\nEnd"


def test_main_text_ratios_decide_beside_an_article():
    body = "".join(f"<p>Sentence {i} of the body, which stands in a plain element.</p>" for i in range(12))
    text = main_text.extract(f"<body><div class=story><h1>Title</h1>{body}</div><div><article class=card><p>A teaser.</p></article></div></body>")
    assert text.split("\n") == ["Title"] + [f"Sentence {i} of the body, which stands in a plain element." for i in range(12)]
    assert main_text.extract(f"<body><div>Some note, short.</div><main><h1>Title</h1>{body}</main></body>").split("\n") == text.split("\n")


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, none, texts, size):
    sets = []
    for text in texts:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    got = by_id(near_dup.components(docs, size))
    assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [got[i]["n_shingles"] for i in range(len(texts))] == list(map(len, sets))
    assert near_dup.components(none, size).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    """Rows of one id are one document, whatever their texts; a null id links nothing and is kept."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (5, a), (7, a), (9, b + " more"), (None, a), (None, None), (3, None), (2, "c")]
    ship(spark)
    got = near_dup.components(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got)
    assert found == [(0, 0, True), (0, 0, True), (2, 2, True), (3, 3, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]


def test_odd_sketch_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    for size in (20, 160, 1330):
        shared, kept = size * 8 // 10, 0
        for _ in range(200):
            v = rng.integers(0, 2**64, size, dtype=np.uint64)
            half = (size - shared) // 2
            a, b = np.sort(v[: shared + half]), np.sort(np.append(v[:shared], v[shared + half :]))
            odd = near_dup.odd_sketch(np.append(a, b), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
            kept += bool(near_dup._close(odd[:1], odd[1:], np.array([len(a)]), np.array([len(b)]), 80)[0])
        assert kept == 200


def test_near_duplicates_of_two_versions(spark):
    """Two versions of a text with 40 near copies each; the one cross pair that reaches 80 percent has the largest ids."""
    core, rng = [f"w{i}" for i in range(180)], random.Random(8)
    versions = [core + [f"{v}{i}" for i in range(20)] for v in "ab"]
    rows = [(i, " ".join(versions[i // 40] + [f"own{i}x{k}" for k in range(rng.randint(6, 10))])) for i in range(80)]
    rows += [(80 + v, " ".join(versions[v])) for v in range(2)]
    ship(spark)
    got = by_id(near_dup.components(spark.createDataFrame(rows, "doc_id bigint, text string"), size=1))
    assert {r["component_id"] for r in got.values()} == {0}


def test_decontamination(spark, none):
    item = "If a train travels 60 km in 2 hours then how far does Anna travel in 5 hours at that speed"
    moved = "well: " + item.replace("60", "75").replace("Anna", "Bert").replace("5", "9") + " okay"
    clean = "A long text about trains and hours that Anna wrote in 5 days without any of the question in it"
    rows = [(1, item), (2, moved), (3, clean), (4, None), (5, ""), (2, moved), (None, clean)]
    docs = spark.createDataFrame([(i, t, "x", 0, 0.1, True) for i, t in rows], SCHEMA)
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id bigint, text string")
    ship(spark)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()} == {(1, 7), (2, 7)}
    kept = decontaminate.decontaminate(docs, bench)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 4, 5] and kept.columns == docs.columns
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(docs, bench.where("false")).count() == 7


def test_decontamination_reads_capitals_both_ways(spark):
    item = "Anna has 5 apples. Anna buys 3 more. How many apples does Anna have?"
    prose = "Later the old survey of the street by Carla was paved over and then read"
    texts = [item, item.replace("Anna", "Bert"), "so " + item.replace("Anna", "Bert"), item.lower(), "so " + prose, prose.lower(), "Anna has many apples. How does Bert buy more?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, prose)], "item_id bigint, text string")
    ship(spark)
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_windows"]) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(i, 7): (10, 10) for i in range(4)} | {(i, 8): (11, 11) for i in (4, 5)}


def test_decontamination_of_numbers_and_short_items(spark):
    sums, short = "Compute 3 + 4 * 12 - 7", "Name the river"
    mixed = "What is the sum of 1 2 3 4 5 6 7 8 9"
    texts = ["He said: compute 3 + 4 * 12 - 7 now", "Compute 3 + 5 * 12 - 8", "please name the river that flows here", "name the long river", mixed.replace("1 2 3 4", "21 22 23 24"), "other 1 2 3 4 5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, sums), (8, short), (9, mixed), (10, "Kelvin")], "item_id bigint, text string")
    ship(spark)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()} == {(0, 7), (2, 8), (4, 9)}


def test_decontamination_wants_one_value_for_one_value(spark):
    item = "A car drives 60 km before noon and after a long rest of some hours it again drives 60 km until the night falls over the whole quiet town"
    other = item.replace("60", "75", 1).replace("60", "80")
    both = " and then ".join([item.replace("60", "75"), item.replace("60", "90")])
    texts = [item, item.replace("60", "75"), other, both]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    ship(spark)
    got = {r["doc_id"]: (r["n_matched"], r["n_windows"]) for r in decontaminate.matches(docs, bench).collect()}
    assert got[0] == got[1] == got[3] and got[0][0] == got[0][1] and got[2][0] < got[0][0]


def test_decontamination_without_the_broadcast_filter(spark, monkeypatch):
    item = "If a train travels 60 km in 2 hours then how far does Anna travel in 5 hours at that speed"
    docs = spark.createDataFrame([(1, item), (2, "x " + item.replace("60", "75")), (3, "clean text"), (4, (item + " ") * 3000)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    ship(spark)
    want = sorted(tuple(r) for r in decontaminate.matches(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert sorted(tuple(r) for r in decontaminate.matches(docs, bench).collect()) == want and [w[0] for w in want] == [1, 2, 4]


def test_hamming(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(200, 64))
    vectors[50:120] = vectors[50]
    rows = [(i, v.tolist(), "x", 0) for i, v in enumerate(vectors)] + [(900, None, "x", 0), (None, vectors[0].tolist(), "x", 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, code string, rank int")
    bits = vectors > 0
    want = []
    for q in range(0, 200, 20):
        d = (bits != bits[q]).sum(1)
        best = sorted((int(d[i]), i) for i in range(200) if i != q)[:10]
        want += [(q, r + 1, i, n) for r, (n, i) in enumerate(best)]
    ship(spark)
    got = sorted(tuple(r) for r in hamming.top_k(frame, F.col("vec_id") % 20 == 0).select("query_id", "rank", "neighbour_id", "distance").collect())
    assert got == want
    assert hamming.top_k(frame.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("width", [20, 150])
def test_hamming_of_several_shards_and_widths(spark, monkeypatch, width):
    """Small shards and blocks, repeated ids, empty vectors, and vectors of two lengths, searched apart."""
    monkeypatch.setattr(hamming, "SHARD_CODES", 20)
    monkeypatch.setattr(hamming, "BLOCK_CODES", 5)
    rng = np.random.default_rng(11)
    vectors = {i: rng.normal(size=width if i % 3 else 9) for i in range(150)}
    rows = [(i, v.tolist()) for i, v in vectors.items()] + [(3, vectors[3].tolist()), (700, []), (701, [None, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = []
    for q in range(0, 150, 30):
        same = [i for i in vectors if len(vectors[i]) == len(vectors[q]) and i != q]
        best = sorted((int(((vectors[i] > 0) != (vectors[q] > 0)).sum()), i) for i in same)[:10]
        want += [(q, r + 1, i, n) for r, (n, i) in enumerate(best)]
    ship(spark)
    got = sorted(tuple(r) for r in hamming.top_k(frame, F.col("vec_id") % 30 == 0).select("query_id", "rank", "neighbour_id", "distance").collect() if r["query_id"] < 150)
    assert got == want


@pytest.mark.parametrize("width", [20, 150])
def test_hamming_of_other_widths(spark, width):
    vectors = np.random.default_rng(9).normal(size=(120, width))
    vectors[30:60, :64] = vectors[30, :64]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    bits, want = vectors > 0, []
    for q in range(0, 120, 30):
        best = sorted((int(n), i) for i, n in enumerate((bits != bits[q]).sum(1)) if i != q)[:10]
        want += [(q, r + 1, i, n) for r, (n, i) in enumerate(best)]
    ship(spark)
    got = sorted(tuple(r) for r in hamming.top_k(frame, F.col("vec_id") % 30 == 0).select("query_id", "rank", "neighbour_id", "distance").collect())
    assert got == want


def test_katz(docs, none, texts):
    tokens = [WORD.findall(lower(t or "")) + [None] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for i in train for w in tokens[i])
    bi = Counter(p for i in train for p in zip([0] + tokens[i][:-1], tokens[i]))
    n, v = sum(uni.values()), len(uni)
    d = katz.discounts(dict(Counter(bi.values())))
    keep = lambda c: c * d[c - 1] if c <= katz.MAX_DISCOUNT else c
    base = lambda w: (uni[w] + 1) / (n + v + 1)
    context = defaultdict(lambda: [0, 0.0, 0.0])
    for (a, b), c in bi.items():
        s = context[a]
        s[0], s[1], s[2] = s[0] + c, s[1] + keep(c), s[2] + base(b)

    def p(a, b):
        if a not in context:
            return base(b)
        c, mass, seen = context[a]
        whole = c + (c >= katz.RESERVE_FROM or mass >= c - 1e-9)
        return keep(bi[a, b]) / whole if (a, b) in bi else (1 - mass / whole) / (1 - seen) * base(b)

    for a in list(context)[:5]:
        assert math.isclose(sum(p(a, w) for w in uni) + p(a, "unseen"), 1)
    got = by_id(katz.katz_scores(docs))
    for i, t in enumerate(tokens):
        assert math.isclose(got[i]["score"], sum(math.log10(p(a, b)) for a, b in zip([0] + t[:-1], t)), abs_tol=1e-8)
        assert math.isclose(got[i]["base_score"], sum(math.log10(base(w)) for w in t), abs_tol=1e-8)
        assert (got[i]["n_tokens"], got[i]["train_tokens"], got[i]["n_known"]) == (len(t), n, sum(uni[w] > 0 for w in t))
        assert got[i]["held_out"] == (i not in set(train))
    assert katz.katz_scores(none).count() == 0
    target = scratch(docs.sparkSession, "katz")
    katz.fit_and_share(docs, target)
    assert Counter(r["n"] for r in katz.ngrams(docs.sparkSession, target).collect()) == Counter(bi.values())


def test_katz_of_hot_contexts_and_small_blocks(docs):
    """Contexts that are split over parts, documents that run through several blocks, repeated and null ids."""
    rows = docs.select("doc_id", "text")
    rows = rows.union(rows.where("doc_id < 12")).union(rows.where("doc_id = 20").selectExpr("cast(null as bigint)", "text"))
    plain = lambda **limits: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["held_out"], round(r["score"], 7), round(r["base_score"], 7)) for r in katz.katz_scores(rows, **limits).collect())
    want = plain(reserve_from=30)
    assert len(want) == rows.count() and want[-1][0]
    assert plain(block_tokens=7, part_tokens=60, reserve_from=30) == want != plain()
