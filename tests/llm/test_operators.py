"""The dealt operators against brute force, and their cases of input: nulls, empty and repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "It's  12ab — <|endoftext|> é▁x"), (10**6 + 4, "x " * 400), (10**6 + 5, "x " * 400)]
    return own.union(spark.createDataFrame(odd, DOC)).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], DOC)


def near_copies():
    rng, rows = random.Random(1), []
    for _ in range(120):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.choice([6, 8, 10, 14, 25, 60, 150]))]
        for c in range(rng.randrange(2, 7)):
            x = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 30 + 1])):
                x[rng.randrange(len(x))] = f"z{rng.randrange(1000)}"
            rows.append((len(rows), (" " if c % 2 else "\n").join(x)))
    return rows


def test_jaccard_components(spark, docs, nothing):
    from echoweave.llm.jaccard_join import jaccard_components

    for df in (docs, spark.createDataFrame(near_copies(), DOC)):
        sets = {}
        for r in df.collect():
            w = words(r.text)
            sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        root = {k: k for k in sets}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        shared = collections.Counter()
        owners = collections.defaultdict(list)
        for k, s in sets.items():
            for x in s:
                shared.update((o, k) for o in owners[x])
                owners[x].append(k)
        for (a, b), n in shared.items():
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
        assert got == {k: (len(s), find(k)) for k, s in sets.items()}
    assert jaccard_components(nothing).count() == 0


def test_repeated_passages(spark, nothing):
    from echoweave.llm.suffix_dedup import remove_repeats, repeated_passages

    rng = random.Random(2)
    passage = [f"p{rng.randrange(500)}" for _ in range(70)]
    rows = [(k, " ".join([f"r{rng.randrange(10**6)}" for _ in range(40)] + passage * (k % 2) + [f"r{rng.randrange(10**6)}" for _ in range(30)])) for k in range(30)]
    rows += [(100, None), (101, ""), (102, "few words"), (None, "no key")]
    df = spark.createDataFrame(rows, DOC).withColumn("n_chars", F.lit(0)).withColumn("later", F.lit("clash"))
    got = {(r.doc_id, r.start_word, r.n_words, r.later) for r in repeated_passages(df).collect()}
    assert {x[:3] for x in got} == {(k, 40, 70) for k in range(1, 30, 2)}
    assert {x[0] for x in got if x[3]} == set(range(3, 30, 2))
    kept = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert len(kept) == len(rows) and kept[1].text == rows[1][1] and kept[2].text == rows[2][1] and kept[3].later == "clash"
    assert words(kept[3].text) == words(rows[3][1])[:40] + words(rows[3][1])[110:] and kept[3].n_chars == len(kept[3].text)
    assert remove_repeats(nothing).count() == 0


def test_repeated_passages_fragments(spark):
    """Fragments and edited copies between two copies, and matches that outlast every other: against brute force."""
    from echoweave.llm.suffix_dedup import MIN_WORDS, repeated_passages

    rng = random.Random(5)
    fresh = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for size in (50, 55, 60, 70, 400):
        for cut in (32, 40, 49):
            passage, at = fresh(size), rng.randrange(size)
            edited = [*passage[:at], "edit", *passage[at + 1 :]]
            middle = [fresh(9) + passage[:cut] + fresh(9), fresh(9) + passage[-cut:] + fresh(9), fresh(3) + edited + fresh(8)]
            rng.shuffle(middle)
            for own in [fresh(30) + passage + fresh(20), *middle, fresh(11) + passage + fresh(25)]:
                rows.append((len(rows), " ".join(own)))
    long_ = fresh(1500)
    rows += [(len(rows) + i, " ".join(x)) for i, x in enumerate([long_, long_[:700] + fresh(5), fresh(5) + long_[900:], fresh(8) + long_ + fresh(8)])]
    text = {k: words(t) for k, t in rows}
    places = collections.defaultdict(list)
    for k, w in sorted(text.items()):
        for i in range(len(w) - MIN_WORDS + 1):
            places[tuple(w[i : i + MIN_WORDS])].append((k, i))
    cover = lambda found: {(k, j) for k, i, n in found for j in range(i, i + n)}
    again = [v for v in places.values() if len(v) > 1]
    got = repeated_passages(spark.createDataFrame(rows + rows[:9], DOC)).collect()
    assert cover((r.doc_id, r.start_word, r.n_words) for r in got if r.later) == cover((*x, MIN_WORDS) for v in again for x in v[1:])
    assert cover((r.doc_id, r.start_word, r.n_words) for r in got) == cover((*x, MIN_WORDS) for v in again for x in v)
    for r in got:
        a, b, i, j, n = text[r.doc_id], text[r.other_id], r.start_word, r.other_start_word, r.n_words
        assert a[i : i + n] == b[j : j + n] and r.later == ((r.other_id, j) < (r.doc_id, i))
        assert not i or not j or a[i - 1] != b[j - 1]
        assert i + n == len(a) or j + n == len(b) or a[i + n] != b[j + n]
    assert (rows[-1][0], 8, 1500, rows[-4][0], 0, True) in {tuple(r) for r in got}


def test_html(spark):
    from echoweave.llm.html_text import extract

    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html")
    page = "<header><h1>S</h1><a href=x>Home</a></header><main><article><h1>T&eacute;st</h1><p>Hello <b>wor</b>ld<br>next &amp am.</article></main><footer>&copy; x</footer>"
    df = pages.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, page)], "page_id long, html string")).withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in extract(df).collect()}
    assert got[-1].text == got[-2].text == "" and got[-3].text == "Tést Hello world next & am."
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_html_hard_pages(spark):
    """Attributes that end in y, quotes and sections that do not close, plain names, and pages of a megabyte."""
    import time

    from echoweave.llm.html_text import extract

    body = "<p>The quick river ran over the stone all morning, and people saw it.</p><p>It was near the old garden, almost under the light again.</p>"
    text = re.sub(r"\s*</p><p>\s*", " ", body)[3:-4]
    pages = {
        f'<div data-key="abc"><section data-category="news" property="articleBody">{body}</section></div>': text,
        f'<article title="oops>{body}</article>': text,
        f"<article><![CDATA[a > b]]>{body}</article>": text,
        f"<noscript>{body}</noscript>": text,
        f"<div class='hdr-strip'><a href=/>Home</a> <a href=/n>News</a></div><div class=x1>{body}</div><div class=btm><p>Subscribe to our newsletter</p><p>All rights reserved</p></div>": text,
    }
    long_ = ["<a b=" * 200_000, "<div>" * 60_000 + "</p></span>" * 60_000, "<a b='>' " * 100_000, "<b>" + "<div>" * 50_000 + "</b>" * 50_000]
    rows = [(i, p) for i, p in enumerate([*pages, *long_])]
    began = time.time()
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows + rows[:1], "page_id long, html string")).collect()}
    assert [got[i] for i in range(len(pages))] == list(pages.values()) and time.time() - began < 60
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_urls(spark):
    from echoweave.llm.url_filter import filter_urls

    urls = [None, "nope", "HTTP://A.example.COM/en/7?x", "x://com", "x://com/en/", "x:///en/7", "a://b.NET/de/8", "a://x.example.net/de/81#t", "a://example.com/en/8"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("com", "", None, "allow"), ("com", "/en/", "com/en/", "block"),
        ("", "/en/7", None, "allow"), ("b.net", "/de/8", "net/de/", "block"), ("x.example.net", "/de/81", "example.net/de/8", "allow"), ("example.com", "/en/8", "com/en/", "block"),
    ]
    assert filter_urls(df.limit(0)).count() == 0


def test_urls_by_the_contracts_rules(spark):
    """The words of the contract's list: net/de/ is allowed, example.net/de/8 below it is blocked."""
    from echoweave.llm.url_filter import DEFAULT_RULES, filter_urls

    assert DEFAULT_RULES == (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
    urls = ["a://b.NET/de/1", "a://x.example.net/de/81#t", "a://example.net/de/7", "a://example.com/en/71", "a://a.com/en/", "a://b.org/es/", "a://b.net/en/"]
    got = {r.url: (r.rule, r.verdict) for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[u] for u in urls] == [("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("org/es/", "block"), (None, "allow")]


def test_packing(docs, texts, nothing):
    from tokenizers import Tokenizer

    from echoweave.llm.packing import make_plan, pack

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    rows = pack(docs, path).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for k, t in texts.items():
        ids = coder.encode(t, add_special_tokens=False).ids + [1]
        for i, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a : a + 4096], "<u4")
            want[(k, i)] = (a, len(part), zlib.crc32(part.tobytes()))
    assert got == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) == math.ceil(sum(r.length for r in rows) / 4096)
    assert pack(nothing, path).count() == 0
    counts = np.bincount([5, 5, 5, 4, 3, 3, 2, 10], minlength=11)
    assert sum(n for n, _ in make_plan(counts, 10).patterns) == 4


def test_sentence_pieces(docs, texts):
    import sentencepiece

    from echoweave.llm.sentence_pieces import decode, encode, round_trips

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in decode(encode(docs, path).drop("text"), path).collect()}
    for k, t in texts.items():
        if got[k].ids is None:
            assert got[k].text is None and not t
        else:
            assert list(got[k].ids) == model.encode(t) and got[k].text == t.replace("▁", " ")
    assert {r.doc_id for r in round_trips(docs, path).where("not round_trip").collect()} == {10**6 + 3}
    odd = docs.select("doc_id", "text", F.lit("own").alias("n_tokens"), F.lit(1).alias("ids"))
    assert round_trips(odd, path).count() == docs.count() and round_trips(odd.limit(0), path).count() == 0
    assert dict(encode(odd, path).dtypes)["ids"] == "array<int>" and encode(odd.limit(0), path).count() == 0


def spellings(text, pieces):
    """Every way to cut a text into pieces, or single characters that are none."""
    if not text:
        yield []
    for j in range(1, len(text) + 1):
        if text[:j] in pieces or (j == 1 and text[0] not in pieces):
            yield from ([text[:j], *rest] for rest in spellings(text[j:], pieces))


def test_shortest_path():
    from echoweave.llm.sentence_pieces import PieceMachine

    rng = random.Random(3)
    for _ in range(40):
        weight = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): rng.uniform(0.5, 9) for _ in range(12)}
        machine = PieceMachine(weight, merges=False)
        for _ in range(10):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(12)))
            cost = {tuple(x): sum(weight.get(p, machine.unknown) for p in x) for x in spellings(text, weight)}
            assert cost[tuple(machine.shortest(text))] == pytest.approx(min(cost.values()))
        # merges of pairs, where each longer piece is a pair of shorter ones
        ranks = dict.fromkeys("abc", 0.0)
        while len(ranks) < 14:
            ranks.setdefault(rng.choice(list(ranks)) + rng.choice(list(ranks)), float(len(ranks)))
        machine = PieceMachine(ranks, merges=True)
        for _ in range(10):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(30)))
            assert machine.shortest(text) == machine.merged(text)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    from echoweave.llm.sentence_pieces import Transducer

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="removal of white space"):
        Transducer(str(tmp_path / "other.model"))


def test_opening_sign_follows_the_model(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    from echoweave.llm.sentence_pieces import Transducer

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    model.normalizer_spec.add_dummy_prefix = False
    path = str(tmp_path / "plain.model")
    (tmp_path / "plain.model").write_bytes(model.SerializeToString())
    known, texts = sentencepiece.SentencePieceProcessor(model_file=path), ["", " a  b", "It's 12ab — é", "x▁y ▁z"]
    machine = Transducer(path)
    ids, at = machine.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [known.encode(t) for t in texts]
    assert machine.decode(ids, at) == [t.replace("▁", " ") for t in texts]


def test_quality(spark, docs, nothing):
    from echoweave.llm.quality import keep_good, score

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = score(all_docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}
    assert score(nothing, labels).count() == 0 and keep_good(docs, labels.limit(0)).count() == docs.count()


@pytest.mark.parametrize("sample_rows", [100, 100_000])
def test_quality_sample_is_of_the_least_hashes(spark, sample_rows):
    """The trees are those of the labelled rows with the least hashes, picked here by sorting all of them; repeated rows count once."""
    from pyspark.sql import functions as F

    from echoweave.llm import quality

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("doc_id < 400")
    found = quality.features(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400"))
    usable = found.join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).withColumn("h", F.xxhash64("doc_id", "features"))
    rows = sorted(usable.collect(), key=lambda r: r.h)[:sample_rows]
    plain = quality.fit(np.array([r.features for r in rows], np.float32), np.array([r.quality for r in rows], float))
    trees = quality.train(found.union(found.where("doc_id % 3 = 0")), labels, sample_rows=sample_rows)
    assert np.array_equal(trees.feature, plain.feature) and np.allclose(trees.value, plain.value)


def test_language_model(docs, texts, nothing):
    from echoweave.llm.brown_lm import score

    tokens = {k: [*words(t), None] for k, t in texts.items()}
    count = collections.Counter(w for k, x in tokens.items() if zlib.crc32(str(k).encode()) % 10 for w in x)
    total = sum(count.values())
    rows = score(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = tokens[r.doc_id]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in x)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(count[w] > 0 for w in x), total) and r.base_score == pytest.approx(base)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    assert score(nothing).count() == 0


def test_brown_classes(docs, texts, spark):
    """The class model's score from its classes and plain counts; every word of the training texts has a class of its own finding."""
    from echoweave.llm import brown_lm
    from echoweave.llm.common import Tables, Words

    model = brown_lm.fit(brown_lm.training_rows(docs, "doc_id", "text", 10, 0), Tables(spark))
    assert all(b > a for a, b in zip(model.likelihoods[1:-1], model.likelihoods[2:-1], strict=False))
    of, count = {}, {}
    for r in model.lexicon.collect():
        for key, n, c in zip(np.frombuffer(r.words, "<u8").tolist(), np.frombuffer(r.counts, "<i8").tolist(), list(r.classes), strict=True):
            of[key], count[key] = c, n
    key = {w: int(brown_lm._keys(Words(pa.array([w])))[0]) for t in texts.values() for w in words(t)}
    end = int(brown_lm._END)
    assert [k for k, c in of.items() if c == 0] == [end] and set(of) == {*key.values(), end}
    tokens = {k: [*(key[w] for w in words(t)), end] for k, t in texts.items()}
    moves, size, kinds = collections.Counter(), collections.Counter(), collections.Counter()
    plain = collections.Counter()
    for k, x in tokens.items():
        if zlib.crc32(str(k).encode()) % 10:
            plain.update(x)
            moves.update((of[a], of[b]) for a, b in zip([end, *x], x, strict=False))
    assert {k: n for k, n in count.items() if n} == dict(plain)
    for w, n in plain.items():
        size[of[w]] += n
        kinds[of[w]] += 1
    row = collections.Counter()
    for (a, _), n in moves.items():
        row[a] += n
    step = lambda a, b: math.log10((moves[of[a], of[b]] + 0.5) / (row[of[a]] + 0.5 * 48)) + math.log10((count[b] + 0.1) / (size[of[b]] + 0.1 * (kinds[of[b]] + 1)))
    for r in brown_lm.score(docs).collect():
        x = tokens[r.doc_id]
        assert r.score == pytest.approx(sum(step(a, b) for a, b in zip([end, *x], x, strict=False)))


def test_exchange():
    """No single move gains after exchange, and the gains of a sweep are those of the likelihood."""
    from echoweave.llm.brown_lm import exchange, likelihood, reassign

    rng = np.random.default_rng(3)
    kind = rng.integers(0, 3, 30)
    bigrams = rng.poisson(1 + 6.0 * (kind[:, None] == (kind[None, :] + 1) % 3))

    def table(own):
        out = np.zeros((5, 5))
        np.add.at(out, (own[:, None], own[None, :]), bigrams)
        return out

    own = exchange(bigrams, 5)
    best = likelihood(table(own))
    for w in range(29):
        for c in range(1, 5):
            other = own.copy()
            other[w] = c
            assert likelihood(table(other)) <= best + 1e-6
    lost = own.copy()
    lost[4] = own[4] % 4 + 1
    out, into = bigrams[4].copy(), bigrams[:, 4].copy()
    out[4] = into[4] = 0
    n = np.concatenate([np.bincount(lost, out, minlength=5), np.bincount(lost, into, minlength=5)])
    code = np.flatnonzero(n)
    assert reassign(table(lost), lost, np.full(len(code), 4), code, n[code])[4] == own[4]


@pytest.mark.parametrize("forests", [5, 0])
def test_embeddings(spark, forests):
    """Against brute force; without forests the exact search alone finds the links."""
    from echoweave.llm.nn_descent import near_duplicates

    rng = np.random.default_rng(0)
    centers = rng.standard_normal((6, 16))
    x = np.concatenate([c + 0.1 * rng.standard_normal((25, 16)) for c in centers] + [rng.standard_normal((60, 16))])
    x[7] *= 1e200
    x[8] *= 1e-200
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [None, *[1.0] * 15], 1), (903, [float("nan"), *[1.0] * 15], 1), (904, [], 1), (905, x[0].tolist(), None), (906, x[0].tolist(), 0)]
    rows += [(910, [1.0, 2.0], 0), (911, [2.0, 4.0], 0), (912, [2.0, 4.1], 0), (912, [9.0, 0.0], 1), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    found = near_duplicates(df, max_forests=forests)
    got = {r.vec_id: r for r in found.collect()}
    assert found.count() == len(got) == len(x) + 10
    u = np.concatenate([x, x[:1]])
    u /= np.abs(u).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids, label = [*range(len(x)), 906], np.array([i % 2 for i in range(len(x))] + [0])
    near = (u @ u.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(u), dtype=bool)
    reach = near | np.eye(len(u), dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    for i, k in enumerate(ids):
        assert got[k].n_links == near[i].sum() and got[k].component_id == min(ids[j] for j in np.flatnonzero(reach[i]))
        assert got[k].kept == (got[k].component_id == k)
    assert all(got[k].n_links == 0 and got[k].kept for k in range(900, 906))
    assert [(got[k].n_links, got[k].component_id) for k in (910, 911, 912)] == [(2, 910)] * 3
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("forests", [1, 0])
def test_embeddings_bridges(spark, forests):
    """Dense groups of more vectors than a list holds, each joined with the next by one vector that links to all of both."""
    from echoweave.llm.nn_descent import near_duplicates

    rng = np.random.default_rng(1)
    at = np.radians([0, 0, 40, 40, 80, 80, 120, 180])
    middle = np.stack([np.cos(at), np.sin(at)], 1)
    x = np.concatenate([np.repeat(np.pad(middle, ((0, 0), (0, 6))), 40, axis=0), np.pad([[np.cos(a), np.sin(a)] for a in np.radians([20, 60])], ((0, 0), (0, 6)))])
    x += 0.002 * rng.standard_normal(x.shape)
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[j].tolist(), 3) for i, j in enumerate(order, 1)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_duplicates(df, max_forests=forests).collect()}
    u = x[order] / np.linalg.norm(x[order], axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    reach = near
    for _ in range(8):
        reach = reach @ reach
    assert len(set(map(bytes, reach))) == 3 and near[:, order >= 320].sum(0).min() > 150
    for i in range(len(x)):
        assert got[i + 1].n_links == near[i].sum() - 1 and got[i + 1].component_id == 1 + np.flatnonzero(reach[i])[0]


def test_embeddings_spanning():
    """The links of a block join what all its links join."""
    from echoweave.llm.nn_descent import _spanning

    rng = np.random.default_rng(2)
    for _ in range(50):
        near = rng.random((12, 9)) < 0.1
        left, right = np.split(rng.permutation(100)[:21].astype(np.int64), [12])
        group = {int(i): {int(i)} for i in (*left, *right)}
        for a, b in np.argwhere(near):
            both = group[int(left[a])] | group[int(right[b])]
            group |= dict.fromkeys(both, both)
        a, b = _spanning(near, left, right)
        assert {int(i): min(g) for i, g in group.items() if min(g) != i} == dict(zip(a.tolist(), b.tolist(), strict=True))


def term_hash(data, seed=42):
    """Spark's xxhash64 of a string, or of a long or int in their own width, as an unsigned number."""
    return xxhash.xxh64(data, seed).intdigest()


def long_bytes(x, size=8):
    return int(x).to_bytes(size, "little", signed=x < 0)


def lexicon_of(texts, low=0.0005, high=0.2):
    df = collections.Counter(w for t in texts.values() for w in set(words(t)))
    return {term_hash(w.encode()) for w, n in df.items() if max(2, low * len(texts)) <= n <= max(2, high * len(texts))}


def print_of(text, kept, rates=(2, 8, 32, 128, 512), subsets=8):
    signed = lambda h: h - (h >> 63 << 64)
    found = sorted(signed(h) for h in {term_hash(w.encode()) for w in words(text)} & kept)
    if not found:
        return f"-{term_hash((text or '').encode()):x}"
    out = ""
    for scale, rate in enumerate(rates):
        bits = rate.bit_length() - 1
        masks = [term_hash(long_bytes(scale, 4), term_hash(long_bytes(h))) for h in found]
        for k in range(subsets):
            drawn = [h for h, m in zip(found, masks, strict=True) if (m >> (k * bits) % (64 - bits)) % rate == 0]
            state = 42
            for h in drawn:
                state = term_hash(long_bytes(h), state)
            out += f"{state % 2**32:08x}" if drawn else "........"
    return out


def alike(a, b, size=8):
    if a == b or a[0] == "-" or b[0] == "-":
        return float(a == b)
    best = 0.0
    for at in range(0, len(a), 8 * size):
        pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(at, at + 8 * size, 8)]
        full = [x for x in pairs if x != ("........", "........")]
        if len(full) >= 2:
            best = max(best, sum(x == y for x, y in full) / len(full))
    return best


def test_fingerprints(docs, texts, nothing):
    from echoweave.llm.imatch import fingerprint_with_edits

    got = {r.doc_id: r for r in fingerprint_with_edits(docs).collect()}
    order = sorted(texts)
    for i, k in enumerate(order):
        t, following = texts[k], texts[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    prints = collections.defaultdict(set)
    for k, t in texts.items():
        prints[t].add(got[k].fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    kept = lexicon_of(texts)
    for i, k in enumerate(order):
        t, following = texts[k], texts[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (print_of(t, kept), print_of(edited, kept))
        assert got[k].near_edited == pytest.approx(alike(got[k].fingerprint, got[k].edited_fingerprint))
        assert got[k].near_next == pytest.approx(alike(got[k].fingerprint, print_of(following, kept)))
    assert np.mean([r.near_edited for r in got.values()]) > 0.3 > 0.1 > np.mean([r.near_next for r in got.values()])
    assert fingerprint_with_edits(nothing).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = corpus_pipeline.read(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, DATA))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_large_texts_of_other_words_are_not_kin(spark):
    """Few cells tell large sets badly: unrelated ones stood around one head, which was compared in whole."""
    from echoweave.llm import jaccard_join as jj
    from echoweave.llm.common import Tables

    rng = random.Random(1)
    words = [[str(rng.random()) for _ in range(1500)] for _ in range(2)]
    texts = [words[0], words[1], words[0][:1400] + words[1][:100]]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    facts = jj._describe(docs, jj.WORDS).cache()
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    assert [tuple(r) for r in jj._plausible(pairs, facts).collect()] == [(0, 2, True, True)]
    named = pairs.withColumns({"h_a": F.col("a"), "h_b": F.col("b")})
    with Tables(spark) as tables:
        assert [tuple(r) for r in jj._kin(named, facts, tables).collect()] == [(0, 2, 0, 2)]
    assert [r.component_id for r in jj.jaccard_components(docs).orderBy("doc_id").collect()] == [0, 1, 0]


def test_groups_meet_strangers_once(spark):
    """A group was sent again with each bucket in which it met a stranger; no pair of a bucket may be lost by sending it once."""
    from echoweave.llm import jaccard_join as jj
    from echoweave.llm.common import Tables

    rng = random.Random(2)
    head = {i: 1 if i <= 40 else 50 if i <= 55 else i for i in range(1, 70)}
    buckets = [sorted({*rng.sample(range(1, 41), 25), *rng.sample(range(50, 70), 3)}) for _ in range(30)]
    rows = [(n, b[0], d, len(b), 1, n, 0) for n, b in enumerate(buckets) for d in b]
    frame = spark.createDataFrame(rows, "bucket long, least long, doc_id long, size long, times long, members long, code long")
    where = spark.createDataFrame([(d, d, h) for d, h in head.items()], "doc_id long, c long, h long")
    strangers = spark.createDataFrame([(b[0], d) for b in buckets for d in b if head[d] != head[b[0]]], "a long, b long").distinct()
    facts = where.select("doc_id", F.lit(100).cast("long").alias("n"))
    with Tables(spark) as tables:
        found = [f.collect() for f in jj._apart(frame, strangers, where, facts, tables)]
    hosts, others = found
    assert len(hosts) == len({(r.bucket, r.doc_id) for r in hosts}) <= 60 and len(others) <= 90
    assert all(r.size == sum(x.bucket == r.bucket for x in part) for part in found for r in part)
    met = {(min(x.doc_id, y.doc_id), max(x.doc_id, y.doc_id)) for part in found for x in part for y in part if x.bucket == y.bucket and x.h != y.h}
    assert {(x, y) for b in buckets for x in b for y in b if x < y and head[x] != head[y]} <= met


def test_sketches_in_fewer_cells_stay_sound():
    """Full sketches tell large sets apart, coarse ones of 128 cells do not; no sketch may show more than the sets' difference."""
    from echoweave.llm import jaccard_join as jj

    rng = np.random.default_rng(3)
    for n, m, shared in ((3000, 3000, 0), (2100, 2000, 1900), (1030, 1020, 1000), (9000, 8000, 7900)):
        pool = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(pool)
        a, b = pool[:n], np.concatenate([pool[:shared], pool[n : n + m - shared]])
        x, y = (jj._counts(jj._middle(s) or s) for s in (jj._sketch(a), jj._sketch(b)))
        size = min(len(x), len(y))
        distance = int(np.abs(jj._folded(x, size) - jj._folded(y, size)).sum())
        assert distance <= n + m - 2 * shared
        assert (7 * distance <= n + m) == (shared > 0)
    # one cell holds more than 15 of a larger set's sketch and as many of a smaller one's: cut alike
    full = np.zeros(2048, np.int16)
    full[:4] = 15, 3, 0, 0
    assert jj._folded(full, 1024)[0] == 15


def test_texts_of_a_block_are_sent_once(spark, monkeypatch):
    """Pairs around one head were verified with both texts sent for each pair."""
    from echoweave.llm import jaccard_join as jj

    monkeypatch.setattr(jj, "LINKED_CHUNK", 4)
    rng = random.Random(4)
    base = [str(rng.random()) for _ in range(80)]
    texts = {i: " ".join(base[: 80 - 5 * (i % 7)] + [f"x{i}"] * (i % 3)) for i in range(20)}
    pairs = spark.createDataFrame([(a, b, a % 2) for a in texts for b in texts if a < b and (b - a) % 2 == 0], "a long, b long, h long")
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted(tuple(r) for r in jj._linked_around(pairs, frame, jj.WORDS, 5).collect())
    assert got == sorted(tuple(r) for r in jj._linked(pairs.select("a", "b"), frame, jj.WORDS).collect())
    assert 0 < len(got) < pairs.count()
