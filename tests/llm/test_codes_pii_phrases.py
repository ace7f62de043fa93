"""Vector codes, personal data and collocations against brute force, and their cases of input."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x[-9:]) <= 255 and len(x.lstrip("0")) < 4 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def random_texts(n):
    rng = random.Random(5)
    bits = ["a.b@c.d_e@f.g", "x@y", "@", "..", "1.2.3.4.5", "999.1.1.1", "0000255.1.2.3", "4111 1111 1111 1111", "5500-0000-0000-0004", "4111111111111111", "+1 (239) 555-8522", "+49 30 1234567", "(", ") ", "é😀", " ", " ", "\n", "12", "-", "+", "DE89 3704 0044 0532 0130 00", "call ", "order ", "A", "9"]
    return [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))), "en") for i in range(n)]


def test_base_spans_equal_brute_force(spark):
    from echoweave.llm.pii import digests

    rows = random_texts(1500) + [(5000, None, None), (5001, "", "en"), (5001, "a@b.c", "en"), (5002, "a" * 900 + "@" + "b" * 900, "en"), (5003, "1 2" * 900, "en"), (5004, "a" * 900 + " 1" * 900, "en"), (5005, "7" * 900 + "a@b" + ".c" * 900, "en"), (None, "+1 (239) 555-8522", "en")]
    got = collections.Counter(tuple(r) for r in digests(spark.createDataFrame(rows, DOC).withColumns({"row": F.lit(1), "kind": F.lit("x")})).drop("spans").collect())
    want = collections.Counter()
    for key, text, _ in rows:
        spans = base_spans(text or "")
        counts = [sum(s[0] == k for s in spans) for k in PATTERNS]
        want[key, *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    assert got == want


def test_added_spans_and_their_scores(spark):
    from echoweave.llm.pii import digests, find_spans

    cases = {
        0: ("pay DE89 3704 0044 0532 0130 00 THIS now", ["iban:4:31:iban"]),
        1: ("pay DE88 3704 0044 0532 0130 00 now", []),  # mod-97 fails
        2: ("ES9121000418450200051332", ["iban"]),
        3: ("xES9121000418450200051332", []),  # stands within a word
        4: ("+1 (239) 555-8522 4111111111111111", ["card", "phone"]),  # both fail as whole runs
        5: ("order 4111111111111111 555-8522", []),  # a word against it
        6: ("call 239-555-8522 today", ["phone"]),
        7: ("about 239-555-8522 today", []),  # no word for it
    }
    df = spark.createDataFrame([(k, t, "en") for k, (t, _) in cases.items()], DOC)
    found = {k: sorted(x.split(":")[0] for x in (r.spans.split(",") if r.spans else [])) for r in digests(df).collect() for k in [r.doc_id]}
    assert found == {k: sorted(x.split(":")[0] for x in want) for k, (_, want) in cases.items()}
    spans = find_spans(df).collect()
    assert {(s.doc_id, cases[s.doc_id][0][s.start : s.end]) for s in spans} == {(s.doc_id, s.value) for s in spans}
    assert {s.value for s in spans if s.kind == "iban"} == {"DE89 3704 0044 0532 0130 00", "ES9121000418450200051332"}
    assert all(0.6 <= s.score <= 1 for s in spans)


def test_long_runs_are_linear(spark):
    from echoweave.llm.pii import digests

    n = 300_000  # a plain search for these patterns takes time with the square of a run
    texts = ["a" * n + "@" + "b" * n, "1 2" * n, "a" * n + " 1" * n, "7" * n + "a@b" + ".c" * n, "+1" + " " * n, "a@b.c " * 20_000]
    out = {r.doc_id: r.spans for r in digests(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOC)).collect()}
    assert [out[i] for i in (0, 1, 2, 4)] == [""] * 4 and out[3] == f"email:0:{3 * n + 3}" and out[5].count("email") == 20_000 and out[5].endswith("email:119994:119999")


def test_pii_empty_table(spark):
    from echoweave.llm.pii import digests

    assert digests(spark.createDataFrame([], DOC)).collect() == []


def lloyd(rows, parts=8, entries=16, rounds=6):
    kept = [(k, label, [math.floor(4096 * x) for x in v]) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-len(kept[0][2]) // parts)
    cut = [[(v + [0] * (width * parts))[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for x in cut:
                own[near(x[p], books[p])[1]].append(x[p])
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    errors = [sum(f[0] for f in row) for row in found]
    of = collections.Counter()
    for (_, label, _), e in zip(kept, errors, strict=True):
        of[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(k, "".join(f"{f[1]:02x}" for f in row), e, of[label], digest) for (k, label, _), row, e in zip(kept, found, errors, strict=True)]


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dim))
    return [(int(i), [float(np.float32(x)) for x in centres[rng.integers(5)] / 4 + rng.standard_normal(dim) / 20], int(rng.integers(3)) if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        vectors(300, 16, 1),
        vectors(9, 16, 2),  # fewer rows than entries
        vectors(40, 13, 3),  # parts of unequal length: padded
        [(1, [0.5] * 8, 1)] * 200 + vectors(60, 8, 4) + [(None, [0.25] * 8, 1), (7, None, 1), (8, [None] + [1.0] * 7, 2), (9, [float("nan")] * 8, 2), (10, [float("inf")] * 8, 2)],  # copies, null key, dropped rows
        [(i, [float(i % 2)] * 8, 0) for i in range(50)],  # ties everywhere
        [],
    ],
)
def test_codes_equal_brute_force(spark, rows):
    from echoweave.llm.vector_codes import compress

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"x": F.lit("clash"), "code": F.lit(1)})
    got = sorted((tuple(r) for r in compress(df).collect()), key=repr)
    assert got == sorted(lloyd(rows), key=repr)


def test_codes_of_several_lengths_and_huge_components(spark):
    from echoweave.llm.vector_codes import compress

    rows = vectors(30, 8, 5) + [(100 + k, v, label) for k, v, label in vectors(30, 16, 6)] + [(500, [3e38] * 8, 1), (501, [-3e38] * 8, 1), (502, [], 1)]
    out = compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(out) == len(rows) and len({r.codebooks_sha256 for r in out}) == 3
    small = sorted((r.vec_id, r.code) for r in out if 100 <= r.vec_id < 500)
    assert small == sorted((r[0], r[1]) for r in lloyd(rows[30:60]))


def phrases(rows, least=10, longest=3, cover=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = collections.defaultdict(int)
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if (lang, p) in inside and 100 * inside[lang, p] >= cover * a:
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]


def phrase_rows():
    rng = random.Random(3)
    vocabulary = ["a", "B", "of", "the", "é", "日本", "New", "york", "city", "x-y", "1"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ", ", " \r\n", "\x0b"]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None])) for i in range(150)]
    return rows + [(1, "new york city " * 40, "en"), (2, "the the the " * 30, "en"), (3, None, "en"), (3, "", None), (4, " . ,", "de"), (5, "a b " * 30_000, "fr"), (6, "a b", "fr")]


@pytest.mark.parametrize("broadcast", [1 << 21, 0])
def test_collocations_equal_brute_force(spark, broadcast):
    from echoweave.llm.collocations import collocations

    rows = phrase_rows()
    df = spark.createDataFrame(rows, DOC).withColumns({"doc": F.lit(1), "groups": F.lit("clash")}).repartition(5)
    for setting in ({}, {"max_words": 4, "min_count": 3, "cover": 80, "top": 20}):
        got = sorted(tuple(r) for r in collocations(df, broadcast_groups=broadcast, **setting).collect())
        kinds = {"least": setting.get("min_count", 10), "longest": setting.get("max_words", 3), "cover": setting.get("cover", 50), "top": setting.get("top", 2000)}
        assert got == sorted(phrases(rows, **kinds))


def test_collocations_of_nothing(spark):
    from echoweave.llm.collocations import collocations

    assert collocations(spark.createDataFrame([], DOC)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None), (2, "one two", "en")], DOC)).collect() == []


def test_pair_counts_of_large_group_numbers():
    import pyarrow as pa

    from echoweave.llm.collocations import adjacent

    at, left, right = adjacent(pa.array([[1 << 40, 5, -1, 7], [], [8, 9]], pa.list_(pa.int64())))
    assert (at.tolist(), left.tolist(), right.tolist()) == ([0, 4], [1 << 40, 8], [5, 9])


def test_a_batch_of_many_groups_is_counted_in_slices(spark):
    """Arrays of a whole batch of 10,000 long texts took an executor of the check tool over its memory."""
    import tracemalloc

    import pyarrow as pa

    from echoweave.llm import collocations

    groups = np.random.default_rng(3).integers(-1, 40, (4000, 1000))
    batch = pa.RecordBatch.from_arrays([pa.array(list(groups), pa.list_(pa.int64()))], names=["groups"])

    class Relation:  # what runs in a task, taken from the plan
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

        groupBy = agg = lambda self, *_: self

    run = collocations._counted(Relation()).run
    tracemalloc.start()
    found = collections.Counter()
    for out in run([batch]):
        for left, right, f in zip(*(out.column(c).to_pylist() for c in ("left", "right", "f")), strict=True):
            found[left, right] += f
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    left, right = groups[:, :-1], groups[:, 1:]
    both = (left >= 0) & (right >= 0)
    assert found == collections.Counter(zip(left[both].tolist(), right[both].tolist(), strict=True))
    assert peak < 100 << 20


def test_only_the_searched_text_of_a_repeated_key_is_cut(spark):
    from echoweave.llm.suffix_dedup import remove_repeats

    passage = " ".join(f"p{i}" for i in range(60))
    long, few, other = " ".join(f"a{i}" for i in range(200)) + " " + passage, "Few words only", " ".join(f"Z{i}" for i in range(300))
    rows = [(1, passage, "en"), (2, long, "en"), (2, few, "en"), (2, other, "en"), (2, long, "en"), (3, None, "en"), (None, passage, "en")]
    df = spark.createDataFrame(rows, DOC)
    got = sorted((r.doc_id or 0, (r.text or "").strip()) for r in remove_repeats(df).collect())
    # the greatest text of key 2 is the long one; both its rows lose the passage, the other two texts stay
    assert got == sorted([(1, passage), (2, long[: -len(passage)].strip()), (2, long[: -len(passage)].strip()), (2, few), (2, other), (3, ""), (0, passage)])
