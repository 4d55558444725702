import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import bpe, chat_format, exact_dedup, language_id, licences, mixing, queries, sharding, simhash, substring_dedup, topk
from tests.oracle import both

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, bucket int, group string, size string"


def corpus(n=120, seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    long = " ".join(rng.choice(vocab) for _ in range(40))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))
        if i % 5 == 0:
            text = text + " " + long
        if i % 7 == 0:
            text = long.upper()
        if i % 11 == 0:
            text = "a a a a a a a a a a a a a a a a a a"
        rows.append((i, text, rng.choice(["x", "y", None]), rng.choice(["s1", "s2", None]), 1, "clash", 1, "g", "z"))
    rows += [(500, None, None, None, None, None, None, None, None), (501, "", "x", "s1", 0, "", 0, "", ""), (None, "null id here", "y", "s2", 1, "", 0, "", "")]
    rows += [(3, "a repeated row", "x", "s1", 1, "", 0, "", "")] * 2 + [(502, "w" * 50_000 + " " + "long text " * 3000, "x", "s3", 1, "", 0, "", "")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    got, want = both(spark, SF, queries.QUERIES[name], queries.SQL[name])
    assert got == want


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert simhash.near_components(empty).count() == 0
    assert bpe.decoded(bpe.encoded(empty)).count() == 0
    assert language_id.predicted(empty, language_id.learned(empty)).count() == 0
    assert sharding.sharded(empty).count() == 0
    assert substring_dedup.without_repeats(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert licences.scanned(empty, licences.templates(spark), "doc_id").count() == 0
    vectors = spark.createDataFrame([], "vec_id long, vec array<bigint>")
    assert topk.top_k(vectors, vectors).count() == 0
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_conversations(talk)).count() == 0


def test_bpe_is_the_library(docs):
    """Also with an extra column for each internal name, repeated rows, and ids that repeat or are null."""
    t = bpe.tokenizer(language_id.tokenizer_path("byte_bpe_50k.json"))
    enc = bpe.encoded(docs.withColumns({c: F.lit("x") for c in ("slice", "words", "docs", "ids", "n_tokens", "pack")}), decode=True)
    got = sorted((str(r["id"]), r["n_tokens"], bytes(r["ids"]), r["text"]) for r in enc.collect())
    want = []
    for r in corpus():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), np.array(ids, "<u4").tobytes(), r[1] or ""))
    assert got == sorted(want)
    assert sorted(r["text"] for r in bpe.decoded(enc).collect()) == sorted(r[1] or "" for r in corpus())
    assert docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_decoding_of_odd_ids(spark):
    rows = [(1, None), (2, b""), (3, np.array([70000, 72], "<u4").tobytes()), (4, np.array([164], "<u4").tobytes())]
    got = {r["id"]: r["text"] for r in bpe.decoded(spark.createDataFrame(rows, "id int, ids binary")).collect()}
    assert got[1] == got[2] == "" and got[3] == "i" and got[4] == "\ufffd"


def test_bpe_query_is_the_library(spark):
    t = bpe.tokenizer(language_id.tokenizer_path("byte_bpe_50k.json"))
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        said = t.decode(ids, skip_special_tokens=False)
        want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert {tuple(r) for r in queries.op3_bpe(spark, SF).collect()} == want


def test_bpe_deals_many_buckets(docs, monkeypatch):
    few = {repr(r) for r in bpe.encoded(docs).collect()}
    monkeypatch.setattr(bpe, "BUCKET", 20_000)
    assert {repr(r) for r in bpe.encoded(docs).collect()} == few


def test_words_are_the_library():
    path = language_id.tokenizer_path("byte_bpe_50k.json")
    rng = random.Random(1)
    parts = ["a", "s", "t", "re", "ll", "'", "'s", " ", "  ", "\n", "\t", "1", "½", "é", "日", "!", " ", " ", "ࡰ", "🙂", "<|endoftext|>", "<|", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    words, first = bpe.split_texts(pa.array(texts), path)
    words = words.to_pylist()
    for i, text in enumerate(texts):
        assert words[first[i] : first[i + 1]] == bpe.library_words(text, path)


def fingerprint(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(WORD.encode(), raw)
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    texts = [r[1] for r in corpus()]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("cap", [1, 64])
def test_links_keep_all_components(spark, cap):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(df, 2, cap).collect()}
    close = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    assert all(close(*g) for g in got)

    def parts(pairs):
        up = {f: f for f in signed}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        return {f: root(f) for f in signed}

    assert parts(map(tuple, got)) == parts((a, b) for a in signed for b in signed if a < b and close(a, b))


def test_allotment_covers_and_adapts():
    both = np.full((64, 64), 0.25)
    np.fill_diagonal(both, 0.5)
    for n in (100, 10**6, 10**10):
        plan = simhash.allotted(n, both * n, 2)
        assert sorted(b for part, _ in plan for b in part) == list(range(64))
        assert sum(t for _, t in plan) == 2 - len(plan) + 1


def test_repeated_passages(docs, monkeypatch):
    rows = [(r[0], re.findall(WORD, r[1] or "")) for r in corpus()]
    least = {}
    for i, w in rows:
        for s in range(len(w) - 12):
            if i is not None:
                least[tuple(w[s : s + 13])] = min(i, least.get(tuple(w[s : s + 13]), i))
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if i is not None and least[tuple(w[s : s + 13])] < i:
                gone[s : s + 13] = [True] * 13
        want.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    for bucket in (16 << 20, 5_000):
        monkeypatch.setattr(substring_dedup, "BUCKET", bucket)
        got = [(str(r["id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.without_repeats(docs).collect()]
        assert sorted(got) == sorted(want)


def test_exact_groups(docs):
    got = {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for r in corpus():
        groups.setdefault(low(r[1]), []).append(r[0])
    want = set()
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        want |= {(i, keep, len(ids), i is not None and i == keep) for i in ids}
    assert got == want


def test_shards_are_even_and_whole(docs):
    rows = sharding.sharded(docs, 5).collect()
    assert len(rows) == len(corpus())
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    where = {}
    for r in rows:
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 60, 3000))[::-1].copy()
    room, want = [], []
    for s in sizes.tolist():
        fits = [(left, k) for k, left in enumerate(room) if left >= s]
        k = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(100)
        room[k] -= s
        want.append(k)
    assert sharding.best_fit(sizes, 100).tolist() == want
    assert len(np.unique(sharding.level(sizes, 40))) == 40


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 9 + 1), "s" + str(i % 4) if i % 4 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source").agg(F.sum(F.col("mix_size") * F.size("mix_draws")).alias("t"), F.first("mix_target").alias("g"), F.max(F.size("mix_draws")).alias("m")).collect()
    assert all(abs(r["t"] - r["g"]) <= 5 and r["m"] <= 3 for r in got)
    assert mixing.mixed(df).count() == mixing.mix(df).select(F.explode("mix_draws")).count()
    assert mixing.quotas(np.array([10, 0, 30]), 7, 1).sum(axis=0).tolist() == [10, 0, 30]


@pytest.mark.parametrize("shard_rows", [37, 50_000])
def test_top_k_is_brute_force(spark, monkeypatch, shard_rows):
    """Also with repeated rows, a vector that a third of all rows hold, nulls, other columns, and blocks of queries."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CELLS", 8)
    rng = np.random.default_rng(1)
    v = [(i, [int(x) for x in rng.integers(-9, 9, 5)]) for i in range(600)] + [(700, None), (None, [1, 2, 3, 4, 5]), (701, []), (702, [10**18] * 5)]
    v += [(1000 + i, [3, -2, 5, 0, 1]) for i in range(300)] + [v[7]] * 2 + [(100, [9, 9, 9, 9, 9])]
    df = spark.createDataFrame(v, "vec_id long, vec array<bigint>").withColumns({c: F.lit(1) for c in ("id", "v", "cell", "part", "block", "ask", "floor", "rank", "score")})
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), shard_rows=shard_rows).collect())
    want = []
    for q, a in {(q, tuple(a)) for q, a in v if q is not None and q % 100 == 0 and a is not None}:
        s = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in v if i is not None and b is not None and i != q)[:10]
        want += [(q, k + 1, i, -p) for k, (p, i) in enumerate(s)]
    assert got == sorted(want)


def test_languages(spark):
    rows = [(i, t, la) for i, (t, la) in enumerate([("the cat and the dog of the house", "en"), ("der Hund und die Katze des Hauses", "de")] * 30)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "de"), (902, "x" * 9000, None), (0, rows[0][1], "en")], "doc_id long, text string, lang string")
    clash = df.select("*", *(F.lit(1).alias(c) for c in ("id", "runs", "_told", "lang_pred", "score", "held_out", "n", "word")))
    assert sorted(map(repr, language_id.predicted(clash, language_id.learned(clash)).collect())) == sorted(map(repr, language_id.predicted(df, language_id.learned(df)).collect()))
    got = {r["id"]: r for r in language_id.predicted(df, language_id.learned(df)).collect()}
    assert all(got[i]["lang_pred"] == la and 0 <= got[i]["score"] <= 1 for i, _, la in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and len(got) == 63


def _pieces(path):
    with open(path, "rb") as f:
        return sorted({base64.b64decode(line.split()[0]) for line in f} | {bytes([b]) for b in range(256)})


def test_forward_sums_all_segmentations():
    """Also over pieces of more than 8 bytes and words of any length, with exact fractions."""
    path = language_id.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    number = {p: k for k, p in enumerate(_pieces(path))}
    longest = max(map(len, number))
    prob = np.append(np.random.default_rng(0).random(len(number)) / len(number), 0)[:, None]
    words = [" the", " \u00e9t\u00e9", " x", " international", " \u043c\u0435\u0436\u0434\u0443\u043d\u0430\u0440\u043e\u0434\u043d\u044b\u0439", " \u65e5\u672c\u8a9e\u306e\u6587\u7ae0", " " + "international" * 40]
    assert any(len(p) > 8 and p in w.encode() for p in number for w in words)
    got = language_id.word_scores(pa.array(words), prob, path)[:, 0]
    for w, log in zip(words, got):
        raw = w.encode()
        sums = [Fraction(1)]
        for j in range(1, len(raw) + 1):
            sums.append(sum((sums[i] * Fraction(float(prob[number[raw[i:j]], 0])) for i in range(max(0, j - longest), j) if raw[i:j] in number), Fraction(0)))
        want = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
        assert abs(log - want) < 1e-8 * abs(want)


def test_expected_piece_counts():
    path = language_id.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    number = {p: k for k, p in enumerate(_pieces(path))}
    q = 1 / len(number)

    def ways(raw):
        if not raw:
            return [()]
        return [(raw[:n], *rest) for n in range(1, len(raw) + 1) if raw[:n] in number for rest in ways(raw[n:])]

    words, times = [" inter", " national", " ab"], np.array([2.0, 1.0, 5.0])
    want = np.zeros(len(number))
    for w, n in zip(words, times):
        each = ways(w.encode())
        total = sum(q ** len(x) for x in each)
        for x in each:
            for p in x:
                want[number[p]] += n * q ** len(x) / total
    assert np.allclose(language_id.piece_counts(pa.array(words), times, path), want)
    long = language_id.piece_counts(pa.array([" " + "international" * 30]), np.ones(1), path)
    sizes = np.array([len(p) for p in _pieces(path)])
    assert abs((long * sizes).sum() - 391) < 1e-6  # each segmentation covers every byte once


@pytest.mark.parametrize("ids", ["null", "equal", "own", "same rows"])
def test_language_sample_is_bounded_whatever_the_ids(spark, ids):
    """Null and equal ids teach as others do, of more rows than wanted exactly so many count, and rows that repeat are one."""
    rows = [(None if ids == "null" else 7 if ids != "own" else 2 * i + k, (lang, w, 0 if ids == "same rows" and i % 10 else i)) for i in range(3000) for k, (lang, w) in enumerate((("en", "the cat"), ("de", "der Hund")))]
    df = spark.createDataFrame([(lang, i, f"{w} {n}") for i, (lang, w, n) in rows], "lang string, id long, text string")
    held = {r["lang"]: (r["n"], r["d"]) for r in language_id.sampled(df, {"en": 3000, "de": 3000}, 250).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("text").alias("d")).collect()}
    assert held == {"en": (250, 250), "de": (250, 250)}
    assert sorted(map(tuple, language_id.sampled(df, {"en": 3000, "de": 3000}, 9000).distinct().collect())) == sorted({(lang, f"{w} {n}") for _, (lang, w, n) in rows})
    model = language_id.learned(df, id_col="id", sample_per_lang=250)
    got = language_id.predicted(spark.createDataFrame([(1, "the cat"), (2, "der Hund")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["id"])] == ["en", "de"]


def test_language_query_is_a_plain_version(spark):
    """The query against a version in plain Python: sample, counts, posterior; and what it gets right where it didn't learn."""
    got = {r["doc_id"]: r for r in queries.op4_language_id(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    path = language_id.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    runs = {r["doc_id"]: [" " + w for w in re.findall(r"[^\W\d_]+", r["text"].lower())] if r["text"] else [] for r in rows}
    languages = sorted({r["lang"] for r in rows if r["lang"] is not None and r["text"] is not None and not held[r["doc_id"]]})
    counts = np.full((len(_pieces(path)), len(languages)), 0.1)
    for k, lang in enumerate(languages):
        words = Counter(w for r in rows if r["lang"] == lang and not held[r["doc_id"]] for w in runs[r["doc_id"]])
        counts[:, k] += np.round(language_id.piece_counts(pa.array(list(words)), np.array(list(words.values()), float), path), 6)
    prob = np.vstack([counts / counts.sum(axis=0), np.zeros(len(languages))])
    assert set(got) == set(held) and {i for i, r in got.items() if r["held_out"]} == {i for i, h in held.items() if h}
    right = []
    for r in rows:
        mine, words = got[r["doc_id"]], runs[r["doc_id"]]
        if not words:
            assert (mine["lang_pred"], mine["score"]) == ("und", 0.0)
            continue
        total = language_id.word_scores(pa.array(words), prob, path).sum(axis=0)
        assert mine["lang_pred"] == languages[int(total.argmax())]
        assert abs(mine["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-6
        if held[r["doc_id"]] and r["lang"] is not None:
            right.append(mine["lang_pred"] == r["lang"])
    assert len(right) > 20 and np.mean(right) >= 0.95


def test_chat_escapes_are_reversible(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|x|> <\\\\|", "é<", "", None, "<|im_end|>\n" * 3]
    rows = [(i, k, role, t) for i in range(3) for k, (role, t) in enumerate(zip(["user", "assistant", "a|s\n\\", None, "assistant", "assistant"], said))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format.digests(chat_format.format_conversations(df)).collect():
        turns = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in rows[:6])
        loss = "".join(t or "" for _, _, role, t in rows[:6] if role == "assistant")
        assert r["n_turns"] == 6 and r["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_licences_and_inheritance(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "code"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (4, "a/b/d/e", "x\nThis work is licensed under the GNU General Public License, version 3.\n"), (5, "z/f", None), (6, None, "Copyright nobody"), (7, "a/q", "")]
    got = {r["id"]: (r["licence"], r["licence_dir"]) for r in licences.licensed(spark.createDataFrame(files, "id long, path string, text string"), licences.templates(spark)).collect()}
    assert got == {1: ("MIT", None), 2: ("Apache-2.0", "a/b"), 3: ("Apache-2.0", None), 4: ("GPL-3.0", None), 5: (None, None), 6: (None, None), 7: ("MIT", "a")}


def test_licences_of_null_and_repeated_ids_and_rows(spark):
    mit, code = "Released under the MIT License.", "plain code"
    files = [(None, "a/x", mit), (None, "b/y", code), (1, "c/x", mit), (1, "c/y", code), (2, "d/LICENSE", mit), (2, "d/LICENSE", mit), (2, "d/e/f", code), (2, "d/e/f", code), (3, "e", None), (3, None, mit)]
    df = spark.createDataFrame(files, "id long, path string, text string").withColumns({c: F.lit("x") for c in ("digest", "own_licence", "licence", "unit", "term", "dir", "name", "up", "given")})
    got = sorted((str(r["id"]), str(r["path"]), str(r["licence"])) for r in licences.licensed(df, licences.templates(spark)).collect())
    assert got == sorted([("None", "a/x", "MIT"), ("None", "b/y", "None"), ("1", "c/x", "MIT"), ("1", "c/y", "None"), *[("2", "d/LICENSE", "MIT"), ("2", "d/e/f", "MIT")] * 2, ("3", "e", "None"), ("3", "None", "MIT")])


def test_licence_query_is_brute_force(spark):
    """Cosines of all units of all documents to all templates in plain Python, and the nearest directory with a licence file."""
    larger = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text", "source").collect()
    term, tag = re.compile(r"spdx:[a-z0-9]+(?:[.+-]+[a-z0-9]+)*\+?|[a-z0-9]+(?:\.[a-z0-9]+)*"), re.compile(licences.TAG)
    terms = lambda t: term.findall(tag.sub("spdx:", t.lower()))
    total = len(docs)
    held = Counter(t for r in docs if r["text"] for t in set(terms(r["text"])))
    weigh = lambda t: {w: n * (math.log((total + 1) / (held[w] + 1)) + 1) for w, n in Counter(terms(t)).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(r["licence"], weigh(r["statement"])) for r in licences.templates(spark).collect()]
    known = [(name, v, length(v)) for name, v in known]

    def own(text):
        if not text:
            return None
        units, blocks = {text}, re.split(r"\n[\W_]*\n", text)
        units |= set(blocks) | {x for b in blocks for x in b.split("\n")}
        units |= {x for b in blocks for x in re.split(r"(?<=[.!?])\s+", re.sub(r"\n(?:(?!\n)[\W_])*", " ", b))}
        units |= {m[0] for m in re.finditer("(?i)" + licences.TAG + r"[a-z0-9]+(?:[.+-]+[a-z0-9]+)*\+?", text)}
        best = []
        for u in units:
            v = weigh(u)
            n = length(v)
            best += [(-round(sum(x * w.get(t, 0) for t, x in v.items()) / (n * m), 6), name) for name, w, m in known if n]
        return min(best) if best and -min(best)[0] >= 0.6 else None

    found = {r["doc_id"]: own(r["text"]) for r in docs}
    path = {}
    for r in docs:
        n = r["doc_id"]
        path[n] = f"{r['source'] if r['source'] is not None else 'none'}/p{n // 500}{f'/m{n // 50 % 10}' if n % 10 else ''}/{'LICENSE' if n % 5 == 0 else 'text'}.{n}"
    given = {}
    for n, p in path.items():
        if n % 5 == 0 and found[n]:
            folder = p.rsplit("/", 1)[0]
            given[folder] = min(given.get(folder, (1, "~", "")), (found[n][0], p, found[n][1]))
    want = {}
    for n, p in path.items():
        folder = p.rsplit("/", 1)[0]
        while folder and folder not in given:
            folder = folder.rpartition("/")[0]
        want[n] = (found[n][1], None) if found[n] else (given[folder][2], folder) if folder else (None, None)
    got = {r["doc_id"]: (r["licence"], r["licence_dir"]) for r in queries.op9_licences(spark, larger).collect()}
    assert sum(x is not None for x in found.values()) > 5 and got == want


def test_a_licence_line_is_found_alike_in_corpora_of_two_sizes(spark):
    def score(n):
        files = spark.range(n).selectExpr("id", "concat_ws('\n', 'this project is by us', if(id % 10 = 0, 'This project is released under the MIT License.', 'the end')) as text")
        return licences.scanned(files, licences.templates(spark)).where("id = 0").first()

    small, large = score(100), score(100_000)
    assert small["own_licence"] == large["own_licence"] == "MIT"
    assert abs(small["own_score"] - large["own_score"]) < 0.05


def test_a_licence_without_a_usual_word_is_found(spark):
    """A passage of the MIT licence that names neither licence nor copyright, and an identifier on the line after its tag."""
    passage = licences.TEXTS.joinpath("MIT.txt").read_text().split("\n\n")[3].replace("\n", " ").replace("COPYRIGHT HOLDERS", "OWNERS")
    assert not re.search("licen[sc]e|copyright", passage, re.I)
    texts = [passage, "# SPDX-License-Identifier:\n# MIT", "plain words", "", None, *["the words and the others of a text"] * 30]
    found = licences.scanned(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), licences.templates(spark)).collect()
    assert {r["id"]: r["own_licence"] for r in found} == {0: "MIT", 1: "MIT"}


def test_licence_files_wrapped_headers_and_spdx(spark):
    full = {p.stem: p.read_text() for p in licences.TEXTS.glob("*.txt")}
    said = {name: f"Copyright 2020 Jane Doe and the others\n\n{text}" for name, text in full.items()}
    gpl = "/*\n * This file is part of Foo.\n *\n * Foo is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version.\n *\n */\nint x;"
    code = [("GPL-2.0", gpl.format(2)), ("GPL-3.0", gpl.format(3)), ("MIT", "# SPDX-License-Identifier: MIT\nx = 1"), ("GPL-3.0", "// spdx-license-identifier: (GPL-3.0-only OR Nobody)"), (None, "# SPDX-License-Identifier: ISC"), ("MIT", "Nothing here is said of it. Released under the MIT License. " + "More words follow in this same long line. " * 9)]
    want = dict(enumerate([*said, *(name for name, _ in code), *[None] * 40]))
    texts = [*said.values(), *(text for _, text in code), *["the file is a part of this one and is free or not"] * 40]
    found = licences.scanned(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), licences.templates(spark)).collect()
    assert {r["id"]: r["own_licence"] for r in found} == {k: name for k, name in want.items() if name}


def test_near_copies_leave_one_row_of_each_component(spark):
    a, b, c, d = ("the river runs to the sea and back again", "nine old ships lie here in the mud", "no one knows what it was", "four more words than that")
    rows = [(1, a), (7, a), (7, b), (7, b), (8, b), (None, c), (None, c), (9, d), (None, d), (3, None), (3, None), (4, "")]
    rows = [(i, text, "x", "s", 1) for i, text in rows] + [(7, b, "y", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(3), SF).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (7, b), (None, c), (9, d), (3, None)], key=repr)
