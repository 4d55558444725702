"""The pipeline against a plain version of its five stages."""

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import bpe, language_id, queries
from tests.llm.test_hot_and_names import roots
from tests.llm.test_operators import _pieces, fingerprint

SF = "/root/testdata/sf0.001"


def kept_by_language(rows):
    path = language_id.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    runs = {r["doc_id"]: [" " + w for w in re.findall(r"[^\W\d_]+", r["text"].lower())] if r["text"] else [] for r in rows}
    languages = sorted({r["lang"] for r in rows if r["lang"] is not None and r["text"] is not None})
    counts = np.full((len(_pieces(path)), len(languages)), 0.1)
    for k, lang in enumerate(languages):
        words = [w for r in rows if r["lang"] == lang for w in runs[r["doc_id"]]]
        some = sorted(set(words))
        number = {w: i for i, w in enumerate(some)}
        counts[:, k] += np.round(language_id.piece_counts(pa.array(some), np.bincount([number[w] for w in words], minlength=len(some)).astype(float), path), 6)
    prob = np.vstack([counts / counts.sum(axis=0), np.zeros(len(languages))])
    for r in rows:
        if runs[r["doc_id"]]:
            total = language_id.word_scores(pa.array(runs[r["doc_id"]]), prob, path).sum(axis=0)
            if 1 / np.exp(total - total.max()).sum() >= 0.5:
                yield r


def test_pipeline_is_its_plain_version(spark):
    rows = list(kept_by_language(spark.read.parquet(f"{SF}/documents.parquet").collect()))
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    last = {}
    for r in rows:
        last[low(r["text"])] = max(r["doc_id"], last.get(low(r["text"]), -1))
    rows = [r for r in rows if last[low(r["text"])] == r["doc_id"]]
    fp = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    some = sorted(set(fp.values()))
    root = roots(some, [(a, b) for i, a in enumerate(some) for b in some[i + 1 :] if (a ^ b).bit_count() <= 2])
    first = {}
    for i, f in fp.items():
        first[root[f]] = min(i, first.get(root[f], i))
    rows = [r for r in rows if first[root[fp[r["doc_id"]]]] == r["doc_id"]]
    c = duckdb.connect()
    c.register("documents", pd.DataFrame([r.asDict() for r in rows]))
    taken = {d: (size, n) for d, size, _, _, n in c.execute(f"select doc_id, size, source_size, target, taken from ({queries.OP8_SQL})").fetchall()}
    t, want = bpe.tokenizer(language_id.tokenizer_path("byte_bpe_50k.json")), []
    for r in rows:
        size, n = taken[r["doc_id"]]
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        said = t.decode(ids, skip_special_tokens=False)
        want += [(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())] * (n // size if size else 0)
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(got) > 50 and sorted(got) == sorted(want)


def test_run_makes_each_stage_once(spark, monkeypatch):
    """Every row that a stage returns is made once: an accumulator in each stage's plan counts them."""
    made = {}

    def counting(name, stage):
        count = made[name] = spark.sparkContext.accumulator(0)

        def seen(batches):
            for x in batches:
                count.add(x.num_rows)
                yield x

        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            return out.mapInArrow(seen, out.schema)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counting(*s) for s in corpus_pipeline.STAGES])
    rows = corpus_pipeline.run(spark, SF).collect()
    found = {name: c.value for name, c in made.items()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert found["bpe"] == len(rows) == found["mix_sources"] and docs >= found["language_id"] >= found["exact_dedup"] >= found["simhash_near_dedup"] > 0


def test_stages_take_nulls_repeats_other_columns_and_empty_tables(spark):
    rows = [(1, "der Hund und die Katze", "de", "s"), (1, "the dog and the cat", "en", "s"), (1, "the dog and the cat", "en", "s"), (None, "the dog and a house", "en", None), (None, None, None, None), (5, "", "en", "s"), (6, "123", None, "t")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("id", "digest", "size", "runs", "bucket", "kept", "mix_key", "base")})
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            n = out.count()
            assert n == 0 if table is not docs else n > 0, name
            if name != "bpe":
                assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(str(r["text"]) for r in corpus_pipeline.identify_language(spark, docs, SF).collect()) == sorted(r[1] for r in rows if r[1] and r[1] != "123")
