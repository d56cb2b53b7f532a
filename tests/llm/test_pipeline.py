"""The pipeline's stages, each against a plain version on its own input, and run() as a whole."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from docvalid.llm import pii, toxicity

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    return out


def plain_mix(rows):
    """How often each document is taken: sources' targets shared out anew until none is above twice its size, documents in the order of their hashes."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else share[s]
            left -= target[s] if over else 0
        open_ = open_ - over if over else set()
    out = Counter()
    for s in order:
        whole = int(target[s] // total[s]) if total[s] else 0
        gap, so_far = target[s] - whole * total[s], 0
        named = [(("" if i is None else str(i)) + "/" + md5(t or ""), i, size(t)) for i, t, of in rows if of == s]
        for _, _, i, n in sorted((md5(what)[:9], what, i, n) for what, i, n in named):
            more = so_far + n <= gap or so_far <= gap and n < 2 * (gap - so_far)
            so_far += n
            out[i] += min(2, whole + more)
    return +out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF_DIR)
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        kept[name] = (before, out := spark.read.parquet(f"file://{tmp_path}/{name}"))
        before = out
    assert list(kept) == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "packing"]

    given, out = kept["toxicity"]
    bad = {r.doc_id for r in toxicity.toxicity(given, spark.read.parquet(f"{SF_DIR}/labels.parquet")).where("predicted = 1").collect()}
    assert Counter(map(tuple, out.collect())) == Counter(tuple(r) for r in given.collect() if r.doc_id not in bad)

    given, out = kept["ngram_jaccard_join"]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    sets, parent = sets_of(rows), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i in parent if find(i) == i) and out.count() < given.count()

    given, out = kept["pii"]
    new = {r.doc_id: r.text for r in pii.pseudonymise(given, pii.KEY).collect()}
    assert {r.doc_id: r.text for r in out.collect()} == new and all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)

    given, out = kept["mixing"]
    assert Counter(r.doc_id for r in out.collect()) == plain_mix([(r.doc_id, r.text, r.source) for r in given.collect()])

    given, out = kept["packing"]
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in given.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want.update((r.doc_id, k, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    mine = lambda df: Counter((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert mine(out) == want and all(r.offset + r.length <= 1024 for r in out.collect())
    assert mine(corpus_pipeline.run(spark, SF_DIR)) == mine(out)


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", None, 3), (2, "", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, frame, SF_DIR).collect()
            assert bool(rows) == bool(frame.count()) or name == "mixing"
