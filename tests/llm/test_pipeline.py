"""Every stage of the pipeline and its whole run against brute force on a small table with nulls and repeated rows."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline as p
from lumenfold.llm import sentencepiece_bpe

SCHEMA = "text STRING, doc_id BIGINT, n_chars BIGINT, lang STRING, source STRING, kept INT, keep_id INT, component_id INT"
ITEM = "seven small ships sailed over the northern sea before dawn"


def make():
    rng = np.random.default_rng(8)
    parts = {"en": "the of and ing tion er".split(), "de": "der die ung sch ein keit".split()}
    prose = lambda k: " ".join("".join(rng.choice(parts[k], 2)) for _ in range(40))
    rows = [(i, prose(k), k) for i in range(40) for k in [("en", "de")[i % 2]]]
    rows += [(100, rows[3][1].upper(), "de"), (101, rows[4][1], "en"), (102, rows[5][1] + " der", "de"), (103, rows[6][1] + " " + ITEM, "en")]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !!", "en"), (203, None, "en"), rows[7], rows[7]]
    return [(t, d, len(t or ""), k, "s", 0, 0, 0) for d, t, k in rows]


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(make(), SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "too short")], "item_id BIGINT, text STRING").write.parquet(f"{out}/benchmark.parquet")
    return out


def lower(t):
    return (t or "").encode().lower().decode()


def shingles(t, n):
    w = lower(t).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_exact(rows):
    """The largest id of each group of equal texts stays, with all its rows."""
    best = {}
    for t, d, *_ in rows:
        best[lower(t)] = max(d, best.get(lower(t), d))
    return [r for r in rows if best[lower(r[0])] == r[1]]


def brute_near(rows):
    """The smallest id of each component stays."""
    s = {d: shingles(t, 5) for t, d, *_ in rows}
    comp = {d: d for d in s}
    for _ in s:
        for a in s:
            for b in s:
                if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return [r for r in rows if comp[r[1]] == r[1]]


def brute_clean(rows):
    q = shingles(ITEM, 5)
    return [r for r in rows if len(lower(r[0]).split()) < 5 or len(shingles(r[0], 5) & q) < 0.8 * len(q)]


def brute_tokens(rows):
    lib = sentencepiece_bpe.vocabulary(sentencepiece_bpe.default_model()).library
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return [(r[1], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for r in rows for ids in [lib.encode(r[0] or "")]]


def known(rows):
    """What the language stage keeps: rows with letters of the trained languages."""
    return [r for r in rows if any(c.isalpha() for c in r[0] or "")]


BRUTE = {"language_id": known, "exact_dedup": brute_exact, "near_dedup": brute_near, "decontaminate": brute_clean}


def cut(rows):
    return sorted(((r[1], r[0], r[3], r[4], r[2]) for r in rows), key=repr)


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_stage(spark, home, name, stage):
    docs = spark.read.parquet(f"{home}/documents.parquet")
    got = sorted((tuple(r) for r in stage(spark, docs, home).collect()), key=repr)
    rows = make()
    assert got == (sorted(brute_tokens(rows), key=repr) if name == "sentencepiece" else cut(BRUTE[name](rows)))
    if name != "sentencepiece":
        assert len(got) < len(rows)
    assert stage(spark, docs.where("doc_id < 0"), home).count() == 0


def test_run(spark, home, tmp_path):
    rows = make()
    for stage in BRUTE.values():
        rows = stage(rows)
    assert sorted((tuple(r) for r in p.run(spark, home).collect()), key=repr) == sorted(brute_tokens(rows), key=repr)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
