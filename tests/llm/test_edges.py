"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns of every operator, and brute force where SQL has no word."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import common, decontaminate, exact_dedup, html_extract, language_id, near_dedup, pii_crf, secrets_scan, sentencepiece_bpe, substring_dedup, toxicity
from lumenfold.llm.components import components

LONG = "der die das und 12 " * 30_000
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "der die ung"), (5, "der die ung"), (None, "the of and"), (None, None), (6, "12 !? 3"), (7, "䷀䷁ ∑")]
CLASH = ("toxicity", "lang_pred", "lang_score", "lang_rejected", "score", "spans", "kept", "keep_id", "component_id", "digest", "h", "part", "bound", "item", "s", "d", "a", "b")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(TEXTS, "doc_id BIGINT, text STRING").withColumns({c: F.lit(f"x{c}") for c in CLASH})
    return df.withColumn("lang", F.when(F.col("doc_id") < 6, "de").otherwise("en")).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < 0")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_toxicity_reads_every_labelled_row(spark, monkeypatch):
    """A word that only rows beyond the driver's own bound hold is learned, and all rows of the fifth calibrate."""
    n = 1200
    rows = [(i, ("vile " if i % 4 == 0 else "kind ") + f"and so on {i % 7} of the rest") for i in range(n)]
    df, labels = spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "doc_id BIGINT, toxic INT")
    seen, start = [], []
    calibrate, train = toxicity.calibrate, toxicity.train
    monkeypatch.setattr(toxicity, "calibrate", lambda m, z, *a: seen.append(len(z)) or calibrate(m, z, *a))
    monkeypatch.setattr(toxicity, "train", lambda texts, *a: start.append(len(texts)) or train([[w for w in t if w != "vile"] for t in texts], *a))
    model = toxicity.fit(df, labels, F.lit(True), positives=40, negatives=60)
    assert start[0] < 200 and 180 < seen[-1] < 300 and not model.squares
    got = toxicity.score_column(df, model).collect()
    assert np.mean([(r["toxicity"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got]) > 0.95


def test_toxicity_fits_scores_and_calibrates(spark, odd, none):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    parts = {"en": ["the", "of", "and"], "de": ["der", "die", "und"]}
    rows = []
    for i in range(600):
        lang, bad = ("en", "de")[i % 2], i // 2 % 2
        rows.append((i, " ".join([*rng.choice(words, 30), *parts[lang] * 3, *(["vileterm" if lang == "en" else "schlimmwort"] * bad)]), bad))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, y INT")
    labels = df.select("doc_id", F.col("y").alias("toxic")).union(spark.createDataFrame([(None, 1), (3, None), (10**6, 1)], "doc_id BIGINT, toxic INT"))
    model = toxicity.fit(df, labels, common.in_crc_fold(F.col("doc_id"), 5, 0) == F.lit(False))
    held = toxicity.score_column(df, model).where(common.in_crc_fold(F.col("doc_id"), 5, 0)).collect()
    assert len(held) > 80 and np.mean([(r["toxicity"] >= 0.5) == (r["y"] == 1) for r in held]) > 0.95
    assert {"", "en", "de"} <= set(model.threshold)
    got = toxicity.score_column(odd, model)
    assert got.columns.count("toxicity") == 1 and set(got.columns) == set(odd.columns)
    rows = got.collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["toxicity"] <= 1 for r in rows)
    alone = {r["toxicity"] for r in rows if r["text"] in (None, "", " \n\t", "12 !? 3")}
    assert len(alone) == 1 and len({r["toxicity"] for r in rows if r["doc_id"] == 5}) == 1
    assert toxicity.score_column(none, model).count() == 0
    unlabelled = toxicity.fit(df, labels.where("toxic = 0"), F.lit(True))
    assert {r["toxicity"] for r in toxicity.score_column(odd, unlabelled).collect()} == {0.0}
    assert toxicity.score_column(odd, toxicity.fit(none, labels, F.lit(True))).count() == len(TEXTS)


def test_language_of_odd_texts_and_many_languages(spark, odd, none):
    model = language_id.fit(odd, F.lit(True))
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == len(TEXTS) and set(rows[0].asDict()) == set(odd.columns)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and r["lang_rejected"] in ((True, False) if letters else (True,))
    assert language_id.identify(none, model).count() == 0
    table = language_id._fold_table()
    assert all((table[c] > 0) == chr(c).isalpha() for c in range(0x110000))
    many = spark.createDataFrame([(i * 10 + k, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 6, f"l{i:03d}") for i in range(260) for k in range(2)], "doc_id BIGINT, text STRING, lang STRING")
    model = language_id.fit(many, F.lit(True), sample=10_000)
    assert len(model.langs) == 260 and model.head.shape == (language_id.DIM, 260)
    assert language_id.identify(many, model).where("lang_pred <> 'und'").count() == 520


def test_exact_dedup_of_odd_texts(odd):
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(odd).collect()), key=repr)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    want = []
    for d, t in TEXTS:
        same = [e for e, u in TEXTS if low(u) == low(t)]
        keep = max((e for e in same if e is not None), default=None)
        want.append((d, keep, len(same), d == keep, sha(low(t))))
    assert got == sorted(want, key=repr)


def test_batches_and_the_reopened_index(spark, tmp_path):
    rows = [(i, f"text {i % 70}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    for batches in (1, 2, 5, 300):
        assert {r["keep_id"] for r in exact_dedup.exact_dedup(df, batches=batches).collect()} == {max(range(k, 200, 70)) for k in range(70)}
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.exact_dedup(df, index)
    spark.sql(f"DROP TABLE {index.table}")  # as in a new session
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 8)
    again = exact_dedup.DigestIndex(spark, path)
    assert again.buckets == 4 and again.exists()
    later = df.withColumn("doc_id", F.col("doc_id") + 1000).union(spark.createDataFrame([(5000, "new")], df.schema))
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(later, again).collect()}
    assert again.rows().count() == 71 and got[5000]["kept"] and sum(r["kept"] for r in got.values()) == 1
    assert got[1000]["keep_id"] == 140 and got[1000]["group_size"] == 3
    again.drop()


def test_near_dedup_of_odd_texts(odd, none):
    rows = near_dedup.near_dedup(odd).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r["kept"] == (r["doc_id"] == r["component_id"]) and (r["doc_id"] is None) == (r["component_id"] is None)
    assert near_dedup.near_dedup(none).count() == 0


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80), (2, 50), (1, 95)])
def test_near_dedup_at_the_threshold(spark, words, percent):
    """Pairs just at and just under the similarity, against brute force."""
    rng, rows = np.random.default_rng(percent), []
    limit = 100 * (100 - percent) // (100 + percent)  # shingles of 100 that may differ
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 10**9, 100 + words - 1)]
        change = int(rng.integers(max(limit - 3, 0), limit + 4))
        other = base[: len(base) - change] + [f"v{x}" for x in rng.integers(0, 10**9, change)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    sets = {d: {tuple(t.split()[i : i + words]) for i in range(len(t.split()) - words + 1)} for d, t in rows}
    want = {d: d - d % 2 if 100 * len(sets[d - d % 2] & sets[d | 1]) >= percent * len(sets[d - d % 2] | sets[d | 1]) else d for d in sets}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), words, percent).collect()}
    assert got == want and 0 < sum(d != c for d, c in want.items()) < 60
    with pytest.raises(ValueError):
        near_dedup.layout(5)


def test_components_of_paths_stars_and_loops(spark):
    rng = np.random.default_rng(2)
    path = rng.permutation(120).tolist()
    edges = [*zip(path, path[1:]), *((1000, i) for i in range(200, 260)), (500, 500), *map(tuple, rng.integers(600, 700, (60, 2)).tolist())]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a BIGINT, b BIGINT")).collect()}
    assert got == {x: find(x) for x in root}


def test_decontamination_of_odd_and_repeated_items(spark, odd, none):
    long_item = " ".join(f"q{i}" for i in range(300))
    items = [(1, "seven small ships sailed over the northern sea"), (1, "ten large trains crossed under the southern hills"), (2, long_item), (2, long_item), (None, long_item), (3, None), (4, ""), (5, "too short")]
    docs = [(10, "a " + items[0][1] + " b"), (11, "c " + items[1][1]), (12, long_item), (13, "q1 q2 q3 q4 q5 q6"), (None, long_item), (14, LONG + long_item), (15, items[0][1]), (15, "and others")]
    got = sorted(tuple(r)[:4] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")).collect())
    assert got == [(10, 1, 4, 4), (11, 1, 4, 4), (12, 2, 296, 296), (14, 2, 296, 296), (15, 1, 4, 4)]
    for held in (10**9, 0):  # broadcast or shuffled
        assert decontaminate.contaminated(odd, spark.createDataFrame(items, "item_id BIGINT, text STRING"), broadcast_bytes=held).count() == 0
    assert decontaminate.contaminated(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_rowwise_operators_on_odd_texts(odd, none):
    lib = sentencepiece_bpe.vocabulary(sentencepiece_bpe.default_model()).library
    ids = lambda t: lib.encode(t or "")
    want = sorted(((d, len(ids(t)), sha(",".join(map(str, ids(t)))), sha(lib.decode(ids(t)))) for d, t in TEXTS), key=repr)
    assert sorted((tuple(r)[:4] for r in sentencepiece_bpe.encode_column(odd).collect()), key=repr) == want
    for run, empty in ((secrets_scan.scan_secrets, 3), (pii_crf.find_pii, 4)):
        rows = run(odd).collect()
        assert len(rows) == len(TEXTS) and {tuple(r)[1 : 2 + empty] for r in rows} == {(0,) * empty + (sha(""),)}
    for run in (sentencepiece_bpe.encode_column, secrets_scan.scan_secrets, pii_crf.find_pii):
        assert run(none).count() == 0


def base_pii(text):
    """The contract's patterns, read plainly."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def base_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return [(a, b, secrets_scan.BASE_KINDS[k]) for a, k, b in sorted(out)]


def test_base_patterns_against_plain_ones():
    rng = np.random.default_rng(9)
    pieces = [["a", "b.c", "@", ".", "-", " ", "+", "1", "25", "255", "256", "4111111111111111", "(", ")", "é", "x@y.z", "10.0.0.1", "5500 0000 0000 0004", "\n"]]
    pieces += [["password", "Token", "api_key", "apikey", '"', "'", " ", ":", "=", "abcdefgh", "AKIA", "ABCDEFGH1234", "0f" * 16, "g", "-", "é", "\n", "."]]
    for k in range(4000):
        text = "".join(rng.choice(pieces[k % 2], rng.integers(1, 14)))
        assert sorted(pii_crf.base_spans(text), key=lambda s: (pii_crf.KINDS.index(s[0]), s[1])) == base_pii(text), text
        assert secrets_scan.scan(text)[0] == base_secrets(text), text


def test_pii_field_on_generated_rows_and_a_long_stretch():
    """Recall of the added spans on rows filled with values the training never drew, and a stretch of many tokens."""
    rng, hit, total = np.random.default_rng(77), 0, 0
    for _ in range(150):
        a, b, c = rng.integers(200, 999), rng.integers(200, 999), rng.integers(1000, 9999)
        for form in (f"{a}-{b}-{c}", f"({a}) {b}-{c}"):
            text = f"please call {form} today"
            spans = pii_crf.added_spans([text], [[]], pii_crf.trained())[0]
            total, hit = total + 1, hit + any(k == "phone" and text[x:y].strip("()") and x <= text.index(str(a)) and y == text.index(str(c)) + 4 for k, x, y in spans)
    assert hit / total > 0.9
    long = "7," * 3000 + " call 555-123-4567 now"
    got = pii_crf.added_spans([long, "call 555-123-4567 now"], [[], []], pii_crf.trained())
    assert [long[a:b] for _, a, b in got[0]][-1:] == ["555-123-4567"] == ["call 555-123-4567 now"[a:b] for _, a, b in got[1]]


def brute_repeats(rows):
    first, out = {}, []
    for d, t in sorted(rows):
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], d) < d:
                gone[i : i + 50] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def test_substrings_in_full_against_brute_force(spark, odd, none):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcde é"), 400))
    rows = []
    for i in range(80):
        a, n = int(rng.integers(0, 340)), int(rng.integers(30, 120))
        rows.append((i, "".join(rng.choice(list("xyz "), rng.integers(0, 150))) + passage[a : a + n] * int(rng.integers(1, 3)) + "".join(rng.choice(list("uvw"), rng.integers(0, 60)))))
    rows += [(100, rows[3][1]), (101, passage), (102, passage * 3), (103, "a" * 500), (104, "a" * 300), (105, "ab" * 200)]
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)).collect())
    assert got == brute_repeats(rows)
    assert substring_dedup.remove_repeats(odd.where("doc_id IS NULL OR doc_id <> 5")).count() == len(TEXTS) - 2
    nulls = [r for r in substring_dedup.remove_repeats(odd).collect() if r["doc_id"] is None]
    assert len(nulls) == 2 and all(r["n_removed"] == 0 for r in nulls)


def test_html_of_odd_pages(spark):
    body = "<article><p>one&nbsp;two &lt;b&gt;</p><p>x &#x41;</p></article>"
    rows = [(1, None, None), (None, "u", body), (2, "u", body), (2, "u", body), (3, "u", "<p"), (4, "u", "&#xD800;&#0;&#99999999;"), (5, "u", "<article>" + "<p>w</p>" * 20_000 + "</article>"), (6, "u", "<script>a</script><style>b</style>")]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").withColumns({c: F.lit("x") for c in ("text", "n_chars", "host", "blocks", "run", "doc_id")})
    got = html_extract.extract(df.repartition(3)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], set()).add(r["text"])
    assert by[1] == {""} and by[6] == {""} and by[2] == by[None] == {"one two <b> x A"} and by[5] == {" ".join(["w"] * 20_000)}
    assert html_extract.extract(df.where("page_id < 0")).count() == 0


def test_html_array_orders_all_pages_of_a_host():
    """One array for the pages of a host: suffixes of different pages in one order, intervals of a common prefix, pages counted once."""
    rng = random.Random(3)
    pages = [[" ".join(rng.choice("abc") for _ in range(rng.choice((3, 8, 30)))) for _ in range(3)] for _ in range(9)] + [[]]
    place, interval, page, toks = html_extract.host_array(pages)
    joined = [w for k, t in enumerate(toks) for w in (*t, f"~{k:03}")]
    first = {w: k for k, w in reversed(list(enumerate(joined)))}  # tokens are ordered by their first place, blocks' ends last
    suffixes = [[(w[0] == "~", first[w]) for w in joined[p : p + html_extract.RUN]] for p in place]
    assert suffixes == sorted(suffixes) and len(place) == sum(len(t) - html_extract.RUN + 1 for t in toks)
    assert [a == b for a, b in zip(suffixes, suffixes[1:])] == [a == b for a, b in zip(interval, interval[1:])]
    foot = "one two three four five six seven eight nine"
    assert html_extract.shared_runs(pages) == [] and set(page) <= set(range(9))
    some = [[*texts, f"{foot} {foot}"] if k < 6 else texts for k, texts in enumerate(pages)]
    turns = [" ".join((foot.split() * 2)[k : k + html_extract.RUN]) for k in range(9)]  # the tenth run is the first again
    assert sorted(html_extract.shared_runs(some)) == sorted((run, 6) for run in turns)


@pytest.mark.parametrize("piece", (100_000, 40))
def test_html_of_hosts_in_one_and_several_arrays(spark, monkeypatch, piece):
    """Equal to brute force over whole hosts, whether a host is one array or dealt over many."""
    monkeypatch.setattr(html_extract, "PIECE", piece)
    rng = random.Random(5)
    foot, half, note = ([f"{x}{k}" for k in range(14)] for x in "fhn")
    rows, parts = [], {}
    for i in range(60):
        host = rng.choice(("one.example", "two.example", "three.example"))
        body = [f"w{rng.randrange(40)}" for _ in range(rng.choice((2, 9, 40)))]
        texts = [body, *([foot] if rng.random() < 0.8 else []), *([half] if rng.random() < 0.5 else []), *([note[:9] + body] if rng.random() < 0.6 else [])]
        marked = i % 7 == 0
        rows.append((i, f"http://{host}/{i}", "".join(f"<{'article' if marked and t is body else 'div'}>{' '.join(t)}</{'article' if marked and t is body else 'div'}>" for t in texts)))
        parts[i] = (host, marked, texts)
    run = html_extract.RUN
    runs = lambda t: {tuple(t[k : k + run]) for k in range(len(t) - run + 1)}
    want = {}
    for i, (host, marked, texts) in parts.items():
        pages = {str(p[1:]): p for p in parts.values() if p[0] == host}.values()
        count = {}
        for _, m, ts in pages:
            for r in set().union(*(runs(t) for t in ts[m:])):
                count[r] = count.get(r, 0) + 1
        cut = {r for r, n in count.items() if n > len(pages) / 2}
        left = []
        for t in texts[:1] if marked else texts:
            gone = set() if marked else {k + j for k in range(len(t) - run + 1) if tuple(t[k : k + run]) in cut for j in range(run)}
            left += [w for k, w in enumerate(t) if k not in gone]
        want[i] = " ".join(left)
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").repartition(7)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == want and any(len(want[i].split()) < sum(map(len, parts[i][2])) for i in want if not parts[i][1])


def test_pipeline_judges_rows_not_ids(spark):
    """A copy under the id of a unique text, copies without an id, and ids that repeat."""
    unique, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, other), (2, other), (2, unique), (None, other.upper()), (None, "alone " + " ".join(f"u{i}" for i in range(30))), (3, other + " more"), (3, " ".join(f"t{i}" for i in range(30)))]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars INT")
    exact = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_copies(spark, df, "").collect()]
    assert sorted(exact, key=repr) == sorted([rows[1], *rows[2:3], *rows[4:]], key=repr)
    near = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_near_copies(spark, df, "").collect()]
    assert sorted(near, key=repr) == sorted([rows[0], rows[2], rows[4], rows[6]], key=repr)
    ids = common.with_row_ids(df, "row").collect()
    assert len({r["row"] for r in ids}) == len(rows) and [r["row"] for r in ids if r["doc_id"] == 1] == [1]


def test_scratch_folder_is_never_local_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"

        class _jsc:
            sc = staticmethod(lambda: Context)

        getCheckpointDir = staticmethod(lambda: Context)
        isDefined = staticmethod(lambda: False)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)


@pytest.mark.parametrize(("many", "hot", "rows_per_batch"), [(2, 3, 7), (2, 10**6, 3), (10**6, 3, 1), (3, 20, 1000)])
def test_substrings_of_hot_passages_against_brute_force(spark, many, hot, rows_per_batch):
    """One passage in many surroundings, dealt by context and compared by windows, in batches of a few rows."""
    rng = np.random.default_rng(many + hot)
    word = lambda n: "".join(rng.choice(list("abcé "), n))
    common_, other = word(90), "xy" * 40
    rows = []
    for i in rng.permutation(120).tolist():
        a, b = sorted(rng.integers(0, 90, 2).tolist())
        rows.append((i, word(int(rng.integers(0, 60))) + common_[a:] + other[: int(rng.integers(0, 80))] + common_[: b + 20] + word(int(rng.integers(0, 60)))))
    rows += [(200 + i, word(10) + common_ + common_) for i in range(30)] + [(300, other * 3), (301, None), (302, common_[:30])]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, rows_per_batch)
    try:
        table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)
        got = sorted(tuple(r) for r in substring_dedup.remove_repeats(table, many=many, hot=hot).collect())
    finally:
        spark.conf.set(size, before)
    assert got == brute_repeats([(d, t or "") for d, t in rows])
