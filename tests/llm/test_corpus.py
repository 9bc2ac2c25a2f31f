import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.llm import common, html_text, language_id, mixing, neighbours, ngram_join, packing, pii, quality, toxicity, warc
from halocline.llm.common import new_path, table, written
from halocline.llm.components import components

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCE = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns of clashing names."""
    texts = [None, "", " \n\t", "one", "two words", SENTENCE, SENTENCE, SENTENCE + " more", "x " * 30000, "ÀÉ ß 中文 mail a@b.cd 1.2.3.4", "\x1c ", SENTENCE.upper()]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None, "a", "b", "c") for i, t in enumerate(texts)]
    rows += [rows[5], (None, SENTENCE, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _sets(rows, n):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset([tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or ([tuple(w)] if w else []))
    return out


def _brute_components(sets, percent):
    parent, seen = {i: i for i in sets}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j, k in Counter(j for s in sets[i] for j in seen[s]).items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            seen[s].append(i)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("words", "percent", "page"), [(3, 90, 1_000_000), (5, 80, 1_000_000), (5, 80, 3000)])
def test_join_is_exact(spark, words, percent, page):
    rng = np.random.default_rng(4)
    base = [[f"v{x}" for x in rng.integers(0, 4000, n)] for n in (12, 30, 80, 200, 200)]
    rows = []
    for i in range(150):
        t = list(base[i % 5])
        for _ in range(rng.integers(0, 1 + len(t) // 12)):
            t[rng.integers(len(t))] = f"z{rng.integers(10**6)}"
        rows.append((i, " ".join(t)))
    sets = _sets(rows, words)
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.JoinParameters(words=words, percent=percent, page_shingles=page, pivots=2)).collect()
    assert {r.doc_id: r.component_id for r in found} == _brute_components(sets, percent)
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(s) for i, s in sets.items()}


def test_join_of_odd_rows(odd, empty):
    found = ngram_join.join(odd).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[1].component_id == 1
    assert by[6].component_id == by[7].component_id == by[11].component_id == 5
    assert ngram_join.join(empty).count() == 0


def test_counting_shingles_takes_few_bytes_in_many_ranges(spark):
    """As many ranges as several GB have, in which no set has two shingles: names of sets do not go along with each."""
    docs = spark.range(0, 2000, 1, 4).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 250), i -> string(hash(id, i))), ' ')").alias("text"))
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    found = ngram_join.join(docs, ngram_join.JoinParameters(words=3, percent=90, range_entries=1000))
    assert found.where("component_id = doc_id and n_shingles = 248").count() == 2000
    assert shuffled() - before < 10 * 2000 * 248


def test_own_shingles_are_never_too_many(spark):
    """Sets in one block or several, with copies, and shingles that some share."""
    rows = [(i, " ".join([*(f"w{i}x{k}" for k in range(40)), *(f"s{i % 7}x{k}" for k in range(30))])) for i in range(60)] + [(100 + i, "a b c d e") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {ngram_join.name_of(s): set(s.tolist()) for s in (ngram_join.shingles(t, 3) for _, t in rows)}
    held = Counter(x for s in sets.values() for x in s)
    for block in (1_000_000, 500, 1):
        found = ngram_join._own(docs, 5000, ngram_join.JoinParameters(words=3, percent=90, range_entries=100, block_entries=block)).collect()
        own = {r.set: r.own for r in found}
        assert len(own) == len(found)
        for name, s in sets.items():
            exact = sum(held[x] == 1 for x in s)
            assert own.get(name, 0) == exact or len(s) == 3 and own.get(name, 0) == 0  # copies in several blocks


def test_written_tables_free_their_shuffles(spark):
    from halocline.llm.common import written

    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = files(), spark.conf.get(key, None)
    found = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert found.count() == 7 and spark.conf.get(key, None) == set_to


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, x) for x in range(101, 140)] + [(139, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found[9] == found[100] == found[120] == 0 and found[19] == 10


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2500, 16)).astype(np.float32)
    x[7] = x[8] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9020, [None] + [1.0] * 15)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.search(vectors, vectors.where("vec_id % 20 = 0")).toPandas()
    hit = 0
    for q in range(0, 2500, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(2500), -s))[:20]) & set(found[found.query_id == q].vec_id))
    assert hit / (125 * 20) >= 0.9 and (found.groupby("query_id").size() == 20).all() and 9020 not in set(found.query_id)
    assert neighbours.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_neighbours_of_many_isotropic_rows(spark, tmp_path):
    n = 100_000
    x = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists}), tmp_path / "v.parquet", row_group_size=10_000)
    vectors = spark.read.parquet(str(tmp_path / "v.parquet"))
    found = neighbours.search(vectors, vectors.where("vec_id % 1000 = 0")).toPandas()
    hit = 0
    for q in range(0, n, 1000):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(set(np.argpartition(-s, 19)[:20]) & set(found[found.query_id == q].vec_id))
    assert hit / (n // 1000 * 20) >= 0.9


def _exact(x, q, k):
    s = x @ x[q]
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k]


def test_neighbours_of_clusters(spark):
    """Where few lists hold the neighbours, few are probed: less than a fifth of them here, at a recall of 0.9 or more."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 24))[rng.integers(0, 300, 30_000)] + 0.1 * rng.normal(size=(30_000, 24))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    p = neighbours.NeighbourParameters(probes=4, first=2, block_rows=2048)
    rows = vectors.selectExpr("vec_id as id", "embedding as v")
    index = neighbours.build(rows, p)
    assert len(index.centroids) > 100
    shared = spark.sparkContext.broadcast(index)
    placed = rows.mapInPandas(lambda frames: (f.assign(list=shared.value.distances(shared.value.place(np.stack(f["v"]).astype(float))).argmin(1).astype("int32")) for f in frames), "id long, v array<float>, list int")
    asked = rows.where("id % 300 = 0")
    assert neighbours.probes_needed(placed, asked, index, p) < len(index.centroids) / 5
    found = neighbours.search(vectors, vectors.where("vec_id % 300 = 0"), p).toPandas()
    x = x.astype(float)
    hit = sum(len(set(_exact(x, q, 20)) & set(found[found.query_id == q].vec_id)) for q in range(0, 30_000, 300))
    assert hit / (100 * 20) >= 0.9 and (found.groupby("query_id").size() == 20).all()
    for r in found.itertuples():
        assert r.score == pytest.approx(x[r.query_id] @ x[r.vec_id], rel=1e-12)


def test_neighbours_of_odd_rows(spark):
    """Other lengths first, null and repeated ids, ties, clashing columns, and fewer candidates than asked for."""
    rows = [(900, [1.0, 2.0, 3.0], 0.5, 1), (None, [1.0, 1.0], 0.5, 1)] + [(i, [float(i % 7), 1.0], 0.5, 1) for i in range(59)] + [(20, [9.0, 9.0], 0.5, 1), (40, [float(40 % 7), 1.0], 0.5, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int")
    found = neighbours.search(vectors, vectors.where("vec_id % 20 = 0")).toPandas()
    assert found.columns.tolist() == ["query_id", "rank", "vec_id", "score"]
    points = [(i, v) for i, v, *_ in rows[2:]]
    for q, vector in {(i, tuple(v)) for i, v in points if i % 20 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, vector, strict=True)), i) for i, v in points if i != q)[:20]
        own = found[found.query_id == q]
        got = [(-s, i) for s, i in zip(own.score, own.vec_id, strict=True)]
        assert all(x in got for x in best) and len(own) == (40 if q == 20 else 20)
    few = vectors.where("vec_id < 5")
    assert neighbours.search(few, few.where("vec_id = 0")).count() == 4


def test_encoder_agrees_with_the_tokenizer():
    texts = [
        "naïve, señor. über$$$ à l'été. ÿ, ßa, íñ÷ ÷a ÀÉ, éa\u0301. x\u00adé déjà-vu éàíïð×þ 12é4",
        "İ, İ. é, É, ÷, a÷, ß. abc<|endoftext|>def, X<|ENDOFTEXT|>, <|startoftext|>",
        "don't we'll 's ,.. ..., a., b,. it's. 12,3. x\x1cy\x00z \x85 \xa0a क़, ﬁ, é, \u0301, 😀, A😀. ẞ. ŉ, ǅ, 中文。",
        "", None, "  ", "a", ", .", "can't, CAN'T. '' 's, _x_ __, x_", "¹², ½. Ⅷ, ١٢.",
    ]
    encode = packing.Encoder(packing.PackingParameters(remembered_words=20))
    whole = [[*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for _ in range(2):  # new, then known
        assert [x.tolist() for x in encode(texts)] == whole
    for t, ids in zip(texts, whole, strict=True):  # forgetting in between
        assert encode([t])[0].tolist() == ids
    assert encode([]) == []


def test_encoder_looks_up_distinct_words_only():
    class Counted(packing._Numbers):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    encode = packing.Encoder(packing.PackingParameters())
    encode._forget()
    encode.numbers = Counted()
    encode.numbers[b""] = 0
    encode._forget = lambda: None
    texts = ["word word, Word. " * 1000, None, "a, b.", ",x", ".", "é, \n"]
    found = encode(texts)
    assert [x.tolist() for x in found] == [encode._whole(t).tolist() for t in texts]
    assert Counted.asked < 20


def test_encoder_forgets_words_of_one_slice():
    """Words that come once don't pile up in the worker; those that come again stay, and ids are the same throughout."""
    encode = packing.Encoder(packing.PackingParameters(single_words=100))
    for i in range(40):
        text = "often. a word " + " ".join(f"w{i}x{j}" for j in range(50)) + (" w0x7 w1x1" if i % 3 == 0 else "")
        assert encode([text])[0].tolist() == encode._whole(text).tolist()
        assert len(encode.numbers) == len(encode.length) <= 1 + 6 + 100 + 2 * 52
    assert {b"often", b"a", b"word"} <= set(encode.numbers) and encode.numbers[b""] == 0


def test_packing_gets_small_batches(spark, monkeypatch):
    """Long texts reach the encoder in batches of some megabytes, and the session's setting is as before."""
    seen, key = [], common.BATCH
    monkeypatch.setattr(packing, "written", lambda df, what: seen.append(df.sparkSession.conf.get(key)) or written(df, what))
    before = spark.conf.get(key)
    packing.pack(spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")))
    assert seen == ["4m"] and spark.conf.get(key) == before
    with common.arrow_batches(spark, "1m"):
        rows = spark.range(600).select(F.expr("repeat('word ', 2000)").alias("text")).coalesce(1)
        sizes = rows.mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 4 and max(r.n for r in sizes) < 2_000_000


def test_lean_gives_the_same():
    assert list(common.lean(lambda batches: (2 * x for x in batches))(iter([1, 2, 3]))) == [2, 4, 6]


def test_personal_data_starts_no_python_workers(spark, monkeypatch):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("mail me: a.b@example.org or +1 202 555 0100").alias("text"))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("a list of rows goes through Python workers"))
    assert pii.detect(docs).where("size(base) = 2").count() == 20


def test_another_tokenizer_is_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"[x]": 0, "Word": 1, "word": 3, "a": 4}, unk_token="[x]"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.save(f"{tmp_path}/t.json")
    encode = packing.Encoder(packing.PackingParameters(tokenizer=f"{tmp_path}/t.json"))
    assert not encode.by_word and [x.tolist() for x in encode(["Word word", None, "a b"])] == [[1, 3, 2], [2], [4, 0, 2]]
    assert packing.Encoder(packing.PackingParameters()).by_word


def test_packing_round_trip(odd, empty):
    from tokenizers import Tokenizer

    rows = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    encode = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    pieces = packing.pack(rows).toPandas()
    for r in rows.collect():
        ids = np.array([*encode.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in pieces[pieces.doc_id == r.doc_id].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    assert packing.pack(odd).count() > 0 and packing.pack(empty).count() == 0


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"n{x}" for x in rng.integers(0, 300, 40)) + (" idiot moron" if i % 4 == 0 else "") for i in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs.where("doc_id < 900"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int"))
    scored = toxicity.score(docs.where("doc_id >= 900"), model).toPandas()
    assert ((scored.score >= 0.5) == (scored.doc_id % 4 == 0)).mean() > 0.97
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(odd.select("doc_id", "text"), none).where("score >= 0.5").count() == 0


@pytest.mark.parametrize("rule", [lambda a, b: a != b, lambda a, b: a and b])
def test_toxicity_learns_pairs(rule):
    """Labels that neither term tells alone: the vectors carry them, and the linear part alone is far off for the first."""
    rng, p = np.random.default_rng(5), toxicity.ToxicityParameters()
    buckets = toxicity._Terms(p.bits)
    has = rng.random((5000, 2)) < 0.5
    terms = [toxicity._terms(" ".join([f"n{x}" for x in rng.integers(0, 500, 25)] + ["alpha"] * bool(a) + ["beta"] * bool(b)), buckets) for a, b in has]
    labels = np.array([float(rule(a, b)) for a, b in has])
    model = toxicity.train(terms[:4000], labels[:4000], p)

    def right(factors):
        z, _ = toxicity._margin(*toxicity._parts(terms[4000:]), 1000, model.bias, model.weights, factors)
        return ((z > 0) == labels[4000:]).mean()

    assert right(model.factors) > 0.97
    if labels.mean() > 0.4:
        assert right(np.zeros_like(model.factors)) < 0.8 and model.factors.any(1).sum() < 50


def test_language(spark, odd, empty):
    found = language_id.op5_language_id(spark, SMALL).join(table(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() / found.count() > 0.97
    model = language_id.fit(odd)
    out = {r.doc_id: r.lang_pred for r in language_id.identify(odd.drop("score"), model).collect()}
    assert out[0] == out[1] == out[2] == out[10] == "und" and out[5] == "en"
    assert language_id.identify(empty.drop("score"), language_id.fit(empty)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("<p>", ""),
        ("<body><nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>One  two<br>three <b>four</p><aside>no</aside><p>five</article><footer>no</footer>", "T & U\nOne two three four\nfive"),
        ("<body><div class='menu'><a>x</a></div><h1>Head</h1><p>Some words that are long enough</p><p>More</p><div id=comments><p>first!</p></div>", "Head\nSome words that are long enough\nMore"),
        ("<html><script>var a='</p>'</script><main><p>a</p><form>no</form><!-- <p>no</p> --><ul><li>b<li>c</ul></main>", "a\nb\nc"),
    ],
)
def test_html(page, text):
    assert html_text.extract(page, {"word": 1.0, "": -2.0, "p": -0.2, "/p": -0.2, "a": -4.0, "li": -0.5}) == text


def _body(inner):
    return f"<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{inner}<footer>f g</footer></body></html>"


PARAGRAPH = "<p>" + "word " * 40 + "</p>"


def test_html_region_follows_the_weights():
    """Without an article: what the scan takes depends on the weights, and structure only completes it."""
    menu = "<ul>" + "<li><a href='x'>link</a></li>" * 6 + "</ul>"
    page = _body("<h1>Title here</h1>" + PARAGRAPH + "<div class='newsletter'>" + "sub " * 60 + "</div>" + PARAGRAPH + "<p>End.</p>" + menu)
    assert html_text.extract(page, {}).split() == ["Title", "here", *["word"] * 80, "End."]
    assert html_text.extract(page, {".newsletter": 0.0}).split() == ["Title", "here", *["word"] * 40, *["sub"] * 60, *["word"] * 40, "End."]
    assert html_text.extract(page, {"p": -60.0}).split() == ["Title", "here", *["word"] * 40]
    assert html_text.extract(page, {"a": -0.1, "/a": -0.1, "li": -0.1, "/li": -0.1}).split()[-7:] == ["End.", *["link"] * 6]
    two = _body("<div>" + PARAGRAPH + "</div><div class='teaser'>" + "buy " * 30 + "</div>")
    assert "buy" in html_text.extract(two, {}) and "buy" not in html_text.extract(two, {".teaser": -5.0})


def test_html_names_are_whole(spark):
    page = "<article><h2 class='section-header'>A b</h2><p class='notice-text'>one two</p><div class='share-price'>x y</div><div class='ad'>no</div></article>"
    assert html_text.extract(page, {}) == "A b\none two\nx y"
    pages = [f"<body><p class='lead'>{'w ' * 30}</p><article>{PARAGRAPH}<p class='fine'>x</p></article></body>" for _ in range(20)]
    weights = html_text.learn(spark.createDataFrame([(p,) for p in pages], "html string"), html_text.HtmlParameters())
    assert weights[".lead"] <= html_text.OUT < weights[".fine"] and weights["word"] > 0 > weights["p"]


@pytest.mark.parametrize("page", ["<a \"'" * 60_000, "<div>x" * 30_000 + "</b>" * 30_000, "<b>" + "<div>x" * 20_000 + "</b>" * 20_000, "<b>" * 20_000 + "<li></li>" * 20_000, "<a '>" * 60_000, "<" * 300_000, "<!--" * 60_000, "<p class=\"" * 30_000])
def test_html_of_hostile_pages(page):
    before = time.thread_time()
    html_text.extract(page, {})
    assert time.thread_time() - before < 5  # seconds; minutes where the time grows with the square


def test_html_of_odd_rows(spark):
    rows = [(None, None, None, "a"), (1, "u", "", "b"), (2, "u", _body("<article>" + "long " * 200_000 + "</article>"), "c"), (2, "u", "no tags", "d"), (2, "u", "no tags", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_text.main_texts(pages, html_text.learn(pages, html_text.HtmlParameters()))
    assert found.columns == ["page_id", "url", "html", "text"]
    assert sorted(len(r.text) for r in found.collect()) == [0, 0, 7, 7, 999_999]


def test_html_of_tables(spark):
    pages = table(spark, SMALL, "pages")
    assert html_text.op6_html_text(spark, SMALL).where("n_chars > 0").count() == pages.count()
    weights = html_text.learn(pages.limit(0), html_text.HtmlParameters())
    assert html_text.main_texts(pages.limit(0), weights).count() == 0


def test_mixing(spark, odd, empty):
    docs = table(spark, SMALL, "documents")
    first, again = (sorted(mixing.op7_mixing(spark, SMALL).collect()) for _ in range(2))
    assert first == again and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in first)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, most = Counter(), {}, Counter()
    for r in first:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        most[s] = max(most[s], r.size)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert abs(sum(target.values()) - sum(r.size for r in first)) < 1e-6
    assert mixing.plan(odd).count() == odd.count() and mixing.plan(empty).count() == 0 and mixing.mix(empty).columns == empty.columns
    assert mixing.mix(docs).count() == sum(r.taken // r.size for r in first if r.size)


def test_targets_stop_at_three_times_the_size(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(rows, mixing.MixingParameters()).collect()}
    assert found["a"] == pytest.approx(30) and found["c"] == pytest.approx(270) and found["b"] == pytest.approx(800)


def _quality(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in quality.judge(odd, labels).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _quality(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judge(empty, labels).count() == 0
    n = spark.range(1).select(quality.binomial_cdf(F.lit(3).cast("long"), F.lit(50).cast("long"), 0.1).alias("p")).first().p
    assert n == pytest.approx(0.25029, abs=1e-4)


def test_cutoffs_come_from_all_labels(spark):
    """1,880 of 200,000 rows over a cutoff prove it; a quarter of both does not."""
    over = {"symbols": (F.col("id") % 10000 < 94).cast("double") * 0.5}
    good = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("stratum"), *[over.get(r, F.lit(0.0)).alias(r) for r in quality.RULES])
    p = quality.QualityParameters()
    cuts = {r.rule: r.cutoff for r in quality.thresholds(good, p).collect()}
    assert cuts == {r: 1 / p.steps for r in quality.RULES}
    assert {r.rule: r.cutoff for r in quality.thresholds(good.limit(50_000), p).collect()}["symbols"] == 0.5


def _cdf(k, n, p):
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return sum(math.exp(x) for x in logs)


def test_binomial_bound_of_few_and_many(spark):
    cases = [(0, 10), (1, 2), (3, 50), (0, 300), (20, 3000), (30, 1500), (1800, 200_000), (1999, 200_000), (9_850, 1_000_000), (299, 300), (300, 300)]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(_cdf(r.k, r.n, 0.01), rel=1e-6), (r.k, r.n)
    vast = spark.createDataFrame([(10**9 // 100, 10**9)], "k long, n long").select(quality.binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("p")).first().p
    assert vast == pytest.approx(0.5, abs=1e-3)


def test_warc(spark):
    big = "<p>" + "é" * 600
    pages = spark.createDataFrame([(1, "u", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u\r\nx", "a\r\n\r\nb"), (6, "u", "a\r\n\r\nb"), (None, "u", big), (2, None, big)], "page_id long, url string, html string")
    found = warc.round_trip(pages, new_path(spark, "warc"), warc.WarcParameters(archive_bytes=1500)).collect()
    assert len(found) == 8
    by = {r.page_id: r for r in found}
    assert (by[1].record_type, by[1].refers_to, by[2].record_type, by[6].record_type) == ("revisit", 2, "response", "response")
    assert by[1].payload_bytes == 1203 and by[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and by[3].payload_bytes == 0
    assert warc.round_trip(pages.limit(0), new_path(spark, "warc")).count() == 0


def test_warc_of_other_columns_and_long_payloads(spark):
    rows = [(1, "x" * 3_000_000, 5, "a"), (2, "x" * 3_000_000, 6, "b"), (None, "y", 7, None), (None, "y", 7, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, payload_bytes int, record_type string")
    found = Counter((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, new_path(spark, "warc")).collect())
    assert found == Counter({(1, None, 3_000_000, "revisit", 2): 1, (2, None, 3_000_000, "response", None): 1, (None, None, 1, "response", None): 2})


def test_warc_records_have_the_mandatory_fields():
    for page in (5, None):
        record = warc._record(page, "u", b"body", 4, hashlib.sha1(b"body").hexdigest(), None, "2001-02-03T04:05:06Z", "0 0 0").decode()
        for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
            assert f"\r\n{name}: " in record
        assert warc.parse(record.encode())["page_id"] == page


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn) or (kind == "phone" and 8 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, odd, empty):
    texts = ["a@b.c%d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.004", "4111 1111 1111 1111 00000000000000000000 0000000000000000", "+1 (017) 555-7713 +12 +1 2 3 4 5 6 7 8)", "ß\U0001f600 a@b.cd", "a" * 50000 + "@b.c " + "9" * 50000 + " " + "1-" * 30000 + "2", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(docs).select("doc_id", pii.written_out(F.col("base")).alias("b"), pii.written_out(F.col("spans")).alias("s")).collect():
        assert r.b == _base(texts[r.doc_id]) and set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    assert pii.detect(odd).count() == odd.count() and pii.detect(empty).count() == 0
    masked = docs.join(pii.detect(docs), "doc_id").select("doc_id", pii.masked(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in masked.collect()}[4] == "ß\U0001f600 [EMAIL]"


def test_pipeline(spark, odd, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd, empty):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), T.StructType([T.StructField(f.name, f.dataType) for f in out.schema]))
        pipeline.STAGES[-1][1](spark, docs, SMALL).count()


def test_personal_data_of_null_and_repeated_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(None, "mail a@b.cd now"), (None, "no data"), (None, "at c@d.ef"), (3, "clean text without any"), (3, "x y@z.cd"), (3, "longer words, then y@z.cd"), (4, None), (None, None), (3, "x y@z.cd")]
    docs = spark.createDataFrame([(i, t, "en", "s", -1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = Counter((r.doc_id, r.text, r.n_chars) for r in pipeline.personal_data(spark, docs, SMALL).collect())
    clean = [(i, re.sub(r"\S+@\S+", "[EMAIL]", t or "") if t else None) for i, t in rows]
    assert found == Counter((i, t, len(t) if t and "[EMAIL]" in t else -1) for i, t in clean)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Rows are told apart by id and text: one row of each group of near copies stays, whatever its id."""
    pipeline = pytest.importorskip("corpus_pipeline")
    other = " ".join(f"o{i}" for i in range(80))
    rows = [(5, SENTENCE), (None, SENTENCE + " more"), (7, other), (7, SENTENCE), (7, "a text of its own"), (7, "a text of its own"), (None, None), (None, "lone words"), (None, "lone words"), (9, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = Counter((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, SMALL).collect())
    assert found == Counter([(5, SENTENCE), (7, other), (7, "a text of its own"), (None, None), (None, "lone words"), (9, ""), (8, "")])


def test_language_stage_rejects_and_corrects(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    english, german = "the house of the man that was there and with them", "das haus und der mann der nicht mit ihnen war ist"
    rows = [(i, english, "en") for i in range(20)] + [(i, german, "de") for i in range(20, 40)] + [(50, german, None), (51, german, "en"), (52, "12 34", "en"), (53, None, "de")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.lang for r in pipeline.language(spark, docs, SMALL).collect()}
    assert found[50] == "de" and 52 not in found and 53 not in found and len(found) == 42 and found[0] == "en"
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.language(spark, unlabelled, SMALL).count() == 42


def _binomial_cdf(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def _cutoffs(rows, p):
    """Brute force: by stratum and rule, the last of the cutoffs from the most lenient on that is proven."""
    by = defaultdict(list)
    for r in rows:
        by[r["stratum"]].append(r)
    out = {}
    for stratum, own in by.items():
        for rule in quality.RULES:
            steps = [min(p.steps, math.ceil(r[rule] * p.steps - 1e-9)) for r in own]
            for j in range(p.steps - 1, 0, -1):
                k = sum(x > j for x in steps)
                if _binomial_cdf(k, len(own), p.risk / 6) > p.error / (6 * len(by)):
                    break
                out[stratum, rule] = j / p.steps
    return out


def test_quality_cutoffs_are_the_proven_ones(spark):
    rng, p = np.random.default_rng(8), quality.QualityParameters()
    rows = []
    for stratum, n in (("en", 5000), ("de", 1500), (None, 1100), ("fr", 40)):
        x = rng.beta([1, 2, 1, 1, 2, 5], [60, 30, 50, 400, 20, 20], (n, 6))
        rows += [(stratum, *map(float, r)) for r in x]
    good = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{r} double" for r in quality.RULES))
    found = {(r.stratum, r.rule): r.cutoff for r in quality.thresholds(good, p).collect()}
    expected = _cutoffs([dict(zip(("stratum", *quality.RULES), r, strict=True)) for r in rows], p)
    assert found == pytest.approx(expected) and {s for s, _ in found} == {"en", "de"} and len(found) == 12
    # on new documents of the same kind, a stratum's rules together keep to its risk
    fresh = rng.beta([1, 2, 1, 1, 2, 5], [60, 30, 50, 400, 20, 20], (100_000, 6))
    assert 0 < (fresh > [found["en", r] for r in quality.RULES]).any(1).mean() <= p.risk


def test_quality_verdict_is_that_of_the_cutoffs(spark):
    rng, p = np.random.default_rng(9), quality.QualityParameters(risk=0.3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(900):
        text = list(rng.choice(words, rng.integers(40, 120)))
        for _ in range(rng.integers(0, 12) if i % 10 else 40):
            text[rng.integers(len(text))] = ["#$%", "LOUD", "what?!"][rng.integers(3)]
        rows.append((i, " ".join(text), "en" if i % 3 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(900) if i % 7], "doc_id long, quality int")
    measures = [r.asDict() for r in quality.measured(docs).collect()]
    failed = {m["doc_id"] for m in measures if m["n_words"] < 50 or 2 * m["n_repeat_words"] > m["n_words"]}
    cuts = _cutoffs([m for m in measures if m["doc_id"] % 10 and m["doc_id"] % 7 and m["doc_id"] not in failed], p)
    kept = {m["doc_id"] for m in measures if m["doc_id"] not in failed and all(m[r] <= cuts.get((m["stratum"], r), 1) for r in quality.RULES)}
    assert {r.doc_id for r in quality.judge(docs, labels, p).where("kept").collect()} == kept
    assert len(cuts) > 6 and len(kept) < 900 - len(failed)


def test_pii_adds_what_its_labelers_agree_on(spark):
    """Written-out emails, national numbers and secrets in fitting surroundings are added; look-alikes are not."""
    rng = np.random.default_rng(4)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(120)]
    texts, wanted = [], []
    for i in range(120):
        number = f"{rng.integers(200, 999)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}"
        made = [(f"please write an email to user{i} [at] mail{i % 9} [dot] com today", "email"), (f"call my phone {number} at noon", "phone"), (f'the token = "{hexes[i]}" is new', "secret"), (f"order ref {number}/x as said", None), (f"commit {hexes[i]} is merged", None), ("plain words only", None), (f"mail bob{i}@site.org now", "email")][i % 7]
        texts.append(made[0])
        wanted.append(made[1])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in pii.detect(docs).collect()}
    for i, kind in enumerate(wanted):
        kinds = [s.kind for s in found[i].spans]
        assert kinds == ([kind] if kind else []), (texts[i], kinds)
        assert [s.kind for s in found[i].base] == (["email"] if i % 7 == 6 else [])
        if kind == "secret":
            assert texts[i][found[i].spans[0].first : found[i].spans[0].last] == hexes[i]


def test_pii_posteriors_are_those_of_the_mixture():
    """Expectation-maximisation against the same model fitted by brute force on drawn votes: reliable labelers are found."""
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.5])
    votes = np.where(rng.random((20_000, 5)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    counted = Counter(map(tuple, votes.tolist()))
    post = pii._expectation_maximisation(list(counted.items()), pii.PiiParameters())
    exact = {}
    for x in counted:
        yes = 0.4 * np.prod(np.where(np.array(x) == 1, right, 1 - right))
        no = 0.6 * np.prod(np.where(np.array(x) == -1, right, 1 - right))
        exact[x] = yes / (yes + no)
    assert sum(n * abs(post[x] - exact[x]) for x, n in counted.items()) / 20_000 < 0.03
