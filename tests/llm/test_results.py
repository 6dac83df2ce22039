"""Each registered query of the subpackage against plain Python, all of its columns, on the smallest tables."""

import hashlib
import html
import re
import time
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import ann, common, pii, queries, quality, secrets, toxicity

from .test_llm import ODD, SF, frame, plain_hits, plain_pii, plain_secrets


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in common.table(spark, SF, "documents").collect()}


def rows(spark, name):
    got = queries.queries()[name](spark, SF)
    return got, {r[0]: r for r in got.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name, operator, label, least", [("op1_quality", quality, "quality", 0.5), ("op4_toxicity", toxicity, "toxic", 0.7)])
def test_scores(spark, docs, name, operator, label, least):
    df, got = rows(spark, name)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")] and set(got) == set(docs)
    table = [common.table(spark, SF, t) for t in ("documents", "labels")]
    model = operator.train(*table)
    again = {r["doc_id"]: r["score"] for r in operator.score(table[0].select("doc_id", "text"), model).collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= least)
        assert abs(r["score"] - again[i]) < 1e-12 and 0 <= r["score"] <= 1
    if name == "op1_quality":
        for i in list(docs)[:40]:
            assert abs(model.of([docs[i]])[0][0] - got[i]["score"]) < 1e-9
    shown = {r["text"] for r in table[0].join(table[1], "doc_id").where(common.held_out()).select("text").collect()}
    trained = {t for t, _ in common.training_rows(*table, label, 10_000)}
    alone = {docs[i] for i in docs if zlib.crc32(str(i).encode()) % 3 != 1}
    assert not (shown - alone) & trained


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df, got = rows(spark, "op2_token_binary")
    assert df.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")] and set(got) == set(docs)
    start = 0
    for i in sorted(docs):
        ids = [*t.encode(docs[i], add_special_tokens=False).ids, 2]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_personal_data(spark, docs):
    df, got = rows(spark, "op3_pii")
    assert set(got) == set(docs)
    for i, r in got.items():
        base = plain_pii(docs[i])
        shown = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == j for b in base) for j in range(4)] and r["base_sha256"] == sha(shown)
        spans = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        places = [(int(s), pii.KINDS.index(k), int(e)) for k, s, e in spans]
        assert places == sorted(places) and set(base) <= set(places)
        more = [p for p in places if p not in set(base)]
        assert not any(s < e2 and s2 < e for s, _, e in more for s2, _, e2 in base) and not any(a[2] > b[0] for a, b in zip(more, more[1:]))


def test_secrets(spark, docs):
    names = [r.name for r in secrets.BASE_RULES]
    df, got = rows(spark, "op5_secrets")
    assert set(got) == set(docs)
    for i, r in got.items():
        base = plain_secrets(docs[i])
        assert [r[f"n_{k}"] for k in names] == [sum(b[1] == j for b in base) for j in range(3)]
        assert r["base_sha256"] == sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in base))
        assert {f"{names[k]}:{s}:{e}" for s, k, e in base} <= set(r["spans"].split(","))


def test_main_texts(spark):
    df, got = rows(spark, "op7_html_text")
    pages = common.table(spark, SF, "pages").collect()
    assert df.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")] and len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
        text = " ".join(x for x in parts if x)
        assert tuple(got[p["page_id"]]) == (p["page_id"], p["url"], text, len(text))


def test_contamination(spark, docs):
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    df, got = rows(spark, "op8_decontamination")
    assert set(got) == set(docs)
    for i in sorted(docs)[::4]:
        n, hit, found = plain_hits(docs[i], items)
        assert tuple(got[i]) == (i, n, hit, len(found), sha(",".join(found)), hit > 0 and 20 * hit >= n)


def test_byte_bpe(spark, docs):
    import tiktoken

    from lumenframe.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    df, got = rows(spark, "op9_byte_bpe")
    assert set(got) == set(docs)
    for i, text in docs.items():
        ids = reference.encode_ordinary(text)
        assert tuple(got[i])[:4] == (i, len(ids), sha(",".join(map(str, ids))), sha(text))


def test_nearest(spark):
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in common.table(spark, SF, "embeddings").collect()}
    df = queries.op10_nearest(spark, SF)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append(tuple(r)[1:])
    hit = total = 0
    assert set(got) == {i for i in x if i % 50 == 0}
    for q, found in got.items():
        score = {i: v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q]) for i, v in x.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        found.sort()
        assert [f[0] for f in found] == list(range(1, min(5, len(score)) + 1)) and all(abs(score[v] - s) < 1e-12 for _, v, s in found)
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        hit, total = hit + len({f[1] for f in found} & set(best)), total + len(best)
    assert hit / total >= 0.9


# The semi-Markov field against enumeration


def segmentations(candidates):
    for n in range(len(candidates) + 1):
        for chosen in combinations(range(len(candidates)), n):
            spans = sorted((candidates[c][0], candidates[c][1]) for c in chosen)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                yield chosen


def small_region(seed):
    rng = np.random.default_rng(seed)
    found = sorted({(int(i), int(i + rng.integers(1, 4)), int(rng.integers(4))) for i in rng.integers(0, 6, 7)})
    return pii.Region(list(range(0, 100, 10)), [(i, j, k, [f"email:f{n % 4}", f"{pii.KINDS[k]}:k"]) for n, (i, j, k) in enumerate(found)])


@pytest.mark.parametrize("seed", range(12))
def test_best_segmentation_equals_enumeration(seed):
    region, rng = small_region(seed), np.random.default_rng(seed + 50)
    scored = [(i, j, k, float(rng.normal())) for i, j, k, _ in region.candidates]
    most = max(sum(scored[c][3] for c in chosen) for chosen in segmentations(scored))
    value = {(region.bounds[i], k, region.bounds[j]): s for i, j, k, s in scored}
    assert abs(sum(value[x] for x in pii.best(region.bounds, scored)) - most) < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_a_step_of_the_fit_equals_enumeration(seed):
    """One step from no weights follows the gold features less those expected over all segmentations, each equally likely."""
    region = small_region(seed)
    i, j, k, gold_features = region.candidates[0]
    gold = {(region.bounds[i], k, region.bounds[j])}
    every = list(segmentations(region.candidates))
    expected, own = {}, {}
    for chosen in every:
        for c in chosen:
            for f in region.candidates[c][3]:
                expected[f] = expected.get(f, 0) + 1 / len(every)
    for f in gold_features:
        own[f] = own.get(f, 0) + 1
    model = pii.SemiMarkovCRF().fit([(region, gold)], epochs=1, rate=1.0, decay=0.0)
    for f in set(expected) | set(own):
        assert abs(model.weights.get(f, 0.0) - (own.get(f, 0) - expected.get(f, 0))) < 5e-3


def test_scores_by_form_equal_sums_of_features():
    """The short way, which looks closely only at spans that can still score, finds what summing all features finds."""
    rng = np.random.default_rng(0)
    texts = ["call (555) 234-9876 or 555.123.4567, mail a (at) b (dot) co", "10.0.0.1 and 4111-1111-1111-1111 x 1 2 3 4 5 6 7 8"]
    names = {x for t in texts for r in pii.regions(t) for c in r.candidates for x in c[3]}
    for _ in range(20):
        model = pii.SemiMarkovCRF({x: float(rng.normal()) for x in names})
        for t in texts:
            plain = [[(i, j, k, s) for i, j, k, f in r.candidates if (s := sum(model.weights.get(x, 0.0) for x in f)) > 0] for r in pii.regions(t)]
            assert model.find(t) == [x for r, c in zip(pii.regions(t), plain) for x in pii.best(r.bounds, c)]


@pytest.mark.parametrize("part, n", [("x", 1_000_000), ("1", 1_000_000), ("1.", 500_000), ("12 34 ", 150_000), ("a@", 400_000), ("x(at)", 200_000), ("+1(", 300_000), ("0123456789abcdef", 60_000), ("1-", 300_000), ("a.b@c.d ", 100_000)])
def test_hostile_texts_take_linear_time(part, n):
    began = time.perf_counter()
    pii.spans_of(part * n + "@", pii.SemiMarkovCRF({"phone:bias": 0.1}))
    assert time.perf_counter() - began < 12


# Odd rows through every stage of the pipeline


def test_stages_take_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns whose names the operators use themselves."""
    clean = "a plain clean sentence about the weather of the day and the town number "
    odd = [*ODD, (50, clean + "one"), (50, clean + "two and three more words than before so that it differs enough to stay apart"), (51, "token = abcdef12345 " + clean * 2), (None, None)]
    names = ["score", "matches", "n_words", "hits", "items", "blob", "findings", "node", "spans", "_blob", "component", "_row", "_place", "_text", "a.b"]
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", *[f"'{n}' AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        got = out.collect()
        assert all(r[n] == n for r in got for n in names)
        before = {(r[0], r[1]) for r in odd}
        if name in ("toxicity", "benchmark_decontamination"):
            assert len(got) == len(odd)
        elif name == "ngram_jaccard_join":
            assert {(r["doc_id"], r["text"]) for r in got} == before and len(got) == len(odd) - 1
            copies = df.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(df)
            again = stage(spark, copies, SF).collect()
            wordless = sum(not common.normal_words(t) for _, t in before)
            assert len(again) == len(got) + sum(i is not None and not common.normal_words(t) for i, t in before) and wordless
        else:
            assert len(got) == len(odd) and all("abcdef12345" not in (r["text"] or "") for r in got)
            assert {r["text"] for r in got} - {r[1] for r in odd} == {odd[-2][1].replace("token = abcdef12345", "<secret>")}
    ids = corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
    assert len(ids) == len(odd) and sum(r["n_tokens"] == 0 for r in ids) == sum(not t for _, t in odd)


def test_operators_on_empty_tables(spark):
    none = frame(spark).limit(0)
    assert pii.find(none, pii.train(none)).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), 50).dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]


def test_only_shared_folders_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(spark.sparkContext.getConf)

    class Session:
        sparkContext, conf = Context, spark.conf

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            common.shared_folder(Session, "x")
