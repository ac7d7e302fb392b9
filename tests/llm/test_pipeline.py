import hashlib
import random
import zlib
from collections import Counter

import brute
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import bpe, toxicity
from textloom.llm.queries import ORACLES, QUERIES


def planted():
    """Rows of (doc_id, text, source), and labels of doc_id."""
    rnd = random.Random(18)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(20, 80))) for _ in range(140)]
    texts += [f"{rnd.choice(texts)} you rotten fool {rnd.choice(words)}" for _ in range(50)]
    texts += [rnd.choice(texts) for _ in range(40)] + [texts[0]] * 20
    base = [rnd.choice(words) for _ in range(200)]
    for _ in range(40):  # one large group of near copies
        own = list(base)
        own[rnd.randrange(200)] = "new"
        texts.append(" ".join(own))
    for i in range(20):
        own = texts[i].split()
        texts.append(" ".join(own[:-1] + ["end"]))
    texts += ["", "one", " ", None]
    rnd.shuffle(texts)
    rows = [(i, t, rnd.choice(["a", "a", "b", "c"])) for i, t in enumerate(texts)]
    return rows, {i: int("rotten" in (t or "")) for i, t, _ in rows if i % 5}


def test_stages_equal_plain_versions(spark, tmp_path):
    rows, labels = planted()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"

    known = [r["doc_id"] for r in docs.orderBy(F.xxhash64("doc_id", "text")).collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    text, rates = {i: t for i, t, _ in rows}, toxicity.Rates()
    known = [i for i in known if text[i] is not None] + [i for i in known if text[i] is None]
    score = brute.calibrated_ftrl([(labels[i], brute.text_features(text[i])) for i in known], rates)
    calm = [r for r in rows if score(brute.text_features(r[1])) < 0.7]
    last = {}
    for i, t, _ in calm:
        last[t or ""] = max(i, last.get(t or "", i))
    single = [r for r in calm if last[r[1] or ""] == r[0]]
    classes = brute.links_of_all_pairs([r[:2] for r in single])
    apart = [r for r in single if classes[r[0]] == r[0]]
    times = brute.mixed(apart)
    want = [Counter(r[0] for r in calm), Counter(r[0] for r in single), Counter(r[0] for r in apart), Counter({i: n for i, n in times.items() if n})]
    assert len(rows) > len(calm) > len(single) > len(apart) > 100 and len(rows) - len(calm) > 40

    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        columns, docs = docs.columns, stage(spark, docs, sf)
        assert docs.columns == columns, name
        assert Counter(r["doc_id"] for r in docs.select("doc_id").collect()) == ids, name

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe._vocabulary(f.read()).ranks
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = Counter()
    for i, n in want[-1].items():
        ids = coder.encode_ordinary(text[i] or "")
        made[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text[i] or "").encode()).hexdigest()] += n
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == made


def test_stages_on_the_real_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, sf)
        assert docs.columns == names, name
        if "mixing" not in name:
            assert 0.5 * before < docs.count() <= before, name
            assert docs.select("doc_id").distinct().count() == docs.count()


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
