"""The pipeline's stages, each against a plain version of its decisions."""

import collections
import random
import re
import zlib

import corpus_pipeline
from offerlens.llm.common import table
from offerlens.llm.language import identify, train_and_identify, train_models
from offerlens.llm.mixing import mix_sources
from offerlens.llm.packing import pack_documents
from offerlens.llm import catalog, stages

SF = "/root/testdata/sf0.001"


def test_language_stage_learns_from_every_row(spark):
    docs = table(spark, SF, "documents")
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("αβγδεζη") for _ in range(5)) for _ in range(60)) for _ in range(3)]
    ids = [i for i in range(9000, 9100) if zlib.crc32(str(i).encode()) % 4 == 2][:3]
    more = spark.createDataFrame([(i, t, "el", "src1", 1) for i, t in zip(ids, texts, strict=True)], docs.schema)
    kept = stages.language_id(spark, docs.unionByName(more), SF)
    assert kept.where("lang = 'el'").count() == 3


def test_language_stage_keeps_columns_of_any_name(spark):
    docs = table(spark, SF, "documents").limit(60)
    odd = docs.selectExpr("*", "doc_id AS _lang", "'x' AS _score", "1 AS _entropy", "doc_id AS _letters", "'y' AS _accepted", "'z' AS _text", "true AS _teaches", "doc_id AS `a b`")
    kept = stages.language_id(spark, odd, SF)
    assert kept.columns == odd.columns and kept.count() > 30
    assert kept.where("_lang = doc_id AND _score = 'x' AND _letters = doc_id AND _accepted = 'y' AND _text = 'z' AND `a b` = doc_id").count() == kept.count()
    assert stages.language_id(spark, docs.limit(0), SF).count() == 0


def test_scoring_once_equals_scoring_twice(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    once = train_and_identify(docs, teaches=~catalog.held_out(docs)).select("doc_id", "_lang", "_score", "_accepted")
    twice = identify(docs, train_models(catalog.training_rows(docs))).select("doc_id", "_lang", "_score", "_accepted")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_near_duplicates_with_null_and_shared_ids(spark):
    docs = table(spark, SF, "documents")
    word = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [
        (None, word("a")), (None, word("a") + " x"), (1, word("a") + " y"),  # null ids
        (5, word("b")), (6, word("b") + " x"), (6, word("c")),  # the clean text shares the id of a near copy
        (7, word("d")), (7, word("d") + " x"),  # both share one id
        (8, word("e")), (8, word("e")), (9, ""), (9, ""), (None, None), (None, None),
    ]
    given = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    got = [(r.doc_id, r.text) for r in stages.near_dedup_stage(spark, given, SF).collect()]
    assert sum(t in (word("d"), word("d") + " x") for _, t in got) == 1 and len(got) == 9
    assert {t[:2] for _, t in got if t} == {"a0", "b0", "c0", "d0", "e0"} and (5, word("b")) in got and (6, word("c")) in got
    assert got.count((9, "")) == got.count((None, None)) == 2 and [i for i, t in got if t and t[:2] == "a0"] == [None]


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    # junk that belongs to no language, a null text, a copy and a repeated row
    some = docs.where("length(text) > 400").orderBy("doc_id").first()
    more = spark.createDataFrame(
        [(9001, "zzq xqj " * 40, None, "src1", 1), (9002, None, "en", "src1", 0), (9003, some.text, some.lang, None, 5), (9003, some.text, some.lang, None, 5)], docs.schema
    )
    docs, kept = docs.unionByName(more), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
    named, exact, near, mixed, packed = kept
    assert all(d.columns == columns for d in kept[:4])
    rows = named.collect()
    ids = {r.doc_id for r in rows}
    assert not {9001, 9002} & ids and table(spark, SF, "documents").where(r"text rlike '\\p{L}'").count() == len(ids - {9003})
    best = {}
    for r in rows:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert collections.Counter(r.doc_id for r in exact.collect()) == collections.Counter(best.values())
    grams = {}
    for r in exact.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        grams[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in grams}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in grams:
        for b in grams:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert sorted(r.doc_id for r in near.collect()) == sorted({top(i) for i in grams})
    copies = {r.doc_id: r.copies for r in mix_sources(near).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter(copies)
    want = pack_documents(mixed, tokenizer=catalog.tokenizer_path())
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, want.collect()))
