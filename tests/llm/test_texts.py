"""Operators 2, 3, 5, 8, 9 and 10 against plain versions, round trips and held-out data."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard

from offerlens.llm import catalog, language, tokens
from offerlens.llm.common import table, worker_cache
from offerlens.llm.html_blocks import blocks_of
from offerlens.llm.html_extract import extract, page_maker
from offerlens.llm.labeller import Features, Labeller
from offerlens.llm.language import identify, train_models, word_scores
from offerlens.llm.mixing import mix_sources, mixed_documents, source_targets
from offerlens.llm.packing import first_fit_decreasing, pack_documents
from offerlens.llm.quality import quality_rules
from offerlens.llm.tokens import token_bytes
from offerlens.llm.warc import dictionary_of, read_records, read_warc, write_warc
from tools.check import compare

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, u long, bucket int, grp long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 1, "x", 2, 3, 4) for i, t, lang, s in rows], DOCS)


ODD = [
    (1, None, "en", "b"), (2, "", None, "b"), (3, "one two three", "en", "a"), (4, "one two three", "en", None), (5, "x " * 3000, "en", "b"), (5, "x " * 3000, "en", "b"),
    (None, "no id", None, None), (6, "ñandú café\r\n\x00tab\there", "es", "a"), (7, "word.\nNext, 'tis <|endoftext|>  two", "en", "\U0001f600"), (8, " ", "en", ""),
]


def test_oracles_hold_on_odd_rows(spark, tmp_path):
    docs(spark, ODD).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("op5_mixing",):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        result = db.execute(catalog.ORACLES[name])
        order = [[d[0] for d in result.description].index(c) for c in df.columns]
        assert compare(got, [tuple(r[i] for i in order) for r in result.fetchall()]) is None


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    result = db.execute(catalog.ORACLES[name])
    order = [[d[0] for d in result.description].index(c) for c in df.columns]
    assert compare([tuple(r) for r in df.collect()], [tuple(r[i] for i in order) for r in result.fetchall()]) is None


# mixing


def filled(sizes, weights, total, most):
    """Water-filling by repetition: clamp what is above its cap, share the rest again."""
    target, free = {}, dict(sizes)
    while free:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level > most * sizes[s]]
        if not over:
            target |= {s: weights[s] * level for s in free}
            break
        for s in over:
            target[s] = most * free.pop(s)
    return target


def test_targets_equal_repeated_clamping(spark):
    r = random.Random(1)
    for _ in range(3):
        sizes = {f"s{k:02}": int(10 ** r.uniform(0, 5)) for k in range(9)}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {x.source: x.target for x in source_targets(rows, [3, 1, 2], 1.5, 2).collect()}
        want = filled(sizes, {s: [3, 1, 2][k % 3] for k, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()), 2)
        assert got == pytest.approx(want)


def test_mix_comes_near_its_targets(spark):
    d = table(spark, SF, "documents")
    rows = mix_sources(d).collect()
    sources = {r.doc_id: r.source for r in d.collect()}
    taken, largest, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        s = sources[r.doc_id]
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        target[s] = r.target
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    copies = collections.Counter(r.doc_id for r in mixed_documents(d).collect())
    assert copies == collections.Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixed_documents(docs(spark, ODD)).columns == DOCS.replace(",", "").split()[::2]
    assert mix_sources(docs(spark, [])).collect() == []


# packing


def test_tournament_tree_is_first_fit():
    r = np.random.default_rng(2)
    lengths = np.sort(r.integers(1, 101, 500))[::-1]
    bins, offsets = first_fit_decreasing(lengths, 100)
    room: list[int] = []
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        k = next((k for k, x in enumerate(room) if x >= n), len(room))
        if k == len(room):
            room.append(100)
        assert (b, o) == (k, 100 - room[k])
        room[k] -= n


def test_pieces_hold_every_id_once(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(catalog.tokenizer_path())
    t.encode_special_tokens = True
    got = collections.defaultdict(list)
    places = collections.defaultdict(list)
    for r in pack_documents(docs(spark, ODD), tokenizer=catalog.tokenizer_path(), group_pieces=5).collect():
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 9 and pack_documents(docs(spark, []), tokenizer=catalog.tokenizer_path()).collect() == []
    for i, text, _, _ in ODD:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        copies = 2 if i == 5 else 1
        assert sum(r.length for r in got[i]) == copies * len(ids)
        for r in got[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_cached_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(catalog.tokenizer_path())
    t.encode_special_tokens = True
    encode = token_bytes(catalog.tokenizer_path())
    texts = [r.text for r in table(spark, SF, "documents").collect()]
    texts += ["don't we're a 'tis", "a  b ", " x", "w.\nNext\n\nTab\tz", "1,2 3.4 a1, b..", "THE!! %%%,", "été. Ça,\nÖl ́x", "a b c 　d", "x\0y z"]
    for x in texts:
        assert encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_unknown_chunks_are_found_in_their_lookup(spark):
    from tokenizers import Tokenizer

    encode, path = token_bytes(catalog.tokenizer_path()), catalog.tokenizer_path()
    chunks = worker_cache(f"tokens:{path}")["chunks"]
    ids = np.array(Tokenizer.from_file(path).encode(" qzxvor,", add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert " qzxvor," not in chunks and chunks[" qzxvor,"] == ids == encode(" qzxvor,")


def test_caches_of_ids_are_bounded_together(spark, monkeypatch):
    encode, home = token_bytes(catalog.tokenizer_path()), worker_cache(f"tokens:{catalog.tokenizer_path()}")
    monkeypatch.setattr(tokens, "CACHED", 60)
    home["parts"].clear(), home["chunks"].clear()
    for i in range(400):
        word = "".join(chr(97 + int(d)) for d in str(i))
        assert encode(f"x {word}, y") == encode(f"x {word}, y")
        assert len(home["parts"]) + len(home["chunks"]) <= 60


def test_other_steps_free_what_a_worker_keeps():
    worker_cache("tokens:x")["chunks"] = {" a": b"1"}
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["a few words"]})
    assert sum(b.num_rows for b in language._count(2)(iter([batch]))) and worker_cache("tokens:x") == {}


# archives


def test_archives_come_back(spark, tmp_path):
    big = "<p>" + "same bytes " * 200
    rows = [(k, f"https://x/{k}", f"<html>{k} " + "text " * (k % 50)) for k in range(300)]
    rows += [(1000, "u", big), (1001, None, big), (1002, "a\nb%", big), (1003, "v", None), (None, "w", "short"), (1004, "y", "short"), (1005, "z", "é\r\n\r\nWARC/1.1\r\n" * 90)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, sha1 string")
    path = str(tmp_path / "warc")
    write_warc(pages, path, archive_bytes=20_000)
    got = {r.page_id: r for r in read_warc(spark, path).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        raw, r = (html or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(raw), hashlib.sha1(raw).hexdigest(), url)
        assert (r.record_type, r.refers_to, r.html) == (("revisit", 1002, None) if i in (1000, 1001) else ("response", None, html or ""))
    files = [p for p in (tmp_path / "warc").iterdir() if p.name.startswith("part-")]
    assert len(files) > 1
    for p in files:  # any Zstandard reader that knows the dictionary can read them
        raw = p.read_bytes()
        if raw:
            z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary_of(raw)))
            with z.stream_reader(raw, read_across_frames=True) as stream:
                import io

                assert list(read_records(io.BufferedReader(stream)))
    empty = str(tmp_path / "none")
    write_warc(pages.limit(0), empty)
    assert read_warc(spark, empty).collect() == []


def test_packing_spreads_rows_without_an_id(spark):
    rows = docs(spark, [(None, f"text {k % 7}", "en", "a") for k in range(3000)])
    got = pack_documents(rows, tokenizer=catalog.tokenizer_path(), group_pieces=100).collect()
    groups = collections.Counter(r.sequence_id >> 32 for r in got)
    assert len(got) == 3000 and len(groups) == 30 and max(groups.values()) < 160


# language


def test_held_out_languages(spark):
    d = table(spark, SF, "documents")
    model = train_models(catalog.training_rows(d))
    rows = identify(d, model).where(catalog.held_out(d)).collect()
    assert len(rows) > 30 and sum(r.lang == r._lang for r in rows) >= 0.97 * len(rows) and all(r._accepted and 0 <= r._score <= 1 for r in rows)
    odd = {r.doc_id: r for r in identify(docs(spark, [*ODD, (9, "12 ½ !", "en", "a"), (10, "qzxj vkqw zzxq jjvk " * 9, "en", "a")]), model).collect()}
    assert [odd[k]._lang for k in (1, 2, 8, 9)] == ["und"] * 4 and not odd[10]._accepted and odd[3]._lang == "en"
    assert identify(docs(spark, []), model).collect() == []
    nothing = train_models(d.where("false").select("text", "lang"))
    assert {r._lang for r in identify(docs(spark, ODD), nothing).collect()} <= {"und"}


def test_probabilities_sum_to_one(spark):
    d = spark.createDataFrame([("abab aab bb abc " * 3, "x")], "text string, lang string")
    model = train_models(d, order=3)
    # all continuations of a word beginning: the letters seen, the end, and what is left for the others
    for begin in ("", "a", "ab"):
        base = word_scores(model, [begin + c for c in "abc"] + [begin + "z"])[:, 0]
        first = np.exp(word_scores(model, [begin])[0, 0])
        assert 0 < first < 1 and base.max() < 0


def naive_kneser_ney(words_, order):
    """P(next | context) by the definition, over one language."""
    counts = collections.Counter()
    for w in words_:
        s = f" {w} "
        for i in range(1, len(s)):
            counts[s[max(0, i - order + 1) : i + 1]] += 1
    levels, upper = {}, {}
    for n in range(order, 0, -1):
        level = collections.Counter({g: c for g, c in counts.items() if len(g) == n})
        for g in upper:
            level[g[1:]] += 1
        levels[n] = upper = level
    discount = {}
    for n, level in levels.items():
        n1, n2 = (sum(c == k for c in level.values()) for k in (1, 2))
        discount[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(s, i):
        value = 1 / 1024
        for n in range(1, min(order, i + 1) + 1):
            g = s[i - n + 1 : i + 1]
            own = {x: c for x, c in levels[n].items() if x[:-1] == g[:-1]}
            if own:
                total = sum(own.values())
                value = max(0, own.get(g, 0) - discount[n]) / total + discount[n] * len(own) / total * value if g in own else discount[n] * len(own) / total * value
        return value

    return lambda w: sum(np.log(p(f" {w} ", i)) for i in range(1, len(w) + 2))


def test_scores_equal_the_definition(spark):
    r = random.Random(3)
    train = ["".join(r.choice("abcd") for _ in range(r.randint(1, 6))) for _ in range(200)]
    model = train_models(spark.createDataFrame([(" ".join(train), "x")], "text string, lang string"), order=4)
    plain = naive_kneser_ney(train, 4)
    for w in ["a", "abc", "dddd", "zq", "abzab", *train[:20]]:
        assert word_scores(model, [w])[0, 0] == pytest.approx(plain(w), rel=1e-4)


def test_rejection_of_a_rare_language_and_of_one_not_learned(spark):
    d = table(spark, SF, "documents").select("text", "lang")
    r = random.Random(8)
    rare = " ".join("".join(r.choice("αβγδεζη") for _ in range(r.randint(2, 7))) for _ in range(60))
    many = spark.range(20_000).selectExpr("concat('one two three four ', id) AS text", "'en' AS lang")
    more = spark.createDataFrame([(rare, "el"), ("hei på deg", "no")], "text string, lang string")
    model = train_models(d.unionByName(many).unionByName(more))
    assert np.isfinite(model.entropy).all() and set(model.languages) >= {"el", "no"}
    # texts of one language weigh alike however often they are copied
    again = train_models(d.unionByName(many).unionByName(more).unionByName(d.limit(1).crossJoin(spark.range(50)).drop("id")))
    assert np.allclose(model.entropy, again.entropy, atol=0.2)
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    junk = "".join(r.choice("βδζ") * 9 + "ψωφ " for _ in range(40))
    got = {x.doc_id: x for x in identify(docs(spark, [(1, rare, "el", "a"), (2, polish * 3, "pl", "a"), (3, junk, "el", "a")]), model).collect()}
    assert got[1]._accepted and not got[2]._accepted and not got[3]._accepted


def test_no_ngrams_share_a_hash(spark):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0x4E00, 0x4E00 + 2000))
    train = ["".join(r.choice(letters) for _ in range(8)) for _ in range(40_000)]
    model = train_models(spark.createDataFrame([(" ".join(train[i::20]), "x") for i in range(20)], "text string, lang string"))
    distinct = {f" {w} "[i : i + 4] for w in train for i in range(len(w) - 1)}
    assert len(model.grams[3][0]) == len(distinct)


# quality


def plain_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]

    def in_repeats(n):
        count = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return {x for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for x in range(k, k + n)}

    repeat, cover = len(in_repeats(8)), len(in_repeats(4))
    longest = next((n for n in range(len(w) - 1, 3, -1) if in_repeats(n)), 0)
    failed = len(w) < 20 or 100 * repeat > 30 * len(w)
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, failed,
        not failed and cover <= 0.5 * len(w) and longest <= 64, cover, longest,
    )


def test_quality_equals_plain_version(spark):
    r = random.Random(5)
    rows = [(i, t, None, None) for i, t, _, _ in ODD if i != 5] + [(5, "x " * 60, None, None)]
    for k in range(40):
        t = " ".join(r.choice(["a", "b\n", "cé", "#d", "中文"]) for _ in range(r.randint(0, 90)))
        rows.append((100 + k, t, None, None))
    for k in range(8):
        block = " ".join(str(r.random()) for _ in range(10 * k))
        rows.append((200 + k, f"{block}\n{block} {r.random()} {block[:50]}", None, None))
    got = {x.doc_id: x for x in quality_rules(docs(spark, rows)).collect()}
    for i, t, _, _ in rows:
        assert tuple(got[i])[1:10] == plain_quality(t), (i, t)
        assert sum(s.end - s.start for s in got[i].spans) == got[i].covered_words
    assert quality_rules(docs(spark, [])).collect() == []


# pages


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/x>Home</a><li>B &amp; C</ul></nav>
    <!-- no <p>text</p> --><div class="Main Content" id='c1'><p>One<b> two</b><br>three&nbsp;four<p>5 &lt; 6<p a="<p>">last < one</div><textarea>x</textarea><p>cut <a hre"""
    got = blocks_of(page)
    assert [b.text for b in got] == ["Home", "B & C", "One two three four", "5 < 6", "last < one", "cut"]
    assert ".content" in got[2].path and got[0].link_chars == 4 and "nav" in got[1].path and "nav" not in got[2].path
    assert blocks_of("") == [] and [b.text for b in blocks_of("<p>" * 20_000 + "deep")] == ["deep"] and [b.text for b in blocks_of("<div>" * 20_000 + "deep")] == ["deep"]


def test_deep_blocks_keep_the_names_around_them():
    deep = blocks_of('<section class="comments"><nav>' + "<div>" * 40 + "<p>reply")[0].path
    assert deep[:4] == ("section", ".comments", "nav", "div") and deep[4:] == ("div",) * 23 + ("p",)
    assert blocks_of("<nav><p>x")[0].path == ("nav", "p")


def test_gradients_equal_differences():
    make = page_maker(["aa", "bb", "cc"], 1)
    pages = [blocks_of(make()[0]) for _ in range(3)]
    x, model = Features(pages), Labeller()
    y = (np.arange(x.lengths.sum()) % 2).astype(np.float32)
    _, grad = model.gradients(x, y)
    for name in ("uf", "wb", "cf", "out", "skip", "tags", "words"):
        at = np.unravel_index(int(np.abs(grad[name]).argmax()), grad[name].shape)
        kept, e = model.p[name][at], 1e-2
        model.p[name][at] = kept + e
        up, _ = model.gradients(x, y)
        model.p[name][at] = kept - e
        down, _ = model.gradients(x, y)
        model.p[name][at] = kept
        assert (up - down) / (2 * e) == pytest.approx(grad[name][at], rel=0.05)


def test_labeller_on_pages_it_has_not_seen(spark):
    names = [f"w{k}" for k in range(300)]

    def some(n, seed):
        make, pages, labels = page_maker(names, seed), [], []
        for _ in range(n):
            markup, truth = make()
            assert len(blocks_of(markup)) == len(truth)
            pages.append(blocks_of(markup))
            labels.append(np.array(truth))
        return pages, labels

    model = Labeller()
    model.fit(*some(250, 1), epochs=10)
    pages, labels = some(60, 2)
    assert ((model.scores(Features(pages)) > 0) == np.concatenate(labels)).mean() > 0.97
    rows = [(1, "u", None, 5), (2, None, "", 5), (3, "u", "<nav><a href='/'>w1</a></nav>", 5), (3, "u", "<nav><a href='/'>w1</a></nav>", 5)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got if r.url) == [(1, "u", "", 0), (3, "u", "", 0), (3, "u", "", 0)]
