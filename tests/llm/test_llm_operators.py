"""Each training-data operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontamination, kneser_ney, ngram_join, packing, quality, queries, sharding, token_counts, token_store, toxicity, warc
from siltstone.llm.common import normalised, word_hashes
from siltstone.llm.tokens import VOCABULARY, encoder

ODD = [
    (1, "One two three four five six seven eight nine ten.\nEleven"), (2, None), (3, ""), (4, " \n\t"), (5, "héllo wörld ñandú 漢字 \U0001f600 ok\r\n\nlast"), (None, "no id here at all"),
    (1, "One two three four five six seven eight nine ten.\nEleven"), (7, "word " * 60_000), (8, "!!!"), (9, "é"),
]


def docs_of(spark, rows):
    """Documents with columns that clash with names used inside."""
    df = spark.createDataFrame([(i, t, "x", 0, "y", 1) for i, t in rows], "doc_id long, text string, node string, bucket int, class string, size int")
    return df


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- 1: token counts


def brute_sections(text, rule):
    own, length = encoder(VOCABULARY)
    data = text.encode()
    ends = [k + 1 for k, b in enumerate(data) if b == 10]
    if data and (not ends or ends[-1] < len(data)):
        ends.append(len(data))
    counts, crossing = [0] * len(ends), [0] * len(ends)
    at = 0
    for token in own.encode_ordinary(text):
        n = int(length[token])
        owner = [next(k for k, e in enumerate(ends) if p < e) for p in range(at, at + n)]
        most = max(Counter(owner).values())
        pick = {"start": owner[0], "end": owner[-1], "majority": min(k for k, c in Counter(owner).items() if c == most)}[rule]
        counts[pick] += 1
        crossing[pick] += len(set(owner)) > 1
        at += n
    return list(zip(counts, crossing))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(spark, rule):
    texts = ["a\n\n\nb  \n c", "x", "\n", "naïve\ncafé \n\n\n\n   tail", "tab\t\n\tend\n"]
    got = defaultdict(list)
    for r in token_counts.section_tokens(docs_of(spark, list(enumerate(texts))), rule).orderBy("doc_id", "section").collect():
        got[r.doc_id].append((r.n_tokens, r.n_crossing))
        assert texts[r.doc_id][r.char_start : r.char_end].count("\n") <= 1
    assert [got[k] for k in range(len(texts))] == [brute_sections(t, rule) for t in texts]


def test_sections_odd(odd, none):
    got = token_counts.section_tokens(odd).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    own, _ = encoder(VOCABULARY)
    expected = Counter()
    for i, t in ODD:
        expected[i] += len(own.encode_ordinary(t or ""))
    assert {r.doc_id: r.n for r in got} == {i: n for i, n in expected.items() if n}
    assert token_counts.section_tokens(none).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(odd, "no such")


def test_fields(spark):
    df = spark.createDataFrame([(1, "title", "body text\nmore"), (2, None, "x")], "doc_id long, a string, b string")
    got = [(r.doc_id, r.section, r.n_tokens) for r in token_counts.field_tokens(df, ["a", "b"]).orderBy("doc_id", "section").collect()]
    own, _ = encoder(VOCABULARY)
    assert sum(n for d, _, n in got if d == 1) == len(own.encode_ordinary("title\nbody text\nmore\n"))
    assert [(d, s) for d, s, _ in got] == [(1, 0), (1, 1), (2, 0), (2, 1)]


# --- 2: sharding


def test_sharding(spark, odd, none):
    got = sharding.shard(odd, 4, 2, 64)
    assert got.count() == len(ODD) and got.where("shard < 0 OR shard >= 6").count() == 0
    assert got.where("doc_id IS NULL").first().slot == 0
    assert sharding.shard(none, 4, 2, 64).count() == 0


def test_rebalancing_moves_slots_to_new_shards_only(spark):
    loads = spark.createDataFrame([(k, 1, 100 + k) for k in range(64)], "slot int, docs long, bytes long")
    first = sharding.initial_map(loads, 4).cache()
    last = sharding.rebalanced(first, loads, 4, 2)
    old, new = ({r.slot: r.shard for r in sharding.current(m).collect()} for m in (first, last))
    assert all(old[s] == new[s] or new[s] >= 4 for s in old)
    assert {r.slot: r.shard for r in sharding.current(last, 1).collect()} == old
    load = Counter()
    for s, shard in new.items():
        load[shard] += 100 + s
    assert set(load) == set(range(6)) and max(load.values()) < 1.5 * sum(load.values()) / 6


def test_map_is_kept_and_edited_at_its_path(spark, odd, none, tmp_path):
    path = "file://" + str(tmp_path / "map")
    with pytest.raises(FileNotFoundError):
        sharding.read_map(spark, path)
    got = {(r.doc_id, r.shard) for r in sharding.shard(odd, 4, 2, 64, map_path=path).collect()}
    kept = sharding.read_map(spark, path)
    assert {(r.doc_id, r.shard) for r in sharding.assignments(odd, kept, 64).collect()} == got
    two = {(r.version, r.slot, r.shard) for r in kept.collect()}
    loads = spark.createDataFrame([(k, 1, 5 * k) for k in range(64)], "slot int, docs long, bytes long")
    with pytest.raises(FileExistsError):
        sharding.create_map(loads, path, 4)
    with pytest.raises(ValueError):
        sharding.grow_map(loads, path, 0)
    (tmp_path / "map" / "v=3").mkdir()  # a run that was lost half-way
    three = {(r.version, r.slot, r.shard) for r in sharding.grow_map(loads, path, 3).collect()}
    assert two < three and all(v == 3 and 6 <= shard < 9 for v, _, shard in three - two)


# --- 3: Kneser-Ney


def brute_kneser_ney(texts):
    big, follow = Counter(), defaultdict(Counter)
    for t in texts:
        ws = ["<s>", *t.lower().split(), "</s>"]
        if len(ws) > 2:
            for a, b in zip(ws, ws[1:]):
                big[a, b] += 1
                follow[a][b] += 1
    before = Counter(b for _, b in big)
    of = lambda counts: kneser_ney.discounts(*(sum(c == k for c in counts) for k in (1, 2, 3, 4)))
    d2, d1 = of(list(big.values())), of(list(before.values()))
    cut = lambda d, c: d[min(c, 3) - 1] if c else 0.0
    total = sum(before.values())
    spare = sum(cut(d1, c) for c in before.values()) / total

    def p1(w):
        return max(before[w] - cut(d1, before[w]), 0) / total + spare / (len(before) + 1)

    def p2(a, b):
        n = sum(follow[a].values())
        if not n:
            return p1(b)
        return (max(follow[a][b] - cut(d2, follow[a][b]), 0) + sum(cut(d2, c) for c in follow[a].values()) * p1(b)) / n

    return p1, p2, before


def test_kneser_ney(spark):
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randrange(1, 40), 60)) for _ in range(80)]
    model = kneser_ney.train(docs_of(spark, list(enumerate(texts))))
    p1, p2, before = brute_kneser_ney(texts)
    other = [" ".join(words(rng, 15, 90)) for _ in range(10)]
    got = {r.doc_id: r for r in kneser_ney.score(docs_of(spark, list(enumerate(texts + other))), model).collect()}
    for k, t in enumerate(texts + other):
        ws = ["<s>", *t.split(), "</s>"]
        expected = sum(math.log(p2(a, b)) for a, b in zip(ws, ws[1:]))
        assert got[k].n_tokens == len(ws) - 1
        assert got[k].log_prob == pytest.approx(expected, rel=1e-9)
        assert got[k].perplexity == pytest.approx(math.exp(-expected / (len(ws) - 1)), rel=1e-9)
    # probabilities of all known words and of one unseen word add up to one
    assert sum(p2("w1", w) for w in [*before, "unseen"]) == pytest.approx(1)


def test_kneser_ney_odd(odd, none):
    got = kneser_ney.perplexity(odd).collect()
    assert len(got) == len(ODD)
    assert [r.perplexity for r in got if r.doc_id in (2, 3, 4, 8)] == [None] * 4
    assert all(math.isfinite(r.perplexity) for r in got if r.n_tokens)
    assert kneser_ney.perplexity(none).count() == 0
    assert kneser_ney.score(odd, kneser_ney.train(none)).where("n_tokens > 0 AND perplexity IS NULL").count() == 0


# --- 4: WARC


def test_warc_records_link_to_their_response(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/", '<html><head><title>T &amp; x</title><script>var a="</p>"</script></head><body><p>one</p>two<a href="/x?a&amp;b">l</a></body></html>', "z"), (2, None, None, "z"), (3, "u", "", "z"), (1, "http://a/", "<p>other", "z")],
        "page_id long, url string, html string, block string",
    )
    rows = warc.derivatives(pages).collect()
    assert len(rows) == 8
    for a, b in zip(rows[::2], rows[1::2]):
        assert a.refers_to == b.refers_to and a.record_id != b.record_id and {a.record_type, b.record_type} == {"metadata", "conversion"}
    text = next(r.block for r in rows if r.page_id == 1 and r.record_type == "conversion")
    assert text == "T & x\none\ntwol"
    assert "outlink: /x?a&b" in next(r.block for r in rows if r.page_id == 1 and r.record_type == "metadata")
    files = warc.write_warc(warc.derivatives(pages), "file://" + str(tmp_path / "w"))
    assert files
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(r.record_id for r in back) == sorted(r.record_id for r in rows)
    assert {(r.record_id, bytes(r.block).decode()) for r in back} == {(r.record_id, r.block) for r in rows}
    assert warc.derivatives(pages.limit(0)).count() == 0


def test_warc_records_refer_to_the_responses_of_an_archive(spark, tmp_path):
    def record(kind, key, url, block):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{key}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2023-0{key}-01T00:00:00Z\r\n"
        return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: b\r\n\r\n<p>caf\xe9</p>\r\n\r\n" + b"<p>long</p>" * 30_000
    data = record("request", 1, "http://a/", b"GET / HTTP/1.1\r\n\r\n") + record("response", 2, "http://a/", page) + record("response", 3, "http://a/", page) + record("response", 4, "http://\udce9/".encode(errors="surrogateescape").decode("latin-1"), b"bare") + record("response", 5, "u", b"")
    (tmp_path / "x.warc").write_bytes(data)
    made = warc.responses(warc.read_warc(spark, str(tmp_path))).withColumn("digest", F.lit("clash")).withColumn("warc_date", F.lit("clash"))
    rows = warc.derivatives(made, headers_col="headers", record_id_col="record_id", date_col="date").collect()
    assert Counter(r.refers_to for r in rows) == {f"<urn:uuid:{k}>": 2 for k in (2, 3, 4, 5)}
    assert all(r.warc_date == f"2023-0{r.refers_to[10]}-01T00:00:00Z" for r in rows)
    assert len({r.record_id for r in rows}) == 8
    first = next(r for r in rows if r.record_type == "conversion" and r.refers_to == "<urn:uuid:2>")
    assert first.source_headers == "Content-Type: text/html\r\nX-A: b" and first.block.split("\n")[0] == "caf\ufffd" and first.block.count("long") == 30_000
    assert next(r.block for r in rows if r.record_type == "conversion" and r.refers_to == "<urn:uuid:4>") == "bare"


# --- 5: n-gram Jaccard join


def shingles(text, n=3):
    ws = normalised(pa.array([text or ""])).to_pylist()[0].split()
    return {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()


def brute_pairs(rows, threshold):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        union = len(sets[a] | sets[b])
        if union and len(sets[a] & sets[b]) >= threshold * union:
            out[a, b] = round(len(sets[a] & sets[b]) / union, 6)
    return out


def copies(rng, sizes, rate):
    """Texts in groups: an original of each size, exact copies and copies with changed words."""
    rows = []
    for size in sizes:
        own = words(rng, size, 5000)
        for k in range(rng.randrange(2, 7)):
            changed = [w if rng.random() > rate * k / 3 else f"x{rng.randrange(10**6)}" for w in own]
            rows.append(" ".join(changed))
    passage = words(rng, 60, 5000)
    rows += [" ".join([*words(rng, 50, 5000), *passage, *words(rng, 50, 5000)]) for _ in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute_classes(rows, threshold):
    """(doc_id, class_id, n_links) of every row, by its place."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        union = len(sets[a] | sets[b])
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * union:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    least = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return Counter((i, least[find(k)] if links[k] else i, links[k]) for k, (i, _) in enumerate(rows))


def got_classes(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in df.collect())


@pytest.mark.parametrize(("threshold", "block"), [(0.55, ngram_join.BLOCK), (0.55, 3), (0.8, ngram_join.BLOCK)])
def test_jaccard_join_against_all_pairs(spark, threshold, block):
    rng = random.Random(5)
    rows = copies(rng, [2, 3, 5, 9, 15, 16, 17, 31, 33, 60, 64, 100, 127, 129, 200, 250, 400, 520, 900, 1500, 3000] * 2, 0.06)
    rows += [(900 + k, rows[0][1]) for k in range(5)] + [rows[1], (None, rows[2][1]), (None, "of its own"), (None, "of its own"), (990, None), (991, "?")]
    assert got_classes(ngram_join.jaccard_join(docs_of(spark, rows), threshold, block=block)) == brute_classes(rows, threshold)


def test_jaccard_join_odd(odd, none):
    assert got_classes(ngram_join.jaccard_join(odd)) == brute_classes(ODD, ngram_join.THRESHOLD)
    assert ngram_join.jaccard_join(none).count() == 0


def test_jaccard_join_of_one_id_with_several_texts(spark):
    t = " ".join(words(random.Random(1), 40))
    rows = [(1, t), (1, "quite another text"), (2, t + " more"), (3, "quite another text")]
    assert got_classes(ngram_join.jaccard_join(docs_of(spark, rows))) == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)])


def test_many_exact_copies(spark):
    t = " ".join(words(random.Random(2), 30))
    assert got_classes(ngram_join.jaccard_join(docs_of(spark, [(k, t) for k in range(60)]))) == Counter((k, 0, 59) for k in range(60))


def test_many_texts_that_share_a_passage(spark):
    rng = random.Random(12)
    passage = words(rng, 60, 5000)
    rows = [(k, " ".join([*words(rng, 50, 5000), *passage, *words(rng, 50, 5000)])) for k in range(5000)]
    # only a passage of this length is not enough to be similar; these few are
    rows += [(6000 + k, rows[k][1] + " and more") for k in range(20)]
    got = {r.doc_id: r for r in ngram_join.jaccard_join(docs_of(spark, rows)).collect()}
    assert len(got) == 5020
    assert {i for i, r in got.items() if r.n_links} == set(range(20)) | set(range(6000, 6020))
    assert all(got[6000 + k].class_id == k and got[k].n_links == 1 for k in range(20))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(1000, 1001 + k) for k in range(50)] + [(2000, 2000)]
    df = spark.createDataFrame(edges, "a long, b long")
    for local in (1 << 20, 0):
        got = {r.node: r.root for r in ngram_join.connected(df, local_edges=local).collect()}
        assert got == {**{k: 0 for k in range(1, 31)}, **{1001 + k: 1000 for k in range(50)}}
    with pytest.raises(RuntimeError):
        ngram_join.connected(df, 1, 0)


def test_deduplicate_judges_rows(spark):
    t, u = (" ".join(words(random.Random(k), 40)) for k in (1, 2))
    rows = [(1, t), (1, t), (2, t), (None, t), (1, u), (3, u), (None, "alone"), (None, "alone"), (5, None), (5, None), (6, ""), (7, "?")]
    got = Counter((r.doc_id, r.text) for r in ngram_join.deduplicate(docs_of(spark, rows)).collect())
    assert got == Counter([(1, t), (1, u), (None, "alone"), (5, None), (5, None), (6, ""), (7, "?")])


def test_deduplicate_keeps_the_least_of_each_component(spark, odd, none):
    rng = random.Random(7)
    rows = copies(rng, [20, 50, 120, 300, 700], 0.06)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs(rows, ngram_join.THRESHOLD):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = docs_of(spark, rows)
    kept = ngram_join.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in root if find(i) == i)
    # the repeated row goes
    assert ngram_join.deduplicate(odd).count() == len(ODD) - 1
    assert ngram_join.deduplicate(none).count() == 0


def test_parity_maps_never_exceed_the_difference():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 62, 500).astype(np.uint64)
    sets = [np.unique(base[: 500 - 20 * k]) for k in range(8)]
    gram = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    maps = ngram_join.parity_maps(gram, first)
    size = np.diff(first)
    order = np.argsort(size, kind="stable")
    near = ngram_join._near(size[order], [maps[k] for k in order], 0, len(sets), 0.5)
    assert near.all()


# --- 6: toxicity


def test_restores_obfuscated_words(spark):
    rng = random.Random(1)
    texts = ["the rotten villain stole a golden crown and the people were angry"] * 20 + [" ".join(words(rng, 30)) for _ in range(5)]
    counts = toxicity.character_counts(docs_of(spark, list(enumerate(texts))))
    restore = toxicity.Restorer(toxicity.log_model(counts, ["villain", "rotten"]))
    for seen, clean in [("v1ll41n", "villain"), ("r0tt3n", "rotten"), ("v i l l a i n", "villain"), ("r.o.t.t.e.n", "rotten"), ("viiiillaaaain", "villain"), ("vi||ain", "villain"), ("r0tt€n", None)]:
        got, changed = restore(f"the {seen} stole it")
        if clean:
            assert got == f"the {clean} stole it" and changed == 1
    for plain in ("in 2024 we paid 100 dollars", "a 3.5 mm jack", "hello!!! what?", "see you at 10 am"):
        assert restore(plain) == (plain, 0)


def test_restores_long_stretches(spark):
    texts = ["you are a rotten villain and the people who stole a golden crown were angry"] * 20
    counts = toxicity.character_counts(docs_of(spark, list(enumerate(texts))))
    restore = toxicity.Restorer(toxicity.log_model(counts, ["villain", "rotten"]))
    phrase = "youarearottenvillainandthepeoplewhostoleagoldencrownwereangry"
    for seen in (" ".join(phrase), ".".join(phrase), "  ".join(phrase * 20), "v1ll41n" * 40, "v" + "i" * 5000 + "llain", " ".join("r0tt3n" * 200)):
        got, changed = restore(f"the {seen}")
        assert changed == 1
        assert got.removeprefix("the ").replace(" ", "") == re.sub("i+", "i", re.sub("[ .]", "", seen).translate(str.maketrans("0134", "oiea")))
    apart = toxicity.Restorer(restore.model, words=["villain", "rotten"])
    for sep in (" ", ".", "  "):
        got, _ = apart("the " + sep.join(phrase))
        assert {"rotten", "villain"} <= set(got.split())
        got, _ = apart("the " + sep.join("v1llain"))
        assert got == "the villain"


def test_restores_pieces_and_doubles(spark):
    texts = ["you are a rotten villain and the people who stole a golden crown were well-known and angry"] * 20
    counts = toxicity.character_counts(docs_of(spark, list(enumerate(texts))))
    restore = toxicity.Restorer(toxicity.log_model(counts, ["villain", "rotten", "moron"]))
    for seen, clean in [("mmoorroonn", "moron"), ("mmoron", "moron"), ("mo-ron", "moron"), ("vil.lain", "villain"), ("v-i.l l_a i*n", "villain"), ("m   o   r   o   n", "moron"), ("r0770n", None), ("m0000ron", "moron"), ("m. .o. .r. .o. .n", "moron")]:
        got, changed = restore(f"the {seen} stole it")
        if clean:
            assert got == f"the {clean} stole it" and changed == 1, seen
    for plain in ("a well-known golden crown", "the people were angry and the villain"):
        assert restore(plain)[0] == plain, plain


def test_triggers_miss_no_reading(spark):
    """What is not decoded could not have changed: every token against a decoder that tries every stretch."""
    rng = random.Random(11)
    texts = ["the rotten villain stole a golden crown"] * 20
    model = toxicity.log_model(toxicity.character_counts(docs_of(spark, list(enumerate(texts)))), ["villain", "rotten"])
    restore = toxicity.Restorer(model)
    alphabet = "aabbeeillnnorttv0134@!|+. -_*~éп"
    for _ in range(3000):
        token = "".join(rng.choice(alphabet.replace(" ", "")) for _ in range(rng.randrange(1, 9)))
        text = f"zq {token} zq"
        whole = toxicity._RUN.sub(restore._run, token)
        spelled = toxicity.SPELLED.search(token)
        if not spelled:
            assert restore(text)[0] == f"zq {whole} zq", token


def test_prefilter_changes_no_score(spark):
    rng = random.Random(12)
    lexicon = {"villain$": 5.0, "vil": 4.0, "rotten$": 5.0, "moo": 4.0, "llama$": 3.5}
    own = toxicity.Classifier(lexicon, [1.0] * 4, 0.0, 1.0)
    model = toxicity.log_model(np.ones((32, 32, 32)), ["villain", "rotten", "moo", "llama"])
    pieces = ["villain", "vviillain", "vil-lain", "rot.ten", "rrotten", "mmooo", "llama", "well-known", "hello", "a.b", "xx-vil_lain", "x", "1", "moon", "v", "i", "book-keeper"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    part = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    heads = np.zeros(1 << 24, bool)
    heads[[toxicity._first_three(f.removesuffix("$").encode()) for f in lexicon]] = True
    got = toxicity._judged(part, toxicity.Restorer(model), own, heads, toxicity.squeezed_heads(lexicon)).column("n_hits").to_pylist()
    restore = toxicity.Restorer(model)
    assert got == [sum(own.counts(restore(t)[0])[1]) for t in texts]
    assert sum(got) > 300


def test_labels_of_other_values(spark):
    rows, labels = toxic_corpus(random.Random(6), 120)
    odd = [(i, t if i % 5 else (2, -1, None)[i % 3]) for i, t in labels] + [(1, 1 - labels[1][1]), (None, 1)]
    df = spark.createDataFrame(odd, "id long, bad int")
    got = toxicity.fit(docs_of(spark, rows), df, label_id_col="id", label_col="bad")
    assert got.lexicon


def brute_best(lattice, model):
    def score(path):
        codes = [0, 0, *(toxicity._code(c) for c, _ in path if c), 0]
        return sum(w for _, w in path) + sum(model[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    return max(score(p) for p in itertools.product(*lattice)), score


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(32), (32, 32)))
    for seen in ("v1|l", "aaab4", "h00k", "m.0.r", "ssss0", "1|1", "aabb"):
        lattice = toxicity.readings(seen)
        best, score = brute_best(lattice, model)
        got = toxicity.viterbi(lattice, model)
        assert any("".join(c for c, _ in p) == got and abs(score(p) - best) < 1e-9 for p in itertools.product(*lattice))
    # of equally good paths, the first in order
    assert toxicity.viterbi([[("b", 0.0), ("a", 0.0)]] * 50, np.zeros((32, 32, 32))) == "a" * 50
    assert toxicity.viterbi([[("a", 0.0)], [("b", 0.0), ("", 0.0)]] * 50, np.zeros((32, 32, 32))) == "a" * 50


def toxic_corpus(rng, n):
    bad = ["gorblat", "snivelor", "krudge", "vilmox"]
    disguise = {"o": "0", "i": "1", "e": "3", "a": "4"}
    rows, labels = [], []
    for k in range(n):
        toxic = k < n // 4
        ws = [f"{rng.choice(['ba', 'lo', 'mi', 'te', 'sun'])}{rng.choice(['ren', 'dal', 'tor', 'ning'])}" for _ in range(60)]
        if toxic:
            for _ in range(8):
                w = rng.choice(bad)
                style = rng.randrange(4)
                ws.insert(rng.randrange(len(ws)), w if style == 0 else "".join(disguise.get(c, c) for c in w) if style == 1 else " ".join(w) if style == 2 else w.replace("r", "rrrr"))
        rows.append((k, " ".join(ws)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(4)
    rows, labels = toxic_corpus(rng, 400)
    known = spark.createDataFrame([x for x in labels if rng.random() < 0.6], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs_of(spark, rows), known).collect()}
    assert len(got) == 400
    right = sum(got[i].toxic == bool(t) for i, t in labels)
    assert right >= 390
    kept = toxicity.reject_toxic(docs_of(spark, rows), known)
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].toxic}


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 9), (5, None, 9), (None, 1, 9)], "doc_id long, toxic int, text int")
    assert toxicity.toxicity(odd, labels).where("NOT toxic").count() == len(ODD)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.reject_toxic(odd, labels.limit(0)).count() == len(ODD)


# --- 7: token ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store_round_trip(spark, odd, tmp_path, encoding):
    path = str(tmp_path / "t")
    token_store.write_tokens(token_store.token_ids(odd), path, encoding)
    own, _ = encoder(VOCABULARY)
    got = Counter((r.doc_id, own.decode(r.token_ids)) for r in token_store.read_tokens(spark, path).collect())
    assert got == Counter((i, t or "") for i, t in ODD)
    one = token_store.read_tokens(spark, path, [5], ["doc_id", "n_tokens"])
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(doc_id, [5])" in plan or "EqualTo(doc_id,5)" in plan
    assert "token_ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert [(r.doc_id, r.n_tokens) for r in one.collect()] == [(5, len(own.encode_ordinary(ODD[4][1])))]


def test_token_store_has_page_indexes(spark, odd, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    token_store.write_tokens(token_store.token_ids(odd), path, "delta")
    meta = pq.ParquetFile(glob.glob(path + "/*.parquet")[0]).metadata.row_group(0)
    columns = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    assert any("DELTA_BINARY_PACKED" in c.encodings for n, c in columns.items() if "element" in n)
    with pytest.raises(ValueError):
        token_store.write_tokens(token_store.token_ids(odd), path, "no such")


def test_tokenized_empty(none):
    assert token_store.tokenized(none).count() == 0


# --- 8: packing


def check_packing(rows, got, capacity, step):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length))
    lengths = defaultdict(int)
    for i, t in rows:
        lengths[i] += len((t or "").split())
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: n for i, n in lengths.items() if n}
    fill = defaultdict(int)
    places = set()
    for r in got:
        fill[r.sequence] += math.ceil(r.length / step) * step
        assert (r.sequence, r.slot) not in places
        places.add((r.sequence, r.slot))
    assert max(fill.values()) <= capacity
    assert set(fill) == set(range(len(fill)))
    return len(fill)


def test_packing_is_near_the_bound(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.choice([3, 10, 40, 55, 70, 90, 130, rng.randrange(1, 300)])) for k in range(600)]
    got = packing.pack(docs_of(spark, rows), 128, 4, packing.word_count(F.col("text"))).collect()
    n = check_packing(rows, got, 128, 4)
    # no packing needs fewer sequences than the linear program; rounding adds at most one for each class
    demand = Counter(math.ceil(r.length / 4) for r in got)
    size = np.array(sorted(demand))
    _, x = packing.column_generation(size, np.array([float(demand[s]) for s in size.tolist()]), 32)
    assert x.sum() - 1e-6 <= n <= x.sum() + len(size)


def test_packing_odd(spark, odd, none):
    got = packing.pack(odd, 256, 16, packing.word_count(F.col("text"))).collect()
    check_packing(ODD, got, 256, 16)
    own, _ = encoder(VOCABULARY)
    tokens = Counter()
    for i, t in ODD:
        tokens[i] += len(own.encode_ordinary(t or ""))
    packed = Counter()
    for r in packing.pack(odd, 256, 16).collect():
        packed[r.doc_id] += r.length
    assert packed == +tokens
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, 100, 16)


def test_packing_query_counts_tokens(spark, tmp_path):
    own, _ = encoder(VOCABULARY)
    rows = [*ODD, (20, "漢字" * 4_000), (21, "QmFzZTY0" * 3_000), (22, "don't pack words, 3.14 of them")]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    expected, fill, got = Counter(), Counter(), Counter()
    for i, t in rows:
        expected[i] += len(own.encode_ordinary(t or ""))
    for r in queries.op8_packing(spark, str(tmp_path)).collect():
        fill[r.sequence] += math.ceil(r.length / 16) * 16
        got[r.doc_id] += r.length
    assert got == +expected
    assert max(fill.values()) <= 2048


def test_column_generation_against_the_linear_program():
    size, demand = np.array([3, 5, 7]), np.array([30.0, 20.0, 11.0])
    patterns, x = packing.column_generation(size, demand, 16)
    assert ((patterns * size).sum(axis=1) <= 16).all()
    assert np.allclose(patterns.T @ x, demand)
    # all patterns tried: none is worth more than the optimum's prices allow
    best = x.sum()
    every = [p for p in itertools.product(range(6), range(4), range(3)) if np.dot(p, size) <= 16]
    basis = patterns.T.astype(float)
    prices = np.linalg.inv(basis).sum(axis=0)
    assert max(np.dot(p, prices) for p in every) <= 1 + 1e-6
    assert best == pytest.approx(float(prices @ demand))
    with pytest.raises(RuntimeError):
        packing.column_generation(size, demand, 16, rounds=1)


# --- 9: quality rules


def test_quality_drops_junk_and_keeps_clean(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(words(rng, 80)), ("en", None)[k % 2], "s" if k % 3 else None, 0) for k in range(300)]
    rows += [(1000, "$# " * 200, "en", "s", 0), (1001, "same " * 300, "en", "s", 0), (1002, None, "en", "s", 0), (1003, "", None, None, 0)]
    # a short text may have a few, not as many as its words; a very long one is judged whole
    rows += [(1004, "Yes! Yes! Go", "en", "new source", 0), (1005, "no " * 12, "en", "s", 0), (1006, " ".join(words(rng, 100_000)), "en", "s", 0), (1007, " ".join(words(rng, 50_000)) + " x" * 100_000, "en", "s", 0)]
    rows += [(None, "# " * 100, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, chars int")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if not r.keep} == {1000, 1001, 1005, 1007, None}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 5
    assert quality.quality(df.limit(0)).count() == 0


def test_counts_at_the_bound(spark):
    bound = 7 / 3 + math.sqrt(49 / 9)
    df = spark.range(12).select(quality.within(F.col("id"), F.lit(0), F.lit(500), 7.0).alias("ok"), "id")
    assert all(r.ok == (r.id <= bound) for r in df.collect())


def test_few_documents_lean_on_the_rest(spark):
    # one source has high rates and many documents, another has the same rates and only a few
    rows = [("en", "large", 1000 + k % 7) for k in range(5000)] + [("en", "small", 1000)] * 3 + [("en", "plain", k % 7) for k in range(5000)] + [("fr", None, 3)]
    counted = spark.createDataFrame(rows, "q_lang string, q_source string, q_symbol long").selectExpr("*", "q_symbol AS q_upper", "q_symbol AS q_repeat", "10000L AS q_chars", "10000L AS q_words")
    fence = {(r.q_lang, r.q_source): r.symbol_fence for r in quality.thresholds(counted, 1.0, 1).collect()}
    assert fence["en", "large"] < 1100 and fence["en", "plain"] < 20
    # its quartiles are those of the language, nearly: one half low, one half high
    assert fence["en", "small"] > 1500 and len(fence) == 4


def test_sketches_merge(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(10_000)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x long").selectExpr("g", "x AS symbol_rate", "x AS upper_rate", "x AS repeat_rate")
    own = quality.sketches(df, ["g"]).groupBy("rule", "cell").agg(F.sum("n").alias("n"))
    whole = quality.sketches(df, []).select("rule", "cell", "n")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, whole.collect()))
    f = quality.fences(whole, [], 0.0, 0).where("rule = 'symbol'").first()
    exact = sorted(x for _, x in rows)[int(0.75 * 500) - 1]
    assert exact * 31 / 32 - 1 <= f.fence <= exact


# --- 10: decontamination


def brute_hits(rows, items, window):
    text = lambda t: normalised(pa.array([t or ""])).to_pylist()[0].split()
    tests = defaultdict(set)
    for i, t in items:
        ws = text(t)
        if i is not None and ws:
            for k in range(max(1, len(ws) - window + 1)):
                tests[i].add(" " + " ".join(ws[k : k + window]) + " ")
    out = Counter()
    for d, t in rows:
        own = " " + " ".join(text(t)) + " "
        for i, strings in tests.items():
            n = sum(s in own for s in strings)
            if n:
                out[d, i, n] += 1
    return out


@pytest.mark.parametrize("table_bytes", [64 << 20, 300])
def test_decontamination(spark, table_bytes):
    rng = random.Random(10)
    items = [(k, " ".join(words(rng, n, 40))) for k, n in enumerate([1, 2, 3, 8, 9, 20, 30])] + [(None, "a b"), (90, None), (91, "?!"), (3, "another text of item three for the same id")]
    rows = []
    for k in range(60):
        ws = words(rng, rng.randrange(0, 80), 40)
        if k % 3 == 0:
            passage = (items[rng.randrange(7)][1]).split()
            ws[5:5] = [w.upper() + "," for w in passage]
        rows.append((k, " ".join(ws)))
    rows += [(100, None), (101, ""), (None, items[5][1]), (None, items[5][1]), (0, "w1 w2"), rows[0], rows[0], (102, "x " * 200_000 + items[5][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = Counter((r.doc_id, r.item_id, r.n_windows) for r in decontamination.benchmark_hits(docs_of(spark, rows), bench, 5, table_bytes=table_bytes).collect())
    assert got == brute_hits(rows, items, 5)
    df = docs_of(spark, rows)
    kept = decontamination.decontaminate(df, bench, 5, table_bytes=table_bytes)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((d, t) for d, t in rows if not brute_hits([(d, t)], items, 5))
    long = [i for i in items if len((i[1] or "").split()) > 1]
    longer = decontamination.benchmark_hits(df, bench, 5, table_bytes=table_bytes, least_words=2).collect()
    assert Counter((r.doc_id, r.item_id, r.n_windows) for r in longer) == brute_hits(rows, long, 5)


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    assert [(r.doc_id, r.n_windows) for r in decontamination.benchmark_hits(odd, bench).collect()] == [(1, 2), (1, 2)]
    assert decontamination.benchmark_hits(none, bench).count() == 0
    assert decontamination.decontaminate(odd, bench.limit(0)).count() == len(ODD)
    with pytest.raises(ValueError):
        decontamination.benchmark_hits(odd, bench, benchmark_bytes=10)


def test_word_hashes_tell_words_apart():
    h, first = word_hashes(normalised(pa.array(["A b  a", None, "b", ""])))
    assert first.tolist() == [0, 3, 3, 4, 4]
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
