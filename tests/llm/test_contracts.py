"""The registered queries against brute force: the smallest tables, and made-up texts with hard cases."""

from __future__ import annotations

import hashlib
import json
import random
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronoframe.llm import decontaminate, jaccard, lines, packing, quality, queries, repeats, sharding, token_files, tokens, urls, wordpiece

from . import brute

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, n bigint, `_text` string, at int"


def made_up(seed=7, n=60):
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, white and very long texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "of", "on", "éa", "ti", "xq", "zu"]) for _ in range(r.randrange(1, 5)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "  \n\t ", "a", "a b c d", "a b c d", "A B C D e", "one two three four", "x" * 3000, "Is it's <|endoftext|> 3.14   z", "\n".join([passage] * 3)]
    while len(texts) < n:
        t = " ".join(word() + r.choice(["", "", ",", ".", "\n"]) for _ in range(r.choice([3, 12, 40, 120, 400])))
        texts.append(t)
        for _ in range(r.choice([0, 0, 1, 3])):
            w = t.split(" ")
            for _ in range(max(1, len(w) // r.choice([10, 40, 200]))):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
        if r.random() < 0.3:
            texts += [t, t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]]
    texts.append(" ".join(word() for _ in range(30_000)))
    return list(enumerate(texts))


def frame(spark, docs):
    return spark.createDataFrame([(d, t, None if d % 7 == 0 else "en", f"s{d % 3}" if d % 5 else None, None, "clash", 1, "x", 2) for d, t in docs], SCHEMA)


@pytest.fixture(scope="module", params=["made up", "smallest table", "empty"])
def docs(request, spark):
    if request.param == "smallest table":
        return sorted((r.doc_id, r.text) for r in queries.documents(spark, SF).select("doc_id", "text").collect())
    return made_up() if request.param == "made up" else []


def test_packing(spark, docs):
    got = packing.pack(frame(spark, docs), WORD).collect()
    own = Tokenizer.from_file(WORD)
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == {d for d, _ in docs}
    for d, t in docs:
        ids, at = brute.encoded(own, t, 1), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids) // 4, brute.crc(ids[4 * at : 4 * (at + r.length)]))
            at += r.length
        assert at == len(ids) // 4
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    if docs:
        total = sum(r.length for r in got)
        assert len(sequences) * 2048 <= total * 1.1 + 2048


def test_quality_counts(spark, docs):
    got = {r.doc_id: r for r in quality.quality(frame(spark, docs)).collect()}
    assert set(got) == {d for d, _ in docs}
    for d, t in docs:
        c, r = brute.counts(t), got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r.base_failed and r.kept)


def plain_limits(rows):
    """{(lang, source): {rate: limit}} from rows with counts, as quality.limits says."""

    def bucket(x):
        s = max(0, x.bit_length() - 6)
        return x >> s << s

    def fence(name, same):
        count, against, units, high, spread = quality.RATES[name]
        values = sorted(bucket(units * r[count] // max(r[against], 1)) for r in rows if not r.base_failed and same(r))
        q = lambda p: next(x for i, x in enumerate(values) if i + 1 >= p * len(values))
        return len(values), q(high) + spread * (q(high) - q(quality.MIDDLE))

    out = {}
    for lang, source in {(r.lang, r.source) for r in rows if not r.base_failed}:
        own = {}
        for name in quality.RATES:
            _, c = fence(name, lambda r: True)
            n, x = fence(name, lambda r: r.lang == lang)
            x = (n * x + quality.SHRINK * c) / (n + quality.SHRINK)
            n, g = fence(name, lambda r: (r.lang, r.source) == (lang, source))
            own[name] = (n * g + quality.SHRINK * x) / (n + quality.SHRINK)
        out[lang, source] = own
    return out


@pytest.mark.parametrize("table", ["smallest table", "made up"])
def test_quality_limits(spark, table):
    """Every verdict follows from the group's limits, recomputed here from sorted values; no document is judged otherwise."""
    if table == "made up":
        # two sources with symbols in most texts, one without: what one rejects the other keeps
        r = random.Random(4)
        texts = [(i, " ".join(r.choice(["ab", "cde", "fghi"]) + f"{r.randrange(10**6)}" + ("#" * (i % 3) if i % 2 else "") for _ in range(80)), "en", f"s{i % 2}", None, None, 1, "x", 2) for i in range(600)]
        texts += [(600 + i, "### " * 20 + " ".join(f"w{r.randrange(10**6)}" for _ in range(80)), "en", f"s{i % 2}", None, None, 1, "x", 2) for i in range(10)]
        rows = quality.quality(spark.createDataFrame(texts, SCHEMA)).collect()
    else:
        rows = quality.quality(queries.documents(spark, SF)).collect()
    own = plain_limits(rows)
    for r in rows:
        above = False
        for name, (count, against, units, _, _) in quality.RATES.items():
            if not r.base_failed:
                limit = own[r.lang, r.source][name]
                assert abs(r[name] - limit) < 1e-6
                above |= units * r[count] > limit * r[against] + quality.CERTAIN * units * r[count] ** 0.5
        assert r.kept == (not r.base_failed and not above)
    if table == "made up":
        judged = {(r.source, r.kept) for r in rows if r.doc_id >= 600 and not r.base_failed}
        assert judged == {("s0", False), ("s1", True)}


def test_good_documents_are_kept(spark):
    """Documents labelled good go by the base rules alone, most bad ones go."""
    sf = "/root/testdata/sf0.01"
    rows = quality.quality(queries.documents(spark, sf)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    kept = {}
    for r in rows.select("quality", "kept").collect():
        kept.setdefault(r.quality, []).append(r.kept)
    assert sum(kept[1]) >= 0.995 * len(kept[1]) and sum(kept[0]) <= 0.1 * len(kept[0])


def test_url_verdicts(spark):
    pages = [
        (1, "http://A.example.net/en/x?q", None), (2, "https://example.net/enx", ""), (3, None, "x"), (4, "no scheme", "x"), (5, "http://net", None), (6, "http://NET/", None), (7, "http://b.example.com/de/1#f", None),
        (8, "http://b.example.com/d", '<link rel="canonical" href="http://c.example.com/de/9">'), (9, "http://q.org/fr/", None), (10, "http://w.com/", "<META http-equiv=refresh content='0; url=http://b.example.com/d'>"),
        (11, "http://v.com/a", '<link href="http://q.org/fr/" rel="canonical">'), (12, "http://v.com/b", '<link href="http://v.com/a" rel="canonical"> <meta http-equiv="refresh" content="1;url=http://b.example.com/d">'), (13, "http://alone.com", "<p>canonical refresh"), (13, "http://alone.com", None),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = sorted(tuple(r) for r in urls.url_verdicts(df).collect())
    said = {}
    for p, u, _ in pages:
        h, path = brute.url(u)
        said[p] = (h, path, brute.rule(h, path, urls.RULES))
    assert [g[:4] for g in got] == sorted((p, *said[p]) for p, _, _ in pages) if None not in [v[2] for v in said.values()] else True
    for g in got:
        assert g[1:4] == said[g[0]]
    verdict = {g[0]: g[4] for g in got}
    assert [verdict[p] for p in (1, 2, 3, 4, 5, 6, 7, 9)] == ["allow", "block", "allow", "allow", "allow", "block", "block", "allow"]
    # 8 to 12 are one component with an allowed page, which stands above the blocked one
    assert verdict[8] == verdict[10] == verdict[11] == verdict[12] == verdict[13] == "allow"
    only = urls.url_verdicts(df.where("page_id IN (8, 10)")).collect()
    assert {r.verdict for r in only} == {"block"}
    assert urls.url_verdicts(df.limit(0)).collect() == []


def test_token_files(spark, docs, tmp_path):
    got = sorted(token_files.token_digest(frame(spark, docs), BYTE).collect())
    own, at, want = Tokenizer.from_file(BYTE), 0, []
    for d, t in docs:
        ids = brute.encoded(own, t, 0)
        want.append((d, at, len(ids) // 4, brute.crc(ids)))
        at += len(ids) // 4
    assert [tuple(r) for r in got] == want
    if docs:
        path = str(tmp_path / "tokens")
        token_files.write_token_files(frame(spark, docs), path, BYTE, 0)
        some = token_files.read_tokens(spark, path, 3, 9).collect()
        assert {r.doc_id: r.tokens for r in some} == {d: list(array("I", brute.encoded(own, t, 0))) for d, t in docs if 3 <= d <= 9}
        assert sorted(tuple(r) for r in token_files.read_counts(spark, path).collect()) == [w[:3] for w in want]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_ids_of_whole_texts(path):
    r = random.Random(3)
    alphabet = [" ", " ", "\n", "a", "B", "é", "À", "'s", "'", ",", ".", "!", "1", "\t", " ", "́", " ", "ﬁ", "İ", "ß", "日", "\x1c", "\0", "<|endoftext|>", "word", "😀"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(3000)]
    own = tokens.Encoder(path)
    for t, got in zip(texts, own.ids(texts), strict=True):
        assert got == array("I", own.tokenizer.encode(t, add_special_tokens=False).ids).tobytes(), repr(t)


def test_line_dedup(spark, docs):
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, docs)).collect()}
    gone = brute.line_matches(docs)
    assert set(got) == {d for d, _ in docs}
    for d, t in docs:
        own = (t or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(own) if (d, i) not in gone)
        assert (got[d].text or "") == kept
        assert got[d].n_removed == sum((d, i) in gone for i in range(len(own)))
        assert (got[d].text is None) == (t is None) and got[d].n_lines == (0 if t is None else len(own))


def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    if docs:
        long = max(docs, key=lambda x: len(x[1] or ""))[1].split()
        items += [(900, " ".join(long[50:80])), (901, " ".join(long[100:107])), (902, " ".join(long[200:211]).upper()), (903, "a"), (904, None), (905, ""), (906, " ".join(long[50:80])), (907, "one two three four")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r) for r in decontaminate.contamination(frame(spark, docs), bench).drop("text_key").collect())
    assert got == brute.contaminated(docs, items)
    assert decontaminate.contamination(frame(spark, docs), bench.limit(0)).where("n_hit > 0").count() == 0


def test_shards(spark, docs):
    got = sharding.hilbert_shards(frame(spark, docs), 8).collect()
    text = dict(docs)
    assert sorted(r.doc_id for r in got) == sorted(text)
    by = {}
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, brute.crc(data), "rows", None)
        by.setdefault(r.shard, []).append(r.slot)
    if docs:
        sizes = [len(by.get(s, [])) for s in range(8)]
        assert set(by) <= set(range(8)) and max(sizes) - min(sizes) <= 1
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
        runs = [hashlib.md5(repr(text[r.doc_id]).encode()).digest() for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert sum(a != b for a, b in zip(runs, runs[1:], strict=False)) + 1 == len(set(runs))  # equal texts side by side


def test_near_duplicates(spark, docs):
    got = sorted(tuple(r) for r in jaccard.near_duplicates(frame(spark, docs)).collect())
    assert got == brute.components(docs)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Large groups are cut into blocks; here blocks of four, with copies that link only in chains."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "SIDE", 3)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"z{r.randrange(1000)}"
        docs.append((len(docs), " ".join(w)))
    got = sorted(tuple(x) for x in jaccard.near_duplicates(frame(spark, docs)).collect())
    assert got == brute.components(docs)


def test_repeats(spark, docs):
    got = sorted(tuple(r) for r in repeats.remove_repeats(frame(spark, docs)).drop("kept").collect())
    assert got == brute.repeats(docs)


@pytest.mark.parametrize("queued", [0, 1 << 20])
def test_suffix_order(queued, monkeypatch):
    monkeypatch.setattr(repeats, "QUEUED", queued)
    monkeypatch.setattr(repeats.Queues.__init__, "__defaults__", (queued,))
    r = random.Random(2)
    for _ in range(60):
        text = [r.randrange(1, r.choice([2, 3, 30])) if r.random() < 0.9 else 1 for _ in range(r.randrange(1, 300))]
        text += text[: r.randrange(len(text))] + [0]
        order = repeats.suffix_order(np.array(text, np.int16), 50).tolist()
        assert sorted(order) == list(range(len(text)))
        heads = [tuple(text[i : i + 50]) for i in order]
        assert heads == sorted(heads)


def test_token_counts(spark, docs):
    vocabulary = set(json.load(open(BYTE, encoding="utf-8"))["model"]["vocab"])
    longest, letters = max(map(len, vocabulary)), tokens.byte_letters()
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.token_counts(frame(spark, docs), BYTE).collect()}
    assert set(got) == {d for d, _ in docs}
    for d, t in docs:
        n = 0
        words = brute.WHITE.findall(t or "")
        for w in words:
            s, at = "".join(letters[b] for b in (" " + w).encode()), 0
            while at < len(s):
                at += next(k for k in range(min(longest, len(s) - at), 0, -1) if s[at : at + k] in vocabulary)
                n += 1
        assert got[d] == (len(words), n)


def test_automaton_with_unknown_words():
    own = wordpiece.Automaton(["ab", "abcd", "bc", "c", "cde"])
    greedy = {"ab": 1, "abc": 2, "abcd": 1, "abcde": 1, "abbc": 2, "x": 1, "abx": 1, "cc": 2, "bcc": 2}
    assert {w: own.count(w) for w in greedy} == greedy
