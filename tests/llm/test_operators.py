"""The ten operators on small tables: brute force, round trips, and the defined edge cases."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactlake.llm import boosting, components, fingerprints, jaccard_join, language_id, license_scan, metric_join, packing, sentencepiece_codec, shingles, token_files, toxicity, url_filter

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, part int, text_hash string"
TEXTS = [None, "", " ", "  two  spaces ", "a", "one two three four", "same text here for all of us", "same text here for all of us", "日本語 テスト 🎉", "tab\tand\nline\r\n end ", "▁mark ▁▁", "<s> </s> <|endoftext|>", "x" * 5000, "word " * 3000, "it's 'll 12 3a .b \u00a0x\u2003y"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, repeated rows, a null key, and columns whose names could clash."""
    rows = [(i, t, None if i % 3 == 0 else "en", "s", 0, 1, 2, "h") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "no key here at all, friends", "en", None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# 1


def test_pieces_match_the_library(docs, nothing):
    m = sentencepiece_codec.PieceModel(PIECES)
    got = sentencepiece_codec.digests(docs, PIECES).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(TEXTS):
        ids = m.library.encode(t or "", add_bos=True, add_eos=True)
        assert (by[i].n_tokens, by[i].ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert by[i].decoded_sha256 == sha(m.library.decode(ids).encode())
    assert sentencepiece_codec.digests(nothing, PIECES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text_encodes_as_the_library(text):
    m = sentencepiece_codec.model(PIECES)
    (ids,) = m.encode([text])
    assert ids == m.library.encode(text, add_bos=True, add_eos=True)
    assert m.decode(ids) == m.library.decode(ids)


def test_both_agendas_agree():
    m = sentencepiece_codec.model(PIECES)
    for part in ("▁internationalization", "▁" + "ab" * 60, "▁aaaaaaaaaaaaaaaa"):
        assert m._merge_short(part) == m._merge_long(part)


def test_encode_then_decode_keeps_other_columns(docs):
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PIECES), PIECES).where("doc_id = 6").first()
    assert back.decoded == TEXTS[6] and back.source == "s"
    with pytest.raises(ValueError, match="already"):
        sentencepiece_codec.encode(docs, PIECES, ids="rank")


# 2


def test_language(spark, nothing):
    words = {"aa": "the and with this that from".split(), "bb": "der die und nicht mit sich".split()}
    rows = [(i, " ".join(words[k][(i * j) % 6] for j in range(3, 20)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "12 !!", "bb"), (1002, "und nicht mit sich die der", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df, language_id.learn(df)).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert got[1002].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert language_id.predict(nothing, language_id.learn(nothing)).count() == 0
    kept = language_id.keep(df, language_id.learn(df))
    assert kept.columns == df.columns and kept.count() == df.count() - 2


def gram_hashes(texts):
    return [h for h, _ in language_id.grams(texts)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab A\n\t é\x0b", max_size=80), st.integers(1, 9))
def test_long_texts_have_the_same_shingles_and_triplets(text, piece):
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.array([0, len(raw)])
    if len(raw):
        assert shingles._long_set(raw, piece).tolist() == shingles.shingle_sets(raw, ends)[0].tolist()
    whole = fingerprints.counts(raw, ends)
    full = fingerprints.SLICE_BYTES
    try:
        fingerprints.SLICE_BYTES = piece
        assert (fingerprints.counts(raw, ends) == whole).all()
    finally:
        fingerprints.SLICE_BYTES = full


def test_triplet_counts_as_by_hand():
    texts = [b"abcde", b"", b"xy", b"abc"]
    got = fingerprints.counts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for row, t in zip(got, texts, strict=True):
        want = np.zeros(fingerprints.BUCKETS, int)
        for k, (a, b, c) in enumerate(fingerprints.KINDS):
            for i in range(len(t) - c):
                h = 0
                for place, at in enumerate((a, b, c)):
                    h ^= hashlib.sha256(f"triplet/{k}/{place}/{t[i + at]}".encode()).digest()[0] % fingerprints.BUCKETS
                want[h] += 1
        assert row.tolist() == want.tolist()


def test_quartile_codes_as_by_hand():
    text = b"some text whose triplets fill a few of the buckets, some of them twice: some text whose"
    c = fingerprints.counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist()
    q = sorted(c)
    quarters = [q[31], q[63], q[95]]
    d = fingerprints.digest([text])[0]
    assert d[: fingerprints.BUCKETS].tolist() == [sum(x > v for v in quarters) for x in c]
    assert d[-1] == hashlib.sha256(text).digest()[0]


def test_long_texts_have_the_same_grams(monkeypatch):
    texts = ["the first text, with words", None, "x" * 9, "", "Un deuxième texte; ß und İ " * 7]
    whole = [sorted(zip(o.tolist(), h.tolist(), strict=True)) for h, o in language_id.grams(texts)]
    for piece in (1, 2, 5, 20):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert sorted(x for h, o in language_id.grams(texts) for x in zip(o.tolist(), h.tolist(), strict=True)) == sorted(sum(whole, []))


def test_predictions_as_by_brute_force():
    """The language whose gram set, tested one by one, holds most of a text's grams; exact sets instead of filters."""
    words = {"x": "hello world again water stone bread".split(), "y": "guten tag welt wasser stein brot".split(), "z": "bonjour monde encore eau pierre pain".split()}

    def cut(t):
        padded = f"    {t}    "
        every = [padded[i : i + n] for n in language_id.ORDERS for i in range(len(padded) - n + 1)]
        return [g for g in every if sum(map(str.isalpha, g)) >= len(g) - 1]

    sets = {k: {g for w in v for g in cut(w)} for k, v in words.items()}
    f = language_id.SlicedFilters.build({k: np.unique(np.concatenate(gram_hashes(v))) for k, v in words.items()})
    for text in ["hello water", "wasser und brot", "le pain et eau", "stein stone pierre stein"]:
        best = max(sorted(sets), key=lambda k: sum(g in sets[k] for g in cut(text)))
        assert f.predict([text])[0] == [best]


def test_more_than_64_languages_and_a_bounded_sample(spark):
    names = [f"l{i:03d}" for i in range(70)]
    profiles = {n: np.unique(np.random.default_rng(i).integers(0, 1 << 32, 300).astype(np.uint32)) for i, n in enumerate(names)}
    f = language_id.SlicedFilters.build(profiles)
    assert f.words.shape[0] == 2
    for i in (0, 63, 64, 69):
        for p in language_id.positions(profiles[names[i]]):
            assert (f.words[i // 64][p] >> np.uint64(i % 64) & np.uint64(1)).all()
    rows = [(1 if zlib.crc32(b"1") % 4 != 2 else 0, "hello world again", "aa")] * 300 + [(k, f"guten tag {k}", "bb") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = language_id.learn(df, sample=8)
    assert f.languages == ["aa", "bb"] and f.predict(["hello again"])[0] == ["aa"]


def test_filters_hold_every_gram_and_correct_for_chance():
    own = np.arange(5000, dtype=np.uint32) * np.uint32(2654435761)
    f = language_id.SlicedFilters.build({"x": own, "y": own[:10] + np.uint32(7)})
    mask = np.bitwise_and.reduce([f.words[0][p] for p in language_id.positions(own)])
    assert (mask & np.uint64(1)).all()
    assert 0 < f.chance[0] < 0.01 and f.chance[1] < f.chance[0]


def test_a_prediction_depends_on_its_text_alone():
    f = language_id.SlicedFilters.build({"x": gram_hashes(["hello world again"])[1], "y": gram_hashes(["guten tag welt"])[1]})
    alone = f.predict(["hello world"])
    assert f.predict(["zzz", "hello world", "", "yyy"])[1][1] == alone[1][0]


def test_neighbours_in_a_batch_change_nothing():
    words = {"x": "hello world again water stone".split(), "y": "guten tag welt wasser stein".split()}
    f = language_id.SlicedFilters.build({k: np.concatenate(gram_hashes(v)) for k, v in words.items()})
    texts = ["welt", "hello", "", None, "wasser", "water", "12", "again stone", "x", "hello"]
    alone = [f.predict([t]) for t in texts]
    for order in (range(len(texts)), range(len(texts))[::-1]):
        own = f.corrected([texts[i] for i in order])
        lang, score = f.predict([texts[i] for i in order])
        for at, i in enumerate(order):
            assert (own[at] == f.corrected([texts[i]])[0]).all()
            assert (lang[at], score[at]) == (alone[i][0][0], alone[i][1][0])
    assert [o.tolist() for _, o in language_id.grams(["ab", "cd"])] == [[0, 0, 0, 1, 1, 1], [0, 0, 1, 1], []]  # " a ab b ", " ab ab "; 4-grams need three letters


# 3


def test_fingerprints_of_neighbours(docs, nothing):
    rows = [(r.doc_id, r.text or "") for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    rows.sort(reverse=True)
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprints.with_next(df).collect()}
    for i, (k, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        a, b, c = (fingerprints.digest([x.encode()]) for x in (t, e, following))
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), sha(e.encode()))
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (*fingerprints.to_hex(a), *fingerprints.to_hex(b))
        assert got[k].near_edited == fingerprints.likeness(a, b)[0] and got[k].near_next == fingerprints.likeness(a, c)[0]
        assert (fingerprints.from_hex(got[k].fingerprint) == a[0]).all()
    assert fingerprints.with_next(docs).count() == docs.count()
    assert fingerprints.with_next(nothing).count() == 0
    one = fingerprints.with_next(df.where("doc_id = 6")).first()
    assert one.near_next == 1.0


def test_difference_is_bounded_and_orders_edits():
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400))
    other = " ".join("".join(rng.choice(list("klmnopqrst"), 5)) for _ in range(400))
    small, large = text.replace("a", "z", 5), text[:1200] + other[:1200]
    d = fingerprints.digest([x.encode() for x in (text, small, large, other)])
    to = [int(fingerprints.difference(d[:1], d[k : k + 1])[0]) for k in range(4)]
    assert to[0] == 0 and to[0] < to[1] < to[2] <= fingerprints.BOUND and to[3] <= fingerprints.BOUND


# 4

RULES = [url_filter.Rule.parse(r) for r in ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_url_rules_and_templates(spark):
    urls = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/712?x#y", "http://a.com/en/1", "http://com/en/", "http://x.example.net/de/81", "http://y.net/de/1", "http://b.org?q=/es/", "http://b.org/es", "http://b.org/es/#", "a://b://c/d", "http://é.org/es/ß"]
    urls += [f"http://bad.com/en/{i}" for i in range(40)] + [f"http://bad.com/fr/{i}" for i in range(40)] + [f"http://good.dev/post/{i}-title-{i}" for i in range(40)] + ["http://bad.com/fr/1"] * 3
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name), u
        assert rule is None or got[i].verdict == rule.verdict
    by_url = {urls[i]: r.verdict for i, r in got.items()}
    assert by_url["http://bad.com/fr/7"] == "block"  # as its merged branch is
    assert by_url["http://good.dev/post/3-title-3"] == "allow" and by_url[None] == "allow"
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_purity_by_brute_force_and_own_labels(spark):
    urls = [f"http://h{i % 3}.dev/{'abc'[i % 3]}/{i % 7}/x{i % 2}" for i in range(300)] + [None, "http://h0.dev", "http://h0.dev/a/1/2/3/4/5/6"]
    rows = [(None if i % 50 == 0 else i, u, ["block", "allow", None][i % 3] if i % 4 else None) for i, u in enumerate(urls)] + [(5, urls[5], "block")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, own string")
    got = url_filter.judge(df, RULES, label="own").collect()
    assert len(got) == len(rows)
    by_url = {}
    for r in got:
        by_url.setdefault((r.host, r.path), set()).add((r.template, r.purity, r.verdict))
    assert all(len(v) == 1 for v in by_url.values())  # rows that repeat a url agree
    sums = {}
    for _, u, own in rows:
        host, path, rule = brute_rule(u)
        (template, *_), = by_url[host, path]
        label = own or (rule and rule.verdict)
        bad, known = sums.get((host, template), (0, 0))
        sums[host, template] = bad + (label == "block"), known + (label is not None)
    for r in got:
        bad, known = sums[r.host, r.template]
        assert r.purity == pytest.approx((bad + url_filter.SMOOTH * url_filter.PRIOR) / (known + url_filter.SMOOTH))
        assert r.rule or r.verdict == ("block" if r.purity >= url_filter.REJECT else "allow")


def test_many_children_become_one_wildcard(spark):
    df = spark.createDataFrame([(i, f"http://h.dev/tag/{chr(97 + i % 26)}{chr(97 + i // 26)}/page") for i in range(200)], "page_id long, url string")
    assert {r.template for r in url_filter.judge(df, RULES).select("template").collect()} == {"/tag/*/page/{end}"}


# 5


def test_licences_as_by_brute_force(spark, docs, nothing):
    t = license_scan.TEMPLATES
    mit, gpl = t["MIT-permission"], t["GPL-header"]
    cut = " ".join(gpl.split()[:34])
    texts = [mit, "x y z. " * 50 + mit + " tail" * 77, gpl.upper(), cut, " ".join(gpl.split()[:10]), t["MIT"] + "\n" + t["Apache-2.0"], "released under the mit licence", "Released under the MIT License", None, "", "licensed " * 500, "pad " * 1001 + t["GPL-3.0"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: {m.license: m.containment for m in r.matches} for r in license_scan.scan(df).collect()}
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, x) for i, x in enumerate(texts)])
    for i, _, names, share in con.execute(f"select doc_id, n_licenses, licenses, containment from ({license_scan.oracle()})").fetchall():
        assert ",".join(sorted(got[i])) == names and max(got[i].values(), default=0) == pytest.approx(share)
    assert got[0] == {"MIT-permission": 1.0} and set(got[5]) == {"MIT", "Apache-2.0"} and got[4] == {} and got[11] == {"GPL-3.0": 1.0}
    assert 0.75 <= got[3]["GPL-header"] < 1
    assert license_scan.scan(docs).count() == docs.count() and license_scan.scan(nothing).count() == 0
    assert license_scan.scan(df, {}).count() == len(texts)


def test_the_licence_plan_is_native(spark, docs):
    plan = license_scan.scan(docs, {"a b": "c d", **license_scan.TEMPLATES})._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_long_templates(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    t = {f"T{i:03d}": " ".join(rng.choice(words, 500)) for i in range(300)}
    texts = ["lead in words " + t["T007"] + " tail", " ".join(t["T123"].split()[:430]), " ".join(t["T200"].split()[:300]), "none at all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [{r.doc_id: {m.license for m in r.matches} for r in license_scan.scan(df, t, index_rows=most).collect()} for most in (license_scan.INDEX_ROWS, 10)]
    assert found[0] == found[1] == {0: {"T007"}, 1: {"T123"}, 2: set(), 3: set()}


# 6


def brute_links(rows):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    sets = [(k, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for k, t in rows]
    links = {i: set() for i in range(len(rows))}
    for (i, (_, a)), (j, (_, b)) in combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            links[i].add(j)
            links[j].add(i)
    out = []
    for i, (k, s) in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((k, len(s), min(keys) if keys else None, len(links[i])))
    return sorted(out, key=str)


def near_texts(seed=3):
    """Chains of edits, exact copies, shared passages, short and empty texts."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \n", "a b", "a b", "A  b", "a b c d e", "a b c d e f"]
    for _ in range(6):
        base = [word() for _ in range(int(rng.integers(40, 150)))]
        for _ in range(12):
            texts.append(" ".join(base))
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(len(base)))] = word()
        texts += [" ".join(base)] * 3
    texts += [" ".join([word() for _ in range(30)] + passage) for _ in range(20)]
    texts += [" ".join(passage + [word() for _ in range(int(n))]) for n in rng.integers(0, 12, 15)]
    return list(enumerate(texts)) + [(None, texts[10]), (None, "quite alone with no key"), (9, texts[9])]


@pytest.mark.parametrize("block, hot, flush", [(1024, 2000, 1 << 20), (5, 3, 300)])
def test_links_as_by_brute_force(spark, monkeypatch, block, hot, flush):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HOT_FLOOR", hot)
    monkeypatch.setattr(jaccard_join, "HOT_TIMES", 0 if hot == 3 else 4)
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "sig": F.lit(2), "key": F.lit(3)}).repartition(4)
    got = [tuple(r) for r in jaccard_join.jaccard_join(df).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert sorted(got, key=str) == brute_links(rows)


def test_one_of_each_group_stays(spark, nothing):
    rows = [(k, t) for k, t in near_texts()[:-1]]
    want = brute_links(rows)
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(k for k, _, c, _ in want if k is not None and k == c)
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["quite alone with no key"]
    assert jaccard_join.jaccard_join(nothing).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=18), min_size=2, max_size=25))
def test_family_overlaps_are_exact(groups):
    sets = sorted({tuple(sorted(g)) for g in groups}, key=lambda g: (len(g), g))
    family = jaccard_join.Family([np.array(s, np.uint64) for s in sets])
    for i, low, high, got in family.overlaps():
        for z in range(len(sets)):
            compatible = 100 * min(len(sets[i]), len(sets[z])) >= 75 * max(len(sets[i]), len(sets[z]))
            assert compatible == (low <= z < high)
            if compatible and z != i:
                assert got[z] == len(set(sets[i]) & set(sets[z]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[201] == 200 and len(got) == 51 + 40 + 2
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# 7


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_waste_least(histogram, buckets):
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths])

    def waste(tops):
        return sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, counts, strict=True))

    got = packing.boundaries(lengths, counts, buckets)
    assert got[-1] == lengths[-1] and len(got) <= buckets and list(got) == sorted(set(got))
    best = min(waste((*some, lengths[-1])) for k in range(min(buckets, len(lengths))) for some in combinations(lengths[:-1], k))
    assert waste(got) == best


def test_batches(spark, docs, nothing):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(n)) for i, n in enumerate(rng.integers(0, 300, 500))] + [(None, 5), (3, 7), (3, 7), (900, 50_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(5), buckets=4, budget=1000).toPandas()
    assert len(got) == len(rows) and (got.n_tokens <= got.bucket_len).all()
    sizes = got.groupby("batch_id").agg(rows=("n_tokens", "size"), top=("bucket_len", "max"), buckets=("bucket", "nunique"))
    assert (sizes.buckets == 1).all() and ((sizes.rows == 1) | (sizes.rows * sizes.top <= 1000)).all()
    for _, own in got.groupby("bucket"):
        room = max(1, 1000 // max(1, own.bucket_len.iloc[0]))
        assert own.batch_id.nunique() == -(-len(own) // room)  # only the last may be short
    assert packing.pack(packing.tokenised(nothing, BYTES, ids=True), carry=("ids",)).count() == 0


def test_padded_batches_hold_the_tokens(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    want = sorted(((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()), key=str)
    packed = packing.pack(packing.tokenised(docs.withColumn("_n", F.lit(1)), BYTES, ids=True), carry=("ids",), buckets=3, budget=400)
    got = []
    for r in packing.padded(packed).collect():
        assert len(r["keys"]) == 1 or len(r["keys"]) * r.bucket_len <= 400
        for k, tokens, mask in zip(r["keys"], r.tokens, r.masks, strict=True):
            assert len(tokens) == len(mask) == r.bucket_len and not any(t for t, m in zip(tokens, mask, strict=True) if not m)
            got.append((k, [t for t, m in zip(tokens, mask, strict=True) if m]))
    assert sorted(got, key=str) == want


def test_boundaries_of_long_lengths_are_exact():
    rng = np.random.default_rng(4)
    lengths = np.unique(rng.integers(1, 1 << 40, 60))
    counts = rng.integers(1, 1000, len(lengths))
    tops = packing.boundaries(lengths, counts, 3).tolist()
    waste = lambda t: sum(int(c) * (min(x for x in t if x >= n) - int(n)) for n, c in zip(lengths.tolist(), counts.tolist(), strict=True))
    assert waste(tops) == min(waste([a, b, int(lengths[-1])]) for a, b in combinations(lengths[:-1].tolist(), 2))


# 8


def vectors(seed=5, n=120, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, dim))
    rows = [(i, (base[i % 20] + rng.normal(scale=0.18, size=dim)).tolist(), i % 3) for i in range(n)]
    rows += [(n + 1, rows[0][1], 0), (n + 2, rows[0][1], 1), (n + 3, [2 * x for x in rows[0][1]], 0)]
    rows += [(n + 4, None, 0), (n + 5, [0.0] * dim, 0), (n + 6, [float("nan")] * dim, 0), (n + 7, [float("inf")] + [0.0] * (dim - 1), 0), (n + 8, rows[0][1], None), (n + 9, [], 0), (n + 10, [None] * dim, 0), (n + 11, [1.0, 0.0], 0), (n + 12, [1.0, 0.01], 0)]
    return rows


@pytest.mark.parametrize("block", [4096, 7])
def test_vectors_as_by_brute_force(spark, block):
    rows = vectors()

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or not a[1] or not b[1] or len(a[1]) != len(b[1]) or any(x is None or not np.isfinite(x) for x in a[1] + b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        norm = np.linalg.norm(x) * np.linalg.norm(y)
        return norm > 0 and x @ y / norm >= 0.93

    links = {a[0]: {b[0] for b in rows if b[0] != a[0] and linked(a, b)} for a in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1)).repartition(3)
    got = {r.vec_id: r for r in metric_join.near_duplicates(df, block=block).collect()}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (len(links[k]), min(seen), k == min(seen))
    assert len(got) == len(rows) and metric_join.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_any_magnitude_and_shared_or_missing_keys(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [1.0, 0.1], 1), (4, [5e-324, 5e-324], 1), (5, [1.0, 1.0], 1), (None, [2.0, 0.21], 1), (3, [1e300, -1e300], 1), (None, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, metric_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (4, 3, 1, False), (5, 3, 1, False), (3, 1, 3, True), (None, 1, 3, False), (3, 0, 3, True), (None, 0, None, True)], key=str)


@pytest.mark.parametrize(("block", "most_cells"), [(16, 1 << 18), (8, 20)])
def test_pivots_prune_clusters_and_lose_no_link(spark, block, most_cells):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, 16))
    x = np.repeat(centres, 16, 0) + rng.normal(scale=0.12, size=(24 * 16, 16))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(len(x)) % 2
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    got = {r.vec_id: r for r in metric_join.near_duplicates(df, block=block, most_cells=most_cells).collect()}
    assert all(got[i].n_links == linked[i].sum() - 1 for i in range(len(x)))
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([root[linked[i]].min() for i in range(len(x))])
    assert all(got[i].component_id == root[i] for i in range(len(x)))
    # The same bounds, in this process: well over half of all cells are ruled out.
    p = metric_join.choose_pivots(unit[label == 0], 12)
    own = metric_join._distances(x[label == 0], p)
    cells = metric_join.Cells(range(12), [1] * 12, [own[own.argmin(1) == c].min(1).max() for c in range(12)])
    kept = cells.near(x[label == 0], own.argmin(1), p, np.sqrt(2 - 2 * 0.93) + metric_join.SLACK)
    assert kept.mean() < 0.5


# 9


def test_token_files_read_back(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write(docs, BYTES, folder, end=2, sequence=64, batch=4)
    got = token_files.read(manifest).orderBy("start").collect()
    library = Tokenizer.from_file(BYTES)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (k, t) in zip(got, rows, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    f = token_files.TokenFile(manifest.orderBy("part").first().uri)
    tokens, mask = f.sequence(0)
    assert len(tokens) == len(mask) == 64 and not tokens.flags.owndata  # a view of the map
    assert (tokens[mask][:10] == f.ids(0, 64)[: mask.sum()][:10]).all()
    assert token_files.read(token_files.write(nothing, BYTES, f"{folder}-none", end=2)).count() == 0


@functools.cache
def fresh_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def test_other_tokenizers_and_other_keys(spark, tmp_path):
    spec = json.loads(open(BYTES).read())
    spec["normalizer"] = {"type": "Lowercase"}
    path = f"{tmp_path}/lower.json"
    with open(path, "w") as f:
        json.dump(spec, f)
    texts = ["Some TEXT <|endoftext|> here", "", None, "Ünï  x"]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = token_files.read(token_files.write(df, path, f"file://{tmp_path}/t", end=2), kind="string").orderBy("doc_id").collect()
    library = token_files.ByteBpe(path).library
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(f"k{i}", len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(want)]
    assert spark.read.parquet(f"file://{tmp_path}/t/manifest").agg(F.sum("n_docs")).first()[0] == len(texts)
    assert sorted(r.doc_id for r in fingerprints.with_next(df).collect()) == ["k0", "k1", "k2", "k3"]
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(df.union(spark.createDataFrame([("a", texts[0])], df.schema))).collect()}["k0"] == "a"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text_tokenizes_as_the_library(text):
    e = token_files.encoder(BYTES)
    assert e.encode([text], 2) == [np.array([*fresh_library().encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "a", "it's", "\n", "日本", "12", "word"]), max_size=9).map("".join))
def test_added_tokens_in_a_text_are_ids_as_in_the_library(text):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(BYTES)
    want = [np.array([*fresh.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in ("no token", text, "")]
    assert token_files.encoder(BYTES).encode(["no token", text, ""], 2) == want


def test_added_tokens_that_take_spaces_or_overlap(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    for flags in ({}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}):
        t = Tokenizer.from_file(BYTES)
        t.add_special_tokens([AddedToken("<x>", **flags), AddedToken("<x>y", **flags)])
        t.save(path := f"{tmp_path}/t.json")
        texts = ["plain text", "a <x> b<x>yz <x>y <|endoftext|><x>", "", "x <x>"]
        assert token_files.ByteBpe(path).encode(texts, 2) == [np.array([*Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes() for x in texts]


# 10


def test_toxicity_learns_and_scores(spark, nothing):
    rng = np.random.default_rng(4)
    clean = "river stone light morning garden window letter bread music paper".split()
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(clean, 30))
        if i % 5 == 0:
            words[3:3] = ["you", rng.choice(["idiot", "moron", "zorbles", "zorblen", "scum"])]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    df = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "you ID1OT you m0ron!!"), (None, "x")], "doc_id long, text string")
    ls = spark.createDataFrame([*labels, (0, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, ls)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    own = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert own and all(got[i].held_out for i in own) and sum(got[i].predicted == int(i % 5 == 0) for i in own) / len(own) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[9002].score > got[9001].score == got[9000].score and got[None].held_out
    assert toxicity.keep(df, model).count() < df.count()
    empty = toxicity.learn(df, ls.limit(0))
    assert toxicity.score(df, empty).first().score == 0.5 and toxicity.score(nothing, empty).count() == 0


def test_obfuscated_spellings_count():
    x = toxicity.Lexicon().features(["you are an idiot ok", "you are an 1d1ot ok", "you are an i.d.i.o.t ok", "you are an i d i o t ok", "you are an ideal ok", ""])
    column = toxicity.NAMES.index("fixed")
    assert (x[:4, column] > 0).all() and x[4, column] == x[5, column] == 0
    assert x[1, toxicity.NAMES.index("obfuscated")] > 0 and x[0, toxicity.NAMES.index("near_you")] > 0


def test_long_texts_have_the_same_features(monkeypatch):
    lexicon = toxicity.Lexicon({"vile": 3.0, "^stin": 2.5})
    texts = ["You vile, st1nking i d i o t! NOW ab c d e f you " * 9, "x " * 40, "", "no space" + "y" * 2000, "ihr und " + "i d i o t " * 8, "tu es laid\u2003et toi " * 12]
    whole = lexicon.features(texts)
    for size in (1, 7, 60):
        monkeypatch.setattr(toxicity, "PIECE", size)
        assert (lexicon.features(texts) == whole).all()


def test_features_as_by_hand():
    lexicon = toxicity.Lexicon({"vile": 3.0, "^stin": 2.5})
    row = dict(zip(toxicity.NAMES, lexicon.features(["You vile FOO! i d i o t 12 stink,"])[0], strict=True))
    n, chars = 10, 33
    assert row["words"] == np.log1p(n) and row["fixed"] == 100 / n and row["learned"] == 100 / n
    assert row["weight"] == pytest.approx(100 * 5.5 / n) and row["strongest"] == 3.0 and row["stem"] == 100 / n
    assert row["near_you"] == 100 / n and row["you"] == 100 / n and row["shouted"] == 100 / n and row["obfuscated"] == 100 / n
    assert row["capitals"] == 4 / chars and row["exclaims"] == 100 / chars and row["punctuation"] == 1 / chars and row["digits"] == 2 / chars and row["hits"] == 3


def test_a_repeated_key_gives_one_row_to_learn_from(spark):
    keys = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    docs = spark.createDataFrame([(keys[0], "some words")] * 300 + [(k, "vile words you" if k % 2 else "kind words") for k in keys], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in keys], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, sample=24)
    assert len(toxicity.score(docs, model).collect()) == docs.count()


def test_boosting_and_calibration():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.fit_trees(x[:500], y[:500])
    raw = trees.raw(x[500:])
    assert ((raw > 0) == y[500:]).mean() > 0.9
    p = boosting.fit_isotonic(raw, y[500:])(np.sort(raw))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1
    assert json.dumps(p[:2].tolist())
