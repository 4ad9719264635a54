import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagemill.llm import chat_format, language_id, ngram_join, packing, quality_rules, queries, secret_scan, source_mix, token_files, topk_search, url_filters
from pagemill.llm._store import shared_dir

from .conftest import BASE, LONG, TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_topk(spark):
    rows = [(i, [float((i * k) % 7 - 3) / 4 for k in range(1, 5)], "c") for i in range(120)]
    rows += [(200, None, "c"), (201, [1.0, None, 0.0, 0.0], "c"), (202, [float("nan")] * 4, "c"), (203, [float("inf")] * 4, "c"), (204, [], "c"), (None, [1.0] * 4, "c"), (50, rows[50][1], "c"), (7, rows[7][1], "c"), (300, [1.0, 2.0], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in topk_search.topk(table, F.col("vec_id") % 50 == 0, block_rows=40, block_queries=2).collect():
        got[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    ints = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in (0, 50, 100):
        v = next(x for i, x in ints if i == q)
        best = sorted((-int(v @ x), i) for i, x in ints if i != q and len(x) == 4)[:5]
        assert sorted(got[q]) == [(k + 1, s, i) for k, (s, i) in enumerate(best)]
    assert got[300] == [] and all(r["vec_id"] != 204 for r in topk_search.topk(table, F.col("vec_id") % 50 == 0).collect()) and topk_search.topk(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_url_filters(spark):
    urls = ["https://A.Example.com/en/x?q#f", "https://www.example.com/en/1", "http://b.net/es/", "http://b.net/esp", "http://net", "x", None, "", "ftp://COM/", "a://b://c/d", "http://xexample.com/en/"]
    table = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)] + [(0, urls[0], "r")], "page_id long, url string, rule string")
    got = {(r["page_id"]): (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(table, queries.URL_RULES).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3][2:] == got[4][2:] == (None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow") and got[8] == ("com", "/", "com/", "allow") and got[9][:2] == ("b:", "//c/d") and got[10][2] == "com/"
    assert url_filters.filter_urls(table, []).where("verdict = 'allow'").count() == 12 and url_filters.filter_urls(table.limit(0), queries.URL_RULES).count() == 0
    odd = [url_filters.Rule("block", "", "/p"), url_filters.Rule("block", "b.net", "/e"), url_filters.Rule("allow", "b.net", "/e")]
    assert {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(table, odd).collect()}[3] == "block"


def test_mix(docs, no_docs):
    rows = source_mix.mix_sizes(docs, block_words=64).collect()
    again = source_mix.mix_sizes(docs.repartition(5), block_words=64).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_hash"], r["taken"])
    assert [(key(r), r["target"]) for r in sorted(rows, key=key)] == [(key(r), r["target"]) for r in sorted(again, key=key)]
    assert len(rows) == len(TEXTS) and all(r["taken"] <= 3 * r["size"] for r in rows)
    sizes = Counter()
    for _, t, _, s in TEXTS:
        sizes[s] += len(WORD.findall(t or ""))
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["source_size"] == sizes[r["source"]]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s, t in target.items():
        assert t <= 3 * sizes[s] + 1e-6 and abs(taken[s] - t) <= 2 + 0.02 * t
    assert source_mix.mix_sizes(no_docs).count() == 0


def test_taken_words_are_the_mix(docs, no_docs):
    out = source_mix.take_words(docs, block_words=64)
    assert out.columns == docs.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
        assert any(" ".join(WORD.findall(r["text"])) in " ".join(WORD.findall(t or "")) for _, t, _, _ in TEXTS)
    for r in source_mix.mix_sizes(docs, block_words=64).collect():
        want[r["doc_id"]] += r["taken"]
    assert got == +want and source_mix.take_words(no_docs).count() == 0


def test_a_tiny_source_does_not_change_how_others_are_cut(spark):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(2000)), "big" if k % 2 else "also big") for k in range(40)]
    rows.append((99, "only three words", None))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = source_mix.mix_sizes(table).collect()
    target, taken = {r["source"]: r["target"] for r in mixed}, Counter()
    for r in mixed:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    runs = [len(WORD.findall(r["text"])) for r in source_mix.take_words(table).where("source is not null").collect()]
    assert sum(runs) == taken["big"] + taken["also big"] and len(runs) < 3 * len(rows)  # blocks of 2,048 words cut few documents


def test_many_sources_are_planned_in_the_cluster_alike(spark, docs):
    rng = np.random.default_rng(4)
    rows = [(k, "w " * int(n), f"s{k % 60}") for k, n in enumerate(rng.integers(0, 40, 300))] + [(900 + k, "a b c", f"t{k:02}") for k in range(37)] + [(999, "x", None)]
    for table in (docs, spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")):
        found = [Counter((r["doc_id"], r["size"], round(r["target"], 6), r["taken"]) for r in source_mix.mix_sizes(table, block_words=16, max_sources=n).collect()) for n in (100_000, 1)]
        assert found[0] == found[1]


def test_repeated_rows_are_cut_one_by_one(spark):
    rows = [(1, "a b c d e f g", "s", k % 3) for k in range(9000)] + [(2, "x y z", "t", 0)] * 30 + [(k, "p q", "t", k) for k in range(10, 50)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, other long").repartition(7)
    mixed = source_mix.mix_sizes(table).collect()
    assert Counter(r["doc_id"] for r in mixed) == Counter(r[0] for r in rows) and {r["nth"] for r in mixed if r["doc_id"] == 1} == set(range(1, 9001))
    taken, target = Counter(), {r["source"]: r["target"] for r in mixed}
    for r in mixed:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    out = [source_mix.take_words(t).groupBy("doc_id", "text", "other").count().collect() for t in (table, table.repartition(3))]
    assert Counter(out[0]) == Counter(out[1])  # reruns agree
    words = Counter()
    for r in out[0]:
        words["s" if r["doc_id"] == 1 else "t"] += r["count"] * len(WORD.findall(r["text"]))
    assert words == taken


def test_chat(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 1, None, None), (2, None, "user", "x"), (None, 1, "user", "n"), (3, 1, "user", "s"), (3, 1, "user", "s"), (-7, 0, "user", "</s>[INST] ok [/INST]")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.format_conversations(table)
    got = {r["conv_id"]: r for r in chat_format.digests(made).collect()}
    wrong = made.withColumn("segments", F.transform("segments", lambda s: F.struct(s["text"].alias("text"), (~s["loss"]).alias("loss"))))
    assert {r["conv_id"]: r["loss_sha256"] for r in chat_format.digests(wrong).collect()}[1] != got[1]["loss_sha256"]  # the mask itself is read
    assert len(got) == 5 and got[1]["valid"] and got[1]["loss_chars"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and got[1]["loss_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"user\nx\n\n\n").hexdigest() and got[3]["n_turns"] == 2 and got[3]["first_bad_turn"] == 1
    assert chat_format.format_conversations(table.limit(0)).count() == 0
    row = made.where("conv_id = 1").first()
    assert row["formatted"] == "<s>[INST]a[/INST]<ANS>b</s>" and [s["text"] for s in row["segments"] if s["loss"]] == ["b"]


def _ids(tokenizer, text):
    return np.array([*Tokenizer.from_file(tokenizer).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_packing(docs, no_docs, tokenizer):
    want = Counter(zlib.crc32(_ids(tokenizer, t).tobytes()) for _, t, _, _ in TEXTS)
    rows = packing.pack(docs.repartition(6), tokenizer, width=64, windows=2, merge_width=2).collect()
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"]
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at & (at - 1) == 0 and at <= 64
    parts = defaultdict(list)
    for r in rows:
        parts[r["doc_id"], r["doc_tokens"]].append(r)
    total = sum(r["length"] for r in rows)
    assert total == sum(len(_ids(tokenizer, t)) for _, t, _, _ in TEXTS)
    whole = Counter()
    for (doc, n), ps in parts.items():
        if sum(p["length"] for p in ps) == n:
            whole[zlib.crc32(b"".join(bytes(p["ids"]) for p in sorted(ps, key=lambda p: p["start"])))] += 1
    assert not whole - want and sum(whole.values()) == len(TEXTS) - 2  # doc 2 stands there twice
    assert packing.pack(no_docs, tokenizer).count() == 0


def test_token_files(spark, docs, no_docs, tokenizer):
    path = shared_dir(spark)
    manifest = token_files.write_token_files(docs, path, tokenizer)
    rows = token_files.read_token_files(spark, path, blocks_at_once=2).collect()
    want = sorted(((d is not None, d or 0), zlib.crc32(_ids(tokenizer, t).tobytes())) for d, t, _, _ in TEXTS)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["ids_crc32"]) for r in rows) == want
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] or 0 for r in rows] == sorted(d or 0 for d, *_ in TEXTS)
    assert [r["start"] for r in rows] == np.r_[0, np.cumsum([r["n_tokens"] for r in rows])][:-1].tolist() and sum(m["docs"] for m in manifest) == len(TEXTS)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    empty = shared_dir(spark)
    assert token_files.write_token_files(no_docs, empty, tokenizer) == [] and token_files.read_token_files(spark, empty).count() == 0


def test_secrets(spark, docs, no_docs):
    table = spark.createDataFrame([(1, "x password=abcdef y"), (2, None), (3, ""), (1, "x password=abcdef y")], "doc_id long, text string").withColumn("spans", F.lit("mine"))
    rows = {r["doc_id"]: r for r in secret_scan.scan(table).collect()}
    assert rows[1]["spans"] == "assign:2:17" and rows[1]["base_sha256"] == hashlib.sha256(b"assign:2:17").hexdigest() and rows[2]["spans"] == rows[3]["spans"] == ""
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count() and secret_scan.scan(no_docs).count() == 0
    assert [r["text"] for r in secret_scan.redact(table).orderBy("doc_id").collect()] == ["x [SECRET] y"] * 2 + [None, ""]


def _measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, no_docs):
    rows = quality_rules.judge(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter((d, *_measures(t)) for d, t, _, _ in TEXTS)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(no_docs).count() == 0


def test_bad_hosts_lose_their_documents(spark):
    good, bad = "a b c d e f g h i j k l", "short"
    rows = [(k, good if k % 20 else bad, f"h{k % 5}") for k in range(200)] + [(1000 + k, bad if k % 10 else good, "spam") for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.judge(table).collect()
    assert {r["host"] for r in got if r["n_words"] == 12 and not r["kept"]} == {"spam"}


def _shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] * bool(w))


def _brute(rows):
    """Links and groups of (id, text) rows by all pairs."""
    sets = [_shingles(t) for _, t in rows]
    links = [{j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)} for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        for i, row in enumerate(links):
            least = min([group[i], *(group[j] for j in row)])
            for j in (i, *row):
                group[j] = min(group[j], least)
    return links, group


def test_jaccard_join(spark, no_docs):
    rng = np.random.default_rng(5)
    rows = [(d, t) for d, t, _, _ in TEXTS if d is not None]
    base = [f"v{k}" for k in rng.integers(0, 400, 120)]
    for k in range(40):  # a family of near copies, and texts that share a passage
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            w[at] = f"n{k}"
        rows.append((100 + k, " ".join(w)))
        rows.append((200 + k, " ".join(base[:30] + [f"u{k}x{i}" for i in range(50)])))
    table = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, key string")
    links, group = _brute(rows)
    want = Counter((d, rows[group[i]][0] if _shingles(t) else d, len(links[i])) for i, (d, t) in enumerate(rows))
    for meeting in (512, 8, 1):
        got = ngram_join.jaccard_join(table, meeting=meeting).collect()
        assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    kept = ngram_join.keep_one(table)
    heads = {g for i, g in enumerate(group) if _shingles(rows[i][1])}
    assert kept.columns == table.columns and kept.count() == len(heads) + len({r for r in rows if not _shingles(r[1])})
    assert ngram_join.jaccard_join(no_docs).count() == 0 and ngram_join.keep_one(no_docs).count() == 0


def test_one_id_on_many_texts(spark):
    """All ids null: representatives are told apart by their texts; a large class and texts without words keep their rows."""
    base = [f"v{k}" for k in range(60)]
    texts = [" ".join([*base, f"n{k % 40}"]) for k in range(120)] + [BASE] * 700 + ["", None, " "] * 30
    table = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = Counter(r["n_links"] for r in ngram_join.jaccard_join(table).collect())
    assert got == {119: 120, 699: 700, 0: 90}
    assert ngram_join.keep_one(table).count() == 2 + 3


def test_one_id_on_two_texts(spark):
    table = spark.createDataFrame([(1, BASE), (1, LONG), (2, BASE), (2, LONG), (1, BASE)], "doc_id long, text string")
    assert sorted(r["text"] for r in ngram_join.keep_one(table).collect()) == sorted([BASE, LONG])


def test_language(spark, docs, no_docs):
    en, de = "the and of with that was for this is in it on ", "der die und nicht mit ist ein auf dem sie ich "
    rows = [(k, (en if k % 3 else de) * 4, "en" if k % 3 else "de", f"s{k % 4}.x.org") for k in range(60)]
    rows += [(100, de * 4, "en", "s1.x.org"), (101, None, "en", None), (102, "", None, "a"), (103, "123 !!", "en", "a"), (104, "ไทยภาษา " * 20, "th", "a"), (105, en, "EN-us", "b")]
    table = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, confidence string")
    got = {r["doc_id"]: r for r in language_id.identify(table).collect()}
    assert all(got[d]["lang"] == lang and got[d]["kept"] for d, _, lang, _ in rows[:60])
    assert got[100]["lang"] == "de" and got[105]["lang"] == "en" and not any(got[d]["kept"] for d in (101, 102, 103)) and got[104]["lang"] == "th"  # one labelled row is a language
    kept = language_id.keep_known(table)
    assert kept.columns == table.columns and {r["doc_id"]: r["lang"] for r in kept.collect()} == {d: got[d]["lang"] for d in got if got[d]["kept"]}
    by_url = table.withColumn("url", F.concat(F.lit("https://"), "source", F.lit("/de/1")))
    assert language_id.identify(by_url, address_col="url").count() == len(rows)
    short = spark.createDataFrame([(k, "ist was", None, f"x{k % 9}.{('de', 'com')[k % 2]}") for k in range(40)] + [(100 + k, de * 3, "de", f"y{k}.de") for k in range(40)] + [(200 + k, en * 3, "en", f"y{k}.com") for k in range(40)], "doc_id long, text string, lang string, source string")
    by_suffix = {r["doc_id"]: r for r in language_id.identify(short).collect()}
    assert by_suffix[0]["confidence"] != by_suffix[1]["confidence"]  # the same text under another suffix
    assert language_id.identify(no_docs).count() == 0 and language_id.identify(docs).count() == len(TEXTS)


def test_rare_language_of_a_large_table_is_known(spark):
    en, de, fr = "the and of with that was for this is in it on ", "der die und nicht mit ist ein auf dem sie ich ", "le la les des une est dans pour que qui sur avec "
    rows = [(k, en * (1 + k % 4), "en", "a") for k in range(3000)] + [(5000 + k, de * (1 + k % 4), "de", "a") for k in range(6)] + [(6000, fr, "fr", "b")] * 1500 + [(7000 + k, fr + "z", "xx", "c") for k in range(4)] + [(8000, "?", "unknown", None), (8001, en, "EN-gb", "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language_id.fit(table, sample_rows=200, id_col="doc_id").languages == ["de", "en", "fr", "xx"]
    assert language_id.fit(table, sample_rows=200, id_col="doc_id", min_rows=5).languages == ["de", "en", "fr"]
    kept = language_id.keep_known(table.where("lang <> 'fr'"), sample_rows=200)
    assert kept.where("lang = 'de' and doc_id between 5000 and 5005").count() == 6


def test_few_rows_of_a_language_stay(spark):
    en, pt = "the and of with that was for this is in it on ", "que não uma para com mais como mas foi ao ele das "
    rows = [(k, en * (2 + k % 5), "en", "a") for k in range(200)] + [(500 + k, pt * (2 + k), "pt", "b") for k in range(4)]
    kept = {r["doc_id"]: r["lang"] for r in language_id.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(kept) == 204 and all(kept[500 + k] == "pt" for k in range(4))


def test_posterior_is_the_sum_of_the_evidence(spark):
    """Recomputed from the counts of all documents, one after the other."""
    rng = np.random.default_rng(8)
    words = {"en": "the and of with that was for this is".split(), "de": "der die und nicht mit ist ein auf".split()}
    rows = [(k, " ".join(rng.choice(words[lang], 1 + k % 9)), lang if k % 4 else None, f"h{k % 5}.{('org', 'com')[k % 2]}.net" if k % 6 else None) for k in range(90) for lang in [("en", "de")[k % 3 == 0]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    profiles = language_id.fit(table, id_col="doc_id")
    got = {r["doc_id"]: r for r in language_id.identify(table, profiles).collect()}
    models = [*profiles.languages, "und"]
    ll, top = {}, {}
    for d, text, _, _ in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        mean, grams = profiles.scores(raw, np.array([0, len(raw)]))
        ll[d] = mean[0] * min(int(grams[0]), language_id.EFFECTIVE)
        top[d] = len(models) - 1 if not grams[0] else int(ll[d].argmax())
    total = Counter(top.values())
    code, suffix, own, above = (defaultdict(Counter) for _ in range(4))
    for d, _, lang, host in rows:
        code[lang or "none"][top[d]] += 1
        suffix["net" if host else "none"][top[d]] += 1
        own[host][top[d]] += 1
        above[host and host.split(".", 1)[1]][top[d]] += 1
    n, m = len(rows), len(models)
    for d, _, lang, host in rows:
        post = []
        for k in range(m):
            everywhere = (total[k] + 1) / (n + m)
            up = host and host.split(".", 1)[1]
            parent = (above[up][k] + 20 * everywhere) / (sum(above[up].values()) + 20) if host else everywhere
            prior = (own[host][k] + 20 * parent) / (sum(own[host].values()) + 20)
            post.append(ll[d][k] + np.log(prior) + np.log((code[lang or "none"][k] + 1) / (total[k] + m + 1)) + np.log((suffix["net" if host else "none"][k] + 1) / (total[k] + 50)))
        post = np.array(post)
        if int(top[d]) < m - 1:
            assert got[d]["lang"] == models[int(post.argmax())] and got[d]["confidence"] == pytest.approx(1 / np.exp(post - post.max()).sum())


def test_held_out_language(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language_id.fit(rows.where("doc_id % 2 = 0"), sample_rows=300)
    got = language_id.identify(rows.where("doc_id % 2 = 1"), profiles, declared_col=None, host_col=None).join(rows.select("doc_id", F.col("lang").alias("said")), "doc_id")
    assert got.where("text_lang = said").count() >= 0.98 * got.count()


def test_pipeline(spark, docs, tokenizer):
    """Each stage against a plain recomputation of its own input."""
    stages, columns = dict(corpus_pipeline.STAGES), ["doc_id", "text", "lang", "source", "n_chars"]
    more = [(100 + k, BASE.replace("cat", f"cat{k % 3}") + f" token: abcdef{k}" + " and so it was with the old town by the sea" * (1 + k % 4), "en", f"s{k % 3}", 1) for k in range(30)]
    begin = docs.select(*columns).unionByName(spark.createDataFrame(more, docs.select(*columns).schema))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)

    known = stages["language"](spark, begin, "")
    said = {(r["doc_id"], r["text_hash"]): r for r in language_id.identify(begin).collect()}
    hashed = begin.withColumn("h", F.xxhash64("text")).collect()
    assert rows(known) == sorted(((r["doc_id"], r["text"], said[r["doc_id"], r["h"]]["lang"], r["source"], r["n_chars"]) for r in hashed if said[r["doc_id"], r["h"]]["kept"]), key=str)

    single = stages["near_duplicates"](spark, known, "")
    before = [(r["doc_id"], r["text"]) for r in known.collect()]
    groups, left = _brute(before)[1], Counter((r["doc_id"], r["text"]) for r in single.collect())
    heads = Counter(min(((d is None, d or 0, t) for (d, t), g in zip(before, groups) if g == head), key=lambda x: x[:2])[:2] for head in {g for g, (_, t) in zip(groups, before) if _shingles(t)})
    assert Counter((d is None, d or 0) for d, t in left.elements() if _shingles(t)) == heads and not left - Counter(before)

    masked = stages["secrets"](spark, single, "")
    tool = secret_scan.default_scanner()
    clean = lambda t: secret_scan.masked(t, tool.spans(t), "[SECRET]") if t else t
    assert rows(masked) == sorted(((r["doc_id"], clean(r["text"]), r["lang"], r["source"], None if r["text"] is None else len(clean(r["text"]))) for r in single.collect()), key=str)
    assert "token: abcdef" not in str(rows(masked)) and "[SECRET]" in str(rows(masked))

    mixed = stages["mix"](spark, masked, "")
    texts, taken = {r["doc_id"]: r["text"] for r in masked.collect()}, Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert " ".join(WORD.findall(r["text"])) in " ".join(WORD.findall(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    want = Counter()
    for r in source_mix.mix_sizes(masked).collect():
        want[r["doc_id"]] += r["taken"]
    assert taken == +want and all(df.columns == columns for df in (known, single, masked, mixed))

    packed = stages["pack"](spark, mixed, "").collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in packed)
    assert sum(r["length"] for r in packed) == sum(len(_ids(tokenizer, r["text"])) for r in mixed.collect())
    whole = Counter(bytes(r["ids"]) for r in packed if r["length"] == r["doc_tokens"])
    assert not whole - Counter(_ids(tokenizer, r["text"]).tobytes() for r in mixed.collect())


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {*queries.QUERIES, "pipeline", "extract_pages"} <= names and set(entry.oracle_sql()) <= names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_components_with_hubs(spark, monkeypatch):
    from pagemill.llm import _graph

    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 1005), (7000, 7001)] + [(8000 + k, 8500) for k in range(200)]
    table = spark.createDataFrame(edges, "u long, v long")
    want = {k: 0 for k in range(300)} | {1000 + k: 1000 for k in range(41)} | {5000: 1000, 7000: 7000, 7001: 7000, 8500: 8000} | {8000 + k: 8000 for k in range(200)}
    for few in (_graph.FEW, 100):
        monkeypatch.setattr(_graph, "FEW", few)
        assert {r["node"]: r["root"] for r in _graph.components(table).collect()} == want
