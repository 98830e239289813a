"""Operators against brute force on small tables, with null, empty, repeated and clashing input."""

import hashlib
import math
import random
import re
import weakref
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from patrika.llm import decontaminate, jaccard_join, lexical, line_dedup, merkle, mixing, neighbours, quality, suffix_dedup, textarrays, tokens, toxicity, urls, warc
from patrika.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None, extra=""):
    rows = [(i, t, "s") for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = queries()[name](spark, DATA), con.sql(oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(repr([r[c] for c in order]) for r in got.collect()) == sorted(repr([r[want.columns.index(c)] for c in order]) for r in want.fetchall())


def test_every_query_takes_empty_tables(spark, tmp_path):
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# -- 1 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, tmp_path, compression):
    warc.register(spark)
    rows = [("urn:a", "response", "http://a/", "x" * 70_000), ("urn:b", "revisit", "http://b/\r\nX: y", ""), ("urn:c", "response", None, "é\r\n\r\nz"), ("urn:d", "metadata", "http://d/", None)]
    df = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, payload string").withColumn("payload", F.col("payload").cast("binary"))
    df.coalesce(2).write.format("warc").mode("append").option("compression", compression).save(str(tmp_path))
    back = spark.read.format("warc").option("digest", "true").load(str(tmp_path))
    got = {r["record_id"]: r for r in back.filter(F.col("record_type").isin("response", "metadata")).collect()}
    assert set(got) == {"urn:a", "urn:c", "urn:d"} and bytes(got["urn:a"]["payload"]) == b"x" * 70_000
    assert bytes(got["urn:c"]["payload"]).decode() == "é\r\n\r\nz" and got["urn:c"]["payload_sha1"] == warc.base32_sha1("é\r\n\r\nz".encode())
    assert [r["record_id"] for r in back.filter("target_uri like 'http://b%'").collect()] == ["urn:b"]
    assert back.filter("record_type = 'warcinfo'").count() >= 1


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_headers_keep_other_line_ends(spark, tmp_path, compression):
    warc.register(spark)
    urls_ = ["http://a/\u2028Content-Length: 45", "http://b/\u0085WARC-Payload-Digest: sha1:EVIL", "http://c/\u2029X: y", "http://d/\x0b\x1c"]
    df = spark.createDataFrame([(f"urn:{i}", "response", u, b"x" * 22) for i, u in enumerate(urls_)], "record_id string, record_type string, target_uri string, payload binary")
    df.coalesce(1).write.format("warc").mode("append").option("compression", compression).save(str(tmp_path))
    back = spark.read.format("warc").option("digest", "true").load(str(tmp_path)).filter("record_type = 'response'").collect()
    assert len(back) == 4 and all(bytes(r["payload"]) == b"x" * 22 and r["payload_digest"] == r["payload_sha1"] == warc.base32_sha1(b"x" * 22) for r in back)
    head = warc._parse("WARC/1.1\r\nWARC-Target-URI: http://a/\u2028B: c\u0085D: e\r\nContent-Length: 3".encode())
    assert head == {"warc-target-uri": "http://a/\u2028B: c\u0085D: e", "content-length": "3"}


def test_warc_ties_and_repeated_rows(spark):
    rows = [(1, "http://a", "same", "p"), (1, "http://a", "same", "p"), (2, "http://b", "same", "q"), (2, "http://c", "same", "q"), (2, "http://c", "other", "q")]
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.digest(spark.createDataFrame(rows, "page_id long, url string, html string, payload string")).collect())
    assert got == Counter({(1, 4, "revisit", 2): 2, (2, 4, "response", None): 2, (2, 5, "response", None): 1})


def test_warc_digest_edges(spark):
    pages = spark.createDataFrame([(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (None, "http://d", "")], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.digest(pages).collect()), key=str)
    assert got == [(1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "response", None), (None, 0, "revisit", 3)]


# -- 2 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("with_bytes", [True, False])
def test_tokens_are_those_of_the_library(with_bytes):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokens.vocabulary()
    if not with_bytes:
        pieces = [("<unk>", 0.0), *((p, -float(len(pieces) % (i + 2))) for i, (p, _) in enumerate(pieces[259:3000]))]
    exact = Tokenizer(models.Unigram(pieces, 0, with_bytes))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter, rng = tokens.Counter(pieces), random.Random(5)
    parts = ["a", "b", " ", "▁", "  ", "é", "日", "😀", "<s>", "<0x41>", "<unk>", "\n", "th", "The", " the", "ing", "0", "\x00", "ß"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert counter.count(text) == len(exact.encode(text).ids), repr(text)


def test_token_counts_of_whole_documents(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokens.vocabulary()
    exact = Tokenizer(models.Unigram(pieces, 0, True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r["doc_id"]: (len(r["text"]), len(exact.encode(r["text"]).ids)) for r in docs.collect()}
    assert {r["doc_id"]: (r["n_chars"], r["n_tokens"]) for r in queries()["op2_token_counts"](spark, DATA).collect()} == want


def test_tokens_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, n_tokens int")
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()} == {1: 2, 2: 0, 3: 0}


# -- 3 ----------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(1000, None, "z"), (None, "x y", "a"), (3, "x", "a"), (3, "x", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(repr, mixing.mix(df.repartition(n)).select("doc_id", "source", "size", "target", "taken").collect())) for n in (1, 7))
    assert one == two and len(one) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, target, capped, total = {s: 1 + i % 3 for i, s in enumerate(order)}, {}, set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in mixing.mix(df).collect():
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 61 for s in order)


# -- 4 ----------------------------------------------------------------------------------------------------------------


def test_quality_statistics(spark):
    rng = random.Random(6)
    texts = ["\n".join(" ".join(rng.choice(["a", "bé", "#x", "日本", "c<>"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    texts += [None, "", " \n \t", "one two three " * 40, "x" * 3000, "same line here\n" * 5]
    got = {r["doc_id"]: r for r in quality.digest(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = WORD.findall(t)
        seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        rep = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, repr(t)
        assert r["base_failed"] == (len(words) < 20 or 100 * len(rep) > 30 * len(words)) and not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize(("accuracy", "random_rules"), [(0.8, 0), (0.7, 0), (0.8, 1)])
def test_quality_fit_on_planted_votes(accuracy, random_rules):
    rng, n = np.random.default_rng(5), 100_000
    good = rng.random(n) < 0.8
    right = [0.5 if r < random_rules else accuracy for r in range(8)]
    votes = np.stack([np.where(rng.random(n) < 0.7, np.where(good == (rng.random(n) < p), 1, -1), 0) for p in right], 1)
    patterns, row, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    f = quality.fit(patterns, counts.astype(float))
    assert np.diff(f.objective).min() >= -1e-6 * abs(f.objective[-1])  # it never falls
    assert np.abs(f.bad_on_bad - right).max() < 0.03 and np.abs(1 - f.bad_on_good - right).max() < 0.03 and abs(f.good - 0.8) < 0.02
    share = lambda said: (said == good).mean()
    assert share(f.posterior[row.ravel()] >= 0.5) >= share(votes.sum(1) >= 0)
    # by brute force: the posterior that Bayes' rule gives with the true shares
    ratio = np.log(0.8 / 0.2) + (patterns * np.log(np.array(right) / (1 - np.array(right)))).sum(1)
    assert np.average(np.abs(f.posterior - 1 / (1 + np.exp(-ratio))), weights=counts) < 0.02


def test_quality_model_finds_junk(spark):
    d = "/root/testdata/sf0.01"
    r = quality.digest(spark.read.parquet(f"{d}/documents.parquet")).withColumnRenamed("quality", "post").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert np.mean([x["kept"] == (x["quality"] == 1) for x in r]) > 0.97


# -- 5 ----------------------------------------------------------------------------------------------------------------


def _removed(rows, width):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        off = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            off[i : i + width] |= b[i : i + width] in seen
            seen.add(b[i : i + width])
        kept = np.frombuffer(b, np.uint8)[~off].tobytes()
        out[doc] = (len(b), int(off.sum()), int((np.diff(np.concatenate([[0], off])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("sample", "often"), [(64, 24), (1, 3)])
def test_suffix_dedup(spark, monkeypatch, sample, often):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 8000)
    rng = random.Random(3)
    letters = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    base = [letters("abcdé \n", rng.randint(90, 400)) for _ in range(10)]
    texts = [None, "", "ab" * 300, "q" * 500, "q" * 99]
    for _ in range(150):
        part = rng.choice(base)
        texts.append(rng.choice([part, letters("xyz ", 150), letters("xyz ", 70) + part[rng.randint(0, 40) : rng.randint(60, 400)] + "q" * rng.randint(0, 200) + rng.choice(base)]))
    ids = list(range(0, 3 * len(texts), 3))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(frame(spark, texts, ids)).collect()}
    assert got == _removed(list(zip(ids, texts, strict=True)), 100)


def test_suffix_dedup_within_one_span(spark):
    rng = random.Random(5)
    sentence = "".join(rng.choice("abcdefgh ") for _ in range(60))
    texts = ["q" * 150, "same line here\n" * 10, sentence * 3, "Eran. " * 23, "-" * 227, "ab" * 242, "ijklmnop" * 60 + "qrs"]
    for text in texts:
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(frame(spark, [text])).collect()}
        assert got == _removed([(0, text)], 100)
        assert got[0][1] > 0
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(frame(spark, texts + texts[:2])).collect()}
    assert got == _removed(list(enumerate(texts + texts[:2])), 100)


def test_previous_factors():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))
        order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
        common = lambda a, b: next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]), 0)
        prefix = np.array([0] + [common(a, b) for a, b in zip(order[:-1], order[1:], strict=True)])
        got = suffix_dedup.previous_factors(order, prefix)
        assert got.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in order.tolist()]


# -- 6 ----------------------------------------------------------------------------------------------------------------


def test_decontamination_finds_paraphrases(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    pool = [word() for _ in range(4000)]
    items = [[rng.choice(pool) for _ in range(rng.randint(15, 60))] for _ in range(30)]
    texts, want = [None, "", " "], set()
    for k in range(400):
        words = [rng.choice(pool) for _ in range(rng.randint(5, 500))]
        if k % 8 == 0:
            n = rng.randrange(30)
            leak = [w if rng.random() > 0.12 else rng.choice(pool) for w in items[n]]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," if rng.random() < 0.2 else w for w in leak]
            want.add((len(texts), n))
        texts.append(" ".join(words))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
    assert got == want
    assert decontaminate.without_leaks(frame(spark, texts), bench).count() == len(texts) - len(want)


@pytest.mark.parametrize("kept", [1.0, 0.7])
def test_decontamination_finds_an_item_that_a_third_of_short_texts_hold(spark, kept):
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    items = [[*rng.sample(words, 20)] for _ in range(12)]
    texts, want = [], set()
    for d in range(360):
        text = rng.sample(words, 60)
        if d % 3 == 0:
            text[20:40] = [w if (i + d // 3) % 10 < 10 * kept else rng.choice(words) for i, w in enumerate(items[0])]
            want.add((d, 0))
        texts.append(" ".join(text))
    bench = spark.createDataFrame([(i, " ".join(w), " ".join(w)) for i, w in enumerate(items)], "item_id long, text string, whole string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, texts), bench, answer_col="whole").collect()} == want


def test_decontamination_is_alike_at_every_size():
    rng = np.random.default_rng(4)
    words = np.sort(rng.integers(1, 2**63, 400).astype(np.uint64))
    items = [rng.choice(400, 20, replace=False) for _ in range(12)]
    share, latent = 10.0 ** rng.uniform(-4, -1, len(words)), rng.standard_normal((400, 16)) / 4
    margins = []
    for total in (250_000, 2_500_000, 300_000_000):
        weight = np.log((1 + total) / (1 + share * total)) + 1
        vectors, part = (weight[:, None] * latent).astype(np.float32), share / share.sum()
        level = decontaminate.thresholds([vectors[i] for i in items], [weight[i] ** 2 for i in items], part @ vectors, float(part @ weight**2), 0.5, 0.6)
        for i, least in zip(items, level, strict=True):  # passages of the item's twelve lightest words among average ones
            light = i[np.argsort(-share[i])[:12]]
            more = rng.choice(400, (200, 20), p=part)
            others, q = vectors[more].sum(1) + vectors[light].sum(0), vectors[i].sum(0)
            cosine = others @ q / np.sqrt((weight[more] ** 2).sum(1) + (weight[light] ** 2).sum()) / np.linalg.norm(q)
            margins.append((cosine >= least).mean())
    assert np.reshape(margins, (3, -1)).mean(1).min() > 0.9


def _leaks_by_brute_force(docs, items):
    """Pairs of document and item with a stretch of text that holds enough of the item's words in order."""
    from patrika.llm.textarrays import blocks

    def words(texts):
        out = []
        for b in map(decontaminate._plain, blocks(pa.array(texts, pa.large_string()))):
            out += np.split(b.word_hashes(), np.cumsum(b.n_words)[:-1])
        return out

    found = set()
    pool = words(items.values())
    for doc, h in zip(docs, words(docs.values()), strict=True):
        for item, w in zip(items, pool, strict=True):
            n, inside = len(w), np.concatenate([[0], np.cumsum(np.isin(h, w))])
            for lo in range(0, len(h), 16):
                a, e = max(0, lo - n), min(len(h), lo + 32 + n)
                if inside[e] - inside[a] >= 0.6 * n and np.isin(w, h[a:e]).mean() >= 0.6 and decontaminate.common_words(w, h[a:e]).mean() >= 0.6:
                    found.add((doc, item))
                    break
    return found


def test_decontamination_against_a_full_search(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    want = _leaks_by_brute_force({r["doc_id"]: r["text"] for r in docs.collect()}, {r["item_id"]: r["text"] for r in bench.collect()})
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, answer=0.0).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 20
    assert min(decontaminate.DIMENSIONS, bench.count() // 2) < bench.count()


def test_the_latent_search_names_the_candidates(spark):
    """Without the cosine there are many times as many candidates (9.5 times here, 15 times on ten times the documents), and
    the same leaks."""
    data = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    found = lambda **o: {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, **o).collect()}
    assert decontaminate.candidates(docs, bench, cosine=-9.0).count() > 8 * decontaminate.candidates(docs, bench).count() > 0
    assert found() == found(cosine=-9.0) and len(found()) > 20


def test_latent_space_finds_what_words_alone_miss(spark):
    rng = random.Random(23)
    word = lambda n: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(n))
    common, topics = [word(2) for _ in range(60)], [[(word(4), word(4)) for _ in range(12)] for _ in range(20)]
    said = lambda topic, n: [rng.choice(rng.choice(topic)) for _ in range(n)]  # noqa: E731  either of two words for a thing
    texts = [" ".join(rng.sample(common, 16) + said(rng.choice(topics), 16)) for _ in range(3000)]
    plain = rng.sample(common, 12)
    item = plain + [a for a, _ in topics[0][:8]]
    texts.append(" ".join(plain + [b for _, b in topics[0][:8]] + said(topics[0], 12)))  # the item in other words
    df = frame(spark, texts)
    sample = df.select(F.col("text").cast("binary")).mapInArrow(decontaminate._some_passages(1.0), "words binary").cache()
    words = {w: int(h) for t in texts for w, h in zip(t.split(), np.concatenate([decontaminate._plain(b).word_hashes() for b in _blocks(t)]), strict=True)}
    known = np.array(sorted(set(words.values())), np.uint64)
    n = Counter(words[w] for t in texts for w in set(t.split()))
    space = decontaminate._space(sample, known, known, np.array([n[int(k)] for k in known], float), len(texts), 32 * len(texts), 24)
    hashes = lambda ws: np.array([words[w] for w in ws], np.uint64)
    q, squares = space.of(hashes(item)), lambda ws: space.squares[np.searchsorted(known, hashes(ws))]
    level = decontaminate.thresholds([q], [squares(item)], space.mean, space.square, 0.5, 0.6)[0]
    idf = {w: np.log((1 + len(texts)) / (1 + n[h])) + 1 for w, h in words.items()}

    def plain_cosine(a, b):
        a, b = Counter(a), Counter(b)
        dot = sum(a[w] * b[w] * idf[w] ** 2 for w in a)
        return dot / np.sqrt(sum((a[w] * idf[w]) ** 2 for w in a) * sum((b[w] * idf[w]) ** 2 for w in b))

    def latent_cosine(t):
        p = space.of(hashes(t)).sum(0)
        return float(p @ q.sum(0) / np.sqrt(squares(t).sum()) / np.linalg.norm(q.sum(0)))

    others = [t.split() for t in texts[:-1]]
    leak = texts[-1].split()
    # by words alone, passages that merely share common ones come first; in the latent space few do
    ahead = sum(plain_cosine(item, t) >= plain_cosine(item, leak) for t in others), sum(latent_cosine(t) >= latent_cosine(leak) for t in others)
    assert latent_cosine(leak) >= level and ahead[1] < ahead[0]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, spark.createDataFrame([(7, " ".join(item), " ".join(plain))], "item_id long, text string, answer string"), answer_col="answer").collect()}
    assert (len(texts) - 1, 7) in found


def _blocks(text):
    from patrika.llm.textarrays import blocks

    return list(blocks(pa.array([text], pa.large_string())))


def test_common_words():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = (rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontaminate.common_words(a, b).sum() == row[-1]


# -- 7 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("leaf", "block"), [(1024, 256), (3, 2)])
def test_jaccard_join(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(9)
    texts = [None, "", " \n", "one two", "one two", "one  two", "a b c d e"]
    for _ in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(300)}"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links, label = Counter(), list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(frame(spark, texts)).collect()}
    assert got == {i: (label[i], links[i]) for i in range(len(texts))}
    kept = {r["doc_id"] for r in jaccard_join.keep_first(frame(spark, texts)).collect()}
    assert kept == {i for i in range(len(texts)) if label[i] == i}


@pytest.mark.parametrize("similarity", [0.5, 0.65])
def test_jaccard_join_at_lower_similarities(spark, similarity):
    rng = random.Random(8)
    texts = []
    for g in range(150):  # pairs of 100 words each that share just enough
        shared = next(n for n in range(101) if n >= similarity * (200 - n))
        both = [f"g{g}w{i}" for i in range(shared)]
        for side in "ab":
            words = both + [f"g{g}{side}{i}" for i in range(100 - shared)]
            texts.append(" ".join(rng.sample(words, len(words))))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(frame(spark, texts), 1, similarity).collect()}
    assert got == {i: (i - i % 2, 1) for i in range(len(texts))}


def test_jaccard_join_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = a.replace("a59", "z")
    rows = [(5, a, 1), (5, b, 2), (6, near, 3), (None, b, 4), (5, a, 5), (7, " ", 6), (7, " ", 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(df).collect())
    # the rows of 5 with text a meet each other and 6; that with b meets the null id, which is the smallest
    assert got == Counter({(5, 5, 2): 2, (6, 5, 2): 1, (5, None, 1): 1, (None, None, 1): 1, (7, 7, 0): 2, (None, None, 0): 1})
    kept = [r["n"] for r in jaccard_join.keep_first(df).collect()]
    assert sorted(kept)[-4:] == [4, 6, 7, 8] and len(kept) == 5 and set(kept) & {1, 5}


def test_jaccard_join_of_a_template(spark):
    shared = [f"t{i}" for i in range(80)]
    texts = [" ".join(shared[:40] + [f"u{d}x{i}" for i in range(16)] + shared[40:]) for d in range(3000)]
    texts += [t.replace("x3", "y") for t in texts[:5]]  # five near copies among them
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(frame(spark, texts)).collect()}
    assert got == {d: (d % 3000 if d >= 3000 or d < 5 else d, int(d >= 3000 or d < 5)) for d in range(3005)}
    reps = frame(spark, texts).select("doc_id", F.lit(0).cast("long"), F.col("text").cast("binary")).mapInArrow(jaccard_join._sketch(5), "id long, tie long, k1 long, k2 long, size long, sig binary, bins binary, fine binary")
    # no loose group is tied together, so nothing but the copies is compared exactly
    assert jaccard_join.candidates(reps.withColumnRenamed("id", "node").select("node", "size", "sig", "bins")).distinct().count() < 50


def test_jaccard_join_of_a_long_template(spark, monkeypatch):
    """Long texts of one template, 0.756 alike: fine bins part them, so only the copies among them are compared exactly."""
    template, compared, in_blocks = [f"t{i}" for i in range(3000)], {}, jaccard_join._in_blocks

    def noted(members, columns):
        compared[columns[-1]] = members.count()
        return in_blocks(members, columns)

    monkeypatch.setattr(jaccard_join, "_in_blocks", noted)
    monkeypatch.setattr(jaccard_join, "FINE_BLOCK", 200)
    own = lambda d, n: [f"u{d}x{i}" for i in range(n)]
    texts = [" ".join(template[:1292] + own(d, 417) + template[1709:]) for d in range(300)]
    texts += [" ".join(template[:1292] + own(d, 417) + template[1709:2990]) for d in range(150)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(frame(spark, texts)).collect()}
    assert got == {d: (d % 300, int(d % 300 < 150)) for d in range(450)}
    assert compared == {"fine": 450, "hashes": 300}


def test_bins_rule_out_no_link():
    rng = np.random.default_rng(2)
    for size in (20, 300, 3000):
        for similarity in (0.5, 0.8):
            shared = int(np.ceil(similarity * 2 * size / (1 + similarity)))
            for _ in range(200):
                h = np.unique(rng.integers(0, 2**64, 2 * size, dtype=np.uint64))
                both = [np.sort(np.concatenate([h[::2][: shared], h[1::2][k : k + size - shared]])) for k in (0, size - shared)] if size > shared else [np.sort(h[:size])] * 2
                both = [x if len(x) == size else np.sort(h[:size]) for x in both]
                many = [jaccard_join.BINS, jaccard_join.FINE][_ % 2]
                bins = [jaccard_join.bins_of(x, np.array([len(x)]), many) for x in both]
                n = len(np.intersect1d(*both))
                if n >= similarity * (2 * size - n):
                    assert jaccard_join.may_link(*bins, np.array([size]), np.array([size]), similarity, jaccard_join.RECALL)[0]


# -- 8 ----------------------------------------------------------------------------------------------------------------


def test_line_dedup_edges(spark):
    line = "  A line that is long enough "
    df = spark.createDataFrame([(1, line + "\nown", 5), (2, line.lower() + "\n" + line, 6), (3, line, 7), (4, None, 8), (None, "", 9)], "doc_id long, text string, n_lines int")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: ("own", 2, 1), 2: ("", 2, 2), 3: (line, 1, 0), 4: ("", 1, 0), None: ("", 1, 0)}


# -- 9 ----------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.digest(docs.join(labels.select("doc_id"), "doc_id"), labels).join(labels, "doc_id").filter("held_out").select("doc_id", "score", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 and x["predicted"] == int(x["score"] >= 0.5) for x in r)
    assert np.mean([x["predicted"] == x["toxic"] for x in r]) > 0.97


def test_toxicity_matching():
    m = toxicity.Matcher({" trash ": 2.0, " idiot ": 3.0}, ("trash can",))
    assert m.weigh("an 1d1оt!")[:2] == (3.0, 1) and m.weigh("trash can")[:2] == (0, 0) and m.weigh("trash, idiot")[:2] == (5.0, 2) and m.weigh(None) == (0, 0, 0)


def test_toxicity_exceptions_are_learned(spark):
    rng = random.Random(3)
    plain = lambda: [rng.choice("one two three four five six seven eight".split()) for _ in range(8)]
    texts = [" ".join(plain() + ["trash", "can"] + plain()) for _ in range(12)] + [" ".join(plain()) for _ in range(200)] + [" ".join(plain() + ["you", "trash"] + plain()) for _ in range(100)]
    rows = frame(spark, texts).select("text", (F.col("doc_id") >= 212).cast("int").alias("toxic"))
    lexicon = toxicity.learn_lexicon(rows)
    found = toxicity.learn_exceptions(rows, lexicon)
    assert " trash " in lexicon and found[0] == "trash can" and "you trash" not in found
    m = toxicity.Matcher(lexicon, found)
    assert m.weigh("a trash can")[1] == 0 and m.weigh("you trash")[1] > 0


# -- 10 ---------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rules = dict(urls.RULES)

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-2, "no scheme"), (-3, "http://A.NET"), (-4, "x://Sub.Example.net/en/a?b://c/d"), (-5, "http://example.com/de/#f"), (-6, "http://notnet/"), (-7, "http://a.org\n/fr/")]
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    given = {r["page_id"]: r["url"] for r in pages.collect()}
    judged = urls.judge(pages).collect()
    labelled = []
    for r in judged:
        host, path = parts(given[r["page_id"]])
        fits = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == rules[rule] if rule else r["verdict"] in ("allow", "block")
    # mined rules hold what plain counting says
    u = F.col("url")
    toks = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", urls.url_tokens(u, urls.host_of(u), urls.path_of(u)).alias("t")).collect()}
    labelled = [(toks[r["page_id"]], r["verdict"]) for r in judged if r["rule"] and toks[r["page_id"]]]
    for r in judged:
        if r["rule_tokens"]:
            need = set(r["rule_tokens"])
            hit = [v for t, v in labelled if need <= t]
            assert need <= toks[r["page_id"]] and hit.count(r["verdict"]) >= 0.8 * len(hit) > 0


def test_urls_mining_against_plain_counting(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        kind = rng.randrange(4)
        host = rng.choice(["a.b.c.d.e.shop.com", "news.org", "x.deep.org"])
        path = "/" + "/".join(rng.choice(["one", "two", "spam" if kind == 0 else "ham"]) for _ in range(4))
        rows.append((i, f"http://{host}{path}/?{rng.choice(['p', 'q'])}=1&{'bad' if kind == 1 else 'ok'}=2", "block" if kind < 2 and rng.random() < 0.97 else "allow"))
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    u = F.col("url")
    toks = {r["page_id"]: tuple(r["t"]) for r in pages.select("page_id", urls.url_tokens(u, urls.host_of(u), urls.path_of(u)).alias("t")).collect()}
    assert {"query=bad", "query=ok"} & set(toks[0]) and any(t.startswith("host6=") for v in toks.values() for t in v)
    said = {r[0]: r[2] for r in rows}
    labelled = pages.select("verdict", urls.url_tokens(u, urls.host_of(u), urls.path_of(u)).alias("tokens"), F.lit(0).alias("_salt"))
    got = {(tuple(r["tokens"]), r["verdict"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in urls.mine(labelled, 0.05, 0.8).collect()}
    count = Counter()
    for i, t in toks.items():
        for k in range(1, 1 << len(t)):
            combo = tuple(x for j, x in enumerate(t) if k >> j & 1)
            count[combo, said[i]] += 1
    rules = {}
    for (combo, verdict), n in count.items():
        total = count[combo, "block"] + count[combo, "allow"]
        if n >= 0.05 * len(rows) and n >= 0.8 * total:
            rules[combo, verdict] = (round(n / total, 9), round(n / len(rows), 9))
    want = {(c, v): x for (c, v), x in rules.items() if len(c) <= urls.LONGEST and not any(rules.get((tuple(t for t in c if t != o), v), (-1,))[0] >= x[0] for o in c)}
    assert got == want and len(want) > 3
    # the best rule for each page
    judged = {r["page_id"]: r for r in urls.judge(pages.select("page_id", "url"), pages.select("page_id", "verdict"), (), 0.05, 0.8).collect()}
    for i, t in toks.items():
        fits = [(x[0], x[1], len(c), v == "block", list(c), v) for (c, v), x in want.items() if set(c) <= set(t)]
        assert judged[i]["verdict"] == (max(fits)[-1] if fits else "allow") and judged[i]["rule_tokens"] == (max(fits)[4] if fits else None)


@pytest.mark.parametrize("whole", [12, 4])
def test_urls_of_many_tokens(spark, monkeypatch, whole):
    monkeypatch.setattr(urls, "WHOLE", whole)
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        path = ["a" if a else "x", "b" if b else "y", *(f"always{k}" for k in range(10)), rng.choice(["m", "n"]), *(f"t{k}" for k in range(14 if i == 7 else 3))]
        rng.shuffle(path)
        rows.append((i, "http://host/" + "/".join(path), "block" if a == b else "allow"))
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    judged = urls.judge(pages.select("page_id", "url"), pages.select("page_id", "verdict"), (), 0.15, 0.9).collect()
    assert {r["page_id"]: r["verdict"] for r in judged} == {i: v for i, _, v in rows}
    assert all(set(r["rule_tokens"]) <= {f"path={x}" for x in "abxy"} for r in judged)


def test_urls_longest_rules_and_ties(spark):
    rules = (("a.org/x/", "block"), ("b.org/y/", "allow"), ("org/x/yy", "allow"), ("org/x/zz", "block"))
    pages = spark.createDataFrame([(1, "http://a.org/x/yy"), (2, "http://b.org/x/yy"), (3, "http://a.org/x/zz"), (4, "http://c.org/x/zz/yy"), (5, "http://b.org/y/"), (6, None)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, rules=rules).collect()}
    # equally long rules: the later by text
    assert got == {1: ("org/x/yy", "allow"), 2: ("org/x/yy", "allow"), 3: ("org/x/zz", "block"), 4: ("org/x/zz", "block"), 5: ("b.org/y/", "allow"), 6: (None, "allow")}


# -- all --------------------------------------------------------------------------------------------------------------


def test_very_long_texts(spark):
    rng = np.random.default_rng(6)
    letters = rng.integers(97, 123, 5 << 20).astype(np.uint8)
    word = letters.tobytes().decode()
    letters[rng.random(len(letters)) < 0.15] = 32
    line = letters.tobytes().decode()
    n = len(line.split())
    docs = spark.createDataFrame([(1, word[: 1 << 20], "a"), (2, line, "a"), (3, line, "b"), (4, "short", "b"), (5, None, None)], "doc_id long, text string, source string").repartition(2)
    assert {r["doc_id"]: r["n_words"] for r in quality.digest(docs).collect()} == {1: 1, 2: n, 3: n, 4: 1, 5: 0}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digest(docs).collect()}
    assert got[3] == (len(line), len(line)) and got[2][1] == 0 and got[1] == (1 << 20, 0)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.digest(docs).collect()} == {1: (1, 0), 2: (2, 1), 3: (2, 1), 4: (4, 0), 5: (5, 0)}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.digest(docs).collect()} == {i: (1, 0) for i in range(1, 6)}
    item = " ".join(line.split()[400_000:400_030])
    found = decontaminate.digest(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(2, 7), (3, 7)}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: 1, 2: n, 3: n, 4: 1, 5: 0}
    counted = {r["doc_id"]: r["n_tokens"] for r in tokens.digest(docs.filter("doc_id in (1, 4, 5)")).collect()}
    assert counted[5] == 0 and counted[1] > 1 << 18
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    assert toxicity.digest(docs, labels).count() == 5
    pages = spark.createDataFrame([(1, "http://a/" + word, word), (2, "http://a/?" + "&".join(f"p{i}" for i in range(2000)), word)], "page_id long, url string, html string")
    assert {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in warc.digest(pages).collect()} == {1: (5 << 20, 2), 2: (5 << 20, None)}
    assert urls.digest(pages).count() == 2


def _thue_morse(n):
    """A word of a and b of 2**n letters and its complement: equal under every polynomial modulo a power of two."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_of_patterned_texts(spark):
    one, two = _thue_morse(10)
    docs = frame(spark, [one, two])
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()} == {0: (0, 0), 1: (1, 0)}
    own = [f"w{i}" for i in range(34)]
    text = " ".join([*own[:8], one, *own[8:16], *own[:8], two, *own[16:]])
    want = {w for w in range(8)} | {w for w in range(17, 25)}
    assert quality.digest(frame(spark, [text])).first()["n_repeat_words"] == len(want)
    rows = list(enumerate([one, two, one[:512], one + "x" + two]))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(frame(spark, [t for _, t in rows])).collect()}
    assert got == _removed(rows, 100)
    held = [" ".join(own[:20] + [x] * 20 + own[20:]) for x in (one, two)]
    bench = spark.createDataFrame([(7, " ".join([one] * 20))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(frame(spark, held), bench).collect()} == {0}


def test_hashes_of_words_and_grams():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 7, 8, 9, 16, 255, 256, 257, 300]))) for _ in range(400)]
    b = next(iter(textarrays.blocks(pa.array([" ".join(words), words[0]], pa.large_string()))))
    b.words()
    seen = defaultdict(set)
    for w, h in zip([*words, words[0]], b.word_hashes().tolist(), strict=True):
        seen[w].add(h)
    assert all(len(x) == 1 for x in seen.values()) and len({h for x in seen.values() for h in x}) == len(seen)
    data = b.data.tobytes()
    for k in (3, 8, 20, 32):
        grams = b.grams(k).tolist()
        assert len(grams) == len(data) - k + 1 and len(set(grams)) == len({data[i : i + k] for i in range(len(grams))})
        assert len(set(zip(grams, (data[i : i + k] for i in range(len(grams))), strict=True))) == len(set(grams))


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    from patrika.llm import textarrays

    text = pa.array(["some words here", "x" * 50 + " y", "", "é" * 30], pa.large_string())
    hashes = []
    for piece in (1 << 20, 7):
        b = next(iter(textarrays.blocks(text)))
        b.words()
        monkeypatch.setattr(textarrays, "BLOCK", piece)
        hashes.append(b.word_hashes().tolist())
    assert hashes[0] == hashes[1] and len(set(hashes[0])) == 6


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = "a line that is long enough to count\nown words " + " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, "")]
    names = ("n_words", "kept", "tokens", "host", "path", "verdict", "_salt", "h1", "size", "score", "bucket", "quality")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("own") for n in names}).withColumn("source", F.lit("s"))
    assert [r["n_words"] for r in quality.digest(docs).orderBy("n_words").collect()] == [0, 0, 40, 40, 40, 40]
    cut = Counter((r["doc_id"], r["n_removed"] > 0) for r in suffix_dedup.digest(docs).collect())
    assert cut == Counter({(1, True): 2, (2, True): 1, (None, False): 2, (3, False): 1})
    lines = Counter((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.digest(docs).collect())
    assert lines == Counter({(1, 2, 2): 2, (2, 2, 0): 1, (None, 2, 2): 1, (None, 1, 0): 1, (3, 1, 0): 1}) or lines == Counter({(1, 2, 1): 2, (2, 2, 0): 1, (None, 2, 1): 1, (None, 1, 0): 1, (3, 1, 0): 1})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.digest(docs, labels).count() == 6 and len({r["score"] for r in toxicity.digest(docs, labels).filter("doc_id = 1").collect()}) == 1
    assert tokens.digest(docs).count() == 6 and mixing.mix(docs).count() == 6
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)), 5), (1, None, 6), (None, "w1 w2", 7)], "item_id long, text string, doc_id int")
    assert Counter((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()) == Counter({(d, i): 1 for d in (1, 2, None) for i in (1, None)})
    pages = docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") < 3, F.lit("http://example.net/en/x")).alias("url"), F.col("text").alias("html"), *names)
    judged = Counter((r["page_id"], r["rule"], r["verdict"]) for r in urls.digest(pages).collect())
    assert judged == Counter({(1, "example.net/en/", "allow"): 2, (2, "example.net/en/", "allow"): 1, (None, None, "allow"): 2, (3, None, "allow"): 1})
    assert warc.digest(pages).count() == 6


def test_toxicity_learns_from_every_label(spark):
    """A term of one labelled row in six thousand is learned from, of however many rows."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 6000 < 2, "rareword here").otherwise("plain text").alias("text"))
    labels = docs.select("doc_id", (F.col("text") != "plain text").cast("int").alias("toxic"))
    rows = toxicity.training_rows(docs, labels)
    assert rows.count() == docs.filter(toxicity.remainder() != 0).count() > 20_000
    assert rows.filter("toxic = 1").count() == docs.filter((toxicity.remainder() != 0) & (F.col("text") != "plain text")).count() > 0


def test_toxicity_joins_labels_alike_at_every_size(spark):
    """Few labels are not broadcast, so that what is shuffled grows with the input and not by a leap."""
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    rows = toxicity.training_rows(docs, docs.select("doc_id", F.lit(1).alias("toxic")))
    assert rows.count() == docs.filter(toxicity.remainder() != 0).count()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_latent_space_is_fitted_on_every_passage(spark):
    """However many passages there are, each is in the sketch, with one count in one row."""
    texts = [f"w{i} " * 32 for i in range(300)]
    df = frame(spark, texts).repartition(3)
    passages = df.select(F.col("text").cast("binary")).mapInArrow(decontaminate._some_passages(1.0), "words binary")
    hashes = np.array([decontaminate._plain(b).word_hashes()[0] for t in texts for b in _blocks(t)])
    order = np.argsort(hashes)
    rows = decontaminate._sketched(passages, hashes[order])
    assert rows.shape == (decontaminate.SKETCH, 300) and (np.abs(rows).sum(0) == 32).all() and (np.count_nonzero(rows, 0) == 1).all()
    assert np.count_nonzero(rows.any(1)) > 100 and 0 < (rows > 0).sum() < 300
    assert not hasattr(decontaminate, "SAMPLE")


def test_the_latent_space_does_not_depend_on_partitions(spark):
    """Passages end with their text, and their signs follow from the document, so that cosines agree however rows are dealt."""
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(300)]
    items = [rng.choices(pool, k=20) for _ in range(5)]
    df = frame(spark, [" ".join(rng.choices(pool, k=rng.randrange(1, 120)) + (items[i % 5] if i % 3 == 0 else [])) for i in range(60)])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = [sorted((r["doc_id"], r["item_id"], round(r["cosine"], 4)) for r in decontaminate.leaks(df.repartition(n), bench).collect()) for n in (1, 5)]
    assert found[0] == found[1] and len(found[0]) >= 20


def test_words_are_counted_once_a_task():
    batches = [pa.RecordBatch.from_arrays([pa.array([b"a b a", b"", b"c"])], ["text"])] * 3
    rows = [r for b in decontaminate._terms(iter(batches)) for r in b.to_pylist()]
    assert len({r["term"] for r in rows}) == len(rows) == 3 and sorted(r["n"] for r in rows) == [3, 3, 6]


# -- 11 ---------------------------------------------------------------------------------------------------------------


def _fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def _neighbours(rows, every, k):
    """By brute force: for each query row its id and list of (cosine, id), nearest first."""
    rows = [(i, np.array(v)) for i, v in rows if _fine(v)]
    out = []
    for at, (q, v) in enumerate(rows):
        if q is not None and q % every == 0:
            a = v / np.abs(v).max()
            scored = [(float(a @ (w / np.abs(w).max()) / np.linalg.norm(a) / np.linalg.norm(w / np.abs(w).max())), i) for n, (i, w) in enumerate(rows) if n != at and len(w) == len(v)]
            out.append((q, sorted(((-round(s, 9), i is not None, i) for s, i in scored), key=lambda x: (x[0], x[1], x[2] or 0))[:k]))
    return out


def test_neighbours_edges(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60)] + [(300, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]), (300, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]), (300, [-1.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    rows += [(400, None), (410, []), (420, [0.0] * 6), (430, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (440, [math.nan] * 6), (450, [math.inf, 1.0, 1.0, 1.0, 1.0, 1.0]), (None, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]), (None, [3.0, -2.0, 1.0, 0.0, 0.0, 0.0])]
    rows += [(460, [1e200, 2e200, 0.0, 0.0, 0.0, 1e200]), (470, [1e-200, 0.0, 0.0, 0.0, 0.0, 0.0]), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (510, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("id", "node", "key", "ids", "score")}).repartition(3)
    got = defaultdict(list)
    for r in neighbours.search(df, 10, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], -round(r["score"], 9), r["vec_id"] is not None, r["vec_id"]))
    want = defaultdict(list)
    for q, near in _neighbours(rows, 10, 5):
        want[q] += [(rank, *x) for rank, x in enumerate(near, 1)]
    assert {q: sorted(x, key=str) for q, x in got.items()} == {q: sorted(x, key=str) for q, x in want.items() if x}


def _recall(got, vectors, every, k):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found, total = 0, 0
    for q in range(0, len(vectors), every):
        s = units @ units[q]
        s[q] = -9
        best = np.sort(s)[-k:]
        scores = [s[i] for _, i, _ in got[q]]
        assert len(got[q]) == k and [r for r, *_ in got[q]] == list(range(1, k + 1)) and np.allclose(scores, [x for *_, x in got[q]], atol=1e-12) and (np.diff(scores) <= 1e-12).all() and q not in [i for _, i, _ in got[q]]
        found += sum(x >= best[0] - 1e-12 for x in scores)
        total += k
    return found / total


@pytest.mark.parametrize("clusters", [0, 40])
def test_neighbours_recall(spark, monkeypatch, clusters):
    monkeypatch.setattr(neighbours, "LEAF", 64)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "RESULTS", 900)
    monkeypatch.setattr(neighbours, "SAMPLE", 2000)
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((6000, 24)).astype(np.float32)
    if clusters:
        vectors = (vectors * 0.3 + rng.standard_normal((clusters, 24))[rng.integers(0, clusters, 6000)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in neighbours.search(df, 20, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert _recall(got, vectors.astype(float), 20, 5) >= 0.9


def test_neighbours_of_the_table(spark):
    data = "/root/testdata/sf0.1"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in queries()["op11_neighbours"](spark, data).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert _recall(got, np.array([vectors[i] for i in range(len(vectors))], float), 50, 5) >= 0.9


def test_forest_queue_starts_with_own_leaves():
    rng = np.random.default_rng(3)
    x = neighbours._units(rng.standard_normal((3000, 12)))
    forest = neighbours.fit(x[:1000], 4, 3)
    leaf, queue = forest.leaf_of(x), forest.queue(x)
    assert all(set(q[:3].tolist()) == set(own.tolist()) for q, own in zip(queue, leaf, strict=True))
    assert forest.counts.sum(1).tolist() == [1000] * 3 and forest.counts.min() > 40


# -- 12 ---------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _best(texts, items, k=10):
    """By brute force, from rows (id, text): the results of each item."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: TERM.findall((t or "").translate(lower))
    docs = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in texts) if t]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df, out = Counter(t for _, c in docs for t in c), Counter()
    for item, text in set(items):
        scored = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            scored += [(-score, i is not None, i or 0)] * (score > 0)
        out += Counter((item, rank, i if known else None, -score) for rank, (score, known, i) in enumerate(sorted(scored)[:k], 1))
    return out


@pytest.mark.parametrize(("items_at_once", "entries"), [(1024, 1 << 14), (7, 40)])
def test_lexical_search(spark, monkeypatch, items_at_once, entries):
    monkeypatch.setattr(lexical, "MOST_ITEMS", items_at_once)
    monkeypatch.setattr(lexical, "ENTRIES", entries)
    monkeypatch.setattr(lexical, "GROUP", min(128, items_at_once // 2))
    rng = random.Random(9)
    words = ["a", "A", "é", "É", "x9", "日本", "the", "THE", "zz", *(f"w{i}" for i in range(60))]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "_", "\x00", "."]) for _ in range(n))
    texts = [(i, text(int(rng.expovariate(1 / 30)))) for i in range(400)] + [(i, "the same text w1 w2") for i in range(1000, 1150)]
    texts += [(2000, None), (2001, ""), (2002, " .-"), (None, "w3 w4"), (None, "w3 w4"), (7, "w5 w5"), (7, "w5 w5"), (2003, "w7 " * 20_000)]
    items = [(i, text(rng.randint(1, 30))) for i in range(20)] + [(1, "the same text"), (50, None), (51, ""), (52, "unknown"), (53, "w1 w1 w1 w2"), (53, "w1 w1 w1 w2"), (None, "w3 é"), (54, "W7 zz")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("n", "doc", "terms", "item", "rank")}).repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("own") for c in ("id", "_key", "item", "score")})
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(docs, bench).collect())
    assert got == _best(texts, items)


def test_lexical_bounds_hold():
    rng = np.random.default_rng(2)
    times, n = rng.integers(1, 50, 500), rng.integers(1, 3000, 500)
    exact = lexical.impacts(times, n, 10_000, 3_000_000)
    m = [25 + 75 * int(x) * 10_000 // 3_000_000 for x in n]
    assert exact.tolist() == [10**9 * int(t) // (1000 * int(t) + 8 * x) for t, x in zip(times, m, strict=True)] and exact.max() < lexical.WHOLE
    up = -(-exact // lexical.STEP)
    assert (up * lexical.STEP >= exact).all() and ((up - 1) * lexical.STEP < exact).all() and up.max() < 256
    assert lexical.impacts(np.array([3]), np.array([10**9]), 10**10, 10**13).tolist() == [3 * 10**9 // (3000 + 8 * (25 + 75 * 10**19 // 10**13))]


# -- 13 ---------------------------------------------------------------------------------------------------------------


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves):
    """All levels of a tree."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([_sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def _manifest(rows):
    """By brute force, from rows (doc_id, source, lang, n_chars, text)."""
    hashed = lambda row: _sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row, hashed(row)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {lang: _tree(leaf for _, leaf in groups[lang]) for lang in langs}
    top = _tree(trees[lang][-1][0] for lang in langs)
    out = Counter()
    for t, lang in enumerate(langs):
        for i, (row, leaf) in enumerate(groups[lang]):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            now, siblings = hashed((*row[:3], row[3] + 1, row[4])) if changed else leaf, []
            for levels, at in ((trees[lang], i), (top, t)):
                for level in levels[:-1]:
                    run = level[at - at % 2 : at - at % 2 + 2]
                    siblings += [d for k, d in enumerate(run) if k != at % 2]
                    now = _sha(*(now if k == at % 2 else d for k, d in enumerate(run)))
                    at //= 2
            out[row[0], leaf, trees[lang][-1][0], top[-1][0], _sha(*siblings), now, now == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("part_bytes", [64 << 20, 160, 160 * 7])
def test_merkle_manifest(spark, part_bytes):
    rng = random.Random(part_bytes)
    langs = [None, "", "en", "é", "日", "z", "en", "en"]
    for n in (1, 2, 3, 40, 203):
        rows = [(rng.choice([None, i, -i, 5]), rng.choice([None, "", "a:b"]), rng.choice(langs[: 1 + n % 8] if n < 203 else langs), rng.choice([None, 7, 2**63 - 1]), rng.choice([None, "", "é 1:2", "x" * 300])) for i in range(n)]
        docs = spark.createDataFrame(rows + rows[: n // 3], "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("own") for c in ("leaf", "_part", "tree", "named")})
        got = Counter(tuple(r) for r in merkle.manifest(docs.repartition(3), part_bytes).collect())
        assert got == _manifest(rows + rows[: n // 3]), n
    assert sum(v for k, v in got.items() if not k[-1]) > 5  # tampering shows


def test_merkle_many_groups(spark):
    rows = [(i, "s", f"l{i % 150}", 1, "t") for i in range(300)] + [(i, "s", "hot", 1, None) for i in range(150)]
    got = Counter(tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), 160 * 20).collect())
    assert got == _manifest(rows)


def test_merkle_fragments_merge_in_any_order():
    rng, leaves = random.Random(4), {0: 13, 1: 1, 2: 8, 3: 5}
    nodes = [((t, 0, i), _sha(f"{t} {i}").encode()) for t, n in leaves.items() for i in range(n)]
    want = _tree(_tree(_sha(f"{t} {i}") for i in range(n))[-1][0] for t, n in leaves.items())[-1][0].encode()
    for _ in range(20):
        rng.shuffle(nodes)
        parts = [dict(nodes[i::6]) for i in range(6)]
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            forest = merkle.Forest(leaves | {merkle.ROOT: len(leaves)})
            for node, digest in [*a.items(), *b.items()]:
                forest.add(node, digest)
            parts.append(forest.open)
        assert parts[0] == {(merkle.ROOT, 2, 0): want}


# -- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        path_rows = out.collect()
        assert 0 < len(path_rows) <= docs.count()
        docs = spark.createDataFrame(path_rows, docs.schema)
    by_class = defaultdict(list)
    for r in jaccard_join.join(docs).collect():
        by_class[r["class_id"]].append(r["doc_id"])
    assert all(len(v) == 1 for v in by_class.values())
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()
    assert "pipeline" in __spark_entry__.queries()


def test_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = ("id", "node", "comp", "size", "count", "target", "n_lines", "n_dropped", "toxicity", "_kept", "_bad", "_id", "_text", "doc", "item", "sig", "a.b", "_0", "_made", "_source", "tick`")
    wide = docs.withColumns({n: F.lit(f"own {n}") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, plain = stage(spark, wide, DATA), stage(spark, docs, DATA)
        assert out.columns == wide.columns, name
        assert all(r[n] == f"own {n}" for r in out.collect() for n in names), name
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in plain.collect()), name
    assert corpus_pipeline.mix_sources(spark, wide, DATA).count() == docs.count()
    assert tokens.count_tokens(wide).columns == [*wide.columns, "n_tokens"]


def test_pipeline_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        after = [r.asDict() for r in stage(spark, docs, DATA).collect()]
        ids = {r["doc_id"] for r in after}
        if name == "toxicity":
            score = {r["doc_id"]: r["predicted"] for r in toxicity.digest(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
            assert ids == {r["doc_id"] for r in before if not score[r["doc_id"]]}
        elif name == "line dedup":
            holders = defaultdict(set)
            key = lambda x: re.sub("[A-Z]", lambda c: c[0].lower(), x).strip(" \t\n\x0b\x0c\r")
            for r in before:
                for line in r["text"].split("\n"):
                    holders[key(line)].add(r["doc_id"])
            goes = lambda x, d: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and d != max(holders[key(x)])
            want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not goes(x, r["doc_id"])) for r in before}
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == {d: (t, len(t)) for d, t in want.items()}
        elif name == "n-gram Jaccard join":
            sets = {}
            for r in before:
                w = WORD.findall(r["text"])
                sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            label = {d: d for d in sets}
            for a in sets:
                for b in sets:
                    if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        low, high = sorted((label[a], label[b]))
                        label = {d: low if x == high else x for d, x in label.items()}
            assert ids == {d for d in sets if label[d] == d}
        elif name == "benchmark decontamination":
            items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
            held = {d for d, _ in _leaks_by_brute_force({r["doc_id"]: r["text"] for r in before}, items)}
            assert ids == {r["doc_id"] for r in before} - held
        else:
            size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
            of = {r["doc_id"]: r["source"] for r in before}
            assert {r["doc_id"]: r["size"] for r in after} == size
            for source in set(of.values()):
                mine = [r for r in after if of[r["doc_id"]] == source]
                assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) and all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        docs = spark.createDataFrame([tuple(r.values()) for r in after], stage(spark, docs, DATA).schema) if name != corpus_pipeline.STAGES[-1][0] else docs


def test_curve_is_fitted_in_few_partitions(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    parts, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, data: parts.append(data.rdd.getNumPartitions()) or fit(self, data))
    rows = spark.createDataFrame([(f"clean words {i} " + "vile " * (i % 3), int(i % 3 > 0)) for i in range(300)], "text string, toxic int")
    many = spark.sparkContext.defaultParallelism * 5
    slope, _ = toxicity.fit_curve(rows.repartition(many), {" vile ": 3.0})
    assert parts == [spark.sparkContext.defaultParallelism] and slope[0] > 0


def test_driver_drops_the_sketch_before_the_search(spark, monkeypatch):
    held, alive, summed, search = [], [], decontaminate._summed, decontaminate._search

    def watched(*args):
        out = summed(*args)
        held.append(weakref.ref(out[0]))
        return out

    monkeypatch.setattr(decontaminate, "_summed", watched)
    monkeypatch.setattr(decontaminate, "_search", lambda *args: alive.extend(r() is not None for r in held) or search(*args))
    text = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    assert decontaminate.leaks(frame(spark, [text, "other words", text]), bench).count() == 2
    assert alive == [False]
