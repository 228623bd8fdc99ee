import itertools
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rastrella.llm import html_text, language_id, parts, perplexity, token_files, toxicity

DATA = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


# quality rules


def slow_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeat = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat)


def test_text_rules(spark, hard_docs):
    texts = [r["text"] or "" for r in hard_docs.collect()] + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for t in [*texts, "a b c d e a b c d e x a b c d e", "x x x x x x x", "l\nl\n \n \nl m\nl m", "é\x85é ñ x"]:
        assert perplexity.text_rules(t) == slow_rules(t)


def slow_words(text):
    dense = re.compile("[\u4e00-\u9fff\u3040-\u30ff]")
    return re.findall(f"{dense.pattern}|[^\\x20\\x09-\\x0D{dense.pattern[1:]}+", text)


def _mix(x):
    x &= (1 << 64) - 1
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return x ^ x >> 29


_ODD64 = 0x9E3779B97F4A7C15


def slow_log_ppl(texts, share=perplexity.SHARE, contexts=perplexity.CONTEXTS):
    """Perplexities of one language's texts from plain dictionaries."""
    h = lambda w: xxhash.xxh64_intdigest(w.encode())
    docs = [slow_words(t) for t in texts]
    halves = []
    for d in docs:
        keys = []
        for i in range(min(2, len(d) - 1), len(d)):
            keys.append(_mix(sum(_mix((h(d[i - b]) + b) * _ODD64) for b in range(3) if i >= b)))
        halves.append((min(keys) * _ODD64 & (1 << 64) - 1) >> 63 if keys else 0)
    bit = lambda c: _mix(c * _ODD64) >> 58
    total = sum(map(len, docs))
    least = max(2, math.ceil(share * total))
    everywhere = Counter(w for d in docs for w in d)
    frequent = {w for w, n in everywhere.items() if n >= least and n * perplexity.FREQUENT >= total}

    def estimate(n, bits):
        return n if len(bits) > 60 else min(n, int(math.floor(-64 * math.log(1 - len(bits) / 64) + 0.5)))

    models = []
    for f in (0, 1):
        own = [d for d, x in zip(docs, halves) if x == f]
        n, left, pairs, around = Counter(), defaultdict(set), Counter(), defaultdict(set)
        for d in own:
            for i, w in enumerate(d):
                n[w] += 1
                left[w].add(bit(h(d[i - 1]) if i else 0))
                if i and w in frequent and d[i - 1] in frequent:
                    pairs[d[i - 1], w] += 1
                    around[d[i - 1], w].add(bit((h(d[i - 2]) if i > 1 else 0) * 3 + (h(d[i + 1]) if i + 1 < len(d) else 0)))
        c = {w: estimate(k, left[w]) for w, k in n.items()}
        t, kinds = sum(c.values()), len(c)
        if not t:
            models.append(None)
            continue
        cc = Counter(c.values())
        d1 = perplexity.discounts(*(cc[i] for i in (1, 2, 3, 4)))
        spare = sum(d1[min(x, 3)] for x in c.values()) / t
        p1 = {w: (c.get(w, 0) - (d1[min(c[w], 3)] if w in c else 0)) / t + spare / (kinds + 1) for w, k in everywhere.items() if k >= least}
        rest = max(1 - sum(p1.values()), spare / (kinds + 1)) / (kinds - sum(w in c for w in p1) + 1)
        models.append((n, pairs, around, p1, rest))
    both = Counter()
    for m in models:
        both += m[1] if m else Counter()
    out = []
    for d, x in zip(docs, halves):
        m = models[1 - x]
        if m is None:
            out.append(math.log(len(everywhere) + 1) if d else 0)
            continue
        n, pairs, around, p1, rest = m
        cc = Counter(pairs.values())
        off = perplexity.discounts(*(cc[i] for i in (1, 2, 3, 4)))[3] if both else 0.5
        sums, part = Counter(), {}
        for pair, k in pairs.items():
            if both[pair] >= least and estimate(k, around[pair]) >= contexts:
                part[pair] = max(0, k - off) / max(1, n[pair[0]])
                sums[pair[0]] += part[pair]
        lp = 0
        for i, w in enumerate(d):
            p = p1.get(w, rest)
            if i and d[i - 1] in frequent:
                p = part.get((d[i - 1], w), 0) + min(1, max(1e-6, 1 - sums[d[i - 1]])) * p
            lp -= math.log(p)
        out.append(lp / max(1, len(d)))
    return out


def test_kneser_ney_matches_dictionaries(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("lang = 'en' and n_chars < 3000").select("text").collect()]
    texts += ["", "one", "two words", "日本語 のテキスト 日本", "the the the", None, texts[0], texts[0] + " more"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    want = slow_log_ppl([t or "" for t in texts])
    for parts in (1, 4):
        got = {r["doc_id"]: r["log_ppl"] for r in perplexity.quality(docs.repartition(parts)).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-4)
    model = perplexity.build_model(docs.select(F.lit("x").alias("lang"), F.coalesce("text", F.lit("")).alias("text")))["x"]
    assert len(model["pairs"]) > 20 and all((np.diff(model[k].astype(np.float64)) > 0).all() for k in ("words", "frequent", "pairs"))


def test_pairs_of_rare_words_count_in_every_part(spark, monkeypatch):
    """Pairs of words far below a 2,048th of their language are entries, and texts, blocks and parts in any cut give the same."""
    rng = np.random.default_rng(11)
    texts = []
    for i in range(600):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 90)]
        for k in range(3):
            words[10 + 20 * k : 12 + 20 * k] = [f"left{(i + 13 * k) % 80}", f"right{(i + 13 * k) % 80}"]
        texts.append(" ".join(words + ["the", f"v{i % 7}"] * 4))
    frame = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    pairs = perplexity.build_model(frame.select("lang", "text"))["x"]["pairs"]
    assert len(pairs) > 60
    want = slow_log_ppl(texts)
    monkeypatch.setattr(perplexity, "BLOCK", 20_000)
    monkeypatch.setattr(perplexity, "PART", 50_000)
    got = {r["doc_id"]: r["log_ppl"] for r in perplexity.quality(frame).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-6)
    assert (perplexity.build_model(frame.select("lang", "text"))["x"]["pairs"] == pairs).all()


def test_requests_for_pairs_are_small_and_read_back():
    """A pair that a block asks for costs less than five bytes; it had seven and more. Things in many contexts read back, too."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{x}" for x in range(20_000)]
    texts = [" ".join(vocabulary[i] for i in np.minimum(rng.zipf(1.3, 400), 20_000) - 1) for _ in range(300)]
    words = perplexity.Words(texts)
    asked = perplexity.Asked(words, 1)
    asked.ids = np.argsort(np.argsort(-np.bincount(asked.at), kind="stable"), kind="stable")
    pairs = perplexity.Pairs(words, asked, 1, np.zeros(0, np.uint64))
    seen = pairs.see(words)
    (_, *bounds), = pairs.bounds
    firsts, far, n, blob = pairs.request(seen, *bounds)
    assert n == len({(a, b) for t in texts for a, b in zip(t.split(), t.split()[1:])}) and len(blob) < 5 * n
    part = perplexity.PairPart(pa.table({"firsts": [firsts], "far": [far], "pairs": [n], "blob": pa.array([blob], pa.binary())}))
    counts = Counter((asked.ids[a], asked.ids[b]) for a, b in zip(pairs.first[pairs.pair], pairs.second[pairs.pair]))
    assert seen.number.max() > perplexity.MANY and (part.seen.tags == seen.tags).all()
    assert {(a, b): k for a, b, k in zip((part.keys[part.first] // 2).tolist(), part.second.tolist(), (part.k[0] + part.k[1]).tolist())} == dict(counts)


def test_near_copies_share_a_half():
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        texts += [" ".join(words), " ".join([*words[:60], "changed", *words[61:]])]
    half = perplexity.Words(texts).half
    assert (half[::2] == half[1::2]).mean() > 0.93 and 0.4 < half.mean() < 0.6


def test_quality(spark, hard_docs, no_docs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for frame in (docs, hard_docs):
        rows = perplexity.quality(frame).collect()
        assert len(rows) == frame.count()
        texts = Counter((r["doc_id"], *slow_rules(r["text"] or "")) for r in frame.collect())
        assert texts == Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert r["kept"] == (not r["base_failed"] and (r["lower"] is None or r["lower"] <= r["log_ppl"] <= r["upper"]))
        again = sorted(map(repr, perplexity.quality(frame.repartition(3)).collect()))
        assert len(again) == len(rows) and sum("kept=True" in r for r in again) == sum(r["kept"] for r in rows)
    assert perplexity.quality(no_docs).count() == 0


def test_bands_are_medians(spark):
    rng = np.random.default_rng(3)
    rows = [(f"l{i % 2}", float(rng.normal(9, 0.5)), int(rng.integers(10, 900)), bool(i % 11 == 0)) for i in range(999)]
    got = {r["lang"]: r for r in perplexity.bands(spark.createDataFrame(rows, "lang string, log_ppl double, n_words long, base_failed boolean")).collect()}
    for lang in ("l0", "l1"):
        good = np.array([(x, n) for a, x, n, failed in rows if a == lang and not failed])
        off = np.abs(good[:, 0] - np.median(good[:, 0]))
        assert got[lang]["middle"] == pytest.approx(np.median(good[:, 0]), abs=0.01)
        assert got[lang]["spread"] == pytest.approx(1.4826 * np.median(off), abs=0.02)
        assert got[lang]["by_length"] == pytest.approx(1.4826 * np.median(off * np.sqrt(good[:, 1])), rel=0.05)


def test_bands_reject_bad_documents_and_keep_good_ones(spark):
    """On the fold that no figure was chosen on."""
    data = "/root/testdata/sf0.1"
    rows = perplexity.quality(spark.read.parquet(f"{data}/documents.parquet")).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").filter("not base_failed and crc32(cast(doc_id as string)) % 5 = 0").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(bad) > 50 and sum(good) >= 0.985 * len(good) and sum(bad) <= 0.4 * len(bad)


# language


def test_language(spark, hard_docs, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    hard = language_id.identify(hard_docs).collect()
    assert len(hard) == hard_docs.count()
    assert {r["lang_pred"] for r in hard if r["doc_id"] in (4, 5, 6, 12)} == {"und"}
    assert language_id.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(hard_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language_id.identify(d).collect())) for d in (docs, changed))
    assert a == b


def test_elastic_net_is_sparse():
    model = language_id.train([("der die das und ist", "de"), ("the of and is to", "en")] * 10)
    assert model["zeros"] > 0.9 and language_id.predict(model, "the and")[0] == "en"


# toxicity


def small_network(rng):
    rows = [(" ".join(rng.choice(["ab", "cd", "ef", "bad"], 40)), int(i % 2)) for i in range(8)]
    model = {k: v.astype(np.float64) if isinstance(v, np.ndarray) and v.dtype == np.float32 else v for k, v in toxicity.train(rows).items()}
    return model | {"bias": float(model["bias"])}, ["ab", "cd", "ef", "bad"]


def test_forward_equals_plain_loops():
    rng = np.random.default_rng(1)
    model, words = small_network(rng)
    ids, windows = rng.integers(0, 4, 50), [(0, 7), (10, 4), (18, 32), (49, 1)]
    x, mask, _ = toxicity._gather(toxicity._project(model, toxicity._inputs(model, words)[0]), ids, *map(np.array, zip(*windows)))
    got = toxicity._forward(model, x, mask, False)[0]
    inputs, h, sig = toxicity._inputs(model, words)[0].astype(float), toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    for (start, size), value in zip(windows, got):
        states = np.zeros((size, 2 * h))
        for k in (0, 1):
            state = np.zeros(h)
            for t in range(size) if k == 0 else reversed(range(size)):
                a, b = inputs[ids[start + t]] @ model["w"][k] + model["b"][k], state @ model["u"][k]
                r, z = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :])
                states[t, k * h : (k + 1) * h] = state
        weight = np.exp(np.tanh(states @ model["att"]) @ model["att_v"])
        assert value == pytest.approx(float((weight / weight.sum()) @ states @ model["out"] + model["bias"]), abs=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    model, words = small_network(rng)
    ids = rng.integers(0, 4, 50)
    start, size = np.array([0, 10, 20]), np.array([7, 4, 9])

    def loss(m):
        x, mask, _ = toxicity._gather(toxicity._project(m, toxicity._inputs(m, words)[0]).astype(float), ids, start, size)
        return np.logaddexp(0, toxicity._forward(m, x, mask, False)[0].astype(float)).sum()

    got = toxicity._gradients(model, words, ids, start, size, toxicity._sigmoid)
    for name in ("u", "att", "att_v", "out", "w", "b", "words", "chars"):
        places = np.argwhere(np.abs(got[name]) >= np.quantile(np.abs(got[name]), 0.9))
        for at in map(tuple, places[rng.integers(0, len(places), 3)]):
            up, down = ({**model, name: model[name].copy()} for _ in range(2))
            up[name][at] += 1e-2
            down[name][at] -= 1e-2
            assert got[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.05, abs=3e-3), name
    assert got["bias"] == pytest.approx((loss({**model, "bias": model["bias"] + 0.01}) - loss({**model, "bias": model["bias"] - 0.01})) / 0.02, rel=0.02)


def test_toxicity_on_the_held_out_fold(spark):
    """Labelled rows that nothing was learned from; no list of words is asked."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(toxicity.training_rows(docs, labels))
    rows = docs.join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").select("text", "toxic").collect()
    score = toxicity.Scorer(model).scores([r["text"] for r in rows])
    toxic = np.array([r["toxic"] for r in rows]) == 1
    assert toxic.sum() > 50 and (score[toxic] >= 0.5).mean() >= 0.85 and (score[~toxic] >= 0.5).mean() <= 0.06


def test_windows_cover_every_word():
    lengths = np.array([0, 1, 31, 32, 33, 56, 57, 500])
    doc, start, size = toxicity._windows(lengths)
    for d, n in enumerate(lengths):
        places = [(s, s + k) for x, s, k in zip(doc, start, size) if x == d]
        assert set().union(*(range(a, b) for a, b in places)) == set(range(n))
        assert all(b[0] < a[1] for a, b in itertools.pairwise(places))


def test_toxicity(spark, hard_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    marked = [r for r in rows if re.search(r"\b(idiot|moron|scum|loser|worthless)\b", r_text(docs, r["doc_id"]))]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    caught = [r for r in marked if r["toxic"] and r["predicted"]]
    assert len(caught) >= 0.9 * sum(r["toxic"] for r in marked)
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and docs.count() - kept.count() >= len(caught)
    none = labels.filter("toxic = 7")
    got = toxicity.toxicity(hard_docs, none).collect()
    assert len(got) == hard_docs.count() and {r["score"] for r in got} == {0.0}
    assert toxicity.toxicity(hard_docs, labels).count() == hard_docs.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0


_TEXTS = {}


def r_text(docs, doc_id):
    if not _TEXTS:
        _TEXTS.update({r["doc_id"]: r["text"].lower() for r in docs.collect()})
    return _TEXTS[doc_id]


# token files


def test_re_pair_round_trip():
    rng = np.random.default_rng(4)
    for n, kinds in ((1, 5), (2, 1), (5000, 3), (20_000, 40), (3000, 1)):
        ids = rng.integers(0, kinds, n)
        ends = np.unique(np.append(rng.integers(1, n + 1, 20), n))
        for first, complete in ((50_257, False), (50_257, True), (70_000, False)):
            shard = token_files.Shard(token_files.write_shard(ids, ends, first, complete))
            assert np.array_equal(shard.all(), ids) and np.array_equal(shard.document(len(ends) - 1), ids[ends[-2] if len(ends) > 1 else 0 :])
            if complete:  # no pair is left twice, but where its places overlap
                last = np.zeros(len(shard.seq), bool)
                last[shard.seq_ends.astype(int) - 1] = True
                pairs = Counter()
                before = None
                for i, p in enumerate(zip(shard.seq[:-1].tolist(), shard.seq[1:].tolist())):
                    if not last[i]:
                        apart = before != (i - 1, p)
                        pairs[p] += apart
                        before = (i, p) if apart else None
                assert max(pairs.values(), default=0) < 2
        data = token_files.write_shard(ids, ends, 50_257)
        shard = token_files.Shard(data)
        assert np.array_equal(shard.all(), ids) and np.array_equal(shard.ends, ends)
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            assert np.array_equal(shard.document(i), ids[a:b])
            first = int(shard.seq_ends[i - 1]) if i else 0
            full = np.concatenate([np.ones(shard.first, np.int64), shard.lengths])
            assert full[shard.seq[first : int(shard.seq_ends[i])]].sum() == b - a
    assert len(token_files.write_shard(np.tile(np.arange(50), 400), np.array([20_000]), 50_257)) < 5000


HARD_TEXTS = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\n b", "a \nb", "x\ty", "it's\nI'll we've", "été,.  b", "a\x1cb c", "<|endoftext|> x<|endoftext|>", "日本 語\n文", "foo.\nBar, baz!! 12 a1 ___", "…Ġ Ġa", "²³ x²", "a b", "wórd's end."]


def test_encoder_equals_whole_encoding(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    coder = token_files.Encoder(open(path, "rb").read())
    assert whole.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = HARD_TEXTS + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts += ["word " * 3 + "x" * 500 + " end", "é" * 300, "a" * 127, "a" * 126 + " b"]
    for t in texts:
        assert np.frombuffer(coder.encode(t), np.uint16).tolist() == whole.encode(t, add_special_tokens=False).ids, t[:80]


def test_encoder_starts_anew_when_its_table_is_full(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN", 300)
    monkeypatch.setattr(token_files, "TABLE_BITS", 9)
    monkeypatch.setattr(token_files, "PART", 900)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, coder = Tokenizer.from_file(path), token_files.Encoder(open(path, "rb").read())
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, int(n))) + "\nline" for n in rng.integers(0, 400, 60)]
    assert [np.frombuffer(b, np.uint16).tolist() for b in coder.encode_all(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, hard_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for frame, size in ((spark.read.parquet(f"{DATA}/documents.parquet"), 10_000), (hard_docs, 50)):
        folder = token_files.shared_folder(spark)
        token_files.write_tokens(frame, path, folder, shard_tokens=size)
        got = sorted(token_files.read_tokens(spark, folder, tokens=True).collect(), key=lambda r: r["start"])
        want = sorted(frame.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or ""))
        at = 0
        for g, w in zip(got, want, strict=True):
            ids = [*whole.encode(w["text"] or "", add_special_tokens=False).ids, 2]
            assert (g["doc_id"], g["start"], g["n_tokens"], g["tokens"]) == (w["doc_id"], at, len(ids), ids)
            assert g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)
    folder = token_files.shared_folder(spark)
    token_files.write_tokens(no_docs, path, folder)
    assert token_files.read_tokens(spark, folder).count() == 0


# pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header>Site name</header><nav><ul><li>Home<li>News</ul></nav>
<div id="cookie-notice">We use cookies</div><main><div class="sidebar">See also</div><article class="post"><header><h1>Fish &amp; chips &lt;3</h1></header><p>One
  two<p>It <i>al</i>ic<br>next<div class="comments"><p>First!</div><form>Mail<input></form><table><tr><td>a<td>b</table><script>if(a<b){"</p>"}</script>
<ul><li>x<li>y</ul><aside>ad</aside></article></main><footer>&copy; 2020</footer></body></html>"""


def main_text(page):
    return " ".join(t for t, _ in html_text.split_page(page)[0])


def test_rules():
    assert main_text(PAGE) == "Fish & chips <3 One two It alic next a b x y"
    assert main_text("<p>plain") == "plain" and main_text("") == "" and main_text("a < b & c") == "a < b & c"
    assert main_text("<article><p title='a>b'>x</p><p class=\"advert\">no<p>y</article>") == "x y"
    assert main_text('<div class="no-sidebar"><p>in</p></div><div role="navigation">out</div><p hidden>out</p>') == "in"
    assert main_text('<article><p>x</p></article><article class="comment"><p>reader</p></article><aside><article>tease</article></aside>') == "x"
    assert main_text("<article><p>one<nav>skip</nav><p>two <b>bold</article><p>out") == "one two bold"


def slow_cover(pages):
    """Which tokens lie in a substring of LONG tokens or more that another page of the host has too."""
    out = {}
    for key, (host, tokens) in pages.items():
        others = {tuple(t[i : i + html_text.LONG]) for k, (h, t) in pages.items() if k != key and h == host for i in range(len(t) - html_text.LONG + 1)}
        covered = [False] * len(tokens)
        for i in range(len(tokens) - html_text.LONG + 1):
            if tuple(tokens[i : i + html_text.LONG]) in others:
                covered[i : i + html_text.LONG] = [True] * html_text.LONG
        out[key] = covered
    return out


def test_suffix_array_is_sorted_to_its_depth():
    rng = np.random.default_rng(6)
    for n, kinds in ((0, 2), (3, 2), (400, 2), (2000, 5), (500, 300)):
        tokens, page = rng.integers(0, kinds, n).astype(np.uint64), np.sort(rng.integers(0, 12, n))
        host = (page % 3).astype(np.uint64)
        order, begins = html_text.suffix_array(tokens, host, page)
        whole = [i for i in range(n - html_text.LONG + 1) if page[i] == page[i + html_text.LONG - 1]]
        key = lambda i: (host[i], *tokens[i : i + html_text.LONG].tolist())  # noqa: B023, E731
        assert order.tolist() == sorted(whole, key=lambda i: (key(i), i))
        assert begins.tolist() == [k for k in range(len(order)) if not k or key(order[k]) != key(order[k - 1])]


def test_weak_words_only_suggest(spark):
    line = "all rights reserved by the owner of this site"
    page = "<article><p>{0} text of its own</p><div class='legal'>{0} is a unique remark within the law</div><div id='copyright'>" + line + "</div></article>"
    rows = [(i, f"http://h/{i}", page.format(f"page{i}")) for i in range(3)]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(3):
        assert got[i]["text"] == f"page{i} text of its own page{i}" and got[i]["n_open"] == 8 + 9 and got[i]["n_cut"] == 7 + 9


def test_repeats_alone_find_the_boilerplate_of_marked_pages(spark):
    """Without markup, on hosts with many pages: what repeats is cut and unique text stays."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        host = f"host{i % 2}"
        own = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 40))
        rows.append((i, f"http://{host}/{i}", f"<nav>Home News Sports Weather Contact About {host}</nav><article><p>{own}</p></article><footer>{host} is a member of the group of local newspapers</footer>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    by_repeats = {r["page_id"]: r["text"] for r in html_text.extract(frame, trust_markup=False).collect()}
    by_markup = {r["page_id"]: r["text"] for r in html_text.extract(frame).collect()}
    assert by_repeats == by_markup


def test_repeats_decide_about_prose_of_articles(spark):
    """A notice that most pages of a host have goes, also as a paragraph of the article; a reprint in some pages stays."""
    notice, reprint = "this text may be copied under the terms of the licence", "a long sentence that two of the pages have in common"
    rows = [(i, f"http://h/{i}", f"<article><p>page {i} says m{i} n{i}</p><p>{reprint if i < 2 else f'own {i}'}</p><p>{notice}</p></article>") for i in range(9)]
    rows += [(100 + i, f"http://small/{i}", f"<article><p>page {i} only{i}</p><p>{notice}</p></article>") for i in range(3)]
    rows += [rows[0], rows[0]]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for i in range(9):
        assert got[i]["text"] == f"page {i} says m{i} n{i} {reprint if i < 2 else f'own {i}'}"
        assert (got[i]["n_repeat"], got[i]["n_notice"], got[i]["n_open"]) == (11 + 11 if i < 2 else 11, 11, 0)
    assert all(got[100 + i]["text"] == f"page {i} only{i} {notice}" and got[100 + i]["n_repeat"] == 11 for i in range(3))


@pytest.mark.parametrize("stream", [html_text.STREAM, 50])
def test_repeats_across_pages_are_removed(spark, monkeypatch, stream):
    monkeypatch.setattr(html_text, "STREAM", stream)
    rng = np.random.default_rng(2)
    pages = []
    for i in range(60):
        host = f"h{i % 3}.example"
        own = [f"w{x}" for x in rng.integers(0, 1000, 30)]
        shared = f"all rights of {host} are reserved for ever".split()
        pages.append((i, f"https://{host}/{i}", own[:15] + shared[: int(rng.integers(3, 9))] + own[15:]))
    frame = spark.createDataFrame([(i, u, f"<body><div>{' '.join(w[:20])}</div><div>{' '.join(w[20:])}</div></body>") for i, u, w in pages], "page_id long, url string, html string").repartition(4)
    cover = slow_cover({i: (u.split("/")[2], w) for i, u, w in pages})
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame).collect()}
    assert got == {i: " ".join(t for t, c in zip(w, cover[i]) if not c) for i, _, w in pages}
    assert any(any(c) for c in cover.values())


def shuffled_bytes(spark):
    """Bytes that all stages so far have written for exchanges."""
    context = spark.sparkContext
    jvm = context._jvm
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_cells_round_trip():
    rng = np.random.default_rng(5)
    for n, high in ((1, 2**63), (2, 2**63), (5, 6), (1000, 1001), (50_000, 2**29), (3, 2)):
        values = np.unique(rng.integers(0, high, n).astype(np.uint64) << np.uint64(1))
        blob = parts.pack_cells(values)
        assert (parts.unpack_cells(blob, len(values)) == values).all()
    values = np.unique(rng.integers(0, 2**29, 50_000).astype(np.uint64))
    assert 8 * len(parts.pack_cells(values)) < (np.log2(2**29 / 50_000) + 1.6) * len(values)


def test_pages_are_exchanged_in_less_than_their_size(spark):
    """Heads that one block alone has cross as a few bits each, and the parsed blocks are written once for three readers."""
    path = "/root/testdata/sf0.1/pages.parquet"
    before = shuffled_bytes(spark)
    assert html_text.extract(spark.read.parquet(path)).agg(F.sum("n_repeat")).first()[0] == 45_538
    written = shuffled_bytes(spark) - before
    assert written < 1.5 * os.path.getsize(path)


def test_hard_pages(spark):
    rows = [(1, "http://a.b/", None), (2, None, ""), (None, "http://a.b/", "<p>x"), (3, "nonsense", PAGE), (3, "nonsense", PAGE), (4, "HTTP://U:p@A.b:80/x", "<script>" + "x" * 200_000), (5, "http://a.b/5", "<div>" * 3000 + "deep"), (6, "", "<p " + "a=\"" * 500)]
    frame = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, text string, key string")
    got = html_text.extract(frame).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert Counter(r["text"] for r in got if r["page_id"] in (1, 2, 4)) == {"": 3}
    assert {r["text"] for r in got if r["page_id"] == 3} == {"Fish & chips <3 One two It alic next a b x y"}
    assert html_text.host_of("HTTP://U:p@A.b:80/x") == "a.b"
    assert html_text.extract(frame.limit(0)).count() == 0


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        sizes.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0.5 * sizes[0]
    assert docs.select("text").distinct().count() == docs.count()
    final = corpus_pipeline.run(spark, SMALL)
    assert set(final.columns) >= {"doc_id", "bucket", "batch"} and {r["doc_id"] for r in final.collect()} <= {r["doc_id"] for r in docs.collect()}
