"""Each operator against a brute-force version, and on odd tables: nulls, empty and long texts, repeated rows,
empty tables, other columns under clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("fieldmesh.llm")
import public_tokenizers  # noqa: E402

from fieldmesh.llm import bpe, decontaminate, imatch, langid, licenses, neardup, queries, scoring, stages, suffixdedup, toxicity, urlfilter  # noqa: E402

SCHEMA = "doc_id long, text string"
WORDS = "the of and in to it was for on that with as by at from is an or be are his this have not were which had".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", "ed", "s"]) for _ in range(n))


def odd(spark):
    """Nulls everywhere, empty, short and long texts, a repeated row, an id with two texts, columns that clash with the operators' own."""
    rng = random.Random(5)
    long = prose(rng, 6000)
    rows = [(1, None), (2, ""), (3, "a"), (4, " \n\t "), (5, long), (6, long), (7, "x" * 5000), (8, "é日本😀 " * 40), (9, "the same row here again"), (9, "the same row here again"), (10, "one"), (10, "two words"), (None, None), (None, "no id here at all")]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in ("node", "sig", "row", "bucket", "tag", "blob", "ord", "block", "k", "tail", "n", "root", "score", "nb")})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(3, 120)) for _ in range(60)]
    rows = []
    for i in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    return rows + [(200, ""), (201, "a b"), (202, "a b"), (203, "A  B")]


def test_near_duplicates_are_exact(spark, texts):
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_posting_lists_as_a_whole_lose_nothing(spark, texts, monkeypatch):
    want = neardup.near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()
    for name in ("WHOLE", "LIST", "BLOCK"):
        monkeypatch.setattr(neardup, name, 3)
    assert sorted(neardup.near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()) == sorted(want)


def test_large_clusters_are_exact(spark, monkeypatch):
    """Clusters of many blocks: near copies in a chain, copies of a long common part that is not enough, and stragglers."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "PASSES", (0,))
    rng = random.Random(11)
    shared = prose(rng, 60).split()
    rows = []
    for i in range(150):  # these drift apart, so links form long chains
        w = rows[-1][1].split() if i % 50 else prose(rng, 80).split()
        w[rng.randrange(80)] = f"drift{i}"
        rows.append((i, " ".join(w)))
    for i in range(150, 260):  # two thirds in common with all others: no link, but for a few
        w = shared + prose(rng, 30).split()
        rows.append((i, " ".join(w)))
        if i % 20 == 0:
            rows.append((1000 + i, " ".join([*w[:-1], "end"])))
    rng.shuffle(rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: find(i) for i in sets}


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                cover[k] += 1
                cover[k + 100] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[: len(b)] > 0
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("together", [50_000, 3])
def test_repeats_are_exact(spark, monkeypatch, together):
    monkeypatch.setattr(suffixdedup, "TOGETHER", together)
    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(3)]
    rows = [(i, "".join(rng.choice(base)[rng.randrange(200) : rng.randrange(210, 400)] for _ in range(4)) + "xy" * rng.randrange(150)) for i in range(50)]
    rows += [(100, "z" * 1000), (101, "z" * 150), (102, ""), (103, None), (104, "é" * 120)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == brute_repeats(rows)


def test_run_index_statistics():
    rng = np.random.default_rng(1)
    parts = [rng.integers(1, 3, rng.integers(1, 40)).astype(np.uint8) for _ in range(20)]
    text = np.concatenate([np.append(p, np.uint8(0)) for p in parts])
    ends = np.repeat(np.cumsum([len(p) + 1 for p in parts]) - 1, [len(p) + 1 for p in parts])
    index = suffixdedup.RunIndex(text, ends)
    suffixes = [bytes(text[i : ends[i]]) for i in index.order]
    assert suffixes == sorted(suffixes)

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert index.statistics().tolist() == [0] + [common(a, b) for a, b in zip(suffixes, suffixes[1:])]
    assert len(index.run_start) <= len(text)


def test_bpe_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(2)
    some = ["", "ΑΣ Σ", "a<|endoftext|>b <|startoftext|>", " x\x1cy\x85z q", "don't we'll I'M 12345 ½", "é ﬁ İstanbul", "日本語 😀", "aaaa" * 900, "theingan" * 700, "''s 's"]
    some += ["".join(rng.choice("etaoinshrdlu") for _ in range(3000)) for _ in range(2)]
    some += ["é\u0301 \u0301x\n" * 5000 + "Σ ΑΣ" * 4000, "un broken" + "é" * 40_000 + "\u0301 end"]
    for window in (16, None):
        e = bpe.Encoder(bpe.load_spec(path), window)
        for t in some:
            want = lib.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(e.encode(t), "<u4").tolist() == want
            shown = lib.decode(want, skip_special_tokens=False)
            assert bpe.decode(e, want) == shown
            assert bpe.digest(e, t) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
    assert bpe.decode(e, np.frombuffer(e.encode("Naïve café!"), "<u4").tolist(), False).split() == ["naïve", "café", "!"]
    got = bpe.digests(spark.createDataFrame([(1, "Hello there"), (2, None)], SCHEMA), path).collect()
    assert [r["n_tokens"] for r in got] == [2, 0] and got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_bpe_digests_come_from_the_decoder(monkeypatch):
    e = bpe.Encoder(bpe.load_spec(public_tokenizers.path("word_bpe_49k.json")))
    monkeypatch.setattr(bpe.Decoder, "push", lambda self, ids: "x" * len(ids))
    n, _, shown = bpe.digest(e, "some words of a text")
    assert shown == hashlib.sha256(b"x" * n).hexdigest()


@pytest.mark.parametrize("unit", ["theingan", "words and spaces "])
def test_bpe_streams_in_constant_memory(unit):
    """A word of 1 MB and a text of 6 MB: beside copies of the word, less than 3 MB are held."""
    import tracemalloc

    e = bpe.Encoder(bpe.load_spec(public_tokenizers.path("word_bpe_49k.json")))
    text = unit * ((6_000_000 if " " in unit else 1_000_000) // len(unit))
    tracemalloc.start()
    n = sum(len(x) for x in e.stream(text))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= len(text) / 4 and held < 3_000_000 + (3 * len(text) if " " not in unit else 0)


def test_bpe_cuts_ascii_words_alike():
    e, rng = bpe.Encoder(bpe.load_spec(public_tokenizers.path("word_bpe_49k.json"))), random.Random(6)
    text = "".join(map(chr, range(128))) + "".join(rng.choice("abz'sdtrevml 019_-\n\t\x1c\x0b<|") for _ in range(5000))
    assert e.ascii_words != e.words and e.ascii_words(text) == e.words(text)


def test_bpe_remembers_words_across_generations(monkeypatch):
    """A word in steady use is merged once, though more words than are remembered come by; long ones are not remembered; tasks share an encoder."""
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    spec = bpe.load_spec(public_tokenizers.path("word_bpe_49k.json"))
    e, fresh = bpe.Encoder(spec), bpe.Encoder(spec)
    merged, ids = [], e.transduce
    monkeypatch.setattr(e, "transduce", lambda data: merged.append(data) or ids(data))
    for k in range(26):
        word = "word" + chr(97 + k)
        assert e.encode(f"steady {word} steady {word}") == b"".join(map(fresh.encode, ("steady", word, "steady", word)))
    assert merged.count(b"steady") == 1 and len(merged) == 27
    assert e.encode("a " + "x" * 70 + " b") == b"".join(fresh.word("a")) + b"".join(fresh.word("x" * 70)) + b"".join(fresh.word("b")) and "x" * 70 not in e.known

    class Sent:
        value = spec

    assert bpe.encoder("one", Sent) is bpe.encoder("one", Sent) is not bpe.encoder("two", Sent)


def test_lookahead_needs_a_proper_list():
    assert bpe.lookahead([("a", "b"), ("ab", "c</w>")], "</w>") is not None
    assert bpe.lookahead([("ab", "c"), ("a", "b")], "") is None


def test_unigram_baseline_and_ppm(spark, texts):
    got = {r["doc_id"]: r for r in scoring.score(spark.createDataFrame(texts, SCHEMA)).collect()}
    counts = collections.Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(t.lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts:
        w = t.lower().split() + [None]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


@pytest.mark.parametrize("rare,held", [(2e-7, 96 << 20), (1e-3, 96 << 20), (1.0, 96 << 20), (0.0, 40_000), (0.0, 3_000), (2e-7, 16)])
def test_ppm_keeps_rare_contexts(spark, texts, monkeypatch, rare, held):
    """The score is that of a model of all contexts, whichever of them are broadcast, and however few bytes they may take."""
    monkeypatch.setattr(scoring, "RARE", rare)
    monkeypatch.setattr(scoring, "BYTES", held)
    got = {r["doc_id"]: r["score"] for r in scoring.score(spark.createDataFrame(texts, SCHEMA)).collect()}

    def keys_of(some):
        data = np.frombuffer(b"".join(t.encode() for t in some), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in some])])
        return scoring.grams(*scoring.sequence(data, off), np.diff(off))[0]

    keys = keys_of([t for i, t in texts if zlib.crc32(str(i).encode()) % 10])
    model = scoring.Model([np.unique(keys & ((1 << 9 * (k + 1)) - 1), return_counts=True) for k in range(scoring.ORDER + 1)])
    for i, t in texts:
        assert got[i] == pytest.approx(model.code(keys_of([t])).sum() / math.log(10)), i


@pytest.mark.parametrize("held", [1_500_000, 5_000])
def test_ppm_deals_counts_in_few_blobs(monkeypatch, held):
    """However many blobs a task reads, it makes one for each bucket and tag (times the portions it takes), and every count arrives once."""
    monkeypatch.setattr(scoring, "HELD", held)
    rng, nb, n = np.random.default_rng(8), 97, 60
    frequent = lambda k, own: (own % 5 == 0) & (k == scoring.LOW)  # noqa: E731  every fifth context of LOW symbols is broadcast
    read, want = [], []
    for tag in range(scoring.LOW, scoring.WORDS + 1):
        keys = np.unique(rng.integers(0, 1 << (62 if tag == scoring.WORDS else 9 * (tag + 1)), 8_000))
        records = scoring.packed(scoring.COUNT, keys, rng.integers(1, 9, len(keys)))
        context = keys if tag == scoring.WORDS else scoring.shared_suffix(keys >> 9)
        read += scoring.dealt(records, (scoring.mix64(context) % np.uint64(n)).astype(np.int64), tag)
        place = keys if tag == scoring.WORDS else scoring.places(keys >> 9, tag, frequent)
        want += [(tag, int(p), *r.tolist()) for p, r, at in zip(scoring.mix64(place) % np.uint64(nb), records, place) if at >= 0]
    made = [(t, b, x) for out in scoring.dealt_to_places(read, nb, frequent) for b, t, x in zip(*(out.column(c).to_pylist() for c in ("bucket", "tag", "blob")))]
    assert sorted((t, b, *r) for t, b, x in made for r in np.frombuffer(x, scoring.COUNT).tolist()) == sorted(want)
    total = sum(len(x) // scoring.COUNT.itemsize for b in read for x in b.column("blob").to_pylist())
    assert len(made) <= nb * (scoring.WORDS + 1 - scoring.LOW) * (total // held + 1) and (held < 10_000 or len(made) < total / 20)


def test_ppm_places_of_the_shortest_suffix_stay_in_their_bucket():
    context = np.random.default_rng(9).integers(0, 1 << 9 * scoring.ORDER, 1000)
    never = lambda k, own: np.zeros(len(own), bool)
    assert (scoring.places(context, scoring.ORDER, never) == scoring.shared_suffix(context)).all()
    longer = scoring.places(context, scoring.ORDER, lambda k, own: np.full(len(own), k < scoring.ORDER))
    assert (longer > context).all() and (longer & ((1 << 9 * scoring.ORDER) - 1) == context).all()


def test_ppm_is_what_the_definition_says():
    """Against a direct walk down the contexts, with escapes and exclusion; probabilities of all symbols sum to about 1."""
    seqs = [b"abracadabra", b"abacab", b"cadabra"]
    data = np.frombuffer(b"".join(seqs), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    seq, begin = scoring.sequence(data, off)
    keys, many = scoring.grams(seq, begin, np.diff(off))
    assert many.tolist() == [len(s) + 1 for s in seqs] and len(keys) == many.sum()
    tables = []
    for k in range(scoring.ORDER + 1):
        x, n = np.unique(keys & ((1 << 9 * (k + 1)) - 1), return_counts=True)
        tables.append((x, n))
    model = scoring.Model(tables)
    counts = [collections.defaultdict(dict) for _ in tables]
    for k, (x, n) in enumerate(tables):
        for a, b in zip(x.tolist(), n.tolist()):
            counts[k][a >> 9][a & 511] = b

    def direct(key):
        s, out, gone = key & 511, 0.0, set()
        for k in range(scoring.ORDER, -1, -1):
            here = {a: b for a, b in counts[k].get((key & ((1 << 9 * (k + 1)) - 1)) >> 9, {}).items() if a not in gone}
            if not here:
                continue
            total = sum(here.values()) + len(here)
            if s in here:
                return out + math.log(here[s] / total)
            out += math.log(len(here) / total)
            gone |= set(here)
        return out - math.log(257 - len(gone))

    for context in (0, (98 << 9) | 99, (1 << 40) | 5):
        some = np.array([(context << 9) | s for s in range(257)], np.int64)
        got = model.code(some)
        assert got == pytest.approx([direct(int(x)) for x in some])
        assert np.exp(got).sum() == pytest.approx(1)


def test_language_id(spark):
    rng = random.Random(4)
    alphabet = {"en": "the and ing tion of er", "de": "der und sch ung ein ich", "fr": "les des eau tion que oui"}
    rows = [(i, "".join(rng.choice(alphabet[x].split()) + rng.choice(["", " "]) for _ in range(rng.randrange(8, 80))), x) for i in range(300) for x in [rng.choice([*alphabet])]]
    rows += [(400, None, "en"), (401, "123 456", "de")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(got[i]["lang_pred"], x) for i, _, x in rows[:300] if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert got[400]["lang_pred"] == got[401]["lang_pred"] == "und"
    assert got[1]["held_out"] == (zlib.crc32(b"1") % 3 == 1)
    mixed = [(500, " ".join(" ".join(alphabet[x].split() * 3) for x in alphabet), "en"), (501, "the and of ing er " * 9, "en"), (502, None, "en"), (503, "", "de")]
    kept = stages.language(spark, spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string"), "")
    assert {r["doc_id"] for r in kept.where("doc_id >= 500").collect()} == {501}


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.2
        rows.append((i, prose(rng, 40) + (f" you {rng.choice(['idiot', 'moron', 'blorken'])} {prose(rng, 10)} {rng.choice(['scum', 'blorkel'])}" if bad else "")))
        labels.append((i, int(bad)))
    got = toxicity.score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    alone = toxicity.score(spark.createDataFrame([(1, "you idiot"), (2, "hello"), (3, None)], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [r["predicted"] for r in alone] == [1, 0, 0]


def test_toxicity_lists_do_not_hang_on_partitions(spark):
    """Entries and counts are those of a plain count over the sample, whatever partitions it comes in."""
    rng = random.Random(7)
    bad = ["blorken", "zzarg", "quibblo"]
    rows = [(i, prose(rng, 30) + (f" {rng.choice(bad)}ly {rng.choice(bad)}" if i % 5 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    models = [toxicity.learn(spark.createDataFrame(rows, SCHEMA).repartition(n), labels) for n in (1, 50)]
    assert models[0]["entries"] == models[1]["entries"] and np.allclose(models[0]["weights"], models[1]["weights"])
    sample = toxicity.sampled(spark.createDataFrame(rows, SCHEMA), labels, 10_000)
    taken = sample.collect()
    assert 200 < len(taken) and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in taken)
    half = [(r["text"], r["doc_id"] % 5 == 0) for r in taken if zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0]
    n = {y: collections.Counter(e for t, z in half if z == y for e in toxicity.entries_of(t)) for y in (True, False)}
    nt, nc = sum(z for _, z in half), sum(not z for _, z in half)

    def sure(e):
        a, b = n[True][e], n[False][e]
        share, toxic = a / (a + b), nt / (nt + nc)
        return a / nt > 8 * b / nc and (a + b) * (share * math.log(share / toxic) + ((1 - share) * math.log((1 - share) / (1 - toxic)) if b else 0)) > -math.log(toxicity.CHANCE)

    assert set(toxicity.lists(sample)[0][len(toxicity.INSULTS) :]) == {e for e in n[True] if sure(e)}
    assert any(e.endswith("blorken") for e in models[0]["entries"])


def test_label_model_estimates_voters_and_labels():
    """A better voter gets the higher accuracy; given labels that are often wrong weigh little."""
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    votes = np.stack([rng.random(4000) < np.where(truth, a, b) for a, b in ((0.95, 0.01), (0.8, 0.03), (0.8, 0.03), (0.4, 0.1))], 1).astype(float)
    noisy = np.where(rng.random(4000) < 0.65, truth, ~truth).astype(int)
    q, model = toxicity.label_model(votes, np.where(rng.random(4000) < 0.5, noisy, -1))
    assert ((q > 0.5) == truth).mean() > 0.95
    right = [model["fires"][1][k] - model["fires"][0][k] for k in range(4)]
    assert right[0] > right[1] > right[3]
    assert model["labels"][1] - model["labels"][0] < 0.5


def test_toxicity_and_language_take_one_text_of_a_repeated_id(spark):
    rows = [(1, f"the text number {k} of one id") for k in range(500)] + [(2, "another")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.sampled(spark.createDataFrame(rows, SCHEMA), labels, 100).count() <= 2
    x, _, _ = langid.sample_windows(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string"), 100)
    assert len(x) <= 2


def test_imatch(spark, texts):
    got = {r["doc_id"]: r for r in imatch.fingerprints(spark.createDataFrame(texts, SCHEMA)).collect()}
    order = sorted(texts, reverse=True)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        assert got[i]["edited_sha256"] == hashlib.sha256(imatch.edited(t, after).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
    prints = collections.defaultdict(set)
    for i, t in texts:
        prints[t].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    long = [got[i] for i, t in texts if len(t) > 200]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long])


def test_imatch_is_the_definition(spark, texts, monkeypatch):
    """Fingerprints and likeness by brute force: subset by subset, term by term."""
    monkeypatch.setattr(imatch, "BAND", (0.02, 0.4))
    rows = sorted(texts, reverse=True)
    words = lambda t: {w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w}
    count = collections.Counter(w for _, t in rows for w in words(t))
    band = {w for w, n in count.items() if 0.02 * len(rows) <= n <= 0.4 * len(rows)}
    assert 10 < len(band) < len(count)
    number = lambda w: xxhash.xxh3_64_intdigest(w.encode()) >> 1

    def part(term, level, deal):
        """The part of the lexicon that a term is dealt to, by an integer mix of its own."""
        x = (term + (level * 64 + deal + 1) * 0x9E3779B97F4A7C15) % 2**64
        return int(imatch.mix64(np.array([x], np.uint64))[0]) % 2**level

    def brute(t):
        own = words(t) & band
        own = sorted(map(number, own if len(own) >= imatch.FEW else words(t)))
        middle = max(2, math.ceil(math.log2(max(1, len(own)))))
        out = {}
        for level in (middle - 1, middle, middle + 1):
            out[level] = []
            for subset in range(imatch.SUBSETS):
                deal, which = divmod(subset, 2**level)
                inside = [x for x in own if part(x, level, deal) == which]
                out[level].append((xxhash.xxh32_intdigest(np.array(inside, "<i8").tobytes()) or 1) if inside else 0)
        return out

    def like(p, q):
        last = None
        for level in sorted(set(p) & set(q)):
            hit = [(a, b) for a, b in zip(p[level], q[level]) if a or b]
            if not hit:
                break
            last = sum(a == b for a, b in hit) / len(hit)
            if len(hit) <= imatch.SUBSETS * 3 / 4:
                break
        return last

    got = {r["doc_id"]: r for r in imatch.fingerprints(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in list(enumerate(rows))[::3]:
        after = rows[(k + 1) % len(rows)][1]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        p, e, q = brute(t), brute(changed), brute(after)
        for name, want in (("fingerprint", p), ("edited_fingerprint", e)):
            assert got[i][name] == ";".join(f"{level}:" + "".join(f"{x:08x}" for x in xs) for level, xs in sorted(want.items()))
        for name, other in (("near_edited", e), ("near_next", q)):
            want = like(p, other)
            assert got[i][name] == pytest.approx(float(p == other) if want is None else want)


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"].replace("person", "human").replace("copies", "dupes")
    rows = [(1, "x " * 50 + mit + " tail"), (2, None), (3, "no license here"), (4, licenses.TEMPLATES["apache-2.0-header"].upper()), (5, "// Released under\n * the MIT\tlicense!")]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(1, "mit"), (4, "apache-2.0-header"), (5, "mit-notice")}
    text = rows[4][1]
    assert text[got[5, "mit-notice"]["start"] : got[5, "mit-notice"]["end"]] == "Released under\n * the MIT\tlicense"


def test_licenses_without_their_first_words():
    """A text that lost or changed the first words is reported with the coverage it has, wherever it stands."""
    index = licenses.Index(licenses.TEMPLATES)
    mit, apache = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2.0-header"]
    for name, text in (("mit", mit[mit.index("free of charge") :]), ("mit", "Zzq qqz " + mit.split(" ", 2)[2]), ("apache-2.0-header", apache[apache.index("you may not") :])):
        for before in ("", "x " * 300):
            data = np.frombuffer((before + text).encode(), np.uint8)
            places = index.candidates(data, np.array([0, len(data)]))[0]
            got = {f[0]: f for f in licenses.scan_texts([before + text], [places], index, 0.8)[0]}
            assert got[name][1] >= 0.8 and got[name][4] == len((before + text).rstrip("."))


def test_license_alignment_is_the_plain_one():
    """Matched words and spans against a cell-by-cell local alignment within the band."""

    def plain(template, words, d, band):
        best, where, prev = 0.0, (0, 0, 0), {}
        low, high = max(0, d - band), min(len(words), d + len(template) + band)
        for i, w in enumerate(template):
            cur = {}
            for j in range(max(low, i + d - band), min(high, i + d + band + 1)):
                same = w == words[j]
                s, first, c = prev.get(j - 1, (0.0, -1, 0))
                got = (s + 1, first if first >= 0 else j, c + 1) if same else (s - 0.5, first, c)
                for other in (prev.get(j), cur.get(j - 1)):
                    if other and other[0] - 0.5 > got[0]:
                        got = (other[0] - 0.5, other[1], other[2])
                cur[j] = got = got if got[0] > 0 else (0.0, -1, 0)
                if same and got[0] > best:
                    best, where = got[0], (got[2], got[1], j)
            prev = cur
        return where

    rng = random.Random(11)
    for _ in range(60):
        template = [rng.randrange(8) for _ in range(rng.randrange(1, 25))]
        words = [rng.randrange(9) for _ in range(10)] + [w for w in template if rng.random() < 0.85] + [rng.randrange(9) for _ in range(10)]
        diagonals, band = np.arange(-3, 15), rng.randrange(1, 6)
        around = np.array([3, 4] + words + [5])  # other texts stand before and behind
        got = zip(*licenses.align(np.array(template), around, diagonals + 2, band, np.full(18, 2), np.full(18, 2 + len(words))))
        got = [(c, a - 2 if c else 0, b - 2 if c else 0) for c, a, b in got]
        assert [tuple(map(int, g)) for g in got] == [plain(template, words, d, band) for d in diagonals.tolist()]


def test_licenses_in_long_repetitive_texts():
    import time

    index = licenses.Index(licenses.TEMPLATES)
    sentence = licenses.TEMPLATES["mit"].split(". ")[0] + ". "
    began = time.time()
    for unit, some in ((sentence, False), ("Released under the MIT License. é ", True)):
        data = np.frombuffer((unit * (300_000 // len(unit))).encode(), np.uint8)
        places = index.candidates(data, np.array([0, len(data)]))[0]
        got = licenses.scan_texts([data.tobytes().decode()], [places], index, licenses.COVERAGE)[0]
        assert (len(got) == 300_000 // len(unit)) == some
    assert time.time() - began < 30


def test_license_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "own.txt").write_text(" ".join(f"word{k} of the licence" for k in range(300)))
    templates = licenses.templates_in(spark, f"file://{tmp_path}")
    docs = spark.createDataFrame([(1, "before " + templates["own"] + " after"), (2, "nothing of it")], SCHEMA)
    assert [(r["doc_id"], r["license"], r["coverage"]) for r in licenses.scan(docs, templates).collect()] == [(1, "own", 1.0)]


def test_decontamination_recall(spark):
    """Every planted item is found at up to the allowed edits; what is farther by brute force is not reported."""
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(12, 40)) + f" key{i}") for i in range(40)]
    rows = []
    for i, t in items:
        for f in (0.0, 0.1, 0.25):
            w = t.split()
            for _ in range(int(f * len(w))):
                p, kind = rng.randrange(len(w)), rng.random()
                w[p : p + 1] = ["zzq"] if kind < 0.34 else [] if kind < 0.67 else ["qqz", w[p]]
            rows.append((len(rows), "unrelated words go before it all " * 5 + " ".join(w) + " and others follow after that " * 5))
    rows.append((1000, "nothing of the kind " * 50))
    got = decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert sum((k, k // 3) in found for k in range(120)) >= 0.97 * 120
    assert all(r["doc_id"] != 1000 for r in got)

    def distance(a, b):
        row = list(range(len(b) + 1))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for r in got[:40]:
        assert distance(items[r["item_id"]][1].split(), rows[r["doc_id"]][1].split()) == r["edits"]
    left = decontaminate.clean(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {k for k, _ in rows} - {d for d, _ in found}


@pytest.mark.parametrize("where", ["front", "middle", "end"])
@pytest.mark.parametrize("n", [4, 38, 59])
def test_decontamination_finds_edits_together(n, where):
    """Items with floor(n / 4) words in a row dropped or replaced are found, alone and beside a two-word item, alike."""
    rng = random.Random(n)
    rows = [(i, " ".join(f"w{i}x{j}" if n < 10 else rng.choice(WORDS) + str(rng.randrange(40)) for j in range(n))) for i in range(40)]
    alone, beside = decontaminate.Items(rows), decontaminate.Items([*rows, (99, "the of")])
    at = {"front": 0, "middle": (n - n // 4) // 2, "end": n - n // 4}[where]
    found = []
    for i, t in rows:
        for put in ([], ["unknown"] * (n // 4)):
            w = t.split()
            w[at : at + n // 4] = put
            text = np.frombuffer(" ".join(["before"] * 70 + w + ["behind"] * 70).encode(), np.uint8)
            off = np.array([0, len(text)])
            got = {f[1:] for f in decontaminate.search_piece(alone, text, off)[0]}
            assert got == {f[1:] for f in decontaminate.search_piece(beside, text, off)[0]} - {f[1:] for f in decontaminate.search_piece(beside, text, off)[0] if f[1] == 99}
            found.append(any(f[0] == i for f in got))
    assert np.mean(found) >= 0.95


def test_decontamination_pair_bound_keeps_every_leak():
    """No window within the distance by brute force is left out before the embedding."""
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(12)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    items = decontaminate.Items(rows)
    for _ in range(30):
        w = rows[rng.randrange(25)][1].split()
        for _k in range(len(w) // 4):
            p = rng.randrange(len(w) + 1)
            w[p : p + rng.randrange(2)] = rng.choice([[], ["other"], [rng.choice(vocabulary)]])
        words = [rng.choice([*vocabulary, "other"]) for _ in range(9)] + w + [rng.choice(vocabulary) for _ in range(9)]
        ids = np.array([items.number.get(x, 0) for x in words] + [0])
        kept = {}
        for j, _, starts in items.regions(ids, np.array([0, len(ids)])):
            kept.setdefault(j, set()).update(starts.tolist())
        for j, seq in enumerate(items.seqs):
            d, a, _ = decontaminate.edit_span(seq, ids[:-1])
            if d <= len(seq) // 4:
                assert a in kept[j]


def test_decontamination_of_a_long_item():
    """An item of 20,000 words, with a fifth of its words replaced, within a text."""
    rng = random.Random(2)
    w = [f"x{rng.randrange(5000)}" for _ in range(20_000)]
    items = decontaminate.Items([(1, " ".join(w)), (2, "two words")])
    w[1000:5000] = ["gone"] * 4000
    text = np.frombuffer(("before it " * 50 + " ".join(w) + " behind it" * 50).encode(), np.uint8)
    assert [f[1] for f in decontaminate.search_piece(items, text, np.array([0, len(text)]))[0]] == [1]


def test_url_filter_both_joins(spark):
    rows = [(k, u, t) for k, (u, t) in enumerate([
        ("http://a.casino-win.example.net/x", "2024-03-01 00:00:00"), ("http://a.casino-win.example.net/x", "2024-10-01 00:00:00"), ("https://u:p@FREE-bets.example.net:8080/", "2024-01-01 00:00:00"),
        ("http://free-bets.example.net./", "2024-06-30 00:00:00"), ("http://ads-track.example.com/", "2024-05-21 00:00:00"), ("http://spam-farm.example.org/en/1", "2024-12-01 00:00:00"), (None, "2024-12-01 00:00:00"), ("not a url", None),
    ])]
    caps = spark.createDataFrame(rows + rows[:1], "page_id long, url string, fetched string")
    both = [sorted(map(tuple, urlfilter.evaluate(caps, urlfilter.entries(spark), n).collect()), key=repr) for n in (100_000, 0)]
    assert both[0] == both[1]
    assert {r[0]: r[4] for r in both[0]} == {0: True, 1: False, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}
    assert len(both[0]) == 9


OPERATORS = {
    "near_duplicates": lambda s, d: neardup.near_duplicates(d), "repeats": lambda s, d: suffixdedup.remove_repeats(d, True, ("node",)), "bpe": lambda s, d: bpe.digests(d, public_tokenizers.path("word_bpe_49k.json")),
    "ppm": lambda s, d: scoring.score(d), "imatch": lambda s, d: imatch.fingerprints(d), "licenses": lambda s, d: licenses.scan(d), "language": lambda s, d: langid.identify(d.withColumn("lang", F.lit(None).cast("string"))),
    "toxicity": lambda s, d: toxicity.score(d, s.createDataFrame([(1, 1), (None, 0), (5, None), (9, 1), (9, 0)], "doc_id long, toxic int")), "leaks": lambda s, d: decontaminate.leaks(d, s.createDataFrame([(1, None), (2, ""), (3, "a"), (None, "the same row")], "item_id long, text string")),
    "urls": lambda s, d: urlfilter.evaluate(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.lit(None).cast("timestamp").alias("fetched"), "k"), urlfilter.entries(s)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(spark, name):
    d = odd(spark)
    got = OPERATORS[name](spark, d).collect()
    if name not in ("licenses", "leaks"):
        assert sorted(r[0] if r[0] is not None else -1 for r in got) == sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in d.collect())
    assert OPERATORS[name](spark, d.limit(0)).count() == 0


def test_every_query_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain versions of each."""
    import corpus_pipeline

    rng = random.Random(9)
    shared, item = prose(rng, 60), prose(rng, 20) + " secret"
    rows = [(i, prose(rng, 80), "en", "s", 0) for i in range(30)]
    rows += [(30, rows[3][1], "en", "s", 0), (31, "12 34", "en", "s", 0), (32, None, "en", "s", 0), (33, prose(rng, 40) + " " + shared, "en", "s", 0), (34, prose(rng, 40) + " " + shared, "en", "s", 0), (35, prose(rng, 30) + " " + item, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left[name] = {r["doc_id"]: r for r in docs.collect()}
    ids = set(range(36))
    assert set(left["language_id"]) == ids - {31, 32}
    assert set(left["near_dedup"]) == ids - {31, 32, 30}
    cut = brute_repeats([(i, t) for i, t, *_ in rows if i in left["near_dedup"]])
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == cut[i][3] for i, r in left["suffix_dedup"].items())
    assert len(left["suffix_dedup"][34]["text"]) < len(rows[34][1])
    assert set(left["decontamination"]) == set(left["near_dedup"]) - {35}
    assert left["bpe"].keys() == left["decontamination"].keys()


STAGE = {f.__name__: f for _, f in stages.STAGES}


@pytest.mark.parametrize("name", sorted(STAGE))
def test_stages_on_odd_tables(spark, tmp_path, name):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, an empty table: no crash, and the same columns."""
    spark.createDataFrame([(1, None), (2, ""), (None, "the same row here again")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd(spark).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    out = STAGE[name](spark, docs, f"file://{tmp_path}")
    rows = out.collect()
    if name != "tokens":
        assert out.columns == docs.columns
    assert STAGE[name](spark, docs.limit(0), f"file://{tmp_path}").count() == 0
    if name == "near_duplicates":
        # 5 and 6 are copies, 9 comes twice, 10 has two texts that are not alike
        assert sorted((str(r["doc_id"]), len(r["text"] or "")) for r in rows) == sorted((str(i), len(t or "")) for i, t in {(r["doc_id"], r["text"]) for r in docs.collect()} if i != 6)


def test_one_of_each_group_stays_where_ids_repeat(spark):
    """An id with two texts that are alike, and one with a text like another id's: one row of each group stays."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (1, base + " more"), (2, "of another kind " * 3), (3, base), (4, " ".join(f"v{k}" for k in range(60))), (4, "alone with its own words")]
    left = stages.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r["doc_id"] for r in left) == [1, 2, 4, 4]
