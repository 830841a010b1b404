"""Each operator over odd rows and an empty table, against brute force."""

import collections
import glob
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from roadlark.llm import bpe, covertree, jaccard, langid, maxent, merkle, mixing, pii, quality, sharding, tandem, tokenfiles, toxicity
from roadlark.llm.common import Scratch
from roadlark.llm.queries import byte_bpe_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


from tests.llm.conftest import prose


def by_text(rows, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in rows)


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


# 1 sharding


def test_shards(odd, odd_rows, none):
    out = sharding.shard(odd, shards=8).collect()
    assert by_text(out, "doc_id", "size", "text_crc32") == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none, shards=8).count() == 0


def test_shards_are_near_equal_and_keep_copies_together(spark):
    from tests.llm.conftest import prose

    rows = [(i, prose(i % 1500, 20 + i * 7 % 300)) for i in range(3000)] + [(5000 + i, "hot " * 40) for i in range(2000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    sums = collections.Counter()
    shards_of = collections.defaultdict(set)
    for r in out:
        sums[r["shard"]] += r["size"]
        shards_of[r["text_crc32"]].add(r["shard"])
    mean = sum(sums.values()) / 8
    assert max(sums.values()) < 1.02 * mean and min(sums.values()) > 0.98 * mean
    split = [c for c, s in shards_of.items() if len(s) > 1]
    assert split in ([], [zlib.crc32(b"hot " * 40)])


# 2 Jaccard join


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, u = [shingle_set(r[1]) for r in rows], Union()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                u.join(i, j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[u.root(i)].append(i)
    least = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in groups.items()}
    return collections.Counter((rows[i][0], len(sets[i]), least[u.root(i)] if sets[i] else rows[i][0]) for i in range(len(rows)))


def test_jaccard_odd_rows(odd, odd_rows, none):
    out = jaccard.join(odd).collect()
    assert by_text(out, "doc_id", "n_shingles", "component_id") == brute_components(odd_rows)
    assert jaccard.join(none).count() == 0


def test_jaccard_large_families(spark, monkeypatch):
    """A passage that most texts share, a family of drifting copies, and cells that are salted."""
    import random

    monkeypatch.setattr(jaccard, "SALT_NODES", 16)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "FLUSH", 4096)
    monkeypatch.setattr(jaccard, "RANGE_BYTES", 1 << 14)
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 5000)}"
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join([word() for _ in range(60)] + passage)) for i in range(60)]
    now = [word() for _ in range(150)]
    for i in range(90):
        now = list(now)
        now[rng.randrange(150)] = word()
        rows.append((1000 + i, " ".join(now)))
    for i in range(40):
        base = [f"b{k}" for k in range(150)]
        for _ in range(rng.choice([1, 2, 4, 6])):
            base[rng.randrange(150)] = word()
        rows.append((2000 + i, " ".join(base)))
    rows += [(5000 + i, rows[0][1]) for i in range(70)] + [(6000 + i, " \n") for i in range(50)] + [(7000 + i, " ".join(passage)) for i in range(3)]
    path = Scratch(spark, "t").path("docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    out = jaccard.join(spark.read.parquet(path)).collect()
    assert by_text(out, "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_rising_values_pack():
    for values in ([], [5], [1, 2, 1 << 47], [3, 3 + (1 << 20)], sorted(np.random.default_rng(2).integers(0, 1 << 48, 500).tolist())):
        x = np.array(values, np.uint64)
        assert jaccard.unpack(jaccard.pack(x), len(x)).tolist() == values


def test_bound_is_never_too_low():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.integers(0, 1 << 62, rng.integers(5, 900), dtype=np.uint64)
        b = np.unique(np.r_[a[: rng.integers(1, len(a))], rng.integers(0, 1 << 62, 40, dtype=np.uint64)])
        a = np.unique(a)
        p = jaccard.Points([jaccard.group_counts(a, len(a)), jaccard.group_counts(b, len(b))])
        bound = p.bound(np.array([0]), np.array([1]))[0]
        assert bound == 0 or bound >= len(np.intersect1d(a, b))
        assert jaccard.overlap_bound(p.coarse[:1], p.coarse[1:])[0] >= len(np.intersect1d(a, b))


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(1)
    counts = rng.poisson(3, (300, jaccard.GROUPS)).astype(np.uint8)
    counts[100:200] = np.maximum(0, counts[:100].astype(int) - (rng.random((100, jaccard.GROUPS)) < 0.05)).astype(np.uint8)
    sizes = counts.sum(1, dtype=np.int64)
    found = {tuple(sorted(p)) for a, b, _ in jaccard.CountTree(counts, sizes).pairs() for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if jaccard.possible(sizes[[i]], sizes[[j]], jaccard.overlap_bound(counts[[i]], counts[[j]]))[0]}
    assert found == want and len(want) >= 100


def test_one_of_each_group_stays(odd, none):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and 4 in ids and 5 in ids
    assert jaccard.keep_one(none).count() == 0


# 3 sanitisation


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return [f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def test_base_spans(odd, odd_rows, none):
    out = pii.spans(odd).select("doc_id", "base_sha256", "n_email", pii.spelled("found").alias("spans")).collect()
    want = [(r[0], brute_spans(r[1] or "")) for r in odd_rows]
    assert by_text(out, "doc_id", "base_sha256") == collections.Counter((d, hashlib.sha256(",".join(s).encode()).hexdigest()) for d, s in want)
    assert sum(r["n_email"] for r in out) == sum(s.startswith("email") for _, own in want for s in own)
    assert pii.spans(none).count() == 0


def test_base_spans_of_random_texts():
    import random

    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab.@-+ 0123456789()é") for _ in range(rng.randint(0, 60)))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in pii.base_spans(text)] == brute_spans(text)


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a.b" * 100_000, "1." * 150_000, "@" * 100_000, "+1" * 100_000):
        pii.base_spans(text)


def test_disclosing_terms_go(spark):
    from tests.llm.conftest import prose

    rows = [(i, f"{prose(i, 30)} Zanzarella writes from jane{0}@mail.example.com today {prose(1000 + i, 30)}") for i in range(6)]
    rows += [(100 + i, prose(5000 + i, 60)) for i in range(300)] + [(900, "Nobody met Zanzarella here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["s"] for r in pii.spans(docs).select("doc_id", pii.spelled("found").alias("s")).collect()}
    at = rows[-1][1].index("Zanzarella")
    assert f"term:{at}:{at + 10}" in spans[900]
    assert all(spans[100 + i] == "" for i in range(300))
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Zanzarella" not in texts[900] and "<EMAIL>" in texts[0] and texts[100] == rows[6][1]


def test_secrets_go_and_words_stay(spark):
    import random

    rng = random.Random(2)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(5)]
    rows = [(i, f'{prose(i, 200)} token = "{k}" {prose(900 + i, 30)}') for i, k in enumerate(keys)]
    rows += [(100 + i, f"{prose(3000 + i, 150)} internationalisations silverwindowgarden2024 eveningmarketrivers") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["s"] for r in pii.spans(docs).select("doc_id", pii.spelled("found").alias("s")).collect()}
    for i, k in enumerate(keys):
        at = rows[i][1].index(k)
        assert out[i] == f"term:{at}:{at + 40}"
    assert all(out[100 + i] == "" for i in range(60))


def test_near_terms_against_a_plain_loop():
    import random

    rng = random.Random(7)
    text = " ".join(rng.choice(["a.b@c.example", "1.2.3.4", "word", "x7", "naïve", "42", "+1 (555) 123-4567"]) for _ in range(400))
    spans = pii.base_spans(text)
    data = np.frombuffer(text.encode(), np.uint8)
    place = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
    a, b, h = pii._terms(data, np.zeros(1, np.int64))
    free = [k for k in range(len(a)) if not any(a[k] < place[e] and b[k] > place[s] for s, e, _ in spans)]
    entity = lambda s, e, k: int.from_bytes(hashlib.blake2b(f"{pii.KINDS[k]}:{text[s:e].lower()}".encode(), digest_size=8).digest(), "little", signed=True)
    want = set()
    for s, e, k in spans:
        before = [x for x in free if a[x] < place[s]][-pii.NEAR :]
        after = [x for x in free if a[x] >= place[s]][: pii.NEAR]
        want |= {(entity(s, e, k), int(h[x].astype(np.int64))) for x in before + after}
    found = pii._near_terms(text, spans)
    assert {(e, t) for e, t in zip(found[0].tolist(), found[1].tolist())} == want


# 4 language model


def test_few_repeats(spark):
    """Hash ranges without a pair seen twice, and batches without a pair that has a weight."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        for texts in (["alpha beta", "gamma delta"], [f"alpha beta gamma w{i}" for i in range(40)], [f"u{i}a u{i}b u{i}c" for i in range(60)], [None]):
            out = maxent.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
            assert sorted(r["doc_id"] for r in out) == list(range(len(texts)))
            for r in out:
                assert math.isfinite(r["score"]) and r["score"] < 0
                assert r["n_tokens"] == len((texts[r["doc_id"]] or "").split()) + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_base_score_and_gain(odd, odd_rows, none):
    out = maxent.score(odd).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = [(r[0], [*WORD.findall((r[1] or "").translate(LOWER)), "\n"]) for r in odd_rows]
    c = collections.Counter(w for d, t in tokens if not held(d) for w in t)
    n = sum(c.values())
    z = math.log10(n + 0.5 * (len(c) + 1))
    want = collections.Counter((d, held(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10(c[w] + 0.5) - z for w in t), 5)) for d, t in tokens)
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in out)
    assert maxent.score(none).count() == 0


def test_model_learns_context(spark):
    import random

    rng = random.Random(1)
    chain = {f"w{i}": [f"w{(i * 7 + k) % 60}" for k in range(3)] for i in range(60)}
    rows = []
    for i in range(400):
        w, text = "w0", []
        for _ in range(60):
            w = rng.choice(chain[w])
            text.append(w)
        rows.append((i, " ".join(text)))
    held = [r for r in maxent.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.7 * sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one():
    tables = maxent.Tables((np.arange(1, 50, dtype=np.uint64), np.arange(49, 0, -1), np.arange(49, dtype=np.uint8) % 7))
    model = maxent.Model(tables)
    model.class_bias[:] = np.random.default_rng(0).normal(0, 1, maxent.CLASSES)
    model.word_previous[3] = np.random.default_rng(1).normal(0, 1, maxent.OUTCOMES)
    assert np.allclose(np.exp(model.class_logs(3)).sum(1), 1)
    sums = np.bincount(model.outcome_class, np.exp(model.word_logs(3)), maxent.CLASSES)
    assert np.allclose(sums, 1)


def test_pairs_are_features_of_their_own(spark):
    """Features are all pairs seen twice or more; each (token, class) still sums to one; gradients end near zero."""
    texts = [prose(i, 50) for i in range(40)] + ["rare words stand here"] * 3 + ["once only " + prose(99, 5)]
    docs = spark.createDataFrame([(x, False) for x in texts], "_text string, held_out boolean")
    scratch = Scratch(spark, "pairs")
    words = maxent.word_counts(docs, 3, scratch)
    tables = maxent.Tables(maxent._head(words, 0))
    logs = np.full((maxent.PREVIOUS, maxent.OUTCOMES), -3.0, np.float32)
    rows = maxent.pair_weights(docs, tables, logs, maxent.Spread(tables, 2000, 4), scratch, steps=200).toPandas()
    weights, norms = {}, {}
    for r in rows.itertuples():
        for p, c, w in zip(maxent.expand_words(tables.words, r.previous), maxent.expand(r.codes), maxent.expand(r.amounts).view("<f4"), strict=True):
            (weights if c >= 0 else norms)[(int(p), int(c))] = float(w)
    hashed, seen, classes = {}, collections.Counter(), collections.Counter()
    for x in texts:
        data = np.frombuffer(x.encode(), np.uint8)
        spans = [m.span() for m in WORD.finditer(x)]
        own = maxent.word_hashes(data, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
        before = int(maxent.START)
        for h in [*map(int, own), int(maxent.END)]:
            code = int(np.searchsorted(tables.words, np.uint64(h)))
            hashed[code] = int(tables.kinds[code])
            seen[(before, code)] += 1
            classes[(before, hashed[code])] += 1
            before = h
    assert set(weights) == {k for k, n in seen.items() if n >= 2}
    assert set(norms) == {(p, -1 - hashed[c]) for p, c in weights}
    for (p, minus), norm in norms.items():
        own = {c: w for (q, c), w in weights.items() if q == p and hashed[c] == -1 - minus}
        assert abs((1 - 0.001 * len(own) + sum(0.001 * 10**w for w in own.values())) * 10**norm - 1) < 1e-4
        for c, w in own.items():
            assert abs(seen[(p, c)] - classes[(p, -1 - minus)] * 0.001 * 10 ** (w + norm) - w * math.log(10)) < 0.05


def test_frequent_pairs_are_spread_without_change(spark):
    docs = spark.createDataFrame([(i, "the " + " the ".join(prose(i % 7, 40).split())) for i in range(120)] + [(500 + i, "") for i in range(60)], "doc_id long, text string")
    one, many = ({r["doc_id"]: r["score"] for r in maxent.score(docs, range_tokens=n).collect()} for n in (1 << 21, 256))
    assert one.keys() == many.keys() and all(abs(one[d] - many[d]) < 1e-3 for d in one)


# 5 toxicity


def test_toxicity(spark, odd, none):
    from tests.llm.conftest import prose

    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        text = prose(i, 80).split()
        if bad:
            for k in (10, 40):
                text[k] = ["zorkblat", "vexhund"][k % 4 // 2]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(1001, prose(900, 60) + " zorkblatt zorkblats " + prose(901, 20)), (1002, prose(902, 80)), (1003, ""), (1004, None)]
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(docs, given).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] == (i in held) for i in range(240))
    assert sum(out[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert out[1001]["predicted"] == 1 and out[1002]["predicted"] == 0  # an unseen spelling
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert toxicity.score(none, given).count() == 0
    assert toxicity.score(odd, given.limit(0)).where("score <> 0").count() == 0


# 6 and 7 tokens


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe_file())


def test_token_files(spark, odd, odd_rows, none):
    path = Scratch(spark, "t").path("files")
    tokenfiles.write(odd, path, byte_bpe_file())
    out = tokenfiles.read(spark, path).collect()
    want = [(r[0], np.array([*library().encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")) for r in odd_rows]
    assert by_text(out, "doc_id", "n_tokens", "ids_crc32") == collections.Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in want)
    start = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    got = {r["doc_id"]: list(r["ids"]) for r in tokenfiles.lookup(spark, path, [8, 12, 999]).collect()}
    assert got == {d: x.tolist() for d, x in want if d in (8, 12)}
    record = spark.read.parquet(f"{path}/shards").first().asDict()
    with pytest.raises(ValueError):
        tokenfiles.Shard(record, b"another dictionary")
    tokenfiles.write(none, path + "0", byte_bpe_file())
    assert tokenfiles.read(spark, path + "0").count() == 0


def test_records_are_bounded_and_the_dictionary_is_reproducible(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", 2000)
    rows = [(i // 3 if i % 5 else None, prose(i, 200)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    paths = [Scratch(spark, "t").path(f"bounded{k}") for k in range(2)]
    for path, given in zip(paths, (docs, docs.repartition(5)), strict=True):
        tokenfiles.write(given, path, byte_bpe_file())
    records = spark.read.parquet(f"{paths[0]}/shards").collect()
    assert len(records) > 20 and all(len(r["payload"]) < 2000 + 1500 for r in records)
    assert tokenfiles._read_dictionary(spark, paths[0]) == tokenfiles._read_dictionary(spark, paths[1])
    one, two = (by_text(tokenfiles.read(spark, p).collect(), "doc_id", "start", "n_tokens", "ids_crc32") for p in paths)
    assert one == two and sum(one.values()) == 300


def test_merges_of_an_earlier_span_are_refused():
    import json

    letters = bpe.byte_letters()
    tokens = [*letters, "ab", "abc"]
    file = {"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [["ab", "c"], *[["a", "b"]] * 1]}, "added_tokens": [{"content": "<|endoftext|>", "id": 300}]}
    bpe.Merges(json.dumps(file))  # one span holds both
    bpe.SPAN, span = 1, bpe.SPAN
    try:
        with pytest.raises(ValueError):
            bpe.Merges(json.dumps(file))
    finally:
        bpe.SPAN = span


def test_library_encoder_on_random_texts():
    import random

    rng, tk = random.Random(9), library()
    with open(byte_bpe_file(), encoding="utf-8") as f:
        e = tokenfiles.LibraryEncoder(f.read())
    texts = ["".join(rng.choice("ab 'st\n\t.,1é日½ \x1f 🙂_　") for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["a <|endoftext|> b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts, 2)] == [[*y.ids, 2] for y in tk.encode_batch(texts, add_special_tokens=False)]


def test_token_file_workers_share_an_encoder_and_ask_in_bounded_calls(spark, tmp_path, monkeypatch):
    """Payloads are compressed once, a worker's tasks share what it knows, and pieces go to the library a few at a time."""
    docs = spark.createDataFrame([(k, f"Word {k}  two\tspaces {k % 7}") for k in range(300)], "doc_id long, text string").repartition(7)
    tokenfiles.write(docs, str(tmp_path / "files"), byte_bpe_file())
    files = glob.glob(str(tmp_path / "files/shards/*.parquet"))
    assert {pq.ParquetFile(f).metadata.row_group(0).column(10).compression for f in files} == {"UNCOMPRESSED"}
    tk = library()
    with open(byte_bpe_file(), encoding="utf-8") as f:
        vocab = f.read()
    e = tokenfiles.worker_encoder(vocab)
    assert tokenfiles.worker_encoder(vocab) is e
    monkeypatch.setattr(tokenfiles, "CALL_PIECES", 3)
    calls, ids = [], e._ids
    monkeypatch.setattr(e, "_ids", lambda pieces: calls.append(len(pieces)) or ids(pieces))
    texts = [f"Opens{k} with{k} many  {k} words{k}" for k in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [y.ids for y in tk.encode_batch(texts, add_special_tokens=False)]
    assert max(calls) <= 3


def test_bpe_round_trip(odd, odd_rows, none):
    out = bpe.round_trip(odd, byte_bpe_file()).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter()
    for r in odd_rows:
        ids = library().encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library().decode(ids, skip_special_tokens=False).encode())] += 1
    assert by_text(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert all(r["is_lossless"] for r in out)
    assert bpe.round_trip(none, byte_bpe_file()).count() == 0


def test_pair_index_on_random_texts():
    import random

    rng, tk = random.Random(4), library()
    with open(byte_bpe_file(), encoding="utf-8") as f:
        e = bpe.Encoder(bpe.Merges(f.read()))
    texts = ["".join(rng.choice("aab 'st\n\t.1é日½ \x1f🙂_") for _ in range(rng.randint(0, 70))) for _ in range(2000)] + ["a" * 999]
    assert [x.tolist() for x in e.encode(texts)] == [y.ids for y in tk.encode_batch(texts, add_special_tokens=False)]


def test_bpe_memory_does_not_grow_with_new_pretokens():
    import tracemalloc

    import pyarrow as pa

    with open(byte_bpe_file(), encoding="utf-8") as f:
        e = bpe.Encoder(bpe.Merges(f.read()))
    letters = np.random.default_rng(4).integers(97, 123, (250_000, 9), dtype=np.uint8)
    words = [" " + w.tobytes().decode() for w in letters]
    tracemalloc.start()
    e._learn(words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20  # the index of all these words at once takes 165 MB
    some = [*words[:500], *words[52_300:52_600], *words[-500:]]  # a part of LEARN_BYTES ends in between
    e = bpe.Encoder(e.merges)
    e._learn(words)
    starts = np.cumsum(e.lengths) - e.lengths
    at = {w: k + 1 for k, w in enumerate(words)}  # 0 is the end-of-text marker
    assert [e.ids[starts[at[w]] : starts[at[w]] + e.lengths[at[w]]].tolist() for w in some] == [y.ids for y in library().encode_batch(some, add_special_tokens=False)]
    batch = pa.RecordBatch.from_pydict({"text": ["x" * (1 << 19)]})
    assert all(sum(map(len, texts)) <= 3 << 20 for _, texts in bpe.blocks(iter([batch] * 20), "text"))


def test_bpe_remembers_a_bounded_number_of_pretokens():
    import tracemalloc

    with open(byte_bpe_file(), encoding="utf-8") as f:
        e = bpe.Encoder(bpe.Merges(f.read()))
    letters = np.random.default_rng(5).integers(97, 123, (400_000, 9), dtype=np.uint8)
    texts = [" ".join(w.tobytes().decode() for w in part) for part in np.split(letters, 5)]
    tracemalloc.start()
    got = [e.encode([t])[0] for t in texts]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(e.known) < 190_000 and most < 70 << 20
    assert [x.tolist() for x in got] == [y.ids for y in library().encode_batch(texts, add_special_tokens=False)]


def test_bpe_writes_ids_in_row_groups_that_are_read_in_small_arrays(spark):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(k, " ".join(map(str, rng.integers(0, 10**6, 1500).tolist()))) for k in range(800)], "doc_id long, text string").coalesce(1)
    out = bpe.round_trip(docs, byte_bpe_file(), with_ids=True)
    groups = [f.metadata.row_group(k) for f in map(pq.ParquetFile, (x.removeprefix("file://") for x in out.inputFiles())) for k in range(f.num_row_groups)]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) < 2 * bpe.ROW_GROUP
    tk = library()
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == {r["doc_id"]: tk.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}


# 8 quality rules


def brute_quality(text):
    w = WORD.findall(text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_quality_counts(odd, odd_rows, none):
    out = quality.score(odd).collect()
    want = collections.Counter((r[0], *brute_quality(r[1] or "")) for r in odd_rows)
    assert by_text(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not any(r["kept"] and r["base_failed"] for r in out)
    assert quality.score(none).count() == 0


def test_frequent_lines(spark):
    from tests.llm.conftest import prose

    menu = "Home | News | About | Contact"
    rows = [(i, f"{prose(i, 60)}\n{menu.upper() if i % 2 else menu}\n{prose(500 + i, 10)}", "h") for i in range(60)]
    rows += [(100, "\n".join([menu] + [" ".join(menu.split()[k % 5 :]) for k in range(3)] * 30), "h"), (101, "\n".join([menu] * 9 + ["one two three"] * 2), "h")]
    rows += [(200 + i, prose(7, 60), "copies") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in quality.score(docs, min_words=5, max_repeat_percent=1000).collect()}
    assert all(out[i]["n_removed_words"] == 7 and out[i]["kept"] for i in range(60))
    assert out[101]["n_removed_words"] == 63 and not out[101]["kept"]  # depleted
    assert all(out[200 + i]["kept"] and out[200 + i]["n_removed_words"] == 0 for i in range(50))  # copies of one text are one document
    texts = {r["doc_id"]: r["text"] for r in quality.clean(docs, min_words=5, max_repeat_percent=1000).collect()}
    assert 101 not in texts and "About" not in texts[0] and texts[200] == rows[-1][1]


def test_colliding_windows(spark, monkeypatch):
    """Six bits of hash collide in every text; the counts stay those of the words."""
    import random

    monkeypatch.setattr(quality, "POSITION_BITS", 58)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(n)), "s") for i, n in enumerate([3, 4, 5, 23, 40, 80, 300])]
    out = {r["doc_id"]: r["n_repeat_words"] for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out == {i: brute_quality(t)[4] for i, t, _ in rows}


def test_repeats_of_a_long_text(spark):
    text = " ".join(f"w{i * 7919 % 400_000}" for i in range(1_000_000))
    out = quality.score(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert (out["n_words"], out["n_repeat_words"]) == (1_000_000, 1_000_000)


# 9 cover tree

def test_far_points_are_compared_once_and_in_single_precision_first():
    """Points that no net thins out get no level above themselves; pairs right at the limit are not lost to rounding."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    x[750:800] = x[:50] + rng.normal(0, 0.06 * np.sqrt(64), (50, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=(50, 64))
    side -= (side * x[50:100]).sum(1)[:, None] * x[50:100]
    side /= np.linalg.norm(side, axis=1)[:, None]
    x[800:850] = 0.9 * x[50:100] + np.sqrt(1 - 0.81) * side  # cosine 0.9 but for rounding
    a, b = covertree.CoverTree(x[:750]), covertree.CoverTree(x[750:])
    assert len(a.levels) == len(b.levels) == 1
    found = {(int(p), int(q)) for i, j in covertree.near_pairs(a, b, float(np.sqrt(0.2))) for p, q in zip(i, j, strict=True)}
    assert set(zip(*(k.tolist() for k in np.nonzero(x[:750] @ x[750:].T >= 0.9 - 1e-12)), strict=True)) <= found
    assert {(50 + k, 50 + k) for k in range(50)} <= found and len(found) < 1000



def test_cover_tree(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 16))
    near = base[rng.integers(0, 150, 200)] + rng.normal(0, 0.12, (200, 16))
    chain = [base[0]]
    for _ in range(40):
        chain.append(chain[-1] + rng.normal(0, 0.25, 16))
    vectors = [v.astype(np.float32).tolist() for v in [*base, *near, *np.array(chain), *[base[1]] * 30, base[1] * 3]]
    rows = list(enumerate(vectors)) + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (9005, [float("inf")] * 16), (9006, [1.0, 2.0]), (9007, [2.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    u, links = Union(), collections.Counter()
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows[:-7]} | {9006: np.array([1, 2]) / 5**0.5, 9007: np.array([1, 2]) / 5**0.5}
    for i in unit:
        for j in unit:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    for block in (4096, 32):
        out = covertree.links(frame, block_points=block, cell_points=100).collect()
        assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out} == {(i, links[i], u.root(i), u.root(i) == i) for i, _ in rows}
        assert len(out) == len(rows)
    assert covertree.links(frame.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [1.0, 0.01], "x")], "vec_id long, embedding array<double>, hash string")
    out = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in covertree.links(nameless).collect())
    assert out == {(None, 0, None): 1, (1, 1, 1): 2, (2, 1, 1): 1}


def test_far_blocks_never_meet(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.05, 24)).astype(np.float32).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    points = frame.selectExpr("cast(vec_id as string) as hash", "vec_id as point", "1L as times", "embedding as u", "24 as dim")
    scratch = Scratch(spark, "t")
    dealt = covertree._dealt(points.select("hash", "point", "times", "u", "dim"), 600, float(np.sqrt(0.2)), 50, 20, 5, scratch)
    blocks = dealt.select("block").distinct().count()
    pairs = dealt.select("left", "right").distinct().count()
    assert pairs < 0.6 * blocks * (blocks + 1) / 2 and dealt.count() < 0.6 * 600 * blocks
    out = covertree.links(frame, block_points=50, cell_points=20).collect()
    assert {r["component_id"] for r in out} == set(range(6)) and all(r["n_links"] == 99 for r in out)


# 10 mixing


def test_mixture(odd, odd_rows, none):
    out = mixing.mix(odd).collect()
    sizes = collections.Counter()
    for r in odd_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.water_fill([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2.0)
    assert sum(target) == pytest.approx(1.5 * sum(sizes.values()))
    assert {(r["source"], r["source_size"], round(r["target"], 6)) for r in out} == {(s, sizes[s], round(t, 6)) for s, t in zip(order, target)}
    assert by_text(out, "doc_id", "size") == collections.Counter((r[0], len(WORD.findall(r[1] or ""))) for r in odd_rows)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    assert sum(r["taken"] for r in out) <= 1.5 * sum(sizes.values())
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixture_meets_targets_and_reruns_agree(spark):
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 20 + i % 50), f"s{0 if i % 3 else i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = ({r["doc_id"]: r["taken"] for r in mixing.mix(d).collect()} for d in (docs, docs.repartition(7)))
    assert one == two
    taken, target = collections.Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 80 for s, t in target.items())
    many = collections.Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert all(many[d] * len(rows[d][1].split()) == t for d, t in one.items())


def brute_taken(spark, docs, budget_share=1.5, epochs=2):
    """The queue, played one document at a time."""
    rows = mixing.mix(docs).collect()
    keys = {(r["doc_id"], r["source"], r["t"]): r["k"] for r in docs.select("doc_id", "source", "text", mixing.row_key("doc_id", "source", "text").alias("rk")).selectExpr("doc_id", "source", "text as t", "xxhash64(rk, 11) as k").collect()}
    turn = {(d, s): k for (d, s, _), k in keys.items()}
    queue, done = [], collections.Counter()
    for source in {r["source"] for r in rows}:
        # by the upper 30 bits of the shuffle (its bucket), then by the whole of it
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (turn[r["doc_id"], source], r["doc_id"]))
        cum = 0
        for _ in range(epochs):
            for r in own:
                cum += r["size"]
                if r["target"]:
                    queue.append((cum / r["target"], r["doc_id"], r["size"]))
    left = budget_share * sum(r["size"] for r in rows)
    for _, same in __import__("itertools").groupby(sorted(q for q in queue if q[2]), key=lambda q: q[0]):
        same = list(same)
        if sum(q[2] for q in same) > left:
            break
        for _, doc, size in same:
            left -= size
            done[doc] += size
    return {r["doc_id"]: done[r["doc_id"]] for r in rows}, {r["doc_id"]: r["taken"] for r in rows}


def test_mixture_against_a_played_queue(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rows = [(i, prose(i, 5 + i * 13 % 40), ["a", "b", None, "c"][i % 7 % 4]) for i in range(900)] + [(2000 + i, " ", "wordless") for i in range(5)] + [(3000, None, "null text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = brute_taken(spark, docs)
    assert got == want and sum(want.values()) > 0
    assert all(got[2000 + i] == 0 for i in range(5))


def test_mixture_keeps_its_table_of_sources_out_of_python_workers(spark):
    slim = spark.createDataFrame([("b", 3), (None, 2), ("a", 5)], "source string, size long")
    table = mixing._sources(spark, slim, mixing.CYCLE, 1.5, 2)
    assert table.schema.simpleString() == "struct<name:string,place:int,source_size:bigint,source_rows:bigint,target:double>"
    assert [tuple(r)[:4] for r in table.collect()] == [("a", 0, 5, 1), ("b", 1, 3, 1), (None, 2, 2, 1)]
    assert "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()  # a list gives a scan of an RDD from Python


def test_mixture_without_words(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(docs).collect()] == [(0, 0.0)] * 2 and mixing.mixed(docs).count() == 0


def test_water_fill():
    assert mixing.water_fill([10, 100], [1, 1], 110, 2.0) == [20.0, 90.0]
    assert mixing.water_fill([], [], 0, 2.0) == [] and mixing.water_fill([0, 5], [1, 1], 7.5, 2.0) == [0.0, 7.5]


# placement


def test_groups_are_placed_by_the_highest_dot_product(spark):
    """Few groups, all heavy: each goes where its vector fits best, in plain loops."""
    texts = [prose(300 + k, 5 + 11 * k % 90) for k in range(20)]
    rows = [(1000 * k + i, t) for k, t in enumerate(texts) for i in range(1 + k % 4)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=3).collect()
    vectors = {hashlib.md5(t.encode()).hexdigest(): [n * (len(t.encode()) + 1), n * len(t.split()), n] for k, t in enumerate(texts) for n in [1 + k % 4]}
    part = [sum(v[d] for v in vectors.values()) / 3 for d in range(3)]
    weights, room, want = (1.0, 0.25, 0.1), [list(part) for _ in range(3)], {}
    for group, v in sorted(vectors.items(), key=lambda x: (-x[1][0], -x[1][2], x[0] + "-1")):
        fit = [sum(weights[d] * (room[s][d] / part[d]) * (v[d] / part[d]) for d in range(3)) for s in range(3)]
        best = max(range(3), key=lambda s: (round(fit[s], 12), -s))
        want[group] = best
        room[best] = [a - b for a, b in zip(room[best], v, strict=True)]
    assert {r["doc_id"]: r["shard"] for r in out} == {d: want[hashlib.md5(t.encode()).hexdigest()] for d, t in rows}


def test_a_group_without_doc_ids_is_cut_too(spark):
    rows = [(None, "hot text")] * 3000 + [(7, "warm text")] * 2000 + [(i, prose(i, 9)) for i in range(50)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=8).collect()
    assert len(out) == len(rows)
    sums = collections.Counter()
    for r in out:
        sums[r["shard"]] += r["size"]
    assert len(sums) == 8 and max(sums.values()) < 1.2 * min(sums.values())
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


# a passage in every document


def test_a_common_passage_reaches_no_range_whole(spark):
    """Each run of documents sends a shingle's count to its range, so ranges grow with runs and not with its documents."""
    from pyspark.sql import functions as F

    common = prose(77, 60)
    rows = [(i, prose(1000 + i, 20) + " " + common) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, _text string").repartition(3)
    posted = jaccard._posted(docs, 8)
    sent = posted.where("kind in (1, 4)").groupBy("part").agg(F.sum(F.length("x") + F.coalesce(F.length("y"), F.length("z"))).alias("bytes"))
    sizes = sorted(r["bytes"] for r in sent.collect())
    assert len(sizes) == 8 and sizes[-1] < 1.5 * sizes[0]
    counts = [r["z"] for r in posted.where("kind = 4").select("z").collect()]
    assert sum(int(np.frombuffer(z, "<u4").max()) for z in counts) >= 1500 and sum(len(z) // 4 for z in counts) < 3 * 400
    out = jaccard.join(docs.withColumnRenamed("_text", "text")).collect()
    assert len(out) == 1500
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = {i: shingles(t) for i, t in rows[:40]}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    component = {r["doc_id"]: r["component_id"] for r in out}
    assert all(component[a] == component[b] for a, b in links)


# 11 Merkle manifest


def hashed(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf_of(r):
    return hashed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashed(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def proofs_of(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text), in plain loops."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    top, out = tree_of([t[-1][0] for t in trees]), collections.Counter()
    for g, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            siblings, at = [], leaf_of((*r[:4], r[4].translate(LOWER))) if tampered else leaf
            for tree, p in ((trees[g], i), (top, g)):
                for level in tree[:-1]:
                    run, k = level[p // 16 * 16 : p // 16 * 16 + 16], p % 16
                    siblings += run[:k] + run[k + 1 :]
                    at, p = hashed(*run[:k], at, *run[k + 1 :]), p // 16
            out[r[0], leaf, trees[g][-1][0], top[-1][0], hashed(*siblings), at, at == top[-1][0]] += 1
    return out


MERKLE = ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def proved(docs, **options):
    from pyspark.sql import functions as F

    from roadlark.llm.common import lower_ascii

    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return merkle.prove(docs, changed={"text": text}, **options)


def test_proofs(odd, odd_rows, none):
    for rows_in_a_part in (5, 10_000):
        got = proved(odd, part_rows=rows_in_a_part).collect()
        assert by_text(got, *MERKLE) == proofs_of([(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows])
    assert proved(none).count() == 0


def test_proofs_over_ragged_partitions(spark):
    """A hot source and copies of one row over many partitions, sources of one row, and trees whose last run is one node."""
    rows = [(i, (None, "hot", "hot", "b", "é")[i % 5], "en", i % 7, f"Text {i}" if i % 11 else None) for i in range(700)]
    rows += [(None, "hot", None, None, None)] * 40 + [(5, "hot", "en", 1, "Same")] * 50 + [(10**6 + i, f"s{i}", "x", 0, "T") for i in range(257)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    got = proved(docs, part_rows=23, siblings=True).collect()
    assert by_text(got, *MERKLE) == proofs_of(rows)
    assert all(hashed(*r["siblings"]) == r["proof_sha256"] for r in got)
    for alone in (rows[:1], rows[:1] * 17):
        assert by_text(proved(spark.createDataFrame(alone, docs.schema), part_rows=2).collect(), *MERKLE) == proofs_of(alone)


# 12 periodic runs


def runs_of(words, least=6, periods=4):
    """(start, length, smallest period) of all runs, by comparing each word with the one a period on."""
    out = []
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(least, periods * p) and not any(all(words[x] == words[x + d] for x in range(i, i + size - d)) for d in range(1, p)):
                out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def kept_of(words, runs):
    lost = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in lost)


def test_all_runs_of_short_texts():
    """Runs of two periods on, where squares overlap, nest and recur elsewhere in another rotation."""
    import itertools
    import random

    rng = random.Random(5)
    cases = [list(x) for n in range(1, 9) for x in itertools.product((0, 1), repeat=n)] + [[rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(9, 60))] for _ in range(300)]
    fibonacci = [[1], [1, 0]]
    for _ in range(8):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for words in [*cases, fibonacci[-1], [0] * 300, [0, 1, 2] * 60 + [2, 0, 1] * 60 + [1, 2, 0, 1, 2]]:
        found = tandem.find_runs(np.array([-1, *words, -2]))
        assert sorted(zip(*(x.tolist() for x in found)), key=lambda x: (x[0], x[2])) == [(a + 1, b, c) for a, b, c in runs_of(words, 2, 2)], words


def test_runs_of_texts(spark, odd, odd_rows, none):
    import random

    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in odd_rows]
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            unit = [f"w{rng.randint(0, 5)}" for _ in range(rng.randint(1, 7))]
            again = unit * rng.randint(1, 7)
            words += again[: rng.randint(1, len(again))] + [f"x{rng.randint(0, 99)}" for _ in range(rng.randint(0, 3))]
        rows.append((1000 + i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows.append((5000, "ha " * 30_000 + "ho hi " * 20_000))
    out = tandem.runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_text=True).collect()
    want = collections.Counter()
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        runs = runs_of(words) if doc_id != 5000 else [(0, 30_000, 1), (30_000, 40_000, 2)]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        want[doc_id, len(words), tuple(runs), best, kept_of(words, runs)] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["strongest"] and tuple(r["strongest"]), r["collapsed"]) for r in out) == want
    assert all(hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"] for r in out)
    assert tandem.runs(odd).count() == len(odd_rows) and tandem.runs(none).count() == 0


def test_runs_query(spark, tmp_path, odd, odd_rows):
    from roadlark.llm.queries import op12_tandem_runs

    odd.write.parquet(str(tmp_path / "documents.parquet"))
    want = collections.Counter()
    for r in odd_rows:
        words, h = WORD.findall(r[1] or ""), zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = runs_of(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        spelled = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want[r[0], len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashed(spelled), hashed(kept_of(words, runs))] += 1
    got = op12_tandem_runs(spark, str(tmp_path)).collect()
    assert by_text(got, "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256") == want


# 13 language identification


def test_letter_ngrams(monkeypatch):
    """Counts of n-grams within a word and its boundaries; the same however a text is cut."""
    texts = ["Hello, wörld a", "", "12 3", "x", "ab  cd\nabc def", "É", "日本語 ok"]

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        return sum(max(0, len(w) + (0 if n == 1 else 2) - n + 1) for w in words for n in langid.ORDERS)

    found = langid.counts(texts)
    assert found.sum(1).tolist() == [grams(t) for t in texts]
    assert (langid.counts(["ab cd"]) == langid.counts(["(cd)"]) + langid.counts(["ab"])).all()
    again = ["hello wörld again and again, " * 4, "one two"]
    whole = langid.counts(again)
    monkeypatch.setattr(langid, "SEGMENT_CHARS", 16)
    assert (langid.counts(again) == whole).all()


def test_machine_is_optimal():
    """The weights of dual coordinate descent leave no gradient of the squared hinge loss."""
    rng = np.random.default_rng(2)
    x = rng.random((40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    signs = np.where(x[:, 0] + 0.2 * rng.random(40) > 0.5, 1.0, -1.0)
    w = langid.fit([(np.arange(6), r) for r in x], signs, rounds=4000)
    each = 10.0 * 40 / (2 * np.where(signs > 0, (signs > 0).sum(), (signs < 0).sum()))
    wide = np.c_[x, np.ones(40)]
    own = np.r_[w[:6], w[-1]]
    loss = np.maximum(0, 1 - signs * (wide @ own))
    assert np.abs(own - 2 * (each * loss * signs) @ wide).max() < 0.05


def test_languages(spark):
    """Held-out accuracy over two families, one language without relatives, and short texts."""
    import random

    rng = random.Random(3)
    stems = {"en": "the of ing tion her and", "de": "der die sch ung ein und", "fr": "le la eau que oi est", "es": "el los que ción ar y", "eu": "zk tx kk etx zu aren"}
    rows = []
    for i in range(1200):
        lang = sorted(stems)[i % 5]
        words = ["".join(rng.choice(stems[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([2, 5, 40]))]
        rows.append((i, " ".join(words).capitalize() + ".", None if i % 17 == 0 else lang))
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    want = {i: sorted(stems)[i % 5] for i in range(1200)}
    assert {r["doc_id"]: r["held_out"] for r in out} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in want}
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_languages_of_odd_rows(spark, odd, odd_rows, none):
    out = langid.identify(odd).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(r[0] for r in odd_rows)
    letters = {r[0] for r in odd_rows if any(c.isalpha() for c in r[1] or "")}
    for r in out:
        if r["doc_id"] is not None:
            assert (r["lang_pred"], r["score"]) == (("en", 1.0) if r["doc_id"] in letters else ("und", 0.0))
    assert langid.identify(none).count() == 0
    unlearned = spark.createDataFrame([(1, "some text", None), (2, "more", None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(unlearned).collect()} == {("und", 0.0)}
