"""Each operator against a brute-force version, on whole small tables and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from quire.llm import common, exact, licences, mixing, packing, pii, rans, registry, repeats, simhash, sketch, tokens, toxicity

LONG = " ".join(f"w{i % 977} the" for i in range(20_000))
COPY = "One passage of more than thirteen words that stands in many of these odd texts, again and again, word for word."
ODD = [
    (1, COPY), (2, COPY.replace(" ", "\n\t ")), (3, ""), (4, None), (5, " \n "), (6, LONG), (7, LONG + " end"), (8, "one"), (9, "zwei Wörter"), (10, "x" * 70_000), (11, "日本語のテキスト 日本語"),
    (12, "mail a.b@c.de and x@y.org, ip 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 phone +1 (523) 555-1055 +12"), (13, "Licensed under the Apache License, Version 2.0. MIT LICENSE mit-license"),
    (14, "<|startoftext|> A'b <|endoftext|> don't ... !!! it's"), (15, COPY + " " + COPY), (16, "idiot " * 20), (17, "a_b@c_d@e.f 4111111111111111 4111111111111111"), (18, "\x00\x1c\x85\xa0 nul"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 9, "s0" if i % 3 else None, "en") for i, t in ODD]
    rows += [(i, t, 9, "s1", "en") for i, t in ODD[:3]] + [(None, COPY, 9, None, "en"), (None, None, 9, None, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, size int, source string, lang string").withColumnRenamed("lang", "component_id")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda texts: [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def rows(df):
    return df.toPandas()


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_tokens_are_the_librarys(ids, plain):
    texts = [t for _, t in plain] + [t or "" for _, t in ODD]
    mine = tokens.WordTokenizer(tokens.vocabulary_path()).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in mine] == ids(texts)


def test_a_batch_looks_up_different_words_only():
    class Counted(dict):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

        def get(self, word, default=None):
            looked.append(word)
            return super().get(word, default)

    looked = []
    tokenizer = tokens.WordTokenizer(tokens.vocabulary_path())
    tokenizer.known = Counted()
    tokenizer.encode([b"One two, two!! TWO one. " * 500, b"one,"] * 2)
    assert sorted(looked) == sorted(tokenizer.known) and set(looked) - {b""} == {b"one", b"two", b",", b"!!", b"."}


def test_token_arrays_are_the_librarys(ids):
    """Words, marks and what looks like a token of its own, also where one text ends and the next begins; slices and nulls."""
    rng = random.Random(5)
    some = [*"aZé1,.!(|' \n\t\x1c\x85\xa0\u0301\u0338\u2003İΣſ٣", "the", "'s", "%%", "<|", "|>", "<|endoftext|>", "<|EndOfText|>", "你好", "ﬁ"]
    texts = [None if rng.random() < 0.05 else "".join(rng.choices(some, k=rng.randint(0, 9))) for _ in range(4000)]
    wanted, column = ids([t or "" for t in texts]), pa.array(texts)
    tokenizer = tokens.WordTokenizer(tokens.vocabulary_path(), words=300, long=6)
    for at in range(0, len(texts), 301):
        found, bounds = tokenizer.arrays(column.slice(at, 301))
        assert [found[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == wanted[at : at + 301]
        assert max(map(len, tokenizer.known)) <= 6
    assert [len(x) for x in tokenizer.arrays(column.slice(0, 0))] == [0, 1]


def test_large_batches():
    batches = [pa.RecordBatch.from_pydict({"text": ["x" * n]}) for n in (10, 400, 900, 5000, 30, 40)]
    joined = list(common.large_batches(iter(batches), 1500))
    assert [[len(x) for x in b.column("text").to_pylist()] for b in joined] == [[10, 400, 900], [5000], [30, 40]]
    assert list(common.large_batches(iter([]))) == []


def packed(found, texts, ids, capacity=2048):
    pieces = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    wanted = collections.Counter()
    for i, x in zip([i for i, _ in texts], ids([t or "" for _, t in texts]), strict=True):
        x = [*x, 0]
        wanted.update((i, k // capacity, k, len(x[k : k + capacity]), crc(x[k : k + capacity])) for k in range(0, len(x), capacity))
    for _, g in found.groupby("sequence_id"):
        at = 0
        for o, n in sorted(zip(g.offset, g.length, strict=True)):
            assert o == at
            at += n
        assert at <= capacity
    return pieces, wanted


def test_packing(spark, docs, odd, plain, ids):
    found = rows(packing.pack(docs, tokens.vocabulary_path()))
    pieces, wanted = packed(found, plain, ids)
    assert pieces == wanted and found.sequence_id.nunique() <= -(-int(found.length.sum()) // 2048) + 2
    split = rows(packing.pack(docs.repartition(16), tokens.vocabulary_path(), items=50, fan_in=2))
    pieces, again = packed(split, plain, ids)
    assert pieces == again
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.doc_id is not None]
    pieces, wanted = packed(rows(packing.pack(odd.where("doc_id IS NOT NULL"), tokens.vocabulary_path())), texts, ids)
    assert pieces == wanted
    assert packing.pack(odd, tokens.vocabulary_path()).where("doc_id IS NULL").count() == 2 and packing.pack(odd.limit(0), tokens.vocabulary_path()).count() == 0
    bins, offsets, used = packing.best_fit([5, 5, 3, 7, 10], 10)
    assert sorted(used) == [10, 10, 10] and len(offsets) == len(bins) == 5


def simhash_plain(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys, prints):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("shard", [1 << 15, 8])
def test_simhash(docs, odd, plain, shard):
    for df, texts in ((docs, plain), (odd, [x for x in ODD if x[0] != 6 and x[0] != 7] + [ODD[5], ODD[6]])):
        found = rows(simhash.near_duplicates(df, width=3, words=1, radius=3, ratio=None, distinct=False, shard=shard))
        prints = {i: simhash_plain(t) for i, t in texts}
        root = components(sorted(prints), prints)
        for r in found.itertuples():
            if r.doc_id == r.doc_id:
                assert int(np.int64(r.f0)) & (1 << 64) - 1 == prints[int(r.doc_id)] and r.component_id == root[int(r.doc_id)]
        assert len(found) == df.count()


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 300)] for _ in range(12)]
    texts = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join([*b[:150], "changed", *b[151:]])) for i, b in enumerate(base)]
    df = spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, size string")
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == list(range(12)) and simhash.deduplicate(df).columns == df.columns
    assert simhash.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize(("cut", "hub"), [(1 << 15, 64), (7, 64), (1 << 15, 3)])
def test_near_duplicates_are_the_pairs_of_four_fifths(spark, docs, odd, plain, cut, hub, monkeypatch):
    monkeypatch.setattr(simhash, "CUT", cut)  # keys that more points have are cut into shards
    monkeypatch.setattr(simhash, "HUB", hub)  # texts with as many compared pairs bound those of others
    rng = np.random.default_rng(7)
    texts = [(i, t) for i, t in plain]
    at = 1 + max(i for i, _ in texts)
    for n in [8, 9, 12, 23, 60, 150, 265] * 12:  # copies with words put in or cut off, on both sides of the threshold
        base = [f"w{x}" for x in rng.integers(0, 9000, n)]
        cut = int(rng.integers(0, max(2, n // 4)))
        other = list(base[cut // 2 : n - cut + cut // 2])
        if n > 20 and rng.random() < 0.5:
            other[len(other) // 2] = "other"
        texts += [(at, " ".join(base)), (at + 1, " ".join(other))]
        at += 2
    texts += [(at + i, " ".join(f"g{x}" for x in range(3 * i, 3 * i + 90))) for i in range(20)]  # a chain
    at += 20
    base = [f"h{x}" for x in rng.integers(0, 9000, 120)]
    for i in range(90):  # a group of near copies, similar to the first, not all to each other; over LEAF, so a tree has them
        other = list(base)
        for k in rng.integers(0, 120, 3):
            other[k] = f"other{i}"
        texts.append((at + i, " ".join(other)))
    at += 90
    for i in range(60):  # and some that are too far from it, every third like the one before
        if i % 3 != 1:
            other = list(base)
            for k in rng.choice(120, 8, replace=False):
                other[k] = f"far{i}"
        texts.append((at + i, " ".join([*other[:-1], f"end{i}"])))
    odd_texts = [(i, t) for i, t in ODD] + [(i, t) for i, t in ODD[:3]]

    def sets(text):
        w = words((text or "").encode().lower().decode() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    for df, have in ((spark.createDataFrame(texts, "doc_id long, text string"), texts), (odd, odd_texts)):
        of = [(i, sets(t)) for i, t in have]
        parent = {i: i for i, _ in of}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for k, (a, x) in enumerate(of):
            for b, y in of[:k]:
                if x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
        assert sorted(r.doc_id for r in simhash.deduplicate(df.where("doc_id IS NOT NULL")).collect()) == sorted(i for i, _ in of if find(i) == i)
    assert simhash.deduplicate(odd).where("doc_id IS NULL").count() == 2


def test_candidates_miss_few_pairs_of_four_fifths():
    """Rates over random sets of one similarity: keys in common, and fingerprints within the radius."""
    rng = np.random.default_rng(11)
    for n, shared in [(5, 4), (10, 9), (24, 21), (27, 24), (135, 120), (450, 400)]:  # sizes n and n, or n and n - 1
        met = near = 0
        for _ in range(400):
            x = rng.integers(0, 1 << 63, 2 * n, np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * n, np.uint64)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:shared], x[n : n + (n - shared if n > 5 else 0)]]))
            assert shared / (len(a) + len(b) - shared) >= 0.77
            met += bool(set(simhash.keys_of(a).tolist()) & set(simhash.keys_of(b).tolist()))
            apart = int(np.bitwise_count(simhash.fingerprint(a, 4) ^ simhash.fingerprint(b, 4)).sum())
            near += apart <= (simhash.SMALL_RADIUS if min(len(a), len(b)) < simhash.SMALL else simhash.RADIUS)
        assert met >= 399 and near >= 396, (n, met, near)


def test_rans(spark, docs, odd, plain, ids, tmp_path):
    tokens_ = [[*x, 1] for x in ids([t for _, t in plain])]
    path = tokens.vocabulary_path()
    rans.write_tokens(docs, path, f"{tmp_path}/a")
    found = rows(rans.read_tokens(spark, f"{tmp_path}/a")).sort_values("doc_id")
    starts = np.cumsum([0, *map(len, tokens_)])[:-1].tolist()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found.itertuples()] == [(i, s, len(x), crc(x)) for (i, _), s, x in zip(plain, starts, tokens_, strict=True)]
    assert [np.frombuffer(x, "<u4").tolist() for x in found.ids] == tokens_
    size = sum(len(r.data) for r in spark.read.parquet(f"{tmp_path}/a/blocks").collect())
    assert size < 2 * sum(map(len, tokens_))  # below 16 bits a token
    rans.write_tokens(odd, path, f"{tmp_path}/b")
    back = rows(rans.read_tokens(spark, f"{tmp_path}/b"))
    assert len(back) == odd.count() and back.n_tokens.sum() == max(back.start + back.n_tokens)
    rans.write_tokens(odd.limit(0), path, f"{tmp_path}/c")
    assert rans.read_tokens(spark, f"{tmp_path}/c").count() == 0


def test_rans_blocks_are_checked():
    rng = np.random.default_rng(1)
    x = np.minimum(rng.geometric(0.01, 200_000), 40_000).astype(np.uint32)
    coder = rans.Coder(rans.quantise(np.bincount(x, minlength=40_001)))
    data = coder.encode([None, 2], [5, len(x) - 5], x)
    doc_ids, lengths, back = coder.decode(data)
    assert doc_ids == [None, 2] and lengths == [5, len(x) - 5] and (back == x).all()
    for at in (50, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            coder.decode(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_mixing(spark, docs, odd):
    for df in (docs, odd):
        copies, sizes, targets = mixing.balanced(df)
        found = rows(copies)
        assert len(found) == df.count() and found.copies.isin([0, 1, 2]).all()
        total = sum(sizes.values())
        assert sum(targets.values()) == pytest.approx(min(1.5 * total, 2 * total)) and all(targets[s] <= 2 * sizes[s] + 1e-6 for s in sizes)
        for s in sizes:
            own = found[found.source.isnull() if s is None else found.source == s]
            assert own["size"].sum() == sizes[s] and abs((own["size"] * own.copies).sum() - targets[s]) <= max(own["size"].max(), 0.02 * targets[s])
    again = rows(mixing.balanced(docs)[0]).set_index("doc_id").copies
    assert (again == rows(mixing.balanced(docs)[0]).set_index("doc_id").copies.reindex(again.index)).all()
    assert mixing.mixture(docs).columns == docs.columns and mixing.mixture(odd.limit(0)).count() == 0
    assert mixing.shares({"a": 100, "b": 1, None: 100}) == {"a": pytest.approx(200), "b": 2.0, None: pytest.approx(99.5)}


def test_mixture_takes_rows_by_themselves(spark, docs, odd):
    for df in (docs, odd.withColumnRenamed("lang", "copies") if "lang" in odd.columns else odd.withColumnRenamed("size", "copies")):
        copies = collections.Counter()
        for r in mixing.balanced(df)[0].collect():
            copies[r.doc_id, r.source, r["size"]] += r.copies
        taken = mixing.mixture(df)
        assert taken.columns == df.columns
        found = collections.Counter((r.doc_id, r.source, len(words(r.text))) for r in taken.collect())
        assert found == +copies
    rows_ = [(None, f"w{i} " * (1 + i % 40), f"s{i % 2}") for i in range(400)] + [(7, f"v{i} " * (1 + i % 40), f"s{i % 2}") for i in range(400)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    taken = mixing.mixture(df).collect()
    for s, t in mixing.balanced(df)[2].items():  # no doc_id is taken or left as a whole
        assert abs(sum(len(words(r.text)) for r in taken if r.source == s) - t) < 40
    assert 0 < sum(r.doc_id is None for r in taken) and {len(words(r.text)) for r in taken} == set(range(1, 41))


def test_mixing_solves_the_dual(spark, docs):
    """The rates against a bisection over single documents, without cells: least relative entropy, so exponentially tilted by size."""
    rows_ = mixing.keyed(docs)
    _, sizes, targets = mixing.balanced(docs)
    found = {(r.source_key, r.cell): r.rate for r in mixing.rates(rows_, targets).collect()}
    docs_ = rows_.toPandas()
    for s, target in targets.items():
        own = docs_[docs_.source.isnull() if s is None else docs_.source == s]
        x, mean = own["size"].to_numpy(float), sizes[s] / len(own)
        if target >= 2 * sizes[s] * (1 - 1e-9):
            assert all(found[k, c] == 2 for k, c in zip(own.source_key, own.cell) if c)
            continue
        low, high = -200.0, 200.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (x * np.minimum(2, np.exp(np.minimum(mid * x / mean, 50)))).sum() < target else (low, mid)
        exact_ = np.minimum(2, np.exp(np.minimum(low * x / mean, 50)))
        got = np.array([found[k, c] for k, c in zip(own.source_key, own.cell)])
        assert np.allclose(got, exact_, rtol=0.05, atol=0.02) and abs((got * x).sum() - target) < 0.01 * target


def test_an_unsolved_dual_is_an_error(spark):
    cells = spark.createDataFrame([("sa", 3, 10, 30)], "source_key string, cell int, n long, s long")
    with pytest.raises(ArithmeticError):
        mixing._newton(cells, {"sa": (10, 30, 17.0)}, tolerance=0.0, rounds=3)


def test_hot_cell_is_cut_by_hash(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "'a' AS source", "repeat('w ', 10) AS text")
    found = rows(mixing.mix(mixing.keyed(df), {"a": 36_000.0}))
    assert found.copies.sum() == 3600 and len(found) == 5000


def test_large_groups_are_looked_up_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_GROUPS", 4)
    keys = [1] * 500 + [2] * 30 + [3] * 4 + [4] * 2 + [5] + [None] * 6
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k long")
    groups = spark.createDataFrame([(k, keys.count(k), f"g{k}") for k in (1, 2, 3, 4)], "k long, n long, name string")
    found = sorted((r.i, r.k, r.n, r["name"]) for r in common.looked_up(df, groups, ["k"], "n").collect())
    assert found == [(i, k, keys.count(k) if k and k < 5 else None, f"g{k}" if k and k < 5 else None) for i, k in enumerate(keys)]


def test_exact(docs, odd, small, spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    wanted = con.sql(exact.ORACLE).df().sort_values("doc_id")
    found = rows(exact.op5_exact_dedup(spark, small)).sort_values("doc_id")
    assert found.astype(str).values.tolist() == wanted[found.columns].astype(str).values.tolist()
    got = rows(exact.duplicates(odd, digests=True))
    for r in got.itertuples():
        if r.doc_id == r.doc_id:
            t = re.sub(r"[\x20\x09-\x0D]+", " ", dict(ODD)[int(r.doc_id)] or "")
            assert bytes(r.text_sha256) == hashlib.sha256(t.encode()).digest()
    lazy = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.duplicates(docs).collect()}
    for r in exact.duplicates(docs, digests=True).collect():
        assert lazy[r.doc_id][:3] == (r.keep_id, r.group_size, r.kept) and lazy[r.doc_id][3] in ((r.text_sha256,) if r.group_size > 1 else (None, r.text_sha256))
    shared = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (2, "b", 3), (2, "b", 4), (3, None, 5), (3, "", 6)], "doc_id long, text string, digest int")
    assert sorted((r.doc_id, r.text) for r in exact.deduplicate(shared).collect() if r.text) == [(1, "a"), (2, "b")] and exact.deduplicate(shared).count() == 3
    kept = exact.deduplicate(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 2 OR doc_id = 4").count() == 0 and kept.where("doc_id = 1").count() == 1 and exact.deduplicate(odd.limit(0)).count() == 0


def shingles(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches(spark, docs, odd, plain):
    found = rows(sketch.edits(docs)).sort_values("doc_id").reset_index(drop=True)
    assert len(found) == len(plain)
    for k, r in found.iterrows():
        old, new = plain[k][1], plain[(k + 1) % len(plain)][1]
        n = len(old)
        edited = old[: n - n // 4] + new[: n // 4]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (plain[k][0], n, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(shingles(old), shingles(edited))) < 0.2 and abs(r.near_next - jaccard(shingles(old), shingles(new))) < 0.2
    small_ = sketch.Sketcher()
    a, b = small_.sketch(LONG.encode()), small_.sketch(" ".join(LONG.split()[:6000]).encode())
    assert abs(small_.distinct(a) - len(shingles(LONG))) < 0.35 * len(shingles(LONG)) and small_.containment(b, a) > 0.7
    assert (sketch.sketch_of(sketch.text_of(a)) == a).all() and (small_.merge(a, b) == small_.sketch(LONG.encode())).mean() > 0.9
    got = rows(sketch.edits(odd))
    assert len(got) == odd.count() and got.fingerprint.notnull().all() and sketch.edits(odd.limit(0)).count() == 0 and sketch.edits(odd.where("doc_id = 9")).count() == 1
    prints = sketch.fingerprints(docs)
    whole = sketch.merged(prints.selectExpr("doc_id % 2 AS part", "fingerprint"), ["part"])
    for r in whole.collect():
        assert r.fingerprint == sketch.text_of(small_.merge(*[small_.sketch(t.encode()) for i, t in plain if i % 2 == r.part]))


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def private_plain(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_private_data(spark, docs, odd, plain, small):
    found = {r.doc_id: r for r in pii.op7_private_data(spark, small).collect()}
    for i, t in plain:
        base = private_plain(t)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        r = found[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[3] == k for x in base) for k in KINDS)
        assert set(joined.split(",")) <= set(r.spans.split(","))
    hard = [(i, t) for i, t in ODD] + [(50, "1" * 30_000), (51, "a" * 30_000 + "@b.c"), (52, "(" * 20_000), (53, "1.2.3.4 " * 500), (54, "+" * 9_000 + "1 " * 9_000), (55, "a@b." * 3000), (56, "日本 a@b.co 日本 10.0.0.1")]
    df = spark.createDataFrame([(i, t, "x") for i, t in hard], "doc_id long, text string, spans string")
    for r in pii.private(df).collect():
        text = dict(hard)[r.doc_id] or ""
        assert [(x.s, x.k, x.e) for x in r.spans if x.base] == [x[:3] for x in private_plain(text)]
    assert pii.private(odd).count() == odd.count() and pii.private(odd.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in pii.masked(df).where("doc_id IN (4, 56)").collect()}
    assert clean == {4: None, 56: "日本 <EMAIL> 日本 <IP>"}


def test_overlapping_spans_are_masked_as_one(spark):
    df = spark.createDataFrame([(1, "x 4111 1111 1111 1111 y"), (2, "a@1.2.3.4.de +1 (523) 555-1055"), (3, "a@b.co" * 300), (4, "é" * 3000 + " 10.0.0.1 " + "z" * 2000 + " q@w.de"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert got[1] == "x <CARD> y" and got[2] == "<EMAIL> <PHONE>" and got[4] == "é" * 3000 + " <IP> " + "z" * 2000 + " <EMAIL>" and got[5] == "" and got[3] == re.sub(KINDS["email"], "<EMAIL>", "a@b.co" * 300)


def test_dense_texts_take_time_in_proportion(spark):
    """A megabyte of numbers in one text; spans still are those of the rules."""
    import time

    unit = "10.0.0.1 x +1 (523) 555-1055 y 4111 1111 1111 1111 z a@b.de "
    text = unit * (1_000_000 // len(unit))
    df = spark.createDataFrame([(1, text), (2, "1.2.3.4 " * 60_000)], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r for r in pii.private(df).collect()}
    assert time.time() - began < 60  # both texts; a quadratic walk takes many minutes
    for r in found.values():
        assert [(x.s, x.k, x.e) for x in r.spans if x.base] == [x[:3] for x in private_plain(text if r.doc_id == 1 else "1.2.3.4 " * 60_000)]


def test_added_spans_are_measured(spark):
    """Loose forms that the base rules miss, planted among numbers that are none: recall and precision of what the classifier adds."""
    rng = np.random.default_rng(3)
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    rows_, planted = [], {}
    for i in range(600):
        name, kind = f"user{digit(3)}", i % 6
        text, span = {
            0: ("please write mail to ", f"{name} [at] example [dot] com"),
            1: ("call my phone ", f"(523) 555-{digit(4)}"),
            2: ("the server address ", ":".join(f"{x:04x}" for x in rng.integers(0, 65536, 8))),
            3: ("order no ", f"{digit(7)}"),
            4: ("see page ", f"{digit(2)}-{digit(4)}-{digit(2)}"),
            5: ("write mail to ", f"{name}@example.com"),
        }[kind]
        before = " ".join(f"w{x}" for x in rng.integers(0, 50, 5)) + " " + text
        rows_.append((i, before + span + " and more"))
        if kind < 3:
            planted[i] = (len(before), len(before) + len(span))
    found = pii.private(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    added = {(r.doc_id, x.s, x.e) for r in found for x in r.spans if not x.base}
    wanted = {(i, *s) for i, s in planted.items()}
    recall, precision = len(added & wanted) / len(wanted), len(added & wanted) / max(1, len(added))
    assert recall > 0.9 and precision > 0.9, (recall, precision)


def test_reliabilities():
    got = pii.reliabilities({(0, "++0++"): 50, (0, "--0--"): 40, (0, "+-0+-"): 10})
    assert got[0, "++0++"] > 0.9 and got[0, "--0--"] < 0.1


def test_licences(spark, docs, odd, plain):
    found = {r.doc_id: r for r in licences.scan(docs).collect()}
    for i, t in plain + [(i, t or "") for i, t in ODD]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        places = sorted((k, label) for p, label in licences.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = found.get(i) if (i, t) in plain else None
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) if r else licences.Scanner().scan(t.encode())[:5]
        assert tuple(got) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
    scanner = licences.Scanner()
    mit = licences.TEMPLATES[0][1]
    assert scanner.scan(mit.encode())[5] == "mit" and scanner.scan(f"x {mit.replace('free of charge', 'for nothing')} y".encode())[7][0]["first"] == 1
    assert scanner.scan(b"the rights to use the software and of the license")[5] == ""
    of = lambda label: next(t for x, t in licences.TEMPLATES if x == label and len(t) > 120)
    for label in ("apache", "gpl", "agpl", "lgpl", "bsd", "bsd-3", "isc", "zlib", "epl", "cc0", "unlicense", "boost", "mpl"):
        first = scanner.scan(f"some words before {of(label)} and behind".encode())
        assert label in first[5].split(",") and any(x["label"] == label and x["first"] == 3 and x["covered"] == 1 for x in first[7]), label
    assert "bsd-3" not in scanner.scan(of("bsd").encode())[5].split(",")
    assert licences.scan(odd).count() == odd.count() and licences.scan(odd.limit(0)).count() == 0


def test_automaton():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 3, 30).tolist() for _ in range(3)]
    text = rng.integers(0, 3, 200).tolist()
    found = [n for n, _ in licences.Automaton(seqs).statistics(text)]
    holds = lambda x: any(x == s[i : i + len(x)] for s in seqs for i in range(len(s)))
    assert found == [max(n for n in range(31) if n <= k + 1 and holds(text[k + 1 - n : k + 1])) for k in range(len(text))]


@pytest.mark.parametrize("short", [32, 8])
def test_index_is_exact(monkeypatch, short):
    monkeypatch.setattr(toxicity, "SHORT", short)
    rng = np.random.default_rng(4)
    terms = [np.sort(rng.choice(60, rng.integers(0, 9), replace=False, p=np.arange(1, 61) / 1830)) for _ in range(500)]
    rows_ = [(t, rng.integers(1, 5, len(t))) for t in terms]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    weights = rng.uniform(0.5, 5, 60)
    index = toxicity.Index(toxicity.Examples(np.arange(500), np.zeros(500, np.int8), begin, np.concatenate(terms), np.concatenate([f for _, f in rows_]), []), weights)
    assert 0 < index.matrix.shape[1] < 60 and len(index.at)
    dense = np.zeros((500, 60))
    for i, (t, f) in enumerate(rows_):
        dense[i, t] = index.unit(t, f)[1]
    for q in rows_[:80]:
        [(hits, cosines)] = index.nearest([q])
        x = np.zeros(60)
        x[q[0]] = index.unit(*q)[1]
        all_ = dense @ x
        order = [i for i in np.lexsort((np.arange(500), -all_)) if all_[i] > 1e-7][:15]
        assert len(hits) == len(order) and np.allclose(cosines, np.minimum(all_[order], 1), atol=1e-6) and np.allclose(np.minimum(all_[index.ids[hits]], 1), cosines, atol=1e-6)


def test_toxicity(spark, small, odd):
    rng = np.random.default_rng(9)
    bad = ["scum", "moron", "clown", "trash", "loser"]
    texts = []
    for i in range(600):
        w = [f"w{x}" for x in rng.integers(0, 300, 60)]
        for _ in range(4 if i % 6 == 0 else 0):
            w[rng.integers(0, 60)] = bad[rng.integers(0, 5)]
        texts.append((i, " ".join(w), "s"))
    df = spark.createDataFrame(texts, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0), 1) for i in range(500)], "doc_id long, toxic int, quality int")
    found = rows(toxicity.toxicity(df, labels))
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and found.score.between(0, 1).all()
    out = found[found.held_out | (found.doc_id >= 500)]
    assert (out.predicted == (out.doc_id % 6 == 0)).mean() > 0.97
    assert toxicity.clean(df, labels).columns == df.columns
    # labels of held-out rows change nothing
    other = rows(toxicity.toxicity(df, labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - toxic, toxic) AS toxic")))
    assert found.set_index("doc_id").score.equals(other.set_index("doc_id").score.reindex(found.doc_id))
    for some in (labels.limit(0), labels.where("toxic = 0"), labels):
        got = rows(toxicity.toxicity(odd, some))
        assert len(got) == odd.count() and got.score.between(0, 1).all()
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_toxicity_is_the_cosine_of_whole_texts(spark, small, docs, plain):
    """Neighbours against dense vectors over every word of every text, computed apart."""
    import math

    labelled = toxicity.labels(spark, small)
    scorer, vocabulary = toxicity.fitted(docs.select("doc_id", "text"), labelled)
    split = {i: re.sub(r"[\x00-\x2f:-@\[-`{-\x7f]", " ", t.lower()).split(" ") for i, t in plain}
    counts = {i: collections.Counter(w for x in ws for w in x.encode().split()) for i, ws in split.items()}
    examples = dict(zip(scorer.index.ids.tolist(), scorer.index.toxic.tolist(), strict=True))
    assert len(examples) > 50 and set(vocabulary.numbers()) == {w for i in examples for w in counts[i]}
    df, n = collections.Counter(w for c in counts.values() for w in c), len(plain)
    has = [collections.Counter(w for i, y in examples.items() if y == k for w in counts[i]) for k in (0, 1)]
    size = [sum(y == k for y in examples.values()) for k in (0, 1)]

    def weight(w):
        if not (has[0][w] or has[1][w]):
            return math.log(n + 1) + 1
        rate = [(has[k][w] + 0.5) / (size[k] + 1) for k in (0, 1)]
        z = (rate[1] - rate[0]) / math.sqrt(sum(rate[k] * (1 - rate[k]) / size[k] for k in (0, 1)))
        return (math.log((n + 1) / (df[w] + 1)) + 1) * (1 + max(0, z - toxicity.CHANCE)) ** 2

    def vector(c):
        v = {w: (1 + math.log(f)) * weight(w) for w, f in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    unit = {i: vector(c) for i, c in counts.items()}
    number = vocabulary.numbers()
    for i, _ in plain[:60]:
        known = [(number[w], f) for w, f in counts[i].items() if w in number]
        [(hits, cosines)] = scorer.index.nearest([([t for t, _ in known], [f for _, f in known], sum((1 + math.log(f)) ** 2 for w, f in counts[i].items() if w not in number))])
        all_ = sorted(((-sum(x * unit[k].get(w, 0) for w, x in unit[i].items()), k) for k in examples), key=lambda x: (round(x[0], 9), x[1]))[:15]
        assert np.allclose(cosines, [-c for c, _ in all_ if c < -1e-7], atol=2e-6)
    texts = spark.createDataFrame([(10**6 + i, t) for i, t in plain if i in examples and words(t)], "doc_id long, text string")
    found = toxicity.toxicity(docs.select("doc_id", "text").unionByName(texts), labelled).where("doc_id >= 1000000").collect()
    assert found and all(r.evidence[0].similarity > 1 - 1e-5 for r in found)  # an equal text is found, whatever its words


def cut_plain(texts, n=13):
    first = {}
    for i, t in sorted(texts):
        w = words(t)
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("group", "bits"), [(1 << 22, 64), (1 << 14, 64), (1 << 14, 5)])  # 5 bits of the first hash: all windows clash there
def test_repeats(docs, odd, plain, group, bits):
    for df, texts in ((docs, plain), (odd.where("doc_id IS NOT NULL"), ODD)):
        found = repeats.without_repeats(df, group=group, bucket=1 << 15, bits=bits).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS sha", "repeats").collect()
        wanted = cut_plain(texts)
        assert len(found) == df.count() and all((r.n_words, r.n_removed, r.sha) == wanted[r.doc_id] for r in found)
        assert all(sum(x.words for x in r.repeats) == r.n_removed and all(x.words >= 13 for x in r.repeats) for r in found)
    assert repeats.without_repeats(odd).where("doc_id IS NULL AND n_removed = 0").count() == 2 and repeats.without_repeats(odd.limit(0)).count() == 0


def test_far_apart_doc_ids(spark):
    df = spark.createDataFrame([(-(1 << 62), COPY), (1 << 62, COPY), (5, COPY)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed > 0 for r in repeats.without_repeats(df).collect()} == {-(1 << 62): False, 5: True, 1 << 62: True}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in common.min_labels(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)} and common.min_labels(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_pipeline(spark, small, ids):
    import corpus_pipeline

    docs_ = common.documents(spark, small)
    columns = docs_.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs_.count()
        docs_ = common.save(stage(spark, docs_, small), "t")
        assert docs_.columns == columns and (name == "mixing" or 0 < docs_.count() <= before)
        if name == "exact dedup":
            keys = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs_.collect()]
            assert len(keys) == len(set(keys))
    found = rows(corpus_pipeline.STAGES[-1][1](spark, docs_, small))
    pieces, wanted = packed(found, [(r.doc_id, r.text) for r in docs_.collect()], ids)
    assert pieces == wanted


def test_pipeline_takes_odd_rows(spark, odd, small):
    import corpus_pipeline

    docs_ = odd.selectExpr("doc_id", "text", "component_id AS lang", "source", "CAST(size AS LONG) AS n_chars")
    for some in (docs_, docs_.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = common.save(stage(spark, some, small), "t")
        assert some.columns[0] == "doc_id"


def test_registry():
    assert len({re.match(r"op(\d+)_", x)[1] for x in registry.queries()}) == 10 and set(registry.oracle_sql()) <= set(registry.queries())
